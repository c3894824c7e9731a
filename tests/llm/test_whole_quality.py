"""The cut between good and bad documents follows all labels, whatever is sampled."""

import numpy as np
import pytest

from mnemoframe.llm import quality


def test_cap_keeps_the_cost_ratio(spark, monkeypatch):
    """400 good and 80 bad documents, overlapping; caps change neither the classes' ratio in the cost nor much of the cut."""
    rng = np.random.default_rng(3)
    vocabulary = {1: [f"fine{k}" for k in range(30)], 0: [f"junk{k}" for k in range(30)]}

    def text(q):
        mixed = rng.random() * 0.7
        return " ".join(rng.choice(vocabulary[1 - q] if rng.random() < mixed else vocabulary[q]) for _ in range(30))

    kinds = [int(k % 6 != 0) for k in range(480)]
    docs = spark.createDataFrame([(k, text(q)) for k, q in enumerate(kinds)], "doc_id long, text string").cache()
    labels = spark.createDataFrame([(k, q) for k, q in enumerate(kinds)] * 2, "doc_id long, quality int")
    effective, threshold = [], quality._share_range

    def spied(good, bad, stands_for=(1.0, 1.0)):
        effective.append(len(good) * stands_for[0] / (len(bad) * stands_for[1]))
        return threshold(good, bad, stands_for)

    monkeypatch.setattr(quality, "_share_range", spied)
    for cap in (6000, 60):
        monkeypatch.setattr(quality, "LABELLED", cap)
        quality.fit(docs, labels)
    assert effective == pytest.approx([5.0, 5.0])


def brute_range(good, bad, stands_for=(1.0, 1.0)):
    """The run of fair thresholds around the best one, by the cost of each."""
    values = sorted({*good, *bad})
    cost = lambda t: quality.COST_OF_REJECTION * stands_for[0] * sum(g < t for g in good) + stands_for[1] * sum(b >= t for b in bad)
    costs = [cost(t) for t in values]
    best = costs.index(min(costs))
    fair = [c <= min(costs) + quality.SLACK * quality.COST_OF_REJECTION * stands_for[0] for c in costs]
    first = next((i + 1 for i in range(best, -1, -1) if not fair[i]), 0)
    last = next((i - 1 for i in range(best, len(fair)) if not fair[i]), len(fair) - 1)
    return (values[first - 1] if first else values[0] - 1), values[last]


def test_range_of_fair_thresholds():
    rng = np.random.default_rng(7)
    for n in (3, 20, 60):
        good, bad = rng.normal(1, 1, 3 * n).round(1), rng.normal(-1, 1, n).round(1)
        for stands_for in ((1.0, 1.0), (3.0, 2.0)):
            assert quality._share_range(good, bad, stands_for) == brute_range(good.tolist(), bad.tolist(), stands_for)


def test_thinned_classes_give_about_the_same_range():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(1, 1, 60_000), rng.normal(-1, 1, 20_000)
    whole, thin = quality._share_range(good, bad), quality._share_range(good[::20], bad[::4], (20.0, 4.0))
    assert np.mean(thin) == pytest.approx(np.mean(whole), abs=0.4)
    assert quality._share_range(np.repeat(good[:50], 2), bad[:50])[0] == pytest.approx(quality._share_range(good[:50], bad[:50], (2.0, 1.0))[0], abs=1.0)


def test_half_of_the_densest_place_stays(spark):
    frame = spark.createDataFrame([(float(w),) for w in (9, 8, 5.2, 5.4, 5.6, 5.8, 3.1, 3.2, 1.5, -4)], "_weight double")
    assert quality._sample_size(frame, 1.0, 7.0) == 2 + 2
    assert quality._sample_size(frame, 1.0, 4.0) == 6 + 1
    assert quality._sample_size(frame, 6.0, 7.0) == 2


def test_seeds_draw_different_documents(spark):
    """With the registered query's settings the noise decides over documents, few of them, and hardly over good ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = [{r["doc_id"] for r in quality.classify_quality(docs, labels, seed=seed).where("kept").select("doc_id").collect()} for seed in range(1, 7)]
    assert len({len(k) for k in kept}) == 1
    assert 2 <= len(set.union(*kept) - set.intersection(*kept)) < 0.05 * len(kept[0])
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert all(len(good - k) <= 0.01 * len(good) for k in kept)
