"""Prior and shares of the url filter come from all labelled rows, not from the sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import url_filter
from mnemoframe.llm.queries import URL_RULES
from mnemoframe.llm.samples import per_class


def frame_of(spark, rows):
    frame = spark.createDataFrame(rows, "url string, blocked int")
    host, path = url_filter.host_and_path(frame["url"])
    return frame.withColumns({"host": host, "path": path})


def test_statistics_cover_rows_outside_the_sample(spark, monkeypatch):
    rows = [(f"http://h{k % 50}.org/s/p{k}", int(k % 8 == 0)) for k in range(1600)] + [(f"http://x{k}.rare/s/q", 1) for k in range(3)]
    frame = frame_of(spark, rows)
    whole = url_filter.learn(frame)
    monkeypatch.setattr(url_filter, "TRAIN_URLS", 60)
    sampled = url_filter.learn(frame)
    assert sampled.shares == whole.shares and sampled.shares[""][-1] == 0.5
    assert sampled.base == pytest.approx(whole.base) == pytest.approx(0)


def test_scores_stay_at_the_prior_under_the_cap(spark, monkeypatch):
    """Labels that nothing in the url tells: scores stay about one half, whatever the classes' sizes and the cap."""
    rng = np.random.default_rng(2)
    frame = frame_of(spark, [(f"http://h{k % 5}.org/s/{rng.integers(1 << 40):x}", int(rng.random() < 0.2)) for k in range(3000)]).cache()
    monkeypatch.setattr(url_filter, "TRAIN_URLS", 400)
    model = url_filter.learn(frame)
    scores = [r[0] for r in url_filter.blocked_probability(url_filter.lexical(frame), model).select("blocked_score").collect()]
    assert np.mean(scores) == pytest.approx(0.5, abs=0.1)


def test_urls_without_a_rule_get_both_verdicts(spark):
    """Hosts that no rule covers: the trees tell them apart, and agree with a plain walk over the trees."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rules = [url_filter.rule(r) for r in URL_RULES]
    rows = [r for r in url_filter.filter_urls(pages, rules).collect() if r["rule"] is None]
    assert {r["verdict"] for r in rows if r["host"].endswith(".org")} == {"allow", "block"}
    frame = pages.select("url")
    host, path = url_filter.host_and_path(frame["url"])
    frame = frame.withColumns({"host": host, "path": path})
    match = url_filter.matching(rules, frame["host"], frame["path"])
    model = url_filter.learn(frame.withColumn("blocked", (match["verdict"] == "block").cast("int")))
    scored = url_filter.blocked_probability(url_filter.lexical(frame), model).limit(100).collect()

    def walk(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[url_filter.FEATURES[node[0]]] <= node[1] else node[3]
        return node

    for row in scored:
        plain = 1 / (1 + np.exp(-(model.base + sum(walk(t, row) for t in model.trees))))
        assert row["blocked_score"] == pytest.approx(plain, abs=1e-9)


def test_copies_of_one_url_are_read_once(spark):
    rows = [("http://hot.org/x", 1)] * 3000 + [(f"http://h{k}.org/{k}", k % 2) for k in range(200)]
    read = per_class(frame_of(spark, rows), "blocked", F.xxhash64("url"), 40)
    assert sum(r["url"] == "http://hot.org/x" for r in read) <= 1 and len(read) <= 80
