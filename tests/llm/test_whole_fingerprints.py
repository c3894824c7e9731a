"""Likeness doesn't depend on a text's size, nor on how often its lines repeat."""

import numpy as np
import pyarrow as pa
import pytest

from mnemoframe.llm import fingerprint


def words(seed, n, width=9):
    made = np.random.default_rng(seed).integers(0, 20_000, n)
    return "\n".join(" ".join(f"w{x}" for x in made[i : i + width]) for i in range(0, n, width))


def near_edited(texts):
    edited = [fingerprint._edited(x, y) for x, y in zip(texts, [*texts[1:], texts[0]], strict=True)]
    return fingerprint.likeness(*(fingerprint.vectors(pa.array(x, pa.large_string())) for x in (texts, edited)))


@pytest.mark.parametrize("n", [1_000, 20_000, 100_000, 400_000])
def test_long_texts_stay_near_their_edits(n):
    near = near_edited([words(seed, n) for seed in range(8)])
    assert 0.25 < near.mean() < 0.6 and near.min() > 0.05


@pytest.mark.parametrize("repeats", [1, 50, 500, 70_000])
def test_repeated_lines_stay_near_their_edits(repeats):
    lines = [[f"line{seed}x{k}" for k in range(10)] for seed in range(3 if repeats > 500 else 8)]
    near = near_edited(["\n".join(x * repeats) for x in lines])
    assert 0.2 < near.mean() < 0.6 and near.min() > 0.05


def test_other_texts_stay_far():
    one, other = (fingerprint.vectors(pa.array([words(seed, 100_000) for seed in range(s, s + 8)], pa.large_string())) for s in (0, 100))
    assert fingerprint.likeness(one, other).max() < 0.1


def test_text_form_is_whole():
    v = fingerprint.vectors(pa.array(["ab cd\n" * 70_000, words(1, 500), ""], pa.large_string()))
    back = fingerprint.parse(fingerprint.as_text(v))
    assert all((v[k] == back[k]).all() and v[k].dtype == back[k].dtype for k in v)
    assert (v["counts"].sum(axis=1) >= v["count"]).all()


def test_other_word_order_within_a_paragraph_differs():
    """Pieces of a paragraph in another order are another paragraph, though as like as can be; whole paragraphs may move."""
    lines = words(4, 400, 80).split("\n")
    block = next(fingerprint.bytesvec.blocks(pa.array([lines[0]])))
    pieces = fingerprint._units(block)[1]
    cut = [block.data[a:b].tobytes().decode() for a, b in zip(pieces.starts, pieces.ends, strict=True)]
    assert len(cut) > 5
    other = " ".join(cut[::-1])
    assert fingerprint.fingerprint(other) != fingerprint.fingerprint(lines[0])
    assert fingerprint.fingerprint("\n".join(lines[::-1])) == fingerprint.fingerprint("\n".join(lines))


def test_ranges_of_keys(spark):
    keys = spark.createDataFrame([(int(k),) for k in np.random.default_rng(6).integers(-(2**63), 2**63 - 1, 3000)] + [(5,)] * 500, "key long")
    cuts = fingerprint._cuts(keys, 40)
    assert cuts == sorted(set(cuts)) and 20 < len(cuts) < 40
    rows = keys.select("key", fingerprint._range(keys["key"], cuts).alias("range")).collect()
    assert all(r["range"] == len(cuts) - sum(c < r["key"] for c in cuts) for r in rows)
    assert fingerprint._cuts(keys, 1) == [] and keys.select(fingerprint._range(keys["key"], [7]).alias("r")).distinct().count() == 2
