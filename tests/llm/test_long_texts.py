"""Texts of hundreds of thousands of words, whole."""

import public_tokenizers

from mnemoframe.llm import decontam, license_scan, neardup, packing, quality
from tests.llm.fixtures import prose
from tests.llm.test_neardup import shingle_set

LONG = " ".join(prose(k, 5_000) for k in range(50))


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_near_duplicates(spark):
    changed = LONG.replace(" amber", " other", 300)
    rows = {r["doc_id"]: r for r in neardup.near_duplicates(docs(spark, LONG, changed, prose(99, 5_000), LONG[: len(LONG) // 2]), 3, 85).collect()}
    assert {i: r["n_shingles"] for i, r in rows.items()} == {i: len(shingle_set(t, 3)) for i, t in ((1, LONG), (2, changed), (3, prose(99, 5_000)), (4, LONG[: len(LONG) // 2]))}
    assert {i: r["component_id"] for i, r in rows.items()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_license_at_the_end(spark):
    row = license_scan.scan_licenses(docs(spark, f"{LONG} under the MIT License")).first()
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (250_004, 1, 250_002, 250_002, "mit")


def test_packing(spark):
    rows = sorted((r["piece"], r["start"], r["length"], r["sequence_id"]) for r in packing.pack(docs(spark, LONG), public_tokenizers.path("byte_bpe_50k.json")).collect())
    n = len(packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))(LONG)) + 1
    assert sum(r[2] for r in rows) == n and {r[2] for r in rows[1:]} == {1024} and rows[0][2] == (n % 1024 or 1024)
    assert [r[1] for r in rows] == [0, *range(rows[0][2], n, 1024)] and len({r[3] for r in rows}) == len(rows)


def test_leak_at_the_end(spark):
    item = prose(777, 40)
    leaks = decontam.find_leaks(docs(spark, f"{LONG} {item}", LONG), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in leaks} == {1}


def test_quality(spark):
    frame = docs(spark, LONG, prose(1, 200), prose(2, 200), "??? !!! " * 100_000)
    rows = {r["doc_id"]: r for r in quality.classify_quality(frame, spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0)], "doc_id long, quality int")).collect()}
    assert all(r["weight"] is not None for r in rows.values())
    assert rows[4]["weight"] < min(rows[i]["weight"] for i in (1, 2, 3))
