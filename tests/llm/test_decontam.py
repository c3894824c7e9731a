"""Decontamination against the full dynamic programme over each text and item."""

import random

import pytest

from mnemoframe.llm import decontam
from mnemoframe.llm.queries import op7_decontamination
from tests.llm.fixtures import documents, nothing, prose


def least_distance(pattern, text):
    """Least edit distance of the pattern to any part of the text (Sellers, 1980)."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        before, row = row, [0]
        for i, p in enumerate(pattern, 1):
            row.append(min(before[i] + 1, row[i - 1] + 1, before[i - 1] + (p != c)))
        best = min(best, row[-1])
    return best


def edited(text, n, seed):
    rng, out = random.Random(seed), list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "#"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "%")
    return "".join(out)


@pytest.mark.parametrize("seed", range(20))
def test_bit_parallel_distance(seed):
    rng = random.Random(seed)
    pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
    text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 200)))
    assert decontam.distance_within(pattern, text)[0] == least_distance(pattern, text)


def test_finds_all_within_budget(spark):
    items = [(k, prose(100 + k, 8 + k)) for k in range(6)]
    docs, number = [], 0
    for item_id, item in items:
        budget = int(len(item) * decontam.ERROR_RATE)
        for edits in (0, budget, budget + 1, 3 * budget + 6):
            docs.append((number, f"{prose(number + 300, 9)} {edited(item, edits, number)}\n{prose(number + 400, 7)}"))
            number += 1
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in found.collect()}
    wanted = {}
    for doc_id, text in docs:
        for item_id, item in items:
            distance = least_distance(item, decontam.normalised(text))
            if distance <= int(len(item) * decontam.ERROR_RATE):
                wanted[doc_id, item_id] = distance
    assert got == wanted and len(got) >= 12


def test_query_finds_planted_passages(spark, small):
    docs = {r["doc_id"]: decontam.normalised(r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r["item_id"]: decontam.normalised(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in op7_decontamination(spark, small).collect()}
    assert {(d, i) for d, text in docs.items() for i, item in items.items() if item and item in text} <= got
    for d, i in got:
        assert least_distance(items[i], docs[d]) <= int(len(items[i]) * decontam.ERROR_RATE)


def test_awkward_rows(spark):
    benchmark = spark.createDataFrame([(1, prose(1, 120)[:200]), (2, None), (3, ""), (None, "one"), (4, " ONE \n two"), (5, "one two"), (5, "one two")], "item_id long, text string")
    docs = documents(spark, clash=("item_id", "distance"))
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, benchmark).collect())
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (11, 4), (11, 5), (11, 5)])
    kept = decontam.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 6, 7, 8, 9, 10, 12, 13, 14, 15, 16, 17]


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "some passage")], "item_id long, text string")
    assert decontam.find_leaks(nothing(spark), benchmark).collect() == []
    assert decontam.find_leaks(documents(spark), benchmark.limit(0)).collect() == []
    assert decontam.without_leaks(documents(spark), benchmark.limit(0)).count() == documents(spark).count()


def test_benchmark_in_blocks(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontam.find_leaks(docs, items)
    other = decontam.find_leaks(docs, items, block_chars=1000)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
