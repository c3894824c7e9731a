"""Near duplicates against comparing all pairs of whole shingle sets."""

import itertools
import re

import numpy as np
import pytest

from mnemoframe.llm import neardup
from mnemoframe.llm.components import connected_components
from mnemoframe.llm.queries import op2_near_duplicates
from tests.llm.fixtures import BASE, documents, nothing, prose


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent):
    """(n_shingles, component) by id, from all pairs."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            shared = len(x & y)
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                one, other = sorted((root(a), root(b)))
                parent[other] = one
    return {i: (len(sets[i]), root(i)) for i in sets}


def found(frame):
    rows = frame.collect()
    for r in rows:
        assert r["kept"] == (r["doc_id"] == r["component_id"]) or r["doc_id"] is None
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}


def test_query_equals_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert found(op2_near_duplicates(spark, small)) == brute([(r["doc_id"], r["text"]) for r in docs], 3, 85)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_awkward_rows(spark, width, percent):
    docs = documents(spark, clash=("component_id", "id", "kept"))
    rows = neardup.near_duplicates(docs, width, percent)
    assert rows.count() == docs.count()
    assert found(rows) == brute([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None], width, percent)
    assert {(r["component_id"], r["kept"]) for r in rows.where("doc_id IS NULL").collect()} == {(None, True)}


def test_chain_of_versions_is_one_component(spark):
    words = prose(5, 400).split()
    texts = [(10 - k, " ".join(words[k * 12 : k * 12 + 250])) for k in range(10)] + [(100 + k, prose(60 + k, 80)) for k in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert found(neardup.near_duplicates(docs, 3, 85)) == brute(texts, 3, 85)


def test_large_mixed_buckets(spark, monkeypatch):
    """Many near copies of one text: families go through the block comparison and lose no link."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "AGAINST", 16)
    words, texts = prose(9, 160).split(), []
    for k in range(60):
        changed = list(words)
        for j in range(k % 12):
            changed[(k * 31 + j * 17) % len(changed)] = f"other{k}x{j}"
        texts.append((k + 1, " ".join(changed)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert found(neardup.near_duplicates(docs, 3, 85)) == brute(texts, 3, 85)


@pytest.mark.parametrize("block,against,size", [(4, 7, 1 << 20), (2048, 4096, 3000)])
def test_unlinked_members_and_sizes(spark, monkeypatch, block, against, size):
    """Families of copies around the threshold and of several lengths, whatever the blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "AGAINST", against)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", size)
    words, texts = prose(21, 120).split(), []
    for k in range(70):
        changed = list(words[: 120 - 3 * (k % 9)])
        for j in range(2 + k % 7):
            changed[(k * 37 + j * 13) % len(changed)] = f"x{k % 35}y{j}"
        texts.append((1000 - 7 * k, " ".join(changed)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert found(neardup.near_duplicates(docs, 3, 85)) == brute(texts, 3, 85)


def test_intersections_in_pieces(monkeypatch):
    monkeypatch.setattr(neardup, "LOOKUP", 5)
    sets = [np.array(x, dtype=np.uint64) for x in ([1, 2, 3, 9], [2], [4, 5, 6, 7, 8, 9, 10], [1, 9], [100])]
    flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    got = neardup._intersections(sets[0], flat, starts, sizes)
    assert got.tolist() == [len(set(sets[0].tolist()) & set(x.tolist())) for x in sets]
    assert neardup._intersections(sets[0], flat, starts[:0], sizes[:0]).tolist() == []


def test_one_id_with_a_copy_and_a_text_of_its_own(spark):
    docs = spark.createDataFrame([(1, BASE), (2, BASE), (2, prose(77, 90)), (3, BASE + " tail")], "doc_id long, text string")
    kept = neardup.one_per_group(docs, 5, 80).collect()
    assert (2, prose(77, 90)) in {(r["doc_id"], r["text"]) for r in kept} and {r["doc_id"] for r in kept} == {1, 2}


def test_empty_table(spark):
    assert neardup.near_duplicates(nothing(spark)).collect() == []
    assert neardup.one_per_group(nothing(spark)).collect() == []


def test_one_per_group_keeps_columns(spark):
    docs = documents(spark, clash=("kept", "_rank"))
    kept = neardup.one_per_group(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 6, 7, 8, 9, 11, 12, 13, 14, 15, 16, 17]
    assert kept.where("doc_id IS NULL").count() == 2


def test_plan_misses_rarely():
    bands, rows = neardup.band_plan(0.85)
    assert (1 - 0.85**rows) ** bands <= neardup.MISS and bands * rows <= 128
    assert neardup.least_matches(0.85, 16) <= 16 * 0.85


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 20)] + [(200, 200), (None, 3), (201, 202), (202, 201)]
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 120)}, 201: 201, 202: 201}


def test_case_is_folded_for_ascii_only():
    assert shingle_set("É", 3) != shingle_set("é", 3) and shingle_set(BASE.upper(), 3) == shingle_set(BASE, 3)
