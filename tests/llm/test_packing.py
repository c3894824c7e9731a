"""Packing against tokenizers itself, exact round trips and optimal packings of small instances."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemoframe.llm import packing
from mnemoframe.llm.queries import TOKENIZER, op6_packing
from tests.llm.fixtures import documents, nothing

PATH = public_tokenizers.path(TOKENIZER)


def optimum(lengths, capacity):
    """Fewest sequences, by trying all places for each piece, longest first."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(lengths):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[at]:
                k = rooms.index(room)
                place(at + 1, [*rooms[:k], room - lengths[at], *rooms[k + 1 :]])
        place(at + 1, [*rooms, capacity - lengths[at]])

    place(0, [])
    return best[0]


def sequences(fillings):
    return sum(times for _, times in fillings)


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
    fixed, rest = packing.reduce_by_dominance(Counter(lengths), 20)
    left = [n for n, c in rest.items() for _ in range(c)]
    assert sequences(fixed) + (optimum(left, 20) if left else 0) == optimum(lengths, 20)
    taken = Counter(n for filling, times in fixed for n in filling * times)
    assert taken + Counter(rest) == Counter(lengths)


@pytest.mark.parametrize("seed", range(10))
def test_fillings_hold_all_pieces(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 1024), 1024, 300]) for _ in range(500))
    fillings = packing.plan(counts)
    assert all(sum(filling) <= 1024 for filling, _ in fillings)
    assert Counter(n for filling, times in fillings for n in filling * times) == counts
    lower = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert lower <= sequences(fillings) <= 1.2 * max(lower, sum(c for n, c in counts.items() if n > 512)) + 1


def held(rows, texts, repeats):
    """Check every promise of the contract over collected rows."""
    exact = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert len({r["piece"] for r in pieces}) * repeats.get(doc_id, 1) == len(pieces)
        at = 0
        for r in pieces[:: repeats.get(doc_id, 1)]:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == 1024 or r["piece"] == 0
            at += r["length"]
        assert at == len(ids)


def test_query_round_trip(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held(op6_packing(spark, small).collect(), texts, {})


def test_awkward_rows(spark):
    docs = documents(spark, clash=("piece", "sequence_id")).where("doc_id IS NOT NULL")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    held(packing.pack(docs, PATH).collect(), texts, {1: 2})
    assert packing.pack(documents(spark).where("doc_id IS NULL"), PATH).count() == 2
    assert packing.pack(nothing(spark), PATH).collect() == []


def test_a_hot_length_is_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    docs = spark.createDataFrame([(k, "amber birch") for k in range(100)], "doc_id long, text string")
    held(packing.pack(docs, PATH).collect(), {k: "amber birch" for k in range(100)}, {})


@pytest.mark.parametrize("text", ["it's  THE\n\n\tend ", "naïve café – “quoted”", "中文 和 English", "\U0001f600‍", "12345 6.7e8", "a" * 5000, "\r\n  x", "ſtraße ǅ"])
def test_ids_are_those_of_tokenizers(text):
    assert packing.encoder(PATH)(text) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
