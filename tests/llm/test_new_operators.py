"""Alignment, filter audit and vector duplicates against plain loops."""

import hashlib
import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemoframe.llm import alignment, filter_audit, queries, vecdup
from tests.llm.fixtures import documents, nothing, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_tokens():
    """Whole-text encoding on both sides, by the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    names = {i: w for w, i in a.get_vocab().items()}

    def encode(text):
        one = [(i, bytes(letters[c] for c in names[i])) for i in a.encode(f" {text}", add_special_tokens=False).ids] if text else []
        other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)] if text else []
        same = text and all(b"".join(x for _, x in side) == f" {text}".encode() for side in (one, other))
        return (one, other) if same else ([], [])

    return encode


def spans(side):
    end, out = 0, []
    for i, x in side:
        out.append((i, end, end + len(x)))
        end += len(x)
    return out


def plain_alignment(texts, encode):
    """Figures of each text, from all pairs of tokens whose bytes overlap."""
    every, counts = [], Counter()
    for text in texts:
        a, b = map(spans, encode(text))
        links = [(i, j) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f)]
        counts.update(links)
        shared = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [([i for i, _, e in a if low < e <= high], [j for j, _, e in b if low < e <= high]) for low, high in zip([0, *shared], shared, strict=False)]
        every.append((len(a), len(b), groups, links))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for n_a, n_b, groups, links in every:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return out, counts


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["<|endoftext|> and <s> plain", "a  b   c\n\n d\t e ", " lead", "tail ", "▁ odd sign", "é́ ü ñ 中文 字   nbsp", "x" * 3000, "don't it's WE'LL 12345 67", "\x00\x1c \x85", "‐‧ ٣٤ अ"]


def test_alignment_equals_all_pairs(spark, plain_tokens, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_UNITS", 60)
    docs = documents(spark, clash=("block", "units", "n_a")).unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    rows = docs.select("doc_id", "text").collect()
    figures, pairs = alignment.align_documents(docs.repartition(3), A, B)
    expected, counts = plain_alignment([r["text"] for r in rows if len(r["text"] or "") < 10_000], plain_tokens)
    if len(expected) < len(rows):
        figures, pairs = alignment.align_documents(docs.where("text IS NULL OR length(text) < 10000"), A, B)
    got = Counter((r["doc_id"], *(r[c] for c in FIGURES)) for r in figures.collect())
    assert got == Counter((r["doc_id"], *e) for r, e in zip([r for r in rows if len(r["text"] or "") < 10_000], expected, strict=True))
    assert {(r["a_id"], r["b_id"]): r["count"] for r in pairs.collect()} == dict(counts)


def test_alignment_of_a_very_long_text(spark, plain_tokens):
    text = " ".join(prose(k, 400) for k in range(60))
    row = alignment.align_documents(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), A, B)[0].collect()
    a, b = map(spans, plain_tokens(text))
    ends_a, ends_b = {e for _, _, e in a}, {e for _, _, e in b}
    for r in row:
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (len(a), len(b), len(ends_a & ends_b), len(ends_a | ends_b))
    assert len({tuple(r[c] for c in FIGURES) for r in row}) == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aé12▁. ​<|>s"), st.characters(codec="utf-8")), max_size=40))
def test_units_are_encoded_as_whole_texts(plain_tokens, text):
    tokens = alignment.loaded(A, B)
    assert tokens.cut
    encoded = tokens.encode(tokens.units(text)) if text else []
    one, other = plain_tokens(text)
    if None in encoded:
        assert not one
    else:
        assert [i for a, _ in encoded for i in a] == [i for i, _ in one]
        assert [i for _, b in encoded for i in b] == [i for i, _ in other]


def test_groups_and_their_products(spark, plain_tokens):
    docs = documents(spark)
    groups = alignment.token_groups(docs, A, B)
    by_doc = {}
    for r in groups.where("doc_id IS NOT NULL").distinct().orderBy("doc_id", "group").collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    for r in docs.where("doc_id IS NOT NULL").select("doc_id", "text").distinct().collect():
        a, b = plain_tokens(r["text"])
        own = by_doc.get(r["doc_id"], [])
        assert [i for g in own for i in g["a_ids"]] == [i for i, _ in a]
        assert [i for g in own for i in g["b_ids"]] == [i for i, _ in b]
        assert [g["end"] for g in own[:-1]] == [g["start"] for g in own[1:]]
    products = alignment.group_products(groups)
    assert products.count() == sum(len(r["a_ids"]) * len(r["b_ids"]) for r in groups.collect())


def test_alignment_of_nothing(spark):
    figures, pairs = alignment.align_documents(nothing(spark), A, B)
    assert figures.collect() == [] and pairs.collect() == []
    figures, _ = alignment.align_documents(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B)
    assert {tuple(r) for r in figures.collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")}


def plain_masks(rows):
    """Masks of ``(id, text)`` rows."""
    least, out = {}, []
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bits = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t])
        out.append(sum(b << k for k, b in enumerate(bits)))
    return out


def plain_audit(rows, labels):
    """``rows``: (id, text, part)."""
    out = {}
    marked = [(part or "", m, i) for (i, _, part), m in zip(rows, plain_masks([r[:2] for r in rows]), strict=True)]
    for part in {m[0] for m in marked}:
        removed_by = Counter()
        for order in itertools.permutations("ABCDE"):
            left = [(m, i) for p, m, i in marked if p == part]
            gone = []
            for step, x in enumerate(order, 1):
                bit = 1 << "ABCDE".index(x)
                here = [(m, i) for m, i in left if m & bit]
                left = [(m, i) for m, i in left if not m & bit]
                labelled = lambda k: sum(labels.get(i, (0, 0))[k] == 1 for _, i in here)  # noqa: B023, E731
                out[part, "".join(order), step] = [len(left), len(here), sum(m & bit > 0 for m, _ in gone), sum(m == bit for p, m, _ in marked if p == part), labelled(0), labelled(1)]
                gone += here
                removed_by[x] += len(here)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def as_table(frame):
    rows = frame.collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("held", [1, filter_audit.HELD_BYTES])
def test_audit_equals_a_plain_loop(spark, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", held)
    extra = [(50 - k, "copied # TEXT", None, f"s{k % 3}", None) for k in range(40)] + [(30, "copied # TEXT", None, "s1", None)] * 3 + [(60, prose(1, 300), None, None, None), (61, "", None, "", None)]
    docs = documents(spark, clash=("mask", "part")).unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True).repartition(5)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (30, 1, 1), (None, 1, 1), (60, 1, 0), (13, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    marks = {1: (1, 1), 30: (1, 1), 60: (1, 0), 13: (0, 1)}
    from pyspark.sql import functions as F

    assert as_table(filter_audit.audit(docs, labels, F.col("source"))) == plain_audit(rows, marks)


def test_masks_with_a_forced_collision(spark, monkeypatch):
    """Different texts with one hash stay apart in their chain."""
    rows = iter([(7, (1, 9, Counter(["x"]), b"one")), (7, (2, 3, Counter(["x"]), b"two")), (7, (1, 4, Counter(["y", "y"]), b"one")), (7, (1, 4, Counter(["x"]), b"one")), (8, (2, 5, "x", None))])
    assert Counter(filter_audit._chained(rows)) == Counter([(9, "x", 1 | 16), (4, "y", 1), (4, "y", 1), (4, "x", 1), (3, "x", 2), (5, "x", 2)])


def test_audit_of_nothing_and_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(nothing(spark), labels).collect() == []
    rows = as_table(filter_audit.audit(documents(spark), labels))
    assert len(rows) == 600 and not any(r[4] or r[5] for r in rows.values())


def test_audit_of_a_very_long_text(spark):
    text = " ".join(f"w{k}" for k in range(400_000))
    assert [r["mask"] for r in filter_audit.masks(spark.createDataFrame([(1, text), (2, text), (3, text + "#")], "doc_id long, text string")).orderBy("doc_id").collect()] == [0, 16, 8]


def plain_links(rows, threshold=0.93):
    """``rows``: (id, vector, label), ids distinct."""
    good = [(i, np.array(v, dtype=float), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = Counter(), {i: i for i, _, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = set()
    for (i, x, k), (j, y, m) in itertools.combinations(good, 2):
        if k == m and len(x) == len(y):
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                pairs.add((i, j))
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (links[i], root(i)) for i, _, _ in rows}, pairs


def near_vectors(seed, n, width=32, labels=3):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base, label = rng.normal(size=width), int(rng.integers(labels))
        for _ in range(int(rng.choice([1, 1, 1, 2, 5, 40]))):
            rows.append((base + rng.normal(size=width) * rng.choice([0, 0.1, 0.25, 0.33])).astype(np.float32).tolist())
            rows[-1] = (rows[-1], label)
    return [(i, v, k) for i, (v, k) in enumerate(rows[:n])]


def found_vectors(frame):
    rows = frame.collect()
    for r in rows:
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}


VECTORS = "vec_id long, embedding array<float>, label int"


def test_one_cell_is_exact(spark):
    rows = near_vectors(1, 500)
    assert found_vectors(vecdup.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS))) == plain_links(rows)[0]


def test_many_cells_and_blocks_find_the_links(spark, monkeypatch):
    monkeypatch.setattr(vecdup, "BLOCK", 16)
    rows = near_vectors(2, 900, width=48)
    expected, pairs = plain_links(rows)
    found = found_vectors(vecdup.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS).repartition(4), cell_rows=20))
    assert len(pairs) > 1000
    assert all(found[i][0] <= expected[i][0] for i in expected)
    assert sum(n for n, _ in found.values()) >= 0.99 * 2 * len(pairs)
    whole = found_vectors(vecdup.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS).repartition(4), cell_rows=20, reach=100.0))
    assert whole == expected


def test_awkward_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0], 1), (9, [1.0, None], 1),
        (10, [float("nan"), 1.0], 1), (11, [float("inf"), 1.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1e30, 1e29], 1), (14, [1e-30, 0.0], 1), (15, [-1.0, 0.0], 1), (16, [-0.0, -2.0], 1), (17, [0.0, -2.0], 1),
    ]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS cid", "1 AS cell", "2 AS copies")
    assert found_vectors(vecdup.near_duplicate_vectors(frame)) == plain_links(rows)[0]
    again = vecdup.near_duplicate_vectors(spark.createDataFrame([*rows[:3], rows[0], (None, [1.0, 0.0], 1), (None, None, None)], VECTORS)).collect()
    assert Counter(tuple(r) for r in again) == Counter([(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (None, 4, None, True), (None, 0, None, True)])
    assert vecdup.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).collect() == []


def test_large_doubles(spark):
    rows = [(1, [1e300, 1e299], 1), (2, [1e-300, 1e-301], 1), (3, [3.0, 0.3], 1), (4, [0.3, 3.0], 1)]
    assert found_vectors(vecdup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))) == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_embedding_duplicates"])
def test_queries_equal_their_sql(spark, small, name):
    duck = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    answer = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    frame = queries.queries()[name](spark, small)
    assert sorted(frame.columns) == sorted(names)
    assert Counter(map(tuple, frame.select(*names).collect())) == Counter(answer.fetchall())


def test_alignment_query_equals_all_pairs(spark, small, plain_tokens):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    every, counts = [], Counter()
    for r in docs:
        a, b = map(spans, plain_tokens(r["text"]))
        ends_a, ends_b = np.array([e for _, _, e in a], dtype=int), np.array([e for _, _, e in b], dtype=int)
        edges = sorted({*ends_a.tolist(), *ends_b.tolist()})
        links = [(a[np.searchsorted(ends_a, e)][0], b[np.searchsorted(ends_b, e)][0]) for e in edges]
        counts.update(links)
        every.append((r["doc_id"], len(a), len(b), len({*ends_a} & {*ends_b}), links))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    expected = {(i, n_a, n_b, g, len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links)) for i, n_a, n_b, g, links in every}
    assert {tuple(r[c] for c in ("doc_id", *FIGURES[:-1])) for r in queries.op11_alignment(spark, small).collect()} == expected
