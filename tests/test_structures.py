"""Graph, pattern, inference, parsing and assembly operators on small fixtures against plain versions."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import assembly, decompose, envelopes, graph, questions, reasoner, store
from mnemoframe.plans import patterns

KNOWS = [("alice", "knows", "bob"), ("alice", "knows", "carol"), ("bob", "knows", "carol"), ("carol", "knows", "alice"), ("alice", "name", "Alice"), ("bob", "name", "Bob"), ("dave", "name", "Dave"), ("bob", "age", "30"), ("carol", "age", "x7")]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("default", *t) for t in KNOWS], "g string, s string, p string, o string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_patterns(people):
    assert rows(patterns.match(people, ("alice", "knows", "?o"))) == [("bob",), ("carol",)]
    assert rows(patterns.match(people, ("nobody", "?p", "?o"))) == []
    triangle = patterns.solutions(people, ("?a", "knows", "?b"), ("?b", "knows", "?c"), ("?c", "knows", "?a")).select("a", "b", "c")
    assert rows(triangle) == [("alice", "bob", "carol"), ("bob", "carol", "alice"), ("carol", "alice", "bob")]
    assert rows(patterns.match(people, ("?x", "knows", "?x"))) == []
    with pytest.raises(ValueError, match="no variable"):
        patterns.solutions(people, ("?a", "knows", "?b"), ("?c", "name", "?d"))
    ages = patterns.optional(patterns.match(people, ("?s", "knows", "alice")), patterns.match(people, ("?s", "name", "?n")))
    assert rows(ages) == [("carol", None)]
    held = patterns.where_holds(patterns.match(people, ("?s", "name", "?n")), people, "alice", "knows", "bob")
    assert held.count() == 3 and patterns.where_holds(held, people, "bob", "knows", "bob").count() == 0


def test_comparisons_need_like_kinds(people):
    found = patterns.match(people, ("?s", "age", "?v"))
    assert rows(found.where(patterns.compare(F.col("v"), ">", 5)).select("s")) == [("bob",)]
    assert rows(found.where(patterns.compare(F.col("v"), ">", "a")).select("s")) == [("carol",)]


def brute_components(edges):
    label = {}
    for a, b in edges:
        if a is not None and b is not None:
            label.setdefault(a, a)
            label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and b is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.mark.parametrize("few", [0, graph.FEW_LINKS])
def test_components_of_paths_stars_and_loops(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_LINKS", few)
    edges = [(f"p{k:02}", f"p{k + 1:02}") for k in range(40)] + [("hub", f"s{k}") for k in range(30)] + [("solo", "solo"), (None, "x"), ("b", "a"), ("a", "b")]
    frame = spark.createDataFrame([(a, b, "r", 1.0) for a, b in edges], "source_id string, target_id string, relation string, weight double")
    got = {r["node"]: (r["component"], r["size"]) for r in graph.components(frame).collect()}
    wanted = brute_components(edges)
    assert {k: c for k, (c, _) in got.items()} == wanted
    assert all(size == sum(v == c for v in wanted.values()) for c, size in got.values())
    assert graph.components(frame.limit(0)).collect() == []


def test_cycles_of_parents_raise(spark):
    assert rows(graph.ancestors(spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, 8)], "id long, parent_id long"))) == [(2, 1, 1), (3, 1, 2), (3, 2, 1)]
    with pytest.raises(RuntimeError, match="cycle"):
        graph.ancestors(spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, None)], "id long, parent_id long"))


@pytest.mark.parametrize("least", [1, 2, 3])
def test_pairs_of_a_hot_group(spark, least):
    """Group 0 holds all items; pairs are those of comparing all items' groups."""
    rng = np.random.default_rng(4)
    data = {f"i{k}": {0, *rng.choice(np.arange(1, 12), 3).tolist()} for k in range(25)} | {"lone": {77}}
    frame = spark.createDataFrame([(i, int(g)) for i, gs in data.items() for g in gs] + [("i1", 0), (None, 0), ("i1", None)], "item string, grp long")
    wanted = sorted((a, b, len(data[a] & data[b])) for a, b in combinations(sorted(data), 2) if len(data[a] & data[b]) >= least)
    assert rows(graph.pairs_sharing(frame, "item", "grp", least)) == wanted


def test_rounds_are_counted_and_bounded(spark):
    chain = [(f"c{k}", reasoner.SUBCLASS, f"c{k + 1}") for k in range(5)] + [("x", reasoner.TYPE, "c0")]
    frame = spark.createDataFrame(chain, "s string, p string, o string")
    closed, rounds = reasoner.closure(frame)
    types = {r["o"] for r in closed.where("s = 'x'").collect()}
    assert types == {f"c{k}" for k in range(6)} and rounds >= 2
    once, rounds = reasoner.closure(frame, 1)
    assert rounds == 1 and {r["o"] for r in once.where("s = 'x'").collect()} == {"c0", "c1"}
    assert reasoner.closure(frame.limit(0))[1] == 0


def test_decomposed_text(spark):
    docs = spark.createDataFrame([(1, "First paragraph.\n\nSecond paragraph with more words."), (2, ""), (3, None), (4, "é\n# A\ntext\n## B\n\n" + "w" * 5000)], "doc_id long, text string")
    tree = {i: [] for i in range(1, 5)}
    for r in decompose.decompose(docs).orderBy("doc_id", "scale", "idx").collect():
        tree[r["doc_id"]].append((r["scale"], r["idx"], r["parent"], r["offset"], r["length"]))
    kinds = lambda i, scale: [x[1:] for x in tree[i] if x[0] == scale]
    assert kinds(1, "section") == [(0, 0, 0, 51)] and kinds(1, "paragraph") == [(0, 0, 0, 16), (1, 0, 18, 33)] and len(kinds(1, "chunk")) == 2
    assert tree[2] == tree[3] == [("document", 0, None, 0, 0)]
    assert kinds(4, "section") == [(0, 0, 0, 3), (1, 0, 3, 9), (2, 0, 12, 5006)]
    assert kinds(4, "paragraph") == [(0, 0, 0, 2), (1, 1, 7, 4), (2, 2, 18, 5000)]
    assert kinds(4, "chunk")[2:] == [(2, 2, 18, 2048), (3, 2, 18 + 1792, 2048), (4, 2, 18 + 3584, 1416)]


def test_markdown_fences(spark):
    text = "intro\n```py\n# no heading\n\n```\n# Head\n```\nopen"
    found = rows(decompose.markdown(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("kind", "offset", "text", "language"))
    assert found == [("code_block", 6, "# no heading\n", "py"), ("heading", 30, "Head", None), ("paragraph", 0, "intro", None)]


def test_composite_similarity(spark):
    shape = "embedding array<double>, entities array<string>, intent string, node_id string, node_ancestors array<string>"
    base = ([1.0, 0.0], ["a", "b"], "x", "n1", ["r"])
    cases = [(base, base, 1.0), (base, ([1.0, 0.0], None, None, None, None), 1.0), (base, ([-1.0, 0.0], [], None, None, None), 0.0), (base, ([0.0, 1.0], ["b", "c"], "y", "n2", ["r"]), 0.6 * 0.5 + 0.2 / 3 + 0.05 * 0.5), ((None,) * 5, base, 0.0)]
    frame = spark.createDataFrame([(a, b) for a, b, _ in cases], f"a struct<{shape.replace(' ', ':').replace(',:', ',')}>, b struct<{shape.replace(' ', ':').replace(',:', ',')}>")
    got = [r[0] for r in frame.select(assembly.composite_similarity("a", "b")).collect()]
    assert got == pytest.approx([w for _, _, w in cases])


def test_queries_and_uris(spark):
    asked = spark.createDataFrame([('"a*b" (c)^',), (" * ",)], "q string")
    assert [r[0] for r in asked.select(questions.sanitised(F.col("q"))).collect()] == ["a b c", "*"]
    assert assembly.uri_filter("mem://team/signal/x") == ("team", "signal") and assembly.uri_filter("mem://") == (None, None)


def test_budget_stops_at_the_first_text_that_does_not_fit(spark):
    frame = spark.createDataFrame([("a", 3.0, "x" * 40), ("b", 2.0, "x" * 400), ("c", 1.0, "x" * 4)], "id string, score double, text string")
    assert rows(assembly.within(frame, 50).select("id")) == [("a",)]


def test_upsert_and_import(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (None, "m")], "id long, v string")
    assert sorted(map(str, rows(store.upsert(old, new, "id").where("id IS NOT NULL")))) == ["(1, 'a')", "(2, 'B')", "(3, 'c')"]
    assert store.upsert(old, new, "id").where("id IS NULL").count() == 2
    counted = store.import_counts(old, spark.createDataFrame([(1, "x"), (5, "x"), (5, "y"), (6, ""), (None, "z")], "id long, v string"), "id", "v").first()
    assert tuple(counted) == (1, 2, 2)
    assert tuple(store.import_counts(old, old.limit(0), "id", "v").first()) == (0, 0, 0)


def test_categories_in_order(spark):
    cases = [("pricing", "", "recent_actions"), ("rfc-owner", "", "ownership"), (None, "they contradict", "contradictions"), ("x", None, "unassigned")]
    frame = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    assert [r[0] for r in frame.select(envelopes.category(F.col("a"), F.col("b"))).collect()] == [c for _, _, c in cases]


@pytest.mark.parametrize("few, large", [(0, 3), (3, 3), (4, 1_000), (99, 3)])
def test_pairs_taken_along_or_counted(spark, monkeypatch, few, large):
    monkeypatch.setattr(graph, "FEW_GROUPS", few)
    monkeypatch.setattr(graph, "LARGE_GROUP", large)
    rng = np.random.default_rng(5)
    data = {f"i{k}": set(rng.choice(np.arange(9), 1 + k % 6, replace=False).tolist()) for k in range(30)}
    frame = spark.createDataFrame([(i, int(g)) for i, gs in data.items() for g in gs], "item string, grp long")
    wanted = sorted((a, b, len(data[a] & data[b])) for a, b in combinations(sorted(data), 2) if len(data[a] & data[b]) >= 2)
    assert rows(graph.pairs_sharing(frame, "item", "grp")) == wanted


def test_impact_derives_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)
    frame = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "works_on", 1.0) for k in range(9)], "source_id string, target_id string, relation string, weight double")

    def noted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    scores = graph.impact_scores(frame.mapInPandas(noted, frame.schema), spark.createDataFrame([("n0",)], "node string"))
    assert rows(scores) == [("n1", 1, 1.5), ("n2", 2, 0.75), ("n3", 3, 0.375)]
    assert seen.value == 9


def test_components_take_codes_that_differ(spark):
    code = graph._coded(spark.range(1000).selectExpr("concat('n', id) AS node"))
    assert spark.range(1000).selectExpr("concat('n', id) AS node").select(code("node")).distinct().count() == 1000


def test_first_round_infers_once(spark):
    known = spark.createDataFrame([("p", reasoner.INVERSE, "q"), ("a", "p", "b"), ("c", "p", "d")], "s string, p string, o string")
    found = [r for part in reasoner.rules(known, known, {reasoner.INVERSE}) for r in rows(part)]
    assert sorted(found) == [("b", "q", "a"), ("d", "q", "c")]
