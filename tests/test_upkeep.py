"""Architectures, scenarios, wiki rules, journals and routing on small fixtures against plain versions."""

import json
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (fills the catalogue)
from mnemoframe.functions import durable, text
from mnemoframe.functions.text import alternatives, ascii_borders, match_count, matches
from mnemoframe.operators import architecture, governance, memory, pipeline, questions, reports, scenarios, signals, wiki
from mnemoframe.streaming import signals as streams


def rows(frame):
    return Counter(tuple(r) for r in frame.collect())


KINDS = {"text": str, "code": str, "image": (str, dict), "audio": (str, dict), "video": (str, dict), "time_series": list, "table": (list, dict), "structured": dict, "graph": dict, "tensor": (list, str), "geo": dict, "binary": str}


def fits(modality, value):
    if modality not in KINDS or not isinstance(value, KINDS[modality]):
        return False
    if isinstance(value, dict) and modality in ("image", "audio", "video"):
        return "path" in value or "url" in value
    return not isinstance(value, dict) or modality != "graph" or {"nodes", "edges"} <= set(value)


def test_every_modality_against_every_kind_of_value(spark):
    values = ["x", "", 5, 2.5, True, [], [1], {}, {"a": 1}, {"url": "u"}, {"path": None}, {"nodes": [], "edges": []}, {"nodes": []}, None]
    modalities = [*KINDS, "unknown"]
    fields = spark.createDataFrame([("a", m, m, i % 2 == 0) for i, m in enumerate(modalities)], "architecture string, field string, modality string, required boolean")
    points = [(i, "a", json.dumps({m: v for m in modalities})) for i, v in enumerate(values)] + [(90, "a", "[1]"), (91, "a", None), (92, "a", "{bad"), (93, "other", "{}"), (94, None, "{}")]
    expected = Counter()
    for i, _, text in points[: len(values) + 3]:
        data = json.loads(text) if text and not text.startswith(("[", "{bad")) else {}
        for k, m in enumerate(modalities):
            v = data.get(m)
            if v is None:
                if k % 2 == 0:
                    expected[i, m, "missing_required"] += 1
            elif not fits(m, v):
                expected[i, m, "incompatible"] += 1
    assert rows(architecture.violations(spark.createDataFrame(points, "id long, architecture string, data string"), fields)) == expected


def test_processors_run_on_right_points_only(spark):
    fields = spark.createDataFrame([("a", "t", "text", True, "word_count"), ("a", "v", "tensor", False, "passthrough"), ("a", "u", "text", False, "nobody")], "architecture string, field string, modality string, required boolean, processor string")
    points = spark.createDataFrame([(1, "a", '{"t": " two words ", "v": [1, {"x": null}], "u": "x"}'), (2, "a", '{"v": [1]}'), (3, "a", '{"t": "é\\n\\"q\\""}')], "id long, architecture string, data string")
    assert rows(architecture.processed(points, fields)) == Counter([(1, "t", "word_count", "2"), (1, "v", "passthrough", '[1,{"x":null}]'), (3, "t", "word_count", "2")])
    shout = architecture.processed(points, fields, {"nobody": F.upper})
    assert rows(shout) == Counter([(1, "u", "nobody", "X")])


def plain_journal(ids, most):
    held, tenth = [], max(1, most // 10)
    for i in ids:
        if len(held) >= most:
            held = held[tenth:]
        held.append(i)
    return held


@pytest.mark.parametrize("most", [1, 7, 25])
def test_journal_equals_a_plain_loop(spark, most):
    rng, events = random.Random(most), []
    for agent, n in (("a", 3), ("b", 7), ("c", 8), ("d", 61), ("e", 200), (None, 30)):
        events += [(agent, i) for i in range(len(events), len(events) + n)]
    expected = Counter()
    for agent in {a for a, _ in events}:
        expected.update((agent, i) for i in plain_journal([i for a, i in events if a == agent], most))
    rng.shuffle(events)
    frame = spark.createDataFrame([(a, i, i // 3) for a, i in events], "agent string, id long, s long").selectExpr("agent", "id", "timestamp_seconds(s) AS time")
    assert rows(signals.journal_kept(frame, most)) == expected
    assert signals.journal_kept(frame.where("false"), most).collect() == []


def test_journal_stream_equals_the_batch(spark, tmp_path):
    """Over several micro-batches the stream keeps what the plain loop keeps."""
    for part in range(3):
        part_rows = [(f"user/{i % 2}", part * 40 + i) for i in range(40)]
        spark.createDataFrame(part_rows, "agent string, id long").selectExpr("agent", "id", "timestamp_seconds(id) AS time").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{part}")
    arriving = spark.readStream.schema("agent string, id long, time timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        query = streams.bounded_journals(arriving, 15).writeStream.format("memory").queryName("journals").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    held = defaultdict(Counter)
    for r in spark.table("journals").collect():
        held[r["journal"]][r["id"]] += 1 if r["recorded"] else -1
    for k in range(2):
        assert sorted(i for i, n in held[f"user/{k}"].items() if n) == plain_journal(range(k, 120, 2), 15)


EDGES = [("c1", "alice", "mentioned_in"), ("c2", "alice", "mentioned_in"), ("c2", "bob", "mentioned_in"), ("c3", "bob", "works_on"), ("c4", "carol", "mentioned_in"), ("c1", "c4", "cross_ref")]
HOMES = [("c1", "north"), ("c2", "north"), ("c3", "south"), ("c4", "south"), ("c5", None)]


def plain_what_if(change, entity, node, depth):
    weights, falls = {"works_on": 1.5, "cross_ref": 1.2, "mentioned_in": 1.0}, {1: 1.0, 2: 0.5, 3: 0.25}
    own = {i for i, n in HOMES if n == node} | {node}
    lost = [e for e in EDGES if (change == "entity_removal" and entity in e[:2]) or (change == "node_cancellation" and own & set(e[:2])) or (change == "dependency_break" and entity in e[:2] and own & set(e[:2]))]
    seen = dict.fromkeys({x for e in lost for x in e[:2]}, 0)
    for d in range(1, depth + 1):
        for a, b, _ in EDGES:
            for x, y in ((a, b), (b, a)):
                if seen.get(x) == d - 1 and y not in seen:
                    seen[y] = d
    scores = defaultdict(float)
    for a, b, relation in EDGES:
        for x, y in ((a, b), (b, a)):
            if seen.get(y, 0) > 0 and seen.get(x) == seen[y] - 1:
                scores[y] += weights[relation] * falls[seen[y]]
    home, out = {i: n for i, n in HOMES if n}, {}
    touch = lambda edges, n: sum(any(home.get(x) == n for x in e[:2]) for e in edges)
    for n in {"north", "south"}:
        score = round(sum(s for i, s in scores.items() if home.get(i) == n), 3)
        if any(home.get(i) == n for i in scores) or touch(lost, n):
            out[n] = (score, touch(EDGES, n), touch(EDGES, n) - touch(lost, n))
    return out


@pytest.mark.parametrize("change,entity,node", [("entity_removal", "alice", None), ("entity_removal", "nobody", None), ("node_cancellation", None, "north"), ("dependency_break", "bob", "south"), ("dependency_break", None, "south"), ("general", "bob", "south"), ("revenue_change", None, "north")])
def test_what_if(spark, change, entity, node):
    edges = spark.createDataFrame(EDGES, "source_id string, target_id string, relation string")
    homes = spark.createDataFrame(HOMES, "id string, node string")
    found = {r["node"]: (r["score"], r["edges_before"], r["edges_after"]) for r in scenarios.what_if(edges, homes, change, entity, node).collect()}
    assert found == (plain_what_if(change, entity, node, 3) if entity or change == "node_cancellation" else {})


def test_what_if_query(spark, small):
    """Removing an entity takes one edge from each context that mentions it, and none besides."""
    from mnemoframe.plans.catalog import QUERIES
    from mnemoframe.sources.views import view

    found = {r["node"]: r["edges_before"] - r["edges_after"] for r in QUERIES["GR13_what_if"](spark, small).collect()}
    homes = {r["id"]: r["node"] for r in view(spark, small, "contexts").select("id", "node").collect()}
    expected = Counter(homes[r["context_id"]] for r in view(spark, small, "mentions").where("name = 'part/7'").collect())
    assert {n: k for n, k in found.items() if k} == dict(expected)


def test_scenarios_of_any_kind(spark):
    texts = ["What if Ed leaves?", "WITHOUT alice", "shut down red", "Drop it", "lose money on Red", "Bob no longer helps x north side", "Tell Carol-Ann", "", None, "A", "What If We Cancel The Agency"]
    aliases = spark.createDataFrame([("north side", "north"), ("red", "red-hub"), ("re", "first")], "alias string, node string")
    found = {r["id"]: (r["change"], r["entity"], r["node"]) for r in scenarios.parse(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), aliases, "treasury").collect()}
    assert found == {
        0: ("entity_removal", "Ed", None), 1: ("entity_removal", "WITHOUT", None), 2: ("node_cancellation", None, "first"), 3: ("node_cancellation", None, None), 4: ("revenue_change", None, "treasury"),
        5: ("dependency_break", "Bob", "north"), 6: ("general", "Tell CarolAnn", None), 7: ("general", None, None), 8: ("general", None, None), 9: ("general", None, None), 10: ("node_cancellation", None, None),
    }
    none = scenarios.parse(spark.createDataFrame([(1, "cancel red")], "id long, text string"), aliases.where("false"), "t").collect()
    assert [(r["change"], r["node"]) for r in none] == [("node_cancellation", None)]


def test_recommendations_without_scores(spark):
    parsed = spark.createDataFrame([(1, "node_cancellation", None, "north"), (2, "entity_removal", None, None), (3, "dependency_break", None, None)], "id long, change string, entity string, node string")
    scores = spark.createDataFrame([(1, "north", 9.0), (1, "b", 1.0), (1, "a", 1.0), (1, "c", 0.5), (1, "d", 0.1)], "id long, node string, score double")
    found = defaultdict(list)
    for r in sorted(scenarios.recommendations(parsed, scores).collect()):
        found[r["id"]].append(r["text"])
    assert [t.split()[1] for t in found[1]] == ["all", "all", "cross-referenced", "a", "b"]
    assert found[2] == ["Audit all affected contexts for dependencies on this change", "Update signal files in affected nodes to reflect new state"]
    assert found[3] == ["Map all contexts that will break and prioritize remediation"]


def test_page_rules(spark):
    pages = spark.createDataFrame([("p", "x\n## summary \n### Related", {"title": "t", "owner": ""}), ("q", None, None), ("r", "## Summary\r\n##No\n##  Related  pages", {"title": "a", "owner": "b"})], "slug string, body string, frontmatter map<string,string>")
    rules = spark.createDataFrame([("required_section", "Summary"), ("required_section", "Related"), ("required_frontmatter", "title"), ("required_frontmatter", "owner"), ("max_bytes", "20"), ("other", "x")], "kind string, value string")
    assert rows(wiki.schema_issues(pages, rules)) == Counter([
        ("p", "missing_section", "Related"), ("p", "empty_frontmatter", "owner"), ("p", "schema_size_exceeded", "25"), ("q", "missing_section", "Summary"), ("q", "missing_section", "Related"), ("q", "missing_frontmatter", "title"),
        ("q", "missing_frontmatter", "owner"), ("r", "missing_section", "Related"), ("r", "schema_size_exceeded", "35"),
    ])
    assert wiki.schema_issues(pages, rules.where("false")).collect() == []


def test_curation_keeps_all_citations(spark):
    pages = spark.createDataFrame([("p", "team", 3, "Text {{cite: a}}\n\n## NEW signals \n- old\n## More\n"), ("q", None, 1, None), ("r", "x", 1, "no citations")], "slug string, audience string, version long, body string")
    cites = spark.createDataFrame([("p", "u/2", "  two\n\nlines " + "x" * 300), ("p", "u/1", None), ("p", "u/1", None), ("q", "u", "w"), ("z", "u", "w"), ("p", None, "lost")], "slug string, uri string, text string")
    found = {r["slug"]: r for r in wiki.curated(pages, cites).collect()}
    assert set(found) == {"p", "q"}
    preview = re.sub(r"\s+", " ", ("two\n\nlines " + "x" * 300)[:240])
    assert found["p"]["body"] == f"Text {{{{cite: a}}}}\n\n## New signals\n\n-  {{{{cite: u/1}}}}\n- {preview} {{{{cite: u/2}}}}\n"
    assert (found["p"]["version"], found["p"]["curated_by"], found["q"]["curated_by"]) == (4, "deterministic:team", None)
    again = wiki.curated(spark.createDataFrame([("p", "team", 4, found["p"]["body"])], "slug string, audience string, version long, body string"), cites).collect()
    assert again[0]["body"] == found["p"]["body"]


def test_routes(spark):
    seen = spark.createDataFrame([(1, "The INVOICE is due", "x", "decide", "invoice"), (2, None, "n1", "inform", "note"), (3, "plain", None, None, None), (4, "Bob Ray called", "n2", "inform", "standup")], "doc_id long, text string, node string, signal_type string, genre string")
    rules = spark.createDataFrame([("content", "Invoice", "a"), ("signal_type", "decide", "a"), ("source_node", "n1", "b"), ("entity_mention", "bob ray", "c"), ("genre", "note", "d"), ("odd", "x", "e")], "field string, pattern string, destination string")
    assert rows(pipeline.route(seen, rules)) == Counter([(1, "a"), (2, "b"), (2, "d"), (3, "inbox"), (4, "c")])
    assert rows(pipeline.route(seen, rules, "money", "people")) == Counter([(1, "a"), (1, "money"), (2, "b"), (2, "d"), (3, "inbox"), (4, "c"), (4, "people")])
    assert rows(pipeline.route(seen.drop("node"), rules.where("false"))) == Counter([(k, "inbox") for k in range(1, 5)])


def test_names_of_several_words(spark):
    docs = spark.createDataFrame([(1, "Anna Bell met Émile; anna-bell left. ED too"), (2, None), (3, ""), (4, "bell anna")], "doc_id long, text string")
    names = spark.createDataFrame([("Anna Bell",), ("anna bell",), ("Emile",), ("Ed",), ("Bell Anna Bell",), ("anna",), (None,), ("!!!",), ("met Émile anna bell left",), ("one two three four five six",)], "name string")
    assert rows(pipeline.mentioned(docs, names)) == Counter([(1, "Anna Bell"), (1, "anna bell"), (1, "Emile"), (1, "anna"), (1, "met Émile anna bell left"), (4, "anna")])
    assert pipeline.mentioned(docs, names.where("false")).collect() == []


def test_sanitised_and_recalled(spark):
    frame = spark.createDataFrame([(' "a*\t(b)^ ',), ("",), (None,), ("plain",)], "q string")
    assert [r[0] for r in frame.select(questions.sanitised(F.col("q"))).collect()] == ["a b", "*", "*", "plain"]
    asked = spark.createDataFrame([("actions", None, "x", "May"), ("who", None, "x", None), ("odd", None, None, None)], "k string, s string, t string, d string")
    assert [r[0] for r in asked.select(questions.recall_question(*map(F.col, "kstd"))).collect()] == ["what actions, decisions, or commitments about x since May", "who is the owner of x, and how do I reach them", None]


def test_export_of_nobody(spark):
    empty = spark.createDataFrame([], "id string, kind string, display_name string")
    contexts = spark.createDataFrame([("c", "u", "text of Ann"), ("d", None, None)], "id string, created_by string, content string")
    owned = {"roles": (spark.createDataFrame([("u", "r"), ("u", "r"), ("v", "s")], "principal_id string, role string"), "role")}
    assert rows(governance.subject_export("u", "Ann", empty, contexts, owned)) == Counter([("contexts", "c"), ("mentions", "c"), ("roles", "r")])
    assert rows(governance.subject_export("w", None, empty, contexts, owned)) == Counter()


def test_sample_is_the_same_for_a_seed(spark):
    from mnemoframe.operators import store

    frame = spark.range(500).selectExpr("id", "id % 7 AS k")
    one = rows(store.sampled(frame, 50, seed=1))
    assert one == rows(store.sampled(frame.repartition(9), 50, seed=1)) and sum(one.values()) == 50
    assert one != rows(store.sampled(frame, 50, seed=2)) and rows(store.sampled(frame, 600)) == rows(frame)
    seen = Counter(r["k"] for r in store.sampled(frame, 350, seed=5).collect())
    assert all(25 < n < 75 for n in seen.values())


def test_collections_survive_json(spark):
    from mnemoframe.operators import store

    frame = spark.createDataFrame([("c", "k1", 'a "quoted"\nline', 5, [1, 2]), ("c", "k2", None, None, None)], "collection string, key string, value string, n long, list array<int>")
    lines = store.collection_to_json(frame)
    broken = lines.select("json").unionByName(spark.createDataFrame([("{bad",), (None,), ('{"n": "x"}',)], "json string"))
    good, bad = store.collection_from_json(broken, "collection string, key string, list array<int>, n long, value string")
    assert {(r["key"], r["value"], r["n"], tuple(r["list"] or ())) for r in good.collect()} == {("k1", 'a "quoted"\nline', 5, (1, 2)), ("k2", None, None, ())}
    assert {r["json"] for r in bad.collect()} == {"{bad", None, '{"n": "x"}'}


def test_events_with_errors(spark):
    from mnemoframe.operators import envelopes

    frame = spark.createDataFrame([('{"id": "1", "source": "s", "type": "t", "sig_mode": "smell", "time": "2024-05-01T10:00:00Z"}',), ("[1]",), ('{"id": "", "source": "s"}',), (None,)], "event string")
    found = [(r["id"], r["mode"], r["specversion"], r["datacontenttype"], r["error"]) for r in envelopes.from_events(frame).collect()]
    assert found[0] == ("1", None, "1.0.2", "application/json", None)
    assert [f[4] for f in found[1:]] == ["not an object", "id is required", "not an object"]


def test_page_files_round_trip(spark):
    pages = spark.createDataFrame([("p", "team", 3, {"owner": "a: b"}, "Body\n---\n"), ("q", "default", 1, None, "")], "slug string, audience string, version int, frontmatter map<string,string>, body string")
    again = wiki.page_fields(pages.select(wiki.page_file().alias("text")))
    assert {(r["slug"], r["audience"], r["version"], r["frontmatter"].get("owner"), r["body"]) for r in again.collect()} == {("p", "team", 3, "a: b", "Body\n---\n"), ("q", "default", 1, None, "")}
    plain = wiki.page_fields(spark.createDataFrame([("no matter",), (None,)], "text string")).collect()
    assert [(r["slug"], r["version"], r["body"], r["frontmatter"]) for r in plain] == [(None, 1, "no matter", {}), (None, 1, "", {})]


def test_skeletons_of_no_genre(spark):
    docs = spark.createDataFrame([(1, "x", " t "), (2, None, None)], "doc_id long, genre string, text string")
    none = spark.createDataFrame([], "genre string, place int, name string, hint string")
    assert [r["structured"] for r in pipeline.with_skeleton(docs, none).orderBy("doc_id").collect()] == ["t", ""]


def test_silences_split_a_hot_key(spark):
    """One key with silences between its bursts: pieces give what one pass gives."""
    rng, at, events = random.Random(2), 0, []
    for i in range(600):
        at += rng.choice([5, 30, 400, 3600, 3601, 9000])
        events.append((i, "hot", at))
    frame = spark.createDataFrame(events, "id long, agent string, s long").selectExpr("id", "agent", "timestamp_seconds(s) AS time")
    last, wanted = None, set()
    for i, _, s in events:
        if last is None or s - last >= 3600:
            wanted.add(i)
            last = s
    assert {r["id"] for r in signals.cooled_down(frame, ["agent"]).collect()} == wanted
    tokens, last, allowed = 2.0, events[0][2], {}
    for i, _, s in events:
        tokens, last = min(2.0, tokens + (s - last) * 0.001), s
        allowed[i] = tokens >= 1
        tokens -= tokens >= 1
    assert {r["id"]: r["allowed"] for r in signals.rate_limited(frame, "agent", 2.0, 0.001).collect()} == allowed


def test_files_of_any_kind(spark):
    from mnemoframe.operators import files

    tree = spark.createDataFrame([("a.md", 5, "x"), (".hidden.md", 5, "x"), ("_skills/b.txt", 5, "x"), ("_x/b.txt", 5, "x"), ("engine/c.py", 5, "x"), ("d.MD", 5, "x"), ("e.pdf", files.MOST_BYTES, None), ("f.pdf", files.MOST_BYTES + 1, None), ("g", 5, "x"), (None, 5, "x"), ("h.md", 0, ""), ("i.overview.md", 3, "x"), ("j.txt", None, "x"), ("k.txt", 3, None)], "path string, size long, content string")
    kept = files.indexable(tree)
    assert {(r["path"], r["kind"]) for r in kept.collect()} == {("a.md", "text"), ("_skills/b.txt", "text"), ("e.pdf", "binary"), ("k.txt", "text")}
    folders = spark.createDataFrame([("a.md", "odd")], "folder string, node string")
    found = {r["path"]: (r["type"], r["node"], r["title"], r["content"]) for r in files.file_contexts(kept, folders).collect()}
    assert found == {"a.md": ("resource", "odd", "a.md", "x"), "_skills/b.txt": ("skill", "inbox", "b.txt", "x"), "e.pdf": ("resource", "inbox", "e.pdf", "")}
    empty = spark.createDataFrame([], "path string")
    assert tuple(files.coverage(empty, spark.createDataFrame([], "spec string, path string")).first()) == (0, 0, 0.0)
    assert tuple(files.coverage(tree.select("path").where("path IS NOT NULL"), spark.createDataFrame([("s", "a.md"), ("t", "a.md"), ("t", "zz")], "spec string, path string")).first()) == (13, 1, 7.7)


def test_mentioned_splits_long_texts_once(spark):
    words = [f"w{i}" for i in range(40_000)]
    docs = spark.createDataFrame([(k, " ".join(words[k:])) for k in range(24)], "doc_id long, text string")
    names = spark.createDataFrame([("w39998 W39999",), ("w5 w6",), ("w0",), ("w10",)], "name string")
    began = time.monotonic()
    found = Counter(tuple(r) for r in pipeline.mentioned(docs, names).collect())
    assert time.monotonic() - began < 60
    assert found == Counter([(k, "w39998 W39999") for k in range(24)] + [(k, "w5 w6") for k in range(6)] + [(k, "w10") for k in range(11)])


def test_window_means_add_up_by_order(spark):
    values = [29.51, 56.91, 11.91, 140.38, 6.29], [66.5, 77.01, 5.28, 22.23, 8.98], [100.91, 121.23, 72.28, 99.24, 16.34], [189.39, 26.57, 72.84, 39.02, 52.18], [None, 3.0, None], [None]
    rows = [(f"a{k}-{n}", at, v) for k in range(6) for n in range(40) for at, v in enumerate(values[k])]
    events = spark.createDataFrame(rows, "agent string, id int, latency double")
    key = "spark.sql.TungstenAggregate.testFallbackStartsAt"
    spark.conf.set(key, "2, 3")  # partial sums meet as they do when memory is short
    try:
        found = reports.window_stats(events, "agent", "id", 5, "latency", F.lit(True)).collect()
    finally:
        spark.conf.unset(key)
    whole = [48, 35, 81, 75, 3, None]
    assert sorted(map(tuple, found)) == sorted((f"a{k}-{n}", 0, len(values[k]), whole[k], 1.0) for k in range(6) for n in range(40))


def test_alternatives_match_as_whole_patterns_do(spark):
    rng = random.Random(14)
    rules = [p for rules in (pipeline.INTENTS, pipeline.GENRES, pipeline.MODES, pipeline.TYPES, memory.ERRORS) for _, p in rules] + [r"\b[A-Z]\w*(?:a|b)+|x{2,}(?:y|z)|(?:no|on)+\s", r"(?:a|ab)(?:c|bcd)|(?:)q"]
    pieces = sorted({w for p in rules for words, _ in alternatives(p)[1] for w in words}) + "ed s y ing . , : ; \n é K İ ß _ 12 3.5 2024-01-02 % € send share this that we friday week day the spec doc error fail go with XX y z no A ba ab bcd [ { ``` ![ ]( ) ? ( # please".split(" ")
    texts = ["".join(rng.choice(["", "", " ", "  "]) + (w.upper() if rng.random() < 0.2 else w.title() if rng.random() < 0.2 else w) for w in rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(1500)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("lower", F.lower("text"))
    text, lower = F.col("text"), F.col("lower")
    wrong, found = [], []
    for pattern in rules:
        whole, plain = text.rlike(ascii_borders(pattern)), F.regexp_count(text, F.lit(ascii_borders(pattern)))
        wrong.append(F.count_if(~matches(text, pattern, lower).eqNullSafe(whole) | ~F.coalesce(match_count(text, pattern, lower), F.lit(0)).eqNullSafe(F.coalesce(plain, F.lit(0)))))
        found.append(F.count_if(whole))
    counts = docs.agg(F.array(*wrong).alias("wrong"), F.array(*found).alias("found")).first()
    assert [p for p, n in zip(rules, counts["wrong"]) if n] == [] and sum(map(bool, counts["found"])) > 0.9 * len(rules)


def test_intents_look_for_words_before_patterns(spark):
    rng = random.Random(16)
    words = ["".join(rng.choices("abdeilmnorstuvé", k=rng.randint(3, 9))) for _ in range(2000)]
    docs = spark.createDataFrame([(" ".join(rng.choices(words, k=20_000)),) for _ in range(64)], "text string").withColumn("lower", F.lower("text")).localCheckpoint()
    whole = F.lit(None)
    for name, pattern in reversed(pipeline.INTENTS):
        whole = F.when(F.col("text").rlike(ascii_borders(pattern)), name).otherwise(whole)

    def seconds(column):
        docs.agg(F.max(column)).collect()
        began = time.monotonic()
        docs.agg(F.max(column)).collect()
        return time.monotonic() - began

    plain = seconds(whole)
    assert seconds(pipeline.intent(F.col("text"), F.col("lower"))) < plain / 2
    assert seconds(pipeline.intent_confidence(F.col("text"), F.col("lower"))) < plain / 2


def test_mentioned_moves_no_runs_that_are_no_names(spark, monkeypatch):
    draw = random.Random(4)
    words = [f"word{i}" for i in range(3000)]
    texts = {k: [draw.choice(words) for _ in range(600)] for k in range(200)}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    wanted = [texts[k][5] for k in range(0, 60, 3)] + [" ".join(texts[k][7:9]).upper() for k in range(40)] + ["Word1 absent word2"]
    names = spark.createDataFrame([(n,) for n in wanted], "name string").distinct()
    expected = Counter((k, n) for k, t in texts.items() for n in set(wanted) if f" {n.lower()} " in f" {' '.join(t)} ")
    tables = Path(durable.shared_folder(spark).removeprefix("file:")) / "tables"
    size = lambda: sum(f.stat().st_size for f in tables.rglob("*.parquet"))
    before = size()
    found = pipeline.mentioned(docs, names)
    assert rows(found) == expected
    assert size() - before < sum(len(" ".join(t)) for t in texts.values()) / 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    monkeypatch.setattr(pipeline, "WHOLE_BYTES", 0)
    found = pipeline.mentioned(docs, names)
    assert rows(found) == expected
    assert "ShuffledHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    runs = docs.select("doc_id", F.explode(pipeline._runs(text.terms(F.col("text")), [1, 2])).alias("phrase"))
    hits = sum(expected.values())
    assert hits <= pipeline._sifted(runs, names.select(F.lower("name").alias("phrase"))).count() < hits + 200 < runs.count() / 10


def test_first_terms(spark):
    texts = [None, "", "One", "  one, Two;three four", "é-e ß 3 x", "a" * 30 + " b c d", "....." * 9 + "a b", "a b c" + "d" * 40 + " e", "a b c", "a b", "x y." + " " * 40 + "z w"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for n, head in [(3, 400), (3, 8), (1, 1), (2, 3)]:
        assert all(r.own == r.whole for r in docs.select(text.first_terms(F.col("text"), n, head).alias("own"), F.slice(text.terms(F.col("text")), 1, n).alias("whole")).collect())
