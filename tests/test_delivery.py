"""Text index, parsers, sessions, clusters and delivery on small fixtures against plain versions."""

import json
import random
import re
import time
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (fills the catalogue)
from mnemoframe.functions import durable
from mnemoframe.functions.stemming import stemmed
from mnemoframe.functions.text import terms
from mnemoframe.operators import clusters, delivery, parsers, sessions, textindex
from mnemoframe.plans.catalog import QUERIES

#: Pairs of the algorithm's published description.
STEMS = """caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop, tanned tan,
falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, rational ration, valenci valenc, hesitanci hesit, digitizer digit, conformabli conform, radicalli radic,
differentli differ, vileli vile, analogousli analog, vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, formaliti formal, sensitiviti sensit,
sensibiliti sensibl, triplicate triplic, formative form, formalize formal, electriciti electr, electrical electr, hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop,
adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend, adoption adopt, homologou homolog, communism commun, activate activ, angulariti angular, homologous homolog, effective effect,
bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll, yes ye, ying ying, toys toi, by by, is is, trees tree, universities univers, y y, saying sai"""


def test_stems(spark):
    pairs = [tuple(p.split()) for p in STEMS.replace("\n", " ").split(",")]
    rows = stemmed(spark.createDataFrame([(a,) for a, _ in pairs] + [(None,), ("",), ("s" * 65,)], "term string")).collect()
    found = {r["term"]: r["stem"] for r in rows}
    assert {a: found[a] for a, _ in pairs} == dict(pairs)
    assert (found[None], found[""], found["s" * 65]) == (None, "", "s" * 65)
    with pytest.raises(ValueError, match="stem"):
        stemmed(spark.createDataFrame([("a", "b")], "term string, Stem string"))


@pytest.fixture(scope="module")
def memories(spark):
    rows = [("a", "Running the ponies home", "user", True, False), ("b", "A pony runs and runs", "user", True, False), ("c", "run PONY run", "agent", True, False), ("d", "run pony", "user", False, False), ("e", "pony running", "user", True, True), ("f", None, "user", True, False), ("g", "", "user", True, False), ("h", "nothing of it", "user", True, False)]
    return spark.createDataFrame(rows, "id string, content string, audience string, is_latest boolean, is_forgotten boolean")


def test_search_by_stems(memories):
    index = textindex.build_index(memories, stems=True)
    found = lambda *a, **k: [r["id"] for r in textindex.search_memories(memories, index, *a, **k).collect()]
    assert set(found("ponies (run)*")) == {"a", "b", "c"}
    assert set(found("ponies run", audience="user", include_old=True, include_forgotten=True)) == {"a", "b", "d", "e"}
    assert found("unknown pony") == []
    assert set(found(" ^* ")) == set(found(None)) == {"a", "b", "c", "f", "g", "h"}
    every = found("pony")
    assert found("pony", limit=1, offset=1) == every[1:2]
    assert index.facts.first()["n"] == 8
    whole = textindex.build_index(memories)
    assert {r["id"] for r in textindex.matches(whole, "pony").collect()} == {"b", "c", "d", "e"}
    empty = textindex.build_index(memories.where("false"))
    assert textindex.matches(empty, "pony").collect() == []


def test_index_reads_the_buckets_of_its_terms(memories):
    index = textindex.build_index(memories)
    plan = textindex.matches(index, "pony")._jdf.queryExecution().explainString(memories.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "PushedFilters" in plan


def test_definitions(spark):
    code = "def  one(x)\n\n  public   class Two {\nclassless\n\tfn a::b é\nprivate def c\ndefault\npublic static Main\nmodule\nX"
    files = spark.createDataFrame([(1, "a/b.PY", code), (2, "noext", code), (3, "x.rs", None), (4, ".hidden", ""), (5, None, "impl y")], "doc_id long, path string, text string")
    rows = parsers.definitions(files).collect()
    wanted, offset = [], 0
    for line in code.split("\n"):
        m = re.match(r"^\s*(public\s+(?:class|interface|static)|private\s+def|defp?|function|func|fn|class|module|struct|interface|impl)\s+([\w.:]+)", line, re.ASCII)
        if m:
            wanted.append((re.sub(r"\s+", " ", m[1]), m[2], line.strip(), offset, len(line.encode())))
        offset += len(line.encode()) + 1
    assert len(wanted) == 5
    for doc_id, language in ((1, "python"), (2, "text")):
        assert sorted((r["keyword"], r["name"], r["text"], r["offset"], r["length"]) for r in rows if r["doc_id"] == doc_id and r["language"] == language) == sorted(wanted)
    assert {(r["doc_id"], r["language"]) for r in rows} == {(1, "python"), (2, "text"), (5, "text")}


def dumped(value, indent=0):
    """YAML of nested dicts and lists by a writer of its own."""
    pad = "  " * indent
    if isinstance(value, dict):
        return "".join(f"{pad}{k}:{' ' + scalar(v) if not isinstance(v, (dict, list)) or not v else chr(10) + dumped(v, indent + 1).rstrip(chr(10))}\n" for k, v in value.items())
    return "".join(f"{pad}-{' ' + scalar(v) if not isinstance(v, (dict, list)) or not v else chr(10) + dumped(v, indent + 1).rstrip(chr(10))}\n" for v in value)


def scalar(v):
    return json.dumps(v) if isinstance(v, (str, dict, list)) else "~" if v is None else json.dumps(v)


def leaves(value, path=""):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in leaves(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in leaves(v, f"{path}[{i}]")]
    kind = {dict: "map", list: "list", str: "string", bool: "boolean", int: "integer", float: "float", type(None): "null"}[type(value)]
    return [(path, kind, "" if kind in ("map", "list", "null") else value if kind == "string" else json.dumps(value))]


def nested(rng, depth):
    kind = rng.choice("dl" if depth == 3 else "dlssss" if depth else "ssss")
    if kind == "d":
        return {f"k{rng.randrange(99)}": nested(rng, depth - 1) for _ in range(rng.randrange(1 if depth == 3 else 0, 4))}
    if kind == "l":
        return [nested(rng, depth - 1) for _ in range(rng.randrange(1 if depth == 3 else 0, 4))]
    return rng.choice([None, True, False, 7, -3, 2.5, "a # b", "x: y", "- z", "é \"q\"", "[1", "~", "12", ""])


def test_yaml_round_trip(spark):
    rng, made = random.Random(3), []
    while len(made) < 120:
        made.append(nested(rng, 3))
    docs = spark.createDataFrame([(i, dumped(v)) for i, v in enumerate(made)], "doc_id long, text string")
    found = {}
    for r in parsers.yaml_leaves(docs).collect():
        assert r["warning"] is None, (r, dumped(made[r["doc_id"]]))
        found.setdefault(r["doc_id"], []).append((r["path"], r["kind"], r["value"]))
    for i, v in enumerate(made):
        assert sorted(found.get(i, [])) == sorted(leaves(v)), dumped(v)


def test_yaml_forms(spark):
    text = "# head\n---\na: 1 # one\n'b c': \"x\\ny # no\"\nd:\n- p: 1\n  q: [1, {r: s, t: 'u, v'}, []]\n- - deep\n  - 2\ne: >-\n  folded\n  text\n\n  more\nf: |\n  kept\n    in\ng: {}\nurl: http://x.y/z#w\n"
    bad = ["a: &x 1", "a: [1", "a:\n\tb: 1", "a: 1\n  b: 2", "a: 1\n- b", "a: 'x", "a: 1\na: 2", "plain words\nmore"]
    docs = spark.createDataFrame([(0, text), *((i, b) for i, b in enumerate(bad, 1)), (50, ""), (51, None), (52, "# only"), (53, "just: one")], "doc_id long, text string")
    rows = parsers.yaml_leaves(docs).collect()
    got = {r["path"]: (r["kind"], r["value"]) for r in rows if r["doc_id"] == 0}
    assert got == {
        "a": ("integer", "1"), "b c": ("string", "x\ny # no"), "d[0].p": ("integer", "1"), "d[0].q[0]": ("integer", "1"), "d[0].q[1].r": ("string", "s"), "d[0].q[1].t": ("string", "u, v"), "d[0].q[2]": ("list", ""),
        "d[1][0]": ("string", "deep"), "d[1][1]": ("integer", "2"), "e": ("string", "folded text\nmore"), "f": ("string", "kept\n  in\n"), "g": ("map", ""), "url": ("string", "http://x.y/z#w"),
    }
    raw = {r["doc_id"]: r for r in rows if r["kind"] == "raw"}
    assert set(raw) == set(range(1, len(bad) + 1)) and all(r["warning"] and r["value"] == bad[i - 1] for i, r in raw.items())
    assert not [r for r in rows if r["doc_id"] in (50, 51, 52)]
    assert {(r["path"], r["offset"]) for r in rows if r["doc_id"] == 53} == {("just", 0)}
    assert [(r["kind"], r["warning"]) for r in parsers.yaml_leaves(docs.where("doc_id = 53"), toml=True).collect()] == [("raw", "TOML is kept as raw text")]


def plain_page(page):
    """Title, text and headings by patterns alone, for pages whose tags are closed."""
    page = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|noscript)\b.*?</\1\s*>", lambda m: "\x00" if m[0][1] != "!" else "\x01", page)
    parts = [unescape(p) for p in re.split(r"(?s)<[^>]*>|\x00|\x01", page)]
    normal = lambda t: re.sub(r"\n{3,}", "\n\n", re.sub(r"[\t ]+", " ", t.replace("\r\n", "\n").replace("\r", "\n"))).strip()
    text = normal("\n".join(p for p in parts if p.strip()))
    inner = lambda html: normal(unescape(re.sub(r"(?s)<[^>]*>|\x00|\x01", "", html)))
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
    heads = [(int(level), inner(body)) for level, body in re.findall(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>", page)]
    return inner(title[1]) or None if title else None, text, sorted((max(text.encode().find(h.encode()), 0), k, h) for k, h in heads)


def test_html_equals_patterns(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = QUERIES["SC25_html"](spark, small).collect()
    assert len(rows) == len(pages)
    same = 0
    for r in rows:
        title, text, heads = plain_page(pages[r["page_id"]])
        own = (r["title"], r["text"], sorted((h["offset"], h["level"], h["text"]) for h in r["headings"]))
        same += own == (title, text, heads)
        for h in r["headings"]:
            assert h["offset"] == 0 or r["text"].encode()[h["offset"] : h["offset"] + h["length"]].decode() == h["text"]
    assert same >= 0.95 * len(rows), same


def test_html_forms(spark):
    page = "<TITLE> A &amp; B </TITLE><script>var x = '<h1>no</h1>';</script><h2 class=x>Two</h2>\r\n<p>t \t x</p><h1>Öne <b>bold</b></h1><noscript><p>hid</p></noscript><h3></h3>end <style>p{}"
    rows = parsers.html_pages(spark.createDataFrame([(1, page), (2, ""), (3, None), (4, "no tags < at all")], "page_id long, html string")).collect()
    by_id = {r["page_id"]: r for r in rows}
    assert set(by_id) == {1, 2, 4}
    assert by_id[1]["title"] == "A & B" and "var" not in by_id[1]["text"] and "hid" not in by_id[1]["text"]
    assert [(h["level"], h["text"]) for h in by_id[1]["headings"]] == [(1, "Öne bold"), (3, ""), (2, "Two")]
    assert (by_id[2]["title"], by_id[2]["text"], by_id[2]["headings"]) == (None, "", [])
    assert by_id[4]["text"] == "no tags < at all"


def plain_compress(messages):
    """Sessions as whole transcripts."""
    out = {}
    for session in {m[0] for m in messages if m[0] is not None}:
        own = sorted(((t, r, x or "") for s, t, r, x in messages if s == session), key=lambda m: (m[0], m[1], m[2]))
        lines = "\n".join(f"**{r.upper()}:** {x}" for _, r, x in own).split("\n")
        squeezed = len(own) > 20 or sum(len(x) for _, _, x in own) > 10_000
        if squeezed:
            says = lambda who, x: re.match(rf"(?i)\*\*{who}:\*\*|{who}:|\[{who}\]", x)
            signal = lambda x: any(w in x.lower() for w in sessions.SIGNALS) or re.search(r"[0-9]", x) or re.search(r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b", x, re.ASCII) or re.search(r"\b[A-Z][a-z]+\b", x, re.ASCII)
            lines = [x for x in lines if says("user", x) or not says("assistant", x) or signal(x)]
        text = "\n".join(lines)
        out[session] = squeezed, text[:2000] + sessions.CUT + text[-2000:] if squeezed and len(text) > 5000 else text
    return out


def test_compression(spark):
    rng, rows = random.Random(5), []
    lines = ["ok then", "we agreed on it", "nothing here", "see You", "at 5", "", "user: hi", "[assistant] mhm", "in may", "x" * 300]
    for session, n in ((1, 3), (2, 25), (3, 40), (4, 2), (5, 1), (6, 21)):
        for turn in range(n):
            k = {3: 12, 4: 60, 5: 4000}.get(session, 2)
            rows.append((session, turn, rng.choice(["user", "assistant", "system"]), "\n".join(rng.choice(lines) for _ in range(k)) if turn % 7 else None))
    rows += [(5, 9, "user", "\n" * 12_000), (7, 0, "assistant", "a"), (7, 0, "assistant", "a"), (None, 1, "user", "lost")]
    got = {r["conv_id"]: (r["compressed"], r["transcript"]) for r in sessions.compress(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == plain_compress(rows)
    forced = sessions.compress(spark.createDataFrame(rows[:3], "conv_id long, turn int, role string, text string"), force=True).collect()
    assert [r["compressed"] for r in forced] == [True]


def test_extraction_keeps_twenty_and_the_first_of_repeats(spark):
    rows = [(1, t, f"We decided on number {t % 25}. Acme is large and we prefer it. WE DECIDED ON NUMBER {t % 25}!") for t in range(60)] + [(2, 0, None), (2, 1, "Bob met Alice today. The plan is: wait."), (2, 2, "bob met alice today."), (3, 0, "short. ok!")]
    got = sessions.extracted_memories(spark.createDataFrame(rows, "conv_id long, turn int, text string"), ["Alice", "Bob"]).collect()
    one = sorted((r["place"], r["content"]) for r in got if r["conv_id"] == 1)
    assert one[:2] == [(1, "We decided on number 0."), (2, "WE DECIDED ON NUMBER 0!")] and [p for p, _ in one] == list(range(1, 21))
    # A sentence that is a fact first is dropped with it, though it would be a preference too.
    assert not any("prefer" in r["content"] for r in got)
    assert [(r["category"], r["content"], r["entities"]) for r in sorted((r for r in got if r["conv_id"] == 2), key=lambda r: r["place"])] == [("decision", "The plan is: wait.", []), ("relationship", "Bob met Alice today.", ["Alice", "Bob"])]
    assert sessions.extracted_memories(spark.createDataFrame([], "conv_id long, turn int, text string"), []).collect() == []


def plain_rebuild(rows, threshold, rounds=10, seeds=clusters.SEEDS):
    """Rounds over one dictionary of centroids a label."""
    out = {}
    for label in {r[2] for r in rows}:
        own = {i: np.array(v, dtype=float) for i, v, k in rows if k == label}
        lead = lambda ids: {ids[k]: own[ids[k]] for k in clusters.leaders(np.array([own[i] for i in ids]), threshold)}  # noqa: B023, E731
        unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
        centroids, before = lead(sorted(own)[:seeds]), None
        for _ in range(rounds):
            tried = seeds
            while True:
                home = {}
                for i, v in own.items():
                    close = {c: (unit(v) @ unit(m) + 1) / 2 for c, m in sorted(centroids.items())}
                    best = max(close, key=close.get)
                    home[i] = best if close[best] >= threshold else None
                left = sorted(i for i, h in home.items() if h is None)
                if not left:
                    break
                tried *= 2
                centroids |= lead(left[:tried])
            if home == before:
                break
            before = home
            centroids = {c: np.mean([own[i] for i, h in home.items() if h == c], axis=0) for c in set(home.values())}
        for i, h in home.items():
            out[i] = label, min(j for j, g in home.items() if g == h)
    return out


@pytest.mark.parametrize("seeds", [2, clusters.SEEDS])
def test_rebuild_equals_a_plain_loop(spark, seeds):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[rng.integers(6)] + rng.normal(size=8) * 0.4).tolist(), [None, 1, 2][min(int(rng.integers(6)), 2)]) for i in range(150)]
    got = {r["vec_id"]: (r["label"], r["cluster"]) for r in clusters.rebuild(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.8, seeds=seeds).collect()}
    assert got == plain_rebuild(rows, 0.8, seeds=seeds)
    assert len({c for _, c in got.values()}) > 6


def test_rebuild_of_little(spark):
    shape = "vec_id long, embedding array<float>, label int"
    assert clusters.rebuild(spark.createDataFrame([], shape)).collect() == []
    rows = clusters.rebuild(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [-1.0, 0.0], 1), (4, None, 1), (5, [0.0, 0.0], 2)], shape))
    assert {tuple(r) for r in rows.collect()} == {(1, 1, 1), (2, 1, 1), (3, 1, 3), (5, 2, 5)}
    table = clusters.cluster_table(rows, spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.5], 1), (3, [-1.0, 0.0], 1), (5, [0.0, 0.0], 2)], shape)).collect()
    assert {(r["cluster"], r["members"], tuple(r["centroid"])) for r in table} == {(1, 2, (1.0, 0.25)), (3, 1, (-1.0, 0.0)), (5, 1, (0.0, 0.0))}


def test_openai_envelope_is_json(spark):
    rows = [(1, "openai", 2, None, 'say "hi"\n\\ é', "u/1"), (1, "openai", 1, "First", None, None), (1, "openai", 3, "T", "x", "u/1"), (2, "claude", 1, "T", " x ", ""), (3, "plain", 1, "T", "x", "u")]
    got = {r["answer_id"]: r for r in delivery.envelopes(spark.createDataFrame(rows, "answer_id long, format string, place int, title string, content string, uri string")).collect()}
    messages = json.loads(got[1]["body"])
    assert [m["content"] for m in messages] == ['### First\n\n\n\n### Chunk 2 \n\nsay "hi"\n\\ é\n\n### T \n\nx', "Source 1: u/1", "Source 2: u/1"] and got[1]["sources"] == ["u/1"]
    assert got[2]["body"] == "<context>\n### T\n\nx\n</context>" and got[2]["sources"] == []
    assert got[3]["body"] == "### T  [1]\n\nx\n\nSources:\n[1] u"


def test_stated_profiles_win(spark):
    rows = spark.createDataFrame([("a", "agent", {"bandwidth": "small"}), ("b", None, None), ("c", "user", {"bandwidth": "vast"})], "id string, kind string, metadata map<string,string>")
    got = {r["id"]: (r["bandwidth"], r["token_budget"], r["format"], r["genre"]) for r in delivery.receivers(rows, genre="pitch").collect()}
    assert got == {"a": ("small", 1500, "claude", "pitch"), "b": ("medium", 6000, "markdown", "pitch"), "c": ("vast", None, "markdown", "pitch")}
    assert {r["token_budget"] for r in delivery.receivers(rows, token_budget=7).collect()} == {7}


def test_intermediate_tables_can_be_cleared(spark):
    table = durable.checkpointed(spark.range(5))
    assert table.count() == 5
    durable.clear_tables(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{durable.shared_folder(spark)}/tables")
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    assert Counter(r[0] for r in durable.checkpointed(spark.range(2)).collect()) == Counter([0, 1])


def test_settings_replace_lists_and_scalars(spark):
    defaults = spark.createDataFrame([("a.b", "integer", "1"), ("a.c", "integer", "2"), ("l[0]", "string", "x"), ("l[1]", "string", "y"), ("s", "string", "old"), ("ab", "string", "z")], "path string, kind string, value string")
    configs = spark.createDataFrame([("w", "a:\n  b: 5\nl: [q]\ns: {t: 1}"), ("n", None), ("e", ""), ("bad", "a: [1"), ("z", "a: 7")], "workspace string, text string")
    found = {}
    for r in parsers.merged_settings(configs, defaults).collect():
        found.setdefault(r["workspace"], {})[r["path"]] = r["value"]
    whole = {"a.b": "1", "a.c": "2", "l[0]": "x", "l[1]": "y", "s": "old", "ab": "z"}
    assert found == {"w": {"a.b": "5", "a.c": "2", "l[0]": "q", "s.t": "1", "ab": "z"}, "n": whole, "e": whole, "bad": whole, "z": {"a": "7", "l[0]": "x", "l[1]": "y", "s": "old", "ab": "z"}}


def test_long_envelopes_take_linear_time(spark):
    n = 60_000
    chunks = spark.range(n).selectExpr("1 AS answer_id", "'plain' AS format", "id AS place", "concat('T', id) AS title", "'c' AS content", "IF(id % 2 = 0, concat('u', id % 3), NULL) AS uri")
    began = time.monotonic()
    row = delivery.envelopes(chunks).first()
    assert time.monotonic() - began < 30
    lines = row["body"].split("\n")
    assert lines[:5] == ["### T0  [1]", "", "c", "", "### T1"] and lines[-1] == f"[{n // 2}] u1" and row["sources"] == ["u0", "u2", "u1"]


def test_yaml_texts_are_dealt_to_tasks(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('a: ', id) AS text").coalesce(1)
    leaves = parsers.yaml_leaves(docs)
    assert leaves.count() == 400 and leaves.rdd.getNumPartitions() > 1


def test_index_counts_terms_where_texts_are_read(spark, monkeypatch):
    texts = ["Straße É é, ÀB ab\nab_x İi Σας K1 1", "", None, "  ..", "x" * 5000 + " y y", "a b c d e f g a"]
    docs = spark.createDataFrame([(k % 5, t) for k, t in enumerate([*texts, "y x y", "a b c d e f g a"])], "id long, content string")
    split = docs.select("id", F.size(terms(F.col("content"))).alias("size"), F.explode(terms(F.col("content"))).alias("term"))
    wanted = sorted(map(tuple, split.groupBy("id", "size", "term").count().collect()))
    index = textindex.build_index(docs)
    assert sorted((r["id"], r["size"], r["term"], r["tf"]) for r in index.postings.collect()) == wanted
    assert index.facts.first()["n"] == len(texts) + 2
    monkeypatch.setattr(textindex, "POSTINGS", 3)
    batches = list(textindex._postings(iter([pa.RecordBatch.from_pydict({"id": [5, 6, 7], "text": ["a b a", "c c d", None]}), pa.RecordBatch.from_pydict({"id": [8], "text": ["e"]})])))
    assert [b.num_rows for b in batches if b.num_rows] == [4, 1]
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == [(5, 3, "a", 2), (5, 3, "b", 1), (6, 3, "c", 2), (6, 3, "d", 1), (8, 1, "e", 1)]
