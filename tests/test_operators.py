"""Operators without SQL against plain Python over the same rows."""

import re
from collections import defaultdict

import numpy as np

import __spark_entry__  # noqa: F401  (fills the catalogue)
from mnemoframe.operators import governance, pipeline, signals
from mnemoframe.plans.catalog import QUERIES
from mnemoframe.sources.views import view


def by_key(rows, *key):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["time"], r["id"])):
        groups[tuple(r[k] for k in key)].append(r)
    return groups


def test_cooldown(spark, small):
    wanted = set()
    for group in by_key(view(spark, small, "signals").collect(), "agent", "type").values():
        last = None
        for r in group:
            if last is None or (r["time"] - last).total_seconds() >= 3600:
                wanted.add(r["id"])
                last = r["time"]
    assert {r["id"] for r in QUERIES["SX08_cooldown"](spark, small).collect()} == wanted


def test_token_bucket(spark, small):
    wanted = {}
    for group in by_key(view(spark, small, "signals").collect(), "agent").values():
        tokens, last = 3.0, group[0]["time"]
        for r in group:
            tokens, last = min(3.0, tokens + (r["time"] - last).total_seconds() * 0.0001), r["time"]
            wanted[r["id"]] = tokens >= 1
            tokens -= tokens >= 1
    got = {r["id"]: r["allowed"] for r in QUERIES["SX10_token_bucket"](spark, small).collect()}
    assert got == wanted and not all(got.values())


def test_budget_skips_what_does_not_fit(spark, small):
    used = 0
    rows = QUERIES["RT10_budget"](spark, small).collect()
    for r in rows:
        used += r["cost"] if r["kept"] else 0
    assert 0 < used <= 3000 and all(r["kept"] or used + r["cost"] > 3000 or r["cost"] > 0 for r in rows)


def test_greedy_clusters(spark, small):
    vectors = sorted(spark.read.parquet(f"{small}/embeddings.parquet").collect(), key=lambda r: (r["label"], r["vec_id"]))
    wanted, label = {}, None
    for r in vectors:
        v = np.array(r["embedding"], dtype=float)
        if r["label"] != label:
            label, centroids, counts = r["label"], [], []
        sims = [(c @ v / (np.linalg.norm(c) * np.linalg.norm(v)) + 1) / 2 for c in centroids]
        if sims and max(sims) >= 0.65:
            best = int(np.argmax(sims))
            counts[best] += 1
            centroids[best] = centroids[best] + (v - centroids[best]) / counts[best]
        else:
            best = len(centroids)
            centroids.append(v.copy())
            counts.append(1)
        wanted[r["vec_id"]] = best
    assert {r["vec_id"]: r["cluster"] for r in pipeline.greedy_clusters(spark.read.parquet(f"{small}/embeddings.parquet")).collect()} == wanted


def test_personal_data():
    text = "Write to ann.lee@example.org or 10.0.0.1; card 4111 1111 1111 1111, not 4111 1111 1111 1112, see https://a.example/x"
    kinds = [kind for kind, _, _ in governance.find_pii(text)]
    assert {"email", "ipv4", "url", "credit_card"} <= set(kinds)
    for kind, offset, length in governance.find_pii(text):
        assert text.encode()[offset : offset + length].strip()
    hidden = governance.redact_text(text)
    assert "example.org" not in hidden and "<REDACTED:email>" in hidden and governance.redact_text(None) is None
    assert len(governance.redact_text(text, "mask").encode()) == len(text.encode())


def test_patterns():
    match = lambda pattern, topic: bool(re.match(signals.pattern_regex(pattern), topic))
    assert match("a.**", "a") and match("a.**", "a.b.c") and match("a.*.c", "a.b.c") and not match("a.*", "a.b.c") and match("**", "x.y")
    topic = lambda pattern, name: bool(re.match(signals.topic_regex(pattern), name))
    assert topic("a.**", "a.b") and not topic("a.**", "a") and topic("*.b", "a.b") and not topic("a.b", "axb")


def test_intent_confidence(spark):
    texts = ["", "Plain words only.", "We are worried about the risk and the blocker."]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in frame.select(pipeline.intent_confidence(frame["text"])).collect()]
    assert got[:2] == [0.3, 0.5] and got[2] == 0.75
