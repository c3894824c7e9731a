"""No rule loses a match where lines are wrapped."""

import re

import pytest

from mnemoframe.llm import license_rules, license_scan


def example(pattern):
    """A text that a name, wording or link of the rules matches, with its optional parts left out."""
    pattern = re.sub(r"\(\?![^()]*(?:\([^()]*\)[^()]*)*\)", "", pattern)
    while re.search(r"\(\?:[^()]*\)", pattern):
        pattern = re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] else m[1].split("|")[0], pattern)
    pattern = re.sub(r"\[([^\]])[^\]]*\](\??)", lambda m: "" if m[2] else " " if m[1] == "-" and " " in m[0] else m[1], pattern)
    pattern = re.sub(r"\.\{1[^}]*\}", "foo bar", pattern)
    pattern = re.sub(r"\.\{0[^}]*\}", "", pattern)
    return re.sub(r"(\\.|.)\?", "", pattern).replace("\\", "")


ALL = [(label, kind, x) for label, (_, *kinds) in license_rules.LICENSES.items() for kind, found in zip(("name", "wording", "link"), kinds, strict=True) for x in found]


@pytest.mark.parametrize("space", [" ", "\n", "  ", "\r\n"])
def test_wrapped_notices_pass_the_gate(spark, space):
    docs = spark.createDataFrame([(k, f"x {example(x)} y".replace(" ", space)) for k, (_, _, x) in enumerate(ALL)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (label, kind, x) in enumerate(ALL):
        assert license_scan.detections(texts[k]), (label, kind, x)
        assert rows[k]["spans"], (label, kind, x)


def test_examples_match_their_own_rules():
    for label, kind, x in ALL:
        assert any(r.label == label and r.pattern.search(example(x).replace(" ", "\n")) for r in license_scan.rules()), (label, kind, x)


@pytest.mark.parametrize("text,label", [("given to the public\ndomain dedication", "cc0-1.0"), ("all\nrights reserved", "proprietary"), ("creative\ncommons attribution", "cc-by"), ("the software shall be used for\ngood, not evil", "json")])
def test_wrapped_phrases(spark, text, label):
    if not license_scan.detections(text):
        pytest.skip("no rule has this phrase")
    row = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["spans"] and row["score"] > 0


def test_gate_is_a_superset():
    assert not any(re.search(r"\s", word) for word in license_scan.GATE)
    assert all(any(word in r.keyword for word in license_scan.GATE) for r in license_scan.rules())


@pytest.mark.parametrize(
    "kinds,kept",
    [
        ([("long", 50, "aa bb cc"), ("short", 60, "bb")], ["short"]),  # a contained match of higher priority
        ([("long", 60, "aa bb cc"), ("short", 50, "bb")], ["long"]),
        ([("left", 50, "aa bb"), ("right", 50, "bb cc")], ["left"]),  # equal priority, a part in common
        ([("left", 50, "aa bb"), ("right", 60, "bb cc")], ["right"]),
        ([("one", 50, "aa"), ("two", 50, "aa bb")], ["two"]),  # equal priority and start: the longer
        ([("left", 50, "aa"), ("right", 60, "bb cc")], ["left", "right"]),
    ],
)
def test_what_overlaps_leave(monkeypatch, kinds, kept):
    made = sorted((license_scan.Rule(label, priority, 1.0, text.split()[0], re.compile(text)) for label, priority, text in kinds), key=lambda r: -r.priority)
    words = license_scan.ahocorasick.Automaton()
    for i, rule in enumerate(made):
        words.add_word(rule.keyword, (*words.get(rule.keyword, ()), i))
    words.make_automaton()
    monkeypatch.setattr(license_scan, "_compiled", lambda: (words, made))
    assert [rule.label for _, _, rule in license_scan.detections("xx aa bb cc yy")] == kept
