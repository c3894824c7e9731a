"""Licence scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment."""

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesvec
from .columns import bounded_batches
from .license_rules import GATE, Rule, rules

#: Phrases whose places are counted, and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


@cache
def _compiled() -> tuple[ahocorasick.Automaton, list[Rule]]:
    ordered = rules()
    words = ahocorasick.Automaton()
    for i, rule in enumerate(ordered):
        words.add_word(rule.keyword, (*words.get(rule.keyword, ()), i))
    words.make_automaton()
    return words, ordered


def detections(text: str) -> list[tuple[int, int, Rule]]:
    """Detections ``(start, end, rule)`` in a lower-cased text, in order of their places.

    Matches are taken in order of priority, then of their start, then of their
    length.  One that shares a character with a match taken before it is
    suppressed: whether it lies within that one, overlaps a part of it, or, of
    lower priority, contains it.  So a long match gives way as a whole to a
    short one of higher priority inside it.
    """
    words, ordered = _compiled()
    due = sorted({i for _, found in words.iter(text) for i in found})
    kept: list[tuple[int, int, Rule]] = []
    matches = sorted((-rule.priority, m.start(), -m.end(), i) for i in due for rule in (ordered[i],) for m in rule.pattern.finditer(text))
    starts: list[tuple[int, int]] = []
    for _, start, negative_end, i in matches:
        if not _overlaps(starts, start, -negative_end):
            kept.append((start, -negative_end, ordered[i]))
    return sorted(kept, key=lambda d: d[:2])


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span meets one of the disjoint, ordered spans; if not, it is added to them."""
    at = bisect_left(taken, (start, end))
    if (at < len(taken) and taken[at][0] < end) or (at and taken[at - 1][1] > start):
        return True
    insort(taken, (start, end))
    return False


def _phrase_places(hashes: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Indices of the words at which each phrase starts within one text."""
    owner_end = np.repeat(bounds[1:], np.diff(bounds))
    places = {}
    for phrase, label in PHRASES.items():
        at = np.flatnonzero(hashes == bytesvec.hash_bytes(phrase[0].encode()))
        at = at[at + len(phrase) <= owner_end[at]]
        for k, word in enumerate(phrase[1:], 1):
            at = at[hashes[at + k] == bytesvec.hash_bytes(word.encode())]
        places[label] = at
    return places


def _gated(lower: bytes, offsets: np.ndarray) -> np.ndarray:
    """Indices of the texts that hold a word of GATE."""
    found = set()
    for word in GATE:
        word, at = word.encode(), -1
        while (at := lower.find(word, at + 1)) >= 0:
            i = int(np.searchsorted(offsets, at, side="right")) - 1
            if at + len(word) <= offsets[i + 1]:
                found.add(i)
            at = int(offsets[i + 1]) - len(word) if at + len(word) <= offsets[i + 1] else at
    return np.array(sorted(found), dtype=np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in bytesvec.blocks(batch.column(1)):
            n, lower = len(block), bytesvec.LOWER_ASCII[block.data]
            words = bytesvec.runs(bytesvec.ALNUM[lower], block.offsets)
            places = _phrase_places(bytesvec.span_hashes(lower, words.starts, words.ends), words.bounds)
            counts = np.zeros(n, dtype=np.int64)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[set[str]] = [set() for _ in range(n)]
            for label, at in places.items():
                of = np.searchsorted(words.bounds, at, side="right") - 1
                np.add.at(counts, of, 1)
                np.minimum.at(first, of, at - words.bounds[of])
                np.maximum.at(last, of, at - words.bounds[of])
                for i in np.unique(of):
                    labels[i].add(label)
            base = [",".join(sorted(x)) for x in labels]
            score = np.where(counts > 0, 0.8, 0.0)
            spans: list[list[dict]] = [[] for _ in range(n)]
            for i in _gated(lower.tobytes(), block.offsets):
                text = block.text_bytes(i).decode("utf-8", "replace").translate(_LOWER)
                for start, end, rule in detections(text):
                    labels[i].add(rule.label)
                    score[i] = max(score[i], rule.confidence)
                    spans[i].append({"label": rule.label, "start": start, "end": end, "priority": rule.priority})
            none = counts == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(block.first, n),
                    pa.array(np.diff(words.bounds)),
                    pa.array(counts),
                    pa.array(np.where(none, 0, first), mask=none),
                    pa.array(np.where(none, 0, last), mask=none),
                    pa.array(base),
                    pa.array([",".join(sorted(x)) for x in labels]),
                    pa.array(score),
                    pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("priority", pa.int32())]))),
                ],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: base phrases, labels of all rules, score and the spans that were kept.

    ``n_base`` counts the places of the base phrases among the text's words
    (ASCII letters and digits, and all characters beyond ASCII);
    ``first_word`` and ``last_word`` are their smallest and largest start, null
    where there is none.  ``labels`` adds those of the rules' detections that
    overlaps left standing; ``spans`` has these detections' places in
    characters of the lower-cased text.  ``score`` is the highest confidence
    of a detection, 0 without one.

    A null text counts as empty: no words, no labels, score 0.  Matches of
    equal priority go to the one that starts first, then to the longest, then
    to the earlier rule.  Repeated rows give repeated results, whole texts are
    read, other columns are ignored, an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    spans = "array<struct<label:string, start:int, end:int, priority:int>>"
    out = rows.mapInArrow(_scan, f"id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {spans}")
    return out.withColumnRenamed("id", id_column)
