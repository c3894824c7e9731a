"""Benchmark decontamination: pigeonhole pieces found by Aho-Corasick, verified by Myers' bit-parallel distance.

An item with an error budget of e edits is cut into e + 1 pieces.  Wherever a
text holds the item with at most e edits, at least one piece stands there
unchanged, so looking up pieces misses nothing.  Each piece found names the
stretch of text where the whole item would be; Myers' algorithm gives the
least edit distance of the item to any part of that stretch.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import bounded_batches

#: Edits allowed, as a share of an item's characters.
ERROR_RATE = 0.05
#: Characters of items that one automaton holds; a larger benchmark is searched in several passes.
BLOCK_CHARS = 2_000_000


def normalised(text: str | None) -> str:
    """Lower case, with each run of white space as one space."""
    return " ".join((text or "").lower().split())


def distance_within(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and the end of the first such part (Myers, 1999)."""
    m = len(pattern)
    if not m:
        return 0, 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    positive, negative, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        equal = places.get(c, 0)
        vertical = equal | negative
        horizontal = (((equal & positive) + positive) ^ positive) | equal
        plus = negative | (full & ~(horizontal | positive))
        minus = positive & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        # A part may start anywhere, so no one is carried into the lowest bit.
        plus, minus = (plus << 1) & full, (minus << 1) & full
        positive = minus | (full & ~(vertical | plus))
        negative = plus & vertical
        if score < best:
            best, end = score, at
    return best, end


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` spans of almost equal length that cover an item."""
    cut = [i * length // (budget + 1) for i in range(budget + 2)]
    return list(zip(cut[:-1], cut[1:], strict=True))


@dataclass
class Item:
    item_id: int
    text: str
    budget: int


class Searcher:
    """Finds items in texts.  Items of equal text are searched once."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            if text := normalised(text):
                by_text.setdefault(text, []).append(item_id)
        self.items = [(ids, text, min(int(len(text) * error_rate), len(text) - 1)) for text, ids in by_text.items()]
        self.automaton = ahocorasick.Automaton()
        for i, (_, text, budget) in enumerate(self.items):
            for start, end in pieces(len(text), budget):
                self.automaton.add_word(text[start:end], (*self.automaton.get(text[start:end], ()), (i, start, end - start)))
        if self.items:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> Iterator[tuple[int, int, int]]:
        """``(item index, distance, end)`` of each place of a normalised text that holds an item within its budget."""
        if not self.items or not text:
            return
        # Starts that were tried, by cells of a budget's width: a cell holds one, so a start is held against three.
        tried: dict[int, dict[int, int]] = {}
        for last, found in self.automaton.iter(text):
            for i, offset, size in found:
                _, item, budget = self.items[i]
                start = last + 1 - size - offset
                seen, cell = tried.setdefault(i, {}), start // (budget + 1)
                if any(abs(start - seen[c]) <= budget for c in (cell - 1, cell, cell + 1) if c in seen):
                    continue
                # The item may begin or end up to a budget away, and a hit nearby in the same stretch is the same place.
                low = max(0, start - 2 * budget)
                stretch = text[low : start + len(item) + 2 * budget]
                if budget == 0 and not _on_word_borders(text, start, len(item)):
                    continue
                distance, end = distance_within(item, stretch)
                seen[cell] = start
                if distance <= budget:
                    yield i, distance, low + end


def _on_word_borders(text: str, start: int, size: int) -> bool:
    before, after = text[start - 1 : start] if start else "", text[start + size : start + size + 1]
    return not (before.isalnum() and text[start].isalnum()) and not (after.isalnum() and text[start + size - 1].isalnum())


_SEARCHERS: dict[tuple, Searcher] = {}


def _searcher(items: list[tuple[int, str]], error_rate: float) -> Searcher:
    """The automaton of the latest items, kept by each Python worker."""
    key = (error_rate, tuple(items))
    if key not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[key] = Searcher(items, error_rate)
    return _SEARCHERS[key]


def _item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("length(trim(text)) > 0")
    n = (items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars + 1
    for block in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        yield sorted((r["item_id"], r["text"]) for r in part.where("item_id IS NOT NULL").collect())


def _hits(items: list[tuple[int, str]], error_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(items, error_rate)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                best: dict[int, list[int]] = {}
                for i, distance, end in search.hits(normalised(text.as_py())):
                    place = best.setdefault(i, [0, distance, end])
                    place[0] += 1
                    if distance < place[1]:
                        place[1:] = [distance, end]
                for i, (places, distance, end) in best.items():
                    for item_id in search.items[i][0]:
                        for column, value in zip(out, (doc_id, item_id, places, distance, end), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "item_id", "places", "distance", "end"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and benchmark item that it holds within the error budget.

    Returns ``(doc_id, item_id, places, distance, end, contaminated)``: the
    number of places, the least distance, the end of the first place with it
    in the normalised text, and true.  Texts and items are compared in lower
    case with single spaces; ``error_rate`` of an item's characters may
    differ.  An item too short for any edit must stand on word borders.

    The benchmark is a table that fits on the driver: its items go into the
    tasks, and documents are read once for each ``block_chars`` of them.

    Null and empty texts hold nothing; null, empty or unnamed items are left
    out.  Items of equal text are each reported.  Repeated rows are each
    reported; other columns are not read.  Without documents or items the
    result is empty.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for items in _item_blocks(benchmark, block_chars):
        part = rows.mapInArrow(_hits(items, error_rate), "doc_id long, item_id long, places long, distance long, end long")
        found = part if found is None else found.unionByName(part)
    return found.withColumn("contaminated", F.lit(True))


def _clean(items: list[tuple[int, str]], error_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(items, error_rate)
        for batch in batches:
            yield batch.filter(pa.array([next(search.hits(normalised(text.as_py())), None) is None for text in batch.column("text")], pa.bool_()))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item within the error budget (see ``find_leaks``)."""
    bounded_batches(docs.sparkSession)
    for items in _item_blocks(benchmark, block_chars):
        docs = docs.mapInArrow(_clean(items, error_rate), docs.schema)
    return docs
