"""Packing token sequences: Martello-Toth dominance reduction, then best fit.

Pieces have whole lengths from 1 to the capacity, so an instance is a
histogram of at most ``capacity`` lengths, whatever the number of documents.
Reduction and best fit work on the histogram and give fillings (multisets of
lengths) with the number of sequences of each.  Documents then find their
sequence by their rank among the pieces of their length, which is counted in
parts, so no length's pieces pass through one task.
"""

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import bounded_batches
from .durable import durable

CAPACITY = 1024
END_ID = 2
#: Pieces of one length whose order one task decides.
PART_ROWS = 50_000

Filling = tuple[tuple[int, ...], int]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Filling], dict[int, int]]:
    """Fix fillings that dominate every other one with the same largest piece; returns them and what is left.

    For a largest piece j, with k the largest other piece that fits beside it:
    {j} alone if nothing fits; {j, k} if it is full, if no two pieces fit
    beside j, or if k is at least as long as the best pair and no three fit;
    {j, k, b} if no three fit and b, the longest that fits beside j and k, is
    at least as long as the smaller piece of any pair.  In each case the
    pieces of another filling can be exchanged for the fixed ones without a
    sequence more (Martello and Toth, 1990).
    """
    left = Counter({n: c for n, c in counts.items() if c > 0})
    lengths = sorted(left)
    fixed: list[Filling] = []

    def available(taken: tuple[int, ...], most: int) -> int | None:
        at = bisect_right(lengths, most)
        while at:
            at -= 1
            if left[lengths[at]] > taken.count(lengths[at]):
                return lengths[at]
        return None

    def smallest(taken: tuple[int, ...], n: int) -> list[int]:
        out: list[int] = []
        for length in lengths:
            out += [length] * min(n - len(out), left[length] - taken.count(length))
            if len(out) == n:
                break
        return out

    def dominant(j: int) -> tuple[int, ...] | None:
        room = capacity - j
        k = available((j,), room)
        if k is None:
            return (j,)
        least = smallest((j,), 3)
        if k == room or len(least) < 2 or least[0] + least[1] > room:
            return (j, k)
        if len(least) == 3 and sum(least) <= room:
            return None
        b = available((j, k), room - k)
        if b is None:
            # k fits alone only; it dominates if no pair is longer.
            return (j, k) if _best_pair(lengths, left, j, room) <= k else None
        at, longest = bisect_right(lengths, room // 2), None
        while at and longest is None:
            at -= 1
            y = lengths[at]
            x = available((j, y), room - y) if left[y] > (y == j) else None
            longest = y if x is not None and x >= y else None
        return (j, k, b) if longest is None or longest <= b else None

    for j in reversed(lengths):
        while left[j]:
            filling = dominant(j)
            if filling is None:
                break
            use = Counter(filling)
            times = min(left[n] // c for n, c in use.items())
            for n, c in use.items():
                left[n] -= c * times
            fixed.append((tuple(sorted(filling, reverse=True)), times))
    return fixed, {n: c for n, c in left.items() if c}


def _best_pair(lengths: list[int], left: Counter, j: int, room: int) -> int:
    """The largest sum of two available pieces that is at most ``room``, or 0."""
    have = [n for n in lengths if left[n] - (n == j) > 0]
    best, a, b = 0, 0, len(have) - 1
    while a <= b:
        total = have[a] + have[b]
        if total > room:
            b -= 1
        else:
            if a < b or left[have[a]] - (have[a] == j) > 1:
                best = max(best, total)
            a += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best fit in descending order of length; equal steps are taken for all equal sequences at once."""
    by_room: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, filling: tuple[int, ...], times: int) -> None:
        if room not in by_room:
            rooms.insert(bisect_left(rooms, room), room)
        by_room[room].append([filling, times])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            filling, times = by_room[room].pop() if at < len(rooms) else ((), n)
            if at < len(rooms) and not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            each = min(room // length, n)
            full = min(times, n // each)
            if times > full and filling:
                put(room, filling, times - full)
            put(room - each * length, filling + (length,) * each, full)
            n -= full * each
    return [(filling, times) for groups in by_room.values() for filling, times in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Filling]:
    """Fillings for a histogram of lengths.  Their number depends on the number of lengths, not of pieces."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """Where the r-th piece of each length goes: for each length, runs of ranks over which sequence ids ascend."""

    def __init__(self, fillings: list[Filling]) -> None:
        runs: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
        ranks: Counter = Counter()
        sequence = 0
        for filling, times in fillings:
            offset = 0
            for length, each in sorted(Counter(filling).items(), reverse=True):
                # Rank r is the (r % each)-th piece of this length in the (r // each)-th of these sequences.
                runs[length].append((ranks[length], each, sequence, offset, length))
                ranks[length] += each * times
                offset += each * length
            sequence += times
        self.sequences = sequence
        self.runs = {length: np.array(rows, dtype=np.int64).reshape(-1, 5) for length, rows in runs.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence ids and offsets."""
        sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
        for length in np.unique(lengths):
            rows, table = np.flatnonzero(lengths == length), self.runs[int(length)]
            run = table[np.searchsorted(table[:, 0], ranks[rows], side="right") - 1]
            within = ranks[rows] - run[:, 0]
            sequence[rows] = run[:, 2] + within // run[:, 1]
            offset[rows] = run[:, 3] + within % run[:, 1] * length
        return sequence, offset


_ENCODERS: dict[str, object] = {}


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file.

    Texts of ASCII and Latin letters are encoded by tiktoken with the same
    vocabulary, which is several times as fast; a text with a special token's
    string or with other characters goes through tokenizers itself, as both
    libraries split words by Unicode tables of their own.
    """

    def __init__(self, path: str) -> None:
        import json
        import os
        import re

        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.exact = Tokenizer.from_file(path)
        specials = [re.escape(t["content"]) for t in model["added_tokens"]]
        self.odd = re.compile("|".join(["[^\x00-ɏ‐-‧]", *specials]))
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        ids = {t["id"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in model["model"]["vocab"].items() if i not in ids}
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        plain = model["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and model["normalizer"] is None
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=words, mergeable_ranks=ranks, special_tokens={}) if plain else None

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or self.odd.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole ones of ``capacity``, after a shorter first one if need be."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))] if n else []


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    for column, value in zip(columns, (doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _placed(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def _ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Pieces with their rank (from 0) among those of their length, ordered in parts of about PART_ROWS rows."""
    hot = {n: -(-c // PART_ROWS) for n, c in histogram.items() if c > PART_ROWS}
    parts = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for item in hot.items() for x in item)), F.col("length").cast("int")), F.lit(1)) if hot else F.lit(1)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), parts).cast("int"))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.selectExpr("length", "part", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS before")
    numbered = pieces.selectExpr("*", "row_number() OVER (PARTITION BY length, part ORDER BY doc_id, piece, ids_crc32) - 1 AS place")
    return numbered.join(before, ["length", "part"]).selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "before + place AS rank")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack all documents' tokens into as few sequences of ``capacity`` as the method finds.

    Returns a row for each piece: ``(doc_id, piece, start, length, ids_crc32,
    sequence_id, offset)``.  A document's tokens are its text's ids and then
    ``end_id``; only a longer document than ``capacity`` is cut, to whole
    pieces after a first one that may be shorter.

    A null or empty text has the end id alone.  Rows that repeat an id are
    packed each.  Ties among pieces of a length go by id, piece and checksum.
    Other columns are not read; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    pieces = durable(rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = Places(plan(histogram, capacity))
    out = _ranked(pieces, histogram).mapInArrow(_placed(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_column)
