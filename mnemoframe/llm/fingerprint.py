"""Homomorphic multiset fingerprints of documents.

A text is a multiset of paragraphs (lines).  Each paragraph is hashed to a wide
vector, and a fingerprint is the sum of its paragraphs' vectors modulo powers
of two.  So the order of paragraphs doesn't matter, and paragraphs can be added
or taken away without the rest.  White space between words of a paragraph
counts, around paragraphs it doesn't.

The vector has a count (modulo 2**32) and four dense lanes (modulo 2**64) of
the paragraph's own hash, so texts with other paragraphs, or with the same
words in another order within a paragraph, differ.  Beside them are
STRATA * LANES sparse lanes (a value modulo 2**16 and a count modulo 2**32) for
likeness, so that an edit within a paragraph costs no more than its own words:
the paragraph is cut into pieces after words whose own hash says so, and each
piece changes one lane: its stratum holds a share of all pieces that halves
from one stratum to the next.  Equality compares the whole; likeness compares
lanes of strata that are sparse enough for the texts' distinct pieces.
"""

import base64
import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesvec
from .columns import bounded_batches

#: The sparsest strata still fit 2 * LANES * 2**(STRATA - 1) distinct units, as many as a string of 2**31 bytes can hold.
STRATA, LANES, DENSE = 26, 16, 4
#: Words of a piece of a paragraph, on average.
PIECE_WORDS = 4
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SPARSE_SALT = np.uint64(0x13198A2E03707345)
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], dtype=np.uint64)
#: Rows of a range of ids that one task reads in order; ranges at most (8 bytes each on the driver), beyond which they hold more rows.
RANGE_ROWS, MOST_RANGES = 20_000, 200_000


def _units(block: bytesvec.Block) -> tuple[bytesvec.Words, bytesvec.Words]:
    """Spans of paragraphs, and of their pieces: words to the next one whose hash says so or that repeats the one before, or to the line's end."""
    data, offsets = block.data, block.offsets
    words = bytesvec.runs(bytesvec.NOT_SPACE[data], offsets)
    if not len(words.starts):
        return words, words
    hashes = bytesvec.span_hashes(data, words.starts, words.ends)
    full = np.diff(words.bounds) > 0
    line = np.searchsorted(np.flatnonzero((data == 10) | (data == 13)), words.starts)
    ends_line = np.ones(len(hashes), dtype=bool)
    ends_line[:-1] = line[1:] != line[:-1]
    ends_line[words.bounds[1:][full] - 1] = True
    repeats = np.zeros(len(hashes), dtype=bool)
    repeats[1:] = hashes[1:] == hashes[:-1]
    repeats[words.bounds[:-1][full]] = False  # a text's first word has none before it
    ends_piece = ends_line | repeats | (hashes % np.uint64(PIECE_WORDS) == 0)

    def spans(ends_unit: np.ndarray) -> bytesvec.Words:
        ends = np.flatnonzero(ends_unit)
        starts = words.starts[np.concatenate([[0], ends[:-1] + 1])]
        return bytesvec.Words(starts, words.ends[ends], np.searchsorted(starts, offsets))

    return spans(ends_line), spans(ends_piece)


def vectors(column: pa.Array) -> dict[str, np.ndarray]:
    """The fingerprints' parts for each text of a column: ``count``, ``dense``, and the sparse lanes' ``values`` and ``counts``."""
    n = len(column)
    out = {"count": np.zeros(n, dtype=np.uint32), "dense": np.zeros((n, DENSE), dtype=np.uint64), "values": np.zeros((n, STRATA * LANES), dtype=np.uint16), "counts": np.zeros((n, STRATA * LANES), dtype=np.uint32)}
    for block in bytesvec.blocks(column):
        paragraphs, pieces = _units(block)
        hashes = bytesvec.span_hashes(block.data, paragraphs.starts, paragraphs.ends)
        out["count"][block.first : block.first + len(block)] = np.diff(paragraphs.bounds)
        full = np.flatnonzero(np.diff(paragraphs.bounds))
        if len(full):
            for k in range(DENSE):
                out["dense"][block.first + full, k] = np.add.reduceat(bytesvec.mix(hashes ^ _SALTS[k]), paragraphs.bounds[full])
        hashes = bytesvec.span_hashes(block.data, pieces.starts, pieces.ends)
        of = block.first + np.repeat(np.arange(len(block)), np.diff(pieces.bounds))
        # Mixed again, as a piece of one word has that word's hash, whose low bits cut the pieces.
        spread = bytesvec.mix(hashes ^ _SPARSE_SALT)
        low = spread & np.uint64((1 << (STRATA - 1)) - 1)
        lowest = np.where(low == 0, np.uint64(1 << (STRATA - 1)), low & (~low + np.uint64(1)))
        stratum = np.log2(lowest.astype(np.float64)).astype(np.int64)
        lane = stratum * LANES + ((spread >> np.uint64(32)) % np.uint64(LANES)).astype(np.int64)
        value = ((spread >> np.uint64(48)) & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
        np.add.at(out["values"], (of, lane), value)
        np.add.at(out["counts"], (of, lane), np.uint32(1))
    return out


#: Parts of a fingerprint in their order, with the bytes of a number and how many there are.
_PARTS = (("count", 4, 1), ("dense", 8, DENSE), ("values", 2, STRATA * LANES), ("counts", 4, STRATA * LANES))


def as_text(v: dict[str, np.ndarray]) -> list[str]:
    """Fingerprints in base 64."""
    rows = np.hstack([v[k].astype(f">u{size}").view(np.uint8).reshape(len(v["count"]), -1) for k, size, _ in _PARTS])
    return [base64.b64encode(row.tobytes()).decode() for row in np.ascontiguousarray(rows)]


def parse(fingerprints: list[str]) -> dict[str, np.ndarray]:
    """The parts that ``as_text`` wrote."""
    raw = np.frombuffer(b"".join(map(base64.b64decode, fingerprints)), dtype=np.uint8).reshape(len(fingerprints), -1)
    out, at = {}, 0
    for k, size, numbers in _PARTS:
        part = np.ascontiguousarray(raw[:, at : at + size * numbers]).view(f">u{size}").astype(f"u{size}")
        out[k] = part.reshape(-1) if numbers == 1 else part
        at += size * numbers
    return out


def fingerprint(text: str) -> str:
    return as_text(vectors(pa.array([text])))[0]


def combine(one: str, other: str, sign: int = 1) -> str:
    """The fingerprint of both texts' paragraphs together, or (sign -1) of the first's without the second's."""
    a, b = parse([one]), parse([other])
    return as_text({k: a[k] + b[k] if sign > 0 else a[k] - b[k] for k in a})[0]


def _first_stratum(counts: np.ndarray) -> np.ndarray:
    """The first stratum from which on a text has about two distinct units a lane or fewer, by the lanes that are occupied."""
    free = 1 - (counts != 0).reshape(len(counts), STRATA, LANES).mean(axis=2)
    with np.errstate(divide="ignore"):
        distinct = np.cumsum(-LANES * np.log(free)[:, ::-1], axis=1)[:, ::-1]
    return np.minimum((distinct > 2 * LANES).sum(axis=1), STRATA - 1)


def likeness(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Mean agreement of the lanes in use, 0 to 1; 1 for equal fingerprints.

    Lanes whose values stand in the ratio of their counts hold the same units,
    perhaps repeated more often in one text; they agree by the smaller count
    over the larger.  Others don't agree.  Only strata count from which on
    each text has about two distinct units a lane or fewer; repeats of a unit
    don't matter for that.
    """
    equal = np.logical_and.reduce([(a[k] == b[k]).reshape(len(a[k]), -1).all(axis=1) for k in a])
    first = np.maximum(_first_stratum(a["counts"]), _first_stratum(b["counts"]))
    counted = np.repeat(np.arange(STRATA), LANES)[None, :] >= first[:, None]
    used = ((a["counts"] != 0) | (b["counts"] != 0)) & counted
    same = used & (a["values"] * b["counts"].astype(np.uint16) == b["values"] * a["counts"].astype(np.uint16))
    shares = np.where(same, np.minimum(a["counts"], b["counts"]) / np.maximum(np.maximum(a["counts"], b["counts"]), 1), 0.0)
    return np.where(equal, 1.0, shares.sum(axis=1) / np.maximum(used.sum(axis=1), 1))


def _edited(text: str, following: str) -> str:
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive range by range in order; a range ends with the head of the next one (``own`` false)."""
    def emit(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        edited = [_edited(x, y) for x, y in zip(texts, following, strict=True)]
        three = [vectors(pa.array(x, pa.large_string())) for x in (texts, edited, following)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(x) for x in texts], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array(as_text(three[0]), pa.string()),
                pa.array(as_text(three[1]), pa.string()),
                pa.array(likeness(three[0], three[1])),
                pa.array(likeness(three[0], three[2])),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    waiting = None
    for batch in batches:
        ids, texts, following, size = [], [], [], 0
        for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            text = text.as_py() or ""
            if waiting is not None:
                ids.append(waiting[0])
                texts.append(waiting[1])
                following.append(text)
                size += len(waiting[1])
            # Of several rows that share the next head's id, the first counts.
            waiting = (doc_id, text) if own else None
            if size > 1 << 20:
                yield emit(ids, texts, following)
                ids, texts, following, size = [], [], [], 0
        if ids:
            yield emit(ids, texts, following)


def _cuts(rows: DataFrame, ranges: int) -> list[int]:
    """Keys that end ranges of about equally many rows, smallest first: Spark's own range partitioning of the keys alone."""
    if ranges < 2:
        return []
    ends = rows.select("key").repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.max("key").alias("key"))
    return sorted({r["key"] for r in ends.collect()})[:-1]


def _range(key: Column, cuts: list[int]) -> Column:
    """The range of a key, 0 for the largest keys: the number of cuts that aren't under it, found in two steps."""
    if not cuts:
        return F.lit(0)
    # One string for each table, which the optimiser folds to one value: a literal for each cut would swell the plan.
    table = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    step = isqrt(len(cuts)) + 1
    steps = cuts[step - 1 :: step]
    group = F.size(F.filter(table(steps), lambda c: c < key)) if steps else F.lit(0)
    within = F.slice(table(cuts), group * F.lit(step) + 1, F.lit(step))
    under = group * F.lit(step) + F.size(F.filter(within, lambda c: c < key))
    return (F.lit(len(cuts)) - under).cast("int")


def compare_with_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness to it and to the next document.

    Returns ``(doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next)``.  The edited text has its
    last ``n_chars // 3`` code points replaced by as many first ones (or all)
    of the next document by descending id; the first follows the last.

    A null text is empty: no paragraph, a fingerprint of zeros, which is like
    nothing but another empty one.  Rows of equal ids follow one another in
    the order of their texts; a null id comes last.  A single row is its own
    next.  Other columns are not read; an empty table gives an empty result.

    Rows are dealt to ranges of ids once, and the head of each range is sent
    to the end of the range before it too, so no order over all rows passes
    through one task.  Rows of one id belong to one range, which is read as a
    stream.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("id", F.lit(-(2**63))))
    wanted = max(rows.count() // RANGE_ROWS + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("range", _range(F.col("key"), _cuts(rows, min(wanted, MOST_RANGES))))
    tops = sorted(tuple(r) for r in rows.groupBy("range").agg(F.max("key")).collect())
    heads = [(r, top, tops[i - 1][0]) for i, (r, top) in enumerate(tops)]
    heads = spark.createDataFrame(heads, "range int, top long, goes_to int")
    own = F.struct("range", F.lit(True).alias("own"))
    copy = F.struct(F.col("goes_to").alias("range"), F.lit(False).alias("own"))
    places = F.explode(F.when(F.col("key") == F.col("top"), F.array(own, copy)).otherwise(F.array(own)))
    dealt = rows.join(F.broadcast(heads), "range").select("id", "text", "key", places.alias("place")).select("id", "text", "key", "place.*")
    ordered = dealt.repartitionById(len(tops) or 1, F.col("range")).sortWithinPartitions("range", F.desc("own"), F.desc("key"), "text")
    out = ordered.select("id", "text", "own").mapInArrow(_compare, _SCHEMA)
    return out.withColumnRenamed("doc_id", id_column)
