"""Near-duplicate detection by MinHash with sequential Bayesian verification.

1. One pass over the texts makes, for each document, its number of distinct
   word shingles, a 128-bit fingerprint of the shingle set, and a MinHash
   signature.  Documents with equal sets form a class; its smallest id stands
   for it in all that follows.
2. Representatives meet in bands of the signature.  In each band bucket they
   are compared with one centre, never with one another.
3. Each candidate pair is checked batch by batch of its signatures: it is given
   up as soon as the posterior probability that its similarity reaches the
   threshold, given the matches so far, falls under ``miss``.
4. Survivors are confirmed on their full shingle sets.
5. Confirmed links are closed to components.  Where a bucket still holds more
   than one component, further rounds with other centres merge what they can.
6. Documents that still share a mixed bucket, directly or over others, form a
   family.  Each document of a family stands once in it, however many buckets
   it shares.  Members outside the family's largest component are held against
   the members of like set size, block against block, with signatures and sets
   at hand: the Bayesian test prunes, full sets confirm, and only links that
   join components leave a task.  So no link that would join components is
   skipped, and no table of a group's pairs arises.

Shingles are compared by 64-bit hashes, and sets are taken as equal if they
have the same size and the same two 64-bit sums over them.
"""

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesvec
from .columns import bounded_batches, fresh
from .components import connected_components
from .durable import durable

#: Chance that banding or Bayesian pruning loses a pair that is just at the threshold.
MISS = 1e-6
#: Signature values that are compared at once.
STEP = 16
#: Rounds with one centre a bucket, while a mixed bucket has more than AGAINST members.
CENTRE_ROUNDS = 5
#: Members of a family outside its largest component in a block, and members that a task holds against them.
BLOCK, AGAINST = 2048, 4096
#: Bytes of signatures and sets on each side of such a comparison, about; a longer document is a block of its own.
BLOCK_BYTES = 32 << 20
#: Set values that are looked up at once.
LOOKUP = 1 << 20
#: Ids that are broadcast at most (8 bytes each) to pick texts for confirmation; beyond it the texts are joined by id.
BROADCAST_IDS = 1_000_000


def band_plan(threshold: float, miss: float = MISS, most_values: int = 128) -> tuple[int, int]:
    """Bands and rows a band: as many rows as ``most_values`` allow for a chance of ``miss`` to share no band."""
    plan = None
    for rows in range(1, 17):
        bands = ceil(log(miss) / log(1 - threshold**rows)) if threshold < 1 else 1
        if plan is None or bands * rows <= most_values:
            plan = bands, rows
    return plan


def least_matches(threshold: float, n: int, miss: float = MISS) -> int:
    """Fewest of ``n`` matches with which P(similarity >= threshold) is still ``miss`` or more, from a uniform prior.

    With m matches the posterior is Beta(m + 1, n - m + 1); its upper tail at t
    is the chance of at most m successes in n + 1 draws of chance t.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _shingle_sets(block: bytesvec.Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    lower = bytesvec.LOWER_ASCII[block.data]
    words = bytesvec.runs(bytesvec.NOT_SPACE[lower], block.offsets)
    hashes = bytesvec.span_hashes(lower, words.starts, words.ends)
    return bytesvec.distinct_per_text(*bytesvec.shingles(hashes, words.bounds, width))


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of bytes from a flat array and its bounds in items."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _features(width: int, values: int):
    a, b = _permutations(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in bytesvec.blocks(batch.column(1)):
                sets, bounds = _shingle_sets(block, width)
                full = np.flatnonzero(np.diff(bounds))
                signature = np.zeros((len(block), values), dtype=np.uint32)
                sums = np.zeros((2, len(block)), dtype=np.uint64)
                if len(full):
                    at, low = bounds[full], (sets >> np.uint64(32)).astype(np.uint32)
                    for k in range(values):
                        signature[full, k] = np.minimum.reduceat(low * a[k] + b[k], at)
                    sums[0, full] = np.add.reduceat(sets, at)
                    sums[1, full] = np.add.reduceat(bytesvec.mix(sets + np.uint64(0x51ED270B)), at)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(block.first, len(block)),
                        pa.array(np.diff(bounds)),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        _binary(signature.reshape(-1), np.arange(len(block) + 1) * values),
                    ],
                    ["id", "n", "f1", "f2", "signature"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bytesvec.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), _binary(*_shingle_sets(block, width))], ["id", "shingles"])

    return run


def _plausible(left: np.ndarray, right: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Positions of the rows that no batch of signature values rules out."""
    rows, matches, start = np.arange(len(left)), np.zeros(len(left), dtype=np.int32), 0
    for end, needed in least:
        matches = matches + (left[rows, start:end] == right[rows, start:end]).sum(axis=1)
        kept = matches >= needed
        rows, matches, start = rows[kept], matches[kept], end
    return rows


def _matrix(column: pa.Array, values: int) -> np.ndarray:
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, dtype=np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(data, dtype=np.uint8)[first : first + 4 * values * len(column)].view(np.uint32).reshape(-1, values) if len(column) else np.zeros((0, values), dtype=np.uint32)


def _prune_pairs(values: int, least: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _plausible(_matrix(batch.column(2), values), _matrix(batch.column(3), values), least)
            yield batch.select([0, 1]).take(pa.array(rows))

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 64-bit values of a binary column, and each row's bounds among them."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
    return np.frombuffer(data, dtype=np.uint64), bounds


def _intersections(own: np.ndarray, shingles: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of one sorted set with others, given by their places in a flat array."""
    out, ends = np.zeros(len(starts), dtype=np.int64), np.cumsum(sizes)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + LOOKUP, side="right")), first + 1)
        length = sizes[first:last]
        bounds = np.concatenate([[0], np.cumsum(length)])
        values = shingles[np.repeat(starts[first:last] - bounds[:-1], length) + np.arange(bounds[-1])]
        found = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        out[first:last] = np.add.reduceat(found.astype(np.int64), bounds[:-1])
        first = last
    return out


def _link_cells(values: int, least: list[tuple[int, int]], percent: int):
    """Links that join components, among the members of each family and size class in a cell."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, component, family, size_class, left, outer = (table.column(x).to_numpy() for x in ("id", "component", "family", "size_class", "left", "outer"))
        signature = _matrix(table.column("signature").chunk(0), values)
        shingles, bounds = _lists(table.column("shingles").chunk(0))
        sizes = np.diff(bounds)
        order = np.lexsort((size_class, family))
        same = (family[order][1:] == family[order][:-1]) & (size_class[order][1:] == size_class[order][:-1])
        out = []
        for rows in np.split(order, np.flatnonzero(~same) + 1):
            lefts, others = rows[left[rows]], rows[~left[rows]]
            label, own_label = component[others], component[lefts]
            for k, i in enumerate(lefts):
                # A pair of two members outside the largest component is met from both sides; the smaller id compares.
                j = np.flatnonzero((label != own_label[k]) & (~outer[others] | (ids[others] > ids[i])))
                n = sizes[others[j]]
                j = j[100 * np.minimum(n, sizes[i]) >= percent * np.maximum(n, sizes[i])]
                j = j[_plausible(np.broadcast_to(signature[i], (len(j), values)), signature[others[j]], least)]
                at = others[j]
                shared = _intersections(shingles[bounds[i] : bounds[i + 1]], shingles, bounds[at], sizes[at])
                j = j[100 * shared >= percent * (sizes[i] + sizes[at] - shared)]
                joined, first = np.unique(label[j], return_index=True)
                for one in others[j[first]]:
                    out.append((min(ids[i], ids[one]), max(ids[i], ids[one])))
                into = own_label[k]
                label[np.isin(label, joined)] = into
                own_label[np.isin(own_label, joined)] = into
        a, b = np.array(out, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of both sets and of their intersection, for pairs of sorted shingle sets."""
    for batch in batches:
        shared, left, right = [], [], []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
            shared.append(int((y[at] == x).sum()) if len(y) else 0)
            left.append(len(x))
            right.append(len(y))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (shared, left, right))], ["a", "b", "shared", "n_a", "n_b"])


class _Search:
    """The documents of one run, and how to confirm candidate pairs of them."""

    def __init__(self, texts: DataFrame, width: int, percent: int, miss: float) -> None:
        self.texts, self.width, self.percent = texts, width, percent
        self.bands, self.rows = band_plan(percent / 100, miss)
        self.values = self.bands * self.rows
        steps = [*range(STEP, self.values, STEP), self.values]
        self.least = [(n, least_matches(percent / 100, n, miss)) for n in steps]

    def features(self) -> DataFrame:
        return self.texts.mapInArrow(_features(self.width, self.values), "id long, n long, f1 long, f2 long, signature binary")

    def sets(self, ids: DataFrame) -> DataFrame:
        """Full shingle sets of some ids."""
        wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        # An id that occurs in several rows (possible only for damaged input) stands for the first of its sets.
        found = self.texts.join(wanted, "id", "left_semi").mapInArrow(_sets(self.width), "id long, shingles binary")
        return durable(found.groupBy("id").agg(F.min("shingles").alias("shingles")))

    def band_keys(self) -> Column:
        part = lambda k: F.xxhash64(F.substring("signature", 1 + 4 * self.rows * k, 4 * self.rows), F.lit(k))
        return F.array(*(part(k) for k in range(self.bands)))

    def plausible(self, pairs: DataFrame, signatures: DataFrame) -> DataFrame:
        """Pairs that the Bayesian test keeps."""
        one, other = (signatures.select(F.col("id").alias(x), F.col("signature").alias(f"signature_{x}")) for x in "ab")
        joined = pairs.join(one, "a").join(other, "b").select("a", "b", "signature_a", "signature_b")
        return joined.mapInArrow(_prune_pairs(self.values, self.least), "a long, b long")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose full shingle sets reach the threshold."""
        sets = self.sets(durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        one, other = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"shingles_{x}")) for x in "ab")
        joined = pairs.join(one, "a").join(other, "b").select("a", "b", "shingles_a", "shingles_b")
        sizes = joined.mapInArrow(_shared, "a long, b long, shared long, n_a long, n_b long")
        return sizes.where(F.lit(100) * F.col("shared") >= F.lit(self.percent) * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def _mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members ``(key, id, component, size)`` of the buckets of three and more that hold more than one component."""
    labelled = members.join(labels, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"))
    return labelled.join(mixed.where("x <> y AND size > 2").select("key", "size"), "key")


def _centre_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each member of a bucket with one centre of it, if they are of different components."""
    draw = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
    centres = members.groupBy("key").agg(F.min(F.struct(draw.alias("draw"), "id", "component")).alias("centre"))
    pairs = members.join(centres, "key").where("component <> centre.component")
    return pairs.select(F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")).distinct()


def _families(mixed: DataFrame) -> DataFrame:
    """``(id, component, family)`` of the members of mixed buckets: a family's members share buckets, directly or over others."""
    centres = mixed.groupBy("key").agg(F.min("id").alias("centre"))
    chained = connected_components(mixed.join(centres, "key").select(F.col("id").alias("a"), F.col("centre").alias("b")))
    return mixed.select("id", "component").distinct().join(chained.withColumnRenamed("component_id", "family"), "id")


def _cells(families: DataFrame, sizes: DataFrame, values: int, percent: int) -> DataFrame:
    """Cells ``(cell, i, j)`` of members to compare: those outside a family's largest component (``left``), and all of like set size.

    Sets that reach the threshold have sizes within a factor, so their size
    classes are equal or adjacent.  Cells that need no blocks are put together.
    """
    step = -log(percent / 100) * 1.0001 if percent < 100 else 1.0
    members = families.join(sizes, "id").select("id", "component", "family", F.floor(F.log(F.col("n")) / F.lit(step)).cast("int").alias("size_class"), (8 * F.col("n") + 4 * values).alias("bytes"))
    counted = members.groupBy("family", "component").agg(F.count("*").alias("n"))
    largest = counted.groupBy("family").agg(F.max(F.struct("n", "component")).getField("component").alias("largest"))
    members = durable(members.join(largest, "family").withColumn("outer", F.col("component") != F.col("largest")).drop("largest"))
    lefts = members.where("outer").withColumn("left", F.lit(True))
    rights = members.withColumn("size_class", F.explode(F.array(*(F.col("size_class") + d for d in (-1, 0, 1))))).withColumn("left", F.lit(False))
    parts = lambda rows, most, name: rows.groupBy("family", "size_class").agg(F.ceil(F.greatest(F.count("*") / F.lit(most), F.sum("bytes") / F.lit(BLOCK_BYTES))).cast("int").alias(name), F.count("*").alias(f"{name}_rows"), F.sum("bytes").alias(f"{name}_bytes"))
    plan = durable(parts(lefts, BLOCK, "blocks").join(parts(rights, AGAINST, "against"), ["family", "size_class"]))
    alone = plan.where("blocks = 1 AND against = 1").agg(F.sum("blocks_bytes") + F.sum("against_bytes"), F.sum("blocks_rows") + F.sum("against_rows")).first()
    bins = max(ceil((alone[0] or 0) / BLOCK_BYTES), ceil((alone[1] or 0) / AGAINST), 1)
    address = F.xxhash64("family", "size_class")
    plan = plan.select("family", "size_class", "blocks", "against", F.when(F.expr("blocks = 1 AND against = 1"), F.pmod(address, F.lit(bins))).otherwise(address).alias("cell"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    draw = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    own = ["id", "component", "family", "size_class", "outer", "left"]
    lefts = lefts.join(plan, ["family", "size_class"]).select("cell", draw("blocks").alias("i"), span("against").alias("j"), *own)
    rights = rights.join(plan, ["family", "size_class"]).select("cell", span("blocks").alias("i"), draw("against").alias("j"), *own)
    return lefts.unionByName(rights)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every document.

    Texts are lower-cased (A-Z) and cut to words without ASCII white space; a
    document's set holds its distinct shingles of ``width`` words.  Documents
    with ``100 * intersection >= percent * union`` are linked, and
    ``component_id`` is the smallest id reachable over links.

    A text with fewer words than ``width`` is one shingle.  Null and empty
    texts, and texts of white space, have no shingle and are linked with
    nothing.  Rows that repeat an id are each returned; they share a component
    if their sets are equal.  Rows with a null id get ``component_id`` null and
    ``kept`` true.  Ties need no rule: components don't depend on the order of
    rows.  Other columns are not read.  An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    search = _Search(texts.where("id IS NOT NULL"), width, percent, miss)
    features = durable(search.features())
    classes = features.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("representative"), F.min("signature").alias("signature"))
    classes = durable(classes)
    signatures = classes.select(F.col("representative").alias("id"), "signature").groupBy("id").agg(F.min("signature").alias("signature"))

    keyed = signatures.select("id", F.posexplode(search.band_keys()).alias("band", "key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    members = durable(keyed.join(crowded, "key", "left_semi"))
    meeting = durable(signatures.join(members.select("id").distinct(), "id", "left_semi"))

    tested = durable(_centre_pairs(members.withColumn("component", F.col("id")), 0))
    links = durable(search.confirmed(durable(search.plausible(tested, meeting))))
    labels = durable(connected_components(links))
    mixed = durable(_mixed_buckets(members, labels))
    for turn in range(1, CENTRE_ROUNDS + 1):
        largest = mixed.agg(F.max("size")).first()[0]
        if largest is None or largest <= AGAINST:
            break
        pairs = durable(_centre_pairs(mixed, turn).join(tested, ["a", "b"], "left_anti"))
        links = durable(links.unionByName(search.confirmed(durable(search.plausible(pairs, meeting)))))
        tested = durable(tested.unionByName(pairs))
        labels = durable(connected_components(links))
        mixed = durable(_mixed_buckets(members, labels))
    if largest is not None:
        families = durable(_families(mixed))
        sets = search.sets(families.select("id"))
        cells = _cells(families, sets.select("id", (F.octet_length("shingles") / 8).cast("long").alias("n")), search.values, percent)
        cells = cells.join(meeting, "id").join(sets, "id").groupBy("cell", "i", "j")
        found = durable(cells.applyInArrow(_link_cells(search.values, search.least, percent), "a long, b long"))
        if not found.isEmpty():
            labels = durable(connected_components(links.unionByName(found)))

    component = F.coalesce("component_id", "representative")
    classes = classes.join(labels.withColumnRenamed("id", "representative"), "representative", "left").select("f1", "f2", "n", component.alias("component_id"))
    rows = features.join(classes, ["f1", "f2", "n"], "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    rows = rows.unionByName(texts.where("id IS NULL").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component_id")))
    return rows.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))


def one_per_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group of near duplicates: that of the smallest id.

    An id's rows go if none of them is kept; so a row stays that shares its id
    with a copy of another document but has a text of its own.  Of rows that
    repeat an id with equal texts' sets, the one whose text sorts first stays.
    Rows without a shingle or without an id all stay.
    """
    found = durable(near_duplicates(docs, width, percent))
    removed = durable(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select("doc_id"))
    few = removed.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(removed) if few else removed, docs["doc_id"].cast("long") == removed["doc_id"], "left_anti")
    repeated = durable(found.where("doc_id IS NOT NULL").groupBy("doc_id", "component_id").agg(F.count("*").alias("n"), F.max("n_shingles").alias("shingles")).where("n > 1 AND shingles > 0").select("doc_id").distinct())
    if repeated.isEmpty():
        return kept
    few = repeated.count() <= BROADCAST_IDS
    other = F.broadcast(repeated) if few else repeated
    same_id = kept["doc_id"].cast("long") == repeated["doc_id"]
    rank = fresh(docs, "_rank")
    first = kept.join(other, same_id, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(rank) == 1).drop(rank)
    return kept.join(other, same_id, "left_anti").unionByName(first)
