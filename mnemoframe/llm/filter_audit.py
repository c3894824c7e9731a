"""Interaction audit of document filters: what each filter removes in every order of application.

1. A task reads documents, marks those that fail a filter on the text, and puts
   equal texts together: the smallest id of a text stands for it, every other
   id is known not to be the smallest.
2. Texts are routed by their xxhash64: all documents with one hash meet in one
   partition, once a task and text.  There chains of the texts that collide,
   with whole text and smallest id, decide which ids are copies.  Documents
   that are known copies already travel without their text, spread evenly.
3. Each document is then a mask of failed filters.  ``combineByKey`` merges
   vectors that count documents, good ones and toxic ones by mask, for each
   part of the table; every order of the filters follows from these counts.
"""

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import permutations
from math import ceil

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Letters of the filters; the last removes copies.
FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Least distinct words, most capital letters, in hundredths of words and of code points.
DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 2
#: Signs that fail a document.
SIGNS = b"#$%&*|"
#: Bytes of texts that a task holds to put equal ones together; then it sends what it has.
HELD_BYTES = 32 << 20
#: Bytes of texts for each partition that they are routed to, so that the chains of one fit in memory.
ROUTED_BYTES = 32 << 20

_SIGNS = re.compile(b"[" + re.escape(SIGNS) + b"]")
_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_COPY = 1 << FILTERS.index("E")


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails, A lowest."""
    words = text.split()
    few = len(words) < LEAST_WORDS
    repeated = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    loud = 100 * capitals > CAPITAL_PERCENT * len(text.translate(None, _CONTINUED))
    return few | repeated << 1 | loud << 2 | bool(_SIGNS.search(text)) << 3


def _marked(rows: Iterator[Row]) -> Iterator[tuple[int, tuple]]:
    """``(route, (mask, id, parts, text))`` for each distinct text, with its smallest id and the number of rows of that id by part; ``(route, (mask, id, part, None))`` for all other rows."""
    held: dict[bytes, tuple[int, int, Counter]] = {}
    size = sent = 0

    def alone(*row) -> tuple[int, tuple]:
        nonlocal sent
        sent += 1
        return xxhash.xxh64_intdigest(b"%d %d" % (row[1] or 0, sent)), (*row, None)

    def texts() -> Iterator[tuple[int, tuple]]:
        for text, row in held.items():
            yield xxhash.xxh64_intdigest(text), (*row, text)

    for doc_id, part, text in rows:
        text = (text or "").encode("utf-8", "surrogatepass")
        mask, least, parts = held.get(text) or (text_mask(text), None, None)
        if doc_id is None:
            yield alone(mask, doc_id, part)
        elif least is None:
            held[text] = mask, doc_id, Counter([part])
            size += len(text)
        elif doc_id > least:
            yield alone(mask | _COPY, doc_id, part)
        elif doc_id == least:
            parts[part] += 1
        else:
            for other in parts.elements():
                yield alone(mask | _COPY, least, other)
            held[text] = mask, doc_id, Counter([part])
        if size > HELD_BYTES:
            yield from texts()
            held, size = {}, 0
    yield from texts()


def _chained(routed: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int | None, str, int]]:
    """``(id, part, mask)`` with the copies' bit.  A chain holds ``[text, smallest id, its rows by part, mask]`` of all texts of a hash."""
    chains: dict[int, list[list]] = {}
    for address, (mask, doc_id, parts, text) in routed:
        if text is None:
            yield doc_id, parts, mask
            continue
        chain = chains.setdefault(address, [])
        link = next((link for link in chain if link[0] == text), None)
        if link is None:
            chain.append([text, doc_id, parts, mask])
        elif doc_id == link[1]:
            link[2].update(parts)
        else:
            if doc_id < link[1]:
                link[1], link[2], doc_id, parts = doc_id, parts, link[1], link[2]
            for part in parts.elements():
                yield doc_id, part, mask | _COPY
    for chain in chains.values():
        for _, doc_id, parts, mask in chain:
            for part in parts.elements():
                yield doc_id, part, mask


def masks(docs: DataFrame, part: Column | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, part, mask)`` for every document: the bits of the filters that it fails, A lowest.

    A null text is empty, and empty texts are equal.  A row without an id is no
    copy and makes none.  Rows that repeat an id and a text aren't copies of
    each other.  A null part is "".
    """
    part = F.lit("") if part is None else F.coalesce(part.cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), part.alias("part"), F.col(text_column).cast("string").alias("text"))
    n = max(ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / ROUTED_BYTES), 1)
    chained = rows.rdd.mapPartitions(_marked).partitionBy(n, lambda address: address).mapPartitions(_chained)
    return docs.sparkSession.createDataFrame(chained, "doc_id long, part string, mask int", verifySchema=False)


def _one(row: Row) -> np.ndarray:
    counts = np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)
    counts[:, row["mask"]] = 1, row["good"], row["toxic"]
    return counts


def _with(counts: np.ndarray, row: Row) -> np.ndarray:
    counts[:, row["mask"]] += (1, row["good"], row["toxic"])
    return counts


def mask_counts(marked: DataFrame, labels: DataFrame):
    """RDD of ``(part, counts)``: documents, good and toxic ones by mask.  A document is good or toxic if any of its labels says so."""
    kinds = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    kinds = kinds.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = marked.join(kinds, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return rows.rdd.map(lambda row: (row["part"], row)).combineByKey(_one, _with, np.add)


def orders_of(counts: np.ndarray) -> Iterator[tuple]:
    """``(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` for all orders of the filters."""
    kinds = np.arange(counts.shape[1])
    fails = [(kinds >> k & 1).astype(bool) for k in range(len(FILTERS))]
    rows, removed_by = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        left = np.ones(len(kinds), dtype=bool)
        for step, letter in enumerate(order, 1):
            k = FILTERS.index(letter)
            removed, redundant = left & fails[k], fails[k] & ~left
            left = left & ~fails[k]
            n, good, toxic = (int(v) for v in counts[:, removed].sum(axis=1))
            removed_by[letter] += n
            rows.append(("".join(order), step, int(counts[0, left].sum()), n, int(counts[0, redundant].sum()), int(counts[0, 1 << k]), good, toxic))
    for row in rows:
        yield *row, removed_by[row[0][row[1] - 1]]


def audit(docs: DataFrame, labels: DataFrame, part: Column | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each part, order of the filters and step, with counts of documents.

    ``kept`` after the step; ``removed`` by it; ``redundant``, failing its
    filter but removed before; ``unique_fails``, failing its filter alone;
    ``good_lost`` and ``toxic_lost``, removed here and labelled so;
    ``shapley``, what its filter removes summed over all orders.  Documents
    are taken as in ``masks``; an empty table gives an empty result; columns
    other than the id, text and part, and of the labels ``doc_id``, ``quality``
    and ``toxic``, are not read.
    """
    found = mask_counts(masks(docs, part, id_column, text_column), labels)
    rows: Callable = lambda item: [(item[0], *row) for row in orders_of(item[1])]
    shape = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return docs.sparkSession.createDataFrame(found.flatMap(rows), shape, verifySchema=False)
