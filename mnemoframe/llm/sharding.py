"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

A row starts at the root and descends region, rack and shard levels.  At each
node every child draws an exponential variate from a hash of the row's key and
the child's name, divided by the child's weight; the least draw wins.  A
child's draw depends on nothing but its own name and weight, so when weights
change, rows move only into or out of the subtrees whose weights change.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable

#: Rows of a part of a shard, about, and parts of a shard at least; a part's slots are ordered by one task.
SLOT_ROWS, LEAST_PARTS = 50_000, 1024


@dataclass(frozen=True)
class Node:
    """A subtree; a leaf has the number of its shard."""

    name: str
    weight: float = 1.0
    children: tuple["Node", ...] = ()
    shard: int | None = None


def branch(name: str, *children: Node) -> Node:
    return Node(name, sum(c.weight for c in children), children)


def shard_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 4, whole_regions: int = 2) -> Node:
    """A tree for ``shards`` shards of equal weight.

    The first ``whole_regions`` regions are laid out full; each further shard
    opens a region of its own, so adding one moves rows into it only.  Weights
    of shards that a full region doesn't have yet are 0.
    """
    regions, number = [], 0
    for r in range(whole_regions):
        racks = []
        for k in range(racks_per_region):
            leaves = [Node(f"{r}/{k}/{s}", float(number + s < shards), shard=number + s) for s in range(shards_per_rack)]
            number += shards_per_rack
            racks.append(branch(f"{r}/{k}", *leaves))
        regions.append(branch(f"{r}", *racks))
    for r in range(whole_regions, whole_regions + max(0, shards - number)):
        regions.append(branch(f"{r}", branch(f"{r}/0", Node(f"{r}/0/0", shard=number + r - whole_regions))))
    return branch("", *regions)


def place(key: Column, node: Node) -> Column:
    """The shard that a key descends to.  A null key descends like any other value."""
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return place(key, live[0])
    draws = []
    for child in live:
        uniform = (F.xxhash64(F.lit(child.name), key).cast("double") + F.lit(2.0**63 + 1)) / F.lit(2.0**64 + 2**13)
        draws.append(-F.log(uniform) / F.lit(child.weight))
    least = F.least(*draws)
    chosen = F.when(draws[0] == least, place(key, live[0]))
    for draw, child in zip(draws[1:-1], live[1:-1], strict=True):
        chosen = chosen.when(draw == least, place(key, child))
    return chosen.otherwise(place(key, live[-1]))


def assign_shards(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Place every row by the law ``key``: its id and the number of shards decide.

    Returns ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``.
    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1, with the checksum
    of the empty text).  ``slot`` numbers a shard's rows from 0 without gaps,
    in an order that depends on ids and texts alone.  ``grown_shard`` is the
    place with one shard more: either the same, or the new shard.

    Equal ids go to the same shard, each with a slot of its own; a null id is
    a key like any other.  Only the id and the text are read.  A hot text,
    source or shard is no single task's load: slots are counted in parts of a
    shard before they are numbered, and the number of parts follows that of
    the rows.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = rows.withColumns(
        {
            "shard": place(F.col("doc_id"), shard_tree(shards)).cast("int"),
            "grown_shard": place(F.col("doc_id"), shard_tree(shards + 1)).cast("int"),
        }
    )
    rows = durable(rows)
    parts = max(LEAST_PARTS, rows.count() // (SLOT_ROWS * shards) + 1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.selectExpr("shard", "part", "sum(n) OVER (PARTITION BY shard ORDER BY part) - n AS before")
    numbered = rows.selectExpr("*", "row_number() OVER (PARTITION BY shard, part ORDER BY doc_id, text_crc32, size) - 1 AS place")
    placed = numbered.join(before, ["shard", "part"])
    slot = (F.col("before") + F.col("place")).cast("long").alias("slot")
    return placed.select(F.col("doc_id").alias(id_column), "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
