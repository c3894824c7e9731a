"""Connected components of a link table, without a driver-side union-find."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def _larger_to_smallest(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest id of its closed neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _smaller_to_smallest(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether each id has one link, to a root that has none itself."""
    forked = links.groupBy("u").count().where("count > 1").select("u")
    chained = links.select(F.col("v").alias("u")).join(links, "u", "left_semi")
    return forked.unionByName(chained).isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(id, component_id)`` for every id that occurs in a link between different ids.

    ``component_id`` is the smallest id reachable.  Alternates large-star and
    small-star steps (Kiveris et al., 2014) until the links form stars; the
    number of rounds grows with the logarithm of the longest path.  Rows with
    a null end and links from an id to itself are left out; repeated links
    count once; an empty table gives an empty result.
    """
    links = durable(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        links = durable(_smaller_to_smallest(_larger_to_smallest(links)))
        if _are_stars(links):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
