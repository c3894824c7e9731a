"""Graph operators over ``edges (source_id, target_id, relation, weight)`` and ``entities (context_id, name)``."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions.durable import checkpointed

#: Rounds after which an iteration that still moves raises an error.
MOST_ROUNDS = 60
#: Links that one task closes at most.
FEW_LINKS = 1_500_000
#: Groups that an item takes along at most, and items beyond which a group is large.
FEW_GROUPS, LARGE_GROUP = 8, 1_000


def degrees(edges: DataFrame) -> DataFrame:
    """Number of edge ends at each node."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Nodes whose degree exceeds the mean by more than ``sigmas`` population deviations."""
    found = degrees(edges)
    facts = found.agg(F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("deviation"))
    above = found.crossJoin(F.broadcast(facts)).where(F.col("degree") > F.col("mean") + F.lit(sigmas) * F.col("deviation"))
    return above.where("deviation > 0").select("node", "degree", F.round((F.col("degree") - F.col("mean")) / F.col("deviation"), 2).alias("sigma"))


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(u, v)`` of each node but the smallest of its component, with that smallest one, from all links at once."""
    pieces = [pdf for pdf in batches if len(pdf)]
    if not pieces:
        return
    links = pd.concat(pieces, ignore_index=True)
    codes, names = pd.factorize(pd.concat([links["u"], links["v"]]), sort=True)
    u, v = codes[: len(links)], codes[len(links) :]
    root = np.arange(len(names))
    while True:
        # Both ends take the smaller root of the two, then each root its own root's.
        least = np.minimum(root[u], root[v])
        new = root.copy()
        for ends in (root[u], root[v], u, v):
            np.minimum.at(new, ends, least)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    held = np.flatnonzero(root != np.arange(len(names)))
    names = np.asarray(names)
    for first in range(0, len(held), 10_000):
        part = held[first : first + 10_000]
        yield pd.DataFrame({"u": names[part], "v": names[root[part]]})


def _coded(names: DataFrame) -> Callable[[str], Column]:
    """A hash for the nodes of ``names (node)`` that no two of them share."""
    for seed in range(MOST_ROUNDS):
        code = lambda c, seed=seed: F.xxhash64(F.lit(seed), F.col(c))
        if names.agg(F.count("*") == F.countDistinct(code("node"))).first()[0]:
            return code
    raise RuntimeError(f"nodes share hashes under {MOST_ROUNDS} seeds")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component, size)``: the smallest node reachable, and how many nodes reach it.

    In each round every node moves to the one around it, itself included, that
    comes first in an order drawn for the round, and links join the places
    that nodes have moved to; so nodes and links shrink by a factor, whatever
    the shape, and all rounds together cost little more than the first.  Once
    no more than FEW_LINKS are left, one task finishes them.  Nodes bear
    hashes meanwhile, which are checked to differ.  Raises where MOST_ROUNDS
    rounds don't settle; rows with a null end are left out.
    """
    ends = checkpointed(edges.select("source_id", "target_id").where("source_id IS NOT NULL AND target_id IS NOT NULL"))
    names = checkpointed(ends.select(F.explode(F.array("source_id", "target_id")).alias("node")).distinct())
    code = _coded(names)
    paired = lambda t, a, b: t.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = checkpointed(paired(ends.select(code("source_id").alias("u"), code("target_id").alias("v")), "u", "v"))
    moves = []
    for k in range(MOST_ROUNDS):
        if links.count() <= FEW_LINKS:
            moves.append(checkpointed(links.coalesce(1).mapInPandas(_roots, links.schema)))
            break
        drawn = lambda c, k=k: F.xxhash64(F.lit(k), F.col(c))
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min_by("v", drawn("v")).alias("v"))
        moves.append(checkpointed(first.where(drawn("v") < drawn("u"))))
        to = lambda c: moves[-1].select(F.col("u").alias(c), F.col("v").alias(f"{c}_to"))
        moved = links.join(to("u"), "u", "left").join(to("v"), "v", "left")
        links = checkpointed(paired(moved.select(F.coalesce("u_to", "u").alias("u"), F.coalesce("v_to", "v").alias("v")), "u", "v"))
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    placed = names.select("node", code("node").alias("u"))
    for move in moves:
        placed = placed.join(move, "u", "left").select("node", F.coalesce("v", "u").alias("u"))
    placed = checkpointed(placed)
    whole = placed.groupBy("u").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    return placed.join(whole, "u").select("node", "component", "size")


def open_triangles(edges: DataFrame) -> DataFrame:
    """Pairs of targets of one source that no edge joins in either direction."""
    edges = checkpointed(edges.select("source_id", "target_id").distinct())
    one = edges.select("source_id", F.col("target_id").alias("b")).distinct()
    pairs = one.join(one.select("source_id", F.col("b").alias("c")), "source_id").where("b < c")
    joined = edges.select(F.least("source_id", "target_id").alias("b"), F.greatest("source_id", "target_id").alias("c")).distinct()
    return pairs.join(joined, ["b", "c"], "left_anti").select(F.col("source_id").alias("a"), "b", "c")


def pairs_sharing(rows: DataFrame, item: str, group: str, least: int = 2) -> DataFrame:
    """``(a, b, shared)``: pairs ``a < b`` of items that share at least ``least`` groups.

    Items in fewer groups are dropped first.  Items in up to FEW_GROUPS take
    their groups along, large ones last; a pair is made at the first group it
    shares, and no others, so pairs are never shuffled.  A pair that shares
    ``least`` groups shares one before the last ``least - 1`` of either, which
    are left out of the join.  Pairs with an item in more groups are counted.
    """
    named = rows.select(F.col(item).alias("i"), F.col(group).alias("g")).where("i IS NOT NULL AND g IS NOT NULL").distinct()
    named = checkpointed(named.join(named.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= least), "i"))
    large = checkpointed(named.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > LARGE_GROUP))
    any_large = not large.isEmpty()
    sized = named.join(large, "g", "left").withColumn("size", F.coalesce("size", F.lit(0))) if any_large else named.withColumn("size", F.lit(0).cast("long"))
    held = sized.where(F.col("n") <= FEW_GROUPS).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("size", "g"))).getField("g").alias("all"))
    dealt = held.select("i", "all", F.explode(F.slice("all", F.lit(1), F.size("all") - (least - 1))).alias("g"))
    side = lambda x: dealt.select(F.col("i").alias(x), F.col("all").alias(f"all_{x}"), "g")
    common = F.array_intersect("all_a", "all_b")
    light = side("a").join(side("b"), "g").where("a < b").where((F.size(common) >= least) & (F.get(common, F.lit(0)) == F.col("g"))).select("a", "b", F.size(common).cast("long").alias("shared"))
    if named.where(F.col("n") > FEW_GROUPS).isEmpty():
        return light
    return light.unionByName(_counted(named, sized.where("size > 0") if any_large else None, least))


def _counted(named: DataFrame, large: DataFrame | None, least: int) -> DataFrame:
    """Pairs of ``named (i, g, n)`` of which one is in more than FEW_GROUPS groups, by counting the groups they share.

    A pair that shares two groups shares one that isn't the largest group of
    ``a``; so each item in a ``large`` one leaves its largest out of the
    self-join, and whether the partner is in it is looked up afterwards.
    """
    rest = named
    if large is not None and least >= 2:
        largest = checkpointed(large.groupBy("i").agg(F.max(F.struct("size", "g")).getField("g").alias("g")))
        rest = named.join(largest, ["i", "g"], "left_anti")
    sides = rest.select(F.col("i").alias("a"), "g", F.col("n").alias("na")).join(named.select(F.col("i").alias("b"), "g", F.col("n").alias("nb")), "g")
    met = sides.where("a < b").where(F.greatest("na", "nb") > FEW_GROUPS).groupBy("a", "b").agg(F.count("*").alias("shared"))
    if large is not None and least >= 2:
        looked = met.join(largest.select(F.col("i").alias("a"), "g"), "a", "left")
        also = named.select(F.col("i").alias("b"), "g", F.lit(1).alias("one"))
        met = looked.join(also, ["b", "g"], "left").select("a", "b", (F.col("shared") + F.coalesce("one", F.lit(0))).alias("shared"))
    return met.where(F.col("shared") >= least)


def cooccurrence(entities: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of names that share at least ``least`` contexts."""
    return pairs_sharing(entities, "name", "context_id", least)


def shared_entity_weights(entities: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of contexts that share at least ``least`` names, weighted by a fifth of their number, 1 at most."""
    found = pairs_sharing(entities, "context_id", "name", least)
    return found.select("a", "b", F.round(F.least(F.col("shared") / 5.0, F.lit(1.0)), 2).alias("weight"))


def reflection_gaps(entities: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Co-occurring pairs without an edge in either direction, with a confidence."""
    joined = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    gaps = cooccurrence(entities, least).join(joined, ["a", "b"], "left_anti")
    return gaps.withColumn("confidence", F.least(F.col("shared") / F.lit(5.0), F.lit(1.0)))


def three_hops(entities: DataFrame) -> DataFrame:
    """``(seed, target, n)``: ways from one name to another over a third within a context.

    A context of m names joins each ordered pair in m - 2 ways, so one
    self-join and the context's size give what three would.
    """
    named = entities.select("context_id", "name").distinct()
    sizes = named.groupBy("context_id").agg(F.count("*").alias("m")).where("m > 2")
    kept = named.join(sizes, "context_id")
    pairs = kept.select("context_id", "m", F.col("name").alias("seed")).join(named.select("context_id", F.col("name").alias("target")), "context_id").where("seed < target")
    # As many ways lead back: pairs are counted one way round.
    ways = pairs.groupBy("seed", "target").agg(F.sum(F.col("m") - 2).alias("n"))
    ends = F.array(F.struct("seed", "target"), F.struct(F.col("target").alias("seed"), F.col("seed").alias("target")))
    return ways.select("n", F.explode(ends).alias("way")).select("way.seed", "way.target", "n")


def shared_contexts(entities: DataFrame, a: str, b: str) -> DataFrame:
    """Contexts that mention both names."""
    found = entities.where(F.col("name").isin(a, b)).groupBy("context_id").agg(F.countDistinct("name").alias("n"))
    return found.where("n = 2").select("context_id")


def top(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows with the largest ``by``, ties in order of the other columns."""
    return df.orderBy(F.desc(by), *ties).limit(n)


def subgraph(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("source_id") == node) | (F.col("target_id") == node))


#: Weights of relations and of depths in impact scores (fixed values).
RELATION_WEIGHTS = {"works_on": 1.5, "cross_ref": 1.2, "mentioned_in": 1.0, "lives_in": 0.6, "supersedes": 0.4}
DEPTH_WEIGHTS = {1: 1.0, 2: 0.5, 3: 0.25}


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """``(node, depth)`` of all nodes within ``depth`` steps of the seeds, either way; the first visit counts."""
    # Written once, so that no round derives the edges anew; each only scans them against its frontier.
    return _visited(checkpointed(edges.select("source_id", "target_id")), seeds, depth)


def _visited(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    both = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("next")).unionByName(edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("next")))
    visited = frontier = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        step = frontier.join(both, "node").select(F.col("next").alias("node")).distinct().join(visited, "node", "left_anti")
        frontier = checkpointed(step.withColumn("depth", F.lit(d)))
        visited = visited.unionByName(frontier)
    return visited


def _weighted(weights: dict, key: Column, default: float) -> Column:
    out = None
    for k, w in weights.items():
        out = F.when(key == k, w) if out is None else out.when(key == k, w)
    return out.otherwise(default)


def impact_scores(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Sum over edges into each visited node of relation weight times depth weight, and the node's depth."""
    edges = checkpointed(edges.select("source_id", "target_id", "relation"))
    visited = _visited(edges, seeds, depth)
    reached = visited.where("depth > 0")
    from_nodes = visited.select(F.col("node").alias("from_node"), F.col("depth").alias("from_depth"))
    ends = edges.select(F.col("source_id").alias("from_node"), F.col("target_id").alias("node"), "relation").unionByName(
        edges.select(F.col("target_id").alias("from_node"), F.col("source_id").alias("node"), "relation")
    )
    arrivals = ends.join(from_nodes, "from_node").join(reached, "node").where("from_depth = depth - 1")
    weight = _weighted(RELATION_WEIGHTS, F.col("relation"), 1.0) * _weighted(DEPTH_WEIGHTS, F.col("depth"), 0.0)
    return arrivals.groupBy("node", "depth").agg(F.round(F.sum(weight), 3).alias("score"))


def ancestors(parents: DataFrame) -> DataFrame:
    """``(id, ancestor, steps)`` along ``(id, parent_id)``, doubling the path each round; a missing parent ends a chain.

    Raises on a cycle of parents, as soon as one has been walked round.
    """
    base = checkpointed(parents.where("parent_id IS NOT NULL").join(parents.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("steps")))
    found, jump = base, base
    for _ in range(MOST_ROUNDS):
        if jump.isEmpty():
            return found
        if not found.where("id = ancestor").isEmpty():
            break
        # jump holds the steps of exactly 2**k, found all of up to 2**k; those of 2**k + 1 to 2**(k + 1) follow.
        onward = jump.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("steps").alias("more"))
        further = found.join(onward, "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"))
        found = checkpointed(found.unionByName(further).distinct())
        jump = checkpointed(jump.join(onward, "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps")))
    raise RuntimeError("parents form a cycle")


def built_edges(contexts: DataFrame, mentions: DataFrame, versions: DataFrame) -> DataFrame:
    """All edges of the store, each once: mentions, homes, references from entities to nodes, and versions that replace others."""
    edge = lambda df, s, t, relation, weight: df.select(F.col(s).alias("source_id"), F.col(t).alias("target_id"), F.lit(relation).alias("relation"), F.lit(weight).alias("weight"))
    homes = contexts.where("node IS NOT NULL")
    named = mentions.join(homes.select(F.col("id").alias("context_id"), "node"), "context_id")
    made = edge(mentions, "context_id", "name", "mentioned_in", 1.0).unionByName(edge(homes, "id", "node", "lives_in", 1.0))
    made = made.unionByName(edge(versions.where("parent_id IS NOT NULL"), "id", "parent_id", "supersedes", 1.0)).unionByName(edge(named, "name", "node", "cross_ref", 0.8))
    return made.distinct()


def _shares(mentions: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(name, node, n, share)``: a node's contexts that mention a name, also as a share of all the node's contexts."""
    totals = contexts.groupBy("node").agg(F.count("*").alias("total"))
    counts = mentions.join(contexts.select(F.col("id").alias("context_id"), "node"), "context_id").groupBy("name", "node").agg(F.count("*").alias("n"))
    return counts.join(totals, "node").select("name", "node", "n", (F.col("n") / F.col("total")).alias("share"))


def critical_dependencies(mentions: DataFrame, contexts: DataFrame, like: str) -> DataFrame:
    """Nodes more than half of whose contexts' number are mentions of names like ``like``."""
    named = mentions.where(F.contains("name", F.lit(like))).withColumn("name", F.lit(like))
    found = _shares(named, contexts).where("share > 0.5")
    return found.select("node", F.lit("mentioned_in").alias("relation"), F.round("share", 3).alias("weight"))


def severities(mentions: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(name, severity)`` of losing each name, by the contexts and nodes that mention it and those that depend on it."""
    reach = _shares(mentions, contexts).groupBy("name").agg(F.sum("n").alias("contexts"), F.count("*").alias("nodes"), F.count_if(F.col("share") > 0.5).alias("critical"))
    level = F.when(F.col("critical") >= 3, "critical").when((F.col("critical") >= 1) | (F.col("nodes") >= 5), "high").when((F.col("nodes") >= 3) | (F.col("contexts") > 15), "medium").otherwise("low")
    return reach.select("name", level.alias("severity"))
