"""Putting answers together: graph boost, tiers within budgets, chunk search, inventories, composite similarity."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.text import token_estimate
from mnemoframe.operators.decompose import summary
from mnemoframe.operators.retrieval import cosine, snippet

#: Tokens of the tiers, and texts of the deepest one (fixed values).
TIER_TOKENS, DEEP_TEXTS = {"l0": 3_000, "l1": 10_000, "l2": 50_000}, 5
#: Weights of scales in chunk search, and of the parts of a composite similarity (fixed values).
SCALE_WEIGHTS = {"section": 1.0, "paragraph": 0.95, "chunk": 0.90}
PART_WEIGHTS = {"cosine": 0.60, "entities": 0.20, "intent": 0.15, "node": 0.05}
CHUNKS_OF_A_CONTEXT = 50


def uri_filter(uri: str) -> tuple[str | None, str | None]:
    """Node and type that a ``scheme://node/type/...`` prefix names."""
    parts = [p for p in uri.partition("://")[2].split("/") if p]
    return (parts[0] if parts else None), (parts[1] if len(parts) > 1 else None)


def listed(contexts: DataFrame, uri: str, limit: int = 50) -> DataFrame:
    """The latest contexts under a URI prefix; none where it names no node."""
    node, kind = uri_filter(uri)
    found = contexts.where(F.lit(node is not None) & (F.col("node") == F.lit(node)))
    if kind is not None:
        found = found.where(F.col("type") == kind)
    return found.orderBy(F.desc("modified_at"), "id").limit(limit)


def graph_boost(results: DataFrame, mentions: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """``(id, score)`` with a tenth more for each of a result's entities that an edge joins to a node named like a query term.

    A node is named like a term that occurs in its id, whatever the case.
    """
    terms = query.lower().split()
    like = lambda c: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(c), t)) if terms else F.lit(False)
    ends = edges.select(F.col("source_id").alias("named"), F.col("target_id").alias("name")).unionByName(edges.select(F.col("target_id").alias("named"), F.col("source_id").alias("name")))
    connected = ends.where(like(F.col("named"))).select("name").distinct()
    counts = mentions.select(F.col("context_id").alias("id"), "name").distinct().join(connected, "name", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    return results.join(counts, "id", "left").select("id", F.round(F.col("score") * (1 + 0.1 * F.coalesce("n", F.lit(0))), 4).alias("score"))


def within(ranked: DataFrame, tokens: int) -> DataFrame:
    """The head of a bounded ranked list ``(id, score, text)`` whose texts fit into so many tokens."""
    spent = F.sum(token_estimate(F.col("text"))).over(Window.orderBy(F.desc("score"), "id"))
    return ranked.withColumn("spent", spent).where(F.col("spent") <= tokens)


def inventory(contexts: DataFrame) -> DataFrame:
    """One row with the store's structure as a text: a line for each node, with its types' counts."""
    counts = contexts.groupBy("node", "type").agg(F.count("*").alias("n"))
    parts = counts.groupBy("node").agg(F.sum("n").alias("n"), F.concat_ws(", ", F.sort_array(F.collect_list(F.concat("type", F.lit(" "), F.col("n").cast("string"))))).alias("types"))
    line = F.concat(F.lit("- "), "node", F.lit(" ("), F.col("n").cast("string"), F.lit("): "), "types").alias("line")
    # Each line takes several characters, so more lines than characters are never part of the text.
    parts = parts.select(line).where("line IS NOT NULL").orderBy("line").limit(4 * TIER_TOKENS["l0"])
    text = F.concat_ws("\n", F.sort_array(F.collect_list("line")))
    return parts.agg(F.concat(F.lit("# Inventory\n"), text).alias("text")).select(F.substring("text", 1, 4 * TIER_TOKENS["l0"]).alias("text"))


def tiers(hits: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(tier, id, text)``: the inventory; summaries of the hits while they fit; full texts of the best while they fit.

    ``hits (id, score)`` is a bounded list; only its contexts' texts are read.
    """
    texts = contexts.join(hits, "id").select("id", "score", "content")
    l1 = within(texts.select("id", "score", summary(F.col("content")).alias("text")), TIER_TOKENS["l1"])
    best = texts.orderBy(F.desc("score"), "id").limit(DEEP_TEXTS).select("id", "score", F.col("content").alias("text"))
    l2 = within(best, TIER_TOKENS["l2"])
    named = lambda df, tier, key="id": df.select(F.lit(tier).alias("tier"), F.col(key).alias("id"), "text")
    return named(inventory(contexts).withColumn("id", F.lit(None).cast("string")), "l0").unionByName(named(l1, "l1")).unionByName(named(l2, "l2"))


def top_permitted(hits: DataFrame, grants: DataFrame, principals: list[str], limit: int) -> DataFrame:
    """The best hits that a caller may read: those without a grant, and those granted to one of their names."""
    restricted = hits.join(grants.select("id").distinct(), "id", "left_anti")
    own = hits.join(grants.where(F.col("principal").isin(principals)).select("id").distinct(), "id", "left_semi")
    return restricted.unionByName(own).orderBy(F.desc("score"), "id").limit(limit)


def grep(hits: DataFrame, chunks: DataFrame, query: str, limit: int = 10, intent: str | None = None) -> DataFrame:
    """``(chunk_id, score, snippet)``: chunks of the hits, at most CHUNKS_OF_A_CONTEXT each, weighted by their scale."""
    found = chunks.join(hits.select(F.col("id").alias("context_id"), "score"), "context_id")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("context_id").orderBy("idx", "scale"))).where(F.col("r") <= CHUNKS_OF_A_CONTEXT)
    if intent is not None:
        found = found.where(F.col("intent") == intent)
    weight = F.lit(0.85)
    for scale, w in SCALE_WEIGHTS.items():
        weight = F.when(F.col("scale") == scale, w).otherwise(weight)
    scored = found.select("chunk_id", F.round(F.col("score") * weight, 6).alias("score"), snippet(F.col("text"), query).alias("snippet"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(limit)


def composite_similarity(a: str, b: str) -> Column:
    """Similarity of the feature structs ``a`` and ``b`` (embedding, entities, intent, node_id, node_ancestors), 0 to 1.

    Parts that either side lacks don't count; the weights of the others are
    scaled to 1.  Without any part it is 0.
    """
    x, y = F.col(a), F.col(b)
    given = lambda name: F.coalesce((F.size(x[name]) > 0) & (F.size(y[name]) > 0), F.lit(False))
    both = lambda name: x[name].isNotNull() & y[name].isNotNull()
    union = F.size(F.array_union(x["entities"], y["entities"]))
    same_size = F.size(x["embedding"]) == F.size(y["embedding"])
    lengths = lambda v: F.exists(v["embedding"], lambda e: e != 0)
    parts = {
        "cosine": (given("embedding"), F.when(same_size & lengths(x) & lengths(y), (cosine(x["embedding"], y["embedding"]) + 1) / 2).otherwise(0.0)),
        "entities": (given("entities"), F.size(F.array_intersect(x["entities"], y["entities"])) / union),
        "intent": (both("intent"), (x["intent"] == y["intent"]).cast("double")),
        "node": (both("node_id"), F.when(x["node_id"] == y["node_id"], 1.0).when(F.coalesce(F.arrays_overlap(x["node_ancestors"], y["node_ancestors"]), F.lit(False)), 0.5).otherwise(0.0)),
    }
    score = sum((F.when(present, w * value).otherwise(0.0) for (present, value), w in zip(parts.values(), PART_WEIGHTS.values(), strict=True)), F.lit(0.0))
    total = sum((F.when(present, w).otherwise(0.0) for (present, _), w in zip(parts.values(), PART_WEIGHTS.values(), strict=True)), F.lit(0.0))
    return F.when(total > 0, score / total).otherwise(0.0)
