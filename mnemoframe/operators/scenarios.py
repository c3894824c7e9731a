"""What-if scenarios: texts become changes of the graph, and the changed graph is held against the present one."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.durable import checkpointed
from mnemoframe.functions.text import ascii_borders
from mnemoframe.operators.graph import impact_scores

# Kinds of change and their patterns, in order of precedence, and capitalised words that are no names.
CHANGES = [
    ("entity_removal", r"\bleav(e|es|ing)\b|\bdeparture\b|\bwithout\b|\bfire[sd]?\b|\bremove[sd]?\b"),
    ("node_cancellation", r"\bcancel\b|\bshut down\b|\bdrop\b|\bend\b|\bkill\b|\bclose\b|\bdissolve\b"),
    ("revenue_change", r"\brevenue\b|\bmoney\b|\bdrop[s]?\b|\blose\b|\bcut\b|\bincome\b"),
    ("dependency_break", r"\bstops?\b|\bno longer\b|\bpull[s]? out\b|\bbreaks?\b"),
]
QUESTION_WORDS = "What If We Cancel Agency The A An Is Are Was Were How Why When Where Who Which".split()
RECOMMENDED, TOP_NODES = 5, 3


def parse(scenarios: DataFrame, aliases: DataFrame, revenue_node: str) -> DataFrame:
    """``(id, change, entity, node)`` of each scenario ``(id, text)``.

    ``entity`` joins the capitalised words that aren't question words; ``node``
    is that of the first of ``aliases (alias, node)``, in order of alias, that
    the text holds; both only where the kind of change asks for them.  The
    aliases are a short table: they meet the texts as one row.  A null text is
    empty.
    """
    text = F.coalesce("text", F.lit(""))
    lower = F.lower(text)
    kind: Column | None = None
    for name, pattern in CHANGES:
        hit = lower.rlike(ascii_borders(pattern))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    words = F.filter(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, "[^A-Za-z']", "").rlike("^[A-Z].") & ~F.regexp_replace(w, "[^A-Za-z']", "").isin(QUESTION_WORDS))
    entity = F.nullif(F.array_join(F.transform(words, lambda w: F.regexp_replace(w, "[^A-Za-z' ]", "")), " "), F.lit(""))
    listed = aliases.agg(F.array_sort(F.collect_list(F.struct("alias", "node"))).alias("aliases"))
    rows = scenarios.crossJoin(F.broadcast(listed)).select("id", kind.otherwise("general").alias("change"), entity.alias("entity"), F.try_element_at(F.filter("aliases", lambda a: F.contains(lower, a["alias"])), F.lit(1)).getField("node").alias("node"))
    named, placed = F.col("change").isin("entity_removal", "dependency_break", "general"), F.col("change").isin("node_cancellation", "dependency_break", "general")
    node = F.when(F.col("change") == "revenue_change", revenue_node).when(placed, F.col("node"))
    return rows.select("id", "change", F.when(named, F.col("entity")).alias("entity"), node.alias("node"))


def lost_edges(edges: DataFrame, homes: DataFrame, change: str, entity: str | None = None, node: str | None = None) -> DataFrame:
    """The edges that a change takes away.

    Removal of an entity takes its edges; cancellation of a node those of the
    node and of the contexts that live in it; a broken dependency those that
    join the entity with the node or its contexts; other changes none.
    ``homes`` has ``(id, node)``.
    """
    at = lambda name: (F.col("source_id") == name) | (F.col("target_id") == name)
    if change == "entity_removal" and entity:
        return edges.where(at(entity))
    if node and change in ("node_cancellation", "dependency_break") and (entity or change == "node_cancellation"):
        own = homes.where(F.col("node") == node).select("id").union(homes.sparkSession.createDataFrame([(node,)], "id string")).distinct()
        if change == "dependency_break":
            edges = edges.where(at(entity))
        touched = [edges.join(own.withColumnRenamed("id", c), c, "left_semi") for c in ("source_id", "target_id")]
        return touched[0].unionByName(touched[1]).distinct()
    return edges.where("false")


def what_if(edges: DataFrame, homes: DataFrame, change: str, entity: str | None = None, node: str | None = None, depth: int = 3) -> DataFrame:
    """``(node, score, edges_before, edges_after)`` of each home node that a change reaches.

    The change takes edges away; their ends are where its impact starts, over
    the present graph.  A node's score sums those of its contexts; edges are
    those that touch its contexts, before and after.
    """
    lost = checkpointed(lost_edges(edges, homes, change, entity, node))
    seeds = lost.select(F.col("source_id").alias("node")).unionByName(lost.select(F.col("target_id").alias("node"))).distinct()
    scores = impact_scores(edges, seeds, depth).select(F.col("node").alias("id"), "score")
    homes = homes.where("node IS NOT NULL").select("id", "node").distinct()
    by_node = scores.join(homes, "id").groupBy("node").agg(F.round(F.sum("score"), 3).alias("score"))

    def touching(some: DataFrame, name: str) -> DataFrame:
        own = some.withColumn("edge", F.xxhash64("source_id", "target_id", "relation"))
        ends = own.select("edge", F.col("source_id").alias("id")).unionByName(own.select("edge", F.col("target_id").alias("id")))
        return ends.join(homes, "id").select("edge", "node").distinct().groupBy("node").agg(F.count("*").alias(name))

    before, gone = touching(edges, "before"), touching(lost, "gone")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    reached = by_node.join(gone.select("node"), "node", "full_outer").join(before, "node", "left").join(gone, "node", "left")
    return reached.select("node", F.coalesce("score", F.lit(0.0)).alias("score"), n("before").alias("edges_before"), (n("before") - n("gone")).alias("edges_after"))


def recommendations(parsed: DataFrame, scores: DataFrame) -> DataFrame:
    """``(id, place, text)``: up to RECOMMENDED recommendations for each parsed scenario.

    ``scores`` has ``(id, node, score)`` of the nodes that each scenario
    reaches; its TOP_NODES best by score, ties by name, are named.
    """
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "node"))), 1, TOP_NODES)
    best = scores.join(parsed.select("id", "change", F.col("node").alias("own")), "id")
    best = best.where(~F.coalesce((F.col("change") == "node_cancellation") & (F.col("node") == F.col("own")), F.lit(False)))
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "node"))).where(F.col("r") <= TOP_NODES)
    tops = ranked.groupBy("id").agg(F.transform(first, lambda x: x["node"]).alias("top"))
    rows = parsed.join(tops, "id", "left").withColumn("top", F.coalesce("top", F.array().cast("array<string>")))
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    each = lambda *parts: F.transform("top", lambda n: put(*(n if p is None else p for p in parts)))
    e, n = F.col("entity"), F.col("node")
    subject = F.coalesce(e, n, F.lit("this change"))
    general = F.concat(F.array(put("Audit all affected contexts for dependencies on ", subject)), each("Review ", None, " node for exposure to ", subject), F.array(F.lit("Update signal files in affected nodes to reflect new state")))
    texts = (
        F.when((F.col("change") == "entity_removal") & e.isNotNull(), F.concat(F.array(put("Document ", e, "'s responsibilities and handoff all active work before departure")), each("Review ", None, " for contexts dependent on ", e, " and assign a replacement owner"), F.array(put("Export ", e, "'s key decisions and context patterns to a reference document"))))
        .when((F.col("change") == "node_cancellation") & n.isNotNull(), F.concat(F.array(put("Archive all ", n, " contexts to prevent knowledge loss"), put("Notify all stakeholders with active contexts in ", n), put("Migrate cross-referenced signals from ", n, " to relevant active nodes")), each("Update ", None, " contexts that reference ", n, " to reflect the cancellation")))
        .when(F.col("change") == "revenue_change", F.concat(F.array(put("Immediately update ", n, " context with revised projections"), F.lit("Audit all active revenue pipelines and re-prioritize based on new reality")), each("Reassess ", None, " budget and resource allocation in light of revenue change")))
        .when(F.col("change") == "dependency_break", F.filter(F.concat(F.array(put("Identify replacement for ", e, "'s role"), put("Review dependency on ", n, " and identify fallback paths"), F.lit("Map all contexts that will break and prioritize remediation")), each("Audit ", None, " for broken dependencies")), lambda t: t.isNotNull()))
        .otherwise(general)
    )
    return rows.select("id", F.posexplode(F.slice(texts, 1, RECOMMENDED)).alias("place", "text"))
