"""Health diagnostics over contexts, edges, entities and vectors."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.operators.retrieval import bm25

# Thresholds, and words that don't count for fidelity.
STALE_DAYS, LOW_QUALITY, IMBALANCE = 30, 0.4, 3.0
STOP_WORDS = "this that with from they have been were will would could should about after before under over between through during".split()


def orphans(contexts: DataFrame, edges: DataFrame) -> DataFrame:
    """Contexts that no edge touches."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return contexts.join(ends, "id", "left_anti").select("id")


def stale(contexts: DataFrame, as_of: str, days: int = STALE_DAYS) -> DataFrame:
    limit = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return contexts.where(F.col("modified_at") < limit).select("id", "modified_at")


def missing_references(routed: DataFrame, edges: DataFrame) -> DataFrame:
    """Destinations other than a context's own node to which no edge leads, listed by context."""
    wanted = routed.where("destination <> node").select("id", "destination").distinct()
    have = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("destination"))
    return wanted.join(have, ["id", "destination"], "left_anti").groupBy("id").agg(F.concat_ws(",", F.sort_array(F.collect_set("destination"))).alias("missing"))


def imbalance(contexts: DataFrame, factor: float = IMBALANCE) -> DataFrame:
    """Nodes with more than ``factor`` times the mean number of contexts."""
    counts = contexts.groupBy("node").agg(F.count("*").alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    return counts.crossJoin(F.broadcast(mean)).where(F.col("n") > F.col("mean") * factor).select("node", "n")


def duplicate_titles(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy("node", "title").agg(F.count("*").alias("n")).where("n > 1")


def case_collisions(names: DataFrame) -> DataFrame:
    """Names that differ in case only."""
    return names.groupBy(F.lower("name").alias("folded")).agg(F.countDistinct("name").alias("n"), F.concat_ws(",", F.sort_array(F.collect_set("name"))).alias("names")).where("n > 1")


def coverage(contexts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Share of contexts with a vector in per cent, and its grade."""
    both = contexts.agg(F.count("*").alias("contexts")).crossJoin(vectors.agg(F.count("*").alias("vectors")))
    percent = F.round(F.col("vectors") * 100.0 / F.col("contexts"), 1)
    return both.select(percent.alias("percent"), F.when(percent >= 80, "ok").when(percent >= 50, "warning").otherwise("critical").alias("status"))


def quality(contexts: DataFrame) -> DataFrame:
    share = F.avg((F.col("sn_ratio") < LOW_QUALITY).cast("double"))
    return contexts.agg(F.round(share, 6).alias("low"), F.when(share <= 0.2, "ok").when(share <= 0.4, "warning").otherwise("critical").alias("status"))


def keyword_set(text: Column) -> Column:
    """Distinct words of four letters and more."""
    words = F.array_distinct(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"))
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS))


def fidelity(contexts: DataFrame, summary: str, content: str) -> DataFrame:
    """Jaccard similarity of a summary's and its content's keywords, and its grade."""
    a, b = keyword_set(F.col(summary)), keyword_set(F.col(content))
    sized = contexts.select("id", a.alias("a"), b.alias("b"))
    score = F.when((F.size("a") == 0) | (F.size("b") == 0), 0.0).otherwise(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")))
    scored = sized.select("id", F.round(score, 6).alias("score"))
    return scored.withColumn("grade", F.when(F.col("score") >= 0.8, "A").when(F.col("score") >= 0.6, "B").when(F.col("score") >= 0.4, "C").when(F.col("score") >= 0.2, "D").otherwise("F"))


def escalations(observations: DataFrame, least: int = 3, ready: float = 1.5) -> DataFrame:
    """Categories observed often enough, and whether their confidence adds up."""
    found = observations.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))
    return found.where(F.col("n") >= least).withColumn("ready", F.col("confidence") >= ready)


def reweave(contexts: DataFrame, mentions: DataFrame, question: str, entity: str, as_of: str, days: int = 30, limit: int = 10) -> DataFrame:
    """``(id, staleness)``: the stalest contexts that a search for ``question`` finds or that mention ``entity``.

    Staleness is the age in parts of ``days``, 1 at most; ties go by id.
    """
    found = bm25(contexts, question).select("id").unionByName(mentions.where(F.col("name") == entity).select(F.col("context_id").alias("id"))).distinct()
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("modified_at")) / 86400.0 / days
    scored = contexts.select("id", "modified_at").join(found, "id").select("id", F.round(F.least(age, F.lit(1.0)), 4).alias("staleness"))
    return scored.where("staleness > 0").orderBy(F.desc("staleness"), "id").limit(limit)
