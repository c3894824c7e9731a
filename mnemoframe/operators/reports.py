"""Counts, joins and lists over the store's relations that its reports and pages are made of."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``(name, n)``: how often each value occurs; null is a value."""
    return rows.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def confident(rows: DataFrame, keys: list[str], confidence: Column, least: float) -> DataFrame:
    """``(*keys, confidence, n)`` of the groups whose confidence adds up to ``least``, rounded to six places."""
    total = rows.groupBy(*keys).agg(F.round(F.sum(confidence), 6).alias("confidence"), F.count("*").alias("n"))
    return total.where(F.col("confidence") >= least)


def histogram(rows: DataFrame, key: str, value: str, width: float, buckets: int) -> DataFrame:
    """``(key, bucket, n)``: buckets of ``width`` from 0; the last of ``buckets`` takes all that is larger."""
    bucket = F.least(F.floor(F.col(value) / width), F.lit(buckets - 1)).cast("long")
    return rows.groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def window_stats(rows: DataFrame, key: str, order: str, size: int, duration: str, success: Column) -> DataFrame:
    """``(key, win, n, duration, success)``: each key's rows in windows of ``size``, with whole mean duration and share of successes.

    Durations are added up by ``order``: the floor of a mean that is nearly
    whole would else change with the order in which partial sums meet.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    windowed = rows.withColumn("win", F.floor((place - 1) / size).cast("int")).withColumn("_place", place)
    listed = F.array_sort(F.collect_list(F.when(F.col(duration).isNotNull(), F.struct("_place", F.col(duration).cast("double").alias("value")))))
    grouped = windowed.groupBy(key, "win").agg(F.count("*").alias("n"), listed.alias("_listed"), F.round(F.avg(success.cast("int")), 4).alias("success"))
    mean = F.when(F.size("_listed") > 0, F.aggregate("_listed", F.lit(0.0), lambda total, x: total + x["value"]) / F.size("_listed"))
    return grouped.select(key, "win", "n", F.floor(mean).alias("duration"), "success")


def version_counts(memories: DataFrame, pages: DataFrame) -> DataFrame:
    """``(kind, n, latest)``: rows and latest versions of memories and of wiki pages."""
    one = memories.agg(F.lit("memories").alias("kind"), F.count("*").alias("n"), F.count_if("is_latest").alias("latest"))
    return one.unionByName(pages.agg(F.lit("wiki").alias("kind"), F.count("*").alias("n"), F.countDistinct("slug", "audience").alias("latest")))


def first_value(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """``(group, value)``: of each group with any, the first value that isn't null."""
    return rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.min_by(value, order).alias(value))


def topics(messages: DataFrame, words: Column, weight: Column, least: int, limit: int) -> DataFrame:
    """``(topic, weight)``: the heaviest words, each once a message, that weigh ``least`` or more; ties by word."""
    said = messages.select(weight.alias("weight"), F.explode(words).alias("topic"))
    return said.groupBy("topic").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= least).orderBy(F.desc("weight"), "topic").limit(limit)


def vectors_of(vectors: DataFrame, contexts: DataFrame, node: str, type: str) -> DataFrame:
    """``(id, vec_id, label)``: the vectors of a node's contexts of a type, which bear the contexts' numbers."""
    own = contexts.where((F.col("type") == type) & (F.col("node") == node)).select("id", F.col("seq").alias("vec_id"))
    return vectors.join(own, "vec_id").select("id", "vec_id", "label")


def chunk_intents(chunks: DataFrame, contexts: DataFrame, node: str) -> DataFrame:
    """``(id, chunk_id, intent)`` of the chunks of a node's contexts; ``none`` without an intent."""
    own = contexts.where(F.col("node") == node).select(F.col("id").alias("context_id"))
    return chunks.join(own, "context_id").select(F.col("context_id").alias("id"), "chunk_id", F.coalesce("intent", F.lit("none")).alias("intent"))


def broken_parents(versions: DataFrame, known: DataFrame) -> DataFrame:
    """``(id)``: versions that replace one which isn't among the ``known``."""
    return versions.where("parent_id IS NOT NULL").join(known.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id")


def cited_contexts(citations: DataFrame, chunks: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(slug, id, node)``: the contexts whose chunks a page cites, each once."""
    cited = citations.join(chunks.select("chunk_id", F.col("context_id").alias("id")), "chunk_id")
    return cited.join(contexts.select("id", "node"), "id").select("slug", "id", "node").distinct()


def citing_pages(chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """``(chunk_id, intent, pages)``: how many citations each chunk has."""
    n = citations.groupBy("chunk_id").agg(F.count("*").alias("pages"))
    return chunks.join(n, "chunk_id", "left").select("chunk_id", "intent", F.coalesce("pages", F.lit(0)).alias("pages"))


def active_holds(holds: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(principal, held)``: how many contexts each principal's unreleased holds keep."""
    own = holds.where("released_at IS NULL").join(contexts.select(F.col("id").alias("context_id")), "context_id")
    return own.groupBy("principal").agg(F.count("*").alias("held"))


def held(contexts: DataFrame, holds: DataFrame) -> DataFrame:
    """``(id, held)``: whether an unreleased hold keeps each context."""
    kept = holds.where("released_at IS NULL").select(F.col("context_id").alias("id"), F.lit(True).alias("held")).distinct()
    return contexts.select("id").join(kept, "id", "left").select("id", F.coalesce("held", F.lit(False)).alias("held"))


def last_curated(pages: DataFrame) -> DataFrame:
    """``(slug, curated_at)`` of each page."""
    return pages.groupBy("slug").agg(F.max("curated_at").alias("curated_at"))


def stale_pages(pages: DataFrame, citations: DataFrame, chunks: DataFrame, contexts: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """``(slug)``: pages curated more than ``days`` ago that cite a node in which something was modified since."""
    old = last_curated(pages).where(F.col("curated_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))
    nodes = cited_contexts(citations, chunks, contexts).select("slug", "node").distinct()
    latest = contexts.groupBy("node").agg(F.max("modified_at").alias("latest"))
    return old.join(nodes, "slug").join(latest, "node").where("latest > curated_at").select("slug").distinct()


def uncurated_citations(pages: DataFrame, citations: DataFrame) -> DataFrame:
    """``(slug, chunk_id)``: citations that are newer than their page's last curation."""
    return citations.join(last_curated(pages), "slug").where("cited_at > curated_at").select("slug", "chunk_id")


def recent(contexts: DataFrame, type: str, as_of: str, days: int, limit: int) -> DataFrame:
    """``(id, modified_at)``: the newest contexts of a type in the last days; ties by id."""
    young = contexts.where((F.col("type") == type) & (F.col("modified_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))))
    return young.select("id", "modified_at").orderBy(F.desc("modified_at"), "id").limit(limit)


def seeds(mentions: DataFrame, contexts: DataFrame, like: str | None, node: str | None, limit: int = 50) -> DataFrame:
    """``(id)``: contexts that mention a name like ``like``, and those of a node, the first by id."""
    named = mentions.where(F.contains("name", F.lit(like)) if like else F.lit(False)).select(F.col("context_id").alias("id"))
    return named.unionByName(contexts.where(F.col("node") == node if node else F.lit(False)).select("id")).distinct().orderBy("id").limit(limit)


def affected(mentions: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """``(name, n)``: the names most often mentioned in the contexts of a name; ties by name."""
    own = mentions.where(F.col("name") == name).select("context_id").distinct()
    beside = mentions.join(own, "context_id", "left_semi").where(F.col("name") != name)
    return beside.groupBy("name").agg(F.countDistinct("context_id").alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def workspaces_of(members: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``(workspace, principal)`` of ``members (principal, workspace_id)`` in ``workspaces (workspace_id, workspace)``."""
    return members.join(workspaces, "workspace_id").select("workspace", "principal")


def profile(contexts: DataFrame, pages: DataFrame, mentions: DataFrame, audience, recent_limit: int = 20, entity_limit: int = 15, characters: int | None = None) -> DataFrame:
    """``(tier, place, item, text)``: a workspace's profile in four tiers.

    ``static``: each node's first context; ``dynamic``: its newest signal;
    ``curated``: the latest version of each page for the audience; ``activity``:
    the newest contexts; ``entities``: the names of most contexts.  Texts are
    cut to ``characters`` if given.  Ties go by id, slug or name.
    """
    cut = lambda c: F.col(c) if characters is None else F.substring(c, 1, characters)
    tier = lambda rows, name, order, item, text: rows.select(F.lit(name).alias("tier"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), F.col(item).cast("string").alias("item"), text.alias("text"))
    by_node = contexts.where("node IS NOT NULL").groupBy("node")
    first = by_node.agg(F.min_by("content", F.struct("modified_at", "id")).alias("text"))
    newest = contexts.where("node IS NOT NULL AND type = 'signal'").groupBy("node").agg(F.max_by("content", F.struct("modified_at", "id")).alias("text"))
    latest = pages.where(F.col("audience") == audience).groupBy("slug").agg(F.max_by("body", "version").alias("text"))
    active = contexts.select("id", "title", "modified_at").orderBy(F.desc("modified_at"), "id").limit(recent_limit)
    named = mentions.groupBy("name").agg(F.countDistinct("context_id").alias("n")).orderBy(F.desc("n"), "name").limit(entity_limit)
    parts = [
        tier(first, "static", ["node"], "node", cut("text")), tier(newest, "dynamic", ["node"], "node", cut("text")), tier(latest, "curated", ["slug"], "slug", cut("text")),
        tier(active, "activity", [F.desc("modified_at"), "id"], "id", F.col("title")), tier(named, "entities", [F.desc("n"), "name"], "name", F.col("n").cast("string")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
