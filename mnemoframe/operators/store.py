"""Store writes as set operations on tables: upserts, deletes, versions, imports, exports, payloads."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``table`` with the rows of ``new``, which replace those of equal keys.

    Columns that ``new`` lacks are null in its rows.  Null keys equal no key,
    so such rows are added; of several new rows with one key all stay, as the
    caller decides which is the last.
    """
    kept = table.join(new.select(*keys).distinct(), list(keys), "left_anti").select(table.columns)
    return kept.unionByName(new, allowMissingColumns=True).select(table.columns)


def delete(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """``table`` without the rows whose keys occur in ``gone``."""
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(table.columns)


def by_node(contexts: DataFrame, node: str, type: str | None = None) -> DataFrame:
    """A node's contexts, latest first, ties by id."""
    found = contexts.where(F.col("node") == node)
    if type is not None:
        found = found.where(F.col("type") == type)
    return found.orderBy(F.desc("modified_at"), "id")


def import_counts(existing: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """``(status, n)`` of a batch import: rows without content are errors, known or repeated keys are skipped, the rest imported."""
    bad = F.col(content).isNull() | (F.trim(content) == "") | F.col(key).isNull()
    marked = incoming.select(F.col(key).alias("k"), bad.alias("bad"))
    grouped = marked.groupBy("k", "bad").agg(F.count("*").alias("n"))
    known = existing.select(F.col(key).alias("k")).distinct().withColumn("known", F.lit(True))
    seen = grouped.join(known, "k", "left")
    fresh = ~F.col("bad") & F.col("known").isNull()
    return seen.agg(
        F.coalesce(F.sum(fresh.cast("long")), F.lit(0)).alias("imported"),
        F.coalesce(F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n") - fresh.cast("long"))), F.lit(0)).alias("skipped"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)), F.lit(0)).alias("errors"),
    )


def exported(table: DataFrame, kind: str) -> DataFrame:
    """A row of JSON for each row, as a batch export writes it."""
    return table.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*table.columns)).alias("line"))


def payload_signals(payloads: DataFrame, kind: str) -> DataFrame:
    """Signals of a connector's payloads ``(external_id, title, html, created, url)``.

    The id is the head of a hash of kind and external id, so a repeated sync
    gives the same one; markup is dropped; an unreadable time is null.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\r]+", " "))
    return payloads.select(
        F.substring(F.sha2(F.concat(F.lit(f"{kind}:"), F.col("external_id").cast("string")), 256), 1, 16).alias("id"),
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        text.alias("content"),
        F.try_to_timestamp("created").alias("time"),
        F.coalesce("url", F.concat(F.lit(f"{kind}://"), F.col("external_id").cast("string"))).alias("source_uri"),
    )


def updated(memories: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories after ``changes (id, content)``, and the new ``updates`` relations.

    Each change makes the next version of its memory, the latest from now on;
    the old row stays but is no more the latest.  Changes to unknown ids do
    nothing.  A new version's id is its parent's with the version appended.
    """
    old = memories.join(changes.select("id", F.col("content").alias("_content")), "id")
    new_id = F.concat("id", F.lit("-v"), F.col("version") + 1)
    new = old.select(*(c for c in memories.columns if c not in ("id", "content", "version", "parent_id", "is_latest")), new_id.alias("_id"), F.col("_content").alias("content"), (F.col("version") + 1).alias("version"), F.col("id").alias("parent_id"), F.lit(True).alias("is_latest"))
    new = new.withColumnRenamed("_id", "id")
    touched = changes.select("id").distinct().withColumn("_touched", F.lit(True))
    kept = memories.join(touched, "id", "left").withColumn("is_latest", F.col("is_latest") & F.col("_touched").isNull()).drop("_touched")
    relations = new.select(F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit("updates").alias("relation"))
    return kept.unionByName(new), relations


def derived(memories: DataFrame, children: DataFrame, relation: str) -> tuple[DataFrame, DataFrame]:
    """Memories with ``children (parent_id, content)`` beside their sources, which stay the latest; and the typed relations."""
    source = memories.withColumnRenamed("id", "_source").drop("content", "version", "parent_id", "is_latest")
    made = source.join(children.select(F.col("parent_id").alias("_source"), "content"), "_source")
    new = made.withColumns({"id": F.concat("_source", F.lit(f"-{relation}")), "version": F.lit(1).cast(memories.schema["version"].dataType), "parent_id": F.col("_source"), "is_latest": F.lit(True)}).select(memories.columns)
    return memories.unionByName(new), new.select(F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit(relation).alias("relation"))


def forgotten(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Memories with a mark on those that are softly forgotten; nothing else of a row changes."""
    marks = ids.select("id", "reason").dropDuplicates(["id"]).withColumn("is_forgotten", F.lit(True))
    return memories.join(marks, "id", "left").withColumn("is_forgotten", F.coalesce("is_forgotten", F.lit(False)))


def cascade(tables: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """``(section, n)``: rows of each table that hang on the ids in its column ``owner``, as an erasure would delete them."""
    wanted = ids.select(F.col("id").alias("owner")).distinct()
    parts = [t.join(wanted, "owner", "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n") for name, t in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def sampled(rows: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """``n`` rows drawn by a seeded hash of their key: the same for a seed wherever and however the table lies.

    Equal keys go by the whole row.  No more than ``n`` rows of a task are
    sorted together.
    """
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def collection_to_json(rows: DataFrame, collection: str = "collection", key: str = "key") -> DataFrame:
    """``(collection, key, json)``: each entry of a key-value store as a line of JSON, all its columns by name."""
    return rows.select(collection, key, F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns)))).alias("json"))


def collection_from_json(lines: DataFrame, schema: str, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """Entries of ``schema`` from lines of JSON, and the lines that don't hold one."""
    read = lines.select(json, F.from_json(json, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("_e"))
    wrong = F.col("_e").isNull() | F.col("_e._bad").isNotNull()
    return read.where(~wrong).select("_e.*").drop("_bad"), read.where(wrong).select(json)
