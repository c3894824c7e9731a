"""Search over a written index: postings by term or stem, read only for the terms of a query."""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions.durable import checkpointed, table_folder
from mnemoframe.functions.stemming import stemmed
from mnemoframe.functions.text import SIGNS, folded, terms
from mnemoframe.operators.retrieval import B, K1

#: Folders that postings are dealt to by a hash of their term: a query reads those of its terms only.
BUCKETS = 32

#: Postings that a task makes at a time (those of one text more at most).
POSTINGS = 100_000


@dataclass
class TextIndex:
    """A written index: ``postings`` has ``(bucket, term, id, tf, size)``; ``facts`` one row ``(n, mean)`` of all documents."""

    postings: DataFrame
    facts: DataFrame
    stems: bool


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, size, term, tf)`` of folded texts ``(id, text)``, some rows at a time."""
    sign_runs = re.compile(f"[{SIGNS}]+")
    for batch in batches:
        ids, texts = batch.columns
        places, sizes, found, counts = [], [], [], []
        for place, text in enumerate(texts):
            tfs = Counter(sign_runs.findall(text.as_py() or ""))
            places += [place] * len(tfs)
            sizes += [tfs.total()] * len(tfs)
            found += tfs
            counts += tfs.values()
            if len(found) >= POSTINGS or place == batch.num_rows - 1:
                columns = [ids.take(pa.array(places, pa.int64())), pa.array(sizes, pa.int32()), pa.array(found, pa.string()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "size", "term", "tf"])
                places, sizes, found, counts = [], [], [], []


def build_index(docs: DataFrame, id_column: str = "id", text_column: str = "content", stems: bool = False, folder: str | None = None) -> TextIndex:
    """Split all texts once and write their postings to ``folder`` (one of its own in the shared folder if it is None).

    A row's terms are counted where it is read; counts are only gathered if some id repeats.
    With ``stems`` terms are brought to their stems, each distinct term once.
    A bucket with a term that all documents hold is split over several tasks
    by its size; files are sorted by term, so that a read of few terms skips
    most of a bucket too.  Null and empty texts have no postings and count among the
    documents with size 0.  Rows that repeat an id add up.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    found = docs.select(F.col(id_column).alias("id"), folded(F.col(text_column)).alias("text")).mapInArrow(_postings, f"id {kind}, size int, term string, tf long")
    if docs.groupBy(id_column).count().where("count > 1").limit(1).count():
        found = found.groupBy("id", "size", "term").agg(F.sum("tf").alias("tf"))
    if stems:
        found = checkpointed(found)
        by_term = stemmed(found.select("term").distinct())
        found = found.join(by_term, "term").groupBy("id", "size", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    folder = folder or table_folder(docs.sparkSession)
    dealt = found.withColumn("bucket", _bucket("term")).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term")
    dealt.select("bucket", "term", "id", "tf", "size").write.partitionBy("bucket").parquet(folder)
    shape = f"term string, id {kind}, tf long, size int, bucket int"
    postings = docs.sparkSession.read.schema(shape).parquet(folder)
    sizes = postings.agg(F.sum("tf").alias("total"))
    facts = checkpointed(docs.agg(F.count("*").alias("n")).crossJoin(sizes).selectExpr("n", "coalesce(total, 0) / nullif(n, 0) AS mean"))
    return TextIndex(postings, facts, stems)


def query_terms(spark: SparkSession, text: str | None, stems: bool = False) -> list[str]:
    """The distinct terms of a query, without its operator signs; stems if the index holds them."""
    row = spark.range(1).select(F.explode(F.array_distinct(terms(F.translate(F.lit(text), '"*^()', "     ")))).alias("term"))
    return sorted({r[0] for r in (stemmed(row).select("stem") if stems else row).collect()})


def matches(index: TextIndex, text: str | None) -> DataFrame:
    """``(id, bm25)`` of the documents that hold every term of the query; none for a query without terms.

    Only the postings of the query's terms are read.  The inverse document
    frequency is floored at a small positive value.
    """
    spark = index.postings.sparkSession
    wanted = query_terms(spark, text, index.stems)
    if not wanted:
        return index.postings.where("false").select("id", F.lit(0.0).alias("bm25"))
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in wanted], "term string").select(_bucket("term")).distinct().collect()]
    rows = index.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))
    # One row for each term of the query.
    frequent = rows.groupBy("term").agg(F.count("*").alias("df"))
    scored = rows.join(F.broadcast(frequent), "term").crossJoin(F.broadcast(index.facts))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return scored.groupBy("id").agg(F.sum(score).alias("bm25"), F.count("*").alias("terms")).where(F.col("terms") == len(wanted)).select("id", "bm25")


def search_memories(memories: DataFrame, index: TextIndex, text: str | None, audience: str | None = None, include_old: bool = False, include_forgotten: bool = False, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Memories that match a query by stems, best first: ``(id, bm25)``.

    Scores come from the whole index, whatever the filters: ``audience``, only
    latest versions unless ``include_old``, no forgotten ones unless
    ``include_forgotten`` (where the table has ``is_forgotten``).  A blank
    query lists all memories of the filters with a null score.  Ties go by id.
    """
    kept = memories
    if audience is not None:
        kept = kept.where(F.col("audience") == audience)
    if not include_old:
        kept = kept.where("is_latest")
    if not include_forgotten and "is_forgotten" in memories.columns:
        kept = kept.where("NOT is_forgotten")
    if query_terms(memories.sparkSession, text):
        found = kept.select("id").join(matches(index, text), "id")
    else:
        found = kept.select("id", F.lit(None).cast("double").alias("bm25"))
    found = found.orderBy(F.desc("bm25"), "id")
    return found.offset(offset).limit(limit) if limit is not None else found.offset(offset)
