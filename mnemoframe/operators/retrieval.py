"""Hybrid retrieval: BM25, time decay, vector search, blending, rank fusion, budgets."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.durable import checkpointed
from mnemoframe.functions.text import slug, terms, token_estimate

K1, B = 1.2, 0.75
HALF_LIFE_HOURS, UNDATED_DECAY = 720.0, 0.5
BLEND, RRF_K, ITEM_OVERHEAD = 0.6, 60, 64


def _occurrences(array: str, word: str) -> Column:
    return F.size(array) - F.size(F.array_remove(array, word))


def bm25(docs: DataFrame, text: str, id_column: str = "id", text_column: str = "content") -> DataFrame:
    """``(id, bm25)`` of the documents that hold every term of the query.

    For one query over texts without an index: texts are split once, and only
    counts of the query's terms are written, from which corpus facts and hits
    follow.  For many queries ``textindex`` splits texts once for all.  The
    inverse document frequency is floored at a small positive value.
    """
    wanted = [r[0] for r in docs.sparkSession.range(1).select(F.explode(F.array_distinct(terms(F.lit(text))))).collect()]
    counted = docs.select(F.col(id_column).alias("id"), terms(F.col(text_column)).alias("terms"))
    tfs = [_occurrences("terms", w).cast("double").alias(f"tf{i}") for i, w in enumerate(wanted)]
    counted = checkpointed(counted.select("id", F.size("terms").alias("size"), *tfs))
    facts = counted.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(wanted))))
    hits = counted
    for i in range(len(wanted)):
        hits = hits.where(F.col(f"tf{i}") > 0)
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return hits.crossJoin(F.broadcast(facts)).select("id", score.alias("bm25"))


def decay(modified_at: Column, as_of: str, half_life_hours: float = HALF_LIFE_HOURS) -> Column:
    """Halves with each half-life of age; a half where there is no time."""
    hours = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(modified_at)) / 3600.0
    return F.coalesce(F.exp(F.lit(-math.log(2) / half_life_hours) * hours), F.lit(UNDATED_DECAY))


def search(contexts: DataFrame, text: str, as_of: str, limit: int | None = 10) -> DataFrame:
    """Contexts by BM25 times decay times quality, best first; all of them without a limit."""
    scored = bm25(contexts, text).join(contexts.select("id", "sn_ratio", "modified_at"), "id")
    score = F.round(F.col("bm25") * decay(F.col("modified_at"), as_of) * (0.5 + 0.5 * F.col("sn_ratio")), 4)
    scored = scored.select("id", score.alias("score"))
    return scored if limit is None else scored.orderBy(F.desc("score"), "id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = total(F.zip_with(wide(a), wide(b), lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(wide(a), lambda x: x * x))) * F.sqrt(total(F.transform(wide(b), lambda x: x * x)))
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def nearest(vectors: DataFrame, to: DataFrame, least: float = 0.1, limit: int = 10) -> DataFrame:
    """The vectors most similar to the one row of ``to``."""
    scored = vectors.crossJoin(F.broadcast(to.select(F.col("embedding").alias("_to")).limit(1)))
    scored = scored.select("vec_id", F.round(cosine(F.col("embedding"), F.col("_to")), 6).alias("similarity"))
    return scored.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "vec_id").limit(limit)


def blend(text_scores: DataFrame, vector_scores: DataFrame, alpha: float = BLEND) -> DataFrame:
    """``alpha`` times the text score over its maximum plus the rest of the cosine, over the union of ids."""
    text_scores = checkpointed(text_scores)
    largest = text_scores.agg(F.max("score").alias("most"))
    both = text_scores.join(vector_scores, "id", "full_outer").crossJoin(F.broadcast(largest))
    text_part = F.when(F.col("most") > 0, F.coalesce("score", F.lit(0.0)) / F.col("most")).otherwise(0.0)
    return both.select("id", F.round(alpha * text_part + (1 - alpha) * F.coalesce("similarity", F.lit(0.0)), 6).alias("score"))


def fuse_ranks(*ranked: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of bounded ``(id, score)`` lists; ranks start at 1, ties go by id."""
    total = None
    for part in ranked:
        places = part.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))
        total = places if total is None else total.unionByName(places)
    return total.groupBy("id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score"))


def within_budget(items: DataFrame, budget: int) -> DataFrame:
    """``(id, kept)`` of a bounded result list: items in order of score are kept while they fit; one that doesn't is skipped."""

    def plan(pdf):
        left, kept = budget, []
        for cost in pdf["cost"]:
            fits = cost <= left
            left -= cost if fits else 0
            kept.append(fits)
        return pdf.assign(kept=kept)[["id", "cost", "kept"]]

    costed = items.select("id", "score", (token_estimate(F.col("content")) + ITEM_OVERHEAD).cast("long").alias("cost"))
    return costed.withColumn("list", F.lit("")).groupBy("list").applyInPandas(lambda pdf: plan(pdf.sort_values(["score", "id"], ascending=[False, True])), "id string, cost long, kept boolean")


def truncated(text: Column, tokens: int) -> Column:
    return F.when(F.length(text) > tokens * 4, F.concat(F.substring(text, 1, tokens * 4), F.lit("…"))).otherwise(text)


def snippet(text: Column, query: str, size: int = 200) -> Column:
    """A window around the first query term (in the query's order) that occurs, or the text's head; null if blank."""
    lower, places = F.lower(text), []
    for term in (t for t in query.lower().split() if len(t) >= 2):
        at = F.locate(term, lower)
        places.append(F.when(at > 0, at))
    at = F.coalesce(*places, F.lit(1)) if places else F.lit(1)
    window = F.trim(text.substr(F.greatest(at - size // 4, F.lit(1)), F.lit(size)))
    return F.when(window != "", window)


def page_score(slug_column: Column, title: Column, query: str) -> Column:
    """How well a page's slug and title match a question: exact, prefix or contained."""
    wanted = slug(F.lit(query))
    long_enough = (F.length(slug_column) >= 4) & (F.length(wanted) >= 4)
    by_slug = F.when(slug_column == wanted, 100).when(slug_column.startswith(wanted) | F.startswith(wanted, slug_column), 50).when(long_enough & (F.contains(slug_column, wanted) | F.contains(wanted, slug_column)), 10).otherwise(0)
    by_title = F.when(F.lower(title) == query.lower(), 40).when(F.contains(F.lower(title), F.lit(query.lower())), 10).otherwise(0)
    return by_slug + by_title


def ranked_pages(pages: DataFrame, query: str, id_column: str = "id", limit: int = 5) -> DataFrame:
    """``(id, score)``: the pages ``(id, slug, title)`` that match a question best by ``page_score``, ties by id."""
    scored = pages.select(id_column, page_score(F.col("slug"), F.col("title"), query).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), id_column).limit(limit)
