"""Quad store operators: pattern scans, idempotent assertion, retraction, statistics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["g", "s", "p", "o"]


def scan(quads: DataFrame, graph: str | None = None, subject: str | None = None, predicate: str | None = None, object: str | None = None) -> DataFrame:
    """Triples that match the bound positions, with one row for each graph that holds them."""
    for column, value in zip(KEYS, (graph, subject, predicate, object), strict=True):
        if value is not None:
            quads = quads.where(F.col(column) == value)
    return quads.select("s", "p", "o")


def assert_quads(quads: DataFrame, new: DataFrame) -> DataFrame:
    """The set of old and new quads."""
    return quads.select(KEYS).unionByName(new.select(KEYS)).dropDuplicates(KEYS)


def retract(quads: DataFrame, gone: DataFrame) -> DataFrame:
    """Quads that are not among ``gone``."""
    return quads.join(gone, KEYS, "left_anti")


def exists(quads: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """One row that says whether a triple is in any graph."""
    return scan(quads, None, s, p, o).limit(1).agg((F.count("*") > 0).alias("found"))


def statistics(triples: DataFrame) -> DataFrame:
    """Triples, distinct subjects and distinct objects, overall (null predicate) and by predicate."""
    parts = [F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects")]
    return triples.groupBy("p").agg(*parts).unionByName(triples.agg(*parts).withColumn("p", F.lit(None).cast("string")))


def agent_facts(quads: DataFrame, agent: str, most: int = 100) -> DataFrame:
    """An agent's facts: the predicate, all its objects in order, and whether they name other resources."""
    facts = quads.where(F.col("s") == agent).select("p", "o").distinct().orderBy("p", "o").limit(most)
    return facts.groupBy("p").agg(F.concat_ws(",", F.sort_array(F.collect_list("o"))).alias("objects"), F.max(F.col("o").contains("/")).alias("relates"))


def prompt_text(quads: DataFrame) -> DataFrame:
    """Each subject's facts as a text for a prompt: a headline, then a line for each fact in order."""
    facts = quads.select("s", "p", "o").distinct()
    lines = F.sort_array(F.collect_list(F.struct("p", "o")))
    text = F.concat_ws("\n", F.transform(lines, lambda x: F.concat(F.lit("- "), x["p"], F.lit(": "), x["o"])))
    return facts.groupBy("s").agg(text.alias("lines")).select("s", F.concat(F.lit("## "), "s", F.lit("\n"), "lines").alias("prompt"))
