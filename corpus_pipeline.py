"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import decontam, langid, neardup, packing, quality
from mnemoframe.llm.durable import ensure_checkpoint_dir
from mnemoframe.llm.queries import TOKENIZER

#: A document has a language if that language has more than this share of the probability over its positions.
MAJORITY = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps.  Null and empty texts, and texts without a token, go; copies of a row stay or go together."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of one language, which fills ``lang`` where that is null.

    Texts without a letter (and null ones) go, and those in which no language
    has the MAJORITY, such as mixtures and noise.  Where nothing is labelled
    there is no language to tell: documents with a letter stay as they are.
    """
    network = langid.learnt(docs, F.col("lang").isNotNull())
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = {c: f"own_{c}" for c in docs.columns if c in ("lang_pred", "score")}
    found = langid.identify(docs.withColumnsRenamed(own), network)
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") > MAJORITY))
    kept = kept.withColumn("lang", F.coalesce(F.col("lang").cast("string"), "lang_pred")).drop("lang_pred", "score")
    return kept.withColumnsRenamed({new: old for old, new in own.items()})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more.

    The smallest id stays; rows without an id or a word all stay.
    """
    return neardup.one_per_group(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.  Null and empty texts hold none; null and empty items are left out."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens.  A null text is empty; copies of a row are each packed."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models and a tokenizer have no form in SQL; tests/llm hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents.  Each stage's result is written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
