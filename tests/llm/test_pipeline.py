"""The pipeline's stages: each one's decisions, columns, and awkward input."""

import pyspark.sql.functions as F

import corpus_pipeline
from mnemoframe.llm import decontam
from tests.llm.fixtures import documents, nothing
from tests.llm.test_neardup import brute


def folder_with(spark, tmp_path, docs):
    folder = str(tmp_path / "tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (12, 1, 0), (15, 1, 0), (16, 0, 0), (17, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "straße 中文字符")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, small)
        assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.collect()}
        assert kept <= ids
        if name == "near_dedup":
            wanted = brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert kept == {i for i, (_, root) in wanted.items() if root == i}
        if name == "benchmark_decontamination":
            items = [decontam.normalised(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            assert not any(item in decontam.normalised(r["text"]) for r in docs.collect() for item in items if item)
        assert len(kept) > 0.4 * len(ids)
        ids = kept
    packed = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids


def test_language_fills_nulls_and_rejects_mixtures(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(120)
    own = {r["doc_id"]: r["lang"] for r in docs.collect()}
    blind = docs.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    strange = spark.createDataFrame([(-1, "12 34", None, "web", 5), (-2, None, "en", "web", None)], docs.schema)
    rows = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, blind.unionByName(strange), small).collect()}
    assert not {-1, -2} & set(rows) and len(rows) > 0.9 * len(own) and None not in rows.values()
    assert sum(lang == own[i] for i, lang in rows.items()) > 0.95 * len(rows)


def test_awkward_tables(spark, tmp_path):
    folder = folder_with(spark, tmp_path, documents(spark, clash=("kept", "score", "key")))
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_with(spark, tmp_path, nothing(spark))).collect() == []
