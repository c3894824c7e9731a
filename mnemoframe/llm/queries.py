"""Registered queries of this subpackage: each applies its operator to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, filter_audit, fingerprint, html_extract, langid, license_scan, neardup, packing, quality, sharding, url_filter, vecdup

#: Rules of the url query.
URL_RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")
TOKENIZER, OTHER_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    network = langid.learnt(docs, F.col("lang").isNotNull() & ~held_out)
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), network, keep_text=False)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=16)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), [url_filter.rule(r) for r in URL_RULES])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures, _ = alignment.align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(OTHER_TOKENIZER))
    return figures


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), F.col("source"))


def op13_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), 0.93)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_near_duplicates, op3_license_scan, op4_shards, op5_main_text, op6_packing, op7_decontamination, op8_fingerprints, op9_url_filter, op10_quality, op11_alignment, op12_filter_audit, op13_embedding_duplicates)
    return {f.__name__: f for f in found}


#: All pairs that share a shingle, with exact set sizes, and the closure of the links among them.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS shingles FROM w),
x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS c FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (n_a + n_b - c)),
either AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT r.id, e.b FROM reach r JOIN either e ON r.root = e.a)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, min(root) AS component_id, s.doc_id = min(root) AS kept FROM s JOIN reach ON s.doc_id = reach.id GROUP BY s.doc_id, len(s.shingles)
"""


#: Masks of failed filters by part, and all orders of the filters over them.
FILTER_AUDIT_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
k AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
        coalesce(doc_id > least, false)] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN k USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
o AS (SELECT '' AS f UNION ALL SELECT f || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(f, x)),
steps AS (SELECT f, s, f[s] AS x FROM o, range(1, 6) r(s) WHERE length(f) = 5),
z AS (SELECT part, f, s, x, n, good, toxic, len(list_filter(fails, lambda b: b)) AS failed, fails[instr('ABCDE', x)] AS here,
        len(list_filter(string_split(f[:s - 1], ''), lambda y: y <> '' AND fails[instr('ABCDE', y)])) > 0 AS before FROM c, steps),
g AS (SELECT part, f AS filter_order, CAST(s AS INT) AS step, x, sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT before THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN here AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN here AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN here AND NOT before THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT before THEN toxic ELSE 0 END) AS toxic_lost FROM z GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM g
"""

#: All pairs of usable vectors of a label, and the closure of the links.
EMBEDDING_DUPLICATES_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, len(embedding) AS width, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.width = b.width AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT r.id, e.b FROM reach r JOIN either e ON r.root = e.a),
c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM either GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """The others depend on trained models, hashes, tokenizers or edit distances; tests/llm hold each against brute force."""
    return {"op2_near_duplicates": NEAR_DUPLICATES_SQL, "op12_filter_audit": FILTER_AUDIT_SQL, "op13_embedding_duplicates": EMBEDDING_DUPLICATES_SQL}
