"""Queries of retrieval and of the document pipeline."""

from pyspark.sql import functions as F

from mnemoframe.functions.text import slug
from mnemoframe.operators import pipeline as P
from mnemoframe.operators import retrieval as R
from mnemoframe.plans.catalog import ORACLES, query
from mnemoframe.sources.views import AS_OF, oracle

_TERMS = "list_filter(regexp_split_to_array(translate(lower(content), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9ß]+'), lambda x: x <> '')"
_BM25 = f"""WITH d AS (SELECT id, sn_ratio, modified_at, {_TERMS} AS terms FROM {{contexts}}),
    c AS (SELECT id, sn_ratio, modified_at, len(terms) AS size, CAST(len(list_filter(terms, lambda x: x = 'hation')) AS DOUBLE) AS a, CAST(len(list_filter(terms, lambda x: x = 'rerean')) AS DOUBLE) AS b FROM d),
    f AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c),
    hits AS (SELECT id, sn_ratio, modified_at, greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * size / mean)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * size / mean)) AS bm25
        FROM c, f WHERE a > 0 AND b > 0)"""
query("RT01_bm25", "contexts", sql=f"{_BM25} SELECT id, round(bm25, 6) AS bm25 FROM hits")(lambda c: R.bm25(c, "hation rerean").select("id", F.round("bm25", 6).alias("bm25")))
_SCORE = f"round(bm25 * exp(-ln(2) / 720.0 * (epoch(TIMESTAMP '{AS_OF}') - epoch(modified_at)) / 3600.0) * (0.5 + 0.5 * sn_ratio), 4)"
query("RT03_search", "contexts", sql=f"{_BM25} SELECT id, {_SCORE} AS score FROM hits ORDER BY score DESC, id LIMIT 10")(lambda c: R.search(c, "hation rerean", AS_OF))
query("RT04_decay", "contexts", sql=f"SELECT id, round(exp(-ln(2) / 168.0 * (epoch(TIMESTAMP '{AS_OF}') - epoch(modified_at)) / 3600.0), 6) AS decay FROM {{contexts}}")(
    lambda c: c.select("id", F.round(R.decay(F.col("modified_at"), AS_OF, 168.0), 6).alias("decay"))
)
_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[]))"
query("RT06_vector_top_k", "embeddings", sql=f"SELECT e.vec_id, round({_COS}, 6) AS similarity FROM {{embeddings}} e, {{embeddings}} t WHERE t.vec_id = 7 AND round({_COS}, 6) >= 0.1 ORDER BY similarity DESC, e.vec_id LIMIT 10")(
    lambda e: R.nearest(e, e.where("vec_id = 7"))
)
query("RT07_hybrid", "contexts", "embeddings", sql=f"""{_BM25}, t AS (SELECT id, {_SCORE} AS score FROM hits), v AS (SELECT concat('ctx-', e.vec_id) AS id, round({_COS}, 6) AS similarity FROM {{embeddings}} e, {{embeddings}} t WHERE t.vec_id = 7 ORDER BY 2 DESC, e.vec_id LIMIT 30)
    SELECT coalesce(t.id, v.id) AS id, round(0.6 * coalesce(score, 0) / (SELECT max(score) FROM t) + 0.4 * coalesce(similarity, 0), 6) AS score FROM t FULL JOIN v ON t.id = v.id""")(
    lambda c, e: R.blend(R.search(c, "hation rerean", AS_OF, None), R.nearest(e, e.where("vec_id = 7"), -1.0, 30).select(F.concat(F.lit("ctx-"), "vec_id").alias("id"), "similarity"))
)
query("RT12_rank_fusion", "contexts", sql="""WITH a AS (SELECT id, row_number() OVER (ORDER BY sn_ratio DESC, id) AS r FROM {contexts} ORDER BY sn_ratio DESC, id LIMIT 50), b AS (SELECT id, row_number() OVER (ORDER BY length(content) DESC, id) AS r FROM {contexts} ORDER BY length(content) DESC, id LIMIT 50)
    SELECT id, round(sum(1.0 / (60 + r)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")(
    lambda c: R.fuse_ranks(c.select("id", F.col("sn_ratio").alias("score")).orderBy(F.desc("score"), "id").limit(50), c.select("id", F.length("content").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(50))
)
query("RT10_budget", "contexts", sql="""WITH RECURSIVE c AS (SELECT id, length(content) // 4 + 64 AS cost, row_number() OVER (ORDER BY sn_ratio DESC, id) AS r FROM (SELECT * FROM {contexts} ORDER BY sn_ratio DESC, id LIMIT 20) t),
    w AS (SELECT id, cost, r, cost <= 3000 AS kept, CASE WHEN cost <= 3000 THEN 3000 - cost ELSE 3000 END AS room FROM c WHERE r = 1 UNION ALL SELECT c.id, c.cost, c.r, c.cost <= w.room, CASE WHEN c.cost <= w.room THEN w.room - c.cost ELSE w.room END FROM w JOIN c ON c.r = w.r + 1) SELECT id, cost, kept FROM w""")(lambda c: R.within_budget(c.select("id", "content", F.col("sn_ratio").alias("score")).orderBy(F.desc("score"), "id").limit(20), 3000))
query("RT11_truncate", "contexts", sql="SELECT id, CASE WHEN length(content) > 400 THEN concat(substr(content, 1, 400), '…') ELSE content END AS text FROM {contexts}")(lambda c: c.select("id", R.truncated(F.col("content"), 100).alias("text")))
query("RT15_snippet", "documents", sql="""SELECT doc_id, nullif(trim(substr(text, greatest(coalesce(nullif(strpos(lower(text), 'rerean'), 0), nullif(strpos(lower(text), 'hation'), 0), 1) - 50, 1), 200), ' '), '') AS snippet FROM {documents}""")(
    lambda d: d.select("doc_id", R.snippet(F.col("text"), "rerean hation").alias("snippet"))
)
query("RT16_wiki_first", "part", sql="""WITH p AS (SELECT p_partkey, p_name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {part}),
    s AS (SELECT p_partkey, CASE WHEN slug = 'red-widget' THEN 100 WHEN starts_with(slug, 'red-widget') OR starts_with('red-widget', slug) THEN 50 WHEN length(slug) >= 4 AND (contains(slug, 'red-widget') OR contains('red-widget', slug)) THEN 10 ELSE 0 END
        + CASE WHEN lower(p_name) = 'red widget' THEN 40 WHEN contains(lower(p_name), 'red widget') THEN 10 ELSE 0 END AS score FROM p) SELECT p_partkey, score FROM s WHERE score > 0""")(
    lambda p: p.select("p_partkey", R.page_score(slug(F.col("p_name")), F.col("p_name"), "Red Widget").alias("score")).where("score > 0")
)
query("RT18_slugify", "documents", sql="SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {documents}")(lambda d: d.select("doc_id", slug(F.col("text")).alias("slug")))


def _case(rules, default, text="text"):
    """The rules as SQL for the oracle; its engine wants flags as an argument and looks for no borders around letters with marks."""
    parts = []
    for name, pattern in rules:
        flags = ""
        if pattern.startswith("(?"):
            flags, pattern = pattern[2 : pattern.index(")")], pattern[pattern.index(")") + 1 :]
        parts.append(f"WHEN regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{flags}') THEN '{name}'")
    return f"CASE {' '.join(parts)} ELSE '{default}' END".replace("{", "{{").replace("}", "}}")


query("PL07_PL09_classify", "seeded")(lambda d: P.classify(d).select("doc_id", "genre", "mode", "signal_type"))
ORACLES["PL07_PL09_classify"] = oracle("SELECT doc_id, @G AS genre, @M AS mode, @T AS signal_type FROM {seeded}").replace("@G", _case(P.GENRES, "note").replace("{{", "{").replace("}}", "}")).replace("@M", _case(P.MODES, "linguistic").replace("{{", "{").replace("}}", "}")).replace("@T", _case(P.TYPES, "inform"))
query("PL14_intent", "seeded")(lambda d: d.withColumn("lower", F.lower("text")).select("doc_id", P.intent(F.col("text"), F.col("lower")).alias("intent")))
ORACLES["PL14_intent"] = oracle("SELECT doc_id, @I AS intent FROM {seeded}").replace("@I", _case(P.INTENTS, "record_fact").replace("{{", "{").replace("}}", "}"))
query("PL14_intent_confidence", "seeded")(lambda d: d.withColumn("lower", F.lower("text")).select("doc_id", P.intent_confidence(F.col("text"), F.col("lower")).alias("confidence")))
_MORE = " ".join("WHEN regexp_matches(text, @P, 'i') THEN round(least(0.65 + least(len(regexp_extract_all(text, @P, 0, 'i')) - 1, 6) * 0.05, 0.95), 2)".replace("@P", "'" + p.removeprefix("(?i)").replace("'", "''") + "'") for _, p in P.INTENTS)
ORACLES["PL14_intent_confidence"] = oracle("SELECT doc_id, CAST(CASE WHEN text = '' THEN 0.3 @M ELSE 0.5 END AS DOUBLE) AS confidence FROM {seeded}").replace("@M", _MORE)
query("PL10_density", "documents", sql="""WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS k FROM {documents})
    SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 0.0 WHEN strlen(text) < 40 THEN 0.3 WHEN len(k) = 0 THEN 0.0 ELSE round(0.4 + 0.5 * len(list_distinct(k)) / len(k), 3) END AS density FROM t""")(lambda d: d.select("doc_id", P.density(F.col("text")).alias("density")))  # fmt: skip
query("PL18_gate", "contexts", sql="SELECT id, CASE WHEN sn_ratio < 0.3 THEN 'reject' WHEN sn_ratio < 0.6 THEN 'quarantine' ELSE 'accept' END AS verdict FROM {contexts}")(lambda c: c.select("id", P.gate(F.col("sn_ratio")).alias("verdict")))
query("PL04_windows", "documents", sql="""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n+')) AS body, generate_subscripts(regexp_split_to_array(text, '\\n+'), 1) - 1 AS paragraph FROM {documents}), s AS (SELECT doc_id, paragraph, strlen(body) AS size FROM p WHERE body <> ''),
    w AS (SELECT doc_id, paragraph, size, unnest(range(0, greatest(CAST(ceil((size - 256) / 1792.0) AS BIGINT), 1))) AS chunk FROM s) SELECT doc_id, paragraph, chunk, chunk * 1792 AS start, least(2048, size - chunk * 1792) AS length FROM w""")(P.windows)  # fmt: skip
query("CL01_greedy_clusters", "embeddings")(P.greedy_clusters)
