"""Queries of wiki pages, signal dimensions, subscriptions, paragraphs and read models."""

from pyspark.sql import functions as F

from mnemoframe.functions.text import terms
from mnemoframe.operators import signals as S
from mnemoframe.operators import wiki as W
from mnemoframe.plans.catalog import query

_DIRECTIVE = "'\\x7b\\x7b\\s*([a-z_]+)\\s*:\\s*([^\\x7d]*?)\\s*\\x7d\\x7d'"
_FOUND = f"""SELECT doc_id, unnest(regexp_extract_all(body, {_DIRECTIVE}, 1)) AS verb, unnest(regexp_extract_all(body, {_DIRECTIVE}, 2)) AS argument FROM {{wiki}}
    UNION ALL SELECT doc_id, 'wikilink', unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1)) FROM {{wiki}}"""
_VERBS = ", ".join(f"'{v}'" for v in W.VERBS)
query("WK02_directives", "wiki", sql=_FOUND)(W.directives)
query("WK03_whitelist", "wiki", sql=f"SELECT doc_id, len(list_filter(regexp_extract_all(body, {_DIRECTIVE}, 1), lambda v: NOT list_contains([{_VERBS}], v))) = 0 AS ok FROM {{wiki}}")(
    lambda w: w.select("doc_id", W.whitelisted(F.col("body")).alias("ok"))
)
query("WK05_integrity", "wiki", "documents", sql=f"""WITH f AS ({_FOUND}) SELECT doc_id, 'invalid_verb' AS problem, verb AS detail FROM f WHERE verb NOT IN ({_VERBS}, 'wikilink')
    UNION ALL SELECT doc_id, 'broken_cite', argument FROM f WHERE verb = 'cite' AND argument NOT IN (SELECT concat('doc/', doc_id) FROM documents WHERE source <> 'src3')
    UNION ALL SELECT doc_id, 'too_large', CAST(strlen(body) AS VARCHAR) FROM {{wiki}} WHERE strlen(body) > 50000""")(
    lambda w, d: W.problems(w, d.where("source <> 'src3'").select(F.concat(F.lit("doc/"), "doc_id").alias("uri")))
)

_CODE = "regexp_matches(data, 'def |fn |->|\\|>|defmodule|import |require |function|const |let |var |class |\\x7b|\\x7d|=>')"
_cases = lambda table, of, default: f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"
_SEGMENT = "list_filter(string_split(type, '.'), lambda s: list_contains([" + ", ".join(f"'{k}'" for k in S.GENRE_OF) + "], s))[1]"
query("SG01_dimensions", "signals", sql=f"""SELECT id, CASE WHEN {_CODE} THEN 'code' ELSE 'linguistic' END AS mode, {_cases(S.GENRE_OF, _SEGMENT, 'chat')} AS genre, {_cases(S.ACTION_OF, "string_split(type, '.')[-1]", 'inform')} AS action,
    CASE WHEN {_CODE} THEN 'code' WHEN regexp_matches(data, '#|[*][*]|- ') THEN 'markdown' ELSE 'cli' END AS format, {_cases(S.STRUCTURE_OF, _SEGMENT, 'default')} AS structure FROM {{signals}}""")(
    lambda s: s.select("id", *(c.alias(n) for n, c in S.dimensions(F.col("data"), F.col("type")).items()))
)
query("SX05_topics", "signals", sql="""SELECT id, pattern FROM {signals}, (VALUES ('app.*', '^app\\.[^.]*$'), ('app.view.**', '^app\\.view\\..*$'), ('*.purchase.created', '^[^.]*\\.purchase\\.created$')) p(pattern, re) WHERE regexp_matches(type, re)""")(
    lambda s: S.subscribed(s, ["app.*", "app.view.**", "*.purchase.created"])
)
_SUBSCRIPTIONS = [("all", "workspace", ""), ("third", "node", "src3"), ("spanish", "audience", "es"), ("word", "topic", "Hation"), ("place", "topic", "SRC1")]
query("SX07_fan_out", "contexts", sql="""WITH s(subscription, scope, value) AS (VALUES ('all', 'workspace', ''), ('third', 'node', 'src3'), ('spanish', 'audience', 'es'), ('word', 'topic', 'Hation'), ('place', 'topic', 'SRC1')),
    r AS (SELECT id, subscription, CASE WHEN scope = 'workspace' THEN 1.0 WHEN scope = 'node' AND contains(node, value) THEN 1.0 WHEN scope = 'topic' AND contains(node, lower(value)) THEN 1.0
        WHEN scope = 'topic' AND contains(lower(content), lower(value)) THEN 0.7 WHEN scope = 'audience' AND genre = value THEN 1.0 ELSE 0.0 END AS score FROM {contexts}, s)
    SELECT id, subscription, CAST(score AS DOUBLE) AS score FROM r WHERE score >= 0.5""")(
    lambda c: S.surfaced(c.select("id", F.col("node").alias("slug"), F.col("content").alias("body"), F.col("genre").alias("audience")), c.sparkSession.createDataFrame(_SUBSCRIPTIONS, "subscription string, scope string, value string"))
)

query("RT08_node_boost", "contexts", sql="SELECT id, round(sn_ratio * CASE WHEN node IN ('src1', 'src4') THEN 1.2 ELSE 1.0 END, 6) AS score FROM {contexts}")(
    lambda c: c.select("id", F.round(F.col("sn_ratio") * F.when(F.col("node").isin("src1", "src4"), 1.2).otherwise(1.0), 6).alias("score"))
)
query("AG02_store_stats", "contexts", sql="""SELECT count(*) AS contexts, count(*) FILTER (type = 'signal') AS signals, count(*) FILTER (type = 'resource') AS resources, count(*) FILTER (type = 'memory') AS memories,
    count(DISTINCT node) AS nodes, count(DISTINCT genre) AS genres, round(avg(sn_ratio), 6) AS mean_quality FROM {contexts}""")(
    lambda c: c.agg(
        F.count("*").alias("contexts"), *(F.count_if(F.col("type") == t).alias(n) for t, n in (("signal", "signals"), ("resource", "resources"), ("memory", "memories"))),
        F.count_distinct("node").alias("nodes"), F.count_distinct("genre").alias("genres"), F.round(F.avg("sn_ratio"), 6).alias("mean_quality"),
    )
)
query("HD04_index_drift", "contexts", "embeddings", sql="""SELECT abs(c - v) AS drift, CASE WHEN c = v THEN 'ok' WHEN abs(c - v) < 5 THEN 'warning' ELSE 'critical' END AS status
    FROM (SELECT count(*) AS c FROM {contexts}), (SELECT count(*) AS v FROM {embeddings})""")(
    lambda c, e: c.agg(F.count("*").alias("c")).join(e.agg(F.count("*").alias("v"))).select(F.abs(F.col("c") - F.col("v")).alias("drift"), F.when(F.col("c") == F.col("v"), "ok").when(F.abs(F.col("c") - F.col("v")) < 5, "warning").otherwise("critical").alias("status"))
)
query("PL03_paragraphs", "wiki", sql="""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(body, '\\n\\n+')) AS t, generate_subscripts(regexp_split_to_array(body, '\\n\\n+'), 1) - 1 AS paragraph FROM {wiki})
    SELECT doc_id, paragraph, strlen(t) AS length, CAST(sum(strlen(t) + 2) OVER (PARTITION BY doc_id ORDER BY paragraph) - strlen(t) - 2 AS BIGINT) AS start FROM p""")(
    lambda w: w.select("doc_id", F.transform(F.split("body", r"\n{2,}"), F.octet_length).alias("sizes"))
    .select("doc_id", F.posexplode("sizes").alias("paragraph", "length"), "sizes")
    .select("doc_id", "paragraph", "length", F.aggregate(F.slice("sizes", F.lit(1), F.col("paragraph")), F.lit(0).cast("long"), lambda a, x: a + x + 2).alias("start"))
)
query("GR04_related_contexts", "edges", sql="SELECT DISTINCT source_id AS id FROM {edges} WHERE target_id = 'part/119' AND relation = 'mentioned_in'")(
    lambda e: e.where("target_id = 'part/119' AND relation = 'mentioned_in'").select(F.col("source_id").alias("id")).distinct()
)
query("GR10_entity_context", "edges", sql="SELECT relation, count(*) AS n, min(source_id) AS first_source, max(target_id) AS last_target FROM {edges} WHERE contains(source_id, 'part/11') OR contains(target_id, 'part/11') GROUP BY relation")(
    lambda e: e.where(F.col("source_id").contains("part/11") | F.col("target_id").contains("part/11")).groupBy("relation").agg(F.count("*").alias("n"), F.min("source_id").alias("first_source"), F.max("target_id").alias("last_target"))
)
