"""Queries of memory, governance, health and signals."""

from pyspark.sql import functions as F

from mnemoframe.functions.text import first_match
from mnemoframe.operators import governance as C
from mnemoframe.operators import health as H
from mnemoframe.operators import memory as M
from mnemoframe.operators import signals as S
from mnemoframe.plans.catalog import ORACLES, query
from mnemoframe.plans.catalog_text import _case
from mnemoframe.sources.views import AS_OF, oracle

_HASH = "sha256(lower(regexp_replace(content, '^\\s+|\\s+$', '', 'g')))"
query("ME01_dedup", "contexts", sql=f"SELECT node AS audience, {_HASH} AS content_hash, min_by(id, seq) AS id, count(*) AS copies FROM {{contexts}} GROUP BY 1, 2")(lambda c: M.deduplicated(c.withColumn("audience", F.col("node")), "seq"))
query("ME05_versions", "memories", sql="SELECT id, version, version = max(version) OVER () AS is_latest FROM {memories} WHERE root_id = 3")(lambda m: M.chain(m, 3))
query("ME05_relations", "memories", sql="SELECT CASE WHEN id = 'mem-3-1' THEN parent_id ELSE id END AS other, CASE WHEN id = 'mem-3-1' THEN 'outbound' ELSE 'inbound' END AS direction FROM {memories} WHERE parent_id IS NOT NULL AND (id = 'mem-3-1' OR parent_id = 'mem-3-1')")(
    lambda m: M.relations(m, "mem-3-1")
)
query("ME06_list", "memories", sql="SELECT id, version FROM {memories} WHERE audience = 'user' AND version > 1")(lambda m: m.where("audience = 'user' AND version > 1").select("id", "version"))
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(M.STOP_WORDS))
_T = "regexp_replace(lower(regexp_replace(regexp_replace(content, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]{2,})([A-Z][a-z])', '\\1 \\2', 'g')), '[`\"''{}()\\[\\]_\\-]', ' ', 'g')"
_KW = f"list_filter(list_distinct(regexp_split_to_array({_T}, '[\\s,.:;!?/\\\\|@#$%^&*+=<>~]+')), lambda w: length(w) > 2 AND NOT regexp_matches(w, '^\\d+$') AND NOT list_contains([{_STOP}], w))"
query("ME08_inverted_index", "memories")(M.inverted_index)
ORACLES["ME08_inverted_index"] = oracle("SELECT keyword, count(*) AS memories, min(id) AS first_id FROM (SELECT id, unnest(@K) AS keyword FROM {memories}) GROUP BY keyword").replace("@K", _KW)
query("ME09_recall", "memories")(lambda m: M.recall(m, ["ing", "ers", "there", "tion"], 400, F.col("version") * 12.0).select("id", "score", F.col("used").cast("long").alias("used")))
ORACLES["ME09_recall"] = oracle("""SELECT id, score, used FROM (SELECT *, CAST(sum(cost) OVER (ORDER BY score DESC, id) AS BIGINT) AS used FROM (
    SELECT id, round(o / 4.0 * 0.5 + exp(-(0.693 / 48.0) * version * 12.0) * 0.3 + CASE category WHEN 'decision' THEN 1.0 WHEN 'preference' THEN 0.9 ELSE 0.5 END * 0.2, 6) AS score, greatest(length(content) // 4, 1) AS cost
    FROM (SELECT *, len(list_intersect(@K, ['ing', 'ers', 'there', 'tion'])) AS o FROM {memories}) WHERE o > 0)) WHERE used <= 400""").replace("@K", _KW)
query("ME11_importance", "memories", sql="""SELECT id, round(least(CAST(CASE category WHEN 'decision' THEN 1.0 WHEN 'preference' THEN 0.9 ELSE 0.5 END + CASE WHEN strlen(content) > 500 THEN 0.1 WHEN strlen(content) > 200 THEN 0.05 ELSE 0 END
    + CASE WHEN regexp_matches(content, '[A-Z][a-z]+[A-Z]|[a-z]+_[a-z]+|->|=>|\\(\\)|def |fn ') THEN 0.05 ELSE 0 END AS DOUBLE), 1.0), 4) AS importance FROM {memories}""")(
    lambda m: m.select("id", F.round(M.importance(F.col("category"), F.col("content")), 4).alias("importance"))
)
_HITS = {k: " + ".join(f"contains(lower(text), '{w}')::INT" for w in v.split()) for k, v in M.CATEGORY_SIGNALS.items()}
_MOST = f"greatest({', '.join(f'{v}' for v in _HITS.values())})"
query("ME14_taxonomy", "seeded", sql=f"SELECT doc_id, CASE WHEN {_MOST} = 0 THEN 'context' {' '.join(f'WHEN {v} = {_MOST} THEN {chr(39)}{k}{chr(39)}' for k, v in _HITS.items())} END AS category FROM {{seeded}}")(
    lambda d: d.select("doc_id", M.categorised(F.col("text")).alias("category"))
)
query("ME18_compaction", "conversations", sql="""SELECT conv_id, sum(k) AS kept, sum(1 - k) AS summarised, sum(CASE WHEN k = 0 THEN length(text) ELSE 0 END) AS saved_chars FROM
    (SELECT *, CASE WHEN role = 'system' OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 THEN 1 ELSE 0 END AS k FROM {conversations}) GROUP BY conv_id""")(lambda c: M.compacted(c, 2))  # fmt: skip
query("ME19_transcript", "conversations", sql="SELECT conv_id, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS transcript FROM {conversations} GROUP BY conv_id")(M.transcript)
query("ME22_observation_kind", "seeded", sql="""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'wrong|error|fail|broken|bug') THEN 'friction' WHEN regexp_matches(lower(text), 'decided|choose|chose|pick|selected') THEN 'decision'
    WHEN regexp_matches(lower(text), 'always|never|prefer|should|must') THEN 'process' WHEN regexp_matches(lower(text), 'mix|command|tool|api|config') THEN 'tool' WHEN regexp_matches(text, '[A-Z][a-z]+ (prefers|wants|needs|likes)') THEN 'people' ELSE 'pattern' END AS kind FROM {seeded}""")(
    lambda d: d.select("doc_id", M.observation_kind(F.col("text")).alias("kind"))
)
query("AG28_recurring_errors", "seeded", sql=f"SELECT kind, count(*) AS n FROM (SELECT {_case(M.ERRORS, 'unknown_error')} AS kind FROM {{seeded}}) GROUP BY kind HAVING count(*) >= 3")(
    lambda d: d.groupBy(first_match(F.col("text"), M.ERRORS, "unknown_error").alias("kind")).agg(F.count("*").alias("n")).where("n >= 3")
)


query("CO01_acl", "contexts", sql="""WITH grants AS (SELECT id AS uri, concat('group-', seq % 5) AS grantee FROM {contexts} WHERE seq % 3 = 0 UNION ALL SELECT id, concat('user-', seq % 4) FROM {contexts} WHERE seq % 3 = 1)
    SELECT id AS uri FROM {contexts} WHERE id NOT IN (SELECT uri FROM grants) OR id IN (SELECT uri FROM grants WHERE grantee IN ('user-1', 'group-2', 'group-3'))""")(
    lambda c: C.permitted(
        c.select(F.col("id").alias("uri")),
        c.where("seq % 3 <> 2").selectExpr("id AS uri", "CASE WHEN seq % 3 = 0 THEN concat('group-', seq % 5) ELSE concat('user-', seq % 4) END AS grantee", "'read' AS permission"),
        c.sparkSession.createDataFrame([("user-1", "group-2"), ("user-1", "group-3"), ("user-2", "group-4")], "principal string, `group` string"), "user-1", "read",
    )
)
_KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3,3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", "url": r"https?://[^\s<>\"'']+"}
query("CO02_pii", "documents", sql=" UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, n FROM (SELECT doc_id, len(regexp_extract_all(text, '{pattern}')) AS n FROM {{documents}}) WHERE n > 0" for kind, pattern in _KINDS.items())
    # The oracle's engine has no lookaheads, so invalid areas are taken out by plain tests.
    + r""" UNION ALL SELECT doc_id, 'ssn', count(*) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{3,3}-\d{2,2}-\d{4,4}\b')) AS x FROM {documents}) WHERE NOT (x[1:3] IN ('000', '666') OR x[1:1] = '9' OR x[5:6] = '00' OR x[8:11] = '0000') GROUP BY doc_id""")(C.pii_counts)
query("CO02_pii_spans", "documents")(C.scan_pii)
query("CO03_luhn", "orders", sql="""WITH d AS (SELECT o_orderkey, CAST(o_orderkey * 7919 + 4000000000000 AS VARCHAR) AS digits FROM {orders}), n AS (SELECT o_orderkey, unnest(range(1, length(digits) + 1)) AS i, length(digits) AS m, digits FROM d),
    v AS (SELECT o_orderkey, i, m, CAST(substr(digits, CAST(m - i + 1 AS INT), 1) AS INT) AS x FROM n) SELECT o_orderkey, sum(CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN x * 2 - 9 ELSE x * 2 END) % 10 = 0 AS valid FROM v GROUP BY o_orderkey""")(
    lambda o: o.select("o_orderkey", C.luhn((F.col("o_orderkey") * 7919 + 4000000000000).cast("string")).alias("valid"))
)
query("CO04_redact", "documents")(lambda d: C.redacted(d).select("doc_id", "redacted"))
query("CO05_retention", "contexts", sql=f"""WITH p(policy, scope, value, days, action) AS (VALUES ('all', 'global', '', 31, 'archive'), ('spanish', 'genre', 'es', 30, 'redact'), ('src3', 'node', 'src3', 29, 'delete'))
    SELECT id, policy, CASE WHEN seq % 10 = 0 THEN 'held' ELSE action END AS action FROM {{contexts}}, p WHERE (scope = 'global' OR (scope = 'genre' AND value = genre) OR (scope = 'node' AND value = node)) AND modified_at < TIMESTAMP '{AS_OF}' - to_days(days)""")(
    lambda c: C.retention(c, c.sparkSession.createDataFrame([("all", "global", "", 31, "archive"), ("spanish", "genre", "es", 30, "redact"), ("src3", "node", "src3", 29, "delete")], "policy string, scope string, value string, days int, action string"), c.where("seq % 10 = 0").select("id"), AS_OF)
)
query("CO07_erasure", "customer", sql="SELECT c_custkey, concat('erased:', substr(sha256(c_name), 1, 16)) AS pseudonym FROM {customer}")(lambda c: c.select("c_custkey", C.erased(F.col("c_name")).alias("pseudonym")))
query("CO09_audit", "signals", sql="SELECT id, time, type FROM {signals} WHERE agent = 'user/7' AND time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00' ORDER BY time DESC, id DESC LIMIT 100")(
    lambda s: C.audit(s, "user/7", None, "2024-01-05 00:00:00", "2024-01-25 00:00:00")
)

query("HD01_orphans", "contexts", "routed", sql="SELECT id FROM {contexts} WHERE id NOT IN (SELECT id FROM {routed} WHERE destination <> node)")(
    lambda c, r: H.orphans(c, r.where("destination <> node").select(F.col("id").alias("source_id"), F.col("destination").alias("target_id")))
)
query("HD02_stale", "contexts", sql=f"SELECT id, modified_at FROM {{contexts}} WHERE modified_at < TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY")(lambda c: H.stale(c, AS_OF))
query("HD03_missing_references", "routed", sql="SELECT id, string_agg(DISTINCT destination, ',' ORDER BY destination) AS missing FROM {routed} WHERE destination <> node AND destination NOT IN ('src1', 'src2') GROUP BY id")(
    lambda r: H.missing_references(r, r.where("destination IN ('src1', 'src2')").select(F.col("id").alias("source_id"), F.col("destination").alias("target_id")))
)
query("HD05_case_collisions", "documents", sql="""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM {documents})
    SELECT lower(name) AS folded, count(DISTINCT name) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM w GROUP BY 1 HAVING count(DISTINCT name) > 1""")(
    lambda d: H.case_collisions(d.select(F.explode(F.split("text", " ")).alias("name")).distinct())
)
query("HD06_imbalance", "contexts", sql="WITH n AS (SELECT node, count(*) AS n FROM {contexts} GROUP BY node) SELECT node, n FROM n WHERE n > (SELECT avg(n) FROM n) * 0.9")(lambda c: H.imbalance(c, 0.9))
query("HD07_duplicate_titles", "contexts", sql="SELECT node, title, count(*) AS n FROM {contexts} GROUP BY node, title HAVING count(*) > 1")(H.duplicate_titles)
query("HD08_broken_references", "routed", sql="SELECT id, destination FROM {routed} WHERE destination NOT IN (SELECT node FROM {contexts})".replace("{contexts}", "(SELECT DISTINCT source AS node FROM documents WHERE source <> 'src5')"))(
    lambda r: r.join(r.where("node <> 'src5'").select(F.col("node").alias("destination")), "destination", "left_anti").select("id", "destination")
)
query("HD09_coverage", "contexts", "embeddings", sql="SELECT round(v * 100.0 / c, 1) AS percent, CASE WHEN round(v * 100.0 / c, 1) >= 80 THEN 'ok' WHEN round(v * 100.0 / c, 1) >= 50 THEN 'warning' ELSE 'critical' END AS status FROM (SELECT count(*) AS c FROM {contexts}), (SELECT count(*) AS v FROM {embeddings})")(H.coverage)
query("HD10_quality", "contexts", sql="SELECT round(avg((sn_ratio < 0.4)::INT), 6) AS low, CASE WHEN avg((sn_ratio < 0.4)::INT) <= 0.2 THEN 'ok' WHEN avg((sn_ratio < 0.4)::INT) <= 0.4 THEN 'warning' ELSE 'critical' END AS status FROM {contexts}")(H.quality)
_WORDS = "list_filter(list_distinct(regexp_split_to_array(regexp_replace(lower(@), '[^a-z0-9\\s]', ' ', 'g'), '\\s+')), lambda w: length(w) >= 4 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in H.STOP_WORDS) + "], w))"
query("HD11_fidelity", "contexts", sql=f"""WITH k AS (SELECT id, {_WORDS.replace('@', 'title')} AS a, {_WORDS.replace('@', 'content')} AS b FROM {{contexts}}), s AS (SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS score FROM k)
    SELECT id, score, CASE WHEN score >= 0.8 THEN 'A' WHEN score >= 0.6 THEN 'B' WHEN score >= 0.4 THEN 'C' WHEN score >= 0.2 THEN 'D' ELSE 'F' END AS grade FROM s""")(lambda c: H.fidelity(c, "title", "content"))  # fmt: skip
query("AG20_escalation", "signals", sql="SELECT type AS category, count(*) AS n, round(sum(latency / 1000.0), 6) AS confidence, round(sum(latency / 1000.0), 6) >= 1.5 AS ready FROM {signals} GROUP BY type HAVING count(*) >= 3")(
    lambda s: H.escalations(s.select(F.col("type").alias("category"), (F.col("latency") / 1000.0).alias("confidence")))
)

_SIZE = "strlen(data)"
query("SG02_signal_to_noise", "signals", sql=f"""SELECT id, round((1.0 + CASE WHEN data IS NULL OR {_SIZE} = 0 THEN 0.2 WHEN {_SIZE} < 10 THEN 0.5 WHEN {_SIZE} < 1000 THEN 0.8 ELSE 0.7 END
    + CASE WHEN len(string_split(type, '.')) >= 3 THEN 1.0 WHEN len(string_split(type, '.')) = 2 THEN 0.7 ELSE 0.4 END + (1 + (parent_id IS NOT NULL)::INT) / 3.0) / 4, 2) AS sn FROM {{signals}}""")(
    lambda s: s.select("id", S.signal_to_noise(F.col("data"), F.col("type"), [F.col("agent"), F.col("parent_id")]).alias("sn"))
)
query("SG03_code_like", "seeded", sql="SELECT doc_id, regexp_matches(text, 'def |fn |->|\\|>|defmodule|import |require |function|const |let |var |class |[{]|[}]|=>') AS code FROM {seeded}".replace("[{]|[}]", "\\x7b|\\x7d"))(
    lambda d: d.select("doc_id", S.code_like(F.col("text")).alias("code"))
)
query("SX02_history", "signals", sql="SELECT id, time, type FROM {signals} WHERE starts_with(type, 'app.p') AND time BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-09 00:00:00' ORDER BY time, id LIMIT 100")(
    lambda s: S.history(s, "app.p", "2024-01-02 00:00:00", "2024-01-09 00:00:00")
)
query("SX03_correlation", "signals", sql="SELECT correlation_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY time, id) AS ids FROM {signals} GROUP BY correlation_id")(S.correlated)
_ROUTES = [("all", "app.**", 0), ("exact", "app.view", 5), ("created", "app.*.created", 50), ("any", "**", 99)]
query("SX04_routes", "signals", sql="""WITH m AS (SELECT id, route, spec, prio FROM {signals}, (VALUES ('all', '^app(\\..*)?$', 3, 0), ('exact', '^app\\.view$', 6, 5), ('created', '^app\\.[^.]+\\.created$', 7, 50), ('any', '^.*$', 0, 99)) r(route, re, spec, prio) WHERE regexp_matches(type, re))
    SELECT id, route, row_number() OVER (PARTITION BY id ORDER BY spec DESC, prio DESC, route) - 1 AS place FROM m""")(lambda s: S.routed(s, _ROUTES))  # fmt: skip
query("AG23_percentiles", "signals", sql="""WITH s AS (SELECT type, latency FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id DESC) AS b FROM {signals}) WHERE b <= 1000), v AS (SELECT type, list(latency ORDER BY latency) AS v FROM s GROUP BY type)
    SELECT type, v[CAST(round((len(v) - 1) * 0.5) AS INT) + 1] AS p50, v[CAST(round((len(v) - 1) * 0.95) AS INT) + 1] AS p95, v[CAST(round((len(v) - 1) * 0.99) AS INT) + 1] AS p99 FROM v""")(lambda s: S.percentiles(s, "type", "latency", "id"))  # fmt: skip
query("SX08_cooldown", "signals", sql="""WITH RECURSIVE e AS (SELECT agent, type, id, epoch_us(time) AS t, row_number() OVER (PARTITION BY agent, type ORDER BY time, id) AS r FROM {signals}),
    w AS (SELECT agent, type, id, r, t AS last, true AS ok FROM e WHERE r = 1 UNION ALL SELECT e.agent, e.type, e.id, e.r, CASE WHEN e.t - w.last >= 3600000000 THEN e.t ELSE w.last END, e.t - w.last >= 3600000000 FROM w JOIN e ON e.agent = w.agent AND e.type = w.type AND e.r = w.r + 1) SELECT id FROM w WHERE ok""")(lambda s: S.cooled_down(s, ["agent", "type"]))
query("SX10_token_bucket", "signals", sql="""WITH RECURSIVE e AS (SELECT agent, id, epoch_us(time) AS t, row_number() OVER (PARTITION BY agent ORDER BY time, id) AS r FROM {signals}),
    w AS (SELECT agent, id, r, t, CAST(2.0 AS DOUBLE) AS tokens, true AS allowed FROM e WHERE r = 1 UNION ALL SELECT agent, id, r, t, CASE WHEN filled >= 1 THEN filled - 1 ELSE filled END, filled >= 1
        FROM (SELECT e.agent, e.id, e.r, e.t, least(CAST(3.0 AS DOUBLE), w.tokens + (e.t - w.t) / CAST(1000000 AS DOUBLE) * CAST(0.0001 AS DOUBLE)) AS filled FROM w JOIN e ON e.agent = w.agent AND e.r = w.r + 1) x) SELECT id, allowed FROM w""")(lambda s: S.rate_limited(s, "agent", 3.0, 0.0001))
query("SX13_sessions", "signals", sql="""WITH g AS (SELECT agent, time, CASE WHEN time - lag(time) OVER (PARTITION BY agent ORDER BY time, id) < INTERVAL '60' MINUTE THEN 0 ELSE 1 END AS fresh FROM {signals}), s AS (SELECT agent, time, sum(fresh) OVER (PARTITION BY agent ORDER BY time ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT agent, min(time) AS started, count(*) AS signals FROM s GROUP BY agent, n""")(
    lambda s: s.groupBy("agent", F.session_window("time", "60 minutes").alias("w")).agg(F.count("*").alias("signals")).select("agent", F.col("w.start").alias("started"), "signals")
)
