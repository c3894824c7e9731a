"""Queries of context assembly, memory search, wiki upkeep, graph building, scenarios, compliance and envelopes."""

from pyspark.sql import functions as F

from mnemoframe.operators import assembly as A
from mnemoframe.operators import decompose as D
from mnemoframe.operators import envelopes as E
from mnemoframe.operators import graph as G
from mnemoframe.operators import reports as R
from mnemoframe.operators import store as S
from mnemoframe.operators import wiki as W
from mnemoframe.plans.catalog import query
from mnemoframe.sources.views import AS_OF

_top = lambda c, n: c.select("id", F.col("sn_ratio").alias("score")).orderBy(F.desc("score"), "id").limit(n)
_HITS = "hits AS (SELECT id, sn_ratio AS score FROM {contexts} ORDER BY score DESC, id LIMIT %d)"
query("RT05_FA01_listed", "contexts", sql="SELECT id, modified_at FROM {contexts} WHERE node = 'src8' AND type = 'memory' ORDER BY modified_at DESC, id LIMIT 50")(lambda c: A.listed(c, "mem://src8/memory/x").select("id", "modified_at"))
query("RT09_graph_boost", "contexts", "mentions", "edges", sql="""WITH c AS (SELECT DISTINCT target_id AS name FROM {edges} WHERE contains(lower(source_id), 'order/1') OR contains(lower(source_id), 'supplier/2') UNION SELECT source_id FROM {edges} WHERE contains(lower(target_id), 'order/1') OR contains(lower(target_id), 'supplier/2')),
    n AS (SELECT context_id, count(DISTINCT name) AS n FROM {mentions} WHERE name IN (SELECT name FROM c) GROUP BY 1) SELECT id, round(sn_ratio * (1 + 0.1 * coalesce(n, 0)), 4) AS score FROM {contexts} LEFT JOIN n ON id = context_id""")(
    lambda c, m, e: A.graph_boost(c.select("id", F.col("sn_ratio").alias("score")), m, e, "Order/1 Supplier/2")
)
_INVENTORY = """inv AS (SELECT concat('# Inventory', chr(10), string_agg(line, chr(10) ORDER BY line)) AS text FROM (SELECT concat('- ', node, ' (', sum(n), '): ', string_agg(concat(type, ' ', n), ', ' ORDER BY concat(type, ' ', n))) AS line FROM (SELECT node, type, count(*) AS n FROM {contexts} GROUP BY 1, 2) GROUP BY node))"""
query("RT28_inventory", "contexts", sql=f"WITH {_INVENTORY} SELECT substr(text, 1, 12000) AS text FROM inv")(A.inventory)
query("RT13_tiers", "contexts", sql=f"""WITH {_INVENTORY}, {_HITS % 20}, f AS (SELECT id, score, content, trim(regexp_replace(regexp_replace(content, '(?m)^#+ +', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM {{contexts}} JOIN hits USING (id)),
    s AS (SELECT id, score, CASE WHEN length(t) <= 500 THEN t ELSE concat(regexp_replace(substr(t, 1, 500), ' [^ ]*$', ''), '…') END AS text FROM f), b AS (SELECT id, score, content AS text FROM f ORDER BY score DESC, id LIMIT 5),
    l1 AS (SELECT *, sum(length(text) // 4) OVER (ORDER BY score DESC, id) AS spent FROM s), l2 AS (SELECT *, sum(length(text) // 4) OVER (ORDER BY score DESC, id) AS spent FROM b)
    SELECT 'l0' AS tier, NULL AS id, substr(text, 1, 12000) AS text FROM inv UNION ALL SELECT 'l1', id, text FROM l1 WHERE spent <= 10000 UNION ALL SELECT 'l2', id, text FROM l2 WHERE spent <= 50000""")(lambda c: A.tiers(_top(c, 20), c))  # fmt: skip
query("RT14_grep", "contexts", "chunks", sql=f"""WITH {_HITS % 40} SELECT chunk_id, round(score * CASE idx WHEN 0 THEN 1.0 ELSE 0.95 END, 6) AS score, nullif(trim(substr(text, greatest(coalesce(nullif(strpos(lower(text), 'the'), 0), 1) - 50, 1), 200), ' '), '') AS snippet
    FROM {{chunks}} JOIN hits ON context_id = id WHERE idx < 50 AND intent = 'specify' ORDER BY score DESC, chunk_id LIMIT 10""")(
    lambda c, k: A.grep(_top(c, 40), k.withColumn("scale", F.when(F.col("idx") == 0, "section").otherwise("paragraph")), "the", 10, "specify")
)
query("RT29_recent_decisions", "contexts", sql=f"SELECT id, modified_at FROM {{contexts}} WHERE type = 'signal' AND modified_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY ORDER BY modified_at DESC, id LIMIT 5")(lambda c: R.recent(c, "signal", AS_OF, 30, 5))
_FEATURES = "SELECT vec_id, embedding, CASE WHEN vec_id % 5 <> 0 THEN list_distinct([concat('e', vec_id % 3), concat('e', vec_id % 4), 'e9']) END AS entities, CASE WHEN vec_id % 3 <> 0 THEN concat('i', vec_id % 2) END AS intent, CASE WHEN vec_id % 7 <> 0 THEN concat('n', vec_id % 4) END AS node_id, [concat('r', vec_id % 2)] AS ancestors FROM {embeddings}"
query("CL02_composite_similarity", "embeddings", sql=f"""WITH f AS ({_FEATURES}), p AS (SELECT x.vec_id, x.entities IS NOT NULL AND y.entities IS NOT NULL AS e, x.intent IS NOT NULL AND y.intent IS NOT NULL AS i, x.node_id IS NOT NULL AND y.node_id IS NOT NULL AS n,
    (list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) + 1) / 2 AS c, len(list_intersect(x.entities, y.entities)) / len(list_distinct(list_concat(x.entities, y.entities))) AS j, CAST(x.intent = y.intent AS DOUBLE) AS m, CASE WHEN x.node_id = y.node_id THEN 1.0 WHEN x.ancestors = y.ancestors THEN 0.5 ELSE 0.0 END AS a
    FROM f x JOIN f y ON y.vec_id = 7) SELECT vec_id, round((0.6 * c + CASE WHEN e THEN 0.2 * j ELSE 0 END + CASE WHEN i THEN 0.15 * m ELSE 0 END + CASE WHEN n THEN 0.05 * a ELSE 0 END) / (0.6 + CASE WHEN e THEN 0.2 ELSE 0 END + CASE WHEN i THEN 0.15 ELSE 0 END + CASE WHEN n THEN 0.05 ELSE 0 END), 6) AS similarity FROM p""")(
    lambda e: _similar_to(e, 7)
)


def _similar_to(vectors, vec_id):
    name = lambda prefix, n: F.concat(F.lit(prefix), F.col("vec_id") % n)
    features = vectors.select("vec_id", F.struct(
        "embedding", F.when(F.col("vec_id") % 5 != 0, F.array_distinct(F.array(name("e", 3), name("e", 4), F.lit("e9")))).alias("entities"), F.when(F.col("vec_id") % 3 != 0, name("i", 2)).alias("intent"),
        F.when(F.col("vec_id") % 7 != 0, name("n", 4)).alias("node_id"), F.array(name("r", 2)).alias("node_ancestors"),
    ).alias("a"))
    one = features.where(F.col("vec_id") == vec_id).select(F.col("a").alias("b"))
    return features.join(F.broadcast(one), F.lit(True)).select("vec_id", F.round(A.composite_similarity("a", "b"), 6).alias("similarity"))


query("JN08_chunk_intents", "contexts", "chunks", sql="SELECT id, chunk_id, coalesce(intent, 'none') AS intent FROM {contexts} JOIN {chunks} ON id = context_id WHERE node = 'src8'")(lambda c, k: R.chunk_intents(k, c, "src8"))
query("JN07_vectors_of_contexts", "embeddings", "contexts", sql="SELECT id, vec_id, label FROM {embeddings} JOIN {contexts} ON vec_id = seq WHERE type = 'resource' AND node = 'src8'")(lambda e, c: R.vectors_of(e, c, "src8", "resource"))
query("JN14_broken_supersedes", "versions", sql="SELECT id FROM {versions} WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM {versions} WHERE audience <> 'user')")(lambda v: R.broken_parents(v, v.where("audience <> 'user'")))
query("JN19_cited_contexts", "citations", "chunks", "contexts", sql="SELECT DISTINCT slug, id, node FROM {citations} c JOIN {chunks} k ON c.chunk_id = k.chunk_id JOIN {contexts} x ON k.context_id = x.id")(R.cited_contexts)
query("JN21_three_way", "chunks", "citations", sql="SELECT k.chunk_id, intent, count(slug) AS pages FROM {chunks} k LEFT JOIN {citations} c ON k.chunk_id = c.chunk_id GROUP BY 1, 2")(R.citing_pages)
query("JN24_workspaces_of", "customer", "nation", sql="SELECT n_name AS workspace, c_custkey AS principal FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")(lambda c, n: R.workspaces_of(c.where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS principal", "c_nationkey AS workspace_id"), n.selectExpr("n_nationkey AS workspace_id", "n_name AS workspace")))
query("JN25_CO06_holds", "holds", "contexts", sql="SELECT principal, count(*) AS held FROM {holds} JOIN {contexts} ON context_id = id WHERE released_at IS NULL GROUP BY principal")(R.active_holds)
query("CO06_is_held", "contexts", "holds", sql="SELECT id, id IN (SELECT context_id FROM {holds} WHERE released_at IS NULL) AS held FROM {contexts}")(R.held)
query("CO07_erasure_preview", "contexts", "chunks", "mentions", "holds", sql="""WITH w AS (SELECT id FROM {contexts} WHERE node = 'src8' AND id NOT IN (SELECT context_id FROM {holds} WHERE released_at IS NULL)) SELECT 'contexts' AS section, count(*) AS n FROM {contexts} WHERE id IN (SELECT id FROM w)
    UNION ALL SELECT 'chunks', count(*) FROM {chunks} WHERE context_id IN (SELECT id FROM w) UNION ALL SELECT 'mentions', count(*) FROM {mentions} WHERE context_id IN (SELECT id FROM w)""")(
    lambda c, k, m, h: S.cascade(
        {"contexts": c.withColumn("owner", F.col("id")), "chunks": k.withColumn("owner", F.col("context_id")), "mentions": m.withColumn("owner", F.col("context_id"))},
        S.delete(c.where("node = 'src8'").select("id"), h.where("released_at IS NULL").select(F.col("context_id").alias("id")), "id"),
    )
)

_words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: F.length(w) >= 4))
query("ME10_memory_search", "memories", sql="""WITH k AS (SELECT id, category, version, list_distinct(list_filter(regexp_split_to_array(lower(content), '[^a-z]+'), lambda w: length(w) >= 4)) AS words FROM {memories}),
    s AS (SELECT id, len(list_intersect(words, ['that', 'from', 'with'])) / 3.0 * 0.5 + 1.0 / version * 0.3 + CASE category WHEN 'decision' THEN 0.9 WHEN 'fact' THEN 0.6 ELSE 0.5 END * 0.2 AS score FROM k) SELECT id, round(score, 3) AS score FROM s WHERE score > 0.05 ORDER BY score DESC, id LIMIT 10""")(
    lambda m: (
        m.select("id", (F.size(F.array_intersect(_words(F.col("content")), F.array(*map(F.lit, ("that", "from", "with"))))) / 3.0 * 0.5 + 1.0 / F.col("version") * 0.3 + F.when(F.col("category") == "decision", 0.9).when(F.col("category") == "fact", 0.6).otherwise(0.5) * 0.2).alias("s"))
        .where("s > 0.05").orderBy(F.desc(F.round("s", 3)), "id").limit(10).select("id", F.round("s", 3).alias("score"))
    )
)
query("ME12_key_value_search", "part", sql="SELECT p_partkey FROM {part} WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'steel') OR contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#3')")(
    lambda p: p.where(F.exists(F.array(F.lit("steel"), F.lit("brand#3")), lambda t: F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), t))).select("p_partkey")
)
query("ME13_recall_similar", "conversations", sql="""WITH k AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 4)) AS w FROM {conversations} WHERE role = 'user'), q AS (SELECT w AS q FROM k WHERE conv_id = (SELECT min(conv_id) FROM k) ORDER BY turn LIMIT 1)
    SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(w, q))) > 0 THEN len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q))) ELSE 0 END, 4) AS likeness FROM k, q ORDER BY likeness DESC, conv_id, turn LIMIT 20""")(
    lambda c: _recall(c.where("role = 'user'").select("conv_id", "turn", _words(F.col("text")).alias("w")))
)


def _recall(episodes):
    asked = episodes.orderBy("conv_id", "turn").limit(1).select(F.col("w").alias("q"))
    likeness = F.round(S.overlap(F.col("w"), F.col("q")), 4)
    return episodes.join(F.broadcast(asked), F.lit(True)).select("conv_id", "turn", likeness.alias("likeness")).orderBy(F.desc("likeness"), "conv_id", "turn").limit(20)


query("ME15_filter", "memories", sql="SELECT id FROM {memories} WHERE category IN ('fact', 'decision') AND audience = 'user' AND version >= 2 AND length(content) >= 40")(lambda m: m.where("category IN ('fact', 'decision') AND audience = 'user' AND version >= 2 AND length(content) >= 40").select("id"))
query("ME16_injection", "memories", sql="""WITH s AS (SELECT id, content, round(0.3 * CASE category WHEN 'decision' THEN 0.9 WHEN 'fact' THEN 0.6 ELSE 0.5 END + 0.5 * CAST(contains(lower(content), 'that') AS INT) + 0.2 / version, 6) AS score FROM {memories}), t AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 20)
    SELECT id, score FROM (SELECT *, sum(strlen(content)) OVER (ORDER BY score DESC, id) AS bytes FROM t) WHERE bytes <= 4000""")(
    lambda m: A.within(
        m.select("id", F.repeat(F.lit("x"), F.octet_length("content") * 4).alias("text"), F.round(0.3 * F.when(F.col("category") == "decision", 0.9).when(F.col("category") == "fact", 0.6).otherwise(0.5) + 0.5 * F.contains(F.lower("content"), F.lit("that")).cast("int") + 0.2 / F.col("version"), 6).alias("score"))
        .orderBy(F.desc("score"), "id").limit(20), 4000).select("id", "score")
)
query("AG26_topics", "conversations", sql="""WITH w AS (SELECT conv_id, turn, role, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 4))) AS topic FROM {conversations})
    SELECT topic, sum(CASE WHEN role = 'user' THEN 2 ELSE 1 END) AS weight FROM w GROUP BY topic HAVING sum(CASE WHEN role = 'user' THEN 2 ELSE 1 END) >= 2 ORDER BY weight DESC, topic LIMIT 15""")(lambda c: R.topics(c, _words(F.col("text")), F.when(F.col("role") == "user", 2).otherwise(1), 2, 15))  # fmt: skip
query("AG19_severities", "signals", sql="SELECT CASE WHEN contains(type, 'error') THEN 'critical' WHEN latency > 50 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM {signals} GROUP BY 1")(lambda s: R.counted(s, "severity", F.when(F.contains("type", F.lit("error")), "critical").when(F.col("latency") > 50, "warning").otherwise("info")))
query("AG21_confident_topics", "signals", sql="SELECT agent, type, round(sum(latency) / 100.0, 6) AS confidence, count(*) AS n FROM {signals} GROUP BY 1, 2 HAVING round(sum(latency) / 100.0, 6) >= 1.5")(lambda s: R.confident(s, ["agent", "type"], F.col("latency") / 100.0, 1.5))
query("AG24_histogram", "signals", sql="SELECT type, CAST(least(floor(latency / 10), 9) AS BIGINT) AS bucket, count(*) AS n FROM {signals} GROUP BY 1, 2")(lambda s: R.histogram(s, "type", "latency", 10, 10))
query("AG27_tool_windows", "signals", sql="""SELECT agent, win, count(*) AS n, CAST(floor(avg(latency)) AS BIGINT) AS duration, round(avg(CAST(NOT contains(type, 'error') AS INT)), 4) AS success FROM (SELECT *, (row_number() OVER (PARTITION BY agent ORDER BY id) - 1) // 5 AS win FROM {signals}) GROUP BY 1, 2""")(lambda s: R.window_stats(s, "agent", "id", 5, "latency", ~F.contains("type", F.lit("error"))))
query("AG31_counts", "versions", "curated", sql="SELECT 'memories' AS kind, count(*) AS n, count(*) FILTER (is_latest) AS latest FROM {versions} UNION ALL SELECT 'wiki', count(*), count(DISTINCT (slug, audience)) FROM {curated}")(R.version_counts)
query("AG34_dominant_intent", "chunks", sql="SELECT context_id, arg_min(intent, idx) AS intent FROM {chunks} WHERE intent IS NOT NULL GROUP BY context_id")(lambda k: R.first_value(k, "context_id", "intent", "idx"))

query("WK01_latest", "curated", sql="SELECT slug, audience, max(version) AS version, arg_max(body, version) AS body FROM {curated} GROUP BY 1, 2")(lambda w: w.groupBy("slug", "audience").agg(F.max("version").alias("version"), F.max_by("body", "version").alias("body")))
query("WK01_upsert", "curated", sql="SELECT slug, version, body FROM {curated} WHERE NOT (version = 1 AND audience = 0) UNION ALL SELECT slug, version, 'new' FROM {curated} WHERE version = 1 AND audience = 0")(
    lambda w: S.upsert(w, w.where("version = 1 AND audience = 0").withColumn("body", F.lit("new")), "slug", "audience", "version").select("slug", "version", "body")
)
_STALE = f"""SELECT DISTINCT w.slug FROM (SELECT slug, max(curated_at) AS curated_at FROM {{curated}} GROUP BY slug) w JOIN {{citations}} c ON w.slug = c.slug JOIN {{chunks}} k ON c.chunk_id = k.chunk_id JOIN {{contexts}} x ON k.context_id = x.id
    WHERE w.curated_at < TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY AND EXISTS (SELECT 1 FROM {{contexts}} y WHERE y.node = x.node AND y.modified_at > w.curated_at)"""
query("WK10_stale_pages", "curated", "citations", "chunks", "contexts", sql=_STALE)(lambda w, c, k, x: R.stale_pages(w, c, k, x, AS_OF))
query("WK11_new_citations", "curated", "citations", sql="SELECT c.slug, chunk_id FROM {citations} c JOIN (SELECT slug, max(curated_at) AS curated_at FROM {curated} GROUP BY slug) w ON c.slug = w.slug WHERE cited_at > curated_at")(R.uncurated_citations)

query("GR01_GR02_edges", "contexts", "mentions", "versions", sql="""SELECT context_id AS source_id, name AS target_id, 'mentioned_in' AS relation, 1.0 AS weight FROM {mentions} UNION SELECT id, node, 'lives_in', 1.0 FROM {contexts} WHERE node IS NOT NULL UNION SELECT id, parent_id, 'supersedes', 1.0 FROM {versions} WHERE parent_id IS NOT NULL
    UNION SELECT name, n, 'cross_ref', 0.8 FROM {mentions} JOIN (SELECT id, node AS n FROM {contexts}) x ON id = context_id WHERE n IS NOT NULL""")(lambda c, m, v: G.built_edges(c, m, v))  # fmt: skip
query("GR14_seeds", "mentions", "contexts", sql="SELECT id FROM (SELECT context_id AS id FROM {mentions} WHERE contains(name, 'part/1') UNION SELECT id FROM {contexts} WHERE node = 'src8') ORDER BY id LIMIT 50")(lambda m, c: R.seeds(m, c, "part/1", "src8"))
query("GR16_critical_dependencies", "mentions", "contexts", sql="""WITH t AS (SELECT node, count(*) AS total FROM {contexts} GROUP BY node), n AS (SELECT node, count(*) AS n FROM {contexts} JOIN {mentions} ON id = context_id WHERE contains(name, 'part/1') GROUP BY node)
    SELECT node, 'mentioned_in' AS relation, round(CAST(n AS DOUBLE) / total, 3) AS weight FROM n JOIN t USING (node) WHERE CAST(n AS DOUBLE) / total > 0.5""")(lambda m, c: G.critical_dependencies(m, c, "part/1"))  # fmt: skip
query("GR17_severity", "mentions", "contexts", sql="""WITH t AS (SELECT node, count(*) AS total FROM {contexts} GROUP BY node), n AS (SELECT name, node, count(*) AS n FROM {contexts} JOIN {mentions} ON id = context_id GROUP BY 1, 2),
    a AS (SELECT name, sum(n) AS contexts, count(*) AS nodes, count(*) FILTER (CAST(n AS DOUBLE) / total > 0.5) AS critical FROM n JOIN t USING (node) GROUP BY name)
    SELECT name, CASE WHEN critical >= 3 THEN 'critical' WHEN critical >= 1 OR nodes >= 5 THEN 'high' WHEN nodes >= 3 OR contexts > 15 THEN 'medium' ELSE 'low' END AS severity FROM a""")(lambda m, c: G.severities(m, c))  # fmt: skip
query("GR19_affected", "mentions", sql="""SELECT name, count(DISTINCT context_id) AS n FROM {mentions} WHERE context_id IN (SELECT context_id FROM {mentions} WHERE name = 'part/7') AND name <> 'part/7' GROUP BY name ORDER BY n DESC, name LIMIT 10""")(lambda m: R.affected(m, "part/7"))
query("GR20_node_ancestors", "nation", "region", sql="""SELECT concat('nation/', n_nationkey) AS id, concat('region/', n_regionkey) AS ancestor, 1 AS steps FROM {nation} UNION ALL SELECT concat('nation/', n_nationkey), 'world', 2 FROM {nation} UNION ALL SELECT concat('region/', r_regionkey), 'world', 1 FROM {region}""")(
    lambda n, r: G.ancestors(
        n.select(F.concat(F.lit("nation/"), "n_nationkey").alias("id"), F.concat(F.lit("region/"), "n_regionkey").alias("parent_id"))
        .unionByName(r.select(F.concat(F.lit("region/"), "r_regionkey").alias("id"), F.lit("world").alias("parent_id"))).unionByName(n.sparkSession.createDataFrame([("world", None)], "id string, parent_id string"))
    )
)
query("GR21_children", "nation", sql="SELECT n_regionkey AS parent, count(*) AS children, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY 1")(lambda n: n.groupBy(F.col("n_regionkey").alias("parent")).agg(F.count("*").alias("children"), F.concat_ws(",", F.sort_array(F.collect_list("n_name"))).alias("names")))
query("GR23_visual_edges", "entities", "related", sql="""SELECT a.name AS a, b.name AS b, 'shared_entity' AS kind FROM {entities} a JOIN {entities} b ON a.context_id = b.context_id AND a.name < b.name GROUP BY 1, 2 HAVING count(*) >= 2
    UNION SELECT least(source_id, target_id), greatest(source_id, target_id), 'cross_ref' FROM {related} WHERE source_id <> target_id""")(
    lambda e, r: G.cooccurrence(e).select("a", "b", F.lit("shared_entity").alias("kind")).unionByName(r.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.lit("cross_ref").alias("kind")).distinct())
)

_AGE = f"epoch(TIMESTAMP '{AS_OF}') - epoch(time) > 86400"
_MISSING = "(CAST(mode IS NULL AS INT) + CAST(genre IS NULL AS INT) + CAST(signal_type IS NULL AS INT) + CAST(format IS NULL AS INT) + CAST(structure IS NULL AS INT))"
query("SG04_failure_modes", "envelopes", sql=" UNION ALL ".join(f"SELECT id, '{name}' AS failure FROM {{envelopes}} WHERE {test}" for name, test in {
    "routing_failure": "source IS NULL", "bandwidth_overload": "strlen(data) > 100000", "fidelity_failure": "sn_ratio < 0.3", "variety_failure": f"{_MISSING} = 5", "structure_failure": f"{_MISSING} BETWEEN 1 AND 4", "genre_mismatch": "genre = 'note' AND contains(type, 'error')",
    "herniation_failure": "parent_id IS NOT NULL AND correlation_id IS NULL", "bridge_failure": "extensions > 20", "decay_failure": _AGE, "feedback_failure": "signal_type = 'direct' AND correlation_id IS NULL AND parent_id IS NULL", "adversarial_noise": "extensions > 50"}.items()))(
    lambda e: E.failures(e, AS_OF, F.when(F.contains("type", F.lit("error")), "alert").otherwise("chat"))
)
query("SG05_constraints", "envelopes", sql=f"""SELECT id, coalesce(strlen(data), 0) <= 8 AS shannon, {_MISSING} = 0 AS ashby, coalesce(contains(type, '.'), false) AND NOT (parent_id IS NOT NULL AND correlation_id IS NULL) AS beer, parent_id IS NOT NULL OR id IN (SELECT parent_id FROM {{envelopes}} WHERE parent_id IS NOT NULL) AS wiener FROM {{envelopes}}""")(
    lambda e: E.constraints(e, 8)
)
query("SG06_validation", "envelopes", sql="""SELECT id, 'type is required' AS error FROM {envelopes} WHERE coalesce(type, '') = '' UNION ALL SELECT id, 'specversion is required' FROM {envelopes} WHERE specversion = '' UNION ALL SELECT id, 'invalid mode: smell' FROM {envelopes} WHERE mode = 'smell'
    UNION ALL SELECT id, 'invalid signal_type: shout' FROM {envelopes} WHERE signal_type = 'shout' UNION ALL SELECT id, 'sn_ratio must be between 0 and 1' FROM {envelopes} WHERE sn_ratio < 0 OR sn_ratio > 1""")(E.errors)  # fmt: skip
query("SG08_chain_child", "envelopes", sql="SELECT id AS parent_id, coalesce(correlation_id, id) AS correlation_id FROM {envelopes}")(lambda e: e.select(*E.child()))
query("SX09_category", "seeded", sql="""SELECT doc_id, CASE WHEN contains(lower(text), 'contradict') THEN 'contradictions' WHEN contains(slug, 'decision') OR contains(lower(text), 'decision') THEN 'recent_actions' WHEN contains(slug, 'schedule') THEN 'schedules' WHEN contains(slug, 'owner') THEN 'ownership' WHEN contains(slug, 'spec') THEN 'professional_knowledge' ELSE 'unassigned' END AS category
    FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'Schedule-a' WHEN 1 THEN 'the-owner' WHEN 2 THEN 'spec-1' ELSE 'x' END AS name, lower(CASE doc_id % 5 WHEN 0 THEN 'Schedule-a' WHEN 1 THEN 'the-owner' WHEN 2 THEN 'spec-1' ELSE 'x' END) AS slug FROM {seeded})""")(
    lambda s: s.select("doc_id", E.category(F.when(F.col("doc_id") % 5 == 0, "Schedule-a").when(F.col("doc_id") % 5 == 1, "the-owner").when(F.col("doc_id") % 5 == 2, "spec-1").otherwise("x"), F.col("text")).alias("category"))
)

_DIR = "'\\x7b\\x7b\\s*([a-z_]+)\\s*:\\s*([^\\x7d]*?)\\s*\\x7d\\x7d'"
_PARTS = f"""WITH d AS (SELECT doc_id, body, regexp_extract_all(body, {_DIR}) AS raws, regexp_extract_all(body, {_DIR}, 1) AS verbs, regexp_extract_all(body, {_DIR}, 2) AS args, regexp_split_to_array(body, {_DIR}) AS segs FROM {{claims}}),
    n AS (SELECT *, list_transform(range(1, len(raws) + 1), lambda i: len(list_filter(verbs[1:i], lambda v: v = 'cite'))) AS ns FROM d)"""
query("WK04_render_markdown", "claims", sql=f"""{_PARTS} SELECT doc_id, concat(array_to_string(list_transform(range(1, len(raws) + 1), lambda i: concat(segs[i], CASE WHEN verbs[i] = 'cite' THEN concat(' [^', ns[i], ']') ELSE concat('`', raws[i], '`') END)), ''), segs[len(segs)],
    chr(10), chr(10), '---', chr(10), chr(10), array_to_string(list_transform(range(1, len(raws) + 1), lambda i: concat('[^', ns[i], ']: ', args[i])), chr(10))) AS text FROM n""")(W.rendered)  # fmt: skip
query("WK04_render_documents", "wiki", sql=f"""{_PARTS.replace('claims', 'wiki')} SELECT doc_id, concat('<context>', chr(10), array_to_string(list_transform(range(1, len(raws) + 1), lambda i: concat(segs[i], CASE WHEN verbs[i] = 'cite' THEN '' ELSE raws[i] END)), ''), segs[len(segs)],
    CASE WHEN ns[-1] > 0 THEN concat(chr(10), chr(10), array_to_string(list_transform(list_filter(range(1, len(raws) + 1), lambda i: verbs[i] = 'cite'), lambda i: concat('<document index="', ns[i], '" source="', args[i], '"></document>')), chr(10))) ELSE '' END, chr(10), '</context>') AS text FROM n""")(
    lambda w: W.rendered(w, "claude")
)

_CITE = "'\\x7b\\x7b\\s*cite\\s*:\\s*[^\\x7d]+?\\s*\\x7d\\x7d'"
_CLAIMS = f"""WITH c AS (SELECT doc_id, regexp_extract_all(body, {_CITE}) AS cites, regexp_extract_all(body, '\\x7b\\x7b\\s*cite\\s*:\\s*([^\\x7d]+?)\\s*\\x7d\\x7d', 1) AS uris, regexp_split_to_array(body, {_CITE}) AS segs FROM {{claims}}),
    p AS (SELECT doc_id, k, uris[k] AS uri, right(array_to_string(list_transform(range(1, k + 1), lambda i: concat(segs[i], CASE WHEN i < k THEN cites[i] ELSE '' END)), ''), 200) AS passage FROM (SELECT *, unnest(range(1, len(cites) + 1)) AS k FROM c)),
    l AS (SELECT doc_id, k, uri, unnest(string_split(passage, chr(10))) AS line FROM p), e AS (SELECT *, unnest(regexp_extract_all(line, '[*][*]([^*]+)[*][*]', 1)) AS entity FROM l),
    v AS (SELECT DISTINCT doc_id, lower(entity) AS entity, value, uri, k, CASE WHEN regexp_matches(value, '[0-9]+-[0-9]+-[0-9]+') THEN 'date' ELSE 'numeric' END AS attr FROM (SELECT *, unnest(regexp_extract_all(line, '[$][0-9,]+(?:[.][0-9]+)?[KMB]?|[0-9,]+(?:[.][0-9]+)?%|[0-9]+-[0-9]+-[0-9]+')) AS value FROM e))"""
query("WK07_contradictions", "claims", sql=f"{_CLAIMS} SELECT doc_id, entity, attr, count(DISTINCT lower(replace(value, ',', ''))) AS n FROM v GROUP BY 1, 2, 3 HAVING count(DISTINCT lower(replace(value, ',', ''))) >= 2")(W.contradictions)
query("WK08_resolved", "claims", sql=f"""{_CLAIMS} SELECT doc_id, entity, attr, max(struct_pack(k := k, value := value)).value AS value FROM v GROUP BY 1, 2, 3 HAVING count(DISTINCT lower(replace(value, ',', ''))) >= 2""")(W.resolved)
query("ME25_cited_claims", "claims", sql=f"""WITH l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM {{claims}}) SELECT doc_id, trim(regexp_replace(line, {_CITE}, '', 'g')) AS claim, unnest(regexp_extract_all(line, '\\x7b\\x7b\\s*cite\\s*:\\s*([^\\x7d]+?)\\s*\\x7d\\x7d', 1)) AS uri FROM l""")(
    lambda w: W.cited_claims(w)
)

query("SC34_memory_file", "journals", sql="""SELECT doc_id, substr(sha256(concat('decision:2024-01-0', 1 + doc_id % 9, ':Chosen ', doc_id)), 1, 16) AS id, 'decision' AS category, concat('2024-01-0', 1 + doc_id % 9) AS stamp, concat('Chosen ', doc_id) AS content FROM {documents}
    UNION ALL SELECT doc_id, substr(sha256(concat('lesson:later:', trim(text, ' ' || chr(9) || chr(10) || chr(13)))), 1, 16), 'lesson', 'later', trim(text, ' ' || chr(9) || chr(10) || chr(13)) FROM {documents}""")(D.memory_entries)  # fmt: skip
query("RT24_permitted_hits", "contexts", "holds", sql="""SELECT id, sn_ratio AS score FROM {contexts} WHERE id NOT IN (SELECT context_id FROM {holds}) OR id IN (SELECT context_id FROM {holds} WHERE principal IN ('user/3', 'user/7')) ORDER BY score DESC, id LIMIT 25""")(
    lambda c, h: A.top_permitted(c.select("id", F.col("sn_ratio").alias("score")), h.select(F.col("context_id").alias("id"), "principal"), ["user/3", "user/7"], 25)
)
query("ME17_recent_within_budget", "conversations", sql="SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS spent FROM {conversations}) WHERE spent <= 120")(
    lambda c: c.selectExpr("conv_id", "turn", "sum(length(text) div 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS spent").where("spent <= 120").select("conv_id", "turn")
)
query("PL11_confidence", "envelopes", sql=f"SELECT id, (5 - {_MISSING}) / 5.0 AS confidence FROM {{envelopes}}")(lambda e: e.select("id", ((5 - E.unresolved()) / 5.0).alias("confidence")))
query("GR11_payload", "edges", sql="SELECT 'node' AS kind, count(DISTINCT n) AS n FROM (SELECT source_id AS n FROM {edges} UNION ALL SELECT target_id FROM {edges}) UNION ALL SELECT relation, count(*) FROM {edges} GROUP BY relation")(
    lambda e: G.degrees(e).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "n").unionByName(e.groupBy(F.col("relation").alias("kind")).agg(F.count("*").alias("n")))
)
query("WS02_active_workspaces", "nation", "customer", sql="SELECT n_name AS workspace, count(c_custkey) AS members FROM {nation} LEFT JOIN {customer} ON n_nationkey = c_nationkey WHERE n_regionkey <> 2 GROUP BY n_name")(
    lambda n, c: n.where("n_regionkey <> 2").join(c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("members")), "n_nationkey", "left").select(F.col("n_name").alias("workspace"), F.coalesce("members", F.lit(0)).alias("members"))
)
query("RT30_profile", "contexts", "curated", "mentions", sql="""WITH n AS (SELECT node, arg_min(content, struct_pack(m := modified_at, i := id)) AS text FROM {contexts} WHERE node IS NOT NULL GROUP BY 1), d AS (SELECT node, arg_max(content, struct_pack(m := modified_at, i := id)) AS text FROM {contexts} WHERE node IS NOT NULL AND type = 'signal' GROUP BY 1),
    w AS (SELECT slug, arg_max(body, version) AS text FROM {curated} WHERE audience = 1 GROUP BY 1), a AS (SELECT id, title, modified_at FROM {contexts} ORDER BY modified_at DESC, id LIMIT 20), e AS (SELECT name, count(DISTINCT context_id) AS n FROM {mentions} GROUP BY 1 ORDER BY n DESC, name LIMIT 15)
    SELECT 'static' AS tier, row_number() OVER (ORDER BY node) AS place, node AS item, substr(text, 1, 400) AS text FROM n UNION ALL SELECT 'dynamic', row_number() OVER (ORDER BY node), node, substr(text, 1, 400) FROM d UNION ALL SELECT 'curated', row_number() OVER (ORDER BY slug), slug, substr(text, 1, 400) FROM w
    UNION ALL SELECT 'activity', row_number() OVER (ORDER BY modified_at DESC, id), id, title FROM a UNION ALL SELECT 'entities', row_number() OVER (ORDER BY n DESC, name), name, CAST(n AS VARCHAR) FROM e""")(lambda c, w, m: R.profile(c, w, m, 1, characters=400))  # fmt: skip
