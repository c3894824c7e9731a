"""Queries of graph analytics and relational read models."""

from pyspark.sql import functions as F

from mnemoframe.operators import graph as G
from mnemoframe.plans.catalog import query

query("AG03_graph_stats", "edges", sql="SELECT relation, count(*) AS n, sum(weight) AS weight FROM {edges} GROUP BY relation")(lambda e: e.groupBy("relation").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")))
query("AG04_top_entities", "edges", sql="SELECT target_id AS entity, count(*) AS n FROM {edges} WHERE relation = 'mentioned_in' GROUP BY 1 ORDER BY n DESC, entity LIMIT 20")(
    lambda e: G.top(e.where("relation = 'mentioned_in'").groupBy(F.col("target_id").alias("entity")).agg(F.count("*").alias("n")), "n", 20, "entity")
)
_ENDS = "SELECT source_id AS node FROM {edges} UNION ALL SELECT target_id FROM {edges}"
query("AG05_degree", "edges", sql=f"SELECT node, count(*) AS degree FROM ({_ENDS}) GROUP BY node")(G.degrees)
query("AG06_hubs", "edges", sql=f"""WITH d AS (SELECT node, count(*) AS degree FROM ({_ENDS}) GROUP BY node), f AS (SELECT avg(degree) AS m, stddev_pop(degree) AS s FROM d)
    SELECT node, degree, round((degree - m) / s, 2) AS sigma FROM d, f WHERE degree > m + 2 * s AND s > 0""")(G.hubs)  # fmt: skip
query("AG07_cooccurrence", "entities", sql="SELECT a.name AS a, b.name AS b, count(*) AS shared FROM {entities} a JOIN {entities} b ON a.context_id = b.context_id AND a.name < b.name GROUP BY 1, 2 HAVING count(*) >= 2")(G.cooccurrence)
query("AG08_entity_summary", "entities", sql="SELECT name, count(*) AS n FROM {entities} GROUP BY name ORDER BY n DESC, name LIMIT 200")(lambda e: G.top(e.groupBy("name").agg(F.count("*").alias("n")), "n", 200, "name"))
query("AG09_node_summary", "contexts", sql="SELECT node, count(*) AS n, max(modified_at) AS latest FROM {contexts} GROUP BY node")(lambda c: c.groupBy("node").agg(F.count("*").alias("n"), F.max("modified_at").alias("latest")))
query("AG10_relation_edges", "edges", sql="SELECT source_id, relation, count(*) AS shared FROM {edges} GROUP BY 1, 2 ORDER BY shared DESC, source_id, relation LIMIT 800")(
    lambda e: G.top(e.groupBy("source_id", "relation").agg(F.count("*").alias("shared")), "shared", 800, "source_id", "relation")
)
query("AG11_entity_connections", "entities", sql="SELECT name, count(DISTINCT context_id) AS contexts FROM {entities} GROUP BY name ORDER BY contexts DESC, name LIMIT 300")(
    lambda e: G.top(e.groupBy("name").agg(F.countDistinct("context_id").alias("contexts")), "contexts", 300, "name")
)
query("AG12_inventory", "contexts", sql="SELECT node, type, count(*) AS n FROM {contexts} GROUP BY node, type")(lambda c: c.groupBy("node", "type").agg(F.count("*").alias("n")))
query("AG13_memory_genres", "contexts", sql="SELECT genre, count(*) AS n FROM {contexts} WHERE type = 'memory' GROUP BY genre")(lambda c: c.where("type = 'memory'").groupBy("genre").agg(F.count("*").alias("n")))
query("AG33_breakdowns", "contexts", sql="""SELECT 'node' AS kind, node AS value, count(*) AS n FROM {contexts} GROUP BY node UNION ALL SELECT 'type', type, count(*) FROM {contexts} GROUP BY type
    UNION ALL SELECT 'genre', genre, count(*) FROM {contexts} GROUP BY genre""")(
    lambda c: c.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("node", "type", "genre")))).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
)
query("AG35_shared_entity_weights", "entities", sql="SELECT a.context_id AS a, b.context_id AS b, round(least(count(*) / 5.0, 1.0), 2) AS weight FROM {entities} a JOIN {entities} b ON a.name = b.name AND a.context_id < b.context_id GROUP BY 1, 2 HAVING count(*) >= 2")(G.shared_entity_weights)
query("AG25_series_features", "events", sql="""SELECT user_id, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, max_by(value, event_id) AS last,
    CASE WHEN covar_pop(CAST(event_id AS DOUBLE), value) > 0 THEN 'up' WHEN covar_pop(CAST(event_id AS DOUBLE), value) < 0 THEN 'down' ELSE 'flat' END AS trend FROM {events} GROUP BY user_id""")(
    lambda e: e.groupBy("user_id").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("deviation"), F.max_by("value", "event_id").alias("last"),
        F.when(F.covar_pop(F.col("event_id").cast("double"), "value") > 0, "up").when(F.covar_pop(F.col("event_id").cast("double"), "value") < 0, "down").otherwise("flat").alias("trend"),
    )
)
query("AG30_mean_vector", "embeddings", sql="SELECT label, i - 1 AS place, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM {embeddings}, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i")(
    lambda e: e.select("label", F.posexplode("embedding").alias("place", "v")).groupBy("label", F.col("place").cast("long").alias("place")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))
)
query("AG22_scale_stats", "documents", sql="SELECT CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 3000 THEN 'medium' ELSE 'long' END AS scale, count(*) AS n, round(avg(length(text)), 4) AS mean_length FROM {documents} GROUP BY 1")(
    lambda d: d.withColumn("size", F.length("text")).groupBy(F.when(F.col("size") < 500, "short").when(F.col("size") < 3000, "medium").otherwise("long").alias("scale")).agg(F.count("*").alias("n"), F.round(F.avg("size"), 4).alias("mean_length"))
)
query("AG36_activity_heatmap", "signals", sql="SELECT type, date_trunc('week', time) AS week, count(*) AS n FROM {signals} GROUP BY 1, 2")(
    lambda s: s.groupBy("type", F.date_trunc("week", "time").alias("week")).agg(F.count("*").alias("n"))
)
query("AG37_activity_timeline", "signals", sql="SELECT agent, count(*) AS n FROM {signals} WHERE time >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '14' DAY GROUP BY agent")(
    lambda s: s.where("time >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '14' DAY").groupBy("agent").agg(F.count("*").alias("n"))
)

query("JN09_unlinked_parts", "part", "edges", sql="SELECT p_partkey FROM {part} WHERE concat('part/', p_partkey) NOT IN (SELECT source_id FROM {edges} UNION SELECT target_id FROM {edges})")(
    lambda p, e: p.withColumn("node", F.concat(F.lit("part/"), "p_partkey")).join(e.select(F.explode(F.array("source_id", "target_id")).alias("node")), "node", "left_anti").select("p_partkey")
)
query("JN13_semi_join", "edges", sql="SELECT DISTINCT source_id FROM {edges} e WHERE EXISTS (SELECT 1 FROM {edges} f WHERE f.target_id = e.source_id)")(
    lambda e: e.select("source_id").distinct().join(e.select(F.col("target_id").alias("source_id")), "source_id", "left_semi")
)
query("JN15_edges_touching_node", "edges", "part", sql="SELECT DISTINCT source_id, target_id, relation FROM {edges}, (SELECT concat('part/', p_partkey) AS node FROM {part} WHERE p_brand = 'Brand#12') WHERE node = source_id OR node = target_id")(
    lambda e, p: (
        e.select("source_id", "target_id", "relation", F.explode(F.array("source_id", "target_id")).alias("node"))
        .join(p.where("p_brand = 'Brand#12'").select(F.concat(F.lit("part/"), "p_partkey").alias("node")), "node", "left_semi").drop("node").distinct()
    )
)
query("JN16_scalar_counts", "customer", "orders", sql="SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS n FROM {customer}")(
    lambda c, o: c.join(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))
)
query("JN17_names_per_context", "entities", sql="SELECT context_id, string_agg(name, ',' ORDER BY name) AS names FROM {entities} GROUP BY context_id")(
    lambda e: e.groupBy("context_id").agg(F.concat_ws(",", F.sort_array(F.collect_list("name"))).alias("names"))
)
query("JN18_latest_version", "memories", sql="SELECT root_id, version, id FROM (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY version DESC) AS r FROM {memories}) WHERE r = 1")(
    lambda m: m.groupBy("root_id").agg(F.max("version").alias("version"), F.max_by("id", "version").alias("id"))
)
query("JN20_three_hops", "entities", sql="""SELECT x.name AS seed, z.name AS target, count(*) AS n FROM {entities} x JOIN {entities} y ON x.context_id = y.context_id AND x.name <> y.name
    JOIN {entities} z ON y.context_id = z.context_id AND z.name <> y.name AND z.name <> x.name GROUP BY 1, 2 ORDER BY n DESC, seed, target LIMIT 20""")(lambda e: G.top(G.three_hops(e), "n", 20, "seed", "target"))  # fmt: skip
query("JN28_shared_contexts", "entities", sql="SELECT context_id FROM {entities} WHERE name IN ('part/260', 'part/625') GROUP BY context_id HAVING count(DISTINCT name) = 2")(lambda e: G.shared_contexts(e, "part/260", "part/625"))
query("JN29_recent_names", "entities", "orders", sql="""SELECT name, count(*) AS n, max(o_orderdate) AS latest FROM {entities} JOIN {orders} ON context_id = o_orderkey WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'
    GROUP BY name ORDER BY n DESC, name LIMIT 8""")(
    lambda e, o: G.top(e.join(o.where("o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'").withColumnRenamed("o_orderkey", "context_id"), "context_id").groupBy("name").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest")), "n", 8, "name")
)
query("JN23_roles_direct_or_group", "customer", "nation", sql="""SELECT c_custkey AS principal, concat('direct:', c_mktsegment) AS role FROM {customer} UNION SELECT c_custkey, concat('group:', n_name) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""")(
    lambda c, n: c.select(F.col("c_custkey").alias("principal"), F.concat(F.lit("direct:"), "c_mktsegment").alias("role")).unionByName(
        c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("principal"), F.concat(F.lit("group:"), "n_name").alias("role"))
    ).distinct()
)

query("GR03_edges_for", "edges", sql="SELECT source_id, target_id, relation, weight FROM {edges} WHERE source_id = 'order/388' AND relation = 'mentioned_in'")(lambda e: e.where("source_id = 'order/388' AND relation = 'mentioned_in'"))
query("GR05_subgraph", "edges", sql="SELECT source_id, target_id, relation, weight FROM {edges} WHERE source_id = 'order/388' OR target_id = 'order/388'")(lambda e: G.subgraph(e, "order/388"))
query("GR06_open_triangles", "trade", sql="""SELECT a.source_id AS a, a.target_id AS b, b.target_id AS c FROM {trade} a JOIN {trade} b ON a.source_id = b.source_id AND a.target_id < b.target_id
    WHERE NOT EXISTS (SELECT 1 FROM {trade} t WHERE (t.source_id = a.target_id AND t.target_id = b.target_id) OR (t.source_id = b.target_id AND t.target_id = a.target_id))""")(G.open_triangles)  # fmt: skip
_REACH = """WITH RECURSIVE both_ways AS (SELECT source_id AS a, target_id AS b FROM {edges} UNION SELECT target_id, source_id FROM {edges}),
    reach(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM both_ways
        UNION (SELECT r.node, min(n.component) FROM recurring.reach r JOIN both_ways ON a = r.node JOIN reach n ON n.node = b WHERE n.component < r.component GROUP BY r.node))"""
query("GR07_components", "edges", sql=f"{_REACH} SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM reach")(G.components)
query("GR09_reflection_gaps", "entities", "related", sql="""SELECT a.name AS a, b.name AS b, count(*) AS shared, least(count(*) / 5.0, 1.0) AS confidence FROM {entities} a JOIN {entities} b ON a.context_id = b.context_id AND a.name < b.name
    WHERE NOT EXISTS (SELECT 1 FROM {related} WHERE (source_id = a.name AND target_id = b.name) OR (source_id = b.name AND target_id = a.name)) GROUP BY 1, 2 HAVING count(*) >= 2""")(G.reflection_gaps)  # fmt: skip
_BFS = """WITH RECURSIVE both_ways AS (SELECT source_id AS a, target_id AS b FROM {edges} UNION SELECT target_id, source_id FROM {edges}),
    walk AS (SELECT 'order/388' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON node = a WHERE depth < 3)"""
_SEED = ("node string",)
query("GR12_impact", "edges", sql=f"{_BFS} SELECT node, min(depth) AS depth FROM walk GROUP BY node")(lambda e: G.impact(e, e.sparkSession.createDataFrame([("order/388",)], *_SEED)))
query("GR15_impact_scores", "edges", sql=f"""{_BFS}, v AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
    ends AS (SELECT source_id AS f, target_id AS t, relation FROM {{edges}} UNION ALL SELECT target_id, source_id, relation FROM {{edges}})
    SELECT y.node, y.depth, round(sum(CAST(CASE relation WHEN 'mentioned_in' THEN 1.0 ELSE 0.6 END AS DOUBLE) * CASE y.depth WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.25 END), 3) AS score
    FROM ends JOIN v x ON f = x.node JOIN v y ON t = y.node WHERE y.depth > 0 AND x.depth = y.depth - 1 GROUP BY 1, 2""")(
    lambda e: G.impact_scores(e, e.sparkSession.createDataFrame([("order/388",)], *_SEED))
)
query("GR22_causality_chain", "signals", sql="""WITH RECURSIVE up AS (SELECT id, parent_id AS ancestor, 1 AS steps FROM {signals} WHERE parent_id IS NOT NULL UNION ALL SELECT up.id, s.parent_id, up.steps + 1 FROM up JOIN {signals} s ON up.ancestor = s.id WHERE s.parent_id IS NOT NULL)
    SELECT id, ancestor, steps FROM up""")(lambda s: G.ancestors(s.select("id", "parent_id")))  # fmt: skip
query("ST02_scale_order", "documents", sql="SELECT source, doc_id, r FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN length(text) < 500 THEN 2 WHEN length(text) < 3000 THEN 1 ELSE 0 END, doc_id) AS r FROM {documents}) WHERE r <= 5")(
    lambda d: d.selectExpr("source", "doc_id", "row_number() OVER (PARTITION BY source ORDER BY CASE WHEN length(text) < 500 THEN 2 WHEN length(text) < 3000 THEN 1 ELSE 0 END, doc_id) AS r").where("r <= 5").selectExpr("source", "doc_id", "CAST(r AS BIGINT) AS r")
)
query("ST04_page", "contexts", sql="SELECT id, modified_at FROM {contexts} ORDER BY modified_at DESC, id LIMIT 50 OFFSET 20")(lambda c: c.select("id", "modified_at").orderBy(F.desc("modified_at"), "id").offset(20).limit(50))
query("ST05_recent", "signals", sql="SELECT id, time, type FROM {signals} ORDER BY time DESC, id DESC LIMIT 100")(lambda s: s.select("id", "time", "type").orderBy(F.desc("time"), F.desc("id")).limit(100))
query("ST07_set_difference", "quads", sql="SELECT s FROM {quads} WHERE p = 'inNation' EXCEPT SELECT o FROM {quads} WHERE p = 'placedBy'")(lambda q: q.where("p = 'inNation'").select("s").subtract(q.where("p = 'placedBy'").select(F.col("o").alias("s"))))
query("ST08_count_windows", "signals", sql="""SELECT agent, win, count(*) AS n, round(avg(latency), 6) AS mean FROM (SELECT agent, latency, (row_number() OVER (PARTITION BY agent ORDER BY id) - 1) // 5 AS win FROM {signals}) GROUP BY 1, 2""")(
    lambda s: s.selectExpr("agent", "latency", "(row_number() OVER (PARTITION BY agent ORDER BY id) - 1) div 5 AS win").groupBy("agent", "win").agg(F.count("*").alias("n"), F.round(F.avg("latency"), 6).alias("mean"))
)
query("ST10_edge_pairs", "trade", sql="SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM {trade} WHERE source_id <> target_id")(
    lambda t: t.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
)
