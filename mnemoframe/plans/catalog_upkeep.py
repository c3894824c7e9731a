"""Queries of questions, routing, architectures, scenarios, wiki rules, journals and subject exports."""

from pyspark.sql import functions as F

from mnemoframe.functions.text import slug
from mnemoframe.operators import architecture, clusters, delivery, envelopes, files, governance, health, memory, pipeline, questions, retrieval, scenarios, sessions, signals, store, textindex, wiki
from mnemoframe.plans.catalog import query
from mnemoframe.plans.catalog_text import _case
from mnemoframe.sources.views import AS_OF

query("RT02_sanitised", "questions", sql="SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '*' ELSE concat(p_name, ' ', p_partkey, ' x') END AS query FROM {questions} JOIN (SELECT p_partkey, p_name FROM {part}) p USING (p_partkey)")(
    lambda q: q.select("p_partkey", questions.sanitised(F.col("query")).alias("query"))
)
query("RT17_ranked_pages", "part", sql="""WITH p AS (SELECT p_partkey, p_name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {part}),
    s AS (SELECT p_partkey, CASE WHEN slug = 'red-widget' THEN 100 WHEN starts_with(slug, 'red-widget') OR starts_with('red-widget', slug) THEN 50 WHEN length(slug) >= 4 AND (contains(slug, 'red-widget') OR contains('red-widget', slug)) THEN 10 ELSE 0 END
        + CASE WHEN lower(p_name) = 'red widget' THEN 40 WHEN contains(lower(p_name), 'red widget') THEN 10 ELSE 0 END AS score FROM p) SELECT p_partkey, score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 5""")(
    lambda p: retrieval.ranked_pages(p.select("p_partkey", slug(F.col("p_name")).alias("slug"), F.col("p_name").alias("title")), "Red Widget", "p_partkey")
)
query("RT19_analysed", "questions", "node_words", sql=r"""WITH q AS (SELECT p_partkey, text, lower(text) AS l, list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')) AS w FROM {questions}),
    n AS (SELECT p_partkey, list(node ORDER BY word) AS nodes FROM q JOIN {node_words} ON contains(l, word) GROUP BY 1),
    c AS (SELECT *, list_filter(w, lambda x: regexp_matches(x, '^[A-Z]') AND NOT list_contains(string_split('the a an is are was were what when where who how why did do does can could should would will about for with from this that these those it its and or but not', ' '), lower(x))) AS names FROM q)
    SELECT c.p_partkey, CASE WHEN regexp_matches(l, '\bvs\b|compare|difference') THEN 'comparison' WHEN regexp_matches(l, '\bwhen\b|\blast\b|\brecent\b|\btoday\b|\byesterday\b|\bthis week\b') THEN 'temporal' WHEN regexp_matches(l, '\bdecision\b|\bdecided\b|\bchose\b|\bwhy did\b') THEN 'decision'
        WHEN regexp_matches(l, '[?]|\bwhat\b|\bhow\b|\boverview\b|\btell me about\b') THEN 'exploration' ELSE 'lookup' END AS intent_type, list_filter(names, lambda x, i: NOT list_contains(names[:i - 1], x)) AS entities,
        CASE WHEN regexp_matches(l, '\brecent\b|\blatest\b|\btoday\b|\bthis week\b') THEN 'recent' WHEN regexp_matches(l, '\bold\b|\bfirst\b|\boriginal\b|\bhistory\b|\bback when\b') THEN 'historical' ELSE 'any' END AS temporal_hint,
        list_filter(coalesce(nodes, []), lambda x, i: NOT list_contains(nodes[:i - 1], x)) AS node_hints FROM c LEFT JOIN n USING (p_partkey)""")(lambda q, w: questions.analysed(q, w, "p_partkey"))  # fmt: skip
query("RT25_recalls", "people", "skills", sql="""WITH r AS (SELECT id, CAST(substr(id, 6) AS INT) AS k, display_name AS who FROM {people})
    SELECT id, CASE k % 6 WHEN 0 THEN concat('what actions, decisions, or commitments by ', who, CASE WHEN k % 4 = 0 THEN ' about plans' ELSE '' END) WHEN 1 THEN concat('who is the ', CASE WHEN k % 4 = 1 THEN 'owner' ELSE who END, ' of ', CASE WHEN k % 4 = 0 THEN 'plans' ELSE '' END, ', and how do I reach them')
        WHEN 2 THEN concat('when does ', CASE WHEN k % 4 = 0 THEN 'plans' ELSE '' END, ' happen, and what is the current schedule') WHEN 3 THEN concat('where is ', CASE WHEN k % 4 = 0 THEN 'plans' ELSE '' END, ' kept, owned, or discussed in the workspace')
        WHEN 4 THEN concat('what is ', who, ' currently committed to, and what tasks are open') END AS question FROM r""")(
    lambda p, s: p.withColumn("k", F.substring("id", 6, 20).cast("int")).select(
        "id",
        questions.recall_question(F.element_at(F.array(*map(F.lit, ("actions", "who", "when", "where", "owns", "other"))), F.col("k") % 6 + 1), F.when(~((F.col("k") % 6 == 1) & (F.col("k") % 4 == 1)), F.col("display_name")), F.when(F.col("k") % 4 == 0, "plans"), F.lit(None).cast("string")).alias("question"),
    )
)

_RULES = [("signal_type", "decide", "leads"), ("content", "invoice", "finance"), ("content", "budget", "finance"), ("signal_type", "commit", "team"), ("source_node", "fr", "france"), ("entity_mention", "Proposal", "sales"), ("genre", "spec", "makers"), ("other", "x", "nowhere")]
query("PL17_route", "seeded", sql="""WITH c AS (SELECT doc_id, text, lang AS node, @T AS signal_type, @G AS genre FROM {seeded}), r(field, pattern, destination) AS (VALUES ('signal_type', 'decide', 'leads'), ('content', 'invoice', 'finance'), ('content', 'budget', 'finance'), ('signal_type', 'commit', 'team'), ('source_node', 'fr', 'france'), ('content', 'proposal', 'sales'), ('genre', 'spec', 'makers')),
    m AS (SELECT doc_id, destination FROM c JOIN r ON (field = 'signal_type' AND signal_type = pattern) OR (field = 'content' AND contains(lower(text), pattern)) OR (field = 'source_node' AND node = pattern) OR (field = 'genre' AND genre = pattern)
        UNION SELECT doc_id, 'money' FROM c WHERE genre IN ('invoice', 'profit-loss', 'budget') UNION SELECT doc_id, 'people' FROM c WHERE genre = 'standup')
    SELECT doc_id, destination FROM m UNION ALL SELECT doc_id, 'inbox' FROM c WHERE doc_id NOT IN (SELECT doc_id FROM m)""".replace("@T", _case(pipeline.TYPES, "inform")).replace("@G", _case(pipeline.GENRES, "note")))(
    lambda d: pipeline.route(pipeline.classify(d).withColumn("node", F.col("lang")), d.sparkSession.createDataFrame(_RULES, "field string, pattern string, destination string"), "money", "people")
)
query("PL13_entities", "documents", "skills", sql="""WITH k AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(lower(text), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9ß]+'), lambda x: x <> '') AS t FROM {documents}),
    n AS (SELECT DISTINCT t[1] AS name FROM k WHERE doc_id % 3 = 0 AND length(t[1]) > 2 UNION SELECT DISTINCT concat(t[2], ' ', t[3]) FROM k WHERE len(t) > 2 UNION SELECT 'MIT License' UNION SELECT 'le'), g AS (SELECT doc_id, concat(' ', array_to_string(t, ' '), ' ') AS s FROM k)
    SELECT doc_id, name FROM g, n WHERE length(name) > 2 AND contains(s, concat(' ', lower(name), ' '))""")(lambda d, s: _entities(d))  # fmt: skip


def _entities(docs):
    """Names taken from the documents' own first words."""
    from mnemoframe.functions.durable import checkpointed
    from mnemoframe.functions.text import first_terms

    words = checkpointed(docs.select("doc_id", first_terms(F.col("text"), 3).alias("t")))
    names = words.where("doc_id % 3 = 0").select(F.try_element_at("t", F.lit(1)).alias("name")).where("name IS NOT NULL")
    names = names.unionByName(words.where("size(t) > 2").select(F.concat(F.element_at("t", 2), F.lit(" "), F.element_at("t", 3)).alias("name")))
    names = names.unionByName(docs.sparkSession.createDataFrame([("MIT License",), ("le",)], "name string")).distinct()
    return pipeline.mentioned(docs, names)


query("PL19_violations", "points", "fields", sql="""SELECT id, 'title' AS field, CASE WHEN id % 17 = 0 OR id % 4 = 0 THEN 'missing_required' ELSE 'incompatible' END AS problem FROM {points} WHERE architecture = 'media' AND (id % 17 = 0 OR id % 4 IN (0, 1))
    UNION ALL SELECT id, 'photo', CASE WHEN id % 17 = 0 THEN 'missing_required' ELSE 'incompatible' END FROM {points} WHERE architecture = 'media' AND (id % 17 = 0 OR id % 7 NOT IN (0, 2))
    UNION ALL SELECT id, 'title', 'incompatible' FROM {points} WHERE architecture = 'series' AND id % 17 <> 0 AND id % 4 = 1
    UNION ALL SELECT id, 'values', CASE WHEN id % 17 = 0 THEN 'missing_required' ELSE 'incompatible' END FROM {points} WHERE architecture = 'series' AND (id % 17 = 0 OR id % 5 = 0)
    UNION ALL SELECT id, 'links', CASE WHEN id % 17 = 0 THEN 'missing_required' ELSE 'incompatible' END FROM {points} WHERE architecture = 'series' AND (id % 17 = 0 OR id % 2 = 1)""")(architecture.violations)  # fmt: skip
query("PL20_processed", "points", "fields", sql="""WITH ok AS (SELECT *, id % 17 <> 0 AND CASE architecture WHEN 'media' THEN id % 4 IN (2, 3) AND id % 7 IN (0, 2) WHEN 'series' THEN id % 4 <> 1 AND id % 5 <> 0 AND id % 2 = 0 END AS fine FROM {points})
    SELECT id, 'title' AS field, 'word_count' AS processor, '3' AS output FROM ok WHERE fine AND architecture = 'media' UNION ALL SELECT id, 'title', 'fingerprint', sha256(concat('Title of ', id)) FROM ok WHERE fine AND architecture = 'series' AND id % 4 <> 0
    UNION ALL SELECT id, 'values', 'passthrough', '[1,2.5]' FROM ok WHERE fine AND architecture = 'series'""")(architecture.processed)  # fmt: skip

query("GR13_scenarios", "scenarios", "aliases", sql=r"""WITH l AS (SELECT id, text, lower(text) AS t, list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(regexp_replace(w, '[^A-Za-z'']', '', 'g'), '^[A-Z].') AND NOT list_contains(string_split('What If We Cancel Agency The A An Is Are Was Were How Why When Where Who Which', ' '), regexp_replace(w, '[^A-Za-z'']', '', 'g'))) AS w FROM {scenarios}),
    c AS (SELECT *, CASE WHEN regexp_matches(t, '\bleav(e|es|ing)\b|\bdeparture\b|\bwithout\b|\bfire[sd]?\b|\bremove[sd]?\b') THEN 'entity_removal' WHEN regexp_matches(t, '\bcancel\b|\bshut down\b|\bdrop\b|\bend\b|\bkill\b|\bclose\b|\bdissolve\b') THEN 'node_cancellation'
        WHEN regexp_matches(t, '\brevenue\b|\bmoney\b|\bdrops?\b|\blose\b|\bcut\b|\bincome\b') THEN 'revenue_change' WHEN regexp_matches(t, '\bstops?\b|\bno longer\b|\bpulls? out\b|\bbreaks?\b') THEN 'dependency_break' ELSE 'general' END AS change FROM l),
    n AS (SELECT id, arg_min(node, alias) AS node FROM l JOIN {aliases} ON contains(t, alias) GROUP BY id)
    SELECT id, change, CASE WHEN change IN ('entity_removal', 'dependency_break', 'general') THEN nullif(array_to_string(list_transform(w, lambda x: regexp_replace(x, '[^A-Za-z'' ]', '', 'g')), ' '), '') END AS entity, CASE WHEN change = 'revenue_change' THEN 'treasury' WHEN change <> 'entity_removal' THEN node END AS node FROM c LEFT JOIN n USING (id)""")(
    lambda s, a: scenarios.parse(s, a, "treasury")
)
_SCORED = "SELECT p.id, n.n_name AS node, CAST((p.id * 7 + n.n_nationkey * 3) % 11 AS DOUBLE) AS score FROM {scenarios} p JOIN {nation} n ON n.n_nationkey % 5 = p.id % 5"
query("GR18_recommendations", "scenarios", "aliases", "nation", sql=f"""WITH s AS ({_SCORED}), r AS (SELECT id, node, row_number() OVER (PARTITION BY id ORDER BY score DESC, node) AS k FROM s),
    t AS (SELECT id, list(node ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY id), c AS (SELECT x.id, CASE x.id % 7 WHEN 0 THEN 'entity_removal' WHEN 1 THEN 'node_cancellation' WHEN 2 THEN 'revenue_change' WHEN 3 THEN 'dependency_break' WHEN 6 THEN 'node_cancellation' ELSE 'general' END AS change,
        CASE x.id % 7 WHEN 0 THEN 'Alice Smith' WHEN 3 THEN 'Bob' WHEN 4 THEN 'Carol' END AS e, CASE x.id % 7 WHEN 1 THEN 'north' WHEN 3 THEN CASE WHEN contains(p_name, 'red') THEN 'red-hub' ELSE 'south-hub' END WHEN 4 THEN 'north' ELSE CASE WHEN contains(p_name, 'deal') THEN 'sales' WHEN contains(p_name, 'red') THEN 'red-hub' END END AS n, coalesce(top, []) AS top
        FROM {{scenarios}} x JOIN {{part}} ON p_partkey = x.id LEFT JOIN t ON t.id = x.id),
    l AS (SELECT id, CASE WHEN change = 'entity_removal' THEN list_concat([concat('Document ', e, '''s responsibilities and handoff all active work before departure')], list_transform(top, lambda x: concat('Review ', x, ' for contexts dependent on ', e, ' and assign a replacement owner')), [concat('Export ', e, '''s key decisions and context patterns to a reference document')])
        WHEN change = 'node_cancellation' AND n IS NOT NULL THEN list_concat([concat('Archive all ', n, ' contexts to prevent knowledge loss'), concat('Notify all stakeholders with active contexts in ', n), concat('Migrate cross-referenced signals from ', n, ' to relevant active nodes')], list_transform(top, lambda x: concat('Update ', x, ' contexts that reference ', n, ' to reflect the cancellation')))
        WHEN change = 'revenue_change' THEN list_concat(['Immediately update treasury context with revised projections', 'Audit all active revenue pipelines and re-prioritize based on new reality'], list_transform(top, lambda x: concat('Reassess ', x, ' budget and resource allocation in light of revenue change')))
        WHEN change = 'dependency_break' THEN list_concat([concat('Identify replacement for ', e, '''s role'), concat('Review dependency on ', n, ' and identify fallback paths'), 'Map all contexts that will break and prioritize remediation'], list_transform(top, lambda x: concat('Audit ', x, ' for broken dependencies')))
        ELSE list_concat([concat('Audit all affected contexts for dependencies on ', coalesce(e, n, 'this change'))], list_transform(top, lambda x: concat('Review ', x, ' node for exposure to ', coalesce(e, n, 'this change'))), ['Update signal files in affected nodes to reflect new state']) END AS texts FROM c)
    SELECT id, CAST(unnest(range(len(texts[:5]))) AS INT) AS place, unnest(texts[:5]) AS text FROM l""")(
    lambda s, a, n: scenarios.recommendations(scenarios.parse(s, a, "treasury"), s.join(n, F.col("n_nationkey") % 5 == F.col("id") % 5).select("id", F.col("n_name").alias("node"), ((F.col("id") * 7 + F.col("n_nationkey") * 3) % 11).cast("double").alias("score")))
)
query("GR13_what_if", "mentions", "contexts", sql="""WITH s AS (SELECT context_id FROM {mentions} WHERE name = 'part/7'), n AS (SELECT DISTINCT name FROM {mentions} WHERE context_id IN (SELECT context_id FROM s) AND name <> 'part/7'),
    c AS (SELECT context_id, count(*) * 0.5 AS score FROM {mentions} WHERE name IN (SELECT name FROM n) AND context_id NOT IN (SELECT context_id FROM s) GROUP BY 1), h AS (SELECT id, node FROM {contexts} WHERE node IS NOT NULL),
    b AS (SELECT node, round(sum(score), 3) AS score FROM c JOIN h ON id = context_id GROUP BY 1), a AS (SELECT node, count(*) AS n FROM {mentions} JOIN h ON id = context_id GROUP BY 1), g AS (SELECT node, count(*) AS n FROM s JOIN h ON id = context_id GROUP BY 1)
    SELECT a.node, CAST(coalesce(score, 0) AS DOUBLE) AS score, a.n AS edges_before, a.n - coalesce(g.n, 0) AS edges_after FROM a LEFT JOIN b ON b.node = a.node LEFT JOIN g ON g.node = a.node WHERE b.node IS NOT NULL OR g.node IS NOT NULL""")(
    lambda m, c: scenarios.what_if(m.select(F.col("context_id").alias("source_id"), F.col("name").alias("target_id"), F.lit("mentioned_in").alias("relation")), c.select("id", "node"), "entity_removal", "part/7", depth=2)
)

query("WK06_schema", "handbook", "page_rules", sql=r"""SELECT slug, audience, version, 'missing_section' AS issue, s AS detail FROM {handbook}, (VALUES ('Summary'), ('Related Pages')) r(s) WHERE NOT (version = 1 AND s = 'Summary') AND NOT (version = 2 AND s = 'Related Pages') UNION ALL SELECT slug, audience, version, CASE WHEN title IS NULL THEN 'missing_frontmatter' ELSE 'empty_frontmatter' END, 'title' FROM {handbook} WHERE coalesce(title, '') = ''
    UNION ALL SELECT slug, audience, version, 'missing_frontmatter', 'status' FROM {handbook} WHERE status IS NULL UNION ALL SELECT slug, audience, version, 'schema_size_exceeded', CAST(strlen(body) AS VARCHAR) FROM {handbook} WHERE strlen(body) > 70""")(
    lambda h, r: wiki.schema_issues(h.withColumn("key", F.struct("slug", "audience", "version")).withColumn("frontmatter", F.map_filter(F.create_map(F.lit("title"), "title", F.lit("status"), "status"), lambda k, v: v.isNotNull())), r, "key").select("key.*", "issue", "detail")
)
query("WK09_curated", "handbook", "new_citations", sql=r"""WITH p AS (SELECT * FROM {handbook} h WHERE version = (SELECT max(version) FROM {handbook} x WHERE x.slug = h.slug)), c AS (SELECT slug, string_agg(concat('- ', regexp_replace(left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 240), '\s+', ' ', 'g'), ' ', chr(123), chr(123), 'cite: ', uri, chr(125), chr(125)), chr(10) ORDER BY uri) AS lines FROM {new_citations} GROUP BY slug)
    SELECT slug, version + 1 AS version, concat(CASE WHEN version > 1 THEN split_part(body, concat(chr(10), chr(10), '##  new Signals'), 1) ELSE body END, chr(10), chr(10), '## New signals', chr(10), chr(10), lines, chr(10)) AS body, concat('deterministic:', audience) AS curated_by FROM p JOIN c USING (slug)""")(
    lambda h, c: wiki.curated(h.join(h.groupBy("slug").agg(F.max("version").alias("version")), ["slug", "version"]), c)
)
query("SX01_bounded_journal", "signals", sql="""WITH r AS (SELECT agent, id, count(*) OVER (PARTITION BY agent) AS n, row_number() OVER (PARTITION BY agent ORDER BY time, id) AS k FROM {signals}) SELECT agent, id FROM r WHERE k > CASE WHEN n <= 15 THEN 0 ELSE n - 15 END""")(
    lambda s: signals.journal_kept(s, 15)
)
query("SX01_coarse_journal", "signals", sql="""WITH r AS (SELECT type, id, count(*) OVER (PARTITION BY type) AS n, row_number() OVER (PARTITION BY type ORDER BY time, id) AS k FROM {signals}) SELECT type, id FROM r WHERE k > CASE WHEN n <= 100 THEN 0 ELSE (n - 100 + 9) // 10 * 10 END""")(
    lambda s: signals.journal_kept(s, 100, "type")
)
query("JN22_CO10_skills", "principal_skills", "skills", "people", sql="SELECT principal_id, kind, name AS skill, level FROM {principal_skills} s JOIN {skills} k ON s.skill_id = k.id JOIN {people} p ON s.principal_id = p.id WHERE level IN ('advanced', 'lead')")(lambda s, k, p: governance.skilled(s, k, p, "advanced"))
query("CO08_subject_export", "people", "contexts", "principal_skills", "holds", "orders", "customer", "signals", sql="""SELECT 'identity' AS section, 'user/7' AS item UNION ALL SELECT 'contexts', id FROM {contexts} WHERE seq % 50 = 7 UNION ALL SELECT 'mentions', id FROM (SELECT id FROM {contexts} WHERE contains(content, 'hation') ORDER BY id LIMIT 100) m
    UNION ALL SELECT DISTINCT 'skills', CAST(skill_id AS VARCHAR) FROM {principal_skills} WHERE principal_id = 'user/7' UNION ALL SELECT DISTINCT 'holds', context_id FROM {holds} WHERE principal = 'user/7' UNION ALL SELECT DISTINCT 'roles', o_orderpriority FROM {orders} WHERE o_custkey = 7
    UNION ALL SELECT DISTINCT 'memberships', c_mktsegment FROM {customer} WHERE c_custkey = 7 UNION ALL SELECT DISTINCT 'events', CAST(id AS VARCHAR) FROM {signals} WHERE agent = 'user/7'""")(
    lambda p, c, k, h, o, m, e: governance.subject_export("user/7", "hation", p, c.withColumn("created_by", F.concat(F.lit("user/"), F.col("seq") % 50)), {
        "skills": (k, "skill_id"), "holds": (h.withColumnRenamed("principal", "principal_id"), "context_id"), "roles": (o.withColumn("principal_id", F.concat(F.lit("user/"), "o_custkey")), "o_orderpriority"),
        "memberships": (m.withColumn("principal_id", F.concat(F.lit("user/"), "c_custkey")), "c_mktsegment"), "events": (e.withColumnRenamed("agent", "principal_id"), "id")})
)
query("HD12_reweave", "contexts", "mentions", sql=f"""WITH s AS (SELECT id, round(least((epoch(TIMESTAMP '{AS_OF}') - epoch(modified_at)) / 86400.0 / 30, 1), 4) AS staleness FROM {{contexts}} WHERE id IN (SELECT context_id FROM {{mentions}} WHERE name = 'part/7') OR list_contains(regexp_split_to_array(translate(lower(content), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9ß]+'), 'hation'))
    SELECT id, staleness FROM s WHERE staleness > 0 ORDER BY staleness DESC, id LIMIT 10""")(lambda c, m: health.reweave(c, m, "hation", "part/7", AS_OF))  # fmt: skip

query("ME23_frictions", "dialogues", sql=r"""WITH n AS (SELECT conv_id * 100 + turn AS id, text FROM {dialogues} ORDER BY conv_id DESC, turn DESC LIMIT 30), s AS (SELECT id, unnest(string_split(regexp_replace(text, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1))) AS c FROM n),
    t AS (SELECT id, regexp_replace(c, '^\s+|\s+$', '', 'g') AS content FROM s) SELECT id, content, CAST(0.5 AS DOUBLE) AS confidence FROM t WHERE length(content) >= 10 AND regexp_matches(lower(content), 'no not|actually|wrong|should have|instead|not that|mistake')""")(
    lambda d: sessions.frictions(d.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("content"), F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn")).alias("modified_at")), 30, 10_000).select("id", "content", "confidence")
)
query("HD13_rethought", "observed", "topics", sql="""WITH m AS (SELECT topic, id, category, content, confidence FROM {observed} JOIN {topics} ON coalesce(category = topic, false) OR contains(content, topic)),
    c AS (SELECT topic, category, count(*) AS n, sum(confidence) AS c FROM m GROUP BY 1, 2), t AS (SELECT topic, CAST(sum(n) AS BIGINT) AS n, round(sum(c), 2) AS total, string_agg(concat(n, ' ', coalesce(category, ''), ' observations'), ', ' ORDER BY category NULLS FIRST) AS parts FROM c GROUP BY 1),
    r AS (SELECT topic, content, row_number() OVER (PARTITION BY topic ORDER BY confidence DESC, id) AS r FROM m WHERE confidence >= 0.7), p AS (SELECT topic, list(content ORDER BY r) AS patterns FROM r WHERE r <= 5 GROUP BY 1)
    SELECT a.topic, CASE WHEN total >= 1.5 THEN 'synthesized' ELSE 'insufficient_evidence' END AS status, coalesce(n, 0) AS observations, coalesce(total, 0.0) AS total_confidence, CASE WHEN total >= 1.5 THEN concat('Rethink on "', a.topic, '": ', parts, '. Total confidence: ', total, '.') END AS summary,
        CASE WHEN total >= 1.5 THEN coalesce(patterns, []) END AS patterns FROM {topics} a LEFT JOIN t ON t.topic = a.topic LEFT JOIN p ON p.topic = a.topic""")(sessions.rethought)  # fmt: skip
query("SG07_round_trip", "envelopes", sql="""SELECT CAST(id AS VARCHAR) AS id, source, type, coalesce(specversion, '') AS specversion, CASE WHEN mode = 'linguistic' THEN mode END AS mode, genre, CASE WHEN signal_type IN ('direct', 'inform') THEN signal_type END AS signal_type, round(sn_ratio, 6) AS sn_ratio, CAST(correlation_id AS VARCHAR) AS correlation_id,
    date_trunc('second', time) AS time, data, CASE WHEN coalesce(source, '') = '' THEN 'source is required' WHEN coalesce(type, '') = '' THEN 'type is required' END AS error FROM {envelopes}""")(
    lambda e: envelopes.from_events(envelopes.to_events(e)).select("id", "source", "type", "specversion", "mode", "genre", "signal_type", F.round("sn_ratio", 6).alias("sn_ratio"), "correlation_id", F.to_timestamp_ntz(F.date_format("time", "yyyy-MM-dd HH:mm:ss")).alias("time"), "data", "error")
)
query("WK12_page_fields", "page_files", sql=r"""SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN concat('page-', doc_id) END AS slug, CASE doc_id % 4 WHEN 2 THEN 'sales' ELSE 'default' END AS audience, CAST(CASE doc_id % 4 WHEN 1 THEN doc_id ELSE 1 END AS INT) AS version, CASE doc_id % 4 WHEN 1 THEN 'Ann: B' END AS owner,
    CASE WHEN doc_id % 4 IN (1, 2) THEN regexp_replace(d.text, '^\n+', '') ELSE p.text END AS body FROM {page_files} p JOIN (SELECT doc_id, text FROM {documents}) d USING (doc_id)""")(
    lambda p: wiki.page_fields(p).select("doc_id", "slug", "audience", "version", F.try_element_at("frontmatter", F.lit("owner")).alias("owner"), "body")
)
query("WK12_page_file", "page_files", sql=r"""WITH f AS (SELECT doc_id, doc_id % 4 AS k, CASE WHEN doc_id % 4 IN (1, 2) THEN regexp_replace(d.text, '^\n+', '') ELSE p.text END AS body FROM {page_files} p JOIN (SELECT doc_id, text FROM {documents}) d USING (doc_id))
    SELECT doc_id, concat('---', chr(10), 'audience: ', CASE k WHEN 2 THEN 'sales' ELSE 'default' END, chr(10), CASE k WHEN 1 THEN concat('owner: Ann: B', chr(10), 'slug: page-', doc_id, chr(10)) ELSE '' END, 'version: ', CASE k WHEN 1 THEN doc_id ELSE 1 END, chr(10), '---', chr(10), chr(10), body) AS text FROM f""")(
    lambda p: wiki.page_fields(p).select("doc_id", wiki.page_file().alias("text"))
)
query("PL05_context_type", "sources", "page_files", sql="""SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'memory' WHEN doc_id % 11 = 4 THEN 'skill' WHEN doc_id % 5 = 3 THEN 'signal' WHEN doc_id % 11 = 5 THEN 'signal' ELSE 'resource' END AS type FROM {sources}""")(
    lambda s, p: s.select("doc_id", pipeline.context_type(F.when(F.col("doc_id") % 11 == 3, "x/_memories/a.md").when(F.col("doc_id") % 11 == 4, "_skills/b.md").when(F.col("doc_id") % 11 == 5, "org/c.md").when(F.col("doc_id") % 11 == 6, "else/c.md").otherwise(F.col("path")), F.when(F.col("doc_id") % 5 == 3, F.concat(F.lit("---\nmode: x\nnode : y\n---\n"), "text")).otherwise(F.col("text")), ["org/"]).alias("type"))
)
query("PL23_skeleton", "documents", "skeletons", sql=r"""SELECT doc_id, CASE WHEN lang = 'de' THEN concat('## Inhalt', chr(10), chr(10), t, chr(10), chr(10), '## Fragen', chr(10), chr(10), '## Folgen', chr(10), chr(10), '<!-- what follows -->', chr(10), chr(10)) ELSE concat('## Context', chr(10), chr(10), t, chr(10), chr(10), '## Route', chr(10), chr(10)) END AS structured
    FROM (SELECT doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM {documents})""")(lambda d, s: pipeline.with_skeleton(d.withColumn("genre", F.col("lang")), s).select("doc_id", "structured"))  # fmt: skip
query("ST03_sample", "contexts", sql="SELECT id, title, node FROM {contexts} WHERE content <> '' ORDER BY md5(concat('3:', id)), id LIMIT 40")(lambda c: store.sampled(c.where("content <> ''").select("id", "title", "node"), 40, seed=3))
query("ME28_collection", "memories", sql="SELECT id, category, content, root_id FROM {memories}")(
    lambda m: store.collection_from_json(store.collection_to_json(m.select(F.col("category").alias("collection"), F.col("id").alias("key"), "content", "root_id")), "collection string, content string, key string, root_id long")[0].select(F.col("key").alias("id"), F.col("collection").alias("category"), "content", "root_id")
)

query("FA04_rendered_for", "reports", sql=r"""WITH r AS (SELECT *, CAST(substr(id, 5) AS INT) % 4 AS who FROM {reports}), t AS (SELECT *, CASE who WHEN 0 THEN CASE WHEN genre IN ('fr', 'es') THEN genre ELSE 'fr' END WHEN 1 THEN 'note' WHEN 2 THEN CASE WHEN genre IN ('note', 'de') THEN genre ELSE 'note' END ELSE coalesce(genre, 'note') END AS target FROM r)
    SELECT id, concat('r', who) AS receiver, target AS genre, regexp_replace(CASE WHEN target = 'note' THEN concat('# Note: ', coalesce(title, ''), chr(10), chr(10), '**Node:** ', coalesce(node, ''), ' | **Genre:** ', coalesce(genre, ''), ' | **S/N:** ', sn_ratio, chr(10), chr(10), coalesce(description, ''))
        ELSE concat('# ', coalesce(title, ''), chr(10), chr(10), '> Genre: ', coalesce(genre, ''), ' | Node: ', coalesce(node, ''), ' | S/N: ', sn_ratio, chr(10), chr(10), content) END, '^\s+|\s+$', '', 'g') AS text FROM t""")(
    lambda r: delivery.rendered_for(r.withColumn("receiver", F.concat(F.lit("r"), F.substring("id", 5, 9).cast("int") % 4)), r.sparkSession.createDataFrame([("r0", 2, "es"), ("r0", 1, "fr"), ("r1", 1, "note"), ("r2", 1, "note"), ("r2", 2, "de")], "receiver string, place int, genre string"))
)
query("ME24_corrections", "seeded", sql=r"""WITH k AS (SELECT array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda w: w <> '')[:5], '_') AS key, concat('answer ', doc_id) AS a, doc_id // 3 AS t FROM {seeded}) SELECT key, arg_max(a, struct_pack(t := t, a := a)) AS correction, count(*) AS n FROM k GROUP BY key""")(
    lambda s: memory.learnt_corrections(s.select(F.col("text").alias("wrong"), F.concat(F.lit("answer "), F.col("doc_id").cast("string")).alias("right"), F.expr("doc_id div 3").alias("time")))
)
query("ME24_recoverable", "seeded", sql=r"""SELECT doc_id AS id, kind, CASE kind WHEN 'timeout_error' THEN 'wait' WHEN 'unknown_error' THEN 'look' END AS correction FROM (SELECT doc_id, CASE WHEN regexp_matches(m, 'file.*not found|no such file') THEN 'file_not_found' WHEN contains(m, 'permission denied') THEN 'permission_denied' WHEN contains(m, 'syntax error') THEN 'syntax_error' WHEN regexp_matches(m, 'import.*error|module.*not found') THEN 'import_error'
    WHEN regexp_matches(m, 'type.*error|expected.*got') THEN 'type_error' WHEN regexp_matches(m, 'network|connection.*refused') THEN 'network_error' WHEN contains(m, 'memory') THEN 'memory_error' WHEN contains(m, 'timeout') THEN 'timeout_error' WHEN regexp_matches(m, 'compilation.*error|compile.*fail') THEN 'compilation_error' WHEN regexp_matches(m, 'test.*fail') THEN 'test_failure' ELSE 'unknown_error' END AS kind FROM (SELECT doc_id, lower(text) AS m FROM {seeded}))""")(
    lambda s: memory.recoverable(s.select(F.col("doc_id").alias("id"), F.col("text").alias("message")), s.sparkSession.createDataFrame([("timeout_error", "wait"), ("unknown_error", "look"), ("other", "x")], "key string, correction string"))
)
query("JN26_clusters_of", "embeddings", sql="SELECT vec_id, label AS cluster, n AS members FROM {embeddings} JOIN (SELECT label, count(*) AS n FROM {embeddings} GROUP BY label) USING (label) WHERE vec_id % 5 = 0")(
    lambda e: clusters.clusters_of(e.where("vec_id % 5 = 0"), e.select("vec_id", F.col("label").alias("cluster")), e.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("members")))
)
query("JN27_matching_memories", "versions", sql="""WITH t AS (SELECT id, list_filter(regexp_split_to_array(translate(lower(content), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9ß]+'), lambda x: x <> '') AS w FROM {versions}) SELECT id, root_id, version FROM {versions} JOIN t USING (id) WHERE list_contains(w, 'de') AND list_contains(w, 'la')""")(
    lambda v: textindex.matches(textindex.build_index(v), "la de").join(v, "id").select("id", "root_id", "version")
)

query("SC16_indexable", "tree", sql="""SELECT path, size, CASE WHEN doc_id % 5 = 1 THEN 'binary' ELSE 'text' END AS kind FROM {tree} WHERE doc_id % 7 NOT IN (1, 3, 4) AND doc_id % 5 NOT IN (2, 3) AND size BETWEEN 1 AND 1048576""")(lambda t: files.indexable(t.select("path", "size")))
query("SC17_SC18_contexts", "tree", "folders", sql=r"""SELECT substr(sha256(path), 1, 32) AS id, concat('mem://', path) AS uri, CASE WHEN doc_id % 5 = 1 THEN 'resource' WHEN doc_id % 7 = 2 THEN 'memory' ELSE 'resource' END AS type, CASE doc_id % 7 WHEN 0 THEN 'north-hub' WHEN 5 THEN 'south-hub' ELSE 'inbox' END AS node, path,
    CASE WHEN doc_id % 5 <> 1 AND regexp_matches(content, '(?m)^# +.+$') THEN trim(regexp_extract(content, '(?m)^# +(.+)$', 1)) ELSE concat('my file ', doc_id, CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.pdf' ELSE '.txt' END) END AS title, CASE WHEN doc_id % 5 = 1 THEN '' ELSE content END AS content,
    CASE WHEN doc_id % 5 = 1 THEN concat('Binary file: my-file_', doc_id, '.pdf (.pdf, ', size, ' bytes)') END AS summary, CASE WHEN doc_id % 5 = 1 THEN CAST(0.3 AS DOUBLE) END AS sn_ratio FROM {tree} WHERE doc_id % 7 NOT IN (1, 3, 4) AND doc_id % 5 NOT IN (2, 3) AND size BETWEEN 1 AND 1048576""")(
    lambda t, f: files.file_contexts(files.indexable(t), f)
)
query("SV01_coverage", "sources", "surfaces", sql="SELECT count(*) AS total, count(*) FILTER (path IN (SELECT path FROM {surfaces})) AS covered, round(100.0 * count(*) FILTER (path IN (SELECT path FROM {surfaces})) / count(*), 1) AS percentage FROM (SELECT DISTINCT path FROM {sources})")(files.coverage)
query("SV02_verified", "surfaces", "sources", sql="""WITH r AS (SELECT DISTINCT spec, path, CASE spec WHEN 'spec-0' THEN 'claimed' WHEN 'spec-1' THEN 'linked' ELSE 'executed' END AS minimum FROM {surfaces}), c AS (SELECT *, CASE length(path) % 4 WHEN 0 THEN 'test_file' WHEN 1 THEN 'command' WHEN 2 THEN 'other' END AS kind FROM r),
    s AS (SELECT *, CASE WHEN kind IS NULL THEN 'none' WHEN kind = 'command' AND spec <> 'spec-2' THEN 'executed' WHEN kind = 'test_file' AND path IN (SELECT path FROM {sources}) THEN 'linked' ELSE 'claimed' END AS strength FROM c)
    SELECT spec, path AS requirement, coalesce(kind, 'none') AS kind, CASE WHEN kind IS NULL THEN '' ELSE path END AS target, strength, CASE strength WHEN 'none' THEN minimum = 'claimed' WHEN 'claimed' THEN minimum = 'claimed' WHEN 'linked' THEN minimum <> 'executed' ELSE true END AS meets_minimum FROM s""")(
    lambda u, s: files.verified(
        u.select("spec", F.col("path").alias("requirement"), F.when(F.col("spec") == "spec-0", "claimed").when(F.col("spec") == "spec-1", "linked").otherwise("executed").alias("minimum")).distinct(),
        u.where("length(path) % 4 < 3").select("spec", F.col("path").alias("requirement"), F.element_at(F.array(*map(F.lit, ("test_file", "command", "other"))), F.length("path") % 4 + 1).alias("kind"), F.col("path").alias("target"), (F.col("spec") != "spec-2").alias("passed")).distinct(), s,
    )
)
query("SC37_signal_files", "reports", "folders", "skeletons", sql=r"""WITH r AS (SELECT *, CAST(substr(id, 5) AS INT) AS k FROM {reports}), t AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'north-hub' ELSE 'other' END AS own, CASE WHEN k % 2 = 0 THEN ['south-hub', 'other'] ELSE [] END AS routed FROM r),
    e AS (SELECT *, own AS target FROM t UNION ALL SELECT *, 'south-hub' FROM t WHERE k % 2 = 0 UNION ALL SELECT *, 'other' FROM t WHERE k % 2 = 0 AND own <> 'other'),
    b AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS body, CASE target WHEN 'north-hub' THEN 'north' WHEN 'south-hub' THEN 'south' ELSE 'inbox' END AS folder, coalesce(title, 'Untitled') AS name FROM e)
    SELECT id, concat(folder, '/signals/2024-03-01-', regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '.md') AS path, target AS node, concat('---', chr(10), 'node: ', target, chr(10), 'title: ', name, chr(10), 'date: 2024-03-01', chr(10), CASE WHEN target <> own THEN concat('cross_ref_from: ', own, chr(10)) ELSE '' END,
        'signal:', chr(10), '  mode: linguistic', chr(10), '  genre: ', genre, chr(10), '  type: inform', chr(10), '  format: markdown', chr(10), '  sn_ratio: 0.6', chr(10), 'tiers:', chr(10), '  l0: "', summary, '"', chr(10), '  l1: "', coalesce(description, ''), '"', chr(10), 'entities:', chr(10), '  - Ann', chr(10), 'routed_to:', chr(10),
        CASE WHEN k % 2 = 0 THEN concat('  - south-hub', chr(10), '  - other', chr(10)) ELSE concat('  []', chr(10)) END, '---', chr(10), chr(10), '# ', name, chr(10), chr(10), CASE WHEN genre = 'de' THEN concat('## Inhalt', chr(10), chr(10), body, chr(10), chr(10), '## Fragen', chr(10), chr(10), '## Folgen', chr(10), chr(10), '<!-- what follows -->', chr(10), chr(10)) ELSE concat('## Context', chr(10), chr(10), body, chr(10), chr(10), '## Route', chr(10), chr(10)) END) AS content FROM b""")(
    lambda r, f, s: files.signal_files(
        r.withColumn("k", F.substring("id", 5, 9).cast("int")).select("id", F.when(F.col("k") % 3 == 0, "north-hub").otherwise("other").alias("node"), "title", "genre", F.lit(None).cast("string").alias("signal_type"), F.lit(None).cast("string").alias("mode"), "format", F.lit(None).cast("double").alias("sn_ratio"),
            F.lit("2024-03-01").alias("day"), "content", "summary", "description", F.array(F.lit("Ann")).alias("entities"), F.when(F.col("k") % 2 == 0, F.array(F.lit("south-hub"), F.lit("other"))).otherwise(F.array().cast("array<string>")).alias("routed_to")), f.select("node", "folder"), s)
)
