"""Queries of parsers, decomposition, store writes, imports and exports."""

from pyspark.sql import functions as F

from mnemoframe.operators import decompose as D
from mnemoframe.operators import store as S
from mnemoframe.plans.catalog import query

_LINES = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM {notes} WHERE text IS NOT NULL),
    o AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, starts_with(line, '```') AS fence,
        sum(CAST(starts_with(line, '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM l),
    k AS (SELECT *, CASE WHEN fence THEN 'fence' WHEN fences % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^#{1,6}\\s+.+$') THEN 'heading' WHEN trim(line, chr(9) || chr(13) || ' ') = '' THEN 'blank' ELSE 'content' END AS kind FROM o),
    r AS (SELECT *, sum(CAST(kind <> 'content' AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM k),
    p AS (SELECT doc_id, min(pos) AS pos, string_agg(line, chr(10) ORDER BY line_no) AS text FROM r WHERE kind = 'content' GROUP BY doc_id, run)"""
query("SC20_markdown", "notes", sql=_LINES + """ SELECT doc_id, 'heading' AS kind, pos AS "offset", strlen(line) AS length, regexp_extract(line, '^(#{1,6})\\s+(.+)$', 2) AS text, length(regexp_extract(line, '^(#{1,6})\\s+(.+)$', 1)) AS level, NULL AS language FROM k WHERE kind = 'heading'
    UNION ALL SELECT doc_id, 'paragraph', pos, strlen(text), text, NULL, NULL FROM p
    UNION ALL SELECT b.doc_id, 'code_block', b.pos, strlen(t), t, NULL, trim(substr(b.line, 4)) FROM k b JOIN (SELECT doc_id, fences, string_agg(line, chr(10) ORDER BY line_no) AS t FROM k WHERE kind = 'code' GROUP BY 1, 2) c ON b.doc_id = c.doc_id AND b.fences = c.fences AND b.fence
        WHERE EXISTS (SELECT 1 FROM k e WHERE e.doc_id = b.doc_id AND e.fence AND e.fences = b.fences + 1)""")(D.markdown)  # fmt: skip
query("SC21_paragraphs", "documents", sql="""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {documents} WHERE text IS NOT NULL),
    o AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - strlen(line) - 1 AS pos, trim(line, chr(9) || chr(13) || ' ') = '' AS blank FROM l), r AS (SELECT *, sum(CAST(blank AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM o)
    SELECT doc_id, min(pos) AS "offset", sum(strlen(line) + 1) - 1 AS length FROM r WHERE NOT blank GROUP BY doc_id, run""")(D.paragraphs)  # fmt: skip
query("SC22_csv", "sheets", sql="""SELECT doc_id, CAST(1 AS INT) AS row_no, name, trim(split_part(string_split(text, chr(10))[2], ',', CAST(i AS INT))) AS value FROM {sheets}, (VALUES (1, 'key'), (2, 'status'), (3, 'total')) v(i, name)
    UNION ALL SELECT doc_id, 2, name, CASE i WHEN 1 THEN 'x' WHEN 2 THEN 'y' END FROM {sheets}, (VALUES (1, 'key'), (2, 'status'), (3, 'total')) v(i, name)""")(D.csv_rows)  # fmt: skip
query("SC23_json_keys", "signals", sql="""SELECT id, key, strpos(data, concat('"', key, '"')) - 1 AS "offset" FROM (SELECT id, data, unnest(json_keys(data)) AS key FROM {signals})""")(lambda s: D.json_keys(s, "data"))
query("PL06_frontmatter", "notes", sql="""SELECT doc_id, 'title' AS name, concat('Note ', doc_id) AS value FROM {notes} WHERE starts_with(text, '---' || chr(10) || 'title:')
    UNION ALL SELECT n.doc_id, 'mode', d.lang FROM {notes} n JOIN {documents} d ON n.doc_id = d.doc_id WHERE starts_with(n.text, '---' || chr(10) || 'title:')""")(D.frontmatter)  # fmt: skip
query("PL12_title", "notes", sql="SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^# +.+$') THEN trim(regexp_extract(text, '(?m)^# +(.+)$', 1)) ELSE concat('note-', doc_id) END AS title FROM {notes}")(
    lambda n: n.select("doc_id", D.title(F.col("text"), F.concat(F.lit("note-"), "doc_id")).alias("title"))
)
query("PL12_summary", "notes", sql="""WITH f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(?m)^#+ +', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM {notes})
    SELECT doc_id, CASE WHEN length(t) <= 500 THEN t ELSE concat(regexp_replace(substr(t, 1, 500), ' [^ ]*$', ''), '…') END AS summary FROM f""")(lambda n: n.select("doc_id", D.summary(F.col("text")).alias("summary")))  # fmt: skip
query("PL15_evidence", "notes", sql="SELECT doc_id, nullif(trim(regexp_extract(text, '(?s)(.{0,20}(?:deadline|First).{0,60})', 1), chr(9) || chr(10) || chr(13) || ' '), '') AS evidence FROM {notes}")(lambda n: n.select("doc_id", D.evidence(F.col("text"), "deadline|First").alias("evidence")))
_TREE = _LINES + """, s AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos FROM k WHERE kind = 'heading' UNION SELECT doc_id, 0 FROM {notes} WHERE strlen(text) > 0)),
    sec AS (SELECT s.doc_id, row_number() OVER w - 1 AS idx, pos, coalesce(lead(pos) OVER w, strlen(n.text)) - pos AS size FROM s JOIN {notes} n ON s.doc_id = n.doc_id WINDOW w AS (PARTITION BY s.doc_id ORDER BY pos)),
    par AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx, (SELECT max(idx) FROM sec WHERE sec.doc_id = p.doc_id AND sec.pos <= p.pos) AS parent, pos, strlen(text) AS size FROM p),
    win AS (SELECT doc_id, idx AS parent, pos, size, unnest(range(0, greatest(CAST(ceil((size - 256) / 1792.0) AS BIGINT), 1))) AS i FROM par),
    tree AS (SELECT doc_id, 'document' AS scale, 0 AS idx, NULL AS parent, 0 AS "offset", strlen(coalesce(text, '')) AS length FROM {notes} UNION ALL SELECT doc_id, 'section', idx, 0, pos, size FROM sec UNION ALL SELECT doc_id, 'paragraph', idx, parent, pos, size FROM par
        UNION ALL SELECT doc_id, 'chunk', row_number() OVER (PARTITION BY doc_id ORDER BY pos + i * 1792, parent) - 1, parent, pos + i * 1792, least(2048, size - i * 1792) FROM win)"""
query("PL01_PL02_decompose", "notes", sql=f"{_TREE} SELECT * FROM tree")(D.decompose)
query("PL22_scale_counts", "notes", sql=f"{_TREE} SELECT d.doc_id, sc.scale, count(t.doc_id) AS n FROM {{notes}} d CROSS JOIN (VALUES ('document'), ('section'), ('paragraph'), ('chunk')) sc(scale) LEFT JOIN tree t ON t.doc_id = d.doc_id AND t.scale = sc.scale GROUP BY 1, 2")(lambda n: D.scale_counts(D.decompose(n)))
query("PL22_children", "notes", sql=f"{_TREE} SELECT s.doc_id, s.idx, count(*) AS children, sum(p.length) AS bytes FROM tree s JOIN tree p ON s.doc_id = p.doc_id AND p.scale = 'paragraph' AND p.parent = s.idx WHERE s.scale = 'section' GROUP BY 1, 2")(
    lambda n: D.decompose(n).where("scale = 'paragraph'").groupBy("doc_id", F.col("parent").alias("idx")).agg(F.count("*").alias("children"), F.sum("length").alias("bytes"))
)

query("SC12_by_node", "contexts", sql="SELECT id, modified_at FROM {contexts} WHERE node = 'src8' AND type = 'signal'")(lambda c: S.by_node(c, "src8", "signal").select("id", "modified_at"))
query("SC13_upsert", "contexts", sql="""SELECT id, node, title FROM {contexts} WHERE seq % 10 <> 0 UNION ALL SELECT id, 'moved', concat('x ', title) FROM {contexts} WHERE seq % 10 = 0 UNION ALL SELECT 'ctx-new', 'moved', 'NEW'""")(
    lambda c: S.upsert(c, c.where("seq % 10 = 0").withColumns({"node": F.lit("moved"), "title": F.concat(F.lit("x "), "title")}).select("id", "node", "title").unionByName(c.sparkSession.createDataFrame([("ctx-new", "moved", "NEW")], "id string, node string, title string")), "id").select("id", "node", "title")
)
query("SC14_upsert_chunks", "chunks", sql="SELECT context_id, idx, CASE WHEN idx = 1 THEN 'reflect' ELSE intent END AS intent FROM {chunks}")(
    lambda c: S.upsert(c, c.where("idx = 1").withColumn("intent", F.lit("reflect")), "context_id", "idx").select("context_id", "idx", "intent")
)
query("SC15_delete", "contexts", sql="SELECT id FROM {contexts} WHERE type <> 'memory'")(lambda c: S.delete(c, c.where("type = 'memory'"), "id").select("id"))
query("SC30_payloads", "payloads", sql="""SELECT substr(sha256(concat('web:', external_id)), 1, 16) AS id, coalesce(title, 'Untitled') AS title, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS content,
    TRY_CAST(created AS TIMESTAMP) AS time, coalesce(url, concat('web://', external_id)) AS source_uri FROM {payloads}""")(lambda p: S.payload_signals(p, "web"))  # fmt: skip
query("SC31_import", "contexts", "documents", sql="""SELECT count(DISTINCT doc_id) FILTER (doc_id % 2 = 0 AND trim(text) <> '') AS imported, (SELECT count(*) FROM {documents}) - count(DISTINCT doc_id) FILTER (doc_id % 2 = 0 AND trim(text) <> '') - count(*) FILTER (text IS NULL OR trim(text) = '') AS skipped,
    count(*) FILTER (text IS NULL OR trim(text) = '') AS errors FROM {documents}""")(
    lambda c, d: S.import_counts(c.where("seq % 2 = 1").select(F.col("seq").alias("doc_id")), d, "doc_id", "text")
)
query("SC32_export", "nation", sql="""SELECT 'nation' AS kind, concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '","n_regionkey":', n_regionkey, '}') AS line FROM {nation}""")(lambda n: S.exported(n, "nation"))

query("ME02_update", "versions", sql="""SELECT id, version, parent_id, is_latest AND NOT (is_latest AND root_id % 2 = 0) AS is_latest FROM {versions} UNION ALL SELECT concat(id, '-v', version + 1), version + 1, id, true FROM {versions} WHERE is_latest AND root_id % 2 = 0""")(
    lambda v: S.updated(v, v.where("is_latest AND root_id % 2 = 0").select("id", F.upper("content").alias("content")))[0].select("id", "version", "parent_id", "is_latest")
)
query("ME02_relations", "versions", sql="SELECT concat(id, '-v', version + 1) AS source_id, id AS target_id, 'updates' AS relation FROM {versions} WHERE is_latest AND root_id % 2 = 0")(
    lambda v: S.updated(v, v.where("is_latest AND root_id % 2 = 0").select("id", F.upper("content").alias("content")))[1]
)
query("ME03_extend", "versions", sql="SELECT id, version, parent_id, is_latest FROM {versions} UNION ALL SELECT concat(id, '-extends'), 1, id, true FROM {versions} WHERE version = 1")(
    lambda v: S.derived(v, v.where("version = 1").select(F.col("id").alias("parent_id"), F.lit("note").alias("content")), "extends")[0].select("id", "version", "parent_id", "is_latest")
)
query("ME04_forget", "versions", sql="SELECT id, audience = 'system' AS is_forgotten, CASE WHEN audience = 'system' THEN 'old' END AS reason FROM {versions}")(
    lambda v: S.forgotten(v, v.where("audience = 'system'").select("id", F.lit("old").alias("reason"))).select("id", "is_forgotten", "reason")
)
query("ME04_delete", "versions", sql="SELECT id FROM {versions} WHERE root_id NOT IN (SELECT root_id FROM {versions} WHERE version = 3)")(lambda v: S.delete(v, v.where("version = 3"), "root_id").select("id"))
query("ME27_session_summary", "conversations", sql="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM {conversations} WHERE role <> 'system')
    SELECT conv_id, n, greatest(n - 5, 0) AS omitted, string_agg(substr(text, 1, 200), chr(10) ORDER BY turn) FILTER (r <= 5) AS tail FROM r GROUP BY conv_id, n""")(
    lambda c: (
        c.where("role <> 'system'").selectExpr("*", "row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r", "count(*) OVER (PARTITION BY conv_id) AS n").where("r <= 5").groupBy("conv_id", "n")
        .agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("turn", F.substring("text", 1, 200).alias("t")))), lambda x: x["t"])).alias("tail"))
        .select("conv_id", "n", F.greatest(F.col("n") - 5, F.lit(0)).alias("omitted"), "tail")
    )
)
