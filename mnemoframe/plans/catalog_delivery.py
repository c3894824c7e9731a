"""Queries of the text index, parsers, sessions, clusters and delivery."""

from pyspark.sql import functions as F

from mnemoframe.operators import clusters, delivery, parsers, sessions, textindex
from mnemoframe.plans.catalog import ORACLES, query
from mnemoframe.plans.catalog_text import _BM25
from mnemoframe.sources.views import oracle

query("RT01_indexed", "contexts", sql=f"{_BM25} SELECT id, round(bm25, 6) AS bm25 FROM hits")(lambda c: textindex.matches(textindex.build_index(c), 'hation "rerean"').select("id", F.round("bm25", 6).alias("bm25")))

#: Porter's steps over the distinct terms, each as one table; m0, m1 and v are the measure's patterns.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_STEMS = r"""
    raw AS (SELECT id, list_filter(regexp_split_to_array(translate(lower(content), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9ß]+'), lambda x: x <> '') AS terms FROM {versions}),
    t0 AS (SELECT DISTINCT term FROM (SELECT unnest(terms) AS term FROM raw UNION ALL SELECT unnest(['des', 'eens']) AS term)),
    t1 AS (SELECT term, regexp_replace(term, '^y', 'Y') AS w FROM t0),
    t2 AS (SELECT term, CASE WHEN w LIKE '_%sses' OR w LIKE '_%ies' THEN w[:-3] WHEN w LIKE '_%s' AND w[-2] <> 's' AND length(w) > 2 THEN w[:-2] ELSE w END AS w FROM t1),
    t3 AS (SELECT term, w, CASE WHEN w LIKE '_%eed' THEN 'eed' WHEN w LIKE '_%ed' THEN 'ed' WHEN w LIKE '_%ing' THEN 'ing' ELSE '' END AS x FROM t2),
    t4 AS (SELECT term, w, x, w[:length(w) - length(x)] AS s FROM t3),
    t5 AS (SELECT term, CASE WHEN x = 'eed' THEN CASE WHEN regexp_matches(s, '@M0') THEN s || 'ee' ELSE w END WHEN x = '' OR NOT regexp_matches(s, '@HV') THEN w
        WHEN regexp_matches(s, '(at|bl|iz)$') THEN s || 'e' WHEN length(s) > 1 AND s[-1] = s[-2] AND NOT contains('aeiouylsz', s[-1]) THEN s[:-2] WHEN regexp_matches(s, '@SH') THEN s || 'e' ELSE s END AS w FROM t4),
    t6 AS (SELECT term, CASE WHEN w LIKE '_%y' AND regexp_matches(w[:-2], '@HV') THEN w[:-2] || 'i' ELSE w END AS w FROM t5),
    two(o, n) AS (VALUES ('ational', 'ate'), ('tional', 'tion'), ('enci', 'ence'), ('anci', 'ance'), ('izer', 'ize'), ('logi', 'log'), ('bli', 'ble'), ('alli', 'al'), ('entli', 'ent'), ('eli', 'e'), ('ousli', 'ous'), ('ization', 'ize'), ('ation', 'ate'),
        ('ator', 'ate'), ('alism', 'al'), ('iveness', 'ive'), ('fulness', 'ful'), ('ousness', 'ous'), ('aliti', 'al'), ('iviti', 'ive'), ('biliti', 'ble')),
    three(o, n) AS (VALUES ('icate', 'ic'), ('ative', ''), ('alize', 'al'), ('iciti', 'ic'), ('ical', 'ic'), ('ful', ''), ('ness', '')),
    four(o) AS (VALUES ('al'), ('ance'), ('ence'), ('er'), ('ic'), ('able'), ('ible'), ('ant'), ('ement'), ('ment'), ('ent'), ('sion'), ('tion'), ('ou'), ('ism'), ('ate'), ('iti'), ('ous'), ('ive'), ('ize')),
    h2 AS (SELECT term, arg_max(o, length(o)) AS o, arg_max(n, length(o)) AS n FROM t6 JOIN two ON ends_with(w, o) AND length(w) > length(o) GROUP BY term),
    t7 AS (SELECT t6.term, CASE WHEN o IS NOT NULL AND regexp_matches(w[:length(w) - length(o)], '@M0') THEN w[:length(w) - length(o)] || n ELSE w END AS w FROM t6 LEFT JOIN h2 ON t6.term = h2.term),
    h3 AS (SELECT term, arg_max(o, length(o)) AS o, arg_max(n, length(o)) AS n FROM t7 JOIN three ON ends_with(w, o) AND length(w) > length(o) GROUP BY term),
    t8 AS (SELECT t7.term, CASE WHEN o IS NOT NULL AND regexp_matches(w[:length(w) - length(o)], '@M0') THEN w[:length(w) - length(o)] || n ELSE w END AS w FROM t7 LEFT JOIN h3 ON t7.term = h3.term),
    h4 AS (SELECT term, max(length(o)) - max(CASE WHEN o IN ('sion', 'tion') THEN 1 ELSE 0 END) AS k FROM t8 JOIN four ON ends_with(w, o) AND length(w) > length(o) GROUP BY term),
    t9 AS (SELECT t8.term, CASE WHEN k IS NOT NULL AND regexp_matches(w[:length(w) - k], '@M1') THEN w[:length(w) - k] ELSE w END AS w FROM t8 LEFT JOIN h4 ON t8.term = h4.term),
    t10 AS (SELECT term, CASE WHEN w LIKE '_%e' AND (regexp_matches(w[:-2], '@M1') OR (regexp_matches(w[:-2], '@M0') AND NOT regexp_matches(w[:-2], '@SH'))) THEN w[:-2] ELSE w END AS w FROM t9),
    stems AS (SELECT term, CASE WHEN length(term) < 3 OR length(term) > 64 THEN term ELSE regexp_replace(CASE WHEN w LIKE '%ll' AND regexp_matches(w, '@M1') THEN w[:-2] ELSE w END, '^Y', 'y') END AS stem FROM t10)"""
_STEMS = _STEMS.replace("@M0", f"^({_C})?{_V}{_C}").replace("@M1", f"^({_C})?{_V}{_C}{_V}{_C}").replace("@HV", f"^({_C})?[aeiouy]").replace("@SH", f"^{_C}[aeiouy][^aeiouwxy]$")
query("RT26_memory_search", "versions")(lambda m: textindex.search_memories(m, textindex.build_index(m, stems=True), "(des) eens*", audience="assistant", include_old=True, limit=None).select("id", F.round("bm25", 6).alias("bm25")))
ORACLES["RT26_memory_search"] = oracle(f"""WITH {_STEMS},
    p AS (SELECT id, len(terms) AS size, stem, count(*) AS tf FROM (SELECT id, terms, unnest(terms) AS term FROM raw) x JOIN stems USING (term) GROUP BY ALL),
    f AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM raw), q AS (SELECT DISTINCT stem FROM stems WHERE term IN ('des', 'eens')),
    d AS (SELECT stem, count(*) AS df FROM p JOIN q USING (stem) GROUP BY 1),
    s AS (SELECT id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS bm25, count(*) AS k FROM p JOIN d USING (stem), f GROUP BY 1)
    SELECT id, round(bm25, 6) AS bm25 FROM s JOIN {{versions}} v USING (id) WHERE k = (SELECT count(*) FROM q) AND v.audience = 'assistant'""".replace("{{versions}}", "{versions}"))  # fmt: skip

query("SC26_definitions", "sources", sql=r"""WITH l AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {sources}),
    o AS (SELECT *, CAST(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - strlen(line) - 1 AS BIGINT) AS pos FROM l),
    x AS (SELECT *, regexp_extract(line, '^[ \t\r\f\v]*(defp?|function|func|fn|class|module|struct|interface|public[ \t]+(?:class|interface|static)|private[ \t]+def|impl)[ \t\r\f\v]+([A-Za-z0-9_.:]+)', ['k', 'name']) AS m FROM o)
    SELECT doc_id, CASE lower(regexp_extract(path, '[.]([^.]*)$', 1)) WHEN 'py' THEN 'python' WHEN 'ex' THEN 'elixir' WHEN 'go' THEN 'go' ELSE 'text' END AS language, m.k AS keyword, m.name AS name, trim(line, concat(' ', chr(9), chr(13))) AS text, pos AS "offset", CAST(strlen(line) AS BIGINT) AS length FROM x WHERE m.name <> ''""")(
    parsers.definitions
)
query("SC24_yaml", "configs", sql="""WITH c AS (SELECT x.c_custkey, x.text, k.c_mktsegment, k.c_nationkey FROM {configs} x JOIN {customer} k ON x.c_custkey = k.c_custkey), g AS (SELECT * FROM c WHERE c_custkey % 10 <> 0),
    r AS (SELECT c_custkey, 'customer.key' AS path, 'integer' AS kind, CAST(c_custkey AS VARCHAR) AS value, 'key: ' AS mark FROM g UNION ALL SELECT c_custkey, 'customer.segment', 'string', c_mktsegment, 'segment: ' FROM g
        UNION ALL SELECT c_custkey, 'customer.nation.id', 'integer', CAST(c_nationkey AS VARCHAR), 'id: ' FROM g UNION ALL SELECT c_custkey, 'customer.nation.active', 'boolean', 'true', 'active: ' FROM g
        UNION ALL SELECT c_custkey, 'tags[0]', 'string', 'a', 'a, "b' FROM g UNION ALL SELECT c_custkey, 'tags[1]', 'string', 'b, c', '"b, c' FROM g UNION ALL SELECT c_custkey, 'tags[2]', 'float', '1.5', '1.5]' FROM g
        UNION ALL SELECT c_custkey, 'steps[0].name', 'string', 'one', 'name: one' FROM g UNION ALL SELECT c_custkey, 'steps[0].note', 'string', concat('two', chr(10), '  lines', chr(10)), 'note: |' FROM g
        UNION ALL SELECT c_custkey, 'steps[1]', 'null', '', '- ~' FROM g UNION ALL SELECT c_custkey, 'empty', 'null', '', 'empty:' FROM g)
    SELECT c_custkey, path, kind, value, CAST(strpos(text, CASE WHEN path = 'customer.nation.id' THEN 'id: ' ELSE mark END) - 1 AS BIGINT) AS "offset", CAST(NULL AS VARCHAR) AS warning FROM r JOIN (SELECT c_custkey, text FROM g) USING (c_custkey)
    UNION ALL SELECT c_custkey, '', 'raw', text, 0, 'tab in the indentation of line 2' FROM c WHERE c_custkey % 10 = 0""")(lambda c: parsers.yaml_leaves(c, "c_custkey"))  # fmt: skip
query("SC24_top_keys", "configs", sql="""SELECT c_custkey, unnest(['customer', 'tags', 'steps', 'empty']) AS key, CAST(strpos(text, concat(unnest(['customer', 'tags', 'steps', 'empty']), ':')) - 1 AS BIGINT) AS "offset" FROM {configs} WHERE c_custkey % 10 <> 0""")(
    lambda c: parsers.top_level_keys(c, "c_custkey")
)
query("SC25_html", "pages")(lambda p: parsers.html_pages(p))

query("ME20_compress", "conversations", sql=r"""WITH s AS (SELECT conv_id, count(*) > 20 OR sum(length(text)) > 10000 AS compressed, string_split(string_agg(concat('**', upper(role), ':** ', text), chr(10) ORDER BY turn), chr(10)) AS lines FROM {conversations} GROUP BY 1),
    k AS (SELECT conv_id, compressed, array_to_string(list_filter(lines, lambda x: NOT compressed OR NOT starts_with(x, '**ASSISTANT:**') OR regexp_matches(lower(x), 'decided|action|todo|will|[$]|deal|close|agreed|confirmed|scheduled|deadline|[0-9]') OR regexp_matches(x, '\b[A-Z][a-z]+\b')
        OR regexp_matches(x, '\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b', 'i')), chr(10)) AS t FROM s),
    r AS (SELECT conv_id, compressed, CASE WHEN compressed AND length(t) > 5000 THEN concat(t[:2000], chr(10), chr(10), '... [compressed] ...', chr(10), chr(10), t[-2000:]) ELSE t END AS transcript FROM k)
    SELECT conv_id, compressed, CAST(length(transcript) AS BIGINT) AS characters, transcript FROM r""")(sessions.compress)  # fmt: skip
_PEOPLE = ["Alice", "Bob", "Carol Jones"]
query("ME21_extracted", "dialogues", sql=r"""WITH s AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1))) AS c, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)), 1) AS n FROM {dialogues}),
    t AS (SELECT conv_id, turn, n, regexp_replace(c, '^\s+|\s+$', '', 'g') AS content FROM s), u AS (SELECT *, list_filter(['Alice', 'Bob', 'Carol Jones'], lambda p: contains(lower(content), lower(p))) AS known FROM t WHERE length(content) >= 10),
    e AS (SELECT *, list_filter(regexp_extract_all(content, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b', 1), lambda x: len(list_filter(string_split(x, ' '), lambda w: NOT list_contains(string_split('The A An And But Or For Nor So Yet Both Either Neither Not Only Such As At By In Of On To Up Via With', ' '), w))) > 0) AS names FROM u),
    a AS (SELECT *, list_filter(list_concat(known, names), lambda x, i: NOT list_contains(list_concat(known, names)[:i - 1], x)) AS entities FROM e),
    m AS (SELECT conv_id, turn, n, content, entities, 0 AS rank, 'decision' AS category, 0.8 AS confidence FROM a WHERE regexp_matches(lower(content), 'decided|agreed|confirmed|chose|we''ll go with|the plan is')
        UNION ALL SELECT conv_id, turn, n, content, entities, 1, 'fact', 0.6 FROM a WHERE regexp_matches(content, '\b[A-Z][a-zA-Z]+\s+(?:is|has|costs?|wants?|needs?|owns?|runs?|leads?|manages?)\s+\S')
        UNION ALL SELECT conv_id, turn, n, content, known, 2, 'relationship', 0.7 FROM a WHERE len(known) >= 2
        UNION ALL SELECT conv_id, turn, n, content, entities, 3, 'preference', 0.7 FROM a WHERE regexp_matches(lower(content), 'prefer|always use|never use|better to|should always')),
    d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(content) ORDER BY rank, turn, n) AS copy FROM m), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank, turn, n) AS place FROM d WHERE copy = 1 AND confidence >= 0.7)
    SELECT conv_id, CAST(place AS INT) AS place, category, content, CAST(confidence AS DOUBLE) AS confidence, entities FROM p WHERE place <= 20""")(lambda d: sessions.extracted_memories(d, _PEOPLE))  # fmt: skip
query("CL03_rebuild", "embeddings")(lambda e: clusters.rebuild(e, threshold=0.58))

query("RT21_receivers", "principals", sql="""SELECT id, coalesce(kind, 'unknown') AS kind, coalesce(audience, 'default') AS audience, coalesce(bandwidth, CASE WHEN kind IN ('agent', 'service') THEN 'large' ELSE 'medium' END) AS bandwidth,
    CAST(CASE coalesce(bandwidth, CASE WHEN kind IN ('agent', 'service') THEN 'large' ELSE 'medium' END) WHEN 'small' THEN 1500 WHEN 'medium' THEN 6000 ELSE 24000 END AS BIGINT) AS token_budget, coalesce(format, CASE kind WHEN 'agent' THEN 'claude' WHEN 'service' THEN 'openai' ELSE 'markdown' END) AS format,
    coalesce(genre, CASE kind WHEN 'user' THEN 'brief' WHEN 'agent' THEN 'spec' ELSE 'note' END) AS genre, 'linguistic' AS mode, 'en-US' AS locale FROM {principals}""")(
    lambda p: delivery.receivers(p.select("id", "kind", F.map_filter(F.create_map(*(x for k in ("bandwidth", "format", "audience", "genre") for x in (F.lit(k), F.col(k)))), lambda k, v: v.isNotNull()).alias("metadata")))
)
query("RT22_envelopes", "packed", sql="""WITH r AS (SELECT answer_id, format, place, title, trim(content, concat(' ', chr(10))) AS content, nullif(uri, '') AS uri, row_number() OVER w AS i, CASE WHEN nullif(uri, '') IS NOT NULL THEN count(nullif(uri, '')) OVER w END AS c FROM {packed} WINDOW w AS (PARTITION BY answer_id ORDER BY place)),
    x AS (SELECT *, concat('### ', coalesce(title, concat('Chunk ', i)), CASE WHEN uri IS NULL THEN '' WHEN format = 'plain' THEN concat('  [', c, ']') WHEN format = 'markdown' THEN concat('  [^', c, ']') ELSE ' ' END, chr(10), chr(10), content) AS section,
        CASE format WHEN 'plain' THEN concat('[', c, '] ', uri) WHEN 'markdown' THEN concat('[^', c, ']: ', uri) WHEN 'claude' THEN concat('<document index="', c, '" source="', uri, '"></document>') WHEN 'openai' THEN concat('{{"role":"system","content":"Source ', c, ': ', uri, '"}}') END AS listed FROM r),
    g AS (SELECT answer_id, format, string_agg(section, concat(chr(10), chr(10)) ORDER BY place) AS body, CASE WHEN format = 'openai' THEN array_to_string(list(listed ORDER BY place) FILTER (uri IS NOT NULL), ',') ELSE array_to_string(list(listed ORDER BY place) FILTER (uri IS NOT NULL), chr(10)) END AS cites, list(uri ORDER BY place) FILTER (uri IS NOT NULL) AS uris FROM x GROUP BY 1, 2)
    SELECT answer_id, format, CASE format WHEN 'plain' THEN concat(body, CASE WHEN cites IS NULL THEN '' ELSE concat(chr(10), chr(10), 'Sources:', chr(10), cites) END) WHEN 'markdown' THEN concat(body, CASE WHEN cites IS NULL THEN '' ELSE concat(chr(10), chr(10), '---', chr(10), chr(10), cites) END)
        WHEN 'claude' THEN concat('<context>', chr(10), body, CASE WHEN cites IS NULL THEN '' ELSE concat(chr(10), chr(10), cites) END, chr(10), '</context>') WHEN 'openai' THEN concat('[{{"role":"system","content":', CAST(to_json(body) AS VARCHAR), '}}', CASE WHEN cites IS NULL THEN '' ELSE concat(',', cites) END, ']') ELSE body END AS body,
        list_filter(coalesce(uris, []), lambda u, k: NOT list_contains(uris[:k - 1], u)) AS sources FROM g""".replace("{{", "{").replace("}}", "}"))(delivery.envelopes)  # fmt: skip
query("RT23_reencoded", "reports", sql=r"""WITH b AS (SELECT *, coalesce(strftime(modified_at, '%Y-%m-%d'), 'unknown') AS d, coalesce(title, '') AS t, coalesce(description, summary) AS about, coalesce(description, '') AS note, list_transform(regexp_extract_all(content, '(?m)^[-*][ \t]+(\S.*)$', 1), lambda x: trim(x)) AS bullets,
        list_transform(regexp_extract_all(content, '(?m)^\d+\.[ \t]+(\S.*)$', 1), lambda x: trim(x)) AS numbers, CASE WHEN doc % 3 = 0 THEN concat('Reach ', doc) END AS aim, CASE WHEN doc % 7 = 0 THEN concat('Call ', doc) END AS cta, CASE WHEN doc % 7 = 0 THEN 'Must fit' END AS req FROM (SELECT *, CAST(substr(id, 5) AS BIGINT) AS doc FROM {reports})),
    p AS (SELECT *, coalesce(regexp_replace(CASE WHEN aim IS NOT NULL THEN regexp_extract(content, '(?s)##\s+Objective\s*\n(.*?)(?:\n##|\z)', 1) END, '^\s+|\s+$', '', 'g'), about) AS objective, CASE WHEN len(bullets) = 0 THEN concat('- ', summary) ELSE array_to_string(list_transform(bullets[:5], lambda x: concat('- ', x)), chr(10)) END AS messages,
        coalesce(cta, concat('Review and respond to: ', t)) AS call, coalesce(req, CASE WHEN len(numbers) = 0 THEN '- No explicit requirements found in source signal.' ELSE array_to_string(list_transform(numbers[:10], lambda x: concat('1. ', x)), chr(10)) END) AS wanted, regexp_replace(content, '^\s+|\s+$', '', 'g') AS body FROM b),
    o AS (SELECT id, CASE target_genre WHEN 'brief' THEN concat('# Brief: ', t, chr(10), chr(10), '**Node:** ', node, ' | **Date:** ', d, chr(10), chr(10), '## Objective', chr(10), objective, chr(10), chr(10), '## Key Messages', chr(10), messages, chr(10), chr(10), '## Call to Action', chr(10), call)
        WHEN 'spec' THEN concat('# Spec: ', t, chr(10), chr(10), '**Node:** ', node, ' | **Genre:** ', genre, ' | **Date:** ', d, chr(10), chr(10), '## Goal', chr(10), objective, chr(10), chr(10), '## Requirements', chr(10), wanted, chr(10), chr(10), '## Constraints', chr(10), '- Source node: ', node, chr(10), '- Format: ', format, chr(10), chr(10), '## Acceptance Criteria', chr(10), 'Signal has been classified and routed. S/N ratio: ', sn_ratio)
        WHEN 'runbook' THEN concat('# Runbook: ', t, chr(10), chr(10), '**Node:** ', node, ' | **Date:** ', d, chr(10), chr(10), '## Procedure', chr(10), chr(10), CASE WHEN len(bullets) > 0 THEN array_to_string(list_transform(bullets, lambda x, i: concat(i, '. ', x)), chr(10)) WHEN strlen(body) > 300 THEN concat(body[:300], '...') ELSE body END)
        WHEN 'note' THEN concat('# Note: ', t, chr(10), chr(10), '**Node:** ', node, ' | **Genre:** ', genre, ' | **S/N:** ', sn_ratio, chr(10), chr(10), note) WHEN 'pitch' THEN concat('# ', t, chr(10), chr(10), '## Problem', chr(10), objective, chr(10), chr(10), '## Solution', chr(10), messages, chr(10), chr(10), '## Next Step', chr(10), call) END AS text FROM p)
    SELECT id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM o""")(delivery.reencoded)  # fmt: skip
query("WS01_settings", "configs", "defaults", sql="""WITH g AS (SELECT x.c_custkey, k.c_mktsegment, k.c_nationkey FROM {configs} x JOIN {customer} k ON x.c_custkey = k.c_custkey WHERE x.c_custkey % 10 <> 0),
    r AS (SELECT c_custkey, unnest(['customer.key', 'customer.segment', 'customer.nation.id', 'customer.nation.active', 'tags[0]', 'tags[1]', 'tags[2]', 'steps[0].name', 'steps[0].note', 'steps[1]', 'empty']) AS path, unnest(['integer', 'string', 'integer', 'boolean', 'string', 'string', 'float', 'string', 'string', 'null', 'null']) AS kind,
        unnest([CAST(c_custkey AS VARCHAR), c_mktsegment, CAST(c_nationkey AS VARCHAR), 'true', 'a', 'b, c', '1.5', 'one', concat('two', chr(10), '  lines', chr(10)), '', '']) AS value FROM g)
    SELECT c_custkey, path, kind, value FROM r UNION ALL SELECT c_custkey, path, kind, value FROM g, {defaults} WHERE path IN ('customer.extra', 'limits.most') UNION ALL SELECT c_custkey, path, kind, value FROM {configs}, {defaults} WHERE c_custkey % 10 = 0""")(
    lambda c, d: parsers.merged_settings(c, d, "c_custkey")
)
