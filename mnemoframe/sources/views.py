"""The engine's relations, derived from the test tables.

Each view is one portable SELECT over tables or other views in braces, so the
same text defines it for Spark and, as a common table expression, for the SQL
oracle; SPARK_VIEWS has Spark's text of the few that can't be.
"""

import re

from pyspark.sql import DataFrame, SparkSession

#: All scores and ages refer to this moment; nothing reads the clock.
AS_OF = "2024-02-01 00:00:00"

VIEWS = {
    "quads": """
        SELECT 'geo' AS g, concat('nation/', n_nationkey) AS s, 'inRegion' AS p, concat('region/', n_regionkey) AS o FROM {nation}
        UNION ALL SELECT 'geo', concat('nation/', n_nationkey), 'name', n_name FROM {nation}
        UNION ALL SELECT 'geo', concat('region/', r_regionkey), 'name', r_name FROM {region}
        UNION ALL SELECT 'default', concat('customer/', c_custkey), 'inNation', concat('nation/', c_nationkey) FROM {customer}
        UNION ALL SELECT 'default', concat('customer/', c_custkey), 'segment', c_mktsegment FROM {customer}
        UNION ALL SELECT 'default', concat('order/', o_orderkey), 'placedBy', concat('customer/', o_custkey) FROM {orders}
        UNION ALL SELECT 'default', concat('order/', o_orderkey), 'status', o_orderstatus FROM {orders}
        UNION ALL SELECT 'default', concat('supplier/', s_suppkey), 'inNation', concat('nation/', s_nationkey) FROM {supplier}""",
    "geo_ontology": """
        SELECT s, p, o FROM {quads} WHERE p IN ('inRegion', 'inNation')
        UNION ALL SELECT 'inRegion', 'rdfs:subPropertyOf', 'locatedIn'
        UNION ALL SELECT 'inNation', 'rdfs:subPropertyOf', 'locatedIn'
        UNION ALL SELECT 'locatedIn', 'rdf:type', 'owl:TransitiveProperty'
        UNION ALL SELECT 'inNation', 'rdfs:domain', 'Located'
        UNION ALL SELECT 'Located', 'rdfs:subClassOf', 'Thing'
        UNION ALL SELECT 'Thing', 'rdfs:subClassOf', 'Top'""",
    "contexts": """
        SELECT concat('ctx-', d.doc_id) AS id, d.doc_id AS seq, d.source AS node, d.lang AS genre,
               CASE WHEN d.doc_id % 3 = 0 THEN 'signal' WHEN d.doc_id % 3 = 1 THEN 'resource' ELSE 'memory' END AS type,
               split_part(d.text, chr(10), 1) AS title, d.text AS content,
               coalesce(CAST(l.quality AS DOUBLE), 0.5) AS sn_ratio,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * d.doc_id AS modified_at
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "edges": """
        SELECT DISTINCT concat('order/', l_orderkey) AS source_id, concat('part/', l_partkey) AS target_id, 'mentioned_in' AS relation, 1.0 AS weight
        FROM {lineitem}
        UNION ALL SELECT DISTINCT concat('part/', l_partkey), concat('supplier/', l_suppkey), 'lives_in', 1.0 FROM {lineitem}""",
    "trade": """
        SELECT source_id, target_id FROM (SELECT source_id, target_id, quantity, avg(quantity) OVER () AS mean FROM (
            SELECT concat('n', c.c_nationkey) AS source_id, concat('n', s.s_nationkey) AS target_id, sum(l.l_quantity) AS quantity
            FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
            GROUP BY 1, 2) pairs) weighed WHERE quantity > mean""",
    "related": """
        SELECT DISTINCT concat('part/', x.l_partkey) AS source_id, concat('part/', y.l_partkey) AS target_id
        FROM {lineitem} x JOIN {lineitem} y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1""",
    "entities": "SELECT DISTINCT l_orderkey AS context_id, concat('part/', l_partkey) AS name FROM {lineitem}",
    "routed": """
        SELECT id, node, CASE WHEN seq % 4 = 0 THEN concat('src', seq % 7) WHEN seq % 4 = 1 THEN node ELSE concat('src', (seq + 3) % 11) END AS destination FROM {contexts}""",
    "signals": """
        SELECT event_id AS id, ts AS time, concat('app.', event_type, CASE WHEN event_id % 2 = 0 THEN '.created' ELSE '' END) AS type,
               concat('user/', user_id) AS agent, value AS latency, props AS data,
               CASE WHEN event_id % 5 <> 0 THEN event_id - 1 END AS parent_id, CAST(floor(event_id / 5) AS BIGINT) AS correlation_id
        FROM {events}""",
    "memories": """
        SELECT concat('mem-', conv_id, '-', turn) AS id, conv_id AS root_id, turn + 1 AS version, role AS audience, text AS content,
               CASE WHEN turn % 3 = 0 THEN 'fact' WHEN turn % 3 = 1 THEN 'decision' ELSE 'preference' END AS category,
               CASE WHEN turn > 0 THEN concat('mem-', conv_id, '-', turn - 1) END AS parent_id
        FROM {conversations}""",
    "wiki": """
        SELECT doc_id, concat('**Acme Widget** costs $', doc_id % 3, '. ', chr(123), chr(123), 'cite: doc/', doc_id % 7, chr(125), chr(125), chr(10), chr(10), 'See [[page ', doc_id % 5, ']] and ',
               chr(123), chr(123), CASE WHEN doc_id % 4 = 0 THEN 'shout' ELSE 'expand' END, ' : part ', doc_id % 6, chr(125), chr(125), chr(10), chr(10), text) AS body
        FROM {documents}""",
    "seeded": """
        SELECT doc_id, lang, concat(CASE doc_id % 12
            WHEN 0 THEN 'We decided: the budget is approved.' WHEN 1 THEN 'Could you send the invoice?' WHEN 2 THEN 'You must meet the requirement: latency under 20 ms.'
            WHEN 3 THEN 'I will finish by friday, action item noted.' WHEN 4 THEN 'We are worried about the risk and the blocker.' WHEN 5 THEN 'Looking back, lessons learned from the postmortem.'
            WHEN 6 THEN 'First, we met. Finally, meeting notes were sent.' WHEN 7 THEN 'def run: import os' WHEN 8 THEN 'We should vote on the proposal:'
            WHEN 9 THEN 'The test suite did fail with a timeout error.' WHEN 10 THEN 'See the reference: related: spec.' ELSE 'Plain words only.' END, ' ', text) AS text
        FROM {documents}""",
    "notes": """
        SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE concat('---', chr(10), 'title: Note ', doc_id, chr(10), 'mode: ', lang, chr(10), '---', chr(10), 'Intro words.', chr(10), chr(10), '# Head ', doc_id, chr(10),
            'First line.', chr(10), text, chr(10), chr(10), '```sql', chr(10), 'SELECT ', doc_id, chr(10), '# no heading', chr(10), '```', chr(10), '## Tail', chr(10), chr(10), 'We must meet the deadline.') END AS text
        FROM {documents}""",
    "payloads": """
        SELECT page_id AS external_id, CASE WHEN page_id % 9 <> 0 THEN concat('Page ', page_id) END AS title, html, CASE WHEN page_id % 4 = 0 THEN 'soon' ELSE concat('2024-01-0', 1 + page_id % 9, ' 10:00:00') END AS created,
               CASE WHEN page_id % 3 <> 0 THEN url END AS url
        FROM {pages}""",
    "sheets": "SELECT o_orderkey AS doc_id, concat('key, status ,total', chr(10), o_orderkey, ',', o_orderstatus, ', ', CAST(floor(o_totalprice) AS BIGINT), chr(10), chr(10), 'x, y', chr(10)) AS text FROM {orders}",
    "mentions": """
        SELECT concat('ctx-', doc_id) AS context_id, concat('part/', 1 + doc_id % 40) AS name FROM {documents} UNION SELECT concat('ctx-', doc_id), concat('part/', 1 + doc_id * 7 % 60) FROM {documents}""",
    "versions": """
        SELECT concat('m', conv_id, '-', turn) AS id, text AS content, turn + 1 AS version, CASE WHEN turn > 0 THEN concat('m', conv_id, '-', turn - 1) END AS parent_id,
               turn = max(turn) OVER (PARTITION BY conv_id) AS is_latest, role AS audience, conv_id AS root_id FROM {conversations}""",
    "chunks": """
        SELECT concat('ctx-', doc_id, ':par-', idx) AS chunk_id, concat('ctx-', doc_id) AS context_id, CAST(idx AS BIGINT) AS idx, body AS text, CASE WHEN (doc_id + idx) % 3 <> 0 THEN CASE WHEN (doc_id + idx) % 2 = 0 THEN 'specify' ELSE 'measure' END END AS intent
        FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS idx, unnest(string_split(text, chr(10))) AS body FROM {documents}) parts""",
    "citations": """
        SELECT concat('page/', p_partkey % 50) AS slug, concat('ctx-', p_partkey % 150, ':par-', p_partkey % 2) AS chunk_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (p_partkey % 90) AS cited_at FROM {part}""",
    "curated": """
        SELECT concat('page/', p_partkey) AS slug, p_partkey % 3 AS audience, CAST(v AS BIGINT) AS version, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (p_partkey % 40 + v) AS curated_at, concat('# Page ', p_partkey, chr(10), p_name) AS body
        FROM {part}, (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3) versions WHERE p_partkey % 4 >= v""",
    "journals": """
        SELECT doc_id, concat('# Memory', chr(10), chr(10), '## [decision] 2024-01-0', 1 + doc_id % 9, chr(10), 'Chosen ', doc_id, chr(10), chr(10), '## [lesson] later', chr(10), text, chr(10)) AS text FROM {documents}""",
    "claims": """
        SELECT doc_id, concat('**Acme Widget** costs $', doc_id % 3, ',000. ', chr(123), chr(123), 'cite: doc/1', chr(125), chr(125), chr(10), '**Acme Widget** costs $', doc_id % 2, '000 and **Beta** is due 2024-01-0', 1 + doc_id % 4, ' ', chr(123), chr(123), ' cite : doc/2', chr(125), chr(125),
               ' or 2024-01-02 ', chr(123), chr(123), 'cite:doc/3 ', chr(125), chr(125), chr(10), text) AS body
        FROM {documents}""",
    "holds": "SELECT concat('ctx-', c_custkey) AS context_id, concat('user/', c_nationkey) AS principal, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-05 00:00:00' END AS released_at FROM {customer}",
    "envelopes": """
        SELECT event_id AS id, CASE WHEN event_id % 13 <> 0 THEN concat('app.', event_type) END AS type, CASE WHEN event_id % 6 <> 0 THEN concat('user/', user_id) END AS source, CASE WHEN event_id % 17 = 0 THEN '' ELSE '1.0' END AS specversion,
               CASE WHEN event_id % 4 <> 0 THEN 'linguistic' WHEN event_id % 8 = 0 THEN 'smell' END AS mode, CASE WHEN event_id % 3 <> 0 THEN 'note' END AS genre, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'direct' WHEN 2 THEN 'shout' ELSE 'inform' END AS signal_type,
               CASE WHEN event_id % 4 <> 0 THEN 'markdown' END AS format, CASE WHEN event_id % 12 <> 0 THEN 'default' END AS structure, value / 50.0 AS sn_ratio, props AS data, CAST(event_id % 60 AS INT) AS extensions, ts AS time,
               CASE WHEN event_id % 7 <> 0 THEN event_id - 1 END AS parent_id, CASE WHEN event_id % 3 = 0 THEN CAST(floor(event_id / 5) AS BIGINT) END AS correlation_id
        FROM {events}""",
    "sources": """
        SELECT doc_id, concat('src/part', doc_id % 11, '/mod', doc_id, CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.EX' WHEN 2 THEN '.go' WHEN 3 THEN '.odd' ELSE '' END) AS path,
               concat('import os', chr(10), '  def run_', doc_id, '(x): é', chr(10), coalesce(text, ''), chr(10), 'public class Big.Thing', doc_id % 7, chr(123), chr(10), chr(9), 'fn  helper::new(é)', chr(10), 'private def hidden_', doc_id, chr(10), 'define x', chr(10), chr(10), 'impl end') AS text
        FROM {documents}""",
    "configs": """
        SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN concat('name: ', c_custkey, chr(10), chr(9), 'bad: 1') ELSE concat('# customer', chr(10), 'customer:', chr(10), '  key: ', c_custkey, '  # its key', chr(10), '  segment: ', chr(39), c_mktsegment, chr(39), chr(10),
            '  nation: ', chr(123), 'id: ', c_nationkey, ', active: true', chr(125), chr(10), 'tags: [a, "b, c", 1.5]', chr(10), 'steps:', chr(10), '  - name: one', chr(10), '    note: |', chr(10), '      two', chr(10), '        lines', chr(10), '  - ~', chr(10), 'empty:', chr(10)) END AS text
        FROM {customer}""",
    "dialogues": """
        SELECT conv_id, turn, role, concat(CASE turn % 4 WHEN 0 THEN 'We decided on option ' WHEN 1 THEN 'Alice Smith prefers the plan of Bob. Beta needs option ' WHEN 2 THEN 'The Team should always ask Carol Jones! It was wrong of Bob, take the other one instead! It is better to wait, Dora has seen nr ' ELSE 'hm ok. Alice and bob met in town nr ' END,
            conv_id % 3, CASE WHEN turn % 4 = 3 THEN '? ' ELSE '. ' END, CASE WHEN turn % 2 = 0 THEN 'Acme owns it. ' ELSE '' END, text) AS text
        FROM {conversations}""",
    "principals": """
        SELECT concat('user/', c_custkey) AS id, CASE c_custkey % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'agent' WHEN 2 THEN 'service' END AS kind, CASE WHEN c_custkey % 5 = 0 THEN 'small' END AS bandwidth, CASE WHEN c_custkey % 7 = 0 THEN 'plain' END AS format,
               CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS audience, CASE WHEN c_custkey % 11 = 0 THEN 'pitch' END AS genre
        FROM {customer}""",
    "questions": """
        SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN ' "(*)^ ' ELSE concat(p_name, '* ("', p_partkey, '")  ^x') END AS query,
               concat(CASE p_partkey % 6 WHEN 0 THEN 'Compare ' WHEN 1 THEN 'When was the last ' WHEN 2 THEN 'Why did Alice choose ' WHEN 3 THEN 'What is the history of ' WHEN 4 THEN 'Notes on ' ELSE 'Is it old: ' END, p_name, CASE p_partkey % 4 WHEN 0 THEN ' for North Team' WHEN 1 THEN ' of The platform deal?' ELSE '' END) AS text
        FROM {part}""",
    "scenarios": """
        SELECT p_partkey AS id, concat(CASE p_partkey % 7 WHEN 0 THEN 'What if Alice Smith leaves ' WHEN 1 THEN 'We Cancel the north side, ' WHEN 2 THEN 'Revenue of Acme falls, ' WHEN 3 THEN 'What If Bob stops working on the south team, ' WHEN 4 THEN 'Carol moves to the north side ' WHEN 5 THEN 'nothing at all, ' ELSE 'Shut down all ' END, p_name) AS text
        FROM {part}""",
    "aliases": "SELECT 'north side' AS alias, 'north' AS node UNION ALL SELECT 'south', 'south-hub' UNION ALL SELECT 'red', 'red-hub' UNION ALL SELECT 'deal', 'sales' UNION ALL SELECT 'team', 'people'",
    "node_words": "SELECT alias AS word, node FROM {aliases}",
    "points": """
        SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'media' WHEN event_id % 3 = 1 THEN 'series' ELSE 'free' END AS architecture,
               CASE WHEN event_id % 17 = 0 THEN 'no json' ELSE concat(chr(123), '"title": ', CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '5' ELSE concat('"Title of ', event_id, '"') END, CASE WHEN event_id % 5 <> 0 THEN ', "values": [1, 2.5]' ELSE ', "values": "none"' END,
                   ', "photo": ', CASE event_id % 7 WHEN 0 THEN concat(chr(123), '"url": "u"', chr(125)) WHEN 1 THEN concat(chr(123), '"place": "p"', chr(125)) WHEN 2 THEN '"file"' ELSE '[1]' END, ', "links": ', CASE WHEN event_id % 2 = 0 THEN concat(chr(123), '"nodes": [], "edges": []', chr(125)) ELSE concat(chr(123), '"nodes": []', chr(125)) END, chr(125)) END AS data
        FROM {events}""",
    "fields": """
        SELECT 'media' AS architecture, 'title' AS field, 'text' AS modality, true AS required, 'word_count' AS processor UNION ALL SELECT 'media', 'photo', 'image', true, NULL UNION ALL SELECT 'media', 'extra', 'geo', false, NULL
        UNION ALL SELECT 'series', 'title', 'text', false, 'fingerprint' UNION ALL SELECT 'series', 'values', 'time_series', true, 'passthrough' UNION ALL SELECT 'series', 'links', 'graph', true, NULL""",
    "handbook": """
        SELECT slug, audience, version, concat(body, chr(10), chr(10), CASE WHEN version = 1 THEN '## Summary' WHEN version = 2 THEN '##  related pages ' ELSE '### Summary' END, chr(10), 'Words.', CASE WHEN version > 1 THEN concat(chr(10), chr(10), '##  new Signals ', chr(10), chr(10), '- old one') ELSE '' END) AS body,
               CASE version WHEN 1 THEN slug WHEN 2 THEN '' END AS title, CASE WHEN audience = 1 THEN 'draft' END AS status
        FROM {curated}""",
    "page_rules": "SELECT 'required_section' AS kind, 'Summary' AS value UNION ALL SELECT 'required_section', 'Related Pages' UNION ALL SELECT 'required_frontmatter', 'title' UNION ALL SELECT 'required_frontmatter', 'status' UNION ALL SELECT 'max_bytes', '70' UNION ALL SELECT 'max_bytes', '90'",
    "new_citations": "SELECT concat('page/', doc_id % 40) AS slug, concat('ctx-', doc_id) AS uri, text FROM {documents}",
    "people": "SELECT concat('user/', c_custkey) AS id, CASE WHEN c_custkey % 4 = 0 THEN 'agent' ELSE 'user' END AS kind, c_name AS display_name FROM {customer}",
    "skills": "SELECT p_partkey AS id, p_name AS name FROM {part} WHERE p_partkey % 3 <> 0",
    "principal_skills": "SELECT DISTINCT concat('user/', o_custkey) AS principal_id, o_orderkey % 50 AS skill_id, CASE o_orderstatus WHEN 'O' THEN 'novice' WHEN 'F' THEN 'advanced' ELSE 'lead' END AS level FROM {orders}",
    "observed": """
        SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS category, concat('Seen ', props, ' by user ', user_id % 3) AS content, CAST(event_id % 11 AS DOUBLE) / 10 AS confidence FROM {events} WHERE event_id % 2 = 0""",
    "topics": "SELECT DISTINCT event_type AS topic FROM {events} UNION SELECT 'user 2' UNION SELECT 'nothing like it'",
    "page_files": """
        SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN concat('---', chr(10), 'slug: page-', doc_id, chr(10), 'version: ', doc_id, chr(10), 'owner:  Ann: B ', chr(10), 'slug: other', chr(10), '---', chr(10), chr(10), text) WHEN doc_id % 4 = 2 THEN concat('---', chr(13), chr(10), 'audience: sales', chr(13), chr(10), 'version: x', chr(13), chr(10), '---', chr(13), chr(10), text) ELSE concat('---', chr(10), 'slug: open', chr(10), text) END AS text
        FROM {documents}""",
    "skeletons": "SELECT 'de' AS genre, 2 AS place, 'Fragen' AS name, '' AS hint UNION ALL SELECT 'de', 1, 'Inhalt', 'first' UNION ALL SELECT 'de', 3, 'Folgen', 'what follows' UNION ALL SELECT 'note', 1, 'Context', NULL UNION ALL SELECT 'note', 2, 'Route', NULL",
    "tree": """
        SELECT doc_id, concat(CASE doc_id % 7 WHEN 0 THEN 'north/' WHEN 1 THEN 'south/.git/' WHEN 2 THEN '_memories/' WHEN 3 THEN '_old/' WHEN 4 THEN 'docs/tools/' WHEN 5 THEN 'south/' ELSE '' END, 'my-file_', doc_id, CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.pdf' WHEN 2 THEN '.abstract.md' WHEN 3 THEN '.exe' ELSE '.txt' END) AS path,
               CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 2000000 ELSE 10 + doc_id END AS size, concat(CASE WHEN doc_id % 2 = 0 THEN concat('# Head ', doc_id, chr(10)) ELSE '' END, text) AS content
        FROM {documents}""",
    "folders": "SELECT 'north' AS folder, 'north-hub' AS node UNION ALL SELECT 'south', 'south-hub'",
    "surfaces": "SELECT concat('spec-', p_partkey % 5) AS spec, concat('src/part', p_partkey % 9, '/mod', p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.EX' WHEN 2 THEN '.go' ELSE '' END) AS path FROM {part}",
    "defaults": "SELECT 'customer.key' AS path, 'integer' AS kind, '0' AS value UNION ALL SELECT 'customer.extra', 'string', 'x' UNION ALL SELECT 'tags[0]', 'string', 'none' UNION ALL SELECT 'tags[7]', 'string', 'none' UNION ALL SELECT 'limits.most', 'integer', '9' UNION ALL SELECT 'steps.deep', 'string', 'z' UNION ALL SELECT 'empty.more', 'null', ''",
    "packed": """
        SELECT o_custkey % 50 AS answer_id, CASE o_custkey % 50 % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'markdown' WHEN 2 THEN 'claude' WHEN 3 THEN 'openai' ELSE 'other' END AS format, o_orderkey AS place,
               CASE WHEN o_orderkey % 3 <> 0 THEN concat('Order ', o_orderkey) END AS title, concat('  Status "', o_orderstatus, '"', chr(10), o_orderpriority, ' ') AS content, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('order/', o_orderkey % 6) END AS uri
        FROM {orders}""",
    "reports": """
        SELECT concat('sig-', doc_id) AS id, CASE WHEN doc_id % 9 <> 0 THEN concat('Report ', doc_id) END AS title, source AS node, lang AS genre, 'markdown' AS format, CASE WHEN doc_id % 6 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * doc_id END AS modified_at, CAST(doc_id % 10 AS INT) AS sn_ratio,
               CASE doc_id % 5 WHEN 0 THEN 'brief' WHEN 1 THEN 'spec' WHEN 2 THEN 'runbook' WHEN 3 THEN 'note' ELSE 'pitch' END AS target_genre, concat('Summary ', doc_id) AS summary, CASE WHEN doc_id % 4 <> 0 THEN concat('About ', doc_id) END AS description,
               concat(CASE WHEN doc_id % 3 = 0 THEN concat('## Objective', chr(10), 'Reach ', doc_id, chr(10)) ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN concat('- first ', doc_id, chr(10), '*  second', chr(10), '-not one', chr(10)) ELSE concat('1. step', chr(10), '22.  other ', chr(10)) END,
                   coalesce(text, ''), chr(10), CASE WHEN doc_id % 7 = 0 THEN concat('## action items ', chr(10), 'Call ', doc_id, chr(10), '## Requirements', chr(10), chr(10), 'Must fit', chr(10)) ELSE '' END) AS content
        FROM {documents}""",
}
#: Views whose SQL Spark writes in another way: lists become rows there by a generator of its own.
SPARK_VIEWS = {
    "chunks": """
        SELECT concat('ctx-', doc_id, ':par-', idx) AS chunk_id, concat('ctx-', doc_id) AS context_id, CAST(idx AS BIGINT) AS idx, body AS text, CASE WHEN (doc_id + idx) % 3 <> 0 THEN CASE WHEN (doc_id + idx) % 2 = 0 THEN 'specify' ELSE 'measure' END END AS intent
        FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (idx, body) FROM {documents}) parts""",
}
#: Triples of the store with a schema for one inference rule each.
ONTOLOGIES = {
    "range": ("inRegion", [("inRegion", "rdfs:range", "Region")]),
    "subproperty": ("inRegion", [("inRegion", "rdfs:subPropertyOf", "locatedIn"), ("locatedIn", "rdfs:subPropertyOf", "placedIn")]),
    "same_property": ("inRegion", [("inRegion", "owl:equivalentProperty", "regionOf")]),
    "inverse": ("placedBy", [("placedBy", "owl:inverseOf", "placed")]),
    "symmetric": ("inRegion", [("inRegion", "rdf:type", "owl:SymmetricProperty")]),
    "has_value": ("inRegion", [("European", "owl:onProperty", "inRegion"), ("European", "owl:hasValue", "region/3"), ("atlantis", "rdf:type", "European")]),
    "same_class": ("inRegion", [("inRegion", "rdfs:domain", "Nation"), ("Nation", "owl:equivalentClass", "Country")]),
    "same_as": ("name", [("nation/1", "owl:sameAs", "land/1"), ("land/1", "owl:sameAs", "earth/1")]),
}
VIEWS |= {
    f"onto_{name}": " UNION ALL ".join([f"SELECT s, p, o FROM {{quads}} WHERE p = '{predicate}'", *(f"SELECT '{s}', '{p}', '{o}'" for s, p, o in schema)])
    for name, (predicate, schema) in ONTOLOGIES.items()
}
_NAME = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a test table."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = SPARK_VIEWS.get(name, VIEWS[name])
    needs = {x: view(spark, sf_dir, x) for x in set(_NAME.findall(text))}
    return spark.sql(text, **needs)


def oracle(sql: str) -> str:
    """``sql`` for the oracle, with the views that it names in braces as common table expressions before it."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    plain = lambda text: _NAME.sub(r"\1", text).strip()
    body = plain(sql)
    if not order:
        return body
    heads = ", ".join(f"{name} AS ({plain(VIEWS[name])})" for name in order)
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[len('WITH RECURSIVE') :].strip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:].strip()}"
    return f"WITH {heads} {body}"
