"""Queries of the quad store, of graph patterns and of inference."""

from pyspark.sql import functions as F

from mnemoframe.operators import quads as Q
from mnemoframe.operators import reasoner
from mnemoframe.plans.catalog import query
from mnemoframe.plans.patterns import compare, match, number, optional, page, solutions, where_holds

query("SC01_scan", "quads", sql="SELECT s, p, o FROM {quads} WHERE g = 'geo' AND p = 'inRegion'")(lambda q: Q.scan(q, graph="geo", predicate="inRegion"))
query("SC02_assert", "quads", sql="SELECT DISTINCT g, s, p, o FROM (SELECT * FROM {quads} UNION ALL SELECT 'default', s, p, o FROM {quads} WHERE g = 'geo')")(lambda q: Q.assert_quads(q, q.where("g = 'geo'").withColumn("g", F.lit("default"))))
query("SC03_retract", "quads", sql="SELECT g, s, p, o FROM {quads} WHERE NOT (p = 'status' AND o = 'F')")(lambda q: Q.retract(q, q.where("p = 'status' AND o = 'F'").distinct()))
query("SC04_count", "quads", sql="SELECT count(*) AS n FROM {quads}")(lambda q: q.agg(F.count("*").alias("n")))
query("SC05_exists", "quads", sql="SELECT count(*) > 0 AS found FROM {quads} WHERE s = 'nation/3' AND p = 'inRegion' AND o = 'region/1'")(lambda q: Q.exists(q, "nation/3", "inRegion", "region/1"))
query("AG01_triple_statistics", "quads", sql="""SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM {quads} GROUP BY p
    UNION ALL SELECT NULL, count(*), count(DISTINCT s), count(DISTINCT o) FROM {quads}""")(Q.statistics)  # fmt: skip
query("SP25_agent_context", "quads", sql="""SELECT p, string_agg(o, ',' ORDER BY o) AS objects, max(contains(o, '/')) AS relates
    FROM (SELECT DISTINCT p, o FROM {quads} WHERE s = 'customer/7') GROUP BY p""")(lambda q: Q.agent_facts(q, "customer/7"))  # fmt: skip

_PATH = "FROM {quads} a JOIN {quads} b ON a.o = b.s WHERE a.p = 'inNation' AND b.p = 'inRegion'"
_IN_REGION = (("?c", "inNation", "?n"), ("?n", "inRegion", "?r"))
query("SP06_basic_graph_pattern", "quads", sql=f"SELECT a.s AS c, b.o AS r {_PATH}")(lambda q: solutions(q, *_IN_REGION).select("c", "r"))
query("SP05_distinct", "quads", sql=f"SELECT DISTINCT b.o AS r {_PATH}")(lambda q: solutions(q, *_IN_REGION).select("r").distinct())
query("SP07_graph", "quads", sql="SELECT s AS n, o AS name FROM {quads} WHERE g = 'geo' AND p = 'name'")(lambda q: match(q, ("?n", "name", "?name", "geo")))
query("SP08_optional", "quads", sql="""SELECT a.s AS n, b.o AS r, c.s AS sup FROM (SELECT * FROM {quads} WHERE p = 'inRegion') a
    LEFT JOIN (SELECT * FROM {quads} WHERE p = 'name') b ON a.o = b.s LEFT JOIN (SELECT * FROM {quads} WHERE p = 'inNation') c ON a.s = c.o""")(
    lambda q: optional(optional(match(q, ("?n", "inRegion", "?g")), match(q, ("?g", "name", "?r"))), match(q, ("?sup", "inNation", "?n"))).select("n", "r", "sup")
)
query("SP09_filter_not_equal", "quads", sql="SELECT s AS o FROM {quads} WHERE p = 'status' AND o <> 'F'")(lambda q: match(q, ("?o", "status", "?s")).where("s <> 'F'").select("o"))
query("SP10_filter_order", "quads", sql="""SELECT s AS n, o AS name FROM {quads} WHERE p = 'name' AND o >= 'F' AND o < 'J'
    UNION ALL SELECT concat('order/', o_orderkey), CAST(o_custkey AS VARCHAR) FROM {orders} WHERE o_custkey > 50""")(
    lambda q: match(q, ("?n", "name", "?name")).where(compare(F.col("name"), ">=", "F") & compare(F.col("name"), "<", "J")).unionByName(
        match(q, ("?n", "placedBy", "?c")).withColumn("name", F.split_part("c", F.lit("/"), F.lit(2))).where(compare(F.col("name"), ">", 50)).select("n", "name")
    )
)
query("SP11_filter_boolean", "quads", sql="SELECT s AS n FROM {quads} WHERE p = 'name' AND NOT (o = 'ASIA' OR o = 'CHINA') AND (contains(o, 'I') OR o < 'C')")(
    lambda q: match(q, ("?n", "name", "?x")).where(~((F.col("x") == "ASIA") | (F.col("x") == "CHINA")) & (F.col("x").contains("I") | compare(F.col("x"), "<", "C"))).select("n")
)
query("SP12_filter_contains", "quads", sql="SELECT s AS n, o AS name FROM {quads} WHERE p = 'name' AND contains(o, 'A')")(lambda q: match(q, ("?n", "name", "?name")).where(F.col("name").contains("A")))
query("SP13_filter_regex", "quads", sql="SELECT s AS n FROM {quads} WHERE p = 'name' AND regexp_matches(o, '^[a-e]', 'i')")(lambda q: match(q, ("?n", "name", "?x")).where(F.col("x").rlike("(?i)^[a-e]")).select("n"))
query("SP14_filter_bound", "quads", sql="SELECT a.s AS n FROM {quads} a WHERE a.p = 'inRegion' AND a.s NOT IN (SELECT o FROM {quads} WHERE p = 'inNation')")(
    lambda q: optional(match(q, ("?n", "inRegion", "?g")), match(q, ("?s", "inNation", "?n"))).where("s IS NULL").select("n")
)
query("SP15_filter_starts_ends", "quads", sql="SELECT s AS n FROM {quads} WHERE p = 'name' AND (starts_with(o, 'A') OR ends_with(o, 'A'))")(
    lambda q: match(q, ("?n", "name", "?x")).where(F.col("x").startswith("A") | F.col("x").endswith("A")).select("n")
)
query("SP17_numeric_values", "quads", sql="SELECT s AS o, CAST(split_part(o, '/', 2) AS DOUBLE) AS value FROM {quads} WHERE p = 'placedBy' AND CAST(split_part(o, '/', 2) AS DOUBLE) < 10")(
    lambda q: match(q, ("?o", "placedBy", "?c")).select("o", number(F.split_part("c", F.lit("/"), F.lit(2))).alias("value")).where("value < 10")
)
query("SP18_order_limit_offset", "quads", sql="SELECT s AS n, o AS name FROM {quads} WHERE p = 'name' ORDER BY o DESC, s LIMIT 7 OFFSET 3")(
    lambda q: page(match(q, ("?n", "name", "?name")), F.desc("name"), F.asc("n"), limit=7, offset=3)
)


def _data(q, *triples):
    return q.sparkSession.createDataFrame([("default", *t) for t in triples], "g string, s string, p string, o string")


query("SP20_insert_data", "quads", sql="SELECT g, s, p, o FROM {quads} UNION SELECT 'default', 'nation/99', 'name', 'NOWHERE'")(lambda q: Q.assert_quads(q, _data(q, ("nation/99", "name", "NOWHERE"))))
query("SP21_delete_data", "quads", sql="SELECT g, s, p, o FROM {quads} WHERE NOT (g = 'default' AND s = 'customer/1' AND p = 'segment')")(
    lambda q: Q.retract(q, _data(q, *(("customer/1", "segment", x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))))
)
query("JN04_star_join", "quads", sql="""SELECT a.s AS o, a.o AS c, b.o AS st, c.o AS seg, d.o AS n FROM {quads} a JOIN {quads} b ON a.s = b.s JOIN {quads} c ON a.o = c.s JOIN {quads} d ON a.o = d.s
    WHERE a.p = 'placedBy' AND b.p = 'status' AND c.p = 'segment' AND d.p = 'inNation'""")(
    lambda q: solutions(q, ("?o", "placedBy", "?c"), ("?o", "status", "?st"), ("?c", "segment", "?seg"), ("?c", "inNation", "?n")).select("o", "c", "st", "seg", "n")
)
query("JN05_existence", "quads", sql="SELECT n FROM (SELECT s AS n FROM {quads} WHERE p = 'inRegion') WHERE EXISTS (SELECT 1 FROM {quads} WHERE s = 'nation/1' AND p = 'inRegion' AND o = 'region/1')")(
    lambda q: where_holds(match(q, ("?n", "inRegion", "?r")).select("n"), q, "nation/1", "inRegion", "region/1")
)
query("SP26_prompt_text", "quads", sql="""SELECT s, concat('## ', s, chr(10), string_agg(concat('- ', p, ': ', o), chr(10) ORDER BY p, o)) AS prompt FROM (SELECT DISTINCT s, p, o FROM {quads} WHERE g = 'geo') GROUP BY s""")(
    lambda q: Q.prompt_text(q.where("g = 'geo'"))
)

_CLOSED = """WITH RECURSIVE located AS (SELECT s, o FROM {geo_ontology} WHERE p IN ('inRegion', 'inNation') UNION SELECT l.s, m.o FROM located l JOIN located m ON l.o = m.s)
    SELECT s, p, o FROM {geo_ontology} UNION SELECT s, 'locatedIn', o FROM located
    UNION SELECT s, 'rdf:type', t FROM (SELECT s FROM {geo_ontology} WHERE p = 'inNation'), (VALUES ('Located'), ('Thing'), ('Top')) v(t)
    UNION SELECT 'Located', 'rdfs:subClassOf', 'Top'"""
query("RE17_materialize", "geo_ontology", sql=_CLOSED)(reasoner.materialize)
_TWO_HOPS = "(SELECT 1 FROM {geo_ontology} a JOIN {geo_ontology} b ON a.o = b.s WHERE a.s = '%s' AND b.o = '%s')"
query("RE18_entails", "geo_ontology", sql=f"""SELECT 'customer/1' AS s, 'locatedIn' AS p, 'region/1' AS o, EXISTS {_TWO_HOPS % ('customer/1', 'region/1')} AS entailed
    UNION ALL SELECT 'supplier/1', 'locatedIn', 'region/2', EXISTS {_TWO_HOPS % ('supplier/1', 'region/2')} UNION ALL SELECT 'region/1', 'locatedIn', 'nation/1', false UNION ALL SELECT 'customer/1', 'rdf:type', 'Top', true""")(
    lambda t: reasoner.entails(t, [("customer/1", "locatedIn", "region/1"), ("supplier/1", "locatedIn", "region/2"), ("region/1", "locatedIn", "nation/1"), ("customer/1", "rdf:type", "Top")])
)
#: For each rule the triples that follow beyond the given ones, by direct SQL.
_FOLLOWS = {
    "RE02_range": ("range", "SELECT o, 'rdf:type', 'Region' FROM {onto_range} WHERE p = 'inRegion'"),
    "RE03_subproperty": ("subproperty", "SELECT 'inRegion', 'rdfs:subPropertyOf', 'placedIn' UNION SELECT s, q, o FROM {onto_subproperty}, (VALUES ('locatedIn'), ('placedIn')) v(q) WHERE p = 'inRegion'"),
    "RE07_equivalent_property": ("same_property", "SELECT 'inRegion', 'rdfs:subPropertyOf', 'regionOf' UNION SELECT 'regionOf', 'rdfs:subPropertyOf', 'inRegion' UNION SELECT x, 'rdfs:subPropertyOf', x FROM (VALUES ('inRegion'), ('regionOf')) v(x) UNION SELECT s, 'regionOf', o FROM {onto_same_property} WHERE p = 'inRegion'"),
    "RE08_inverse": ("inverse", "SELECT o, 'placed', s FROM {onto_inverse} WHERE p = 'placedBy'"),
    "RE09_symmetric": ("symmetric", "SELECT o, 'inRegion', s FROM {onto_symmetric} WHERE p = 'inRegion'"),
    "RE11_RE12_has_value": ("has_value", "SELECT 'atlantis', 'inRegion', 'region/3' UNION SELECT s, 'rdf:type', 'European' FROM {onto_has_value} WHERE p = 'inRegion' AND o = 'region/3'"),
    "RE13_equivalent_class": ("same_class", "SELECT a, 'rdfs:subClassOf', b FROM (VALUES ('Nation'), ('Country')) x(a), (VALUES ('Nation'), ('Country')) y(b) UNION SELECT s, 'rdf:type', t FROM {onto_same_class}, (VALUES ('Nation'), ('Country')) v(t) WHERE p = 'inRegion'"),
    "RE14_RE16_same_as": ("same_as", "SELECT a, 'owl:sameAs', b FROM (VALUES ('nation/1'), ('land/1'), ('earth/1')) x(a), (VALUES ('nation/1'), ('land/1'), ('earth/1')) y(b) UNION SELECT a, p, o FROM {onto_same_as}, (VALUES ('land/1'), ('earth/1')) x(a) WHERE s = 'nation/1' AND p = 'name'"),
}
for _name, (_onto, _more) in _FOLLOWS.items():
    query(_name, f"onto_{_onto}", sql=f"SELECT s, p, o FROM {{onto_{_onto}}} UNION {_more}")(reasoner.materialize)
query("RE19_edges_as_triples", "edges", sql="SELECT DISTINCT source_id AS s, relation AS p, target_id AS o FROM {edges} UNION SELECT DISTINCT target_id, 'mentions', source_id FROM {edges} WHERE relation = 'mentioned_in' UNION SELECT 'mentioned_in', 'owl:inverseOf', 'mentions'")(
    lambda e: reasoner.materialize(reasoner.edge_triples(e, [("mentioned_in", "owl:inverseOf", "mentions")]))
)
