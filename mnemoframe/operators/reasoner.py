"""RDFS and OWL-RL forward chaining: semi-naive rounds of joins until nothing new appears."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions.durable import checkpointed

TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range"
TRANSITIVE, SYMMETRIC, INVERSE, SAME = "owl:TransitiveProperty", "owl:SymmetricProperty", "owl:inverseOf", "owl:sameAs"
SAME_CLASS, SAME_PROPERTY, ON_PROPERTY, HAS_VALUE = "owl:equivalentClass", "owl:equivalentProperty", "owl:onProperty", "owl:hasValue"
#: Rounds after which rules that still infer something raise an error.
MOST_ROUNDS = 100


def _of(triples: DataFrame, predicate: str, s: str, o: str) -> DataFrame:
    return triples.where(F.col("p") == predicate).select(F.col("s").alias(s), F.col("o").alias(o))


def _triple(df: DataFrame, s, p, o) -> DataFrame:
    column = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(column(s).alias("s"), column(p).alias("p"), column(o).alias("o"))


def _joined(a: DataFrame, b: DataFrame, da: DataFrame, db: DataFrame, on) -> DataFrame:
    """Pairs of the two sides of which at least one is new."""
    return a.join(b, on) if da is a and db is b else da.join(b, on).unionByName(a.join(db, on))


def vocabulary(triples: DataFrame) -> set[str]:
    """Which of the schema's predicates and marks occur."""
    predicates = [TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, INVERSE, SAME, SAME_CLASS, SAME_PROPERTY, ON_PROPERTY, HAS_VALUE]
    marks = triples.where((F.col("p") == TYPE) & F.col("o").isin(TRANSITIVE, SYMMETRIC)).select(F.col("o").alias("word"))
    return {r["word"] for r in triples.where(F.col("p").isin(predicates)).select(F.col("p").alias("word")).unionByName(marks).distinct().collect()}


def rules(known: DataFrame, new: DataFrame, words: set[str]) -> list[DataFrame]:
    """What each rule infers from known triples if at least one of them is new; rules whose ``words`` don't occur are left out."""
    out = []

    def both(make):
        # In the first round all is new, and pairs are made once.
        made = make(known)
        return (made, made) if known is new else (made, make(new))

    def infer(needs, left, right, on, s, p, o):
        if needs <= words:
            (a, da), (b, db) = both(left), both(right)
            if on == "p" and SAME not in needs:
                # A schema of properties is short; by property, all triples of a common one would meet in one task.
                a, da = (F.broadcast(a),) * 2 if da is a else (F.broadcast(a), F.broadcast(da))
            out.append(_triple(_joined(a, b, da, db, on), s, p, o))

    triple = lambda t: t.select("s", "p", "o")
    infer({DOMAIN}, lambda t: _of(t, DOMAIN, "p", "c"), triple, "p", "s", F.lit(TYPE), "c")
    infer({RANGE}, lambda t: _of(t, RANGE, "p", "c"), triple, "p", "o", F.lit(TYPE), "c")
    infer({SUBPROPERTY}, lambda t: _of(t, SUBPROPERTY, "x", "y"), lambda t: _of(t, SUBPROPERTY, "y", "z"), "y", "x", F.lit(SUBPROPERTY), "z")
    infer({SUBPROPERTY}, lambda t: _of(t, SUBPROPERTY, "p", "q"), triple, "p", "s", "q", "o")
    infer({SUBCLASS, TYPE}, lambda t: _of(t, SUBCLASS, "c", "d"), lambda t: _of(t, TYPE, "s", "c"), "c", "s", F.lit(TYPE), "d")
    infer({SUBCLASS}, lambda t: _of(t, SUBCLASS, "x", "y"), lambda t: _of(t, SUBCLASS, "y", "z"), "y", "x", F.lit(SUBCLASS), "z")
    infer({INVERSE}, lambda t: _of(t, INVERSE, "p", "q"), triple, "p", "o", "q", "s")
    infer({INVERSE}, lambda t: _of(t, INVERSE, "q", "p"), triple, "p", "o", "q", "s")
    infer({SYMMETRIC}, lambda t: _of(t.where(F.col("o") == SYMMETRIC), TYPE, "p", "_"), triple, "p", "o", "p", "s")
    infer({SAME}, lambda t: _of(t, SAME, "x", "y"), lambda t: _of(t, SAME, "y", "z"), "y", "x", F.lit(SAME), "z")
    for name, sub in ((SAME_PROPERTY, SUBPROPERTY), (SAME_CLASS, SUBCLASS)):
        if name in words:
            pairs = _of(new, name, "a", "b")
            out += [_triple(pairs, "a", F.lit(sub), "b"), _triple(pairs, "b", F.lit(sub), "a")]
    if SAME in words:
        out.append(_triple(_of(new, SAME, "a", "b"), "b", F.lit(SAME), "a"))
        for place in "spo":
            rest = {c: F.col(c) for c in "spo"} | {place: F.col("y")}
            infer({SAME}, lambda t, place=place: _of(t, SAME, place, "y"), triple, place, rest["s"], rest["p"], rest["o"])

    if TRANSITIVE in words:
        marked = _of(known.where(F.col("o") == TRANSITIVE), TYPE, "p", "_").select("p").distinct()
        a, da = (t.join(marked, "p", "left_semi") for t in (known, new))
        # A property that has just been marked transitive takes all its triples as new.
        fresh = a.join(_of(new.where(F.col("o") == TRANSITIVE), TYPE, "p", "_").select("p"), "p", "left_semi")
        da = da.unionByName(fresh).distinct()
        name = lambda t, *to: t.select("p", *(F.col(c).alias(x) for c, x in zip("so", to, strict=True)))
        out.append(_triple(_joined(name(a, "x", "y"), name(a, "y", "z"), name(da, "x", "y"), name(da, "y", "z"), ["p", "y"]), "x", "p", "z"))

    if {ON_PROPERTY, HAS_VALUE} <= words:
        restrictions = _of(known, ON_PROPERTY, "c", "p").join(_of(known, HAS_VALUE, "c", "v"), "c")
        fresh = restrictions.join(new.where(F.col("p").isin(ON_PROPERTY, HAS_VALUE)).select(F.col("s").alias("c")).distinct(), "c", "left_semi")
        (a, da), (b, db) = both(lambda t: _of(t, TYPE, "s", "c")), both(lambda t: t.select("s", "p", F.col("o").alias("v")))
        out.append(_triple(_joined(a, restrictions, da, fresh, "c"), "s", "p", "v"))
        out.append(_triple(_joined(b, restrictions, db, fresh, ["p", "v"]), "s", F.lit(TYPE), "c"))
    return out


def closure(triples: DataFrame, most_rounds: int | None = None) -> tuple[DataFrame, int]:
    """All triples that follow from ``(s, p, o)`` triples, themselves included, as a set; and the rounds that inferred something.

    Null parts take no part in joins and stay as they are.  Stops after
    ``most_rounds`` rounds if given; otherwise when a round adds nothing, and
    raises where MOST_ROUNDS rounds don't get there.
    """
    known = new = checkpointed(triples.select("s", "p", "o").distinct())
    done = 0
    while not new.isEmpty():
        if done == most_rounds:
            break
        if done > MOST_ROUNDS:
            raise RuntimeError(f"rules still infer after {MOST_ROUNDS} rounds")
        parts = rules(known, new, vocabulary(known))
        if not parts:
            break
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        new = checkpointed(found.distinct().join(known, ["s", "p", "o"], "left_anti"))
        known = known.unionByName(new)
        done += 1
    return known, max(done - 1, 0) if most_rounds is None else done


def materialize(triples: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """The triples of ``closure``."""
    return closure(triples, most_rounds)[0]


def entails(triples: DataFrame, asked: list[tuple[str, str, str]]) -> DataFrame:
    """``(s, p, o, entailed)``: which of the asked triples follow; the input is left as it is."""
    wanted = triples.sparkSession.createDataFrame(asked, "s string, p string, o string")
    held = materialize(triples).join(F.broadcast(wanted), ["s", "p", "o"], "left_semi").withColumn("held", F.lit(True))
    return wanted.join(held, ["s", "p", "o"], "left").select("s", "p", "o", F.coalesce("held", F.lit(False)).alias("entailed"))


def edge_triples(edges: DataFrame, schema: list[tuple[str, str, str]]) -> DataFrame:
    """Edges as triples, with the schema that is to hold over them."""
    rules_of = edges.sparkSession.createDataFrame(schema, "s string, p string, o string")
    return edges.select(F.col("source_id").alias("s"), F.col("relation").alias("p"), F.col("target_id").alias("o")).unionByName(rules_of)
