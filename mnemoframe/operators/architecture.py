"""Data points against architectures: declared fields, their kinds, and processors over them."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shapes of a value that fit each modality, as the first word of its variant type.
TEXT, LIST, MAP = "STRING", "ARRAY", "OBJECT"
SHAPES = {
    "text": (TEXT,), "code": (TEXT,), "image": (TEXT, MAP), "audio": (TEXT, MAP), "video": (TEXT, MAP), "time_series": (LIST,), "table": (LIST, MAP), "structured": (MAP,), "graph": (MAP,), "tensor": (LIST, TEXT), "geo": (MAP,), "binary": (TEXT,),
}
#: Keys that a map has to hold: one of them, or all.
ANY_KEY = {m: ("path", "url") for m in ("image", "audio", "video")}
ALL_KEYS = {"graph": ("nodes", "edges")}


def _fits(modality: Column, value: Column) -> Column:
    """Whether a variant fits a modality; an unknown modality fits nothing."""
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    holds = lambda key: F.try_variant_get(value, f"$.{key}", "variant").isNotNull()
    shapes = F.create_map(*(F.lit(x) for name, kinds in SHAPES.items() for x in (name, F.array(*map(F.lit, kinds)))))
    shaped = F.coalesce(F.array_contains(F.try_element_at(shapes, modality), kind), F.lit(False))
    keyed = F.lit(True)
    for names, combine in ((ANY_KEY, lambda a, b: a | b), (ALL_KEYS, lambda a, b: a & b)):
        for name, keys in names.items():
            found = holds(keys[0])
            for key in keys[1:]:
                found = combine(found, holds(key))
            keyed = keyed & ((modality != name) | (kind != MAP) | found)
    return shaped & keyed


def _fields_of(points: DataFrame, fields: DataFrame) -> DataFrame:
    """Each point's declared fields with their values as variants; null where the point lacks one or it is null."""
    known = points.select("id", "architecture", F.from_json("data", "map<string,variant>").alias("values"))
    value = F.try_element_at("values", F.col("field"))
    met = known.join(fields.select("architecture", "field", "modality", "required", *(["processor"] if "processor" in fields.columns else [])), "architecture")
    return met.withColumn("value", F.when(F.schema_of_variant(value) != "VOID", value))


def violations(points: DataFrame, fields: DataFrame) -> DataFrame:
    """``(id, field, problem)``: a row for each field of a point's architecture that the point doesn't satisfy.

    ``points`` has ``(id, architecture, data)`` with ``data`` a JSON object;
    ``fields`` has ``(architecture, field, modality, required)``.  A required
    field that is missing or null is ``missing_required``; a value whose shape
    doesn't fit the modality is ``incompatible``; a missing optional one is
    right.  Data that isn't a JSON object lacks all fields.  Points of an
    architecture without fields have no problems.
    """
    rows = _fields_of(points, fields)
    problem = F.when(F.col("value").isNull(), F.when(F.col("required"), "missing_required")).when(~_fits(F.col("modality"), F.col("value")), "incompatible")
    return rows.select("id", "field", problem.alias("problem")).where("problem IS NOT NULL")


#: Processors of fields: from a field's value as text to its output as text.
PROCESSORS: dict[str, Callable[[Column], Column]] = {
    "word_count": lambda text: F.size(F.array_remove(F.split(text, r"\s+"), "")).cast("string"),
    "fingerprint": lambda text: F.sha2(text, 256),
    "passthrough": lambda text: text,
}


def processed(points: DataFrame, fields: DataFrame, processors: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``(id, field, processor, output)``: each field with a processor, of the points without a violation.

    Values are given to a processor as text: strings as they are, others as
    JSON.  Fields whose processor isn't known, and null values, have no output.
    """
    processors = PROCESSORS if processors is None else processors
    wrong = violations(points, fields).select("id").distinct()
    rows = _fields_of(points.join(wrong, "id", "left_anti"), fields).where(F.col("processor").isin(list(processors)) & F.col("value").isNotNull())
    text = F.when(F.schema_of_variant("value") == TEXT, F.try_variant_get("value", "$", "string")).otherwise(F.to_json("value"))
    output = F.lit(None).cast("string")
    for name, run in processors.items():
        output = F.when(F.col("processor") == name, run(F.col("text"))).otherwise(output)
    return rows.withColumn("text", text).select("id", "field", "processor", output.alias("output"))
