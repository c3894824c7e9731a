"""Checks of signal envelopes: failure modes, the four constraints, validity, chains, categories of surfaces."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dimensions of a signal, allowed values, limits.
DIMENSIONS = ["mode", "genre", "signal_type", "format", "structure"]
MODES = ["linguistic", "visual", "code", "data", "mixed"]
TYPES = ["direct", "inform", "commit", "decide", "express"]
LARGE_DATA_BYTES, LEAST_RATIO, MANY_EXTENSIONS, TOO_MANY_EXTENSIONS, OLD_SECONDS = 100_000, 0.3, 20, 50, 86_400


def unresolved() -> Column:
    """How many dimensions of a signal have no value."""
    return sum((F.col(d).isNull().cast("int") for d in DIMENSIONS), F.lit(0))


def failures(signals: DataFrame, as_of: str, inferred: Column) -> DataFrame:
    """``(id, failure)``: every failure mode of every signal; ``inferred`` is the genre that a signal's type suggests."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("time")
    missing = unresolved()
    modes = {
        "routing_failure": F.col("source").isNull(),
        "bandwidth_overload": F.octet_length("data") > LARGE_DATA_BYTES,
        "fidelity_failure": F.col("sn_ratio") < LEAST_RATIO,
        "variety_failure": missing == len(DIMENSIONS),
        "structure_failure": (missing > 0) & (missing < len(DIMENSIONS)),
        "genre_mismatch": F.col("genre").isNotNull() & (inferred != F.col("genre")) & (inferred != "chat"),
        "herniation_failure": F.col("parent_id").isNotNull() & F.col("correlation_id").isNull(),
        "bridge_failure": F.col("extensions") > MANY_EXTENSIONS,
        "decay_failure": age > OLD_SECONDS,
        "feedback_failure": (F.col("signal_type") == "direct") & F.col("correlation_id").isNull() & F.col("parent_id").isNull(),
        "adversarial_noise": F.col("extensions") > TOO_MANY_EXTENSIONS,
    }
    found = F.filter(F.array(*(F.when(test, name) for name, test in modes.items())), lambda x: x.isNotNull())
    return signals.select("id", F.explode(found).alias("failure"))


def constraints(signals: DataFrame, most_bytes: int) -> DataFrame:
    """``(id, shannon, ashby, beer, wiener)``: whether each constraint holds.

    Data fit the channel; all dimensions are resolved; the type has parts and a
    parent comes with a correlation; the signal answers one or is answered.
    """
    answered = signals.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct().withColumn("answered", F.lit(True))
    typed = F.coalesce(F.col("type").contains("."), F.lit(False))
    return signals.join(answered, "id", "left").select(
        "id",
        (F.coalesce(F.octet_length("data"), F.lit(0)) <= most_bytes).alias("shannon"),
        (unresolved() == 0).alias("ashby"),
        (typed & ~(F.col("parent_id").isNotNull() & F.col("correlation_id").isNull())).alias("beer"),
        (F.col("parent_id").isNotNull() | F.coalesce("answered", F.lit(False))).alias("wiener"),
    )


def errors(signals: DataFrame) -> DataFrame:
    """``(id, error)``: what makes an envelope invalid."""
    required = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"{c} is required") for c in ("id", "type", "specversion")]
    enums = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(values), F.concat(F.lit(f"invalid {c}: "), F.col(c))) for c, values in (("mode", MODES), ("signal_type", TYPES))]
    ratio = F.when(~F.col("sn_ratio").between(0.0, 1.0), "sn_ratio must be between 0 and 1")
    return signals.select("id", F.explode(F.filter(F.array(*required, *enums, ratio), lambda x: x.isNotNull())).alias("error"))


def child(parent_id: str = "id", correlation: str = "correlation_id") -> list[Column]:
    """Parent and correlation of a signal's child: the correlation goes on, or begins with the parent."""
    return [F.col(parent_id).alias("parent_id"), F.coalesce(F.col(correlation), F.col(parent_id)).alias("correlation_id")]


#: Categories of a surface in order of precedence: the words in its name, the words in its body (fixed values).
CATEGORIES = [
    ("contradictions", [], ["contradict"]),
    ("recent_actions", ["decision"], ["decision"]),
    ("recent_actions", ["pricing"], []),
    ("schedules", ["schedule", "deadline"], []),
    ("ownership", ["owner", "responsibility"], []),
    ("open_tasks", ["todo", "action-items"], []),
    ("professional_knowledge", ["spec", "rfc"], []),
    ("procedures", ["playbook", "how-to"], []),
    ("contacts", ["contact", "people"], []),
]


def category(slug: Column, body: Column) -> Column:
    """The first category one of whose words occurs."""
    slug, body = F.lower(F.coalesce(slug, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    out = None
    for name, in_slug, in_body in CATEGORIES:
        found = F.lit(False)
        for text, words in ((slug, in_slug), (body, in_body)):
            for w in words:
                found = found | text.contains(w)
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise("unassigned")


#: Attributes that a converted event has in its own right, and those that become extensions (fixed values).
ATTRIBUTES = ["specversion", "id", "source", "type", "time", "subject", "data", "datacontenttype", "dataschema"]
EXTENSIONS = ["mode", "genre", "signal_type", "format", "structure", "sn_ratio", "parent_id", "correlation_id"]
SPECVERSION, CONTENT_TYPE = "1.0.2", "application/json"


def to_events(signals: DataFrame, prefix: str = "sig") -> DataFrame:
    """``(id, event)``: each signal as the JSON of an event; nulls are left out.

    Columns of EXTENSIONS are named with the prefix, ``time`` is an ISO
    instant in UTC.  Columns that a table lacks are left out.
    """
    there = set(signals.columns)
    own = [(F.date_format(F.to_utc_timestamp(F.col("time").cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if c == "time" else F.col(c).cast("string") if c == "id" else F.col(c)).alias(c) for c in ATTRIBUTES if c in there]
    more = [F.col(c).alias(f"{prefix}_{c}") for c in EXTENSIONS if c in there]
    return signals.select("id", F.to_json(F.struct(*own, *more)).alias("event"))


def from_events(events: DataFrame, prefix: str = "sig") -> DataFrame:
    """Signals ``(id, error, ...)`` from a column ``event`` of JSON: ATTRIBUTES and EXTENSIONS as text, ``sn_ratio`` as a number.

    A missing version or content type gets its default; dimensions beyond the
    allowed values become null.  ``error`` names the first required attribute
    that is missing or empty (id, source, type), or says ``not an object``.
    """
    shape = ", ".join([*(f"`{c}` string" for c in ATTRIBUTES), *(f"`{prefix}_{c}` {'double' if c == 'sn_ratio' else 'string'}" for c in EXTENSIONS)])
    read = events.select(F.from_json("event", shape, {"mode": "PERMISSIVE"}).alias("e"), F.substring(F.ltrim("event"), 1, 1).alias("opened"))
    allowed = {"mode": MODES, "signal_type": TYPES}
    value = lambda c: F.col(f"e.{prefix}_{c}")
    columns = {c: F.col(f"e.{c}") for c in ATTRIBUTES} | {c: F.when(value(c).isin(allowed[c]), value(c)) if c in allowed else value(c) for c in EXTENSIONS}
    columns["specversion"], columns["datacontenttype"] = F.coalesce(columns["specversion"], F.lit(SPECVERSION)), F.coalesce(columns["datacontenttype"], F.lit(CONTENT_TYPE))
    columns["time"] = F.try_to_timestamp(columns["time"])
    missing = F.when(F.coalesce(F.col("opened"), F.lit("")) != "{", "not an object")
    for c in ("id", "source", "type"):
        missing = missing.when(F.coalesce(columns[c], F.lit("")) == "", f"{c} is required")
    return read.select(*(v.alias(c) for c, v in columns.items()), missing.alias("error"))
