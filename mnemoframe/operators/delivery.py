"""Delivery to receivers: profiles, cited envelopes in four formats, and re-encoding by genre."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Token budgets by bandwidth, and defaults by kind of receiver.
BUDGETS = {"small": 1500, "medium": 6000, "large": 24000}
BANDWIDTHS = {"service": "large", "agent": "large"}
FORMATS = {"agent": "claude", "service": "openai"}
GENRES = {"user": "brief", "agent": "spec", "service": "note"}


def _by(column: str, table: dict, default) -> Column:
    known = F.create_map(*(F.lit(x) for item in table.items() for x in item))
    return F.coalesce(F.try_element_at(known, F.col(column)), F.lit(default))


def receivers(principals: DataFrame, bandwidth: str | None = None, format: str | None = None, genre: str | None = None, token_budget: int | None = None) -> DataFrame:
    """``(id, kind, audience, bandwidth, token_budget, format, genre, mode, locale)`` of each principal ``(id, kind, metadata)``.

    What a caller states goes first, then what the ``metadata`` map holds, then
    the default of the principal's kind.  The budget follows from the
    bandwidth unless stated; an unknown bandwidth has none.
    """
    meta = lambda key: F.try_element_at("metadata", F.lit(key))
    width = F.coalesce(F.lit(bandwidth), meta("bandwidth"), _by("kind", BANDWIDTHS, "medium"))
    sizes = F.create_map(*(F.lit(x) for item in BUDGETS.items() for x in item))
    return principals.select(
        "id",
        F.coalesce("kind", F.lit("unknown")).alias("kind"),
        F.coalesce(meta("audience"), F.lit("default")).alias("audience"),
        width.alias("bandwidth"),
        F.coalesce(F.lit(token_budget), F.try_element_at(sizes, width)).cast("long").alias("token_budget"),
        F.coalesce(F.lit(format), meta("format"), _by("kind", FORMATS, "markdown")).alias("format"),
        F.coalesce(F.lit(genre), meta("genre"), _by("kind", GENRES, "note")).alias("genre"),
        F.coalesce(meta("mode"), F.lit("linguistic")).alias("mode"),
        F.coalesce(meta("locale"), F.lit("en-US")).alias("locale"),
    )


def _json(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def envelopes(chunks: DataFrame, key: str = "answer_id") -> DataFrame:
    """``(answer_id, format, body, sources)``: the packed chunks of each answer as one envelope in the answer's ``format``.

    ``chunks`` has ``(answer_id, format, place, title, content, uri)``, within
    a token budget already.  Each chunk is a titled section in order of
    ``place``; one with a ``uri`` is cited, by numbers in plain and markdown,
    and the sources are listed as the format asks, each citation once.
    ``sources`` are the distinct uris in order of first citation.  A chunk
    without a title is called by its number; formats other than the four give
    the sections alone.
    """
    parts = chunks.select(key, "format", "place", F.coalesce("title", F.lit("")).alias("title"), F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", "").alias("content"), F.nullif(F.col("uri"), F.lit("")).alias("uri"))
    order = Window.partitionBy(key, "format").orderBy("place", "title", "content", "uri")
    parts = parts.withColumns({"i": F.row_number().over(order), "c": F.count("uri").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("string")})
    message = lambda text: F.concat(F.lit('{"role":"system","content":'), _json(text), F.lit("}"))
    form = lambda plain, markdown: F.when(F.col("format") == "plain", plain).when(F.col("format") == "markdown", markdown)
    title = F.when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.lit("Chunk "), F.col("i").cast("string")))
    # A citation stands after a space of its own.
    mark = F.when(F.col("uri").isNotNull(), F.concat(F.lit(" "), form(F.concat(F.lit(" ["), "c", F.lit("]")), F.concat(F.lit(" [^"), "c", F.lit("]"))).otherwise(""))).otherwise("")
    listed = form(F.concat(F.lit("["), "c", F.lit("] "), "uri"), F.concat(F.lit("[^"), "c", F.lit("]: "), "uri"))
    listed = listed.when(F.col("format") == "claude", F.concat(F.lit('<document index="'), "c", F.lit('" source="'), "uri", F.lit('"></document>'))).when(F.col("format") == "openai", message(F.concat(F.lit("Source "), "c", F.lit(": "), "uri")))
    parts = parts.select(key, "format", "i", F.concat(F.lit("### "), title, mark, F.lit("\n\n"), "content").alias("section"), listed.alias("listed"), "uri")
    grouped = parts.groupBy(key, "format").agg(F.array_sort(F.collect_list(F.struct("i", "section", "listed", "uri"))).alias("rows"))
    cited = F.filter("rows", lambda r: r["uri"].isNotNull())
    grouped = grouped.select(key, "format", F.array_join(F.col("rows.section"), "\n\n").alias("sections"), F.transform(cited, lambda r: r["listed"]).alias("listed"), F.transform(cited, lambda r: r["uri"]).alias("cited"))
    lines = lambda before: F.when(F.size("cited") > 0, F.concat(F.lit(before), F.array_join("listed", "\n"))).otherwise("")
    body = (
        form(F.concat("sections", lines("\n\nSources:\n")), F.concat("sections", lines("\n\n---\n\n")))
        .when(F.col("format") == "claude", F.concat(F.lit("<context>\n"), "sections", lines("\n\n"), F.lit("\n</context>")))
        .when(F.col("format") == "openai", F.concat(F.lit("["), F.array_join(F.concat(F.array(message(F.col("sections"))), "listed"), ","), F.lit("]")))
        .otherwise(F.col("sections"))
    )
    return grouped.select(key, "format", body.alias("body"), F.array_distinct("cited").alias("sources"))


# Headings that name a part, limits, and what stands where a part is missing.
BULLETS, NUMBERED, STEPS = 5, 10, 300
OBJECTIVE, GOAL, REQUIREMENTS, CALL = "Objective", "(?i:Goal|Objective|Purpose)", "(?i:Requirements)", "(?i:Call to Action|Next Step|Action Items?)"
NO_REQUIREMENTS = "- No explicit requirements found in source signal."


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def section(content: Column, heading: str) -> Column:
    """The text under the first ``##`` heading that matches, up to the next one; null without such a heading."""
    pattern = rf"(?s)##\s+{heading}\s*\n(.*?)(?:\n##|\z)"
    return F.when(content.rlike(pattern), _trim(F.regexp_extract(content, pattern, 1)))


def _items(content: Column, pattern: str, most: int | None = None) -> Column:
    found = F.transform(F.regexp_extract_all(content, F.lit(rf"(?m)^{pattern}[ \t]+(\S.*)$"), F.lit(1)), _trim)
    return found if most is None else F.slice(found, 1, most)


def reencoded(signals: DataFrame, genre: Column | str = "target_genre") -> DataFrame:
    """``(id, text)``: each signal as a brief, spec, runbook, note or pitch, as its ``target_genre`` says; others pass with a header.

    ``signals`` has ``(id, title, node, genre, format, modified_at, sn_ratio,
    content, summary, description)``.  Parts are found by their headings,
    bullets and numbers; a missing part falls back to the description, then
    the summary.  A null content is empty; a null date is ``unknown``.
    """
    genre = F.col(genre) if isinstance(genre, str) else genre
    content = F.coalesce("content", F.lit(""))
    described = F.coalesce("description", "summary", F.lit(""))
    date = F.coalesce(F.date_format("modified_at", "yyyy-MM-dd"), F.lit("unknown"))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    bullets = _items(content, "[-*]")
    five = F.slice(bullets, 1, BULLETS)
    messages = F.when(F.size(five) == 0, F.concat(F.lit("- "), value("summary"))).otherwise(F.array_join(F.transform(five, lambda b: F.concat(F.lit("- "), b)), "\n"))
    call = F.coalesce(section(content, CALL), F.concat(F.lit("Review and respond to: "), value("title")))
    objective = F.coalesce(section(content, OBJECTIVE), described)
    numbered = _items(content, r"\d+\.", NUMBERED)
    wanted = F.coalesce(section(content, REQUIREMENTS), F.when(F.size(numbered) == 0, NO_REQUIREMENTS).otherwise(F.array_join(F.transform(numbered, lambda n: F.concat(F.lit("1. "), n)), "\n")))
    body = _trim(content)
    steps = F.when(F.size(bullets) > 0, F.array_join(F.transform(bullets, lambda b, i: F.concat((i + 1).cast("string"), F.lit(". "), b)), "\n"))
    steps = steps.when(F.octet_length(body) > STEPS, F.concat(F.left(body, F.lit(STEPS)), F.lit("..."))).otherwise(body)
    lines = lambda *parts: _trim(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    node = ("**Node:** ", value("node"))
    text = (
        F.when(genre == "brief", lines("# Brief: ", value("title"), "\n\n", *node, " | **Date:** ", date, "\n\n## Objective\n", objective, "\n\n## Key Messages\n", messages, "\n\n## Call to Action\n", call))
        .when(
            genre == "spec",
            lines("# Spec: ", value("title"), "\n\n", *node, " | **Genre:** ", value("genre"), " | **Date:** ", date, "\n\n## Goal\n", F.coalesce(section(content, GOAL), described), "\n\n## Requirements\n", wanted,
                  "\n\n## Constraints\n- Source node: ", value("node"), "\n- Format: ", value("format"), "\n\n## Acceptance Criteria\nSignal has been classified and routed. S/N ratio: ", value("sn_ratio")),
        )
        .when(genre == "runbook", lines("# Runbook: ", value("title"), "\n\n", *node, " | **Date:** ", date, "\n\n## Procedure\n\n", steps))
        .when(genre == "note", lines("# Note: ", value("title"), "\n\n", *node, " | **Genre:** ", value("genre"), " | **S/N:** ", value("sn_ratio"), "\n\n", F.coalesce("description", F.lit(""))))
        .when(genre == "pitch", lines("# ", value("title"), "\n\n## Problem\n", objective, "\n\n## Solution\n", messages, "\n\n## Next Step\n", call))
        .otherwise(lines("# ", value("title"), "\n\n> Genre: ", value("genre"), " | Node: ", value("node"), " | S/N: ", value("sn_ratio"), "\n\n", content))
    )
    return signals.select("id", text.alias("text"))


def rendered_for(signals: DataFrame, competences: DataFrame) -> DataFrame:
    """``(id, receiver, genre, text)``: each signal for each of its receivers, in a genre that the receiver reads.

    ``signals`` has the columns of ``reencoded`` and a ``receiver``;
    ``competences (receiver, place, genre)`` are what a receiver reads, the
    favourite first.  A signal keeps its genre if the receiver reads it, else
    takes the favourite; a receiver that isn't known gets it as it is.
    """
    known = competences.groupBy("receiver").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "genre"))), lambda c: c["genre"]).alias("_reads"))
    # Competences are a short table; by receiver, all signals of a busy one would meet in one task.
    met = signals.join(F.broadcast(known), "receiver", "left")
    target = F.when(F.col("_reads").isNull() | F.array_contains("_reads", F.col("genre")), F.col("genre")).otherwise(F.element_at("_reads", 1))
    met = met.withColumn("target_genre", F.coalesce(target, F.lit("note"))).withColumn("_row", F.struct("id", "receiver", "target_genre"))
    texts = reencoded(met.drop("id").withColumnRenamed("_row", "id"))
    return texts.select("id.id", "id.receiver", F.col("id.target_genre").alias("genre"), "text")
