"""From sessions to memory: compression of transcripts, and memories extracted from what was said."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.text import ascii_borders, occurs

# When a session is compressed, and what is left of it, in characters.
MESSAGES, CHARACTERS, RESULT, HEAD, TAIL = 20, 10_000, 5_000, 2_000, 2_000
CUT = "\n\n... [compressed] ...\n\n"
#: Words that keep a line of the assistant (fixed values).
SIGNALS = ["decided", "action", "todo", "will", "$", "deal", "close", "agreed", "confirmed", "scheduled", "deadline"]
_DATE = r"(?i)\b\d{4}[-/]\d{2}[-/]\d{2}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b"


def kept_line(line: Column) -> Column:
    """Whether compression keeps a line: all but the assistant's lines without signal words, digits, dates or proper nouns."""
    speaks = lambda who: line.rlike(rf"(?i)^(\*\*{who}:\*\*|{who}:|\[{who}\])")
    signal = occurs(F.lower(line), SIGNALS) | line.rlike("[0-9]") | line.rlike(ascii_borders(_DATE)) | line.rlike(ascii_borders(r"\b[A-Z][a-z]+\b"))
    return speaks("user") | ~speaks("assistant") | signal


def compress(messages: DataFrame, force: bool = False, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(session, compressed, characters, transcript)`` of each session: ``**ROLE:** text`` lines in order.

    A session of more than MESSAGES messages or CHARACTERS characters, or each
    one if ``force``, loses its lines without signal; if more than RESULT
    characters are left, it becomes their first HEAD and last TAIL ones.

    Sessions of any length are cut without being gathered: lines are counted
    from both ends, and only as many as there are characters to keep can be
    part of the result.  A null text is empty; messages without a session are
    left out; messages of equal order go by role and text.
    """
    own = messages.where(F.col(session).isNotNull()).select(F.col(session).alias("session"), F.col(order).alias("at"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    said = own.withColumn("said", F.concat(F.lit("**"), F.upper(F.coalesce("role", F.lit(""))), F.lit(":** "), "text"))
    sizes = said.groupBy("session").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("characters"))
    sizes = sizes.withColumn("compressed", F.lit(force) | (F.col("messages") > MESSAGES) | (F.col("characters") > CHARACTERS))
    lines = said.select("session", "at", "role", "text", F.posexplode(F.split("said", "\n")).alias("line_at", "line")).join(sizes.select("session", "compressed"), "session")
    lines = lines.where(~F.col("compressed") | kept_line(F.col("line")))
    totals = lines.groupBy("session").agg((F.sum(F.length("line") + 1) - 1).alias("left"))
    place = ["at", "role", "text", "line_at"]
    # A line takes a character at least, its line feed; so the first of so many lines hold the first of so many characters.
    # Untouched sessions have no more lines than characters, messages and the marks of their roles.
    most = CHARACTERS + MESSAGES + 1
    ends = []
    for name, orders, n in (("head", [F.col(c) for c in place], most), ("tail", [F.desc(c) for c in place], TAIL + 1)):
        ranked = lines.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy(*orders))).where(F.col("n") <= n)
        row = F.struct(F.col("n") if name == "head" else -F.col("n"), "line")
        ends.append(ranked.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "\n").alias(name)))
    joined = sizes.join(totals, "session", "left").join(ends[0], "session", "left").join(ends[1], "session", "left")
    long = F.col("compressed") & (F.col("left") > RESULT)
    result = F.when(long, F.concat(F.left("head", F.lit(HEAD)), F.lit(CUT), F.right("tail", F.lit(TAIL)))).otherwise(F.coalesce("head", F.lit("")))
    return joined.select(F.col("session").alias(session), "compressed", F.length(result).cast("long").alias("characters"), result.alias("transcript"))


# Phrases of decisions and preferences, the form of facts, confidences, and words that are no names.
DECISIONS = ["decided", "agreed", "confirmed", "chose", "we'll go with", "the plan is"]
PREFERENCES = ["prefer", "always use", "never use", "better to", "should always"]
FACT = r"\b[A-Z][a-zA-Z]+\s+(?:is|has|costs?|wants?|needs?|owns?|runs?|leads?|manages?)\s+\S"
NAMES = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b"
KINDS = [("decision", 0.8), ("fact", 0.6), ("relationship", 0.7), ("preference", 0.7)]
LEAST_CONFIDENCE, MEMORIES, LEAST_LENGTH = 0.7, 20, 10
NO_NAMES = "The A An And But Or For Nor So Yet Both Either Neither Not Only Such As At By In Of On To Up Via With".split()


def sentences(text: Column) -> Column:
    """The sentences of a text, trimmed: cut after ``.``, ``!`` and ``?`` before white space; those under LEAST_LENGTH characters are left out."""
    cut = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(cut, lambda s: F.length(s) >= LEAST_LENGTH)


def proper_nouns(sentence: Column) -> Column:
    """Runs of one to three capitalised words, without those of NO_NAMES alone, each once in order."""
    found = F.regexp_extract_all(sentence, F.lit(ascii_borders(NAMES)), F.lit(1))
    return F.array_distinct(F.filter(found, lambda n: F.exists(F.split(n, " "), lambda w: ~w.isin(NO_NAMES))))


def extracted_memories(messages: DataFrame, people: list[str], session: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """``(session, place, category, content, confidence, entities)``: up to MEMORIES memories of each session.

    Each sentence gives a decision, a fact, a relationship (two of ``people``)
    or a preference, or several.  Of equal contents, case aside, the first
    stays: by kind in this order, then as they were said.  Those under
    LEAST_CONFIDENCE go after that.  ``people`` are a bounded list of names;
    entities are the people and proper nouns of the sentence.

    No session is gathered in a task: repeats meet by their content, and
    places are counted with a limit.
    """
    rows = messages.select(F.col(session).alias("session"), F.col(order).alias("at"), F.posexplode(sentences(F.col(text))).alias("n", "content"))
    lower = F.lower("content")
    known = F.array(*(F.when(F.contains(lower, F.lit(p.lower())), F.lit(p)) for p in people)) if people else F.array().cast("array<string>")
    rows = rows.withColumn("known", F.filter(known, lambda p: p.isNotNull()))
    holds = [occurs(lower, DECISIONS), F.col("content").rlike(ascii_borders(FACT)), F.size("known") >= 2, occurs(lower, PREFERENCES)]
    everyone = F.array_distinct(F.concat("known", proper_nouns(F.col("content"))))
    found = F.filter(
        F.array(*(F.when(hit, F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("category"), F.lit(sure).alias("confidence"), (F.col("known") if kind == "relationship" else everyone).alias("entities"))) for rank, ((kind, sure), hit) in enumerate(zip(KINDS, holds, strict=True)))),
        lambda m: m.isNotNull(),
    )
    one = rows.select("session", "at", "n", "content", F.explode(found).alias("m"))
    first = F.min(F.struct("m.rank", "at", "n", "content", "m.category", "m.confidence", "m.entities")).alias("m")
    kept = one.groupBy("session", F.lower("content").alias("key")).agg(first).where(F.col("m.confidence") >= LEAST_CONFIDENCE)
    place = F.row_number().over(Window.partitionBy("session").orderBy("m.rank", "m.at", "m.n", "m.content"))
    ranked = kept.withColumn("place", place).where(F.col("place") <= MEMORIES)
    return ranked.select(F.col("session").alias(session), "place", "m.category", "m.content", "m.confidence", "m.entities")


#: Words of a sentence that corrects something (fixed values).
CORRECTIONS = ["no not", "actually", "wrong", "should have", "instead", "not that", "mistake"]
FRICTIONS, FRICTION_CONFIDENCE = 20, 0.5


def frictions(signals: DataFrame, documents: int = 50, most: int = FRICTIONS) -> DataFrame:
    """``(id, n, content, confidence)``: sentences that correct something in the newest signals ``(id, content, modified_at)``.

    Only the ``documents`` newest with a content are read, ties by id; of their
    sentences the first ``most`` are returned, newest signals first.
    """
    newest = signals.where("content <> ''").orderBy(F.desc("modified_at"), "id").limit(documents)
    said = newest.select("id", "modified_at", F.posexplode(sentences(F.col("content"))).alias("n", "content"))
    found = said.where(occurs(F.lower("content"), CORRECTIONS)).orderBy(F.desc("modified_at"), "id", "n").limit(most)
    return found.select("id", "n", "content", F.lit(FRICTION_CONFIDENCE).alias("confidence"))


#: Confidence that a topic's observations have to add up to, confidence of those that are patterns, and patterns shown (fixed values).
ENOUGH, SURE, PATTERNS = 1.5, 0.7, 5


def rethought(observations: DataFrame, topics: DataFrame) -> DataFrame:
    """``(topic, status, observations, total_confidence, summary, patterns)`` of each topic by what was observed of it.

    An observation ``(id, category, content, confidence)`` belongs to a topic
    that is its category or stands in its content.  With less than ENOUGH
    confidence in all the status is ``insufficient_evidence``, without summary
    and patterns; else ``synthesized``, with the number of observations by
    category and the contents of the first PATTERNS sure ones, best first,
    ties by id.  The topics are a short table and meet the observations as
    one row; topics that nothing belongs to have no evidence.
    """
    listed = topics.agg(F.collect_set("topic").alias("topics"))
    belongs = F.filter("topics", lambda t: F.coalesce(F.col("category") == t, F.lit(False)) | F.coalesce(F.contains("content", t), F.lit(False)))
    seen = observations.crossJoin(F.broadcast(listed)).select("id", "category", "content", "confidence", F.explode(belongs).alias("topic"))
    counts = seen.groupBy("topic", "category").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))
    part = F.concat(F.col("n").cast("string"), F.lit(" "), F.coalesce("category", F.lit("")), F.lit(" observations"))
    totals = counts.groupBy("topic").agg(F.sum("n").alias("observations"), F.round(F.sum("c"), 2).alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", part.alias("part")))), lambda p: p["part"]), ", ").alias("parts"))
    first = Window.partitionBy("topic").orderBy(F.desc("confidence"), "id")
    sure = seen.where(F.col("confidence") >= SURE).withColumn("r", F.row_number().over(first)).where(F.col("r") <= PATTERNS)
    patterns = sure.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "content"))), lambda p: p["content"]).alias("patterns"))
    rows = topics.select("topic").distinct().join(totals, "topic", "left").join(patterns, "topic", "left")
    total, enough = F.coalesce("total", F.lit(0.0)), F.coalesce(F.col("total") >= ENOUGH, F.lit(False))
    summary = F.concat(F.lit('Rethink on "'), "topic", F.lit('": '), "parts", F.lit(". Total confidence: "), F.col("total").cast("string"), F.lit("."))
    return rows.select(
        "topic",
        F.when(enough, "synthesized").otherwise("insufficient_evidence").alias("status"),
        F.coalesce("observations", F.lit(0)).alias("observations"),
        total.alias("total_confidence"),
        F.when(enough, summary).alias("summary"),
        F.when(enough, F.coalesce("patterns", F.array().cast("array<string>"))).alias("patterns"),
    )
