"""Signals: envelope analysis, routing patterns, journal, subscriptions, rate limits, percentiles."""

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.text import occurs

# Substrings that mark code.
CODE_MARKS = ["def ", "fn ", "->", "|>", "defmodule", "import ", "require ", "function", "const ", "let ", "var ", "class ", "{", "}", "=>"]


def code_like(data: Column) -> Column:
    return occurs(data, CODE_MARKS)


def signal_to_noise(data: Column, type_: Column, present: list[Column]) -> Column:
    """Mean of dimension, data, type and context scores; all five dimensions have defaults, so the first is 1."""
    size = F.octet_length(data)
    data_score = F.when(data.isNull() | (size == 0), 0.2).when(size < 10, 0.5).when(size < 1000, 0.8).otherwise(0.7)
    depth = F.size(F.split(type_, r"\."))
    type_score = F.when(type_.isNull(), 0.2).when(depth >= 3, 1.0).when(depth == 2, 0.7).otherwise(0.4)
    context_score = sum((p.isNotNull().cast("double") for p in present), F.lit(0.0)) / F.lit(3.0)
    return F.round((F.lit(1.0) + data_score + type_score + context_score) / 4, 2)


def pattern_regex(pattern: str) -> str:
    """A dotted pattern as a regular expression: ``*`` is one segment, ``**`` all that follow."""
    out = ""
    for i, part in enumerate(pattern.split(".")):
        if part == "**":
            return f"^{out}(?:{re.escape('.') if i else ''}.*)?$" if i else "^.*$"
        out += (re.escape(".") if i else "") + ("[^.]+" if part == "*" else re.escape(part))
    return f"^{out}$"


def specificity(pattern: str) -> int:
    return sum(0 if p == "**" else 1 if p == "*" else 3 for p in pattern.split("."))


def routed(signals: DataFrame, routes: list[tuple[str, str, int]]) -> DataFrame:
    """``(id, route, place)``: the routes ``(name, pattern, priority)`` that match, most specific first, then by priority and name."""
    ranked = sorted(routes, key=lambda r: (-specificity(r[1]), -max(-100, min(100, r[2])), r[0]))
    matches = F.array(*(F.when(F.col("type").rlike(pattern_regex(p)), F.lit(name)) for name, p, _ in ranked))
    found = signals.select("id", F.posexplode(F.filter(matches, lambda x: x.isNotNull())).alias("place", "route"))
    return found.select("id", "route", F.col("place").cast("long").alias("place"))


def history(signals: DataFrame, prefix: str, since: str, until: str, limit: int = 100) -> DataFrame:
    """Journal entries of types that start with ``prefix``, oldest first."""
    found = signals.where(F.col("type").startswith(prefix) & F.col("time").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))
    return found.select("id", "time", "type").orderBy("time", "id").limit(limit)


def correlated(signals: DataFrame) -> DataFrame:
    """Ids of each correlation in order of time."""
    ordered = F.sort_array(F.collect_list(F.struct("time", "id")))
    return signals.groupBy("correlation_id").agg(F.concat_ws(",", F.transform(ordered, lambda x: x.getField("id").cast("string"))).alias("ids"))


def percentiles(samples: DataFrame, key: str, value: str, order: str, last: int = 1000) -> DataFrame:
    """Nearest-rank p50, p95 and p99 of each key's last ``last`` samples (index ``round(p * (n - 1))``).

    Parts of a key give their own last samples first, so a hot key's rows are
    never ordered in one task.
    """
    parts = samples.withColumn("part", F.pmod(F.xxhash64(order), F.lit(64)))
    late = parts.withColumn("back", F.row_number().over(Window.partitionBy(key, "part").orderBy(F.desc(order)))).where(F.col("back") <= last)
    recent = late.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("back") <= last)
    held = recent.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v"))
    at = lambda p: F.element_at("v", (F.round((F.size("v") - 1) * F.lit(p)) + 1).cast("int"))
    return held.select(key, at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def _in_time_order(events: DataFrame, key: list[str], step: Callable, silence: float) -> DataFrame:
    """``(id, allowed)``, where ``step(state, time)`` gives a key's next state and whether the event is allowed.

    After ``silence`` seconds without an event a key starts afresh, so its
    events fall into pieces that don't depend on each other.  Pieces are told
    from the slots of that length which hold events: an empty slot between
    two is such a silence.  A piece's events arrive in order in Arrow batches
    of bounded size; nothing but its state is held, however many they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in batches:
            out = []
            for own, t in zip(pdf["piece"], pdf["time"], strict=True):
                if own != at:
                    at, state = own, None
                state, ok = step(state, t)
                out.append(ok)
            yield pdf[["id"]].assign(allowed=out)

    slotted = events.select("id", "time", F.struct(*key).alias("key"), F.floor(F.unix_micros(F.col("time").cast("timestamp")) / F.lit(silence * 1e6)).alias("slot"))
    slots = slotted.select("key", "slot").distinct()
    by_slot = Window.partitionBy("key").orderBy("slot")
    pieces = slots.withColumn("new", F.coalesce((F.col("slot") - F.lag("slot").over(by_slot) > 1).cast("int"), F.lit(0))).select("key", "slot", F.sum("new").over(by_slot).alias("n"))
    placed = slotted.join(pieces, ["key", "slot"]).withColumn("piece", F.to_json(F.struct("key", "n")))
    ordered = placed.select("id", "time", "piece").repartition("piece").sortWithinPartitions("piece", "time", "id")
    return ordered.mapInPandas(run, "id long, allowed boolean")


def cooled_down(events: DataFrame, key: list[str], seconds: int = 3600) -> DataFrame:
    """Events that are let through: the first of a key, then each that comes ``seconds`` or more after the last one let through."""

    def step(last, t):
        ok = last is None or (t - last).total_seconds() >= seconds
        return (t if ok else last), ok

    return _in_time_order(events, key, step, seconds).where("allowed").select("id")


def rate_limited(events: DataFrame, key: str, capacity: float, per_second: float) -> DataFrame:
    """``(id, allowed)`` of a token bucket for each key, refilled with time and advanced on refusal too."""

    def step(state, t):
        last, tokens = state or (t, capacity)
        tokens = min(capacity, tokens + (t - last).total_seconds() * per_second)
        ok = tokens >= 1
        return (t, tokens - 1 if ok else tokens), ok

    # A bucket is full again after so long a silence, whatever was in it.
    return _in_time_order(events, [key], step, capacity / per_second)


# What a segment of a signal's type says of genre and structure, and its last one of the action.
GENRE_OF = {"error": "error", "alert": "alert", "progress": "progress", "task": "brief", "spec": "spec", "report": "report", "review": "pr", "chat": "chat", "decision": "adr"}
STRUCTURE_OF = {
    "error": "error_report", "alert": "alert_template", "progress": "progress_update", "task": "task_brief", "spec": "specification",
    "report": "report_template", "review": "review_template", "chat": "conversation", "decision": "decision_record",
}
ACTION_OF = {
    "completed": "inform", "created": "inform", "started": "inform", "failed": "inform", "request": "direct", "command": "direct", "dispatch": "direct",
    "decided": "decide", "approved": "commit", "committed": "commit", "merged": "commit", "expressed": "express", "acknowledged": "express",
}


def _looked_up(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for item in table.items() for x in item)), key), F.lit(default))


def dimensions(data: Column, type_: Column) -> dict[str, Column]:
    """Mode, genre, action, format and structure that a text signal's type and data imply."""
    segments = F.split(F.coalesce(type_, F.lit("")), r"\.")
    known = F.try_element_at(F.filter(segments, lambda s: s.isin(list(GENRE_OF))), F.lit(1))
    code, text = code_like(data), data.isNotNull()
    return {
        "mode": F.when(text & code, "code").otherwise("linguistic"),
        "genre": _looked_up(GENRE_OF, known, "chat"),
        "action": _looked_up(ACTION_OF, F.element_at(segments, -1), "inform"),
        "format": F.when(~text, "json").when(code, "code").when(occurs(data, ["#", "**", "- "]), "markdown").otherwise("cli"),
        "structure": _looked_up(STRUCTURE_OF, known, "default"),
    }


def topic_regex(pattern: str) -> str:
    """A topic pattern as a regular expression: ``*`` is one segment, ``**`` one or more, whatever follows it."""
    out = []
    for part in pattern.split("."):
        if part == "**":
            out.append(".*")
            break
        out.append("[^.]*" if part == "*" else re.escape(part))
    return "^" + re.escape(".").join(out) + "$"


def subscribed(signals: DataFrame, patterns: list[str]) -> DataFrame:
    """``(id, pattern)`` for each (bounded list of) topic pattern that a signal's type matches."""
    matches = F.array(*(F.when(F.col("type").rlike(topic_regex(p)), F.lit(p)) for p in patterns))
    return signals.select("id", F.explode(F.filter(matches, lambda x: x.isNotNull())).alias("pattern"))


def surfaced(pages: DataFrame, subscriptions: DataFrame, least: float = 0.5) -> DataFrame:
    """``(id, subscription, score)`` of pages ``(id, slug, body, audience)`` that reach a subscription ``(subscription, scope, value)``.

    Subscriptions are a short table and meet the pages as one row; only those
    that a page reaches become rows of their own.
    """
    listed = subscriptions.agg(F.collect_list(F.struct("subscription", "scope", "value")).alias("_subscriptions"))
    lower_body = F.lower("body")

    def score(s: Column) -> Column:
        topic = F.lower(s["value"])
        return (
            F.when(s["scope"] == "workspace", 1.0)
            .when((s["scope"] == "node") & F.contains("slug", s["value"]), 1.0)
            .when((s["scope"] == "topic") & (topic != "") & F.contains("slug", topic), 1.0)
            .when((s["scope"] == "topic") & (topic != "") & F.contains(lower_body, topic), 0.7)
            .when((s["scope"] == "audience") & (F.coalesce("audience", F.lit("default")) == s["value"]), 1.0)
            .otherwise(0.0)
        )

    scored = F.transform("_subscriptions", lambda s: F.struct(s["subscription"].alias("subscription"), score(s).alias("score")))
    met = pages.crossJoin(F.broadcast(listed)).select("id", F.explode(F.filter(scored, lambda s: s["score"] >= least)).alias("s"))
    return met.select("id", "s.subscription", "s.score")


def journal_kept(signals: DataFrame, max_size: int, key: str = "agent") -> DataFrame:
    """``(key, id)`` of the signals that each key's bounded journal still holds after all of them have been recorded.

    A journal that holds ``max_size`` signals gives up its oldest tenth (one at
    least) before it records the next.  So n recordings of different ids leave
    all but the tenths that were given up: as many as it takes to bring n
    down to ``max_size``.  Only the last ``max_size`` rows of a key are ranked,
    and each task sends no more of a key than that.  Signals go by time, then
    id; those without a key share one journal.
    """
    tenth = max(1, max_size // 10)
    totals = signals.groupBy(F.struct(key).alias("journal")).agg(F.count("*").alias("n"))
    given_up = F.ceil(F.greatest(F.col("n") - max_size, F.lit(0)) / F.lit(tenth)) * tenth
    newest = Window.partitionBy("journal").orderBy(F.desc("time"), F.desc("id"))
    last = signals.select(F.struct(key).alias("journal"), "time", "id").withColumn("r", F.row_number().over(newest)).where(F.col("r") <= max_size)
    return last.join(totals, "journal").where(F.col("r") <= F.col("n") - given_up).select(F.col(f"journal.{key}").alias(key), "id")
