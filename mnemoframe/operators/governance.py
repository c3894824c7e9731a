"""Access control, personal data, retention and audit."""

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mnemoframe.functions.text import ascii_borders

# Patterns of personal data (offsets and word rules are those of ASCII bytes).
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?:\+?1[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}\b|\+[1-9]\d{1,14}\b",
    "ssn": r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b",
    "url": r"https?:\/\/[^\s<>\"']+",
    "credit_card": r"\b(?:\d[ -]?){13,19}\b",
}
_COMPILED = {kind: re.compile(pattern.encode()) for kind, pattern in PII.items()}


def permitted(resources: DataFrame, grants: DataFrame, memberships: DataFrame, principal: str, permission: str) -> DataFrame:
    """Resources without any grant, and those granted to the principal or to a group of theirs; permissions imply no others."""
    groups = memberships.where(F.col("principal") == principal).select(F.col("group").alias("grantee"))
    holders = groups.unionByName(groups.sparkSession.createDataFrame([(principal,)], "grantee string")).distinct()
    granted = grants.where(F.col("permission") == permission).join(holders, "grantee", "left_semi").select("uri")
    open_ones = resources.join(grants.select("uri"), "uri", "left_anti")
    return open_ones.unionByName(resources.join(granted, "uri", "left_semi"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.split(F.reverse(digits), "")
    values = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _luhn(digits: bytes) -> bool:
    values = [d - 48 for d in reversed(digits)]
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def find_pii(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, byte offset, byte length)`` in order of offset."""
    data = (text or "").encode()
    out = []
    for kind, pattern in _COMPILED.items():
        for m in pattern.finditer(data):
            digits = re.sub(rb"\D", b"", m.group())
            if kind != "credit_card" or (len(digits) >= 13 and _luhn(digits)):
                out.append((kind, m.start(), m.end() - m.start()))
    return sorted(out, key=lambda x: (x[1], -x[2], x[0]))


#: Kinds whose matches need no check beyond the pattern.
PLAIN_KINDS = ("email", "ssn", "ipv4", "url")


def may_hold(text: Column, kind: str) -> Column:
    """A cheap test that no text fails which holds personal data of a kind."""
    return {"email": text.contains("@"), "url": text.contains("://"), "ipv4": text.rlike(r"[0-9]\.[0-9]"), "ssn": text.rlike("[0-9]-[0-9]")}.get(kind, text.rlike("[0-9]"))


def _suspects(docs: DataFrame, text_column: str) -> Column:
    """Rows whose texts have to be read in Python."""
    text, found = F.coalesce(F.col(text_column).cast("string"), F.lit("")), F.lit(False)
    for kind in PII:
        found = found | may_hold(text, kind)
    return found


def pii_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, kind, n)``: matches of the plain kinds in each text that has any; built-in expressions only."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    counts = F.array(*(F.struct(F.lit(kind).alias("kind"), F.when(may_hold(text, kind), F.size(F.regexp_extract_all(text, F.lit(f"({ascii_borders(PII[kind])})"), F.lit(1)))).otherwise(0).cast("long").alias("n")) for kind in PLAIN_KINDS))
    found = docs.select(F.col(id_column).alias("doc_id"), F.explode(F.filter(counts, lambda x: x["n"] > 0)).alias("x"))
    return found.select("doc_id", "x.kind", "x.n")


def scan_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each match.  Texts that may hold one are read in Arrow batches; a null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *m) for i, text in zip(pdf["id"], pdf["text"], strict=True) for m in find_pii(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "offset", "length"])

    return docs.where(_suspects(docs, text_column)).selectExpr(f"{id_column} AS id", f"{text_column} AS text").mapInPandas(run, "doc_id long, kind string, offset long, length long")


def redact_text(text: str | None, strategy: str = "placeholder") -> str | None:
    """Personal data replaced; of overlapping matches the earliest, then the longest counts."""
    if text is None:
        return None
    data, out, at = text.encode(), [], 0
    for kind, offset, length in find_pii(text):
        if offset < at:
            continue
        value = data[offset : offset + length]
        new = {"placeholder": f"<REDACTED:{kind}>", "mask": "*" * length, "remove": "", "hash": f"<REDACTED:{kind}:{hashlib.sha256(value).hexdigest()[:6]}>"}[strategy]
        out += [data[at:offset], new.encode()]
        at = offset + length
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def redacted(docs: DataFrame, strategy: str = "placeholder", text_column: str = "text") -> DataFrame:
    """``docs`` with a column ``redacted``; texts that can't hold personal data pass as they are, without Python."""
    apply = F.pandas_udf(lambda s: s.map(lambda t: redact_text(t, strategy)), StringType())
    suspect = _suspects(docs, text_column)
    return docs.where(suspect).withColumn("redacted", apply(F.col(text_column))).unionByName(docs.where(~suspect).withColumn("redacted", F.col(text_column)))


def retention(contexts: DataFrame, policies: DataFrame, holds: DataFrame, as_of: str) -> DataFrame:
    """What a sweep does to each context that a policy's scope covers and that is older than its days: the action, or ``held``.

    ``policies (policy, scope, value, days, action)`` are a short table: they
    meet the contexts as one row.
    """
    listed = policies.agg(F.collect_list(F.struct("policy", "scope", "value", "days", "action")).alias("policies"))
    covers = lambda p: F.coalesce((p["scope"] == "global") | ((p["scope"] == "node") & (p["value"] == F.col("node"))) | ((p["scope"] == "genre") & (p["value"] == F.col("genre"))), F.lit(False))
    old = lambda p: F.coalesce(F.col("modified_at") < F.lit(as_of).cast("timestamp") - F.make_interval(days=p["days"]), F.lit(False))
    due = contexts.crossJoin(F.broadcast(listed)).select("id", F.explode(F.filter("policies", lambda p: covers(p) & old(p))).alias("p"))
    held = holds.select("id").distinct().withColumn("held", F.lit(True))
    return due.join(held, "id", "left").select("id", "p.policy", F.when(F.col("held"), "held").otherwise(F.col("p.action")).alias("action"))


def erased(name: Column) -> Column:
    """A pseudonym that stands for an erased principal."""
    return F.concat(F.lit("erased:"), F.substring(F.sha2(name, 256), 1, 16))


def audit(events: DataFrame, principal: str, kind: str | None, since: str, until: str, limit: int = 100) -> DataFrame:
    found = events.where((F.col("agent") == principal) & F.col("time").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))
    if kind is not None:
        found = found.where(F.col("type") == kind)
    return found.select("id", "time", "type").orderBy(F.desc("time"), F.desc("id")).limit(limit)


#: Mentions of a subject that an export lists (fixed value).
MENTIONS = 100
#: Levels of a skill, lowest first (fixed values).
LEVELS = ["novice", "intermediate", "advanced", "lead"]


def skilled(principal_skills: DataFrame, skills: DataFrame, principals: DataFrame, least: str = LEVELS[0]) -> DataFrame:
    """``(principal_id, kind, skill, level)``: known principals with known skills at ``least`` or above.

    ``principal_skills`` has ``(principal_id, skill_id, level)``, ``skills``
    ``(id, name)``, ``principals`` ``(id, kind)``.  An unknown level is under
    all others.
    """
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    own = principal_skills.where(rank >= LEVELS.index(least) + 1)
    named = own.join(skills.select(F.col("id").alias("skill_id"), F.col("name").alias("skill")), "skill_id")
    return named.join(principals.select(F.col("id").alias("principal_id"), "kind"), "principal_id").select("principal_id", "kind", "skill", "level")


def subject_export(principal: str, name: str | None, principals: DataFrame, contexts: DataFrame, owned: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(section, item)``: all that the store holds on a principal.

    ``identity`` is the principal's own row; ``contexts`` those that it created;
    ``mentions`` the first MENTIONS contexts, by id, whose content holds its
    name.  ``owned`` gives the other sections: for each a table with a
    ``principal_id``, and the column whose values are listed, each once.  A
    principal without a name has no mentions; sections without rows have none.
    """
    section = lambda rows, title, column: rows.select(F.lit(title).alias("section"), F.col(column).cast("string").alias("item"))
    out = section(principals.where(F.col("id") == principal), "identity", "id").unionByName(section(contexts.where(F.col("created_by") == principal), "contexts", "id"))
    if name:
        held = contexts.where(F.contains("content", F.lit(name))).select("id").orderBy("id").limit(MENTIONS)
        out = out.unionByName(section(held, "mentions", "id"))
    for title, (rows, column) in owned.items():
        out = out.unionByName(section(rows.where(F.col("principal_id") == principal).select(column).distinct(), title, column))
    return out
