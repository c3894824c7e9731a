"""Questions: sanitising, intent analysis and the texts of typed recalls."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions.text import ascii_borders

# Kinds of intent and times in order of precedence, and words that are no names.
INTENTS = [
    ("comparison", r"\bvs\b|compare|difference"),
    ("temporal", r"\bwhen\b|\blast\b|\brecent\b|\btoday\b|\byesterday\b|\bthis week\b"),
    ("decision", r"\bdecision\b|\bdecided\b|\bchose\b|\bwhy did\b"),
    ("exploration", r"\?|\bwhat\b|\bhow\b|\boverview\b|\btell me about\b"),
]
TIMES = [("recent", r"\brecent\b|\blatest\b|\btoday\b|\bthis week\b"), ("historical", r"\bold\b|\bfirst\b|\boriginal\b|\bhistory\b|\bback when\b")]
STOPWORDS = "the a an is are was were what when where who how why did do does can could should would will about for with from this that these those it its and or but not".split()


def sanitised(text: Column) -> Column:
    """A query without the signs that mean something to a search engine; ``*`` for an empty one."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), '"*^()', "     "), r"\s+", " "), "^ | $", "")
    return F.when(plain == "", "*").otherwise(plain)


def _first(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    out: Column | None = None
    for name, pattern in rules:
        hit = text.rlike(ascii_borders(pattern))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def analysed(questions: DataFrame, node_words: DataFrame, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """``(id, intent_type, entities, temporal_hint, node_hints)`` of each question.

    Entities are its capitalised words but stop words, each once in order;
    hints are the nodes of ``node_words (word, node)`` whose word occurs in it,
    in order of the words.  The words are a short table: they meet the
    questions as one row.  A null question is an empty one.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    lower = F.lower(text)
    bare = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
    entities = F.array_distinct(F.filter(bare, lambda w: w.rlike("^[A-Z]") & ~F.lower(w).isin(STOPWORDS)))
    listed = node_words.agg(F.array_sort(F.collect_set(F.struct("word", "node"))).alias("words"))
    hints = F.array_distinct(F.transform(F.filter("words", lambda w: F.contains(lower, w["word"])), lambda w: w["node"]))
    rows = questions.crossJoin(F.broadcast(listed))
    return rows.select(id_column, _first(lower, INTENTS, "lookup").alias("intent_type"), entities.alias("entities"), _first(lower, TIMES, "any").alias("temporal_hint"), hints.alias("node_hints"))


def recall_question(kind: Column, subject: Column, topic: Column, since: Column) -> Column:
    """The question of a typed recall: ``actions``, ``who``, ``when``, ``where`` or ``owns``; null for another kind.

    ``subject`` is the actor (or, for who, the role, owner if null); parts of an
    actions recall that are null or empty are left out.
    """
    given = lambda c: F.coalesce(c, F.lit(""))
    part = lambda word, c: F.when(given(c) != "", F.concat(F.lit(f" {word} "), c)).otherwise("")
    actions = F.concat(F.lit("what actions, decisions, or commitments"), part("by", subject), part("about", topic), part("since", since))
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return (
        F.when(kind == "actions", actions)
        .when(kind == "who", put("who is the ", F.coalesce(subject, F.lit("owner")), " of ", given(topic), ", and how do I reach them"))
        .when(kind == "when", put("when does ", given(topic), " happen, and what is the current schedule"))
        .when(kind == "where", put("where is ", given(topic), " kept, owned, or discussed in the workspace"))
        .when(kind == "owns", put("what is ", given(subject), " currently committed to, and what tasks are open"))
    )
