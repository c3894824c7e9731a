"""Memory operators: deduplication, keywords, recall, importance, categories, compaction."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.text import first_match, occurs, token_estimate, trimmed

# Stop words, category signals, importances, error patterns.
STOP_WORDS = """the and for are but not you all any can had her was one our out day been have from this that with what when will more about which them than been would make
like time just know take people into year your good some could over such after come made find back only first great even give most those down should well being work through
where much other also life between know years hand high because large turn each long next look state want head around move both think still might school world kind keep never
really need does going right used every last very just said same tell call before mean also actually thing many then those however these while most only must since well still
under again too own part here there where help using really trying getting doing went got let its use way may new now old see try run put set did get how has him his she her
its who why yes yet able""".split()
CATEGORY_SIGNALS = {
    "context": "currently working session today now",
    "lesson": "lesson learned mistake bug fix correction wrong error regression",
    "pattern": "pattern recurring repeatedly noticed common typical",
    "project_info": "stack architecture repo project codebase framework dependency",
    "project_spec": "requirement spec acceptance criteria must shall feature story",
    "solution": "solution solved resolved workaround fix approach",
    "user_preference": "prefer always never convention style rule habit want like dislike",
}
IMPORTANCE = {"decision": 1.0, "preference": 0.9, "architecture": 0.95, "bug": 0.8, "insight": 0.85, "contact": 0.7, "workflow": 0.75, "general": 0.5, "note": 0.4}
ERRORS = [
    ("file_not_found", r"(?i)file.*not found|no such file"),
    ("permission_denied", r"(?i)permission denied"),
    ("syntax_error", r"(?i)syntax error"),
    ("import_error", r"(?i)import.*error|module.*not found"),
    ("type_error", r"(?i)type.*error|expected.*got"),
    ("network_error", r"(?i)network|connection.*refused"),
    ("memory_error", r"(?i)out of memory|memory"),
    ("timeout_error", r"(?i)timeout"),
    ("compilation_error", r"(?i)compilation.*error|compile.*fail"),
    ("test_failure", r"(?i)test.*fail"),
]
RECALL_WEIGHTS, RECALL_RATE = (0.5, 0.3, 0.2), 0.693 / 48.0


def content_hash(content: Column) -> Column:
    """Key of equal contents: case and surrounding white space don't count."""
    return F.sha2(F.lower(trimmed(content)), 256)


def deduplicated(memories: DataFrame, *order: str) -> DataFrame:
    """The first memory of each audience and content, and how many it stands for.  Pre-aggregates, so a hot content is no single task's load."""
    keyed = memories.withColumn("content_hash", content_hash(F.col("content")))
    return keyed.groupBy("audience", "content_hash").agg(F.min_by("id", F.struct(*order)).alias("id"), F.count("*").alias("copies"))


def chain(memories: DataFrame, root) -> DataFrame:
    """A memory's versions in order, with the latest marked."""
    found = memories.where(F.col("root_id") == root)
    return found.select("id", "version", (F.col("version") == F.max("version").over(Window.partitionBy("root_id"))).alias("is_latest"))


def relations(memories: DataFrame, memory_id: str) -> DataFrame:
    """Relations of one memory to its neighbours, with their direction."""
    links = memories.where("parent_id IS NOT NULL").select(F.col("id").alias("source"), F.col("parent_id").alias("target"))
    touching = links.where((F.col("source") == memory_id) | (F.col("target") == memory_id))
    out = F.col("source") == memory_id
    return touching.select(F.when(out, F.col("target")).otherwise(F.col("source")).alias("other"), F.when(out, "outbound").otherwise("inbound").alias("direction"))


def keywords(text: Column) -> Column:
    """Distinct lower-cased words of three letters and more: camel case split, stop words and numbers left out."""
    t = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    t = F.lower(F.regexp_replace(t, "([A-Z]{2,})([A-Z][a-z])", "$1 $2"))
    t = F.regexp_replace(t, r"""[`"'{}()\[\]_\-]""", " ")
    stop = F.array(*(F.lit(w) for w in dict.fromkeys(STOP_WORDS)))
    words = F.array_except(F.split(t, r"[\s,.:;!?/\\|@#$%^&*+=<>~]+"), stop)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.rlike(r"^\d+$"))


def inverted_index(memories: DataFrame) -> DataFrame:
    """Keyword, number of memories and smallest id among them."""
    return memories.select("id", F.explode(keywords(F.col("content"))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("memories"), F.min("id").alias("first_id"))


def importance(category: Column, content: Column) -> Column:
    base = F.lit(0.5)
    for name, value in IMPORTANCE.items():
        base = F.when(F.lower(category) == name, value).otherwise(base)
    size = F.octet_length(content)
    longer = F.when(size > 500, 0.1).when(size > 200, 0.05).otherwise(0.0)
    technical = F.when(content.rlike(r"[A-Z][a-z]+[A-Z]|[a-z]+_[a-z]+|->|=>|\(\)|def |fn "), 0.05).otherwise(0.0)
    return F.least(base + longer + technical, F.lit(1.0))


def categorised(content: Column) -> Column:
    """The category with most signal words; the first in the alphabet among equals, ``context`` without any."""
    lower, hits = F.lower(content), {}
    for name, words in CATEGORY_SIGNALS.items():
        hits[name] = sum((lower.contains(w).cast("int") for w in words.split()), F.lit(0))
    most = F.greatest(*hits.values())
    out = F.when(most == 0, "context")
    for name, n in hits.items():
        out = out.when(n == most, name)
    return out


def recall(memories: DataFrame, wanted: list[str], budget: int, age_hours: Column) -> DataFrame:
    """Memories by overlap, recency and importance, up to the first that exceeds the token budget.

    Only the best candidates can fit: each costs a token at least, so
    ``budget`` rows are ranked at most.
    """
    overlap = F.size(F.array_intersect(keywords(F.col("content")), F.array(*map(F.lit, wanted)))) / F.lit(float(len(wanted)))
    weight = F.lit(0.5)
    for name, value in IMPORTANCE.items():
        weight = F.when(F.col("category") == name, value).otherwise(weight)
    a, b, c = RECALL_WEIGHTS
    scored = memories.where(overlap > 0).select("id", F.round(overlap * a + F.exp(-RECALL_RATE * age_hours) * b + weight * c, 6).alias("score"), F.greatest(token_estimate(F.col("content")), F.lit(1)).alias("cost"))
    best = scored.orderBy(F.desc("score"), "id").limit(budget)
    used = F.sum("cost").over(Window.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0))
    return best.withColumn("used", used).where(F.col("used") <= budget).select("id", "score", "used")


def compacted(turns: DataFrame, keep: int = 20) -> DataFrame:
    """A conversation's system messages and last ``keep`` turns as they are, the others counted and their characters summed."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    marked = turns.withColumn("kept", (F.col("role") == "system") | (back <= keep))
    return marked.groupBy("conv_id").agg(
        F.sum(F.col("kept").cast("int")).alias("kept"), F.sum((~F.col("kept")).cast("int")).alias("summarised"), F.sum(F.when(~F.col("kept"), F.length("text")).otherwise(0)).alias("saved_chars")
    )


def transcript(turns: DataFrame) -> DataFrame:
    """Each conversation as one text of ``role: text`` lines in order."""
    line = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    return turns.groupBy("conv_id").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(line)), lambda x: x.getField("line"))).alias("transcript"))


def observation_kind(text: Column) -> Column:
    lower = F.lower(text)
    return (
        F.when(occurs(lower, ["wrong", "error", "fail", "broken", "bug"]), "friction")
        .when(occurs(lower, ["decided", "choose", "chose", "pick", "selected"]), "decision")
        .when(occurs(lower, ["always", "never", "prefer", "should", "must"]), "process")
        .when(occurs(lower, ["mix", "command", "tool", "api", "config"]), "tool")
        .when(text.rlike("[A-Z][a-z]+ (prefers|wants|needs|likes)"), "people")
        .otherwise("pattern")
    )


def correction_key(text: Column) -> Column:
    """What a correction is remembered under: the first five words in lower case, letters and digits alone."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", "")
    return F.array_join(F.slice(F.array_remove(F.split(plain, r"\s+"), ""), 1, 5), "_")


def learnt_corrections(corrections: DataFrame) -> DataFrame:
    """``(key, correction, n)`` of ``corrections (wrong, right, time)``: the latest for each key, ties by text, and how often it was corrected."""
    keyed = corrections.select(correction_key(F.col("wrong")).alias("key"), "right", "time")
    return keyed.groupBy("key").agg(F.max_by("right", F.struct("time", "right")).alias("correction"), F.count("*").alias("n"))


def error_kind(message: Column) -> Column:
    """The kind of the first pattern of ERRORS that an error's message matches, ``unknown_error`` without one."""
    return first_match(F.coalesce(message, F.lit("")), ERRORS, "unknown_error")


def recoverable(errors: DataFrame, solutions: DataFrame) -> DataFrame:
    """``(id, kind, correction)`` of ``errors (id, message)``: what is known against errors of a kind, by ``solutions (key, correction)``; else null."""
    kinds = errors.select("id", error_kind(F.col("message")).alias("kind"))
    return kinds.join(solutions.select(F.col("key").alias("kind"), "correction"), "kind", "left").select("id", "kind", "correction")
