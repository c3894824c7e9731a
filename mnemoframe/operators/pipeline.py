"""Document pipeline: classification, intents, quality, chunk windows, routing, clustering."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions.durable import checkpointed
from mnemoframe.functions.text import first_match, match_count, matches, terms

# Classification patterns and labels, in order of precedence.
GENRES = [
    ("invoice", r"(?i)invoice|billing|payment due"),
    ("profit-loss", r"(?i)P&L|profit.loss|revenue vs|net income"),
    ("budget", r"(?i)\bbudget\b|quarterly spend|annual spend"),
    ("decision-log", r"(?i)decision:|decided:|we decided|key decisions"),
    ("adr", r"(?ims)Architecture Decision Record|ADR\s+\d+|## Status\n.*## Context"),
    ("spec", r"(?i)## Requirements|## Acceptance Criteria|## Constraints"),
    ("runbook", r"(?i)## Steps|## Procedure|runbook|step-by-step"),
    ("postmortem", r"(?i)postmortem|incident report|root cause analysis"),
    ("standup", r"(?i)yesterday|today|blockers|standup|weekly signal"),
    ("transcript", r"(?i)## Participants|## Action Items|## Key Points"),
    ("plan", r"(?i)## Non-Negotiables|## Time Blocks|week plan|execution plan"),
    ("brief", r"(?i)## Key Messages|## Call to Action|## Objective"),
    ("proposal", r"(?i)## Proposed|## Investment|## Timeline|## Deliverables"),
    ("pitch", r"(?i)pitch|value proposition|problem.solution"),
    ("changelog", r"(?i)CHANGELOG|## Added|## Changed|## Fixed|## Removed"),
    ("readme", r"(?i)## Installation|## Usage|## Getting Started|## Contributing"),
]
MODES = [
    ("code", r"```[a-z]+\n|defmodule|def |class |function |import |require "),
    ("data", r"(?m)^\s*[\[\{]"),
    ("visual", r"!\[.*\]\(.*\)|<img |<svg "),
    ("mixed", r"```"),
]
TYPES = [
    ("decide", r"(?i)decided:|we decided|decision:|approved:|rejected:"),
    ("commit", r"(?i)committing to|we will|I will|action item:|committed:"),
    ("direct", r"(?i)please |you need to|you must|do this|call to action|next step:|immediately"),
    ("express", r"(?i)feeling|frustrated|excited|worried|concerned|hope|proud"),
]
INTENTS = [
    ("request_info", r"(?i)\?|\b(?:could you|can you|wondering|how do|what is|when will|who is)\b|(?:^|\W)(?:please\s+(?:send|share|let me know)|question:)"),
    ("propose_decision", r"(?i)\b(?:we should|proposing|deciding between|vote on)\b|(?:^|\W)(?:let's\s+(?:go with|pick|choose|decide)|proposal:|recommend(?:ed)?\s+(?:we|you|they|approach))"),
    ("commit_action", r"(?i)\b(?:i'll|we'll|i will|we will|going to|committing to|taking on)\b|(?:^|\W)(?:owning\s+(?:this|that)|action item|todo:|task:|by\s+(?:monday|tuesday|wednesday|thursday|friday|end of (?:week|day|month)|eod|eow))"),
    ("express_concern", r"(?i)\b(?:worri(?:ed|es)|concern(?:ed|s|ing)?|risk(?:y|s|ed)?|blocker|blocked|issue|problem|alarming|dangerous|unsafe|unsustainable|warning|caution|red flag)\b"),
    ("specify", r"(?i)\b(?:must|shall|required|requires?|mandator(?:y|ily)|acceptance criteria)\b|(?:^|\W)(?:requirement:|spec(?:ification)?:|contract:|constraint:|invariant:)"),
    ("measure", r"(?i)(?:\d+(?:\.\d+)?(?:%|\s*(?:seconds?|minutes?|hours?|days?|weeks?|months?|ms|rpm|rps|req\/s|tps|tokens?|dollars?|\$|€|£|users?|customers?|conversions?|clicks?|hits?|errors?|failures?))|latency|throughput|count|total|average|median|p95|p99)"),
    ("reflect", r"(?i)\b(?:looking back|in retrospect|retrospective|reviewing|post.?mortem|lessons learned|reflecting|examining past|hindsight)\b"),
    ("narrate", r"(?i)(?:^|\W)(?:first,|next,|then,|after(?:wards)?,|finally,|timeline:)|\b(?:subsequently|meeting notes)\b|on\s+(?:\w+day|\d{4}-\d{2}-\d{2})"),
    ("reference", r"(?i)^\s*(?:see|cf\.|cite)\b|(?:^|\W)(?:ref(?:erence)?s?:|related:|link:|source:|attached:)|\b(?:per\s+(?:the\s+)?(?:doc|spec|note|email|thread|ticket|pr|issue))\b"),
]
WINDOW_BYTES, OVERLAP_BYTES = 2048, 256


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds genre, mode and signal type."""
    t, lower = F.col(text), F.col("_lower")
    found = {"genre": first_match(t, GENRES, "note", lower), "mode": first_match(t, MODES, "linguistic", lower), "signal_type": first_match(t, TYPES, "inform", lower)}
    return docs.withColumn("_lower", F.lower(t)).withColumns(found).drop("_lower")


def intent(text: Column, lower: Column | None = None) -> Column:
    """The first intent whose rule a text matches; ``lower``, the text in lower case, is best a column of its own."""
    return F.when(text == "", "record_fact").otherwise(first_match(text, INTENTS, "record_fact", lower))


def intent_confidence(text: Column, lower: Column | None = None) -> Column:
    """0.65 and 0.05 for each further match of the intent's rule, up to 0.95; 0.5 by default, 0.3 for an empty text."""
    lower = F.lower(text) if lower is None else lower
    out = F.when(text == "", 0.3)
    for _, pattern in INTENTS:
        more = F.least(match_count(text, pattern, lower) - 1, F.lit(6))
        out = out.when(matches(text, pattern, lower), F.round(F.least(0.65 + more * 0.05, F.lit(0.95)), 2))
    return out.otherwise(0.5)


def density(text: Column) -> Column:
    """Signal-to-noise estimate: share of distinct tokens mapped to 0.4-0.9; short texts 0.3, empty ones 0."""
    tokens = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")
    ratio = F.size(F.array_distinct(tokens)) / F.size(tokens)
    return F.when(F.octet_length(text) == 0, 0.0).when(F.octet_length(text) < 40, 0.3).when(F.size(tokens) == 0, 0.0).otherwise(F.round(0.4 + ratio * 0.5, 3))


def gate(sn_ratio: Column) -> Column:
    return F.when(sn_ratio < 0.3, "reject").when(sn_ratio < 0.6, "quarantine").otherwise("accept")


def windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Overlapping byte windows of each paragraph: ``(doc_id, paragraph, chunk, start, length)`` in the paragraph's bytes."""
    step = WINDOW_BYTES - OVERLAP_BYTES
    paragraphs = docs.select(id_column, F.posexplode(F.split(text_column, r"\n{1,}")).alias("paragraph", "body")).where("body <> ''")
    n = F.octet_length("body")
    last = F.greatest(F.ceil((n - F.lit(OVERLAP_BYTES)) / F.lit(step)).cast("int") - 1, F.lit(0))
    cut = paragraphs.select(id_column, "paragraph", n.alias("size"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return cut.select(id_column, "paragraph", "chunk", (F.col("chunk") * step).alias("start"), F.least(F.lit(WINDOW_BYTES), F.col("size") - F.col("chunk") * step).alias("length"))


#: Where signals of some genres go besides (fixed genres; the destinations are parameters).
FINANCIAL_GENRES, TEAM_GENRES = ["invoice", "profit-loss", "budget"], ["standup"]


def route(signals: DataFrame, rules: DataFrame, finance: str | None = None, team: str | None = None) -> DataFrame:
    """``(doc_id, destination)``: where each signal goes by ``rules (field, pattern, destination)``; ``inbox`` without a match.

    A rule asks for a signal type, a genre, a source node (where signals have
    a ``node``), or a pattern or an entity that the text holds in any case of
    letters.  Financial genres also go to ``finance`` and those of a team to
    ``team``, if these are given.  The rules are a short table: they meet the
    signals as one row.  A null text holds nothing.
    """
    listed = rules.agg(F.collect_set(F.struct("field", "pattern", "destination")).alias("rules"))
    text = F.lower(F.coalesce("text", F.lit("")))
    node = F.col("node") if "node" in signals.columns else F.lit(None).cast("string")
    equal = {"signal_type": F.col("signal_type"), "genre": F.col("genre"), "source_node": node}

    def fits(rule: Column) -> Column:
        found = F.when(rule["field"].isin("content", "entity_mention"), F.contains(text, F.lower(rule["pattern"])))
        for field, column in equal.items():
            found = found.when(rule["field"] == field, F.coalesce(column == rule["pattern"], F.lit(False)))
        return F.coalesce(found, F.lit(False))

    matched = F.transform(F.filter("rules", fits), lambda r: r["destination"])
    beside = [F.when(F.col("genre").isin(genres), place) for genres, place in ((FINANCIAL_GENRES, finance), (TEAM_GENRES, team)) if place is not None]
    if beside:
        matched = F.concat(matched, F.filter(F.array(*beside), lambda d: d.isNotNull()))
    destinations = F.array_distinct(matched)
    rows = signals.crossJoin(F.broadcast(listed))
    return rows.select("doc_id", F.explode(F.when(F.size(destinations) == 0, F.array(F.lit("inbox"))).otherwise(destinations)).alias("destination"))


#: Words of a name that are looked for, at most.
NAME_WORDS = 5
#: Bytes of names, with what a table of them takes beside, up to which each task gets them whole.
WHOLE_BYTES, NAME_BYTES = 256_000_000, 128
#: Bits by which the runs of words are sifted when there are more names, as a power of two.
SIEVE = 26


def _runs(words: Column, sizes: list[int]) -> Column:
    """The different runs of as many words as ``sizes`` has, one run a string."""

    def sized(listed: Column, n: int) -> Column:
        if n == 1:
            return listed
        starts = F.slice(listed, F.lit(1), F.greatest(F.size(listed) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: F.concat_ws(" ", w, *(F.get(listed, i + k) for k in range(1, n))))

    # As the variable of a lambda the words stand for their value: as an expression they would be split anew for each place.
    return F.get(F.transform(F.array(words), lambda listed: F.array_distinct(F.concat(*(sized(listed, n) for n in sizes)))), 0)


def _sifted(runs: DataFrame, spelt: DataFrame) -> DataFrame:
    """The runs whose bit is set by a name: all that are names, and few others unless there are very many names."""
    place = F.shiftrightunsigned(F.xxhash64("phrase"), 64 - SIEVE)
    group, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    masks = spelt.groupBy(group.alias("_group")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_mask"))
    return runs.withColumn("_group", group).join(F.broadcast(masks), "_group").where(F.getbit("_mask", bit) == 1).drop("_group", "_mask")


def mentioned(docs: DataFrame, names: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, name)``: the names of ``names (name)`` that stand in a text as whole words, in any case of letters and without marks.

    Names may have several words, NAME_WORDS at most; those of two signs or
    less aren't looked for.  Each text's runs of as many words as names have
    are looked up among the names where the text is read: most runs are no
    name, and all of them take several times the space of the texts.  If the
    names are more than WHOLE_BYTES, runs that can be names are joined with
    them by a shuffle, so the number of names doesn't matter.  Texts that
    share an id give rows each.
    """
    spelt = names.where(F.length("name") > 2).select("name", terms(F.col("name")).alias("words")).where(F.size("words").between(1, NAME_WORDS))
    spelt = checkpointed(spelt.select("name", F.size("words").alias("n"), F.array_join("words", " ").alias("phrase")).distinct())
    sizes = spelt.groupBy("n").agg(F.sum(F.octet_length("name") + F.octet_length("phrase") + NAME_BYTES)).collect()
    if not sizes:
        return docs.where("false").select(id_column, F.lit("").alias("name"))
    runs = docs.select(id_column, F.explode(_runs(terms(F.col(text_column)), sorted(r[0] for r in sizes))).alias("phrase"))
    spelt = spelt.select("phrase", "name")
    if sum(r[1] for r in sizes) <= WHOLE_BYTES:
        return runs.join(F.broadcast(spelt), "phrase").select(id_column, "name")
    # The sizes of the inputs say little of how many runs come from them: without the hint the runs may be taken for the smaller side.
    return _sifted(runs, spelt).join(spelt.hint("shuffle_hash"), "phrase").select(id_column, "name")


def greedy_clusters(vectors: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Greedy clustering in order of ids, within each partition key ``label``: join the most similar running-mean centroid or start one.

    Similarity is the cosine mapped to 0-1.  The order of arrival decides, so
    a label's vectors pass one task: they arrive in Arrow batches, and only
    the centroids are kept in memory, whose number the data set.  A label that
    holds too many is to be cut into finer ones by the caller.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label, store, counts = None, np.zeros((0, 0)), []
        for pdf in batches:
            out = []
            for lab, vec_id, vector in zip(pdf["label"], pdf["vec_id"], pdf["embedding"], strict=True):
                v = np.asarray(vector, dtype=float)
                if lab != label:
                    label, store, counts = lab, np.zeros((8, len(v))), []
                centroids = store[: len(counts)]
                best, score = -1, -1.0
                if len(counts):
                    norms = np.linalg.norm(centroids, axis=1) * np.linalg.norm(v)
                    sims = (np.divide(centroids @ v, norms, out=np.zeros(len(counts)), where=norms > 0) + 1) / 2
                    best = int(sims.argmax())
                    score = sims[best]
                if score >= threshold:
                    counts[best] += 1
                    centroids[best] += (v - centroids[best]) / counts[best]
                else:
                    best = len(counts)
                    if best == len(store):
                        store = np.vstack([store, np.zeros_like(store)])
                    store[best] = v
                    counts.append(1)
                out.append((vec_id, lab, best))
            yield pd.DataFrame(out, columns=["vec_id", "label", "cluster"])

    ordered = vectors.repartition("label").sortWithinPartitions("label", "vec_id").select("label", "vec_id", "embedding")
    return ordered.mapInPandas(run, "vec_id long, label int, cluster int")


def context_type(path: Column, content: Column, signal_folders: list[str]) -> Column:
    """``memory``, ``skill``, ``signal`` or ``resource``: by folder, then by front matter with ``signal`` or ``node``, then Markdown under ``signal_folders``."""
    where = F.coalesce(path, F.lit(""))
    block = F.regexp_extract(F.coalesce(content, F.lit("")), r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    inside = F.lit(False)
    for folder in signal_folders:
        inside = inside | where.contains(folder)
    return (
        F.when(where.contains("_memories/"), "memory")
        .when(where.contains("_skills/"), "skill")
        .when(block.rlike(r"(?m)^(signal|node)[ \t]*:"), "signal")
        .when(where.endswith(".md") & inside, "signal")
        .otherwise("resource")
    )


def with_skeleton(docs: DataFrame, skeletons: DataFrame, fallback: str = "note", text_column: str = "text") -> DataFrame:
    """``docs`` with a column ``structured``: the text under the first section of its ``genre``, the other sections empty with their hints.

    ``skeletons`` has ``(genre, place, name, hint)``, a short table that meets
    the texts as one row.  A genre without sections takes those of
    ``fallback``; without these too, the text stays alone.
    """
    by_genre = skeletons.groupBy("genre").agg(F.array_sort(F.collect_list(F.struct("place", "name", F.coalesce("hint", F.lit("")).alias("hint")))).alias("sections"))
    listed = by_genre.agg(F.map_from_entries(F.collect_list(F.struct("genre", "sections"))).alias("_skeletons"))
    own = F.coalesce(F.try_element_at("_skeletons", F.coalesce("genre", F.lit(fallback))), F.try_element_at("_skeletons", F.lit(fallback)))
    content = F.regexp_replace(F.coalesce(F.col(text_column), F.lit("")), r"^\s+|\s+$", "")
    hint = lambda s: F.when(s["hint"] != "", F.concat(F.lit("<!-- "), s["hint"], F.lit(" -->\n\n"))).otherwise("")
    blocks = F.transform("_own", lambda s, i: F.concat(F.lit("## "), s["name"], F.lit("\n\n"), F.when(i == 0, F.concat(content, F.lit("\n\n"))).otherwise(hint(s))))
    met = docs.crossJoin(F.broadcast(listed)).withColumn("_own", own)
    return met.withColumn("structured", F.when(F.col("_own").isNull(), content).otherwise(F.array_join(blocks, ""))).drop("_own", "_skeletons")
