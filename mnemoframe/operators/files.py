"""Files and contexts: which files are indexed, what becomes of them, the files that signals are written to, and specification coverage."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions.text import slug
from mnemoframe.operators.pipeline import context_type, with_skeleton

# Folders and files that are left out, sizes, and extensions read as text or as metadata.
SKIPPED = [".git", ".claude", "node_modules", "_ARCHIVE", ".system", "engine", "tasks", "tools"]
SIDECARS = [".abstract.md", ".overview.md"]
KEPT_FOLDERS = ["_memories", "_skills"]
MOST_BYTES = 1024 * 1024
TEXT_FILES = "md txt rst adoc ex exs py js ts jsx tsx go rs rb java c cpp h sh bash zsh json yaml yml toml csv xml".split()
BINARY_FILES = "pdf docx pptx xlsx png jpg jpeg gif svg mp4 mp3".split()
BINARY_RATIO, PREVIEW = 0.3, 300


def _extension(path: Column) -> Column:
    """What follows the last dot of a file's name, in its own case; nothing for a name that only starts with one."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def indexable(files: DataFrame) -> DataFrame:
    """The rows of ``files`` that an index takes, with ``kind`` ``text`` or ``binary``.

    ``files`` has ``(path, size)``, relative to the root.  A folder or file is
    left out by name, if it starts with a dot or an underscore (but for
    memories and skills), if it is a sidecar, empty, larger than MOST_BYTES or
    of no known extension.  A null path is left out.
    """
    parts = F.split("path", "/")
    out = lambda name: name.isin(SKIPPED) | name.startswith(".") | (name.startswith("_") & ~name.isin(KEPT_FOLDERS))
    sidecar = F.lit(False)
    for ending in SIDECARS:
        sidecar = sidecar | F.col("path").endswith(ending)
    kind = F.when(_extension(F.col("path")).isin(TEXT_FILES), "text").when(_extension(F.col("path")).isin(BINARY_FILES), "binary")
    kept = files.where(~F.exists(parts, out) & ~sidecar & F.col("size").between(1, MOST_BYTES))
    return kept.withColumn("kind", kind).where("kind IS NOT NULL")


def file_contexts(files: DataFrame, folders: DataFrame, scheme: str = "mem") -> DataFrame:
    """``(id, uri, type, node, path, title, content, summary, sn_ratio)`` of each indexable file ``(path, size, content, kind)``.

    The id is the path's hash, the node that of the first folder by ``folders
    (folder, node)``, ``inbox`` for others.  A binary file is a resource with
    its size alone; a text has its type and its first heading, or its name, as
    title, and no ratio yet.  An empty text is left out.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    plain = F.trim(F.regexp_replace(name, "[-_]", " "))
    binary = F.col("kind") == "binary"
    heading = F.trim(F.regexp_extract(F.coalesce("content", F.lit("")), r"(?m)^# +(.+)$", 1))
    homes = folders.select("folder", "node")
    read = files.where(binary | (F.coalesce("content", F.lit("")) != "")).withColumn("folder", F.split_part("path", F.lit("/"), F.lit(1))).join(homes, "folder", "left")
    summary = F.concat(F.lit("Binary file: "), name, F.lit(" (."), _extension(F.col("path")), F.lit(", "), F.col("size").cast("string"), F.lit(" bytes)"))
    type_ = F.when(binary, "resource").otherwise(context_type(F.col("path"), F.col("content"), []))
    return read.select(
        F.substring(F.sha2("path", 256), 1, 32).alias("id"),
        F.concat(F.lit(f"{scheme}://"), "path").alias("uri"),
        type_.alias("type"),
        F.coalesce("node", F.lit("inbox")).alias("node"),
        "path",
        F.when(~binary & (heading != ""), heading).otherwise(plain).alias("title"),
        F.when(binary, "").otherwise(F.col("content")).alias("content"),
        F.when(binary, summary).alias("summary"),
        F.when(binary, BINARY_RATIO).alias("sn_ratio"),
    )


def signal_files(signals: DataFrame, folders: DataFrame, skeletons: DataFrame) -> DataFrame:
    """``(id, path, node, content)``: the Markdown files of each signal, one in its own folder and one for each other folder it is routed to.

    ``signals`` has ``(id, node, title, genre, signal_type, mode, format,
    sn_ratio, day, content, summary, description, entities, routed_to)``;
    folders without an entry in ``folders (node, folder)`` are ``inbox``.  A
    file is ``folder/signals/day-title.md``: front matter, the title, and the
    content without front matter of its own under its genre's skeleton.  A
    copy names the node that it comes from.
    """
    own = signals.withColumn("own", F.coalesce("node", F.lit("inbox")))
    targets = F.array_union(F.array("own"), F.filter(F.coalesce("routed_to", F.array().cast("array<string>")), lambda n: n.isNotNull()))
    each = own.withColumn("target", F.explode(targets))
    named = folders.select(F.col("node").alias("target"), "folder")
    placed = each.join(named, "target", "left").join(folders.select(F.col("node").alias("own"), F.col("folder").alias("own_folder")), "own", "left")
    placed = placed.withColumns({"folder": F.coalesce("folder", F.lit("inbox")), "own_folder": F.coalesce("own_folder", F.lit("inbox"))})
    placed = placed.where((F.col("target") == F.col("own")) | (F.col("folder") != F.col("own_folder")))
    title, genre = F.coalesce("title", F.lit("Untitled")), F.coalesce("genre", F.lit("note"))
    body = F.regexp_replace(F.coalesce("content", F.lit("")), r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    placed = with_skeleton(placed.withColumns({"genre": genre, "text": body}), skeletons)
    safe = lambda c: F.translate(F.coalesce(c, F.lit("")), '"\n', "' ")
    listed = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0, "  []\n").otherwise(F.array_join(F.transform(c, lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), ""))
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\n"))
    copied = F.when(F.col("target") != F.col("own"), line("cross_ref_from: ", F.col("own"))).otherwise("")
    ratio = F.round(F.coalesce(F.col("sn_ratio").cast("double"), F.lit(0.6)), 2).cast("string")
    content = F.concat(
        line("---"), line("node: ", F.col("target")), line("title: ", title), line("date: ", F.col("day").cast("string")), copied, line("signal:"), line("  mode: ", F.coalesce("mode", F.lit("linguistic"))), line("  genre: ", F.col("genre")),
        line("  type: ", F.coalesce("signal_type", F.lit("inform"))), line("  format: ", F.coalesce("format", F.lit("markdown"))), line("  sn_ratio: ", ratio), line("tiers:"), line('  l0: "', safe(F.col("summary")), '"'),
        line('  l1: "', safe(F.left(F.coalesce("description", F.lit("")), F.lit(PREVIEW))), '"'), line("entities:"), listed(F.col("entities")), line("routed_to:"), listed(F.col("routed_to")), line("---"), line(""), line("# ", title), line(""), F.col("structured"),
    )
    path = F.concat("folder", F.lit("/signals/"), F.col("day").cast("string"), F.lit("-"), slug(title), F.lit(".md"))
    return placed.select("id", path.alias("path"), F.col("target").alias("node"), content.alias("content"))


def coverage(sources: DataFrame, surfaces: DataFrame) -> DataFrame:
    """One row ``(total, covered, percentage)``: how many source files ``(path)`` some specification's surface ``(spec, path)`` names; 0 without sources."""
    named = surfaces.select("path").distinct().withColumn("named", F.lit(1))
    counted = sources.select("path").distinct().join(named, "path", "left").agg(F.count("*").alias("total"), F.count("named").alias("covered"))
    return counted.select("total", "covered", F.when(F.col("total") > 0, F.round(100.0 * F.col("covered") / F.col("total"), 1)).otherwise(0.0).alias("percentage"))


#: How well a requirement is verified, weakest first, and kinds of claims that name a file (fixed values).
STRENGTHS = ["claimed", "linked", "executed"]
FILE_KINDS = ["test_file", "source_file", "doc_file"]


def verified(requirements: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """``(spec, requirement, kind, target, strength, meets_minimum)``: each claim on each requirement, and requirements without one.

    ``requirements`` has ``(spec, requirement, minimum)``, ``claims`` ``(spec,
    requirement, kind, target, passed)``.  A command that passed counts as
    executed, a file that is among ``sources (path)`` as linked, all else as
    claimed; a requirement without a claim has the strength ``none``, which
    only a minimum of ``claimed`` takes.
    """
    files = sources.select(F.col("path").alias("target"), F.lit(True).alias("there")).distinct()
    met = requirements.join(claims, ["spec", "requirement"], "left").join(files, "target", "left")
    strength = (
        F.when(F.col("kind").isNull(), "none")
        .when((F.col("kind") == "command") & F.coalesce("passed", F.lit(False)), "executed")
        .when(F.col("kind").isin(FILE_KINDS) & F.coalesce("there", F.lit(False)), "linked")
        .otherwise("claimed")
    )
    order = F.array(*map(F.lit, STRENGTHS))
    rank = lambda c: F.array_position(order, c)
    enough = F.when(F.col("strength") == "none", F.col("minimum") == "claimed").otherwise(rank(F.col("strength")) >= rank(F.col("minimum")))
    return met.withColumn("strength", strength).select("spec", "requirement", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("target", F.lit("")).alias("target"), "strength", enough.alias("meets_minimum"))
