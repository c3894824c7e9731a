"""Documents into structure: parsers of text formats, and the tree of document, sections, paragraphs and chunks.

Lines and their byte offsets are rows, and a parser's state is a running count
over a document's lines; so parsing is a window over the document, not a loop.
"""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from mnemoframe.functions.text import ascii_borders
from mnemoframe.operators.pipeline import OVERLAP_BYTES, WINDOW_BYTES

HEADING = r"^(#{1,6})\s+(.+)$"


def _in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, line_no, line, offset)``: every line of every document, and the bytes before it."""
    lines = docs.where(F.col(text).isNotNull()).select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("offset", F.coalesce(F.sum(F.octet_length("line") + 1).over(_in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def markdown(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, kind, offset, length, text, level, language)``: headings, paragraphs and fenced code of Markdown.

    A fence line opens or closes code; within it no line is a heading.  A
    paragraph is a run of other lines that aren't blank.  Code without a
    closing fence gives nothing.  Null texts have no lines.
    """
    lines = lines_of(docs, text).withColumn("fence", F.col("line").startswith("```"))
    lines = lines.withColumn("fences", F.sum(F.col("fence").cast("int")).over(_in_order()))
    inside = ~F.col("fence") & (F.col("fences") % 2 == 1)
    kind = F.when(F.col("fence"), "fence").when(inside, "code").when(F.col("line").rlike(HEADING), "heading").when(F.trim("line", F.lit(" \t\r")) == "", "blank").otherwise("content")
    lines = lines.withColumn("kind", kind)
    lines = lines.withColumn("run", F.sum((F.col("kind") != "content").cast("int")).over(_in_order()))
    joined = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]))
    none = F.lit(None)
    headings = lines.where("kind = 'heading'").select("doc_id", "kind", "offset", F.octet_length("line").alias("length"), F.regexp_extract("line", HEADING, 2).alias("text"), F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), none.cast("string").alias("language"))
    paragraphs = lines.where("kind = 'content'").groupBy("doc_id", "run").agg(F.min("offset").alias("offset"), joined.alias("text"))
    paragraphs = paragraphs.select("doc_id", F.lit("paragraph").alias("kind"), "offset", F.octet_length("text").alias("length"), "text", none.cast("int").alias("level"), none.cast("string").alias("language"))
    # Lines of code belong to the odd fence before them; an even fence closes it.
    opened = F.col("fences") - F.when(F.col("fence") & (F.col("fences") % 2 == 0), 1).otherwise(0)
    code = lines.where("kind IN ('fence', 'code')").groupBy("doc_id", opened.alias("block")).agg(
        F.min("offset").alias("offset"), F.sum(F.col("fence").cast("int")).alias("marks"),
        F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.when(~F.col("fence"), F.struct("line_no", "line")))), lambda x: x["line"])).alias("text"),
        F.trim(F.substring(F.min_by("line", "line_no"), 4, 1000)).alias("language"),
    )
    code = code.where("marks = 2").select("doc_id", F.lit("code_block").alias("kind"), "offset", F.octet_length("text").alias("length"), "text", none.cast("int").alias("level"), "language")
    return headings.unionByName(paragraphs).unionByName(code)


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, offset, length)`` of the runs of lines that aren't blank."""
    lines = lines_of(docs, text).withColumn("blank", F.trim("line", F.lit(" \t\r")) == "")
    lines = lines.withColumn("run", F.sum(F.col("blank").cast("int")).over(_in_order())).where("NOT blank")
    spans = lines.groupBy("doc_id", "run").agg(F.min("offset").alias("offset"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    return spans.select("doc_id", "offset", (F.col("bytes") - 1).alias("length"))


def csv_rows(docs: DataFrame, text: str = "text", delimiter: str = ",") -> DataFrame:
    """``(doc_id, row_no, name, value)`` of inline tables with a header line; cells without a name are dropped."""
    lines = docs.select("doc_id", F.posexplode(F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")).alias("line_no", "line"))
    cells = lines.select("doc_id", "line_no", F.transform(F.split("line", delimiter), lambda x: F.trim(x)).alias("cells"))
    header = cells.where("line_no = 0").select("doc_id", F.col("cells").alias("names"))
    body = cells.where("line_no > 0").join(header, "doc_id").select("doc_id", F.col("line_no").alias("row_no"), F.explode(F.arrays_zip(F.col("names").alias("name"), F.col("cells").alias("value"))).alias("x"))
    return body.select("doc_id", "row_no", F.col("x.name").alias("name"), F.col("x.value").alias("value")).where("name IS NOT NULL")


def json_keys(docs: DataFrame, text: str) -> DataFrame:
    """``(id, key, offset)``: top-level keys of JSON objects, and where their names first stand (from 0)."""
    keys = docs.select("id", F.col(text).alias("t"), F.explode(F.json_object_keys(text)).alias("key"))
    return keys.select("id", "key", (F.expr("locate(concat('\"', key, '\"'), t)") - 1).alias("offset"))


def memory_entries(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, id, category, stamp, content)`` of the entries ``## [category] stamp`` of a memory file; the id is the head of a hash of the rest."""
    head = r"\A## \[([^\]]+)\][ \t]+([^\n]+)"
    parts = docs.select("doc_id", F.explode(F.split(text, r"(?m)^(?=## \[)")).alias("part")).where(F.col("part").rlike(head))
    content = F.trim(F.regexp_replace("part", head, ""), F.lit(" \t\r\n"))
    found = parts.select("doc_id", F.regexp_extract("part", head, 1).alias("category"), F.regexp_extract("part", head, 2).alias("stamp"), content.alias("content"))
    return found.select("doc_id", F.substring(F.sha2(F.concat_ws(":", "category", "stamp", "content"), 256), 1, 16).alias("id"), "category", "stamp", "content")


def frontmatter(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, name, value)`` of the lines ``name: value`` between a first line ``---`` and the next one."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    lines = docs.select("doc_id", F.explode(F.split(block, "\n")).alias("line")).where(r"line RLIKE '^[A-Za-z_]+:'")
    return lines.select("doc_id", F.split_part("line", F.lit(":"), F.lit(1)).alias("name"), F.trim(F.regexp_replace("line", "^[A-Za-z_]+:", "")).alias("value"))


def title(text: Column, fallback: Column) -> Column:
    """The first heading of level one; without one the fallback, without that ``Untitled``."""
    found = F.trim(F.regexp_extract(text, r"(?m)^# +(.+)$", 1))
    return F.when(found != "", found).otherwise(F.coalesce(fallback, F.lit("Untitled")))


def summary(text: Column, most: int = 500) -> Column:
    """The text without heading marks and with single spaces, cut at the last word that fits into ``most`` characters."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^#+ +", ""), r"[ \t\n\r]+", " "))
    cut = F.regexp_replace(F.substring(flat, 1, most), r" [^ ]*$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit("…")))


def evidence(text: Column, pattern: str) -> Column:
    """A window around a pattern's first match, 20 characters before it and 60 after, trimmed; null without a match."""
    around = F.regexp_extract(text, f"(?s)(.{{0,20}}(?:{ascii_borders(pattern)}).{{0,60}})", 1)
    return F.when(around != "", F.trim(around, F.lit(" \t\r\n")))


def decompose(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, scale, idx, parent, offset, length)``: the tree of each document, section, paragraph and chunk.

    Sections begin at headings; what stands before the first is a section too,
    and a document without headings is one section.  Paragraphs belong to the
    section that holds their first byte.  Chunks are overlapping windows of a
    paragraph's bytes.  ``idx`` counts from 0 in order of offsets within a
    document and scale; ``parent`` is the index one scale up.  Null and empty
    texts give the document alone.
    """
    base = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    whole = base.select("doc_id", F.octet_length("text").alias("size"))
    document = whole.select("doc_id", F.lit("document").alias("scale"), F.lit(0).alias("idx"), F.lit(None).cast("int").alias("parent"), F.lit(0).cast("long").alias("offset"), F.col("size").cast("long").alias("length"))
    elements = markdown(base)
    starts = elements.where("kind = 'heading'").select("doc_id", "offset").unionByName(whole.where("size > 0").select("doc_id", F.lit(0).cast("long").alias("offset"))).distinct()
    by_offset = Window.partitionBy("doc_id").orderBy("offset")
    sections = starts.join(whole, "doc_id").select("doc_id", F.lit("section").alias("scale"), (F.row_number().over(by_offset) - 1).alias("idx"), F.lit(0).alias("parent"), "offset", (F.coalesce(F.lead("offset").over(by_offset), F.col("size")) - F.col("offset")).alias("length"))
    marks = sections.select("doc_id", "offset", F.col("idx").alias("section"), F.lit(None).cast("int").alias("length"))
    found = elements.where("kind = 'paragraph'").select("doc_id", "offset", F.lit(None).cast("int").alias("section"), "length")
    # One ordered pass gives each paragraph the section before it; a section starts before a paragraph of the same offset.
    merged = marks.unionByName(found).withColumn("parent", F.last("section", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("offset", F.col("section").isNull())))
    inner = merged.where("section IS NULL").select("doc_id", F.lit("paragraph").alias("scale"), (F.row_number().over(by_offset) - 1).alias("idx"), "parent", "offset", F.col("length").cast("long").alias("length"))
    step = WINDOW_BYTES - OVERLAP_BYTES
    last = F.greatest(F.ceil((F.col("length") - F.lit(OVERLAP_BYTES)) / F.lit(step)).cast("int") - 1, F.lit(0))
    cut = inner.select("doc_id", F.col("idx").alias("parent"), F.col("offset").alias("begin"), F.col("length").alias("size"), F.explode(F.sequence(F.lit(0), last)).alias("k"))
    cut = cut.select("doc_id", "parent", (F.col("begin") + F.col("k") * step).alias("offset"), F.least(F.lit(WINDOW_BYTES), F.col("size") - F.col("k") * step).alias("length"))
    chunks = cut.select("doc_id", F.lit("chunk").alias("scale"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("offset", "parent")) - 1).alias("idx"), "parent", "offset", "length")
    return document.unionByName(sections).unionByName(inner).unionByName(chunks)


def scale_counts(tree: DataFrame) -> DataFrame:
    """``(doc_id, scale, n)`` for all four scales, 0 where there is none."""
    scales = F.explode(F.array(*map(F.lit, ("document", "section", "paragraph", "chunk")))).alias("scale")
    wanted = tree.where("scale = 'document'").select("doc_id", scales)
    counts = tree.groupBy("doc_id", "scale").agg(F.count("*").alias("n"))
    return wanted.join(counts, ["doc_id", "scale"], "left").select("doc_id", "scale", F.coalesce("n", F.lit(0)).alias("n"))
