"""Wiki pages: directives, links and integrity."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verbs that a page may use, and its size limit in bytes.
VERBS = ["cite", "include", "expand", "search", "table", "trace", "recent"]
MOST_BYTES = 50_000
#: Bytes before a citation in which its claims stand (fixed value, counted in characters here).
CLAIM_REACH = 200
_CITE = r"\{\{\s*cite\s*:\s*([^}]+?)\s*\}\}"
_ENTITY, _VALUE = r"\*\*([^*\n]+)\*\*", r"(\$[\d,]+(?:\.\d+)?[KMB]?|[\d,]+(?:\.\d+)?%|\d{4}-\d{2}-\d{2})"
_DIRECTIVE, _LINK = r"\{\{\s*([a-z_]+)\s*:\s*([^}]*?)\s*\}\}", r"\[\[([^\]]+)\]\]"


def _all(body: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(body, F.lit(pattern), F.lit(group))


def directives(pages: DataFrame, id_column: str = "doc_id", body: str = "body") -> DataFrame:
    """``(doc_id, verb, argument)``: a row for each directive, and for each link with the verb ``wikilink``."""
    found = F.arrays_zip(_all(F.col(body), _DIRECTIVE, 1).alias("verb"), _all(F.col(body), _DIRECTIVE, 2).alias("argument"))
    links = pages.select(id_column, F.lit("wikilink").alias("verb"), F.explode(_all(F.col(body), _LINK, 1)).alias("argument"))
    return pages.select(id_column, F.explode(found).alias("d")).select(id_column, "d.verb", "d.argument").unionByName(links)


def whitelisted(body: Column) -> Column:
    """Whether all directives use known verbs; links always do."""
    return F.forall(_all(body, _DIRECTIVE, 1), lambda v: v.isin(VERBS))


def problems(pages: DataFrame, sources: DataFrame, id_column: str = "doc_id", body: str = "body") -> DataFrame:
    """``(doc_id, problem, detail)``: unknown verbs, citations of sources that don't exist (``uri``), and pages without text or too large."""
    found = directives(pages, id_column, body)
    unknown = found.where(~F.col("verb").isin([*VERBS, "wikilink"])).select(id_column, F.lit("invalid_verb").alias("problem"), F.col("verb").alias("detail"))
    cites = found.where("verb = 'cite'").select(id_column, F.col("argument").alias("uri"))
    broken = cites.join(sources.select("uri").distinct(), "uri", "left_anti").select(id_column, F.lit("broken_cite").alias("problem"), F.col("uri").alias("detail"))
    size = F.octet_length(F.coalesce(F.col(body), F.lit("")))
    sized = pages.where((size == 0) | (size > MOST_BYTES)).select(id_column, F.when(size == 0, "empty").otherwise("too_large").alias("problem"), size.cast("string").alias("detail"))
    return unknown.unionByName(broken).unionByName(sized)


def claims(pages: DataFrame, id_column: str = "doc_id", body: str = "body") -> DataFrame:
    """``(doc_id, place, entity, attr, value, uri)``: bold entities with prices, shares and dates of the same line, shortly before a citation.

    ``place`` counts a page's citations from 1; ``attr`` is ``date`` or ``numeric``.
    """
    cites, uris = _all(F.col(body), _CITE, 0), _all(F.col(body), _CITE, 1)
    parts = F.arrays_zip(F.slice(F.split(body, _CITE), F.lit(1), F.size(cites)).alias("before"), cites.alias("cite"), uris.alias("uri"))
    # One pass over a page's citations carries the text's last characters along.
    start = F.struct(F.lit("").alias("tail"), F.array().cast("array<struct<place:int,passage:string,uri:string>>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        passage = F.right(F.concat(state["tail"], part["before"]), F.lit(CLAIM_REACH))
        found = F.struct((F.size(state["out"]) + 1).alias("place"), passage.alias("passage"), part["uri"].alias("uri"))
        return F.struct(F.right(F.concat(passage, part["cite"]), F.lit(CLAIM_REACH)).alias("tail"), F.concat(state["out"], F.array(found)).alias("out"))

    passages = pages.select(id_column, F.explode(F.aggregate(parts, start, step, lambda s: s["out"])).alias("x"))
    lines = passages.select(id_column, "x.place", "x.uri", F.explode(F.split("x.passage", "\n")).alias("line"))
    pairs = lines.select(id_column, "place", "uri", "line", F.explode(_all(F.col("line"), _ENTITY, 1)).alias("entity"))
    pairs = pairs.select(id_column, "place", "uri", F.lower("entity").alias("entity"), F.explode(_all(F.col("line"), _VALUE, 1)).alias("value"))
    attr = F.when(F.col("value").rlike(r"\d{4}-\d{2}-\d{2}"), "date").otherwise("numeric")
    return pairs.select(id_column, "place", "entity", attr.alias("attr"), "value", "uri")


def _clashes(pages: DataFrame) -> DataFrame:
    plain = F.lower(F.regexp_replace("value", ",", ""))
    found = claims(pages).groupBy("doc_id", "entity", "attr").agg(F.countDistinct(plain).alias("n"), F.max(F.struct("place", "value")).getField("value").alias("value"))
    return found.where("n >= 2")


def contradictions(pages: DataFrame) -> DataFrame:
    """``(doc_id, entity, attr, n)``: entities of a page with two or more values of one kind, commas and case aside."""
    return _clashes(pages).select("doc_id", "entity", "attr", "n")


def resolved(pages: DataFrame) -> DataFrame:
    """The value that stays of each contradiction where newer citations win: that of the last one."""
    return _clashes(pages).select("doc_id", "entity", "attr", "value")


def cited_claims(pages: DataFrame, id_column: str = "doc_id", body: str = "body") -> DataFrame:
    """``(doc_id, claim, uri)``: each line with citations, without them, once for each source."""
    lines = pages.select(id_column, F.explode(F.split(body, "\n")).alias("line"))
    claim = F.trim(F.regexp_replace("line", _CITE, ""))
    return lines.select(id_column, claim.alias("claim"), F.explode(_all(F.col("line"), _CITE, 1)).alias("uri"))


#: How each format marks the n-th citation, wraps a directive that isn't resolved, and lists the sources (fixed values).
FORMATS = {
    "plain": (" [{}]", "⟨", "⟩", "\n\nSources:\n", "[{}] "),
    "markdown": (" [^{}]", "`", "`", "\n\n---\n\n", "[^{}]: "),
    "claude": ("", "", "", "\n\n", ""),
}


def rendered(pages: DataFrame, format: str = "markdown", id_column: str = "doc_id", body: str = "body") -> DataFrame:
    """``(doc_id, text)``: pages with numbered citations and a list of their sources; other directives stay as marked text."""
    mark, opened, closed, head, label = FORMATS[format]
    raw, verbs, arguments = _all(F.col(body), _DIRECTIVE, 0), _all(F.col(body), _DIRECTIVE, 1), _all(F.col(body), _DIRECTIVE, 2)
    segments = F.split(body, _DIRECTIVE)
    parts = F.arrays_zip(F.slice(segments, F.lit(1), F.size(raw)).alias("before"), raw.alias("raw"), verbs.alias("verb"), arguments.alias("argument"))
    numbered = lambda pattern, n: F.concat(*(x for k, piece in enumerate(pattern.split("{}")) for x in ([n.cast("string")] if k else []) + [F.lit(piece)]))
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("sources"), F.lit(0).alias("n"))

    def step(state: Column, part: Column) -> Column:
        cite = part["verb"] == "cite"
        n = state["n"] + 1
        listed = F.concat(F.lit('<document index="'), n.cast("string"), F.lit('" source="'), part["argument"], F.lit('"></document>')) if format == "claude" else F.concat(numbered(label, n), part["argument"])
        text = F.concat(state["text"], part["before"], F.when(cite, numbered(mark, n)).otherwise(F.concat(F.lit(opened), part["raw"], F.lit(closed))))
        sources = F.when(cite, F.concat(state["sources"], F.when(state["n"] > 0, F.lit("\n")).otherwise(F.lit("")), listed)).otherwise(state["sources"])
        return F.struct(text.alias("text"), sources.alias("sources"), F.when(cite, n).otherwise(state["n"]).alias("n"))

    done = F.aggregate(parts, start, step)
    text = F.concat(F.col("d.text"), F.element_at(segments, -1), F.when(F.col("d.n") > 0, F.concat(F.lit(head), F.col("d.sources"))).otherwise(F.lit("")))
    if format == "claude":
        text = F.concat(F.lit("<context>\n"), text, F.lit("\n</context>"))
    return pages.withColumn("d", done).select(id_column, text.alias("text"))


def headings(body: Column) -> Column:
    """The page's second-level headings, in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?m)^##[ \t]+(\S.*?)[ \t\r]*$"), F.lit(1)), lambda h: F.lower(h))


def schema_issues(pages: DataFrame, rules: DataFrame, id_column: str = "slug", body: str = "body", frontmatter: str = "frontmatter") -> DataFrame:
    """``(slug, issue, detail)``: pages held against ``rules (kind, value)``.

    A ``required_section`` is a second-level heading, whatever its case; a
    ``required_frontmatter`` key must be there and not be empty; ``max_bytes``
    bounds the body, by the least of several.  The rules are a short table and
    meet the pages as one row.  A null body is empty, null front matter has no
    key; other kinds of rules are left out.
    """
    kind = lambda name: F.array_sort(F.collect_set(F.when(F.col("kind") == name, F.col("value"))))
    listed = rules.agg(kind("required_section").alias("_sections"), kind("required_frontmatter").alias("_keys"), F.min(F.when(F.col("kind") == "max_bytes", F.col("value").cast("long"))).alias("_most"))
    met = pages.crossJoin(F.broadcast(listed))
    present, size = headings(F.col(body)), F.octet_length(F.coalesce(F.col(body), F.lit("")))
    meta = F.coalesce(F.col(frontmatter), F.create_map().cast("map<string,string>"))
    issue = lambda name, detail: F.struct(F.lit(name).alias("issue"), detail.alias("detail"))
    sections = F.transform(F.filter("_sections", lambda s: ~F.array_contains(present, F.lower(s))), lambda s: issue("missing_section", s))
    keys = F.filter("_keys", lambda k: F.coalesce(F.try_element_at(meta, k), F.lit("")) == "")
    keys = F.transform(keys, lambda k: F.struct(F.when(F.try_element_at(meta, k).isNull(), "missing_frontmatter").otherwise("empty_frontmatter").alias("issue"), k.alias("detail")))
    large = F.when(size > F.col("_most"), F.array(issue("schema_size_exceeded", size.cast("string")))).otherwise(F.array().cast("array<struct<issue:string,detail:string>>"))
    return met.select(id_column, F.explode(F.concat(sections, keys, large)).alias("i")).select(id_column, "i.issue", "i.detail")


#: Characters of a citation's text that a curated page shows (fixed value).
PREVIEW = 240


def curated(pages: DataFrame, citations: DataFrame) -> DataFrame:
    """The next version ``(slug, version, body, curated_by)`` of each page ``(slug, audience, version, body)`` with new citations.

    ``citations`` has ``(slug, uri, text)``; they are listed under ``## New
    signals`` at the page's end, in order of uri, in place of such a section
    that stands there.  Pages without a citation are not returned, citations
    of no page are left out.  A null text is empty; one citation twice is
    listed once.
    """
    trimmed = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    preview = F.regexp_replace(F.left(trimmed(F.coalesce("text", F.lit(""))), F.lit(PREVIEW)), r"\s+", " ")
    entry = F.struct("uri", F.concat(F.lit("- "), preview, F.lit(" {{cite: "), "uri", F.lit("}}")).alias("line"))
    listed = citations.where("uri IS NOT NULL").groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_set(entry)), lambda e: e["line"]), "\n").alias("lines"))
    rest = F.regexp_replace(F.regexp_extract(F.coalesce("body", F.lit("")), r"(?is)\A(.*?)(?:\n##\s+New signals\s*\n.*)?\z", 1), r"\s+\z", "")
    kept = F.when(F.coalesce("body", F.lit("")).rlike(r"(?i)\n##\s+New signals\s*\n"), rest).otherwise(F.coalesce("body", F.lit("")))
    body = F.concat(F.regexp_replace(F.concat(kept, F.lit("\n\n## New signals\n\n"), "lines"), r"\s+\z", ""), F.lit("\n"))
    return pages.join(listed, "slug").select("slug", (F.col("version") + 1).alias("version"), body.alias("body"), F.concat(F.lit("deterministic:"), F.col("audience").cast("string")).alias("curated_by"))


def page_fields(files: DataFrame, text: str = "text") -> DataFrame:
    """``files`` with ``frontmatter`` (a map of text), ``slug``, ``audience``, ``version`` and ``body`` read from a page file.

    Front matter stands between a first line ``---`` and the next one, as
    ``key: value`` lines, the first of a key counting; without it the whole
    text is the body.  A missing audience is ``default``, a version that isn't
    a whole number 1; a missing slug is null.
    """
    pattern = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"
    content = F.coalesce(F.col(text), F.lit(""))
    found = content.rlike(pattern)
    lines = F.filter(F.split(F.regexp_extract(content, pattern, 1), r"\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["key"] == p["key"]))
    meta = F.when(found, F.map_from_entries(first)).otherwise(F.create_map().cast("map<string,string>"))
    named = files.withColumn("frontmatter", meta)
    value = lambda key: F.try_element_at("frontmatter", F.lit(key))
    version = F.when(value("version").rlike("^[0-9]{1,9}$"), value("version").cast("int")).otherwise(1)
    body = F.when(found, F.regexp_replace(F.regexp_extract(content, pattern, 2), r"\A\n+", "")).otherwise(content)
    return named.withColumns({"slug": value("slug"), "audience": F.coalesce(value("audience"), F.lit("default")), "version": version, "body": body})


def page_file(frontmatter: str = "frontmatter") -> Column:
    """A page's file: its front matter, with slug, audience and version, as sorted lines, then its body."""
    own = F.create_map(*(x for c in ("slug", "audience", "version") for x in (F.lit(c), F.col(c).cast("string"))))
    kept = F.map_filter(F.coalesce(F.col(frontmatter), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("slug", "audience", "version"))
    entries = F.array_sort(F.map_entries(F.map_concat(kept, F.map_filter(own, lambda k, v: v.isNotNull()))))
    lines = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")), F.lit("\n"))), "")
    return F.concat(F.lit("---\n"), lines, F.lit("---\n\n"), F.coalesce("body", F.lit("")))
