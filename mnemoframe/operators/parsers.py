"""Parsers of structured texts: source code, YAML and HTML, to flat rows with byte offsets.

A text is parsed by a small sequential function over its lines or events, in
Arrow batches; rows leave as flat tables, so nothing of a text's nesting is kept
beyond its own parse.
"""

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {
    "elixir": "ex exs", "python": "py", "javascript": "js jsx", "typescript": "ts tsx", "go": "go", "rust": "rs", "ruby": "rb", "java": "java", "c": "c h", "cpp": "cpp cc hpp", "csharp": "cs",
    "kotlin": "kt", "swift": "swift", "php": "php", "bash": "sh bash zsh", "lua": "lua", "perl": "pl", "sql": "sql", "scala": "scala", "clojure": "clj", "haskell": "hs", "ocaml": "ml", "fsharp": "fs",
    "dart": "dart", "nim": "nim", "zig": "zig", "vim": "vim", "elisp": "el",
}
#: Words that open a definition, whatever the language (fixed values).
DEFINERS = ["def", "defp", "function", "func", "fn", "class", "module", "struct", "interface", r"public[ \t]+(?:class|interface|static)", r"private[ \t]+def", "impl"]
_DEFINITION = re.compile(rb"^[ \t\r\f\v]*(" + "|".join(DEFINERS).encode() + rb")[ \t\r\f\v]+([A-Za-z0-9_.:]+)[^\n]*", re.MULTILINE)
#: HTML elements whose content isn't text (fixed values).
SILENT = {"script", "style", "noscript"}
#: Rows that leave a task at once.
_SENT = 20_000


def parsed(docs: DataFrame, parse: Callable[[str], Iterator[tuple]], columns: str, id_column: str, text_column: str) -> DataFrame:
    """The rows that ``parse`` finds in each text, each with its document's id; a null text has none."""
    kind = docs.schema[id_column].dataType.simpleString()
    shape = f"id {kind}, {columns}"
    arrow = pa.schema([pa.field(f.name, f.type) for f in _arrow_schema(docs, shape)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.as_py() is None:
                    continue
                for row in parse(text.as_py()):
                    rows.append((doc_id, *row))
                    if len(rows) == _SENT:
                        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow)

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, shape).withColumnRenamed("id", id_column)


def _arrow_schema(docs: DataFrame, shape: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(docs.sparkSession.createDataFrame([], shape).schema)


def language(path: Column) -> Column:
    """The language of a file by its extension, ``text`` where it isn't known."""
    known = F.create_map(*(F.lit(x) for name, endings in LANGUAGES.items() for ending in endings.split() for x in (ending, name)))
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"[^./]\.([^./]*)$", 1))), F.lit("text"))


def _definitions(text: str) -> Iterator[tuple]:
    data = text.encode()
    for found in _DEFINITION.finditer(data):
        line = found[0].decode()
        yield re.sub(r"\s+", " ", found[1].decode()), found[2].decode(), line.strip(), found.start(), len(found[0])


def definitions(files: DataFrame, id_column: str = "doc_id", path_column: str = "path", text_column: str = "text") -> DataFrame:
    """``(doc_id, language, keyword, name, text, offset, length)`` of each line that defines something, in any of the languages.

    Offset and length are bytes of the whole line; ``text`` is trimmed.  An
    unknown extension has the language ``text``; its lines are searched too.
    """
    found = parsed(files, _definitions, "keyword string, name string, text string, offset long, length long", id_column, text_column)
    languages = files.select(id_column, language(F.col(path_column)).alias("language")).distinct()
    return found.join(languages, id_column).select(id_column, "language", "keyword", "name", "text", "offset", "length")


class _Lines:
    """The lines of a YAML text that hold something: ``(indent, content, byte offset of the content)``; comments are cut."""

    def __init__(self, text: str) -> None:
        self.rows: list[tuple[int, str, int]] = []
        self.raw: list[str] = text.split("\n")
        self.at: list[int] = []  # for each row, its place in raw
        offset = 0
        for k, line in enumerate(self.raw):
            body = _without_comment(line.rstrip("\r"))
            indent = len(body) - len(body.lstrip(" "))
            if body.strip() and body.strip() not in ("---", "..."):
                if body[indent] == "\t":
                    raise ValueError(f"tab in the indentation of line {k + 1}")
                self.rows.append((indent, body.strip(), offset + indent))
                self.at.append(k)
            offset += len(line.encode()) + 1


def _without_comment(line: str) -> str:
    quote = ""
    for k, sign in enumerate(line):
        if quote:
            quote = "" if sign == quote else quote
        elif sign in "\"'" and (k == 0 or line[k - 1] in " [{,:"):
            quote = sign
        elif sign == "#" and (k == 0 or line[k - 1] in " \t"):
            return line[:k]
    return line


_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},"'&*!|>%@`-][^:#]*?|-[^\s:][^:#]*?)\s*:(?:\s+(.*)|$)""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " "}


def _scalar(text: str) -> tuple[str, str]:
    """Kind and value of a scalar."""
    if text[:1] == '"':
        if len(text) < 2 or text[-1] != '"':
            raise ValueError("a quoted value isn't closed on its line")
        return "string", re.sub(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[0]), text[1:-1])
    if text[:1] == "'":
        if len(text) < 2 or text[-1] != "'":
            raise ValueError("a quoted value isn't closed on its line")
        return "string", text[1:-1].replace("''", "'")
    if text[:1] in "&*!":
        raise ValueError("anchors, aliases and tags aren't read")
    if text in ("", "~", "null", "Null", "NULL"):
        return "null", ""
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return "boolean", text.lower()
    if re.fullmatch(r"[-+]?\d+", text):
        return "integer", text
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+(?=[eE]))([eE][-+]?\d+)?", text):
        return "float", text
    return "string", text


def _flow(text: str, path: str, offset: int) -> Iterator[tuple]:
    """Leaves of a list or a map written on one line."""
    depth, parts, start, quote = 0, [], 1, ""
    for k, sign in enumerate(text):
        if quote:
            quote = "" if sign == quote else quote
        elif sign in "\"'" and text[k - 1] in " [{,:":
            quote = sign
        elif sign in "[{":
            depth += 1
        elif sign in "]}":
            depth -= 1
            if depth == 0 and k != len(text) - 1:
                raise ValueError("something follows a closed list or map")
        if depth == (1 if sign == "," else 0) and not quote and (sign == "," or k == len(text) - 1):
            parts.append((text[start:k], start))
            start = k + 1
    if depth or quote or text[-1] != {"[": "]", "{": "}"}[text[0]]:
        raise ValueError("a list or map isn't closed on its line")
    if len(parts) == 1 and not parts[0][0].strip():
        yield path, "list" if text[0] == "[" else "map", "", offset
        return
    for n, (part, at) in enumerate(p for p in parts if p[0].strip() or p is not parts[-1]):
        inner = offset + len(text[:at].encode()) + len(part) - len(part.lstrip())
        part = part.strip()
        if text[0] == "{":
            key = _KEY.fullmatch(part)
            if not key:
                raise ValueError("a map has an entry without a key")
            name, value = _scalar(key[1])[1], (key[2] or "").strip()
            inside = len(part[: len(part) - len(value)].encode()) if value[:1] in ("[", "{") else 0
            yield from _value(value, _joined(path, name), inner + inside)
        else:
            yield from _value(part, f"{path}[{n}]", inner)


def _joined(path: str, key: str) -> str:
    return f"{path}.{key}" if path else key


def _value(text: str, path: str, offset: int) -> Iterator[tuple]:
    if text[:1] in ("[", "{"):
        yield from _flow(text, path, offset)
    else:
        yield path, *_scalar(text), offset


def _block(lines: _Lines, at: int, path: str, under: int = -1) -> tuple[list[tuple], int]:
    """Leaves of the block that starts at a row, and the row after it.  A list may stand as far left as the key that it belongs to (``under``)."""
    out: list[tuple] = []
    indent, first, _ = lines.rows[at]
    sequence, n = first == "-" or first.startswith("- "), 0
    seen: set[str] = set()
    while at < len(lines.rows) and lines.rows[at][0] == indent:
        _, body, offset = lines.rows[at]
        if (body == "-" or body.startswith("- ")) != sequence:
            if sequence and indent == under:
                break
            raise ValueError(f"line {lines.at[at] + 1} mixes a list and a map")
        if sequence:
            own, rest = f"{path}[{n}]", body[1:].strip()
            n += 1
            if rest and _KEY.fullmatch(rest) and rest[0] not in "\"'[{" or re.match(r"- |-$", rest):
                # What follows the dash is a block of its own, indented as far as it stands.
                shift = len(body) - len(rest)
                lines.rows[at] = (indent + shift, rest, offset + shift)
                found, at = _block(lines, at, own)
                out += found
                continue
        else:
            key = _KEY.fullmatch(body)
            if not key:
                raise ValueError(f"line {lines.at[at] + 1} has no key")
            own, rest = _joined(path, _scalar(key[1])[1]), (key[2] or "").strip()
            if own in seen:
                raise ValueError(f"line {lines.at[at] + 1} repeats a key")
            seen.add(own)
        if re.fullmatch(r"[|>][-+]?", rest):
            text, at = _literal(lines, at, indent, rest)
            out.append((own, "string", text, offset))
        elif rest:
            inside = len(body[: len(body) - len(rest)].encode()) if rest[0] in "[{" else 0
            out += list(_value(rest, own, offset + inside))
            at += 1
        elif at + 1 < len(lines.rows) and (lines.rows[at + 1][0] > indent or (not sequence and lines.rows[at + 1][0] == indent and re.match(r"- |-$", lines.rows[at + 1][1]))):
            found, at = _block(lines, at + 1, own, indent)
            out += found
        else:
            out.append((own, "null", "", offset))
            at += 1
    if at < len(lines.rows) and lines.rows[at][0] > indent:
        raise ValueError(f"line {lines.at[at] + 1} is indented deeper than its block")
    return out, at


def _literal(lines: _Lines, at: int, indent: int, style: str) -> tuple[str, int]:
    """A text of several lines, kept (``|``) or folded (``>``)."""
    first = k = lines.at[at] + 1
    body = []
    while k < len(lines.raw) and (not lines.raw[k].strip() or len(lines.raw[k]) - len(lines.raw[k].lstrip(" ")) > indent):
        body.append(lines.raw[k].rstrip("\r"))
        k += 1
    depth = min((len(x) - len(x.lstrip(" ")) for x in body if x.strip()), default=0)
    rows = [x[depth:] for x in body]
    while rows and not rows[-1].strip():
        rows.pop()
    text = "\n".join(rows) if style[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(rows)).replace("\n\n", "\n")
    at += 1
    while at < len(lines.rows) and first <= lines.at[at] < k:
        at += 1
    return text + ("" if style.endswith("-") or not rows else "\n"), at


def _yaml(text: str) -> Iterator[tuple]:
    """Rows ``(path, kind, value, offset, is_top, warning)``."""
    try:
        lines, rows, at = _Lines(text), [], 0
        if lines.rows:
            rows, at = _block(lines, 0, "") if _KEY.fullmatch(lines.rows[0][1]) or lines.rows[0][1][0] == "-" else (list(_value(lines.rows[0][1], "", lines.rows[0][2])), 1)
        if at < len(lines.rows):
            raise ValueError(f"line {lines.at[at] + 1} belongs to no block")
    except (ValueError, RecursionError) as error:
        yield "", "raw", text, 0, str(error)
        return
    for path, kind, value, offset in rows:
        yield path, kind, value, offset, None


def _toml(text: str) -> Iterator[tuple]:
    yield "", "raw", text, 0, "TOML is kept as raw text"


def yaml_leaves(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", toml: bool = False) -> DataFrame:
    """``(doc_id, path, kind, value, offset, warning)``: each leaf of a YAML text with the path to it, as ``a.b[0].c``.

    Reads block and one-line lists and maps, plain and quoted scalars,
    comments, and kept or folded texts of several lines.  ``kind`` is string,
    integer, float, boolean, null, or list and map for empty ones; ``offset``
    is the byte where the leaf's key (or, in a list, its entry) stands.  A text
    that can't be read so, or TOML, is one row of kind ``raw`` with a warning;
    an empty text has no rows.
    """
    # A small file of short texts is one task's input, but long work: it is dealt to as many tasks as shuffles have.
    docs = docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_column)
    return parsed(docs, _toml if toml else _yaml, "path string, kind string, value string, offset long, warning string", id_column, text_column)


def top_level_keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, key, offset)``: the first keys of each YAML text, with the byte where ``key:`` first stands in it (0 if it doesn't)."""
    leaves = yaml_leaves(docs, id_column, text_column).where("warning IS NULL")
    keys = leaves.select(id_column, F.regexp_extract("path", r"^([^.\[]+)", 1).alias("key")).where("key <> ''").distinct()
    texts = docs.select(id_column, F.col(text_column).alias("_text"))
    at = F.expr("octet_length(substring_index(_text, concat(key, ':'), 1))")
    found = F.expr("instr(_text, concat(key, ':')) > 0")
    return keys.join(texts, id_column).select(id_column, "key", F.when(found, at).otherwise(0).cast("long").alias("offset"))


class _Page(HTMLParser):
    """Texts of a page in order, its title and its headings."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.silent: list[str] = []
        self.title: list[str] | None = None
        self.in_title = False
        self.headings: list[tuple[int, list[str]]] = []
        self.open: list[int] = []
        self.in_text = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.in_text = False
        if tag in SILENT:
            self.silent.append(tag)
        elif tag == "title":
            self.in_title, self.title = True, self.title if self.title is not None else []
        elif re.fullmatch("h[1-6]", tag):
            self.open.append(len(self.headings))
            self.headings.append((int(tag[1]), []))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.in_text = False

    def handle_comment(self, data: str) -> None:
        self.in_text = False

    def handle_endtag(self, tag: str) -> None:
        self.in_text = False
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass
        elif tag == "title":
            self.in_title = False
        elif re.fullmatch("h[1-6]", tag) and self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.in_text:  # a text may come in several pieces
            self.texts[-1] += data
        else:
            self.texts.append(data)
        self.in_text = True
        if self.in_title:
            self.title.append(data)
        for k in self.open:
            self.headings[k][1].append(data)


def _normal(text: str) -> str:
    text = re.sub(r"\r\n|\r", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[\t ]+", " ", text)).strip()


def _html(text: str) -> Iterator[tuple]:
    page = _Page()
    page.feed(text)
    page.close()
    plain = _normal("\n".join(t for t in page.texts if t.strip()))
    title = _normal("".join(page.title or [])) or None
    data, rows = plain.encode(), []
    for level, parts in page.headings:
        heading = _normal("".join(parts))
        rows.append({"level": level, "text": heading, "offset": max(data.find(heading.encode()), 0), "length": len(heading.encode())})
    rows.sort(key=lambda r: (r["offset"], r["level"]))
    yield title, plain, rows, len(text.encode())


def html_pages(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``(page_id, title, text, headings, html_bytes)``: the visible text of each page, its title, and h1 to h6 with their bytes in that text.

    Texts between tags are joined by line feeds, with single spaces and at
    most one blank line; scripts, styles and noscript are left out.  A heading
    whose words are cut by other elements isn't found in the text and has the
    offset 0.  An empty page has an empty text, and null as its title.
    """
    return parsed(pages, _html, "title string, text string, headings array<struct<level:int,text:string,offset:long,length:long>>, html_bytes long", id_column, html_column)


def merged_settings(configs: DataFrame, defaults: DataFrame, id_column: str = "workspace", text_column: str = "text") -> DataFrame:
    """``(workspace, path, kind, value)``: each workspace's settings, its YAML over the ``defaults (path, kind, value)``.

    Maps are merged key by key; a list, a scalar or null of the YAML takes the
    place of whatever the defaults have there, and so does a map that stands
    where they have a scalar.  A text that can't be read, or is null or empty,
    leaves the defaults.  These are a short table that meets the workspaces as
    one row.
    """
    own = yaml_leaves(configs, id_column, text_column).where("warning IS NULL").select(id_column, "path", "kind", "value")
    named = own.groupBy(id_column).agg(F.collect_set(F.regexp_extract("path", r"^([^\[]*)", 1)).alias("own_paths"))
    listed = defaults.agg(F.collect_list(F.struct("path", "kind", "value")).alias("defaults"))
    rows = configs.select(id_column).distinct().join(named, id_column, "left").crossJoin(F.broadcast(listed))
    base = lambda d: F.regexp_extract(d["path"], r"^([^\[]*)", 1)
    under = lambda a, b: F.startswith(a, F.concat(b, F.lit(".")))
    replaced = lambda d: F.exists(F.coalesce("own_paths", F.array().cast("array<string>")), lambda q: (q == base(d)) | under(q, base(d)) | under(base(d), q))
    kept = rows.select(id_column, F.explode(F.filter("defaults", lambda d: ~replaced(d))).alias("d")).select(id_column, "d.path", "d.kind", "d.value")
    return own.unionByName(kept)
