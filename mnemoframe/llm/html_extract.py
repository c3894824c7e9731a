"""Main-text extraction: flat text blocks classified by a small decision tree.

A page is cut into flat blocks at block-level tags.  A block is described by
its own word count and link density and by those of its neighbours, two on
either side; a decision tree grown from LABELLED decides by these numbers alone
which blocks belong to the article.  Where the page's own markup says otherwise
(an article element; a menu, footer, form, advert or comment by element, class,
id or role), the markup corrects the tree.
"""

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import bounded_batches

#: Neighbours on either side that describe a block.
NEIGHBOURS = 2
FEATURES = [f"{what}{at:+d}" if at else what for at in (0, *(k for n in range(1, NEIGHBOURS + 1) for k in (-n, n))) for what in ("words", "density")]

#: Labelled pages: for each block its words, its link density, and 1 for article or 0 for the rest.
LABELLED = [
    # menu, advert, article, footer
    [(1, 1.0, 0), (2, 1.0, 0), (1, 1.0, 0), (1, 1.0, 0), (8, 0.0, 0), (9, 0.0, 1), (44, 0.0, 1), (30, 0.0, 1), (6, 0.0, 1), (71, 0.0, 1), (12, 0.0, 0)],
    [(1, 1.0, 0), (1, 1.0, 0), (3, 1.0, 0), (2, 1.0, 0), (5, 0.0, 0), (11, 0.0, 1), (24, 0.0, 1), (9, 0.0, 0)],
    [(2, 1.0, 0), (2, 1.0, 0), (1, 1.0, 0), (12, 0.0, 0), (7, 0.0, 1), (9, 0.0, 1), (14, 0.0, 0)],
    [(1, 1.0, 0), (1, 1.0, 0), (1, 1.0, 0), (4, 0.0, 0), (3, 0.0, 1), (3, 0.0, 1), (18, 0.0, 1), (60, 0.0, 1), (2, 0.0, 1), (1, 0.0, 1), (5, 0.0, 1), (35, 0.0, 1), (4, 0.0, 1), (7, 0.0, 0)],
    [(1, 1.0, 0), (4, 1.0, 0), (1, 1.0, 0), (15, 0.0, 0), (10, 0.0, 1), (120, 0.0, 1), (17, 0.0, 0)],
    [(2, 1.0, 0), (1, 1.0, 0), (1, 1.0, 0), (10, 0.0, 0), (6, 0.0, 1), (52, 0.1, 1), (11, 0.0, 1), (13, 0.0, 1), (4, 0.0, 0)],
    # an article with links, quotations, lists and odd lines
    [(1, 1.0, 0), (2, 1.0, 0), (3, 1.0, 0), (7, 0.0, 0), (8, 0.0, 1), (55, 0.3, 1), (6, 1.0, 1), (48, 0.2, 1), (2, 0.0, 1), (3, 0.5, 1), (40, 0.0, 1), (1, 0.0, 1), (28, 0.4, 1), (11, 0.2, 0)],
    [(2, 1.0, 0), (1, 1.0, 0), (9, 0.0, 0), (12, 0.0, 1), (33, 0.0, 1), (1, 0.0, 1), (6, 1.0, 1), (50, 0.0, 1), (1, 0.0, 1), (5, 1.0, 1), (64, 0.0, 1), (22, 0.0, 1), (15, 0.0, 0)],
    [(1, 1.0, 0), (2, 1.0, 0), (1, 1.0, 0), (10, 0.0, 0), (4, 0.0, 1), (18, 0.05, 1), (49, 0.0, 1), (1, 0.0, 1), (6, 1.0, 1), (12, 0.0, 1), (30, 0.15, 1), (9, 0.0, 1), (7, 0.0, 0)],
    [(2, 1.0, 0), (1, 1.0, 0), (8, 0.0, 0), (5, 0.0, 1), (20, 0.3, 1), (14, 0.0, 1), (3, 0.1, 1), (36, 0.0, 1), (4, 1.0, 1), (8, 0.0, 1), (51, 0.25, 1), (5, 0.0, 1), (16, 0.05, 1), (9, 0.0, 1), (6, 0.0, 0)],
    [(1, 1.0, 0), (3, 1.0, 0), (2, 1.0, 0), (14, 0.0, 0), (7, 0.0, 1), (2, 0.0, 1), (5, 1.0, 1), (15, 0.0, 1), (25, 0.2, 1), (60, 0.0, 1), (8, 1.0, 1), (3, 0.0, 1), (45, 0.0, 1), (13, 0.0, 0)],
    [(2, 1.0, 0), (1, 1.0, 0), (1, 1.0, 0), (9, 0.0, 0), (6, 0.0, 1), (22, 0.0, 1), (57, 0.0, 1), (2, 0.0, 1), (5, 1.0, 1), (11, 0.0, 1), (13, 0.0, 1), (6, 0.0, 0)],
    [(1, 1.0, 0), (1, 1.0, 0), (7, 0.0, 0), (9, 0.0, 1), (41, 0.0, 1), (4, 0.0, 1), (7, 1.0, 1), (10, 0.0, 1), (8, 0.0, 0)],
    # a notice before the article, related links and comments after it
    [(3, 1.0, 0), (2, 1.0, 0), (2, 1.0, 0), (11, 0.0, 0), (8, 0.0, 1), (80, 0.0, 1), (46, 0.1, 1), (2, 0.0, 0), (9, 1.0, 0), (7, 1.0, 0), (8, 1.0, 0), (10, 0.3, 0)],
    [(1, 1.0, 0), (1, 1.0, 0), (6, 0.0, 0), (9, 0.0, 1), (38, 0.0, 1), (90, 0.0, 1), (3, 1.0, 0), (4, 1.0, 0), (3, 1.0, 0), (5, 1.0, 0), (16, 0.0, 0)],
    # long lists of teasers, whole pages of links
    [(2, 1.0, 0), (2, 1.0, 0), (12, 0.8, 0), (10, 0.9, 0), (14, 0.7, 0), (9, 1.0, 0), (11, 0.8, 0), (3, 1.0, 0), (6, 0.0, 0)],
    [(1, 1.0, 0), (1, 1.0, 0), (1, 1.0, 0), (2, 1.0, 0), (1, 1.0, 0), (8, 0.6, 0), (2, 1.0, 0), (1, 1.0, 0)],
    # long articles of long and short blocks
    [(1, 1.0, 0), (2, 1.0, 0), (1, 1.0, 0), (9, 0.0, 0), (8, 0.0, 1), (98, 0.0, 1), (26, 0.0, 1), (8, 0.0, 1), (11, 0.0, 1), (94, 0.0, 1), (11, 0.0, 1), (210, 0.0, 1), (4, 0.0, 1), (20, 0.0, 1), (222, 0.0, 1), (12, 0.0, 1), (2, 0.0, 1), (19, 0.0, 1), (13, 0.0, 1), (8, 0.0, 0)],
    [(2, 1.0, 0), (1, 1.0, 0), (1, 1.0, 0), (13, 0.0, 0), (12, 0.0, 1), (5, 0.0, 1), (140, 0.0, 1), (130, 0.0, 1), (7, 0.0, 1), (79, 0.0, 1), (16, 0.0, 1), (1, 0.0, 1), (108, 0.0, 1), (3, 0.0, 1), (75, 0.0, 1), (12, 0.0, 1), (123, 0.0, 1), (9, 0.0, 1), (17, 0.0, 0)],
    [(1, 1.0, 0), (1, 1.0, 0), (3, 1.0, 0), (6, 0.0, 0), (4, 0.0, 1), (4, 0.0, 1), (161, 0.0, 1), (45, 0.0, 1), (7, 0.0, 1), (25, 0.0, 1), (84, 0.0, 1), (2, 0.0, 1), (60, 0.0, 1), (13, 0.0, 1), (19, 0.0, 1), (104, 0.0, 1), (11, 0.0, 0)],
    # no menu; no footer
    [(7, 0.0, 1), (42, 0.0, 1), (66, 0.0, 1), (31, 0.0, 1), (10, 0.0, 0)],
    [(1, 1.0, 0), (2, 1.0, 0), (5, 0.0, 0), (6, 0.0, 1), (29, 0.0, 1), (58, 0.0, 1), (45, 0.0, 1)],
    [(60, 0.0, 1), (75, 0.0, 1), (34, 0.0, 1)],
    [(28, 0.0, 1)],
]

_QUOTED = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
_SILENT = r"script|style|noscript|template|svg|math|iframe|object|canvas|title|select|textarea|button|audio|video"
_TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<(?:!|\?)[^>]*>|<(?:svg|math)(?=[\s/])[^>]*/>|<({_SILENT})(?=[\s/>]){_QUOTED}>.*?(?:</\1\s*>|(?=<body[\s>])|\Z)|<(/?)([a-z][^\s/>]*)({_QUOTED})>|<(/?)([a-z][^\s/>]*)([^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input picture source".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
_ARTICLE = frozenset("article main".split())
#: Words in class, id or role that mark an element as no part of the article.
_FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended register related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar trending widget widgets".split()
)
#: Words in class, id or role that mark the article.
_ARTICLE_WORDS = frozenset("article articlebody entry main post story".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


@dataclass
class Block:
    text: str
    words: int
    density: float
    in_article: bool
    in_furniture: bool


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is the article, or furniture around it."""
    article, furniture = tag in _ARTICLE, tag in _FURNITURE or (tag == "header" and not in_article)
    if attributes and tag not in ("html", "body"):
        for groups in _NAMES.findall(attributes):
            words = set(_WORDS.findall("".join(groups).lower()))
            article |= bool(words & _ARTICLE_WORDS) and not words & _FURNITURE_WORDS
            furniture |= bool(words & _FURNITURE_WORDS) and tag not in _ARTICLE
    return article, furniture


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page in order."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, whether it opens the article, whether it is furniture
    articles = furniture = links = 0

    def close() -> None:
        nonlocal parts
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
            if text:
                linked = sum(len(_SPACE.sub("", p)) for p, in_link in parts if in_link)
                whole = sum(len(_SPACE.sub("", p)) for p, _ in parts)
                out.append(Block(text, text.count(" ") + 1, linked / max(whole, 1), articles > 0, furniture > 0))
            parts = []

    def pop() -> None:
        nonlocal articles, furniture, links
        tag, article, noise = stack.pop()
        articles -= article
        furniture -= noise
        links -= tag == "a"

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            parts.append((page[at : token.start()], links > 0))
        at = token.end()
        ending, tag, attributes = (token[2], token[3], token[4]) if token[3] else (token[5], token[6], token[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            close()
        elif tag == "br":
            parts.append((" ", links > 0))
        if ending:
            if any(open_tag == tag for open_tag, _, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in _VOID:
            while stack and stack[-1][0] in _CLOSES.get(tag, ()):
                pop()
            if tag == "a" and links:
                while stack[-1][0] != "a":
                    pop()
                pop()
            article, noise = _marks(tag, attributes, articles > 0)
            stack.append((tag, article, noise))
            articles += article
            furniture += noise
            links += tag == "a"
    parts.append((page[at:], links > 0))
    close()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; neighbours beyond the page's ends count as empty."""
    return _with_neighbours([(b.words, b.density) for b in blocks])


def _with_neighbours(own: list[tuple[int, float]]) -> np.ndarray:
    n, edge = len(own), np.zeros((NEIGHBOURS, 2))
    padded = np.vstack([edge, np.array(own, dtype=float).reshape(-1, 2), edge])
    shifts = [0, *(k for d in range(1, NEIGHBOURS + 1) for k in (-d, d))]
    return np.hstack([padded[NEIGHBOURS + k : NEIGHBOURS + k + n] for k in shifts])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A decision tree: ``(feature, cut, tree at or under it, tree above it)``, or a leaf's class.  Splits minimise Gini impurity; ties go to the first."""
    if depth == 0 or len(set(y)) == 1:
        return int(y.mean() >= 0.5)
    gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean())
    splits = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        splits += [(gini(y[x[:, k] <= cut]) + gini(y[x[:, k] > cut]), k, cut) for cut in (values[1:] + values[:-1]) / 2]
    if not splits:
        return int(y.mean() >= 0.5)
    impurity, k, cut = min(splits)
    if impurity >= gini(y) - 1e-9:
        return int(y.mean() >= 0.5)
    left = x[:, k] <= cut
    return k, float(cut), grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


@cache
def tree():
    x = np.vstack([_with_neighbours([block[:2] for block in page]) for page in LABELLED])
    return grow(x, np.array([block[2] for page in LABELLED for block in page], dtype=float))


def classify(node, row: np.ndarray) -> int:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def main_text(page: str) -> str:
    """The article's blocks in page order, joined by line feeds: those the tree takes and those marked as article, without what is marked as furniture."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if not b.in_furniture and (b.in_article or classify(tree(), row)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py() or "") for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page, from its whole html.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one line feed; ``n_chars`` counts code points.
    A null or empty page, or one without an article, has the text ``""``.
    Unclosed tags, comments and scripts run to the page's end.  Repeated rows
    give repeated results; other columns are not read; an empty table gives an
    empty result.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col("url").cast("string"), F.col(html_column).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long").withColumnRenamed("page_id", id_column)
