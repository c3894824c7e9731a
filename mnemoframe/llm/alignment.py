"""Alignment of two tokenizers' tokens by elementary byte intervals.

Both tokenizers cut the same bytes: a space and the text.  The union of all
their token ends cuts these bytes into elementary intervals; each interval has
one owner on either side, found by binary search, and so is one overlap of two
tokens.  Ends that both sides share close groups: the smallest runs of bytes
that both sides cover with whole tokens.  The pairs of a group's product are
the many-to-many alignment of its tokens.

Neither tokenizer has a token that goes on over a single space between two
other signs (TokenBytes checks it for the vocabulary), so texts are cut there
into units, every unit's ends are shared, and the intervals of a unit are found
once for a block of documents, however often the unit occurs in it.

How often an id pair is linked in the whole corpus takes two passes over a
table of blocks.  A block gives each of its distinct id pairs once with its
number of links; these are summed over all blocks, and the sums come back to
each block once for each of its distinct pairs.  So what is shuffled grows with
blocks and vocabularies, not with documents and their tokens, and a pair that
occurs in every document is one row a block.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import bounded_batches
from .durable import durable
from .packing import Encoder

#: Bytes of text and distinct units of a block, about: a document is never cut over two blocks.
BLOCK_BYTES, BLOCK_UNITS = 32 << 20, 400_000
#: Places where texts are cut to units: before a single space between other signs.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Texts in which some spaces aren't such places.
_LOOSE = re.compile(r"\A | \Z| \s|\s ")
#: Longer units are left to the tokenizers' own libraries.
LONG_UNIT = 64
#: Words of documents whose new units are encoded together.
TOGETHER = 100_000
#: Rows of a block that are sent to Spark at once.
_SENT = 20_000


class TokenBytes:
    """Both tokenizers, the bytes of each of their ids, and whether texts may be cut to units."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = Encoder(path_a)
        self.a.exact.encode_special_tokens = True  # their strings in a text are ordinary text
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        words = self.a.exact.get_vocab(with_added_tokens=True)
        self.bytes_a: list[bytes] = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.bytes_a[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cut = not any(re.search(r"[^▁]▁", p) for p in pieces) and self.b.decode(self.b.encode("a  b")) == "a  b" and self.a.fast is not None
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))
        # What a token adds to the text of its group: with a comma, or with what ends its side of a group.
        texts = [(b"%d," % i, b"%d|" % i) for i in range(len(self.bytes_a))], [(b"%d," % i, b"%d;" % i) for i in range(len(self.bytes_b))]
        self.written = [x[k] for side in texts for k in (0, 1) for x in side]
        self._latin = self._latin_merges(pieces)

    def _latin_merges(self, pieces: list[str]):
        """The B pieces of single-byte signs as a byte-pair vocabulary, with its ids and a pattern of what it can't encode.

        Both libraries merge the adjacent pair whose piece stands first, so on
        units of signs that are pieces themselves they give the same ids.
        """
        import tiktoken

        single = {p for i, p in enumerate(pieces) if len(p) == 1 and not self.b.is_byte(i) and p <= "\xff"}
        known = [(self.b.get_score(i), i, p) for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)) and set(p) <= single | {"▁"} and " " not in p]
        scores = [score for score, _, p in known if len(p) > 1]
        if not self.cut or len(set(scores)) < len(scores):
            return None
        # Single signs are no merges, so where they stand among the ranks is of no matter.
        order = sorted((x for x in known if len(x[2]) > 1), reverse=True)
        ranks = {p.replace("▁", " ").encode("latin-1"): k for k, (_, _, p) in enumerate(order)}
        ids = [i for _, i, _ in order]
        own = {p.replace("▁", " ").encode("latin-1"): i for _, i, p in known if len(p) == 1}
        for byte in (bytes([b]) for b in range(256)):
            ranks[byte] = len(ids)
            ids.append(own.get(byte, -1))
        odd = re.compile("[^" + re.escape("".join(sorted(single - {" "}))) + "]")
        return tiktoken.Encoding("latin", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe, ids, odd

    def units(self, text: str) -> list[str]:
        """Pieces of a text whose tokens are those of the whole text; each lacks the space before it."""
        if not self.cut:
            return [text]
        return _CUT.split(text) if _LOOSE.search(text) else text.split(" ")

    def _ids_b(self, units: list[str]) -> list[list[int]]:
        out: list = [None] * len(units)
        rest = range(len(units))
        if self._latin:
            merges, ids, odd = self._latin
            encode, rest = merges.encode_single_piece, []
            for k, unit in enumerate(units):
                if len(unit) > LONG_UNIT or odd.search(unit):
                    rest.append(k)
                else:
                    out[k] = [ids[i] for i in encode(b" " + unit.encode("latin-1"))]
        for k, found in zip(rest, self.b.encode([units[k] for k in rest], num_threads=1), strict=True):
            out[k] = found
        return out

    def _ids_a(self, units: list[str]) -> list[list[int]]:
        piece = self.a.fast._core_bpe.encode_single_piece if self.a.fast is not None else None
        # Letters alone are one word of the pattern, so no pattern is needed to cut them.
        return [piece(b" " + u.encode()) if piece and len(u) <= LONG_UNIT and u.isascii() and u.isalpha() else self.a(f" {u}") for u in units]

    def encode(self, units: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of each unit on either side; None where their bytes aren't those of a space and the unit."""
        every_a, every_b = self._ids_a(units), self._ids_b(units)
        whole = "".join(f" {u}" for u in units).encode()
        spelt = [b"".join(map(table.__getitem__, (i for ids in side for i in ids))) for table, side in ((self.bytes_a, every_a), (self.bytes_b, every_b))]
        pairs = list(zip(every_a, every_b, strict=True))
        if spelt[0] == whole == spelt[1]:
            return pairs
        same = lambda u, a, b: b"".join(map(self.bytes_a.__getitem__, a)) == f" {u}".encode() == b"".join(map(self.bytes_b.__getitem__, b))
        return [(a, b) if same(u, a, b) else None for u, (a, b) in zip(units, pairs, strict=True)]


_LOADED: dict[tuple[str, str], TokenBytes] = {}


def loaded(path_a: str, path_b: str) -> TokenBytes:
    """Both tokenizers, once for each Python worker."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = TokenBytes(path_a, path_b)
    return _LOADED[path_a, path_b]


class Intervals:
    """Elementary intervals of a run of units: ``edges`` are their ends, ``own_a`` and ``own_b`` the places of their tokens, ``shared`` marks ends of groups."""

    def __init__(self, encoded: list[tuple[list[int], list[int]]], tokens: TokenBytes) -> None:
        self.ids_a = np.array([i for a, _ in encoded for i in a], dtype=np.int64)
        self.ids_b = np.array([i for _, b in encoded for i in b], dtype=np.int64)
        self.ends_a, self.ends_b = np.cumsum(tokens.lengths_a[self.ids_a]), np.cumsum(tokens.lengths_b[self.ids_b])
        self.n_a, self.n_b = np.array([len(a) for a, _ in encoded], dtype=np.int64), np.array([len(b) for _, b in encoded], dtype=np.int64)
        self.edges = np.union1d(self.ends_a, self.ends_b)
        self.own_a, self.own_b = np.searchsorted(self.ends_a, self.edges), np.searchsorted(self.ends_b, self.edges)
        self.shared = (self.ends_a[self.own_a] == self.edges) & (self.ends_b[self.own_b] == self.edges)
        unit_ends = self.ends_a[np.cumsum(self.n_a) - 1] if len(encoded) else np.zeros(0, dtype=np.int64)
        self.bounds = np.concatenate([[0], np.searchsorted(self.edges, unit_ends) + 1])

    def written(self, tokens: TokenBytes) -> tuple[np.ndarray, np.ndarray]:
        """The groups as places among ``tokens.written``, group by group and A first, and each unit's number of them."""
        ends = self.edges[self.shared]
        at_a, at_b = np.searchsorted(ends, self.ends_a), np.searchsorted(ends, self.ends_b)
        last_a, last_b = ends[at_a] == self.ends_a, ends[at_b] == self.ends_b
        size_a, size_b = len(tokens.bytes_a), len(tokens.bytes_b)
        place = np.concatenate([self.ids_a + size_a * last_a, self.ids_b + 2 * size_a + size_b * last_b])
        order = np.argsort(np.concatenate([2 * at_a, 2 * at_b + 1]), kind="stable")
        return place[order].astype(np.int32), self.n_a + self.n_b

    def groups(self) -> Iterator[tuple[int, int, list[int], list[int]]]:
        """``(start, end, A ids, B ids)`` of each group in order."""
        ends = self.edges[self.shared]
        to_a, to_b = (np.searchsorted(x, ends).tolist() for x in (self.ends_a, self.ends_b))
        ids_a, ids_b = self.ids_a.tolist(), self.ids_b.tolist()
        start = a = b = 0
        for end, last_a, last_b in zip(ends.tolist(), to_a, to_b, strict=True):
            yield start, end, ids_a[a : last_a + 1], ids_b[b : last_b + 1]
            start, a, b = end, last_a + 1, last_b + 1


class _Grown:
    """An array that is added to, with room for more."""

    def __init__(self, kind: type, width: tuple[int, ...] = ()) -> None:
        self.data, self.n = np.zeros((1024, *width), dtype=kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros((max(len(self.data), len(values)) + len(values), *self.data.shape[1:]), dtype=self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    def all(self) -> np.ndarray:
        return self.data[: self.n]


class _Block:
    """The units of a block of documents, and each document as the units that it holds."""

    def __init__(self, tokens: TokenBytes) -> None:
        self.tokens = tokens
        self.known: dict[str, int] = {}
        self.odd: set[str] = set()
        self.figures, self.codes = _Grown(np.int64, (4,)), _Grown(np.int64)
        self.written, self.first = _Grown(np.int32), _Grown(np.int64)
        self.docs: list[tuple] = []
        self.waiting: list[tuple[int | None, list[str]]] = []
        self.words = self.bytes = 0

    def _add_units(self, units: list[str]) -> None:
        encoded = self.tokens.encode(units)
        self.odd.update(u for u, e in zip(units, encoded, strict=True) if e is None)
        found = [(u, e) for u, e in zip(units, encoded, strict=True) if e is not None]
        if not found:
            return
        x = Intervals([e for _, e in found], self.tokens)
        n_groups = np.add.reduceat(x.shared.astype(np.int64), x.bounds[:-1])
        self.figures.add(np.column_stack([x.n_a, x.n_b, n_groups, np.diff(x.bounds)]))
        self.codes.add(x.ids_a[x.own_a] * len(self.tokens.bytes_b) + x.ids_b[x.own_b])
        written, sizes = x.written(self.tokens)
        self.first.add(self.written.n + np.cumsum(sizes) - sizes)
        self.written.add(written)
        self.known.update(zip((u for u, _ in found), range(len(self.known), len(self.known) + len(found)), strict=True))

    def add(self, doc_id: int | None, text: str | None) -> None:
        self.bytes += len(text or "")
        units = self.tokens.units(text) if text else []
        self.waiting.append((doc_id, units))
        self.words += len(units)
        if self.words >= TOGETHER:
            self._settle()

    def _settle(self) -> None:
        """Make the units of the documents that wait known, and reduce these documents to places and a hash."""
        new = {u: None for _, units in self.waiting for u in units if u not in self.known and u not in self.odd}
        if new:
            self._add_units(list(new))
        figures, written, first = self.figures.all(), self.written.all(), self.first.all()
        for doc_id, units in self.waiting:
            if not units or (self.odd and not self.odd.isdisjoint(units)):
                self.docs.append((doc_id, "", np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)))
                continue
            at = np.fromiter(map(self.known.__getitem__, units), dtype=np.int32, count=len(units))
            sizes = figures[at, 0] + figures[at, 1]
            ends = np.cumsum(sizes)
            places = written[np.repeat(first[at] - ends + sizes, sizes) + np.arange(ends[-1])]
            text = b"".join(map(self.tokens.written.__getitem__, places.tolist()))
            own, times = np.unique(at, return_counts=True)
            self.docs.append((doc_id, hashlib.sha256(text[:-1]).hexdigest(), own, times.astype(np.int32)))
        self.waiting, self.words = [], 0

    def full(self) -> bool:
        return self.bytes >= BLOCK_BYTES or len(self.known) >= BLOCK_UNITS

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        """The block's documents, and one row with its units: for each its links as places among the block's distinct id pairs."""
        self._settle()
        figures = self.figures.all()
        sums = np.array([(figures[own] * times[:, None]).sum(axis=0) for _, _, own, times in self.docs], dtype=np.int64).reshape(-1, 4)
        for first in range(0, len(self.docs), _SENT):
            docs = self.docs[first : first + _SENT]
            columns = [pa.array([number] * len(docs), pa.int64()), pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs])]
            columns += [pa.array(sums[first : first + _SENT, k]) for k in range(4)]
            columns += [pa.array([d[k].tobytes() for d in docs], pa.binary()) for k in (2, 3)]
            columns += [pa.nulls(len(docs), pa.binary())] * 4
            yield pa.RecordBatch.from_arrays(columns, _BLOCK_NAMES)
        if self.known:
            uses = np.zeros(len(self.known), dtype=np.int64)
            for _, _, own, times in self.docs:
                uses[own] += times
            links = figures[:, 3]
            codes, place = np.unique(self.codes.all(), return_inverse=True)
            # Sums of whole numbers as floats are exact up to 2**53.
            n = np.bincount(place, weights=np.repeat(uses, links)).astype(np.int64)
            own = [pa.array([v.tobytes()], pa.binary()) for v in (codes, n, links.astype(np.int32), place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.nulls(1, k) for k in (pa.int64(), pa.string(), *[pa.int64()] * 4, pa.binary(), pa.binary())), *own], _BLOCK_NAMES)


_BLOCK_NAMES = ["block", "doc_id", "groups_sha256", "n_a", "n_b", "n_groups", "n_links", "units", "times", "codes", "code_links", "unit_links", "places"]
_BLOCK_SCHEMA = "block long, doc_id long, groups_sha256 string, n_a long, n_b long, n_groups long, n_links long, units binary, times binary, codes binary, code_links binary, unit_links binary, places binary"


def _blocks(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, number = loaded(path_a, path_b), TaskContext.get().partitionId() << 24
        block = _Block(tokens)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(doc_id, text.as_py())
                if block.full():  # at most TOGETHER words wait beyond BLOCK_UNITS
                    yield from block.batches(number)
                    block, number = _Block(tokens), number + 1
        yield from block.batches(number)

    return run


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct id pair of a block, also those of units that only occur in texts without tokens (0 links)."""
    for batch in batches:
        for number, codes, links in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            codes, links = (np.frombuffer(v.as_buffer(), dtype=np.int64) for v in (codes, links))
            for first in range(0, len(codes), _SENT):
                part = codes[first : first + _SENT]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number.as_py())), pa.array(np.arange(first, first + len(part), dtype=np.int32)), pa.array(part), pa.array(links[first : first + _SENT])], ["block", "place", "code", "links"])


def _weighed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links, from the corpus-wide counts of the block's id pairs."""
    ints = lambda v, kind: np.frombuffer(v.as_buffer(), dtype=kind)
    is_doc = left.column("units").is_valid()
    docs, units = left.filter(is_doc), left.filter(pa.compute.invert(is_doc))
    values = np.zeros((1, 2), dtype=np.int64)
    if units.num_rows:
        links, places = ints(units.column("unit_links")[0], np.int32), ints(units.column("places")[0], np.int32)
        counts = np.zeros((places.max() + 1, 2), dtype=np.int64)
        at = right.column("place").to_numpy()
        counts[at, 0], counts[at, 1] = right.column("is_best").to_numpy(), right.column("count").to_numpy()
        values = np.add.reduceat(counts[places], np.concatenate([[0], np.cumsum(links)[:-1]]))
    sums = np.zeros((docs.num_rows, 2), dtype=np.int64)
    for k, (own, times) in enumerate(zip(docs.column("units"), docs.column("times"), strict=True)):
        sums[k] = (values[ints(own, np.int32)] * ints(times, np.int32).astype(np.int64)[:, None]).sum(axis=0)
    return pa.table([*(docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(sums[:, 0]), pa.array(sums[:, 1]), docs.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Each document's alignment in figures, and how often each id pair is linked in the corpus.

    The first table has ``(doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256)`` for every row of ``docs``: numbers of tokens,
    groups and links; links whose id pair has the highest corpus-wide count
    among the pairs of its B id, ties included; the sum of the counts over all
    links; and the hash of the groups written as ``a1,a2|b1;a3|b2,b3``.  The
    second has ``(a_id, b_id, count)``.

    A null or empty text, and one that either tokenizer doesn't give back byte
    by byte, has no tokens: zeros and ``""``.  Rows that repeat an id, and rows
    without one, are returned each and count each.  Other columns are not read;
    an empty table gives empty results.  Very long texts are blocks of their own.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    blocks = durable(rows.mapInArrow(_blocks(path_a, path_b), _BLOCK_SCHEMA))
    pairs = blocks.where("codes IS NOT NULL").select("block", "codes", "code_links").mapInArrow(_block_pairs, "block long, place int, code long, links long").where("links > 0")
    size_b = len(loaded(path_a, path_b).bytes_b)
    counts = durable(pairs.groupBy("code").agg(F.sum("links").alias("count")).withColumn("b_id", F.pmod("code", F.lit(size_b))))
    highest = counts.groupBy("b_id").agg(F.max("count").alias("highest"))
    marked = counts.join(highest, "b_id").select("code", "count", (F.col("count") == F.col("highest")).cast("int").alias("is_best"))
    found = pairs.join(marked, "code").select("block", "place", "count", "is_best")
    left = blocks.select("block", "doc_id", "groups_sha256", "n_a", "n_b", "n_groups", "n_links", "units", "times", "unit_links", "places")
    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    figures = left.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_weighed, shape).withColumnRenamed("doc_id", id_column)
    return figures, counts.select(F.expr(f"code DIV {size_b}").alias("a_id"), "b_id", "count")


def _document_groups(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(path_a, path_b)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                encoded = tokens.encode(tokens.units(text.as_py())) if text.as_py() else []
                rows = [] if None in encoded else list(Intervals(encoded, tokens).groups())
                for first in range(0, len(rows), _SENT):
                    start, end, a, b = zip(*rows[first : first + _SENT], strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(start), pa.int64()), pa.array(range(first, first + len(start)), pa.int64()), *(pa.array(v, k) for v, k in zip((start, end, a, b), kinds, strict=True))], ["doc_id", "group", "start", "end", "a_ids", "b_ids"])

    return run


def token_groups(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, group, start, end, a_ids, b_ids)``: the groups of every document in order, with their bytes in a space and the text.

    Texts without tokens, as in ``align_documents``, have no group.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(_document_groups(path_a, path_b), "doc_id long, group long, start long, end long, a_ids array<long>, b_ids array<long>").withColumnRenamed("doc_id", id_column)


def group_products(groups: DataFrame) -> DataFrame:
    """Each pair of an A and a B token of a group: columns of ``groups`` other than the lists, and ``(a_place, a_id, b_place, b_id)``."""
    kept = [c for c in groups.columns if c not in ("a_ids", "b_ids")]
    one = groups.select(*kept, "b_ids", F.posexplode("a_ids").alias("a_place", "a_id"))
    return one.select(*kept, "a_place", "a_id", F.posexplode("b_ids").alias("b_place", "b_id"))
