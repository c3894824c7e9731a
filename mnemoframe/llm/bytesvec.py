"""Vectorised word splitting and hashing of Arrow text columns.

A batch of texts is one byte buffer plus offsets.  Word borders come from a
256-entry class table, and a word's hash from differences of a prefix sum
modulo 2**64, so no Python code runs per word.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BLOCK_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

#: One random odd 64-bit value for each byte.
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

#: Words are runs without ASCII white space: ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class _Powers:
    """Powers of the multiplier and of its inverse, grown when a longer block comes."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _BLOCK_BYTES + 1)
            steps = np.full(size, _MULTIPLIER, dtype=np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = np.uint64(_INVERSE)
            self.down = np.cumprod(steps, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all their bits depend on all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Texts ``first`` to ``first + n - 1`` of a batch as one buffer."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text_bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Byte spans of all words of a block; those of text i are ``bounds[i]`` to ``bounds[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and 64-bit offsets of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def blocks(column: pa.Array, block_bytes: int = _BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of about ``block_bytes``; a longer text is a block of its own."""
    data, offsets = text_buffers(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Block(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of True that don't cross a text's border."""
    if not len(inside):
        return Words(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64))
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(inside))]
    opens[borders] = inside[borders]
    closes[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(opens)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def hash_bytes(text: bytes) -> np.uint64:
    """The hash that ``span_hashes`` gives a span with these bytes."""
    data = np.frombuffer(text, dtype=np.uint8)
    return span_hashes(data, np.array([0]), np.array([len(data)]))[0]


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, or of the whole text where it has fewer; and their bounds."""
    counts = np.diff(bounds)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(counts)), sizes)
    first = bounds[owner] + (np.arange(out_bounds[-1]) - out_bounds[owner])
    length = np.minimum(counts[owner], width)
    out = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    padded = np.concatenate([hashes, np.zeros(width, dtype=np.uint64)])
    for k in range(width):
        word = np.where(k < length, padded[first + k], np.uint64(0))
        out = (out ^ word) * np.uint64(_MULTIPLIER)
        out ^= out >> np.uint64(29)
    return mix(out), out_bounds


def distinct_per_text(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and their bounds."""
    n = len(bounds) - 1
    values = values.copy()
    for i in range(n):
        values[bounds[i] : bounds[i + 1]].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    new[bounds[:-1][bounds[:-1] < len(values)]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[bounds]
