"""Vectorised tokenising of Arrow string columns: word bounds and 64-bit word hashes straight from the UTF-8 buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18  # texts are handled in slices of about this size, so temporaries stay bounded whatever the batch
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: words are maximal runs of bytes other than space and \x09-\x0D
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: words are maximal runs of a-z, 0-9 and everything beyond ASCII (texts are lower-cased first)
WORDLIKE = np.zeros(256, dtype=bool)
WORDLIKE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES * 3 // 2)
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= SLICE_BYTES * 2:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Slice:
    """Some texts of a batch: rows [first, first + n), their bytes, and each text's bounds within the bytes."""

    first: int
    data: np.ndarray
    bounds: np.ndarray  # n + 1 offsets

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column (null: empty) into slices of whole texts; a text beyond the limit is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Words of a slice: byte bounds, hashes, and for each text the range of its words."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n + 1 offsets into start/end
    hash: np.ndarray | None


def words(piece: Slice, wordlike: np.ndarray, hashed: bool = True) -> Words:
    """Lower-case A-Z and split; a text's end ends its last word."""
    low = LOWER[piece.data]
    inside = wordlike[low]
    size = len(low)
    if not size:
        none = np.zeros(0, dtype=np.int64)
        return Words(low, none, none, np.zeros(piece.n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint64))
    before = np.empty(size, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = piece.bounds[:-1][piece.bounds[:-1] < size]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(size, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, piece.bounds)
    return Words(low, start, end, first, word_hashes(low, start, end) if hashed else None)


def word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span from one prefix polynomial over the bytes."""
    size = len(low)
    prefix = np.empty(size + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(BASE, size), out=prefix[1:])
    value = (prefix[end] - prefix[start]) * powers(_INVERSE, size)[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingles(words_of: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and their offsets by text; a shorter text, if it has words, is one run."""
    hashes, first = words_of.hash, words_of.first
    count = np.diff(first)
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(runs)])
    total = int(offsets[-1])
    if not total:
        return np.zeros(0, dtype=np.uint64), offsets
    begin = np.repeat(first[:-1] - offsets[:-1], runs) + np.arange(total)
    padded = np.concatenate([hashes, np.zeros(width, dtype=np.uint64)])
    length = np.repeat(np.minimum(count, width), runs)
    out = length.astype(np.uint64)
    for k in range(width):
        part = padded[begin + k] * np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
        out = mix(out + (np.where(length > k, part, np.uint64(0)) if k else part)) if k == width - 1 else out + (np.where(length > k, part, np.uint64(0)) if k else part)
    return out, offsets
