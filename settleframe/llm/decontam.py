"""Benchmark decontamination: Wu-Manber multi-pattern search over the words of whole documents.

A pattern is a window of ``width`` benchmark words (an item of fewer, but not none, is one window). Patterns of a length
share a shift table over two-word blocks: a block that no pattern holds lets the search move on by nearly the whole
length, one that ends a pattern leads to its suffix-hash bucket, and the texts of the bucket's patterns are compared
directly. A slice of documents is cut into many lanes that are searched in step. Tables of numpy arrays are built on the
executors, for blocks of ``BLOCK_CHARS`` of the benchmark, and broadcast one by one; documents pass through all of them
in one Python stage without a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ready
from .textbytes import WORDLIKE, Words, mix, slices, words

WIDTH = 10
BLOCK_CHARS = 8_000_000  # benchmark text in one broadcast; its tables have about ten bytes for each
KEPT_BLOCKS = 2  # so many blocks stay in a Python worker; of more, each is loaded again for every batch of documents
LANES = 2048
RESULT = "struct<n_words:long,n_hit:long,bits:binary,items:array<string>>"


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of two-word blocks; entry k is of the words k and k + 1."""
    return mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


def _sums(hashes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes)])


def _buckets(blocks: np.ndarray, sums: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """Bucket of the windows that begin at ``begin``: from their last block and the sum of their words' hashes."""
    last = blocks[begin + length - (2 if length > 1 else 1)]
    return mix(last * np.uint64(0xC2B2AE3D27D4EB4F) + sums[begin + length] - sums[begin])


@dataclass
class Tables:
    """Patterns of one length: shifts by block, and buckets of patterns, each with its first word and its owners."""

    length: int
    blocks: np.ndarray  # sorted hashes of the blocks (of the words themselves if the length is 1)
    shift: np.ndarray
    bucket: np.ndarray  # sorted, one for each pattern
    begin: np.ndarray  # a pattern's first word in the benchmark's words
    bounds: np.ndarray  # of each pattern's owners
    owner: np.ndarray


@dataclass
class Block:
    """A part of the benchmark: the bytes and bounds of its words, the names of its items, and tables by length."""

    low: bytes
    start: np.ndarray
    end: np.ndarray
    names: list[str | None]
    tables: list[Tables]

    def spelled(self, begin: int, length: int) -> bytes:
        return _spelled(self.low, self.start, self.end, begin, length)


def _spelled(low: bytes, start: np.ndarray, end: np.ndarray, begin: int, length: int) -> bytes:
    return b" ".join(low[start[w] : end[w]] for w in range(begin, begin + length))


def build(items: list[tuple[str | None, str]], width: int = WIDTH) -> Block:
    """Tables of (name, text) items, all at once."""
    pieces = list(slices(pa.array([t for _, t in items], pa.large_string()), 1 << 62))
    if not pieces:
        return Block(b"", np.zeros(0, np.int64), np.zeros(0, np.int64), [], [])
    found = words(pieces[0], WORDLIKE)
    size, first, tables = np.diff(found.first), found.first[:-1], []
    sums, pairs = _sums(found.hash), _pairs(found.hash) if len(found.hash) else found.hash
    # the ordered hash tells patterns of one bucket apart, so that a text that repeats itself has few of them
    for length in sorted({min(width, int(n)) for n in size} - {0}):
        mine = np.flatnonzero(np.minimum(size, width) == length)
        count = size[mine] - length + 1
        owner = np.repeat(mine, count)
        begin = np.repeat(first[mine] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        blocks = pairs if length > 1 else found.hash
        held = size[mine] - 1 if length > 1 else size[mine]  # blocks of each item
        place = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)
        shift = np.maximum(0, (length - 2 if length > 1 else 0) - place)
        of = blocks[np.repeat(first[mine], held) + place]
        order = np.lexsort((shift, of))
        new = np.concatenate([[True], of[order][1:] != of[order][:-1]])
        bucket, ordered = _buckets(blocks, sums, begin, length), np.zeros(len(begin), dtype=np.uint64)
        for k in range(length):
            ordered = mix(ordered + found.hash[begin + k])
        by = np.lexsort((owner, ordered, bucket))
        bucket, ordered, begin, owner = bucket[by], ordered[by], begin[by], owner[by]
        same = (bucket[1:] == bucket[:-1]) & (ordered[1:] == ordered[:-1])
        head = np.concatenate([[True], ~same])
        once = np.concatenate([[True], ~(same & (owner[1:] == owner[:-1]))])
        bounds = np.concatenate([(np.cumsum(once) - 1)[head], [int(once.sum())]])
        tables.append(Tables(length, of[order][new], shift[order][new], bucket[head], begin[head], bounds, owner[once].astype(np.int32)))
    return Block(found.low.tobytes(), found.start, found.end, [name for name, _ in items], tables)


def _stops(blocks: np.ndarray, tables: Tables) -> np.ndarray:
    """Positions in ``blocks`` where a pattern's last block stands, by lanes that skip along in step."""
    n, default = len(blocks), max(1, tables.length - 1)
    lanes = min(LANES, max(1, n // 256))
    at = np.arange(lanes, dtype=np.int64) * n // lanes
    until = np.concatenate([at[1:], [n]])
    found = []
    while len(at):
        here = blocks[at]
        k = np.searchsorted(tables.blocks, here)
        k[k == len(tables.blocks)] = 0
        step = np.where(tables.blocks[k] == here, tables.shift[k], default)
        if (stop := step == 0).any():
            found.append(at[stop])
        at = at + np.maximum(step, 1)
        going = at < until
        at, until = at[going], until[going]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def search(found: Words, block: Block) -> tuple[np.ndarray, list[tuple[int, str | None]]]:
    """Which words are hit, and (document, item) of every occurrence."""
    hit, owners = np.zeros(len(found.hash) + 1, dtype=np.int64), []
    whole, sums = found.low.tobytes(), _sums(found.hash)
    pairs = _pairs(found.hash) if len(found.hash) > 1 else found.hash[:0]
    for t in block.tables:
        if len(found.hash) < t.length:
            continue
        blocks = pairs if t.length > 1 else found.hash
        begin = _stops(blocks, t) - (t.length - 2 if t.length > 1 else 0)
        begin = begin[begin >= 0]
        doc = np.searchsorted(found.first, begin, side="right") - 1
        inside = begin + t.length <= found.first[doc + 1]
        begin, doc = begin[inside], doc[inside]
        bucket = _buckets(blocks, sums, begin, t.length) if len(begin) else np.zeros(0, dtype=np.uint64)
        low, high = np.searchsorted(t.bucket, bucket), np.searchsorted(t.bucket, bucket, side="right")
        for k in np.flatnonzero(low < high).tolist():
            at = int(begin[k])
            text = _spelled(whole, found.start, found.end, at, t.length)
            for pattern in range(int(low[k]), int(high[k])):
                if text == block.spelled(int(t.begin[pattern]), t.length):
                    hit[at] += 1
                    hit[at + t.length] -= 1
                    owners += [(int(doc[k]), block.names[o]) for o in t.owner[t.bounds[pattern] : t.bounds[pattern + 1]].tolist()]
    return np.cumsum(hit)[:-1] > 0, owners


def _held(block: Broadcast, keep: bool) -> Block:
    """A broadcast block; where there are many, it isn't kept in the worker."""
    path = getattr(block, "_path", None)
    return block.value if keep or path is None else block.load_from_path(path)


def _scan(blocks: list[Broadcast]):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in columns:
            hits: list[np.ndarray | None] = [None] * len(text)
            named: list[set] = [set() for _ in range(len(text))]
            sizes = np.zeros(len(text), dtype=np.int64)
            for sent in blocks:
                block = _held(sent, len(blocks) <= KEPT_BLOCKS)
                for piece in slices(text):
                    found = words(piece, WORDLIKE)
                    sizes[piece.first : piece.first + piece.n] = np.diff(found.first)
                    hit, owners = search(found, block)
                    for d, owner in owners:
                        row = piece.first + d
                        if owner is not None:
                            named[row].add(owner)
                        if hits[row] is None:
                            hits[row] = np.zeros(sizes[row], dtype=bool)
                    for d in {d for d, _ in owners}:
                        hits[piece.first + d] |= hit[found.first[d] : found.first[d + 1]]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()))
            rows = (sizes, [0 if h is None else int(h.sum()) for h in hits], [None if h is None else np.packbits(h).tobytes() for h in hits], [sorted(n) for n in named])
            yield pa.StructArray.from_arrays([pa.array(r, kind) for r, kind in zip(rows, kinds, strict=True)], ["n_words", "n_hit", "bits", "items"])

    return run


def _blocks(benchmark: DataFrame, width: int) -> list[Broadcast]:
    """The benchmark's tables, built by the executors in blocks of about BLOCK_CHARS and sent one at a time through the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars // BLOCK_CHARS))

    def made(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["item", "text"], na_position="first")
        names = [None if pd.isna(x) else x for x in group["item"]]
        return pd.DataFrame({"tables": [pickle.dumps(build(list(zip(names, group["text"], strict=True)), width))]})

    tables = items.groupBy(F.pmod(F.xxhash64("item", "text"), F.lit(n)).alias("block")).applyInPandas(made, "tables binary")
    send = benchmark.sparkSession.sparkContext.broadcast
    return [send(pickle.loads(r.tables)) for r in tables.toLocalIterator()] or [send(build([]))]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, into: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit (words inside an occurrence), bits (which), items (sorted as strings).

    Texts are lower-cased in A-Z; words are runs of a-z, 0-9 and all beyond ASCII. Null and empty texts have no words and
    no hits; an empty benchmark hits nothing. An item without id hits words but is not listed; repeated ids count once.
    Repeated documents each have their result.
    """
    ready(docs.sparkSession)
    return docs.withColumn(into, F.arrow_udf(_scan(_blocks(benchmark, width)), RESULT)("text"))


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    c = F.col("contamination")
    out = contamination(docs.select("doc_id", "text"), benchmark, width).select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), c["items"].alias("items"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
