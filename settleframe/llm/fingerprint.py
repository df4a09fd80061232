"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` lays texts end to end and keeps one modular prefix array of them. It answers whether any two spans are
equal, and finds longest common extensions by binary search, for many spans at once. A fingerprint is a sample of a
text's prefix array: its hashes at the places of the KEPT distinct spans of SPAN code points that hash least. Two
fingerprints therefore still tell whether the text between any two such places is equal, and their likeness is the
share of both texts that common extensions cover.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import ranges
from .runtime import ready
from .textbytes import BASE, mix, powers

SPAN, KEPT = 12, 32
PART_BYTES = 8 << 20  # text aimed at for a task
PIECE_CHARS = 1 << 18  # texts are hashed in pieces of about this size
_INVERSE = pow(BASE, -1, 1 << 64)
_WIDE = (1 << 48) - 1  # prefix hashes are kept modulo 2**48
_ALL = 1 << 32  # beyond every span's scattered hash
_P = (1 << 31) - 1
_PRIMES = (1_103_515_245, 747_796_405)  # bases of the two lanes modulo _P that tell whole texts apart
_tables: dict[int, np.ndarray] = {}
_ENTRY = np.dtype([("at", "<u4"), ("span", "<u4"), ("low", "<u4"), ("high", "<u2")])


def _codes() -> np.ndarray:
    """A scattered 64-bit number for each code point."""
    if 0 not in _tables:
        _tables[0] = mix(np.arange(1, 0x110001, dtype=np.uint64))
    return _tables[0]


def _prime_powers(base: int, n: int) -> np.ndarray:
    """Powers modulo _P, made by doubling and kept."""
    table = _tables.get(base, np.ones(1, dtype=np.uint64))
    while len(table) < n:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), _P)) % np.uint64(_P)])
    _tables[base] = table
    return table[:n]


class Prefixes:
    """The prefix array of texts laid end to end; text k has the places begin[k] up to begin[k] + size[k]."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        n = len(self.points)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_codes()[self.points] * powers(BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans, whatever their place."""
        return (self.sums[end] - self.sums[begin]) * self.back[begin]

    def equal(self, i: np.ndarray, other: Prefixes, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of ``length`` at i here and at j there are equal."""
        return self.spans(i, i + length) == other.spans(j, j + length)

    def common_extension(self, i: np.ndarray, other: Prefixes, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many code points agree from i here and j there, up to ``most``."""
        low, high = np.zeros(len(most), dtype=np.int64), np.array(most, dtype=np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(i, other, j, middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.minimum(high, middle - 1))
        return low

    def wholes(self) -> list[int]:
        """62-bit hashes of the texts, from prefix arrays modulo a prime in two lanes."""
        p, out = np.uint64(_P), np.zeros(len(self.size), dtype=np.uint64)
        for base in _PRIMES:
            sums = np.zeros(len(self.points) + 1, dtype=np.uint64)
            np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * _prime_powers(base, len(self.points)) % p, out=sums[1:])
            lane = (sums[self.begin + self.size] - sums[self.begin]) % p
            lane = lane * _prime_powers(pow(base, -1, _P), len(self.points) + 1)[self.begin] % p
            out = (out << np.uint64(31)) | lane
        return out.tolist()


@dataclass
class Print:
    """A fingerprint: size, hash of the whole, and of each kept span its place, hash, and the hash of all before it."""

    n: int
    whole: int
    total: int
    at: list[int]
    span: list[int]
    sums: list[int]

    def __str__(self) -> str:
        entries = np.empty(len(self.at), dtype=_ENTRY)
        sums = np.array(self.sums, dtype=np.uint64)
        entries["at"], entries["span"] = self.at, self.span
        entries["low"], entries["high"] = sums & np.uint64(0xFFFFFFFF), sums >> np.uint64(32)
        return f"{self.n:x}.{self.whole:016x}.{self.total:012x}.{base64.b64encode(entries.tobytes()).decode()}"

    @classmethod
    def parsed(cls, text: str) -> Print:
        n, whole, total, entries = text.split(".")
        rows = np.frombuffer(base64.b64decode(entries), dtype=_ENTRY)
        sums = rows["low"].astype(np.uint64) | rows["high"].astype(np.uint64) << np.uint64(32)
        return cls(int(n, 16), int(whole, 16), int(total, 16), rows["at"].tolist(), rows["span"].tolist(), sums.tolist())

    @property
    def limit(self) -> int:
        """All distinct spans with hashes up to this one are kept."""
        return max(self.span) if len(self.span) == KEPT else _ALL

    def between(self, begin: int, before: int, end: int, upto: int) -> int:
        """Hash of the text from place ``begin``, with the hash ``before`` ahead of it, to ``end``."""
        return (upto - before) * int(powers(_INVERSE, begin + 1)[begin]) & _WIDE if begin < end else 0


def _least(span: np.ndarray, text: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Of the spans ``few``, which are in the order of their places, the first of each of the KEPT least of each text."""
    key = text[few].astype(np.uint64) << np.uint64(32) | span[few]
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[order][1:] != key[order][:-1]
    order = order[new]
    of = text[few][order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    return few[np.sort(order[rank < KEPT])]


def prints(texts: list[str]) -> tuple[Prefixes, list[Print]]:
    """The prefix array of some texts, and their fingerprints. A text of fewer than SPAN code points is one span."""
    p = Prefixes(texts)
    count = np.where(p.size >= SPAN, p.size - SPAN + 1, np.minimum(p.size, 1))
    offset = np.cumsum(count) - count
    text = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(text)) + (p.begin - offset)[text]
    span = p.spans(at, at + np.minimum(p.size, SPAN)[text])
    span = (span * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    bound = np.minimum(3.0 * KEPT / np.maximum(count, 1) * _ALL, _ALL).astype(np.uint64)
    kept = _least(span, text, np.flatnonzero(span < bound[text]))
    short = (np.bincount(text[kept], minlength=len(texts)) < KEPT) & (bound < _ALL)
    if short.any():  # texts that repeat themselves: all their spans are looked at
        kept = np.sort(np.concatenate([kept[~short[text[kept]]], _least(span, text, np.flatnonzero(short[text]))]))
    own = text[kept]
    sums = p.spans(p.begin[own], at[kept]) & np.uint64(_WIDE)
    place = at[kept] - p.begin[own]
    cut = np.searchsorted(own, np.arange(len(texts) + 1)).tolist()
    totals = (p.spans(p.begin, p.begin + p.size) & np.uint64(_WIDE)).tolist()
    place, span, sums, sizes = place.tolist(), span[kept].tolist(), sums.tolist(), p.size.tolist()
    return p, [
        Print(sizes[k], whole, totals[k], place[cut[k] : cut[k + 1]], span[cut[k] : cut[k + 1]], sums[cut[k] : cut[k + 1]])
        for k, whole in enumerate(p.wholes())
    ]


def fingerprint_of(text: str) -> str:
    return str(prints([text])[1][0])


def likeness(a: Print, b: Print) -> float:
    """2 * covered / both sizes, where ``covered`` are the places of ``a`` in common extensions with ``b``; 1 for equal texts.

    Spans that both would keep are met in order; each that ``b`` has too is extended as far as the sampled prefix arrays
    agree, to the texts' beginnings or ends if those agree too.
    """
    if (a.n, a.whole) == (b.n, b.whole):
        return 1.0
    limit = min(a.limit, b.limit)
    there = {s: k for k, s in enumerate(b.span) if s <= limit}
    if there.keys().isdisjoint(a.span):
        return 0.0
    here, those = [k for k, s in enumerate(a.span) if s <= limit], sorted(there.values())
    number = {k: i for i, k in enumerate(those)}

    def same(i: int, j: int, more: int) -> bool:
        k, q, m, r = here[i], here[i + more], those[j], those[j + more]
        if a.at[q] - a.at[k] != b.at[r] - b.at[m] or a.span[q] != b.span[r]:
            return False
        return a.between(a.at[k], a.sums[k], a.at[q], a.sums[q]) == b.between(b.at[m], b.sums[m], b.at[r], b.sums[r])

    covered, done, i = 0, 0, 0
    while i < len(here):
        k = here[i]
        m = there.get(a.span[k])
        if m is None:
            i += 1
            continue
        low, high = 0, min(len(here) - 1 - i, len(those) - 1 - number[m])
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if same(i, number[m], middle) else (low, middle - 1)
        q, r = here[i + low], those[number[m] + low]
        begin = 0 if (a.at[k], a.sums[k]) == (b.at[m], b.sums[m]) else a.at[k]
        end = min(a.n, a.at[q] + SPAN)
        tail = a.n - a.at[q]
        if tail == b.n - b.at[r] and a.between(a.at[q], a.sums[q], a.n, a.total) == b.between(b.at[r], b.sums[r], b.n, b.total):
            end = a.n
        covered, done, i = covered + max(0, end - max(begin, done)), max(done, end), i + low + 1
    return min(1.0, 2 * covered / (a.n + b.n))


_OUT = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(), "common_edited": pa.int64(),
}
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_edited long"
)


def _followed(rows: list[tuple]) -> list[tuple]:
    """Results of all rows (doc_id, text, part, lent) that a row of the same part follows."""
    has_next = [k for k, (a, b) in enumerate(zip(rows, rows[1:], strict=False)) if a[2] == b[2] and not a[3]]
    if not has_next:
        return []
    texts = [r[1] for r in rows]
    p, own = prints(texts)
    edited = [texts[k][: len(texts[k]) - len(texts[k]) // 3] + texts[k + 1][: len(texts[k]) // 3] for k in has_next]
    e, changed = prints(edited)
    shared = p.common_extension(p.begin[has_next], e, e.begin, np.minimum(p.size[has_next], e.size)).tolist()
    return [
        (
            rows[k][0], own[k].n, hashlib.sha256(text.encode()).hexdigest(), str(own[k]), str(new),
            likeness(own[k], new), likeness(own[k], own[k + 1]), common,
        )
        for k, text, new, common in zip(has_next, edited, changed, shared, strict=True)
    ]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in their order, in pieces of about PIECE_CHARS; a piece begins with the last row of the one before."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        found = _followed(rows)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(_OUT.values())], list(_OUT))

    rows, held = [], 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            rows.append(row)
            held += len(row[1])
            if held >= PIECE_CHARS and len(rows) > 1:
                yield out(rows)
                rows, held = rows[-1:], 0
    yield out(rows)


def fingerprints(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Each document against its edited text and the next document: see SCHEMA; common_edited is the shared beginning.

    The next document is the one of the next smaller doc_id, after the last the first. Equal ids are in the order of their
    texts' hashes, null ids come last among the least. A null text is empty; two empty texts are alike (1), an empty one
    and another are not (0). An only document is its own next one. Repeated rows each get a row. Extra columns are ignored.

    Documents are dealt to tasks in ranges of about ``part_bytes`` (``ranges``), and each range borrows the first row of
    the next one: every text is shuffled once.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    down = F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))  # rises as ids fall
    name = F.xxhash64("text")
    cut = ranges(docs, down, name, F.octet_length("text") + 64, part_bytes)
    keyed = docs.withColumn("down", down).withColumn("name", name)
    keyed = keyed.withColumn("part", cut.of(F.col("down"), F.col("name")))
    first = cut.starts(F.col("part"), F.col("down"), F.col("name"))
    own = F.struct("part", F.lit(False).alias("lent"))
    also = F.struct(F.pmod(F.col("part") - 1, F.lit(cut.n)).alias("part"), F.lit(True).alias("lent"))
    dealt = keyed.select("doc_id", "text", "down", "name", F.explode(F.when(first, F.array(own, also)).otherwise(F.array(own))).alias("p"))
    dealt = dealt.select("doc_id", "text", "p.part", "p.lent", "down", "name")
    return dealt.repartitionById(cut.n, F.col("part")).sortWithinPartitions("part", "lent", "down", "name", "text").mapInArrow(_pairs, SCHEMA)
