"""URL filters: a bit-parallel Shift-And automaton runs all glob rules at once over each canonical URL.

A canonical URL is ".host#path": the host lower-cased behind a dot, so that "*.com" fits a domain and its subdomains, and
a "#", which neither part can hold, before the path. Patterns are laid end to end in rows of 64-bit words; a "*" lets the
position before it stay. All URLs of a batch advance together, one byte a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ready

#: fixed values: rules as (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: globs over canonical URLs that are blocked where no rule fits; other URLs are allowed
BLOCKED = ("*.ads-*", "*.ads.*", "*.adserver*", "*.adult-*", "*.cheap-*", "*-pills.*", "*.casino*", "*.spam*")
RESULT = "struct<rule:string,verdict:string,globs:array<string>>"
_ONE = np.uint64(1)


@dataclass
class Automaton:
    """Masks of the packed globs. Bit k stands for "the first k + 1 symbols of a glob have been read"."""

    globs: list[str]
    masks: np.ndarray  # (256, words): symbols that each byte can be
    stay: np.ndarray  # symbols that a star follows: any byte keeps them
    start: np.ndarray  # first symbols of globs
    loose: np.ndarray  # first symbols of globs that begin with a star: they may begin anywhere
    final: list[tuple[int, bool]]  # last symbol of each glob, and whether the URL may go on after it


def compiled(globs: list[str]) -> Automaton:
    """Globs of literals, "*" (any bytes) and "?" (one byte); each has at least one symbol that isn't a star."""
    bits, total = [], sum(len(g.encode().replace(b"*", b"")) for g in globs)
    masks, (stay, start, loose) = np.zeros((256, -(-total // 64) or 1), dtype=np.uint64), np.zeros((3, -(-total // 64) or 1), dtype=np.uint64)
    at = 0
    for glob in globs:
        first, symbols = at, glob.encode()
        if not symbols.strip(b"*"):
            raise ValueError("a glob needs a symbol besides *")
        for k, symbol in enumerate(symbols):
            if symbol == ord("*"):
                if at > first:
                    stay[(at - 1) // 64] |= _ONE << np.uint64((at - 1) % 64)
                continue
            bit = _ONE << np.uint64(at % 64)
            masks[slice(None) if symbol == ord("?") else symbol, at // 64] |= bit
            if at == first:
                (loose if symbols[:1] == b"*" else start)[at // 64] |= bit
            at += 1
        bits.append((at - 1, symbols[-1:] == b"*"))
    return Automaton(globs, masks, stay, start, loose, bits)


def fits(automaton: Automaton, urls: list[bytes]) -> np.ndarray:
    """Whether each glob fits each URL as a whole: (url, glob)."""
    order = sorted(range(len(urls)), key=lambda k: -len(urls[k]))
    sizes = np.array([len(urls[k]) for k in order], dtype=np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(urls[k] for k in order) or b"\0", dtype=np.uint8)
    state = np.zeros((len(urls), automaton.masks.shape[1]), dtype=np.uint64)
    for step in range(int(sizes[0]) if len(urls) else 0):
        n = int(np.searchsorted(-sizes, -step, side="left"))  # URLs longer than this come first
        old = state[:n]
        moved = old << _ONE
        moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
        # the shift out of a glob's last symbol would enter the next glob: only its own start may set that bit
        moved &= ~(automaton.start | automaton.loose)
        moved |= automaton.loose if step else automaton.loose | automaton.start
        state[:n] = (moved & automaton.masks[data[ends[:n] - sizes[:n] + step]]) | (old & automaton.stay)
    out = np.zeros((len(urls), len(automaton.globs)), dtype=bool)
    for g, (bit, _) in enumerate(automaton.final):
        out[order, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & _ONE
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased; path: from there up to ? # or end. Else both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filtered(pages: DataFrame, rules=RULES, blocked=BLOCKED) -> DataFrame:
    """Per page: page_id, host, path, rule (the longest that fits, as host and path; else null), verdict, globs (those blocked that fit).

    A rule fits its host and all subdomains if the path starts with the rule's; of the longest, block comes before allow,
    then the greater host. Where no rule fits, the verdict is block
    if one of the globs does, else allow. A null or malformed URL has an empty host and path: no rule fits, and it is
    allowed. Repeated rows each get a row; extra columns are ignored.
    """
    ready(pages.sparkSession)
    ranked = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0], r[1]), reverse=True)
    globs = [f"*.{host}#{path}*" for _, host, path in ranked] + list(blocked)

    def judge(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automaton = compiled(globs)
        for hosts, paths in columns:
            fit = fits(automaton, [f".{h}#{p}".encode() if h or p else b"" for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)])
            rule, verdict, found = [], [], []
            for row in fit:
                k = int(np.argmax(row[: len(ranked)])) if row[: len(ranked)].any() else None
                found.append([g for g, hit in zip(blocked, row[len(ranked) :], strict=True) if hit])
                rule.append(None if k is None else ranked[k][1] + ranked[k][2])
                verdict.append(ranked[k][0] if k is not None else "block" if found[-1] else "allow")
            yield pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict), pa.array(found, pa.list_(pa.string()))], ["rule", "verdict", "globs"])

    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    out = parts.withColumn("found", F.arrow_udf(judge, RESULT)("host", "path"))
    return out.select("page_id", "host", "path", "found.rule", "found.verdict", "found.globs")
