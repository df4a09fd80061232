"""Cutting a table that is to be sorted into ranges of about equal bytes, from a sample of its keys."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = 1 << 17  # sampled keys, about; they alone come to the driver
MOST = 1 << 15  # ranges


@dataclass
class Ranges:
    """The least key of each range, in order. Keys are two longs; each key belongs to one range."""

    firsts: list[int]
    seconds: list[int]

    @property
    def n(self) -> int:
        return max(1, len(self.firsts))

    def _array(self, values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values)) or "0"), ",").cast("array<bigint>")

    def of(self, first: Column, second: Column) -> Column:
        """The number of the range of a key: a binary search in the literal arrays."""
        a, b = self._array(self.firsts), self._array(self.seconds)
        steps = [F.lit(1 << k) for k in reversed(range((self.n - 1).bit_length()))]
        if not steps:
            return F.lit(0)
        reached = lambda k: (first > F.get(a, k)) | ((first == F.get(a, k)) & (second >= F.get(b, k)))
        return F.aggregate(F.array(*steps), F.lit(0), lambda k, s: F.when((k + s < self.n) & reached(k + s), k + s).otherwise(k))

    def starts(self, number: Column, first: Column, second: Column) -> Column:
        """Whether a key is the least of its range."""
        a, b = self._array(self.firsts), self._array(self.seconds)
        return (first == F.get(a, number)) & (second == F.get(b, number))


def ranges(rows: DataFrame, first: Column, second: Column, size: Column, per_range: int, most: int = MOST) -> Ranges:
    """Ranges of about ``per_range`` bytes, at most ``most`` of them, over the keys (first, second); none of the columns is null.

    About KEYS keys are drawn by a hash, so the same rows always make the same ranges; the sizes of what isn't drawn are
    one further row of the same aggregation. Few or far keys, and keys that repeat, change nothing: ranges follow bytes.
    An empty table has no ranges.
    """
    share = int(min(1.0, KEYS / max(1, rows.count())) * (1 << 30))
    drawn = F.pmod(F.xxhash64("a", "b", F.lit(29)), F.lit(1 << 30)) < share
    keyed = rows.select(first.alias("a"), second.alias("b"), size.cast("long").alias("size")).withColumn("drawn", drawn)
    pick = lambda c: F.when(F.col("drawn"), F.col(c)).alias(c)
    got = keyed.withColumn("key", F.struct("a", "b")).groupBy("drawn", pick("a"), pick("b")).agg(F.sum("size").alias("size"), F.min("key").alias("least")).collect()
    if not got:
        return Ranges([], [])
    keys = sorted((r.least.a, r.least.b, r["size"] if r.drawn else 0) for r in got)  # what isn't drawn gives its least key only
    weight = np.array([k[2] for k in keys], dtype=np.float64)
    total = sum(r["size"] for r in got)
    parts = int(min(most, max(1, -(-total // per_range))))
    before = np.cumsum(weight) - weight
    number = np.floor(before * parts / max(1.0, weight.sum())).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return Ranges([keys[k][0] for k in cut], [keys[k][1] for k in cut])
