"""Ranking a linked list that is spread over a cluster, with the sums of weights before each of its arcs.

First each task contracts the paths that lie inside a slab of its rows. What is left is contracted by rounds of coin
tosses: an arc with tails whose predecessor has heads is taken out of the list, about a quarter of them in a round. Once at
most ``bound`` arcs are left one task ranks them, and the arcs taken out get their sums back, the last round first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ready, written

SLAB = 1 << 16  # rows that are contracted together in a task
BOUND = 1 << 17  # arcs that one task ranks: 5 MB
NONE = -1  # follows the last arc
SUMS = ("steps", "leaves", "saved")


def ranked(following: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a set of paths, each arc's first arc and the sums of weights from there up to it, itself left out.

    ``following`` has indices, NONE after a path's last arc. Predecessors are doubled in steps: about log2 of the longest path.
    """
    n = len(following)
    before = np.arange(n)
    inner = np.flatnonzero(following != NONE)
    sums = np.zeros_like(weights)
    before[following[inner]] = inner
    sums[following[inner]] = weights[inner]
    while True:
        further = before[before]
        if (further == before).all():
            return before, sums
        sums = sums + sums[before]
        before = further


def _within(arcs: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The index among ``arcs`` of each of ``following``, NONE where it isn't there."""
    order = np.argsort(arcs)
    at = np.minimum(np.searchsorted(arcs[order], following), max(0, len(arcs) - 1))
    return np.where(arcs[order][at] == following, order[at], NONE) if len(arcs) else np.zeros(0, dtype=np.int64)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (arc, next, weights) to (arc, first, offsets) and, for a path's first arc, where the path goes on and its sums."""
    names = ["arc", "next", *SUMS]

    def slab(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        arc, following = (table.column(c).to_numpy() for c in names[:2])
        weights = np.stack([table.column(c).to_numpy() for c in SUMS], axis=1)
        inside = _within(arc, following)
        first, sums = ranked(inside, weights)
        last = np.flatnonzero(inside == NONE)  # one for each path
        goes_on, total = np.zeros(len(arc), dtype=np.int64), np.zeros_like(weights)
        goes_on[first[last]], total[first[last]] = following[last], sums[last] + weights[last]
        heads = first == np.arange(len(arc))
        columns = [pa.array(arc), pa.array(arc[first]), *[pa.array(sums[:, k]) for k in range(len(SUMS))]]
        columns += [pa.array(goes_on, mask=~heads), *[pa.array(total[:, k], mask=~heads) for k in range(len(SUMS))]]
        return pa.RecordBatch.from_arrays(columns, ["arc", "first", *[f"{s}_in" for s in SUMS], "next", *SUMS])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SLAB:
            yield slab(held)
            held = []
    if held:
        yield slab(held)


def _rank_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    arc, following = table.column("arc").to_numpy(), table.column("next").to_numpy()
    weights = np.stack([table.column(c).to_numpy() for c in SUMS], axis=1)
    _, sums = ranked(_within(arc, following), weights)
    yield pa.RecordBatch.from_arrays([pa.array(arc), *[pa.array(sums[:, k]) for k in range(len(SUMS))]], ["arc", *SUMS])


def _tails(arc: Column | str, turn: int) -> Column:
    return F.xxhash64(arc, F.lit(turn)) % 2 == 0


def _ranks(links: DataFrame, bound: int, turn: int = 0) -> DataFrame:
    """(arc, sums before it) of a written list of links."""
    if links.count() <= bound:
        return written(links.coalesce(1).mapInArrow(_rank_all, "arc bigint, " + ", ".join(f"{s} bigint" for s in SUMS)), "ranks")
    out = _tails("arc", turn)
    into = ~out & (F.col("next") != NONE) & _tails("next", turn)
    taken, takers = links.where(out), links.where(into)
    joined = taken.alias("v").join(takers.alias("u"), F.col("v.arc") == F.col("u.next"), "left")
    goes = joined.select(
        F.coalesce("u.arc", "v.arc").alias("arc"), "v.next", *[(F.col(f"v.{s}") + F.coalesce(f"u.{s}", F.lit(0))).alias(s) for s in SUMS],
        F.when(F.col("u.arc").isNotNull(), F.col("v.arc")).alias("gone"), *[F.col(f"u.{s}").alias(f"{s}_in") for s in SUMS],
    )
    stay = links.where(~out & ~into)
    for c in goes.columns[len(links.columns) :]:
        stay = stay.withColumn(c, F.lit(None).cast("long"))
    turned = written(goes.unionByName(stay), f"links-{turn}")
    ranks = _ranks(turned.select(*links.columns), bound, turn + 1)
    back = turned.where("gone is not null").alias("g").join(ranks.alias("r"), "arc")
    back = back.select(F.col("gone").alias("arc"), *[(F.col(f"r.{s}") + F.col(f"g.{s}_in")).alias(s) for s in SUMS])
    return written(ranks.unionByName(back), f"ranks-{turn}")


def list_ranks(links: DataFrame, bound: int = BOUND) -> DataFrame:
    """(arc, steps, leaves, saved) with the sums of weights over all earlier arcs of the list.

    ``links`` (arc, next, steps, leaves, saved) is one list: each arc once, ``next`` the following arc, NONE for the last;
    no column is null. Paths inside a slab are contracted first, so rows that are near in the list should be near in the
    table. An empty list has no rows.
    """
    ready(links.sparkSession)
    schema = "arc bigint, first bigint, " + ", ".join(f"{s}_in bigint" for s in SUMS) + ", next bigint, " + ", ".join(f"{s} bigint" for s in SUMS)
    paths = written(links.mapInArrow(_contracted, schema), "paths")
    ranks = _ranks(paths.where("next is not null").select("arc", "next", *SUMS), bound)
    joined = paths.alias("p").join(ranks.alias("r"), F.col("p.first") == F.col("r.arc"))
    return joined.select("p.arc", *[(F.col(f"p.{s}_in") + F.col(f"r.{s}")).alias(s) for s in SUMS])
