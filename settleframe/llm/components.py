"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import hot_beyond, removed, spread_join, written


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b long) to (node, label): each node that isn't its component's least, with that least node.

    Nulls, loops and repeated edges are ignored. Each round is two joins on aggregated minima and is written to the
    shared folder; the rounds grow with the logarithm of the longest path and end when each component is a star.
    While a node has more than HOT edges, the minima of such nodes are broadcast and their edges stay where they are.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    done, most, n = _progress(now)
    while not done:
        hot = hot_beyond(2 * n, most)  # large-star gives no node more lesser ends than it had ends
        ends = F.count(F.lit(1)).alias("n")
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), ends)
        low = low.select("a", F.least("a", "m").alias("m"), "n")
        large = spread_join(both.where("b > a"), low, "a", hot).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), ends)
        small = spread_join(large, low, "a", hot).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        then = written(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        removed(now.sparkSession, now)
        now = then
        done, most, n = _progress(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _progress(edges: DataFrame) -> tuple[bool, int, int]:
    """Whether all components are stars, the most edges of a node, and the number of edges.

    In a star each node has either one edge to a lesser node, or only edges from greater ones.
    """
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("out").alias("outs"), F.min("out").alias("least"), F.count(F.lit(1)).alias("n"))
    unfinished = (F.col("outs") > 1) | ((F.col("outs") == 1) & (F.col("least") == 0))
    found = nodes.agg(F.max(unfinished).alias("left"), F.max("n").alias("most"), F.sum("outs").alias("edges")).first()
    return not found.left, found.most or 0, found.edges or 0
