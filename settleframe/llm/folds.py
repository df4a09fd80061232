"""The fold of a document and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; a null id is held out, so nothing is learned from it."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def least_draws(keyed: DataFrame, by: str, per_value: int) -> DataFrame:
    """(by, draw): of each value of ``by`` the ``per_value`` least of its distinct draws, all of them if it has no more.

    ``keyed`` has a value and a draw, a 64-bit hash, in each row; null values are left out. Repeated rows have one draw.
    Draws far above the ones wanted are cut off by the value's count, so no task ranks more than a few times ``per_value``.
    """
    pairs = keyed.where(F.col(by).isNotNull()).select(by, "draw").distinct()
    counts = pairs.groupBy(by).agg(F.count(F.lit(1)).alias("all"))
    # in hashes of 62 bits; with twice as many expected as wanted, fewer than wanted are out of the question
    cut = F.floor(F.lit(float(1 << 62)) * 2 * (per_value + 50) / F.col("all"))
    near = pairs.join(F.broadcast(counts), by).where((F.col("all") <= per_value) | (F.shiftrightunsigned("draw", 2) < cut))
    order = Window.partitionBy(by).orderBy(F.shiftrightunsigned("draw", 2), "draw")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_value).select(by, "draw")


def sampled(rows: DataFrame, by: str, per_value: int) -> DataFrame:
    """One row of each of the ``per_value`` least draws of a value of ``by``: the same rows in every run.

    ``rows`` has text, by, and draw, a hash of all by which rows are told apart; of rows with one draw one is kept. The
    chosen draws are bounded by the values, so they are broadcast: texts that weren't chosen aren't shuffled.
    """
    chosen = least_draws(rows, by, per_value)
    return rows.join(F.broadcast(chosen), [by, "draw"]).groupBy(by, "draw").agg(F.first("text").alias("text"))
