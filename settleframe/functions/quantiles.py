"""Exact percentiles of a frequency table by rank selection, and sketches as the approximate option."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

DIGIT = 12  # bits of the value that a step settles: a task sees at most 4096 counts of a group


def _selected(freq: DataFrame, wanted: DataFrame, by: Sequence[str], value: str, weight: str, bits: int) -> DataFrame:
    """(by, rank, value): the value at each wanted rank (from 0) of its group.

    The values' ranges are counted, the range that holds a rank is cut into finer ones, and so on down to one value.
    """
    shift = max(0, -(-bits // DIGIT) - 1) * DIGIT
    many = shift > DIGIT
    at = wanted.select(*by, "rank", F.col("rank").alias("left"), F.lit(0).cast("long").alias("prefix"))
    while True:
        digit = F.shiftright(value, shift)
        rows = freq.withColumn("prefix", F.shiftright(digit, DIGIT)).withColumn("digit", digit)
        if shift + DIGIT < bits:  # not the first step, which has one range
            rows = rows.join(F.broadcast(at.select(*by, "prefix").distinct()), [*by, "prefix"], "left_semi")  # a row for each wanted rank at most
        counts = rows.groupBy(*by, "prefix", "digit").agg(F.sum(weight).alias("own"))
        order = Window.partitionBy(*by, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("own").over(order))
        inside = (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("own"))
        met = counts.join(F.broadcast(at), [*by, "prefix"]).where(inside)
        at = met.select(*by, "rank", (F.col("left") - F.col("upto") + F.col("own")).alias("left"), F.col("digit").alias("prefix"))
        if not shift:
            return at.select(*by, "rank", F.col("prefix").alias(value))
        at = stored(at, "ranks") if many else at  # else each step would make the ones before it twice
        shift -= DIGIT


def percentiles(freq: DataFrame, by: Sequence[str], value: str, weight: str, shares: Sequence[float], most: int | None = None) -> DataFrame:
    """(by, q): the exact percentiles of ``value``, a whole number from 0 on, which occurs ``weight`` times in a row.

    q has a double for each of ``shares``, taken on the straight line between neighbouring ranks. No task holds the
    values of a group. Rows without weight don't count, groups without any weight have no row. ``by`` is not null, and
    ``freq`` is read once for each step: a stored table serves best. ``most`` is a bound of the values, if it is known.
    """
    freq = freq.where(F.col(weight) > 0).select(*by, F.col(value).cast("long").alias(value), F.col(weight).cast("long").alias(weight))
    bits = int((freq.agg(F.max(value)).first()[0] or 0) if most is None else most).bit_length()
    totals = freq.groupBy(*by).agg(F.sum(weight).alias("n"))
    ranks = [(F.lit(float(s)) * (F.col("n") - 1)) for s in shares]
    both = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(r).cast("long"), F.ceil(r).cast("long")) for r in ranks])))
    wanted = totals.select(*by, F.explode(both).alias("rank"))
    found = _selected(freq, wanted, by, value, weight, bits)
    maps = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", F.col(value).cast("double")))).alias("at"))  # two a share
    out = totals.join(maps, list(by)) if by else totals.crossJoin(maps)  # without groups one row with one row

    def between(r: Column) -> Column:
        low, high = F.element_at("at", F.floor(r).cast("long")), F.element_at("at", F.ceil(r).cast("long"))
        return low + (high - low) * (r - F.floor(r))

    return out.select(*by, F.array(*[between(r) for r in ranks]).alias("q"))


def quantile_sketches(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, sketch): a KLL sketch of whole numbers, one for each row of ``rows``; the approximate option for trades themselves."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col(value).cast("long")).alias("sketch"))


def merged_quantile_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Coarser sketches from finer ones, as of days put together."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketched_percentiles(sketches: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(by, q): about the percentiles, each a value that occurs; the rank error is near 1 %."""
    each = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(s))).cast("double") for s in shares]
    return merged_quantile_sketches(sketches, by).select(*by, F.array(*each).alias("q"))


def distinct_sketches(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, sketch): a HyperLogLog sketch of the distinct values, to be stored beside a cube and merged later."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(F.col(value).cast("string"), F.lit(14)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Coarser sketches from finer ones, as of days put together."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimates(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, distinct): about how many distinct values; the standard error is below 1 % for 2**14 registers."""
    return merged_sketches(sketches, by).select(*by, F.hll_sketch_estimate("sketch").alias("distinct"))
