"""Places of rows inside their groups, by one range sort: no group is ever gathered in one task.

A table is dealt into sorted ranges and each row gets a number that rises with the order. Only the runs, one row for each
group and range that meet, are then summed to tell how many rows of the group lie in earlier ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import removed, written

_PART = 33  # monotonically_increasing_id has the partition above this bit


def same(a: str, b: str, *columns: str) -> Column:
    """Null-safe equality of the columns of two aliases."""
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def in_order(rows: DataFrame, keys: Sequence[str | Column], what: str) -> DataFrame:
    """``rows`` written in ranges of ``keys``, nulls first, with a column ``seq`` that rises with them (not without gaps).

    Rows of equal keys may end up in any order, but in one range: where many rows can be equal, the caller adds a salt as
    the last key. ``rows`` should be a written table, as the range bounds are sampled from it first.
    """
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(dealt.withColumn("seq", F.monotonically_increasing_id()), what)


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[str], what: str) -> DataFrame:
    """``rows`` written with ``place``, the number from 0 of a row in its group by ``order``, and ``n``, the group's rows.

    Nulls come first, and a null group is a group. The join that brings the places back is on group and range, so that
    one task gets no more rows of a group than its range holds.
    """
    sorted_rows = in_order(rows, [*group, *order], f"{what}-in-order")
    numbered = sorted_rows.withColumn("part", F.shiftright("seq", _PART))
    runs = numbered.groupBy(*group, "part").agg(F.min("seq").alias("least"), F.count(F.lit(1)).alias("own"))
    by = Window.partitionBy(*group)
    before = F.coalesce(F.sum("own").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*group, "part", (before - F.col("least")).alias("shift"), F.sum("own").over(by).alias("n"))
    joined = numbered.alias("r").join(runs.alias("u"), same("r", "u", *group) & (F.col("r.part") == F.col("u.part")))
    out = written(joined.select(*[f"r.{c}" for c in rows.columns], (F.col("r.seq") + F.col("u.shift")).alias("place"), "u.n"), what)
    removed(rows.sparkSession, sorted_rows)
    return out
