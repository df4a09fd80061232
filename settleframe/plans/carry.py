"""The last value before: as-of joins over times that are dealt out in ranges, each range handing its last values on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

_PART = 33  # monotonically_increasing_id has the partition above this bit


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], exact: bool = True) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the last row of ``right`` in its group ``by`` at or before its ``on``.

    Without ``exact`` only earlier rows count. Values are null where the group has none yet, as before a group's first row
    and for a null ``on``. Of rows of ``right`` with equal ``by`` and ``on`` the one with the greatest values holds; a null
    value of the last row stays null. Both sides have columns of the same types for ``by`` and ``on``.

    The two sides are put together and dealt into sorted ranges of (by, on); a range looks back inside itself, and what a
    range has last of a group, one row for each group and range, is handed on to the next ranges. No group is gathered
    in one task, however many rows it has, and nothing is crossed.
    """
    own = [c for c in left.columns if c not in by and c != on]
    held = F.struct(*[F.col(v) for v in values])
    asks = left.select(*by, on, F.lit(1 if exact else -1).alias("_side"), F.lit(None).cast(right.select(held.alias("_v")).schema["_v"].dataType).alias("_v"), F.struct(*own, F.lit(0).alias("_")).alias("_own"))
    last = right.where(F.col(on).isNotNull()).groupBy(*by, on).agg(F.max(held).alias("_v"))
    tells = last.select(*by, on, F.lit(0).alias("_side"), "_v", F.lit(None).cast(asks.schema["_own"].dataType).alias("_own"))
    both = stored(asks.unionByName(tells), "as-of-both")
    keys = [*by, on, "_side"]
    rows = stored(both.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_seq", F.monotonically_increasing_id()), "as-of-in-order")
    rows = rows.withColumn("_part", F.shiftright("_seq", _PART)).withColumn("_told", F.when(F.col("_side") == 0, F.struct("_v")))
    inside = Window.partitionBy(*by, "_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_here", F.last("_told", ignorenulls=True).over(inside))
    tails = rows.groupBy(*by, "_part").agg(F.max_by("_told", F.when(F.col("_told").isNotNull(), F.col("_seq"))).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    handed = tails.withColumn("_handed", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    same = F.col("l._part") == F.col("h._part")
    for c in by:
        same &= F.col(f"l.{c}").eqNullSafe(F.col(f"h.{c}"))
    joined = local.where("_side <> 0").alias("l").join(handed.alias("h"), same, "left")
    found = F.when(F.col(f"l.{on}").isNotNull(), F.coalesce("l._here", "h._handed"))
    out = joined.select(*[f"l.{c}" for c in [*by, on]], "l._own", found.alias("_found"))
    return out.select(*[F.col(c) if c in by or c == on else F.col(f"_own.{c}") for c in left.columns], *[F.col(f"_found._v.{v}") for v in values])
