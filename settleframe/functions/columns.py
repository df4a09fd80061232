"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: ten price buckets in cents
BUCKETS = ("1-10c", "11-20c", "21-30c", "31-40c", "41-50c", "51-60c", "61-70c", "71-80c", "81-90c", "91-99c")


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """a * scale / b as double; null where b is 0."""
    return F.lit(scale) * a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def quarter(ts: Column | str) -> Column:
    return F.date_trunc("quarter", ts).cast("timestamp_ntz")


def quarter_label(ts: Column | str) -> Column:
    return F.concat(F.year(ts), F.lit(" Q"), F.quarter(ts))


def quarter_short(ts: Column | str) -> Column:
    """As in Q3 '24."""
    return F.concat(F.lit("Q"), F.quarter(ts), F.lit(" '"), F.substring(F.year(ts).cast("string"), -2, 2))


def hour_of(ts: Column, tz: str = "UTC") -> Column:
    """Hour of day in ``tz`` of a time stored in UTC."""
    return F.hour(ts if tz == "UTC" else F.from_utc_timestamp(ts, tz))


def price_bucket(price: Column) -> Column:
    """The bucket of a price in cents; null outside 1 to 99."""
    labels = F.array(*[F.lit(b) for b in BUCKETS])
    return F.when(price.between(1, 99), F.element_at(labels, F.floor((price - 1) / 10).cast("int") + 1))


def category(event_ticker: Column) -> Column:
    """The leading capitals and digits; 'independent' for null and where there are none."""
    found = F.regexp_extract(event_ticker, "^([A-Z0-9]+)", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit("independent")).otherwise(found)


def variance(n: Column, s: Column, s2: Column, sample: bool = False) -> Column:
    """Variance from exact integer moments; products are taken as decimals, so they can't overflow. Null for too few rows."""
    wide = lambda c: c.cast("decimal(38,0)")
    spread = (wide(n) * s2 - wide(s) * s).cast("double")
    return ratio(spread, n.cast("double") * (n - 1 if sample else n))


def interval95(mean: Column, variance_: Column, n: Column) -> tuple[Column, Column, Column]:
    """Standard error, lower and upper bound."""
    se = F.sqrt(variance_ / n)
    return se, mean - 1.96 * se, mean + 1.96 * se


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles to ``places``; what is so close to 0 loses its sign."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def chart_table(df: DataFrame, x: str, ys: dict[str, str], places: int = 2) -> DataFrame:
    """Records for a chart: x, and renamed, rounded series."""
    return rounded(df.select(x, *[F.col(c).cast("double").alias(name) for c, name in ys.items()]), places).orderBy(x)


FEW = 1 << 12  # rows that one task sorts, and about the ranges that are counted at a time


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The n rows with the least seeded hashes of the key: the same ones every time, and fewer only if there are fewer.

    Ranges of the hash are counted, which tells the one that the n-th row falls into; all rows of lower ranges are taken
    where they are, and that range is counted by finer ones until it holds only FEW rows, which are sorted. Each count is
    a scan of the key alone. Rows that share their hash, as repeated keys do, are interchangeable.
    """
    draw, name = F.xxhash64(key, F.lit(seed)), "_span"
    inside, taken, left = F.lit(True), F.lit(False), n
    for shift in (52, 40, 28, 16, 4, 0):
        spans = F.shiftright(draw, shift)  # keeps the order and the sign
        counts = sorted((r[name], r["count"]) for r in df.where(inside).groupBy(spans.alias(name)).count().collect())
        if sum(c for _, c in counts) <= left:
            return df.where(taken | inside)
        for cut, count in counts:
            if count > left:
                break
            left -= count
        taken, inside = taken | (inside & (spans < cut)), spans == cut
        if not left:
            return df.where(taken)
        if count <= FEW:
            return df.where(taken).unionByName(df.where(inside).orderBy(draw, key).limit(left))
    return df.where(taken).unionByName(df.where(inside).limit(left))
