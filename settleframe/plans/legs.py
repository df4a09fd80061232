"""A trade as two legs, a taker's and the mirrored maker's, joined to the outcome: one scan, one join, one explode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import category

MOMENTS = ("n", "won", "contracts", "sp", "se", "se2", "cp", "ce", "cw")


def resolved(markets: DataFrame, strict: bool = True) -> DataFrame:
    """Markets with a yes or no result; strict ones are also finalized."""
    found = markets.where(F.col("result").isin("yes", "no"))
    return (found.where("status = 'finalized'") if strict else found).select("ticker", "result", category(F.col("event_ticker")).alias("category"))


def two_legs(trades: DataFrame) -> DataFrame:
    """Every trade twice: role, side, price, contracts, with the trade's other columns. A maker takes the other side at its price."""
    yes = F.col("taker_side") == "yes"
    leg = lambda role, on_yes: F.struct(
        F.lit(role).alias("role"), F.when(on_yes, "yes").otherwise("no").alias("side"), F.when(on_yes, F.col("yes_price")).otherwise(F.col("no_price")).alias("price")
    )
    other = [c for c in trades.columns if c not in ("yes_price", "no_price", "taker_side", "count")]
    return trades.select(*other, F.col("count").alias("contracts"), F.explode(F.array(leg("taker", yes), leg("maker", ~yes))).alias("leg")).select(*other, "contracts", "leg.*")


def _outcome(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("won", (F.col("side") == F.col("result")).cast("long"))
    return out.withColumn("e", 100 * F.col("won") - F.col("price"))


def legs(trades: DataFrame, markets: DataFrame, strict: bool = True) -> DataFrame:
    """Legs of trades in resolved markets: n (1), contracts, won (0 or 1), e = 100 * won - price in cents, and the category."""
    return _outcome(two_legs(trades.join(resolved(markets, strict), "ticker"))).withColumn("n", F.lit(1).cast("long"))


def trade_sums(trades: DataFrame, markets: DataFrame, *keys, strict: bool = True, sized: bool = False, also: tuple = ()) -> DataFrame:
    """Trades of resolved markets, summed by side, prices, result and ``keys``, before they are mirrored.

    n is the number of trades in a row and count their contracts; ``sized``, trades are also told apart by their
    contracts, and count is what each of them has. ``also``: names of further columns, whose least and greatest values
    are kept as least_x and most_x. Keys may be columns of trades or of ``resolved`` markets.

    Where Spark expects to broadcast the markets, trades meet their outcome as they are read and are summed there. Where
    it doesn't, they are summed by ticker and all else below the join, and again without the ticker after it. Of the
    trades themselves nothing is shuffled either way, and a market's many trades meet its outcome as a few sums.
    """
    known = resolved(markets, strict)
    by = ["taker_side", "yes_price", "no_price", *keys, *(["count"] if sized else [])]
    ends = [f(c).alias(f"{name}_{c}") for c in also for name, f in (("least", F.min), ("most", F.max))]
    volume = [] if sized else [F.sum("count").alias("count")]
    if is_small(known):
        return trades.join(known, "ticker").groupBy(*by, "result").agg(F.count(F.lit(1)).alias("n"), *volume, *ends)
    of_market = [k for k in keys if isinstance(k, str) and k in known.columns]
    first = trades.groupBy("ticker", *[k for k in by if not any(k is m for m in of_market)]).agg(F.count(F.lit(1)).alias("n"), *volume, *ends)
    sums = {"n", *(() if sized else ("count",)), *[f"{e}_{c}" for c in also for e in ("least", "most")]}
    names = [c for c in first.columns if c != "ticker" and c not in sums]
    again = [f(f"{name}_{c}").alias(f"{name}_{c}") for c in also for name, f in (("least", F.min), ("most", F.max))]
    return first.join(known, "ticker").groupBy(*names, *of_market, "result").agg(F.sum("n").alias("n"), *volume, *again)


def is_small(df: DataFrame) -> bool:
    """Whether Spark's own estimate of ``df`` is within the session's limit for broadcasts."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if limit.startswith("-"):
        return False
    most = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most


def leg_sums(trades: DataFrame, markets: DataFrame, *keys, strict: bool = True, sized: bool = False, also: tuple = ()) -> DataFrame:
    """As ``legs``, for ``trade_sums``: a few rows for each pair of prices are mirrored."""
    return _outcome(two_legs(trade_sums(trades, markets, *keys, strict=strict, sized=sized, also=also)))


def legs_of(sums: DataFrame) -> DataFrame:
    """The legs of ``trade_sums``."""
    return _outcome(two_legs(sums))


def mirrored(sums: DataFrame, markets: DataFrame, strict: bool = True) -> DataFrame:
    """Legs of trades that were summed before by ticker, side, prices and other columns (n and count), as ``leg_sums`` gives them.

    The sums may be in parts; they are added up over all tickers of a result and category before they are mirrored.
    """
    met = sums.join(resolved(markets, strict), "ticker").drop("ticker")
    by = [c for c in met.columns if c not in ("n", "count")]
    return _outcome(two_legs(met.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("count").alias("count"))))


def totals(sized: DataFrame) -> DataFrame:
    """Rows of ``leg_sums(sized=True)`` with contracts summed, as ``moments`` needs them."""
    return sized.withColumn("contracts", F.col("n") * F.col("contracts"))


def moments() -> list:
    """Exact integer sums that the price-keyed analyses need, of legs or their sums; they add up over any split of the rows."""
    n, p, w, e, c = (F.col(x).cast("long") for x in ("n", "price", "won", "e", "contracts"))
    return [
        F.sum(n).alias("n"), F.sum(n * w).alias("won"), F.sum(c).alias("contracts"), F.sum(n * p).alias("sp"), F.sum(n * e).alias("se"),
        F.sum(n * e * e).alias("se2"), F.sum(c * p).alias("cp"), F.sum(c * e).alias("ce"), F.sum(c * w).alias("cw"),
    ]


def position_cube(legs_: DataFrame, *keys: str) -> DataFrame:
    """Moments by keys and (role, side, price)."""
    return legs_.groupBy(*keys, "role", "side", "price").agg(*moments())


def by_role(cube: DataFrame, *keys: str) -> DataFrame:
    """Moments by keys and role as one row for each key that both roles have: taker_n, maker_n and so on.

    Both roles come from one aggregation of the legs; only its few rows are shuffled again.
    """
    sums = [F.sum(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("taker", "maker") for c in MOMENTS]
    return cube.groupBy(*keys).agg(*sums).where("taker_n is not null and maker_n is not null")


def merged(cube: DataFrame, *keys: str) -> DataFrame:
    """A coarser cube from a finer one, or from several put together."""
    return cube.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in MOMENTS])
