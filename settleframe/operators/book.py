"""Analyses of the book venue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BUCKETS, hour_of, interval95, price_bucket, quarter, ratio, variance
from ..functions.quantiles import distinct_estimates, distinct_sketches, percentiles, quantile_sketches, sketched_percentiles
from ..functions.stats import normal_two_sided_p
from ..plans.legs import by_role, leg_sums, legs, merged, moments, position_cube, totals, two_legs
from ..sources.shared import stored
from ..sources.tables import Tables


def _if(test: Column, value) -> Column:
    return F.sum(F.when(test, value).otherwise(0))


def book_legs(t: Tables, strict: bool = True) -> DataFrame:
    return legs(t.book_trades, t.book_markets, strict)


def book_sums(t: Tables, *keys, sized: bool = False, strict: bool = True) -> DataFrame:
    """``leg_sums`` of the venue; "quarter" among the keys is made from the time, "category" comes from the market."""
    keys = [quarter("created_time").alias("quarter") if isinstance(k, str) and k == "quarter" else k for k in keys]
    return leg_sums(t.book_trades, t.book_markets, *keys, strict=strict, sized=sized)


def _moments(t: Tables, cube: DataFrame | None, *keys: str) -> DataFrame:
    """Moments by ``keys`` from a stored cube (``position_moments``), or from the trades."""
    if cube is not None:
        return merged(cube, *keys)
    return book_sums(t, *[k for k in keys if k in ("quarter", "category")]).groupBy(*keys).agg(*moments())


def win_rate_by_price(t: Tables, cube: DataFrame | None = None) -> DataFrame:
    """Both legs by price: total_trades, wins, win_rate in percent. ``cube``: a stored ``position_moments`` to read instead of trades."""
    by = _moments(t, cube, "price").select("price", F.col("n").alias("total_trades"), F.col("won").alias("wins"))
    return by.withColumn("win_rate", ratio(F.col("wins"), F.col("total_trades"), 100))


def mispricing_by_price(t: Tables, cube: DataFrame | None = None) -> DataFrame:
    """Win rates of takers, makers and both at prices where both roles trade, and how far they are from the price."""
    by = by_role(_moments(t, cube, "role", "price").where(F.col("price").between(1, 99)), "price")
    counts = [F.col(f"{r}_{c}").alias(f"{r}_{name}") for r in ("taker", "maker") for c, name in (("n", "trades"), ("won", "wins"))]
    both = [(F.col(f"taker_{c}") + F.col(f"maker_{c}")).alias(f"combined_{name}") for c, name in (("n", "trades"), ("won", "wins"))]
    out = by.select("price", *counts, *both, F.col("price").cast("double").alias("implied_probability"))
    for who in ("taker", "maker", "combined"):
        rate, p = ratio(F.col(f"{who}_wins"), F.col(f"{who}_trades"), 100), F.col("implied_probability")
        out = out.withColumn(f"{who}_win_rate", rate).withColumn(f"{who}_mispricing_pp", rate - p).withColumn(f"{who}_mispricing_pct", (rate - p) / p * 100)
    return out


def _returns(role: str) -> list[Column]:
    c = lambda name: F.col(f"{role}_{name}")
    n, var = c("n"), variance(c("n"), c("se"), c("se2")) / 1e4
    excess, error = ratio(c("se"), n, 0.01), F.sqrt(var / n)
    return [
        ratio(c("won"), n).alias(f"{role}_win_rate"), (F.col("price") / 100).alias(f"{role}_expected"), excess.alias(f"{role}_excess"), var.alias(f"{role}_var"),
        n.alias(f"{role}_n"), (c("cp") / 100).alias(f"{role}_volume_usd"), (c("ce") / 100).alias(f"{role}_pnl"), error.alias(f"{role}_se"),
        (excess / F.nullif(error, F.lit(0.0))).alias(f"{role}_z"),
    ]


def maker_vs_taker_returns(t: Tables, p_values: bool = True, cube: DataFrame | None = None) -> DataFrame:
    """Excess return, spread, volume and profit at each price from 1 to 99 that both roles trade; z and two-sided p."""
    by = _moments(t, cube, "role", "price").where(F.col("price").between(1, 99))
    out = by_role(by, "price").select("price", *_returns("taker"), *_returns("maker"))
    if p_values:
        out = out.withColumn("taker_p", normal_two_sided_p("taker_z")).withColumn("maker_p", normal_two_sided_p("maker_z"))
    return out


def maker_counterparty_excess(t: Tables, cube: DataFrame | None = None) -> DataFrame:
    """A taker's excess at p beside the maker's at 100 - p; 0 where the maker has none.

    Each of the up to 99 rows is told at its own price and, as the other side, at the mirrored one: one aggregation serves both.
    """
    rows = maker_vs_taker_returns(t, p_values=False, cube=cube).select("price", "taker_excess", "maker_excess")
    own = F.struct("price", "taker_excess", F.lit(None).cast("double").alias("other"), F.lit(1).alias("own"))
    mirror = F.struct((100 - F.col("price")).alias("price"), F.lit(None).cast("double").alias("taker_excess"), F.col("maker_excess").alias("other"), F.lit(0).alias("own"))
    told = rows.select(F.explode(F.array(own, mirror)).alias("r")).select("r.*")
    by = told.groupBy("price").agg(F.max("own").alias("own"), F.max("taker_excess").alias("taker_excess"), F.coalesce(F.max("other"), F.lit(0.0)).alias("counterparty_excess"))
    return by.where("own = 1").drop("own")


def _maker_sides(t: Tables, cube: DataFrame | None) -> DataFrame:
    by = _moments(t, cube, "role", "side", "price").where("role = 'maker'").where(F.col("price").between(1, 99))
    pick = lambda s, c, name: F.sum(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{name}")
    cols = [pick(s, c, c) for s in ("yes", "no") for c in ("n", "won", "contracts", "se", "cp", "cw")]
    return by.groupBy("price").agg(*cols)


def maker_returns_by_direction(t: Tables, cube: DataFrame | None = None) -> DataFrame:
    """Makers' trade-weighted win rate and excess by side and price, and NO minus YES."""
    out = _maker_sides(t, cube)
    cols = [c for s in ("yes", "no") for c in (
        ratio(F.col(f"{s}_won"), F.col(f"{s}_n")).alias(f"{s}_win_rate"), ratio(F.col(f"{s}_se"), F.col(f"{s}_n"), 0.01).alias(f"{s}_excess"), F.col(f"{s}_n"),
        F.col(f"{s}_contracts"), (F.col(f"{s}_cp") / 100).alias(f"{s}_volume"),
    )]
    return out.select("price", *cols).withColumn("diff", F.col("no_excess") - F.col("yes_excess"))


def maker_win_rate_by_direction(t: Tables, cube: DataFrame | None = None) -> DataFrame:
    """The same weighted by contracts: win rate and mispricing against the price."""
    cols = []
    for s in ("yes", "no"):
        rate = ratio(F.col(f"{s}_cw"), F.col(f"{s}_contracts"))
        cols += [rate.alias(f"{s}_win_rate"), (rate - F.col("price") / 100).alias(f"{s}_mispricing"), F.col(f"{s}_n"), F.col(f"{s}_contracts")]
    return _maker_sides(t, cube).select("price", (F.col("price") / 100).alias("implied_prob"), *cols)


def ev_yes_vs_no(t: Tables) -> DataFrame:
    """Of each price from 1 to 99 the expected value in cents of buying YES and NO, weighted by contracts, and the better; a tie is NO."""
    trades = t.book_trades.join(t.book_markets.where(F.col("result").isin("yes", "no")).select("ticker", "result"), "ticker")
    sums = trades.groupBy("yes_price", "no_price", "result").agg(F.sum("count").alias("count"))
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_price").alias("price"))
    rows = sums.select("count", "result", F.explode(F.array(side("yes"), side("no"))).alias("b")).select("count", "result", "b.*")
    pick = lambda s, test: F.sum(F.when((F.col("side") == s) & test, F.col("count")))
    won, all_ = F.col("side") == F.col("result"), F.lit(True)
    by = rows.groupBy("price").agg(*[e for s in ("yes", "no") for e in (pick(s, all_).alias(f"{s}_contracts"), F.coalesce(pick(s, won), F.lit(0)).alias(f"{s}_w"))])
    grid = t.book_trades.sparkSession.range(1, 100).select(F.col("id").cast("int").alias("price"))
    out = grid.join(by, "price", "left")
    for s in ("yes", "no"):
        rate = ratio(F.col(f"{s}_w"), F.col(f"{s}_contracts"))
        out = out.withColumn(f"{s}_win_rate", rate).withColumn(f"{s}_ev", 100 * rate - F.col("price"))
    yes, no = F.coalesce("yes_ev", F.lit(-100.0)), F.coalesce("no_ev", F.lit(-100.0))
    out = out.withColumn("implied_prob", F.col("price") / 100).withColumn("best_ev", F.greatest(yes, no)).withColumn("best_bet", F.when(yes > no, "YES").otherwise("NO"))
    return out.drop("yes_w", "no_w")


def yes_vs_no_by_price(t: Tables) -> DataFrame:
    """Contracts by role and side at each price, resolved or not, and their shares in percent."""
    sums = t.book_trades.groupBy("taker_side", "yes_price", "no_price").agg(F.sum("count").alias("count"))
    by = two_legs(sums).where(F.col("price").between(1, 99))
    names = [(r, s) for r in ("taker", "maker") for s in ("yes", "no")]
    out = by.groupBy("price").agg(*[_if((F.col("role") == r) & (F.col("side") == s), F.col("contracts")).alias(f"{r}_{s}") for r, s in names], F.sum("contracts").alias("total"))
    return out.select("*", *[ratio(F.col(f"{r}_{s}"), F.col("total"), 100).alias(f"{r}_{s}_pct") for r, s in names])


SHARES = (0.5, 0.25, 0.75, 0.9, 0.95)


def size_sketches(t: Tables, *keys) -> DataFrame:
    """KLL sketches of trade sizes in cents, and of contracts, by role and ``keys``: to be stored, and merged over days.

    Each trade is sketched on its own, so this reads legs and not their sums.
    """
    rows = book_legs(t).withColumn("cents", F.col("contracts") * F.col("price"))
    by = ["role", *keys]
    cents = quantile_sketches(rows, by, "cents").withColumn("of", F.lit("cents"))
    return cents.unionByName(quantile_sketches(rows, by, "contracts").withColumn("of", F.lit("contracts")))


def sketched_sizes(sketches: DataFrame) -> DataFrame:
    """(role, median, p25, p75, p90, p95, median_contracts) from stored ``size_sketches``, with a rank error near 1 %."""
    q = sketched_percentiles(sketches, ["role", "of"], SHARES)
    dollars = q.where("of = 'cents'").select("role", *[(F.col("q")[k] / 100).alias(n) for k, n in enumerate(("median", "p25", "p75", "p90", "p95"))])
    return dollars.join(q.where("of = 'contracts'").select("role", F.col("q")[0].alias("median_contracts")), "role")


def trade_size_by_role(t: Tables) -> DataFrame:
    """Distribution of trade sizes in dollars by role, exact: percentiles by rank selection from a table of how often each size occurs.

    ``size_sketches`` and ``sketched_sizes`` are the approximate option.
    """
    by = book_sums(t, sized=True).groupBy("role", (F.col("contracts") * F.col("price")).alias("cents"), "contracts").agg(F.sum("n").alias("f"))
    by = stored(by, "sizes")
    wide, c = F.col("cents").cast("decimal(38,0)"), F.col("cents")
    sums = by.groupBy("role").agg(
        F.sum("f").alias("n"), F.sum(c * F.col("f")).alias("s"), F.sum(wide * c * F.col("f")).alias("s2"), F.sum(F.col("contracts") * F.col("f")).alias("sc")
    )
    most = by.agg(F.max("cents").alias("cents"), F.max("contracts").alias("contracts")).first()
    middle = percentiles(by, ["role"], "contracts", "f", [0.5], most.contracts or 0).select("role", F.col("q")[0].alias("median_contracts"))
    out = sums.join(percentiles(by, ["role"], "cents", "f", SHARES, most.cents or 0), "role").join(middle, "role")
    std = F.sqrt((F.col("n").cast("decimal(38,0)") * F.col("s2") - F.col("s").cast("decimal(38,0)") * F.col("s")).cast("double")) / F.col("n") / 100
    q = lambda k: (F.col("q")[k] / 100)
    return out.select(
        "role", "n", ratio(F.col("s"), F.col("n"), 0.01).alias("mean"), q(0).alias("median"), std.alias("std_pop"), q(1).alias("p25"), q(2).alias("p75"),
        q(3).alias("p90"), q(4).alias("p95"), ratio(F.col("sc"), F.col("n")).alias("mean_contracts"), "median_contracts", (F.col("s") / 100).alias("total"),
    )


def win_rate_by_trade_size(t: Tables, least: int = 10) -> DataFrame:
    """Takers' win rate by quarter-decade of size in dollars, with a 95 % interval of the excess."""
    size = F.greatest(F.col("contracts") * F.col("price") / 100, F.lit(0.01))
    binned = totals(book_sums(t, sized=True).where("role = 'taker'").withColumn("bin", F.floor(F.log10(size) * 4).cast("int")))
    by = binned.groupBy("bin").agg(*moments()).where(F.col("n") >= least)
    excess, var = ratio(F.col("se"), F.col("n"), 0.01), variance(F.col("n"), F.col("se"), F.col("se2"), sample=True) / 1e4
    se, low, high = interval95(excess, var, F.col("n"))
    return by.select("bin", F.pow(F.lit(10.0), F.col("bin") / 4).alias("size_bin"), ratio(F.col("won"), F.col("n")).alias("win_rate"), ratio(F.col("sp"), F.col("n"), 0.01).alias("expected"), excess.alias("excess"), var.alias("var"), "n", (F.col("cp") / 100).alias("volume"), se.alias("se"), low.alias("ci_low"), high.alias("ci_high"))


def returns_by_hour(t: Tables, tz: str = "UTC") -> DataFrame:
    """Takers' returns by hour of day."""
    by = book_sums(t, hour_of(F.col("created_time"), tz).alias("hour")).where("role = 'taker'").groupBy("hour").agg(*moments())
    excess, var = ratio(F.col("se"), F.col("n"), 0.01), variance(F.col("n"), F.col("se"), F.col("se2"), sample=True) / 1e4
    se, low, high = interval95(excess, var, F.col("n"))
    return by.select("hour", ratio(F.col("won"), F.col("n")).alias("win_rate"), ratio(F.col("sp"), F.col("n"), 0.01).alias("avg_implied_prob"), excess.alias("excess"), var.alias("var"), "contracts", (F.col("cp") / 100).alias("volume"), "n", se.alias("se"), low.alias("ci_low"), high.alias("ci_high"))


def vwap_by_hour(t: Tables, tz: str = "UTC") -> DataFrame:
    """Takers' volume-weighted price by hour of day."""
    p = F.col("price").cast("long")
    rows = book_sums(t, hour_of(F.col("created_time"), tz).alias("hour")).where("role = 'taker'")
    by = rows.groupBy("hour").agg(*moments(), F.sum(F.col("n") * p * p).alias("sp2"))
    vwap, std = ratio(F.col("cp"), F.col("contracts")), F.sqrt(variance(F.col("n"), F.col("sp"), F.col("sp2"), sample=True))
    se = std / F.sqrt(F.col("n"))
    return by.select("hour", vwap.alias("vwap"), "contracts", (F.col("cp") / 100).alias("volume"), "n", ratio(F.col("sp"), F.col("n")).alias("avg_price"), std.alias("std"), se.alias("se"), (vwap - 1.96 * se).alias("ci_low"), (vwap + 1.96 * se).alias("ci_high"))


def volume_over_time(t: Tables) -> DataFrame:
    """Contracts of all trades by quarter."""
    return t.book_trades.groupBy(quarter("created_time").alias("quarter")).agg(F.sum("count").alias("volume"))


def _bucket_volumes(t: Tables, cube: DataFrame | None) -> DataFrame:
    long = F.coalesce(F.col("price").between(1, 20), F.lit(False)).alias("is_longshot")
    by = _moments(t, cube, "quarter", "role", "price").where("role = 'taker'").groupBy("quarter", price_bucket(F.col("price")).alias("price_bucket"), long)
    return by.agg(F.sum("cp").alias("cents"), F.sum("contracts").alias("contracts"), F.sum("n").alias("n"))


def longshot_volume_share(t: Tables, cube: DataFrame | None = None) -> DataFrame:
    """Takers' dollars at 1 to 20 cents by quarter, and their share; quarters without any are left out."""
    long = F.col("is_longshot")
    out = _bucket_volumes(t, cube).groupBy("quarter").agg(_if(long, F.col("cents")).alias("lc"), _if(long, F.col("contracts")).alias("longshot_contracts"), _if(long, F.col("n")).alias("longshot_n"), F.sum("cents").alias("tc"))
    return out.where("longshot_n > 0").select("quarter", (F.col("lc") / 100).alias("longshot_volume"), "longshot_contracts", "longshot_n", (F.col("tc") / 100).alias("total_volume"), ratio(F.col("lc"), F.col("tc"), 100).alias("share_pct"))


def price_bucket_share_pivot(t: Tables, least_usd: int = 1_000_000, cube: DataFrame | None = None) -> DataFrame:
    """Share of each price bucket by quarter in percent, for quarters with enough volume; a column for each bucket."""
    cols = [F.sum(F.when(F.col("price_bucket") == b, F.col("cents")).otherwise(0)).alias(b) for b in BUCKETS]
    out = _bucket_volumes(t, cube).groupBy("quarter").agg(*cols, F.sum("cents").alias("tc")).where(F.col("tc") >= 100 * least_usd)
    return out.select("quarter", *[ratio(F.col(b), F.col("tc"), 100).alias("p" + b.rstrip("c").replace("-", "_")) for b in BUCKETS])


def maker_taker_gap_over_time(t: Tables, least: int = 1000, cube: DataFrame | None = None) -> DataFrame:
    """Mean excess by quarter of both roles, each with enough legs, in percentage points, and maker minus taker."""
    by = _moments(t, cube, "quarter", "role").where(F.col("n") >= least)
    cols = []
    for r in ("taker", "maker"):
        n, s, s2 = (F.col(f"{r}_{c}") for c in ("n", "se", "se2"))
        excess = ratio(s, n)
        se, low, high = interval95(excess, variance(n, s, s2), n)
        cols += [excess.alias(f"{r}_excess_pp"), n, (F.col(f"{r}_cp") / 100).alias(f"{r}_volume"), se.alias(f"{r}_se_pp"), low.alias(f"{r}_ci_low"), high.alias(f"{r}_ci_high")]
    return by_role(by, "quarter").select("quarter", *cols).withColumn("gap_pp", F.col("maker_excess_pp") - F.col("taker_excess_pp"))


def ticker_sketches(t: Tables, *keys) -> DataFrame:
    """HyperLogLog sketches of the tickers traded, by ``keys`` such as a day, to be stored beside a cube."""
    return distinct_sketches(t.book_trades, list(keys), "ticker")


def meta_stats(t: Tables, tickers: DataFrame | None = None) -> DataFrame:
    """Sizes of the data as metric, value, formatted. Counts are exact; with stored ``ticker_sketches``, num_tickers comes from them."""
    exact = [F.countDistinct("ticker").alias("num_tickers")] if tickers is None else []
    trades = t.book_trades.agg(F.count(F.lit(1)).alias("num_trades"), F.sum("count").alias("total_volume"), *exact)
    markets = t.book_markets.agg(F.count(F.lit(1)).alias("num_markets"), F.countDistinct("event_ticker").alias("num_events"))
    names = ("num_trades", "total_volume", "num_markets", "num_events", "num_tickers")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("value")) for n in names])).alias("r")
    one = trades.crossJoin(markets)  # one row with one row
    if tickers is not None:
        one = one.crossJoin(distinct_estimates(tickers, []).withColumnRenamed("distinct", "num_tickers"))  # and one more
    out = one.select(rows).select("r.*")
    millions = out.where("metric = 'num_trades'").select(
        F.lit("num_trades_millions").alias("metric"), "value", F.format_string("%.1f million", F.col("value") / 1e6).alias("formatted")
    )
    billions = out.where("metric = 'total_volume'").select(
        F.lit("total_volume_billions").alias("metric"), "value", F.format_string("$%.2f billion", F.col("value") / 1e9).alias("formatted")
    )
    return out.withColumn("formatted", F.format_number("value", 0)).unionByName(millions).unionByName(billions)


def calibration_sums(t: Tables) -> DataFrame:
    """Wins and legs by time slot and price, all that ``calibration_deviation_over_time`` needs of the trades: one scan.

    A slot is a day, but on Sundays, which a weekly boundary cuts at a time that isn't known yet, each time on its own.
    """
    at = F.col("created_time")
    slot = F.when(F.dayofweek(at) == 1, at).otherwise(F.date_trunc("day", at).cast("timestamp_ntz")).alias("slot")
    rows = leg_sums(t.book_trades, t.book_markets, slot, strict=False, also=("created_time",)).where(F.col("price").between(1, 99))
    return rows.groupBy("slot", "price").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("won")).alias("w"), F.min("least_created_time").alias("least"), F.max("most_created_time").alias("most")
    )


def calibration_deviation_over_time(t: Tables, least: int = 1000, sums: DataFrame | None = None) -> DataFrame:
    """At each weekly boundary from the first Sunday on, at the first leg's time of day, the mean over prices of |cumulative win rate - price|.

    A leg counts from the first boundary at or after it. Trades are scanned once, for ``calibration_sums`` (``sums``: stored
    ones to read instead); the windows hold 99 rows a week.
    """
    sums = stored(calibration_sums(t), "calibration") if sums is None else sums
    first = sums.agg(F.min("least").alias("lo"), F.max("most").alias("hi"))
    # Sunday is day 1; days on to the first Sunday that isn't before the first leg
    sunday = F.col("lo") + F.make_dt_interval(F.pmod(8 - F.dayofweek("lo"), F.lit(7)).cast("int"))
    bounds = first.select(sunday.alias("start"), "hi").where("start <= hi")
    week = F.greatest(F.lit(0), F.ceil(F.timestamp_diff("MICROSECOND", F.col("start"), F.col("slot")) / F.lit(7 * 86400 * 1_000_000)))
    at = F.col("start") + F.make_dt_interval((7 * week).cast("int"))
    dated = sums.join(F.broadcast(bounds)).withColumn("at", at).where("at <= hi")  # one row
    by = dated.groupBy("at", "price").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    weeks = bounds.select(F.explode(F.sequence("start", "hi", F.expr("interval 7 days"))).alias("at"))
    grid = weeks.crossJoin(sums.sparkSession.range(1, 100).select(F.col("id").cast("int").alias("price"))).join(by, ["at", "price"], "left")
    upto = Window.partitionBy("price").orderBy("at")
    grid = grid.withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(upto)).withColumn("w", F.sum(F.coalesce("w", F.lit(0))).over(upto)).where("n > 0")
    out = grid.groupBy("at").agg(F.avg(F.abs(100 * F.col("w") / F.col("n") - F.col("price"))).alias("mean_abs_deviation"), F.sum("n").alias("cumulative_legs"))
    return out.where(F.col("cumulative_legs") >= least).withColumnRenamed("at", "week")


def position_moments(t: Tables) -> DataFrame:
    """The cube that serves the price-keyed analyses: integer moments by quarter, category, role, side and price."""
    return position_cube(book_sums(t, "quarter", "category"), "quarter", "category")
