"""The five significance tests, from frequency tables and moments over all legs: no samples, nothing raw on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, variance
from ..functions.quantiles import percentiles
from ..functions.stats import cohens_d, correlation_t, normal_two_sided_p, normal_upper_p, student_two_sided_p, two_proportion_z, welch
from ..plans.legs import legs_of, moments, resolved, totals, trade_sums
from ..sources.shared import stored
from ..sources.tables import Tables
from .categories import classify, rules_table

STEP = 256  # values in a group of the two-level rank sums
#: fixed values: prices and price ranges that are tested
PRICES = (1, 2, 3, 4, 5, 10, 15, 20, 25, 50, 75, 80, 85, 90, 95, 96, 97, 98, 99)
RANGES = ((1, 10), (11, 25), (26, 50), (51, 75), (76, 90), (91, 99))


def equal_width_bin(x: Column, low: Column, high: Column, k: int) -> Column:
    """1 to k over [low, high], closed on the right, the least value in the first."""
    width = (high - low) / k
    return F.when(high == low, F.lit(1)).otherwise(F.least(F.lit(k), F.greatest(F.lit(1), F.ceil((x - low) / F.nullif(width, F.lit(0.0))).cast("int"))))


def frequencies(t: Tables) -> DataFrame:
    """How often each trade (taker's side, both prices, contracts, result, category) occurs, written once.

    All five tests read this one table, so trades are scanned once: it has both sides of a trade, ``legs_of`` mirrors it.
    """
    return stored(trade_sums(t.book_trades, t.book_markets, "category", sized=True), "frequencies")


def _legs(t: Tables, freq: DataFrame | None) -> DataFrame:
    return legs_of(freq if freq is not None else frequencies(t))


def _below(freq: DataFrame, value: str, weight: Column, *by: str) -> DataFrame:
    """``freq`` with the column below: the weight of lesser values inside ``by``.

    Sums are taken inside groups of STEP values and then over the groups, so no task sorts all values.
    """
    inside = Window.partitionBy(*by, "step").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = freq.withColumn("step", F.expr(f"{value} div {STEP}")).withColumn("weight", weight)
    rows = rows.withColumn("inside", F.coalesce(F.sum("weight").over(inside), F.lit(0)))
    before = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = freq.groupBy(*by, F.expr(f"{value} div {STEP}").alias("step")).agg(F.sum(weight).alias("sum"))
    steps = steps.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    return rows.join(steps, [*by, "step"]).withColumn("below", F.col("inside") + F.col("before")).drop("step", "weight", "inside", "before")


def trade_size_by_role(t: Tables, bins: int = 10, least: int = 100, p_values: bool = True, freq: DataFrame | None = None) -> DataFrame:
    """By bin of the taker's price: what makers and takers pay in the same trades, and Mann-Whitney U (makers larger).

    A trade gives both its sizes to the bin of its taker's price; bins with fewer than ``least`` trades are left out.
    Ranks are sums over a frequency table, medians are exact.
    """
    freq = freq if freq is not None else frequencies(t)
    yes = F.col("taker_side") == "yes"
    taker, maker = F.when(yes, F.col("yes_price")).otherwise(F.col("no_price")), F.when(yes, F.col("no_price")).otherwise(F.col("yes_price"))
    trades = freq.select(taker.alias("price"), (F.col("count") * taker).alias("taker_cents"), (F.col("count") * maker).alias("maker_cents"), "n")
    ends = trades.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    trades = trades.join(F.broadcast(ends)).withColumn("bin", equal_width_bin(F.col("price"), F.col("lo"), F.col("hi"), bins))  # one row
    none = F.lit(0).cast("long")
    sizes = F.array(F.struct(F.col("maker_cents").alias("cents"), F.col("n").alias("m"), none.alias("k")), F.struct(F.col("taker_cents").alias("cents"), none.alias("m"), F.col("n").alias("k")))
    by = trades.select("bin", F.explode(sizes).alias("s")).select("bin", "s.*").groupBy("bin", "cents").agg(F.sum("m").alias("m"), F.sum("k").alias("k"))
    by = stored(by, "sizes")
    tied = F.col("m") + F.col("k")
    rank = _below(by, "cents", tied, "bin").withColumn("rank", F.col("below") + (tied + 1) / 2.0)
    ties = F.sum((tied.cast("double") * tied * tied - tied)).alias("ties")
    sums = rank.groupBy("bin").agg(
        F.sum("k").alias("n_trades"), F.sum(F.col("m") * F.col("rank")).alias("r1"), ties, F.sum(F.col("m") * F.col("cents")).alias("s1"), F.sum(F.col("k") * F.col("cents")).alias("s2")
    ).where(F.col("n_trades") >= least)
    for role, weight in (("maker", "m"), ("taker", "k")):
        middle = percentiles(by, ["bin"], "cents", weight, [0.5]).select("bin", (F.col("q")[0] / 100).alias(f"{role}_median"))
        sums = sums.join(middle, "bin")
    n = F.col("n_trades").cast("double")
    u = F.col("r1") - n * (n + 1) / 2
    sd = F.sqrt(n * n / 12 * (2 * n + 1 - F.col("ties") / (2 * n * (2 * n - 1))))
    means = {"maker": ratio(F.col("s1"), n, 0.01), "taker": ratio(F.col("s2"), n, 0.01)}
    span = F.concat((F.col("bin") - 1) * 10 + 1, F.lit("-"), F.col("bin") * 10, F.lit("c"))
    out = sums.select(
        "bin", span.alias("price_bin"), "n_trades", *[m.alias(f"{r}_mean") for r, m in means.items()], "maker_median", "taker_median", u.alias("u"),
        (1 - 2 * u / (n * n)).alias("rank_biserial"), ((u - n * n / 2 - 0.5) / F.nullif(sd, F.lit(0.0))).alias("z"),
    )
    out = out.withColumn("mean_ratio", F.col("maker_mean") / F.nullif("taker_mean", F.lit(0.0))).withColumn("maker_larger", F.col("maker_mean") > F.col("taker_mean"))
    return out.withColumn("p", normal_upper_p("z")) if p_values else out


def yes_no_asymmetry(t: Tables, least: int = 100, p_values: bool = True, freq: DataFrame | None = None) -> DataFrame:
    """Takers on YES and NO at the listed prices, where each has ``least`` trades: win rates weighted by contracts, and NO against YES.

    yes_n and no_n are contracts; z is of the pooled shares, NO minus YES; ev is the expected value in percent of the price.
    """
    rows = totals(_legs(t, freq)).where("role = 'taker'").where(F.col("price").isin(*PRICES))
    pick = lambda s, c: F.sum(F.when(F.col("side") == s, F.col(c)))
    sums = [pick(s, c).alias(f"{s}_{name}") for s in ("yes", "no") for c, name in (("contracts", "n"), ("cw", "w"))]
    both = rows.groupBy("price", "side").agg(*moments()).where(F.col("n") >= least).groupBy("price").agg(*sums)
    both = both.where("yes_n is not null and no_n is not null")
    c = {name: F.col(name).cast("double") for name in ("yes_n", "yes_w", "no_n", "no_w")}
    rate = {s: c[f"{s}_w"] / F.nullif(c[f"{s}_n"], F.lit(0.0)) for s in ("yes", "no")}
    p = F.col("price")
    out = both.select("price", *[r.alias(f"{s}_win_rate") for s, r in rate.items()], "yes_n", "no_n", two_proportion_z(c["no_w"], c["no_n"], c["yes_w"], c["yes_n"]).alias("z"))
    for s in ("yes", "no"):
        out = out.withColumn(f"{s}_ev_pct", (100 * F.col(f"{s}_win_rate") - p) / p * 100)
    yes, no = F.col("yes_win_rate"), F.col("no_win_rate")
    out = out.withColumn("diff_pp", (no - yes) * 100).withColumn("ev_diff", F.col("no_ev_pct") - F.col("yes_ev_pct")).withColumn("no_better", no > yes)
    return out.withColumn("p", normal_two_sided_p("z")) if p_values else out


def _compared(rows: DataFrame, key: str, names: tuple[str, str], p_values: bool) -> DataFrame:
    """Welch's t and Cohen's d of the columns n, mean and var of two sides in each row."""
    sides = [F.col(f"{s}_{c}").cast("double").alias(f"{s}_{c}") for s in names for c in ("n", "mean", "var")]
    out, of = rows.select(key, *sides), [F.col(f"{s}_{c}") for s in names for c in ("n", "mean", "var")]
    t, df = welch(*of)
    out = out.withColumn("t", t).withColumn("df", df).withColumn("cohens_d", cohens_d(*of)).withColumn("diff", of[1] - of[4])
    return out.withColumn("p", student_two_sided_p("t", "df")) if p_values else out


def category_gaps(
    t: Tables, rules: DataFrame | None = None, base: str = "Finance", least: int = 100, p_values: bool = True, freq: DataFrame | None = None
) -> DataFrame:
    """Takers' excess in each other group against ``base``."""
    rules = rules if rules is not None else rules_table(t.book_trades.sparkSession)
    rows = totals(_legs(t, freq)).where("role = 'taker'")
    classes = classify(resolved(t.book_markets).select("category").distinct(), rules).select("category", "group")  # from the markets
    by = rows.groupBy("category").agg(*moments()).join(classes, "category").groupBy("group").agg(*[F.sum(c).alias(c) for c in ("n", "se", "se2")])
    by = by.where(F.col("n") >= least)
    by = by.select("group", "n", ratio(F.col("se"), F.col("n"), 0.01).alias("mean"), (variance(F.col("n"), F.col("se"), F.col("se2"), sample=True) / 1e4).alias("var"))
    # the base group's values beside each other group: a handful of rows in one window
    everything = Window.partitionBy(F.lit(1))
    held = [F.max(F.when(F.col("group") == base, F.col(c))).over(everything).alias(f"base_{c}") for c in ("n", "mean", "var")]
    both = by.select("group", *held, *[F.col(c).alias(f"other_{c}") for c in ("n", "mean", "var")])
    return _compared(both.where((F.col("group") != base) & F.col("base_n").isNotNull()), "group", ("base", "other"), p_values)


def trade_size_performance(t: Tables, bins: int = 20, p_values: bool = True, freq: DataFrame | None = None) -> DataFrame:
    """One row: Pearson and Spearman of takers' log10 size and excess with their p, and the weighted line over size bins with its R².

    All come from the frequency table of (size, excess); sizes under a cent count as one. The line is fitted with the
    bins' counts, its R² uses their roots.
    """
    rows = _legs(t, freq).where("role = 'taker'")
    rows = rows.groupBy(F.greatest(F.col("contracts") * F.col("price"), F.lit(1)).cast("long").alias("cents"), "e").agg(F.sum("n").alias("f"))
    rows = stored(rows, "sizes-and-excess")
    rows = rows.withColumn("x", F.log10(F.col("cents") / 100)).withColumn("y", F.col("e") / 100)

    def ranked(col: str) -> DataFrame:
        by = _below(rows.groupBy(col).agg(F.sum("f").alias("c")), col, F.col("c"))
        return by.select(col, (F.col("below") + (F.col("c") + 1) / 2.0).alias(f"rank_{col}"))

    def correlation(x: str, y: str, name: str) -> Column:
        w, a, b = F.col("f"), F.col(x), F.col(y)
        n, sx, sy = F.sum(w), F.sum(w * a), F.sum(w * b)
        spread = F.sqrt((F.sum(w * a * a) - sx * sx / n) * (F.sum(w * b * b) - sy * sy / n))
        return ((F.sum(w * a * b) - sx * sy / n) / F.nullif(spread, F.lit(0.0))).alias(name)

    both = rows.join(ranked("cents"), "cents").join(ranked("e"), "e")
    all_ = both.agg(F.sum("f").alias("n"), correlation("x", "y", "pearson"), correlation("rank_cents", "rank_e", "spearman"))
    if p_values:
        for name in ("pearson", "spearman"):
            all_ = all_.withColumn(f"{name}_p", student_two_sided_p(correlation_t(F.col(name), F.col("n")), (F.col("n") - 2).cast("double")))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    by = rows.join(F.broadcast(ends)).groupBy(equal_width_bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.sum("f").alias("w"), (F.sum(F.col("f") * F.col("x")) / F.sum("f")).alias("bx"), (F.sum(F.col("f") * F.col("y")) / F.sum("f")).alias("by"))
    w, x, y = F.col("w"), F.col("bx"), F.col("by")
    line = by.agg(F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"))
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    line = line.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw"))
    r, fit = F.sqrt("w"), F.col("slope") * x + F.col("intercept")
    mean = by.agg((F.sum(F.sqrt("w") * y) / F.sum(F.sqrt("w"))).alias("ybar"))
    fitted = by.join(F.broadcast(line.select("slope", "intercept"))).join(F.broadcast(mean)).groupBy("slope", "intercept").agg((1 - F.sum(r * (y - fit) ** 2) / F.nullif(F.sum(r * (y - F.col("ybar")) ** 2), F.lit(0.0))).alias("r2"))
    return all_.crossJoin(fitted.withColumn("slope_pp", 100 * F.col("slope")))  # one row with one row


def maker_direction(t: Tables, cap: int = 100, least: int = 100, p_values: bool = True, freq: DataFrame | None = None) -> DataFrame:
    """Makers' NO against YES in price ranges where each side has ``least`` legs.

    The excess is weighted by all contracts. Welch's t and Cohen's d, NO minus YES, weigh each leg by its contracts up to
    ``cap``, as if it were repeated so often. yes_n and no_n are legs.
    """
    span = F.coalesce(*[F.when(F.col("price").between(a, b), F.lit(f"{a}-{b}")) for a, b in RANGES])
    w, c, e = F.col("n") * F.least("contracts", F.lit(cap)), F.col("n") * F.col("contracts"), F.col("e").cast("long")
    rows = _legs(t, freq).where("role = 'maker'").withColumn("range", span).where("range is not null")
    by = rows.groupBy("range", "side").agg(
        F.sum("n").alias("legs"), F.sum(w).alias("n"), F.sum(w * e).alias("se"), F.sum(w * e * e).alias("se2"), ratio(F.sum(c * e), F.sum(c)).alias("excess_pp")
    ).where(F.col("legs") >= least)
    moments_ = (F.col("n"), F.col("se"), F.col("se2"))
    by = by.select("range", "side", "legs", "excess_pp", "n", ratio(F.col("se"), F.col("n"), 0.01).alias("mean"), (variance(*moments_, sample=True) / 1e4).alias("var"))
    pick = lambda s, name: F.max(F.when(F.col("side") == s, F.col(name))).alias(f"{s}_{name}")
    both = by.groupBy("range").agg(*[pick(s, x) for s in ("no", "yes") for x in ("legs", "excess_pp", "n", "mean", "var")])
    both = both.where("yes_legs is not null and no_legs is not null")
    own = both.select(
        "range", "yes_excess_pp", "no_excess_pp", (F.col("no_excess_pp") - F.col("yes_excess_pp")).alias("diff_pp"), (F.col("no_excess_pp") > F.col("yes_excess_pp")).alias("no_better"),
        F.col("yes_legs").alias("yes_n"), F.col("no_legs").alias("no_n"),
    )
    tested = _compared(both, "range", ("no", "yes"), p_values).select("range", "t", "df", "cohens_d", *(["p"] if p_values else []))
    return own.join(tested, "range")


def statistical_tests(t: Tables) -> DataFrame:
    """(test, metric, value) of all five, from one frequency table that is written once: trades are scanned once."""
    freq = frequencies(t)

    def rows(df: DataFrame, test: str, **metrics: Column) -> DataFrame:
        out = df.agg(*[c.cast("double").alias(k) for k, c in metrics.items()])
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])).alias("r")
        return out.select(F.lit(test).alias("test"), each).select("test", "r.*")

    count, significant = F.count(F.lit(1)), F.coalesce(F.sum((F.col("p") < 0.05).cast("int")), F.lit(0))
    single = {k: F.max(k) for k in ("pearson", "pearson_p", "spearman", "spearman_p", "slope_pp", "r2")}
    parts = [
        rows(trade_size_by_role(t, freq=freq), "trade_size_by_role", groups=count, significant=significant, mean_ratio=F.avg("mean_ratio")),
        rows(yes_no_asymmetry(t, freq=freq), "yes_no_asymmetry", groups=count, significant=significant, mean_diff_pp=F.avg("diff_pp")),
        rows(category_gaps(t, freq=freq), "category_gaps", groups=count, significant=significant, max_abs_d=F.max(F.abs("cohens_d"))),
        rows(trade_size_performance(t, freq=freq), "trade_size_performance", **single),
        rows(maker_direction(t, freq=freq), "maker_direction", groups=count, significant=significant, max_abs_d=F.max(F.abs("cohens_d"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
