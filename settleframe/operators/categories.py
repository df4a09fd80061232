"""Categories, their groups by ordered substring rules, and analyses by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import category, ratio
from ..plans.legs import by_role, resolved
from ..sources.tables import Tables
from .book import _moments

#: a small sample; users bring their own rules (pattern, group, category, subcategory), the first that fits counts
SAMPLE_RULES = (
    ("NFL", "Sports", "Football", "NFL"), ("NBA", "Sports", "Basketball", "NBA"), ("BTC", "Crypto", "Bitcoin", "Price"), ("INX", "Finance", "Indices", "Daily"),
    ("PRES", "Politics", "Elections", "President"), ("HIGH", "Weather", "Temperature", "Daily high"),
)
RULE_SCHEMA = "ordinal int, pattern string, group string, mid string, sub string"


def rules_table(spark: SparkSession, rules=SAMPLE_RULES) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], RULE_SCHEMA)


def classify(df: DataFrame, rules: DataFrame, col: str = "category") -> DataFrame:
    """``df`` with group, mid and sub of the first rule whose pattern is in the upper-cased category; else Other, Other, the category.

    The distinct categories' substrings of the lengths that patterns have are looked up among the patterns, so rules and
    categories meet in an equi-join, however many of both there are. An empty pattern is in every category, a null
    category has none.
    """
    names = df.select(F.col(col).alias("_name")).where(F.col(col).isNotNull()).distinct()
    lengths = rules.select(F.length("pattern").alias("n")).agg(F.collect_set("n"))
    sized = names.withColumn("_upper", F.upper("_name")).withColumn("_lengths", F.coalesce(lengths.scalar(), F.array().cast("array<int>")))
    starts = lambda n: F.sequence(F.lit(1), F.length("_upper") - n + 1)
    parts = F.transform(F.filter("_lengths", lambda n: n <= F.length("_upper")), lambda n: F.transform(starts(n), lambda k: F.substring(F.col("_upper"), k, n)))
    looked_up = sized.select("_name", F.explode(F.array_distinct(F.flatten(parts))).alias("pattern"))
    hit = looked_up.join(rules, "pattern")
    first = hit.groupBy("_name").agg(F.min_by(F.struct("group", "mid", "sub"), "ordinal").alias("_r"))
    out = df.join(first, F.col(col) == F.col("_name"), "left").drop("_name")
    other = F.struct(F.lit("Other").alias("group"), F.lit("Other").alias("mid"), F.col(col).alias("sub"))
    return out.withColumn("_r", F.coalesce("_r", other)).select("*", "_r.group", "_r.mid", "_r.sub").drop("_r")


def maker_taker_returns_by_category(t: Tables, rules: DataFrame | None = None, cube: DataFrame | None = None) -> DataFrame:
    """Excess of both roles by group, the categories' means weighted by contracts, in percentage points."""
    rules = rules if rules is not None else rules_table(t.book_trades.sparkSession)
    by = _moments(t, cube, "category", "role")
    classes = classify(resolved(t.book_markets).select("category").distinct(), rules)  # from the markets, so trades are read once
    both = by_role(by, "category").join(classes, "category")
    cols = []
    for r in ("taker", "maker"):
        n, c, x = F.col(f"{r}_n"), F.col(f"{r}_contracts"), ratio(F.col(f"{r}_se"), F.col(f"{r}_n"), 0.01)
        cols += [(100 * F.sum(x * c) / F.sum(c)).alias(f"{r}_excess_pp"), F.sum(n).alias(f"{r}_n"), (F.sum(f"{r}_cp") / 100).alias(f"{r}_volume"), (F.sum(f"{r}_ce") / 100).alias(f"{r}_pnl")]
    return both.groupBy("group").agg(*cols).withColumn("gap_pp", F.col("maker_excess_pp") - F.col("taker_excess_pp"))


def _volumes(t: Tables, rules: DataFrame | None) -> DataFrame:
    rules = rules if rules is not None else rules_table(t.book_trades.sparkSession)
    by = t.book_markets.groupBy(category(F.col("event_ticker")).alias("category")).agg(F.sum(F.coalesce("volume", F.lit(0))).alias("volume"), F.count(F.lit(1)).alias("markets"))
    return classify(by, rules)


def market_types(t: Tables, rules: DataFrame | None = None) -> DataFrame:
    """Volume and number of markets by group, and the share of all volume."""
    by = _volumes(t, rules).groupBy("group").agg(F.sum("volume").alias("volume"), F.sum("markets").alias("markets"))
    return by.withColumn("share_pct", ratio(F.col("volume"), F.sum("volume").over(Window.partitionBy(F.lit(1))), 100))


def market_type_hierarchy(t: Tables, rules: DataFrame | None = None, least_share: float = 0.01) -> DataFrame:
    """Volumes as (level, group, mid, sub) rows: children under ``least_share`` of their parent are left out, as is an only child of its parent's name."""
    v = _volumes(t, rules)
    of = lambda *keys: v.groupBy(*keys).agg(F.sum("volume").alias("volume"))

    def kept(level: DataFrame, parent: list[str], own: str) -> DataFrame:
        over = Window.partitionBy(*parent)
        big = level.withColumn("p", F.sum("volume").over(over)).where(F.col("volume") >= least_share * F.col("p")).withColumn("k", F.count(F.lit(1)).over(over))
        return big.where((F.col("k") > 1) | (F.col(own) != F.col(parent[-1]))).drop("p", "k")

    none = F.lit(None).cast("string")
    top = of("group").select(F.lit(1).alias("level"), "group", none.alias("mid"), none.alias("sub"), "volume")
    mid = kept(of("group", "mid"), ["group"], "mid")
    sub = kept(of("group", "mid", "sub").join(mid.select("group", "mid"), ["group", "mid"]), ["group", "mid"], "sub")
    return top.unionByName(mid.select(F.lit(2).alias("level"), "group", "mid", none.alias("sub"), "volume")).unionByName(sub.select(F.lit(3).alias("level"), "group", "mid", "sub", "volume"))


def market_types_topn(t: Tables, rules: DataFrame | None = None, n: int = 8) -> DataFrame:
    """The n largest categories of each group and the rest as '<group> Other', if it isn't 0."""
    order = Window.partitionBy("group").orderBy(F.desc("volume"), "category")
    ranked = _volumes(t, rules).withColumn("k", F.row_number().over(order))
    name = F.when(F.col("k") <= n, F.col("category")).otherwise(F.concat("group", F.lit(" Other")))
    return ranked.groupBy("group", name.alias("category"), (F.col("k") > n).alias("rest")).agg(F.sum("volume").alias("volume")).where("not rest or volume > 0").drop("rest")


def top_groups(t: Tables, rules: DataFrame | None = None, n: int = 8) -> DataFrame:
    """The n groups with the most dollars taken, largest first (ties by name), with both roles' excess."""
    by = maker_taker_returns_by_category(t, rules)
    return by.select("group", "taker_volume", "taker_excess_pp", "maker_excess_pp").orderBy(F.desc("taker_volume"), "group").limit(n)
