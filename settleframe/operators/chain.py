"""Analyses of the chain venue: swaps priced by their amounts, and times by block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quarter, ratio
from ..plans.carry import as_of
from ..sources.shared import stored
from ..sources.tables import Tables
from .book import book_sums

BLOCK_BUCKET = 10_800  # blocks whose times are taken as one


def market_resolution(t: Tables) -> DataFrame:
    """(kind, key, outcome, won): tokens with whether they won, AMM addresses by outcome index. Of a repeated key the market with the greatest id holds."""
    prices = F.transform(F.from_json("outcome_prices", "array<string>"), lambda x: x.try_cast("double"))
    m = t.chain_markets.where("closed").select("id", "market_maker_address", F.from_json("clob_token_ids", "array<string>").alias("tokens"), prices.alias("p")).where(F.size("p") == 2)
    a, b = F.col("p")[0], F.col("p")[1]
    m = m.where(((a > 0.99) & (b < 0.01)) | ((a < 0.01) & (b > 0.99))).withColumn("winner", F.when(a > 0.99, 0).otherwise(1))
    tokens = m.where(F.size("tokens") == 2).select("id", "winner", F.posexplode("tokens").alias("outcome", "key")).withColumn("kind", F.lit("token"))
    amms = m.where("market_maker_address is not null").select("id", "winner", F.explode(F.array(F.lit(0), F.lit(1))).alias("outcome"), F.lower("market_maker_address").alias("key")).withColumn("kind", F.lit("amm"))
    both = tokens.unionByName(amms).where("key is not null")
    amm_outcome = F.when(F.col("kind") == "amm", F.col("outcome"))
    by = both.groupBy("kind", "key", amm_outcome.alias("outcome")).agg(F.max_by((F.col("outcome") == F.col("winner")).cast("long"), F.struct("id", "outcome")).alias("won"))
    return by.select("kind", "key", F.coalesce("outcome", F.lit(-1)).cast("int").alias("outcome"), "won")


def priced_legs(t: Tables) -> DataFrame:
    """(block_number, price, won): the buyer at the rounded price of a swap and the seller at 100 less the ratio, rounded, both venues of the chain; prices 1 to 99."""
    buys = F.col("maker_asset_id") == "0"
    ctf = t.chain_trades.select(
        "block_number", F.when(buys, F.col("taker_asset_id")).otherwise(F.col("maker_asset_id")).alias("key"), F.when(buys, F.col("maker_amount")).otherwise(F.col("taker_amount")).cast("double").alias("usd"),
        F.when(buys, F.col("taker_amount")).otherwise(F.col("maker_amount")).cast("double").alias("tokens"),
    ).withColumn("kind", F.lit("token")).withColumn("outcome", F.lit(-1))
    usdc = t.collateral_lookup.where("collateral_symbol = 'USDC'").select(F.lower("address").alias("key")).distinct()
    amm = t.chain_legacy_trades.select("block_number", F.lower("fpmm_address").alias("key"), F.col("amount").try_cast("double").alias("usd"), F.col("outcome_tokens").try_cast("double").alias("tokens"), F.col("outcome_index").cast("int").alias("outcome"))
    amm = amm.join(usdc, "key", "left_semi").withColumn("kind", F.lit("amm"))
    rows = ctf.unionByName(amm).where("usd > 0 and tokens > 0").join(market_resolution(t), ["kind", "key", "outcome"])
    cents = 100 * F.col("usd") / F.col("tokens")
    sides = F.array(F.struct(F.round(cents).cast("int").alias("price"), F.col("won").alias("won")), F.struct(F.round(100 - cents).cast("int").alias("price"), (1 - F.col("won")).alias("won")))
    return rows.select("block_number", F.explode(sides).alias("s")).select("block_number", "s.*").where(F.col("price").between(1, 99))


def chain_win_rate_by_price(t: Tables) -> DataFrame:
    by = priced_legs(t).groupBy("price").agg(F.count(F.lit(1)).alias("total_trades"), F.sum("won").alias("wins"))
    return by.withColumn("win_rate", ratio(F.col("wins"), F.col("total_trades"), 100))


def chain_calibration_metrics(t: Tables) -> DataFrame:
    """One row: Brier score, log loss and expected calibration error, to four places."""
    n, w, p = F.col("total_trades"), F.col("wins"), F.col("price") / 100
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    total = F.sum("total_trades")
    return chain_win_rate_by_price(t).agg(
        F.round(F.sum(w * (p - 1) ** 2 + (n - w) * p**2) / total, 4).alias("brier"), F.round(-F.sum(w * F.ln(q) + (n - w) * F.ln(1 - q)) / total, 4).alias("log_loss"),
        F.round(F.sum(n * F.abs(w / n - p)) / total, 4).alias("ece"), F.coalesce(total, F.lit(0)).alias("total_trades"),
    )


def bucket_times(t: Tables) -> DataFrame:
    """(bucket, ts): the time of the first block of each bucket."""
    return t.blocks.groupBy(F.expr(f"block_number div {BLOCK_BUCKET}").alias("bucket")).agg(F.min_by(F.col("timestamp").try_cast("timestamp"), "block_number").alias("ts"))


def chain_volume_over_time(t: Tables) -> DataFrame:
    """Notional volume by quarter: dollars of USDC AMM trades and outcome tokens of swaps. Blocks are summed by bucket before times join."""
    bucket = F.expr(f"block_number div {BLOCK_BUCKET}").alias("bucket")
    usdc = t.collateral_lookup.where("collateral_symbol = 'USDC'").select(F.lower("address").alias("key")).distinct()
    amm = t.chain_legacy_trades.select(bucket, F.lower("fpmm_address").alias("key"), F.col("amount").try_cast("decimal(38,0)").alias("v")).join(usdc, "key", "left_semi").select("bucket", "v")
    ctf = t.chain_trades.where("maker_asset_id = '0' or taker_asset_id = '0'")
    ctf = ctf.select(bucket, F.when(F.col("maker_asset_id") == "0", F.col("taker_amount")).otherwise(F.col("maker_amount")).cast("decimal(38,0)").alias("v"))
    by = amm.unionByName(ctf).groupBy("bucket").agg(F.sum("v").alias("v"))
    return by.join(bucket_times(t), "bucket").groupBy(quarter("ts").alias("quarter")).agg((F.sum("v").cast("double") / 1e6).alias("volume_usd"))


def chain_trades_per_block(t: Tables) -> DataFrame:
    """Trades of both kinds by block, with the block's time; each kind is counted before the union."""
    count = lambda df: df.groupBy("block_number").agg(F.count(F.lit(1)).alias("c"))
    by = count(t.chain_trades).unionByName(count(t.chain_legacy_trades)).groupBy("block_number").agg(F.sum("c").alias("trades"))
    return by.join(t.blocks.select("block_number", F.col("timestamp").try_cast("timestamp").cast("timestamp_ntz").alias("ts")), "block_number")


def cross_venue_calibration(t: Tables, least: int = 1000, every: int = 2) -> DataFrame:
    """Cumulative (total, wins, win_rate) by venue, price and day, on every second day on which either venue has ``least`` legs by then.

    Legs are summed by day and price, written once. A running total holds until its venue and price trade again, so it is
    told for the kept days in between: how many kept days lie before a day is asked as of that day, and no grid is made.
    """
    dated = book_sums(t, F.date_trunc("day", "created_time").cast("date").alias("day")).where(F.col("price").between(1, 99))
    book = dated.select(F.lit("book").alias("venue"), "day", "price", "n", (F.col("n") * F.col("won")).alias("w"))
    chain = priced_legs(t).withColumn("bucket", F.expr(f"block_number div {BLOCK_BUCKET}")).groupBy("bucket", "price").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w"))
    chain = chain.join(bucket_times(t), "bucket").select(F.lit("chain").alias("venue"), F.to_date("ts").alias("day"), "price", "n", "w")
    by = stored(book.unionByName(chain).where("day is not null").groupBy("venue", "day", "price").agg(F.sum("n").alias("n"), F.sum("w").alias("w")), "sums-by-day")
    # a venue's legs only grow, so days are kept from the first on which either has enough
    whole = by.groupBy("venue", "day").agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("venue").orderBy("day")))
    since = whole.where(F.col("all") >= least).agg(F.min("day")).scalar()
    days = by.select("day").distinct()
    numbered = days.where(F.col("day") >= since).withColumn("k", F.row_number().over(Window.orderBy("day")))  # one row a day
    kept = numbered.where((F.col("k") - 1) % every == 0).select("day", F.expr(f"(k - 1) div {every} + 1").cast("int").alias("k"))
    kept = stored(kept, "kept-days")
    before = as_of(days, kept, [], "day", ["k"], exact=False).select("day", F.coalesce("k", F.lit(0)).alias("earlier"))
    own = Window.partitionBy("venue", "price").orderBy("day")
    totals = by.select("venue", "price", "day", F.sum("n").over(own).alias("total"), F.sum("w").over(own).alias("wins"), F.lead("day").over(own).alias("next"))
    after = before.select(F.col("day").alias("next"), F.col("earlier").alias("upto"))
    held = totals.join(before, "day").join(after, "next", "left").withColumn("upto", F.coalesce("upto", kept.agg(F.max("k")).scalar()))
    held = held.where("total > 0 and upto > earlier").withColumn("k", F.explode(F.sequence(F.col("earlier") + 1, F.col("upto"))))
    out = held.drop("day").join(kept, "k")
    return out.select("venue", F.col("day").cast("timestamp_ntz").alias("day"), "price", "total", "wins", ratio(F.col("wins"), F.col("total"), 100).alias("win_rate"))


def cross_venue_frames(t: Tables, least: int = 100) -> DataFrame:
    """The curve of each venue as of each kept day, where the venue has ``least`` legs by then."""
    grid = cross_venue_calibration(t)
    over = Window.partitionBy("venue", "day")
    return grid.withColumn("venue_total", F.sum("total").over(over)).where(F.col("venue_total") >= least).select("venue", "day", "price", "win_rate", "venue_total")
