"""Jobs from landed raw records to the typed tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .manifest import Manifest, Run


def event_time(text: Column) -> Column:
    """An ISO time with any number of fractional digits, cut or filled to six; empty or bad: null.

    The usual form, in UTC with at most nine digits, is cast as it is: one pattern instead of three and a new text.
    """
    usual = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z$")
    seconds = F.regexp_extract(text, r"^([^.Z+]*\d)", 1)
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)", 1), 1, 6), 6, "0")
    zone = F.regexp_extract(text, r"(Z|[+-]\d\d:\d\d)$", 1)
    other = F.try_to_timestamp(F.concat(seconds, F.lit("."), fraction, F.when(zone.isin("", "Z"), "+00:00").otherwise(zone)))
    return F.when(usual, text.try_cast("timestamp")).otherwise(other).cast("timestamp_ntz")


def _default(name: str, value, kind: str) -> Column:
    return F.coalesce(F.col(name).try_cast(kind), F.lit(value).cast(kind)).alias(name)


def ingest_book_trades(raw: DataFrame) -> DataFrame:
    """Trades whose required keys are all there."""
    keys = ("trade_id", "ticker", "count", "yes_price", "no_price", "taker_side", "created_time")
    return raw.dropna(subset=list(keys)).select("trade_id", "ticker", F.col("count").cast("long"), F.col("yes_price").cast("int"), F.col("no_price").cast("int"), "taker_side", event_time(F.col("created_time")).alias("created_time"))


def ingest_book_markets(raw: DataFrame) -> DataFrame:
    """Markets with defaults for missing keys; prices stay null, empty times become null."""
    text = [_default(c, "", "string") for c in ("market_type", "title", "yes_sub_title", "no_sub_title", "result")]
    counts = [_default(c, 0, "bigint") for c in ("volume", "volume_24h", "open_interest")]
    prices = [F.col(c).try_cast("int").alias(c) for c in ("yes_bid", "yes_ask", "no_bid", "no_ask", "last_price")]
    times = [event_time(F.col(c)).alias(c) for c in ("created_time", "open_time", "close_time")]
    return raw.where("ticker is not null").select("ticker", "event_ticker", "status", *text, *prices, *counts, *times)


def ingest_chain_markets(raw: DataFrame) -> DataFrame:
    """camelCase to snake_case; numbers may be strings; a bad time is null."""
    return raw.where("id is not null").select(
        F.col("id").cast("string"), F.col("conditionId").alias("condition_id"), "question", "slug", "outcomes", F.col("outcomePrices").alias("outcome_prices"), F.col("clobTokenIds").alias("clob_token_ids"),
        _default("volume", 0.0, "double"), _default("liquidity", 0.0, "double"), _default("active", False, "boolean"), _default("closed", False, "boolean"),
        event_time(F.col("endDate")).alias("end_date"), event_time(F.col("createdAt")).alias("created_at"), F.col("marketMakerAddress").alias("market_maker_address"),
    )


def ingest_data_api_trades(raw: DataFrame) -> DataFrame:
    return raw.select(F.coalesce("conditionId", "market", F.lit("")).alias("condition_id"), F.coalesce("side", F.lit("")).alias("side"), _default("size", 0.0, "double"), _default("price", 0.0, "double"), F.coalesce("outcome", F.lit("")).alias("outcome"), _default("timestamp", 0, "bigint"))


#: fixed value: topic of the order event
ORDER_FILLED = "0xd0a08e8c493f9c94f29311604c9de1b4e8c8d4c06bd0c789af57f2d65bfec0f6"


def _word(data: Column, k: int) -> Column:
    """The k-th 32-byte word of hex data behind 0x."""
    return F.substring(data, 3 + 64 * k, 64)


def _has_words(data: Column, least: int) -> Column:
    """Whether hex data behind 0x is whole 32-byte words, at least so many: by its length and by whether it can be read as hex; the pattern, which is slow, judges the rest."""
    hexed = F.startswith(data, F.lit("0x")) & (F.length(data) % 64 == 2) & (F.length(data) >= 2 + 64 * least) & F.unhex(F.substr(data, F.lit(3))).isNotNull()
    return hexed | data.rlike("^0x([0-9a-fA-F]{64}){%d,}$" % least)


def _small(word: Column) -> Column:
    """A hex word that fits 60 bits as a number; null if it doesn't."""
    return F.when(F.substring(word, 1, 49) == "0" * 49, F.conv(F.substring(word, 50, 15), 16, 10).cast("bigint"))


def _address(topic: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.substring(topic, 27, 40)))


@F.pandas_udf(StringType())
def _big(words: pd.Series) -> pd.Series:  # 256-bit numbers have no native type
    return words.map(lambda w: str(int(w, 16)) if w else None, na_action="ignore")


def decode_order_filled(logs: DataFrame, topic: str = ORDER_FILLED) -> DataFrame:
    """Logs (block_number, transaction_hash, log_index, topics, data) to swaps; rows that don't decode are left out."""
    d = F.col("data")
    fits = (F.col("topics")[0] == topic) & (F.size("topics") == 4) & _has_words(d, 5)
    out = logs.where(fits).select(
        "block_number", "transaction_hash", "log_index", F.lower(F.col("topics")[1]).alias("order_hash"), _address(F.col("topics")[2]).alias("maker"), _address(F.col("topics")[3]).alias("taker"),
        _big(_word(d, 0)).alias("maker_asset_id"), _big(_word(d, 1)).alias("taker_asset_id"), _small(_word(d, 2)).alias("maker_amount"), _small(_word(d, 3)).alias("taker_amount"), _small(_word(d, 4)).alias("fee"),
    )
    return out.dropna(subset=["maker_amount", "taker_amount", "fee"])


def chain_trade_measures(trades: DataFrame) -> DataFrame:
    """is_buy, price, size, side and token of swaps; 0 where an amount is."""
    buys = F.col("maker_asset_id") == "0"
    usd, tokens = F.when(buys, F.col("maker_amount")).otherwise(F.col("taker_amount")), F.when(buys, F.col("taker_amount")).otherwise(F.col("maker_amount"))
    price = F.when(tokens > 0, usd / F.nullif(tokens, F.lit(0))).otherwise(0.0)
    return trades.withColumns({"is_buy": buys, "price": price, "size": tokens / 1e6, "side": F.when(buys, "BUY").otherwise("SELL"), "token": F.when(buys, F.col("taker_asset_id")).otherwise(F.col("maker_asset_id"))})


def decode_amm_trades(logs: DataFrame, buy_topic: str, sell_topic: str) -> DataFrame:
    """AMM buy and sell logs to legacy trades: address, trader and outcome from topics, amounts from data, with price, size and volume."""
    t, d = F.col("topics"), F.col("data")
    fits = t[0].isin(buy_topic, sell_topic) & (F.size("topics") >= 3) & _has_words(d, 3)
    out = logs.where(fits).select(
        "block_number", "transaction_hash", "log_index", F.lower("address").alias("fpmm_address"), _address(t[1]).alias("trader"), (t[0] == buy_topic).alias("is_buy"),
        _big(_word(d, 0)).alias("amount"), _big(_word(d, 1)).alias("fee_amount"), _small(F.substring(t[2], 3, 64)).alias("outcome_index"), _big(_word(d, 2)).alias("outcome_tokens"),
    )
    a, n = F.col("amount").try_cast("double"), F.col("outcome_tokens").try_cast("double")
    return out.withColumns({"price": F.when(n > 0, a / F.nullif(n, F.lit(0.0))).otherwise(0.0), "size": n / 1e6, "volume": a / 1e6})


def dedup_append(stored: DataFrame, new: DataFrame, keys: list[str], first_by: list[str]) -> DataFrame:
    """Rows of ``new`` to append: of each unseen key the first by ``first_by``.

    A row with a null in its key is no repeat of any other: all of them are appended.
    """
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    order = Window.partitionBy(*keys).orderBy(*first_by)
    unseen = new.where(whole).join(stored.select(*keys), keys, "left_anti")
    first = unseen.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    return first.select(*new.columns).unionByName(new.where(~whole))


def pending_tickers(markets: DataFrame, trades: DataFrame, least_volume: int = 100) -> DataFrame:
    """Markets with enough volume and no stored trade."""
    return markets.where(F.col("volume") >= least_volume).select("ticker").distinct().join(trades.select("ticker").distinct(), "ticker", "left_anti")


def tag_provenance(df: DataFrame, contract: str | None = None) -> DataFrame:
    return df.withColumn("_fetched_at", F.current_timestamp().cast("timestamp_ntz")).withColumn("_contract", F.lit(contract).cast("string"))


def interpolate_blocks(samples: DataFrame, bucket: int = 100_000) -> DataFrame:
    """(block_number, ts seconds) samples to every block between: ts + whole seconds of the linear course; the last sample stays.

    Samples are followed inside buckets of blocks; a bucket's last one is followed by the first of the next bucket that has any.
    """
    rows = samples.groupBy("block_number").agg(F.min("ts").alias("ts")).withColumn("bucket", F.expr(f"block_number div {bucket}"))
    own = Window.partitionBy("bucket").orderBy("block_number")
    rows = rows.withColumn("nb", F.lead("block_number").over(own)).withColumn("nt", F.lead("ts").over(own))
    heads = rows.groupBy("bucket").agg(F.min(F.struct("block_number", "ts")).alias("h"))
    heads = heads.withColumn("next", F.lead("h").over(Window.orderBy("bucket"))).select("bucket", "next")
    rows = rows.join(heads, "bucket").select("block_number", "ts", F.coalesce("nb", "next.block_number").alias("nb"), F.coalesce("nt", "next.ts").alias("nt"))
    span = F.col("nb") - F.col("block_number")
    out = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(span - 1, F.lit(0)))))
    step = F.when(F.col("k") > 0, F.floor((F.col("nt") - F.col("ts")) * F.col("k") / F.nullif(span, F.lit(0)))).otherwise(0)
    return out.select((F.col("block_number") + F.col("k")).alias("block_number"), (F.col("ts") + step).cast("long").alias("ts"))


def iso_blocks(blocks: DataFrame) -> DataFrame:
    """Epoch seconds as ISO text."""
    return blocks.select("block_number", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))


def read_compacted(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot that ``compact`` made of the table in ``path``; a folder without one is read as it is."""
    manifest = Manifest(spark, path)
    runs = manifest.runs()
    return spark.read.parquet(*(manifest.paths(runs) if runs else [path]))


def compact(spark: SparkSession, path: str, order_by: str, file_bytes: int = 128 << 20, rows: int | None = None) -> None:
    """Rewrite the table in ``path`` into files of about ``file_bytes``, ranged by a column, each of at most ``rows`` rows.

    The new files are a snapshot in a folder of their own, and take effect with a manifest in one step: until then, and if
    the run fails, ``read_compacted`` gives the old ones. The number of ranges follows from the bytes stored now. A plain
    folder keeps its files under their names until the caller deletes them; of older snapshots the last one is kept.
    """
    manifest = Manifest(spark, path)
    runs = manifest.runs()
    size = stored_bytes(spark, manifest.paths(runs) if runs else [path])
    number = max([r.last for r in runs], default=0) + 1
    rows_now = read_compacted(spark, path)
    ranged = rows_now.repartitionByRange(max(1, -(-size // file_bytes)), order_by).sortWithinPartitions(order_by)
    name = f"run-{number}"
    ranged.write.mode("overwrite").option("maxRecordsPerFile", rows or 0).parquet(f"{path.rstrip('/')}/{name}")
    manifest.commit([Run(name, first=number, last=number)])


def stored_files(spark: SparkSession, folder: str) -> list[tuple[int, str, int]]:
    """(time, path, bytes) of the files right in a folder, oldest first; hidden ones, as Spark's own, aren't told."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((s.getModificationTime(), s.getPath().toString(), s.getLen()) for s in found if s.isFile() and s.getPath().getName()[0] not in "._")


def drop_oldest(spark: SparkSession, folder: str, keep_bytes: int) -> None:
    """Delete the oldest files of a folder until at most ``keep_bytes`` are left: for landed files that are appended, while nothing reads them."""
    files = stored_files(spark, folder)
    left = sum(size for _, _, size in files)
    for _, name, size in files:
        if left <= keep_bytes:
            break
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)
        left -= size


def stored_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of the files in folders."""
    total = 0
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total
