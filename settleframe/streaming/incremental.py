"""Exactly-once appends and a running position cube with Structured Streaming.

What a batch adds takes effect with one manifest, so a batch that runs again after a failure counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import category
from ..plans.legs import merged, mirrored, position_cube
from ..sources.ingest import dedup_append, ingest_book_trades
from .keyindex import KeyIndex
from .levels import Levels

RAW_TRADES = "trade_id string, ticker string, count bigint, yes_price int, no_price int, taker_side string, created_time string"
STORED = "trade_id string, ticker string, count bigint, yes_price int, no_price int, taker_side string, created_time timestamp_ntz, batch bigint"
SUMS = "ticker string, day date, taker_side string, yes_price int, no_price int, n bigint, count bigint"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SUM_KEYS = ("ticker", "day", "taker_side", "yes_price", "no_price")


def _batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All batches under ``folder``; none if the first one isn't written yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)


def append_trades(spark: SparkSession, landing: str, table: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Landed JSON trades to a Parquet folder, each trade_id once, however late it comes; of a batch's repeats the earliest stays.

    Stored keys are looked up in an index beside the table (``key_index``), in the buckets that the batch's keys fall into;
    the stored trades aren't read. A batch is a folder of the table, written first, and then its keys; if the stream fails between the two, both are written again, and if it
    fails after both, the batch is done. A restart goes on where the checkpoint is.
    """
    trades = ingest_book_trades(spark.readStream.schema(RAW_TRADES).option("maxFilesPerTrigger", files_a_batch).json(landing))

    def add(batch: DataFrame, number: int) -> None:
        batch.sparkSession.conf.set(CLEANUP, "true")  # of the stream's own session: else shuffles of all batches stay until the driver collects its garbage
        index = key_index(batch.sparkSession, table)
        if index.holds(number):
            return
        order = ["created_time", "ticker", "count", "yes_price", "no_price", "taker_side"]
        batch = batch.withColumn("trade_id", F.coalesce("trade_id", F.lit("")))  # no id is null; told so, Spark doesn't parse all lines again to look for rows without one
        stored = index.candidates(batch.select(F.col("trade_id").alias("key"))).withColumnRenamed("key", "trade_id")
        dedup_append(stored, batch, ["trade_id"], order).write.mode("overwrite").option("compression", "zstd").parquet(f"{table}/batch={number}")
        new = batch.sparkSession.read.schema(STORED).parquet(f"{table}/batch={number}")
        index.add(number, new.where("trade_id is not null").select(F.col("trade_id").alias("key")))

    return trades.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def key_index(spark: SparkSession, table: str) -> KeyIndex:
    """The keys of the trades that ``append_trades`` stored in ``table``."""
    return KeyIndex(spark, f"{table.rstrip('/')}_keys")


def stored_trades(spark: SparkSession, table: str) -> DataFrame:
    """What ``append_trades`` stored."""
    return _batches(spark, table, STORED).drop("batch")


def _summed(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*SUM_KEYS).agg(F.sum("n").alias("n"), F.sum("count").alias("count"))


def sums_so_far(spark: SparkSession, folder: str) -> Levels:
    """The sums under ``folder``: batches merged two by two, so a read meets about as many folders as their number has bits."""
    return Levels(spark, folder, SUMS, merge=_summed)


def grow_cube(trades: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep sums of streamed trades by ticker, day, side and prices under ``folder``.

    Outcomes are joined when the cube is read, so a trade that comes before its market is resolved counts from then on.
    """

    def add(batch: DataFrame, number: int) -> None:
        levels = sums_so_far(batch.sparkSession, folder)
        if not levels.holds(number):
            by = batch.groupBy("ticker", F.to_date("created_time").alias("day"), "taker_side", "yes_price", "no_price")
            levels.add(number, by.agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("count")))

    return trades.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cube_so_far(spark: SparkSession, folder: str, markets: DataFrame, strict: bool = True) -> DataFrame:
    """Moments by day, category, role, side and price of all trades so far in markets that are resolved by now."""
    return position_cube(mirrored(sums_so_far(spark, folder).read(), markets, strict), "day", "category")


def cube_of_all(cube: DataFrame) -> DataFrame:
    """The same over all days and categories."""
    return merged(cube, "role", "side", "price")


def pending_categories(spark: SparkSession, folder: str, markets: DataFrame) -> DataFrame:
    """(category, n): trades so far whose market has no outcome yet; without a market their category is null."""
    open_ = markets.select("ticker", category(F.col("event_ticker")).alias("category"), F.col("result").isin("yes", "no").alias("done"))
    by = sums_so_far(spark, folder).read().groupBy("ticker").agg(F.sum("n").alias("n")).join(open_, "ticker", "left")
    return by.where(~F.coalesce("done", F.lit(False))).groupBy("category").agg(F.sum("n").alias("n"))
