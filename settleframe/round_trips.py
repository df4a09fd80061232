"""Jobs that keep state or write files, run whole over the stand-ins and read back: what they stored is their result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import ingest, sinks
from .sources.shared import run_folder
from .sources.tables import read_collateral, stand_in_tables
from .streaming import incremental

FILES = 6  # that a landed table is dealt into at least, and batches that a stream reads it in at most
FILE_ROWS = 500_000  # trades in a landed file, about
LANDED_BYTES = 256 << 20  # of landed files that are appended, kept at most
TIMEOUT_S = 3600


def _folder(spark: SparkSession, what: str) -> str:
    return f"{run_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _files(rows: int) -> int:
    """Files that so many rows are landed in: their number grows with the rows, so no task writes more than about FILE_ROWS."""
    return max(FILES, -(-rows // FILE_ROWS))


def _numbered_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(stand_in_tables(spark, sf_dir).book_trades)


def _numbered(t: DataFrame) -> DataFrame:
    """The stand-in trades, their times as text, with ids made of all a trade says: equal trades are one."""
    fields = [F.col("ticker").cast("string").alias("ticker"), "count", "yes_price", "no_price", "taker_side", F.date_format("created_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_time")]
    rows = t.select(*fields)
    return rows.select(F.md5(F.concat_ws("|", *rows.columns).cast("binary")).alias("trade_id"), *rows.columns)


def appended_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades landed twice as JSON, appended once each.

    They land share by share, each copy of a trade in a share of its own draw, and a share is a batch. Once it is appended,
    its files go, but for the newest LANDED_BYTES: disk holds one share as text, not all of them. Nothing is shuffled to land.
    """
    folder, trades = _folder(spark, "appended"), stand_in_tables(spark, sf_dir).book_trades
    landing, draw = f"{folder}/landing", F.xxhash64("ticker", "count", "yes_price")  # what is cheap to make: every share reads all trades
    for share in range(FILES):
        times = sum((F.pmod(half, F.lit(FILES)) == share).cast("int") for half in (draw, F.shiftright(draw, 32)))
        drawn = trades.withColumn("_times", times).where("_times > 0")
        landed = _numbered(drawn.withColumn("_time", F.explode(F.array_repeat(F.lit(0), F.col("_times")))))
        landed.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).json(landing)
        stream = incremental.append_trades(spark, landing, f"{folder}/table", f"{folder}/check", files_a_batch=len(ingest.stored_files(spark, landing)))
        if not stream.awaitTermination(TIMEOUT_S):
            stream.stop()
            raise TimeoutError(f"share {share} was not appended in {TIMEOUT_S} s")
        ingest.drop_oldest(spark, landing, LANDED_BYTES)
    return incremental.stored_trades(spark, f"{folder}/table")


def streamed_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments by day, category, role, side and price, from sums that a stream of trades keeps batch by batch."""
    folder, t = _folder(spark, "streamed"), stand_in_tables(spark, sf_dir)
    named = lambda df: df.withColumn("ticker", F.col("ticker").cast("string"))
    trades = named(t.book_trades)
    files = _files(trades.count())
    trades.repartition(files, F.rand(1)).write.parquet(f"{folder}/trades")
    stream = spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", -(-files // FILES)).parquet(f"{folder}/trades")
    incremental.grow_cube(stream, f"{folder}/cube", f"{folder}/check").awaitTermination(TIMEOUT_S)
    return incremental.cube_so_far(spark, f"{folder}/cube", named(t.book_markets))


def compacted_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored trades after two compactions of their folder into itself."""
    folder = _folder(spark, "compacted")
    trades = stand_in_tables(spark, sf_dir).book_trades
    trades.repartition(_files(trades.count()), F.rand(1)).write.parquet(folder)  # by a number: dealing in turn would sort all that a task reads
    for order_by in ("created_time", "ticker"):
        ingest.compact(spark, folder, order_by, file_bytes=1 << 20, rows=10_000)
    return ingest.read_compacted(spark, folder)


def sunk_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades written by each sink and read back, with the sink's name."""
    folder, t = _folder(spark, "sinks"), stand_in_tables(spark, sf_dir).book_trades
    sinks.write_parquet(t, f"{folder}/parquet")
    sinks.write_csv(t, f"{folder}/csv")
    sinks.write_json(t, f"{folder}/json")
    schema = t.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    back = {
        "parquet": spark.read.parquet(f"{folder}/parquet"), "csv": spark.read.schema(schema).option("header", True).csv(f"{folder}/csv"),
        "json": spark.read.schema(schema).json(f"{folder}/json"),
    }
    out = None
    for name, rows in back.items():
        rows = rows.withColumn("sink", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def tagged_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain trades with the contract they came from, and whether they have a time of fetching."""
    tagged = ingest.tag_provenance(stand_in_tables(spark, sf_dir).chain_trades, "0xc0")
    return tagged.withColumn("fetched", F.col("_fetched_at").isNotNull()).withColumnRenamed("_contract", "contract").drop("_fetched_at")


def looked_up_collateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collateral lookup, written as one JSON object and read as rows."""
    folder = _folder(spark, "collateral")
    lookup = stand_in_tables(spark, sf_dir).collateral_lookup
    entry = F.struct("collateral_symbol", F.lower("address").alias("collateral_address"))
    whole = lookup.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("address", entry)))).alias("value"))  # the file is one object
    whole.write.text(folder)
    return read_collateral(spark, folder)


JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (appended_trades, streamed_cube, compacted_trades, sunk_trades, tagged_trades, looked_up_collateral)
}

_SUMS = {"won": "won", "contracts": "contracts", "sp": "price", "se": "e", "se2": "e*e", "cp": "contracts*price", "ce": "contracts*e", "cw": "contracts*won"}
#: bodies of DuckDB SQL over the stand-in views
JOBS_SQL = {
    "appended_trades": f"""
        select md5(concat_ws('|', ticker, count, yes_price, no_price, taker_side, strftime(created_time, '%Y-%m-%dT%H:%M:%SZ'))) as trade_id, *
        from (select distinct cast(ticker as varchar) as ticker, count, yes_price, no_price, taker_side, created_time from book_trades )""",
    "streamed_cube": f"""
        select cast(created_time as date) as day, category, role, side, price, count(*) as n,
            {", ".join(f"cast(sum({x}) as bigint) as {n}" for n, x in _SUMS.items())} from legs group by 1, 2, 3, 4, 5""",
    "compacted_trades": "select * from book_trades ",
    "sunk_trades": "select b.*, sink from book_trades b, (values ('parquet'), ('csv'), ('json')) v(sink)",
    "tagged_trades": "select *, '0xc0' as contract, true as fetched from chain_trades ",
    "looked_up_collateral": "select address, collateral_symbol, lower(address) as collateral_address from collateral_lookup ",
}
