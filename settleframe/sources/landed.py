"""Landed raw records: their schemas, how JSON lines become rows, and stand-ins that Spark derives from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest

#: schemas of raw records; a missing key is null
RAW = {
    "book_trades": "trade_id string, ticker string, count bigint, yes_price int, no_price int, taker_side string, created_time string",
    "book_markets": """ticker string, event_ticker string, market_type string, title string, yes_sub_title string, no_sub_title string,
        status string, yes_bid bigint, yes_ask bigint, no_bid bigint, no_ask bigint, last_price bigint, volume bigint, volume_24h bigint,
        result string, created_time string, open_time string, close_time string, open_interest bigint""",
    "chain_markets": """id string, conditionId string, question string, slug string, outcomes string, outcomePrices string,
        clobTokenIds string, volume string, liquidity string, active string, closed string, endDate string, createdAt string,
        marketMakerAddress string""",
    "data_api_trades": "conditionId string, market string, side string, size string, price string, outcome string, timestamp string",
}


def read_landed(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """JSON lines of one kind of record. Numbers of the chain venue may be strings, so they stay text until ``ingest``."""
    return spark.read.schema(RAW[kind]).json(path)


def parsed(lines: DataFrame, kind: str) -> DataFrame:
    """The same from a column ``value`` of JSON text; a line that isn't JSON is a row of nulls.

    A generator makes the fields, so that later filters don't parse the line again for each field that they ask for.
    """
    return lines.select(F.inline(F.array(F.from_json("value", RAW[kind]))))


_PRICE = "(l_partkey*31 + l_suppkey*17 + l_linenumber*7) % 99"
#: raw records as SQL that both engines read; {string} is the type of text
STAND_INS = {
    "book_trades": f"""select concat(l_orderkey, '-', l_linenumber, '-', l_partkey) as trade_id, concat('T', l_orderkey) as ticker, cast(l_quantity as bigint) as count, cast(1 + {_PRICE} as int) as yes_price, cast(99 - {_PRICE} as int) as no_price, case when l_partkey % 20 = 0 then null when l_linestatus = 'O' then 'yes' else 'no' end as taker_side, concat(substr(cast(l_shipdate as {{string}}), 1, 10), 'T10:20:30.', substr('123456789', 1, 1 + l_linenumber), 'Z') as created_time
        from lineitem""",
    "book_markets": """select case when o_custkey % 40 > 0 then concat('M', o_orderkey) end as ticker, concat('E', o_custkey) as event_ticker, o_orderstatus as status, case when o_custkey % 5 > 0 then o_orderpriority end as title, case when o_orderstatus <> 'O' then 'yes' end as result, o_orderkey % 100 as yes_bid, o_orderkey % 99 as yes_ask, o_orderkey % 98 as no_bid, o_orderkey % 97 as no_ask, o_orderkey % 96 as last_price, case when o_custkey % 3 > 0 then cast(floor(o_totalprice) as bigint) end as volume, concat(substr(cast(o_orderdate as {string}), 1, 10), 'T01:02:03Z') as created_time, case when o_orderkey % 2 = 0 then '' else concat(substr(cast(o_orderdate as {string}), 1, 10), 'T04:05:06.5Z') end as open_time, case when o_orderkey % 3 = 0 then concat(substr(cast(o_orderdate as {string}), 1, 10), 'T07:08:09.1234567+00:00') end as close_time
        from orders""",
    "chain_markets": """select cast(p_partkey as {string}) as id, concat('0xc', p_partkey) as conditionId, p_name as question, p_brand as slug, '["Yes","No"]' as outcomes, case when p_size % 2 = 0 then '["1","0"]' else '["0","1"]' end as outcomePrices, concat('["', p_partkey, '","', p_partkey + 1, '"]') as clobTokenIds, case p_partkey % 3 when 0 then concat(p_size, '.5') when 1 then 'n/a' end as volume, cast(p_size as {string}) as liquidity, case when p_partkey % 4 = 0 then 'true' end as active, case when p_partkey % 5 = 0 then 'false' else 'true' end as closed, case when p_partkey % 2 = 0 then 'soon' else '2024-05-06T07:08:09.12Z' end as endDate, '2024-01-02T03:04:05Z' as createdAt, concat('0xF', p_partkey) as marketMakerAddress
        from part""",
    "data_api_trades": """select case when event_id % 2 = 0 then concat('0xm', user_id % 25) end as conditionId, case when event_id % 3 = 0 then concat('m', user_id) end as market, case when event_id % 4 > 0 then 'BUY' end as side, case when event_id % 5 > 0 then concat(user_id, '.25') end as size, case when event_id % 7 = 0 then '-' else concat('0.', user_id) end as price, case when user_id % 2 = 0 then 'Yes' end as outcome, cast(event_id as {string}) as timestamp
        from events""",
}
#: fixed values of the stand-ins: topics of AMM buys and sells
AMM_BUY, AMM_SELL = "0xb1", "0x5e"
_K = "cast(get_json_object(props, '$.k') as bigint)"


def _word(x: str) -> str:
    return f"lpad(lower(hex({x})), 64, '0')"


_ORDER_LOGS = f"""select event_id*130 as block_number, concat('0x', event_id) as transaction_hash, user_id as log_index,
array(if(event_id % 11 = 0, '0x00', '{ingest.ORDER_FILLED}'), concat('0x', {_word("event_id")}), concat('0x', {_word("user_id")}), concat('0x', {_word("event_id + user_id")})) as topics,
substr(concat('0x', if(event_id % 2 = 0, {_word("0L")}, lpad(concat(hex(user_id + 1), repeat('0', 16)), 64, '0')), {_word("event_id")}, {_word(_K + "*10000")}, {_word("1000000L")}, {_word("event_id % 7")}), 1, if(event_id % 37 = 0, 100, 322)) as data from {{base}}"""
_AMM_LOGS = f"""select event_id*130 as block_number, concat('0x', event_id) as transaction_hash, user_id as log_index, concat('0xAB', user_id % 25) as address,
array(case event_id % 3 when 0 then '{AMM_BUY}' when 1 then '{AMM_SELL}' else '0x00' end, concat('0x', {_word("user_id")}), concat('0x', {_word("event_id % 2")})) as topics,
concat('0x', {_word(_K + "*10000")}, {_word("event_id % 7")}, {_word("if(event_id % 9 = 0, 0L, 1000000L)")}) as data from {{base}}"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed_stand_in(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """JSON lines (value) of a kind of record; null fields are missing keys."""
    sql = STAND_INS[kind].format(string="string")
    base = sql.rsplit(" from ", 1)[1]
    rows = spark.sql(sql.rsplit(" from ", 1)[0] + " from {base}", base=_table(spark, sf_dir, base))
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def _typed(kind: str, job):
    return lambda spark, sf_dir: job(parsed(landed_stand_in(spark, sf_dir, kind), kind))


def _logs(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Logs that are made of events. A generator hands them on, so that later steps don't make them again for each use of a field."""
    return spark.sql(sql, base=_table(spark, sf_dir, "events")).select(F.inline(F.array(F.struct("*"))))


def _order_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.decode_order_filled(_logs(spark, sf_dir, _ORDER_LOGS))


def _amm_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.decode_amm_trades(_logs(spark, sf_dir, _AMM_LOGS), AMM_BUY, AMM_SELL)


def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events is stored; all arrive, a fifth of them twice, the second time with another value."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    again = events.where("event_id % 5 = 0").withColumn("value", F.col("value") + 1)
    return ingest.dedup_append(events.where("event_id % 3 = 0"), events.unionByName(again), ["event_id"], ["value"])


JOBS = {
    "ingest_book_trades": _typed("book_trades", ingest.ingest_book_trades),
    "ingest_book_markets": _typed("book_markets", ingest.ingest_book_markets),
    "ingest_chain_markets": _typed("chain_markets", ingest.ingest_chain_markets),
    "ingest_data_api_trades": _typed("data_api_trades", ingest.ingest_data_api_trades),
    "decode_order_filled": _order_filled,
    "decode_amm_trades": _amm_trades,
    "dedup_append": _dedup,
}
