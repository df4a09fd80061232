"""The tables of both venue shapes, their schemas, and stand-ins derived from the test tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "book_trades": """trade_id string, ticker string, count bigint, yes_price int, no_price int, taker_side string,
        created_time timestamp_ntz, _fetched_at timestamp_ntz""",
    "book_markets": """ticker string, event_ticker string, market_type string, title string, yes_sub_title string, no_sub_title string,
        status string, yes_bid int, yes_ask int, no_bid int, no_ask int, last_price int, volume bigint, volume_24h bigint, result string,
        created_time timestamp_ntz, open_time timestamp_ntz, close_time timestamp_ntz, open_interest bigint, _fetched_at timestamp_ntz""",
    "chain_trades": """block_number bigint, transaction_hash string, log_index bigint, order_hash string, maker string, taker string,
        maker_asset_id string, taker_asset_id string, maker_amount bigint, taker_amount bigint, fee bigint, timestamp bigint,
        _fetched_at timestamp_ntz, _contract string""",
    "chain_legacy_trades": """block_number bigint, transaction_hash string, log_index bigint, fpmm_address string, trader string,
        amount string, fee_amount string, outcome_index bigint, outcome_tokens string, is_buy boolean, timestamp bigint,
        _fetched_at timestamp_ntz""",
    "chain_markets": """id string, condition_id string, question string, slug string, outcomes string, outcome_prices string,
        clob_token_ids string, volume double, liquidity double, active boolean, closed boolean, end_date timestamp_ntz,
        created_at timestamp_ntz, market_maker_address string, _fetched_at timestamp_ntz""",
    "blocks": "block_number bigint, timestamp string",
    "collateral_lookup": "address string, collateral_symbol string",
}


@dataclass
class Tables:
    book_trades: DataFrame
    book_markets: DataFrame
    chain_trades: DataFrame
    chain_legacy_trades: DataFrame
    chain_markets: DataFrame
    blocks: DataFrame
    collateral_lookup: DataFrame


def read_tables(spark: SparkSession, root: str) -> Tables:
    """Parquet folders under ``root``, one for each table, read with fixed schemas."""
    return Tables(**{f.name: spark.read.schema(SCHEMAS[f.name]).parquet(f"{root}/{f.name}") for f in fields(Tables)})


def read_collateral(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object file, address to properties, as rows."""
    text = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", "map<string,struct<collateral_symbol:string,collateral_address:string>>"))
    return text.select(entries.alias("address", "of")).select("address", "of.collateral_symbol", "of.collateral_address")


_PRICE = "(l_partkey*31 + l_suppkey*17 + l_linenumber*7) % 99"
_MINUTES = "(l_partkey*60 + l_suppkey) % 1440"
#: the stand-ins as SQL; {minutes} and {k} differ between engines
STAND_INS = {
    "book_trades": f"""select cast(l_orderkey as bigint) as ticker, cast(l_quantity as bigint) as count, cast(1 + {_PRICE} as int) as yes_price, cast(99 - {_PRICE} as int) as no_price, case when l_linestatus = 'O' then 'yes' else 'no' end as taker_side, {{minutes}} as created_time
        from lineitem""",
    "book_markets": """select cast(o_orderkey as bigint) as ticker, case o_custkey % 8 when 0 then 'NFLGAME-25' when 1 then 'INXD-24' when 2 then 'BTCD-24' when 3 then 'PRES-24' when 4 then 'HIGHNY-24' when 5 then 'zzz-1' when 6 then '' else null end as event_ticker, case o_orderstatus when 'F' then 'finalized' when 'P' then 'closed' else 'open' end as status, case when o_orderstatus = 'O' then '' when (o_orderkey*7 + o_custkey) % 2 = 0 then 'yes' else 'no' end as result, cast(floor(o_totalprice) as bigint) as volume
        from orders""",
    "chain_trades": """select event_id*130 as block_number, case when event_id % 2 = 0 then '0' else 'tok_' || user_id % 50 end as maker_asset_id, case when event_id % 2 = 0 then 'tok_' || user_id % 50 else '0' end as taker_asset_id, case when event_id % 2 = 0 then {k}*10000 else 1000000 end as maker_amount, case when event_id % 2 = 0 then 1000000 else {k}*10000 end as taker_amount
        from events where event_type <> 'purchase'""",
    "chain_legacy_trades": """select event_id*130 as block_number, '0xF' || user_id % 25 as fpmm_address, cast({k}*10000 as {string}) as amount, '1000000' as outcome_tokens, event_id % 2 as outcome_index
        from events where event_type = 'purchase'""",
    "chain_markets": """select cast(n_nationkey as {string}) as id, '["tok_' || 2*n_nationkey || '","tok_' || (2*n_nationkey + 1) || '"]' as clob_token_ids, case n_nationkey % 4 when 0 then '["1","0"]' when 1 then '[0.0, 1.0]' when 2 then '["0.5","0.5"]' else 'oops' end as outcome_prices, '0xf' || n_nationkey as market_maker_address, n_nationkey % 5 <> 0 as closed
        from nation""",
    "blocks": "select event_id*130 as block_number, cast(ts as {string}) as timestamp from events",
    "collateral_lookup": """select '0xf' || n_nationkey as address, case when n_nationkey % 3 = 0 then 'USDT' else 'USDC' end as collateral_symbol
        from nation""",
}
SPARK = {"minutes": f"""l_shipdate + make_dt_interval(0, 0, cast({_MINUTES} as int), 0)""", "k": """cast(get_json_object(props,
    '$.k') as bigint)""", "string": "string"}
DUCKDB = {"minutes": f"l_shipdate + to_minutes({_MINUTES})", "k": "cast(json_extract_string(props, '$.k') as bigint)", "string": "varchar"}


def stand_in_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables as views over the driver's test tables."""
    found = {}
    for name, sql in STAND_INS.items():
        base = sql.split(" from ")[1].split()[0]
        found[name] = spark.sql(sql.format(**SPARK).replace(f" from {base}", " from {base}"), base=spark.read.parquet(f"{sf_dir}/{base}.parquet"))
    return Tables(**found)
