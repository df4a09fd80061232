"""DuckDB SQL for the ingest jobs: what the landed records say, taken from the tables they were derived from."""

from __future__ import annotations

from .sources.landed import STAND_INS


def _raw(kind: str) -> str:
    return f"({STAND_INS[kind].format(string='varchar')})"


def _time(col: str) -> str:
    text = f"replace({col}, '+00:00', 'Z')"
    fraction = f"rpad(substr(regexp_extract({text}, '\\.([0-9]+)Z', 1), 1, 6), 6, '0')"
    return f"try_cast(concat(regexp_extract({text}, '^([^.Z]*)', 1), '.', {fraction}) as timestamp) as {col}"


_K = "cast(json_extract_string(props, '$.k') as bigint)"
_N = "case when event_id % 9 = 0 then 0 else 1000000 end"

INGEST_SQL = {
    "ingest_book_trades": f"""select trade_id, ticker, count, yes_price, no_price, taker_side, {_time('created_time')}
        from {_raw('book_trades')} where taker_side is not null""",
    "ingest_book_markets": f"""select ticker, event_ticker, status, '' as market_type, coalesce(title, '') as title, '' as yes_sub_title,
        '' as no_sub_title, coalesce(result, '') as result, """
    + ", ".join(f"cast({c} as int) as {c}" for c in ("yes_bid", "yes_ask", "no_bid", "no_ask", "last_price"))
    + f""", coalesce(volume, 0) as volume, cast(0 as bigint) as volume_24h, cast(0 as bigint) as open_interest, {_time('created_time')}, {_time('open_time')}, {_time('close_time')}
        from {_raw('book_markets')} where ticker is not null""",
    "ingest_chain_markets": f"""select id, "conditionId" as condition_id, question, slug, outcomes, "outcomePrices" as outcome_prices, "clobTokenIds" as clob_token_ids, coalesce(try_cast(volume as double), 0.0) as volume, cast(liquidity as double) as liquidity,
    coalesce(active = 'true', false) as active, closed = 'true' as closed, try_cast(replace(replace("endDate", 'T', ' '), 'Z', '') as timestamp) as end_date, timestamp '2024-01-02 03:04:05' as created_at, "marketMakerAddress" as market_maker_address from {_raw("chain_markets")}""",
    "ingest_data_api_trades": f"""select coalesce("conditionId", market, '') as condition_id, coalesce(side, '') as side, round(coalesce(try_cast(size as double), 0.0), 6) as size, round(coalesce(try_cast(price as double), 0.0), 6) as price, coalesce(outcome, '') as outcome, cast(timestamp as bigint) as timestamp
        from {_raw("data_api_trades")}""",
    "decode_order_filled": f"""select event_id*130 as block_number, concat('0x', event_id) as transaction_hash, user_id as log_index, printf('0x%064x', event_id) as order_hash, printf('0x%040x', user_id) as maker, printf('0x%040x', event_id + user_id) as taker,
    case when event_id % 2 = 0 then '0' else cast(cast(user_id + 1 as hugeint)*18446744073709551616 as varchar) end as maker_asset_id, cast(event_id as varchar) as taker_asset_id, {_K}*10000 as maker_amount, cast(1000000 as bigint) as taker_amount, event_id % 7 as fee
    from events where event_id % 11 > 0 and event_id % 37 > 0""",
    "decode_amm_trades": f"""select event_id*130 as block_number, concat('0x', event_id) as transaction_hash, user_id as log_index, concat('0xab', user_id % 25) as fpmm_address, printf('0x%040x', user_id) as trader, event_id % 3 = 0 as is_buy,
    cast({_K}*10000 as varchar) as amount, cast(event_id % 7 as varchar) as fee_amount, event_id % 2 as outcome_index, cast({_N} as varchar) as outcome_tokens, round(case when event_id % 9 = 0 then 0.0 else {_K}/100.0 end, 6) as price, ({_N})/1e6 as size, round({_K}/100.0, 6) as volume
    from events where event_id % 3 < 2""",
    "dedup_append": "select event_id, user_id, event_type, value from events where event_id % 3 > 0",
}
