"""DuckDB SQL for the registered analyses, over the same stand-ins for the test tables."""

from __future__ import annotations

from .functions.columns import BUCKETS
from .operators.categories import SAMPLE_RULES
from .operators.chain import BLOCK_BUCKET
from .oracle_ingest import INGEST_SQL
from .oracle_parts import B, R, exact, student, two_sided, upper  # noqa: F401
from .oracle_tests import TESTS_SQL
from .round_trips import JOBS_SQL
from .sources.tables import DUCKDB, STAND_INS

_VIEWS = {name: sql.format(**DUCKDB) for name, sql in STAND_INS.items()}
_CATEGORY = """case when coalesce(regexp_extract(event_ticker, '^([A-Z0-9]+)', 1),
    '') = '' then 'independent' else regexp_extract(event_ticker, '^([A-Z0-9]+)', 1) end"""
_VIEWS |= {
    "resolved": f"select ticker, result, status, {_CATEGORY} as category from book_markets where result in ('yes', 'no')",
    "loose_legs": """select t.ticker, r.status, r.category, t.created_time, t.count as contracts, x.role, x.side, case when x.side = 'yes' then yes_price else no_price end as price, cast(x.side = r.result as bigint) as won, r.result
        from (select *, unnest([{'role': 'taker', 'side': taker_side}, {'role': 'maker', 'side': case when taker_side = 'yes' then 'no' else 'yes' end}]) as x
        from book_trades) t join resolved r on t.ticker = r.ticker""",
    "legs": "select *, 100*won - price as e, date_trunc('quarter', created_time) as quarter from loose_legs where status = 'finalized'",
    "rules": """select *
        from (values """ + ", ".join(f"({k}, '{p}', '{g}', '{m}', '{s}')" for k, (p, g, m, s) in enumerate(SAMPLE_RULES)) + ') v(ordinal, pattern, "group", mid, sub)',
    "classes": """select c.category, coalesce(min_by(r."group", r.ordinal), 'Other') as "group", coalesce(min_by(r.mid, r.ordinal), 'Other') as mid, coalesce(min_by(r.sub, r.ordinal), c.category) as sub
        from (select distinct """ + _CATEGORY + """ as category from book_markets) c left
        join rules r on contains(upper(c.category), r.pattern) group by c.category""",
    "volumes": f'select k.*, v.volume, v.markets from (select {_CATEGORY} as category, cast(sum(volume) as bigint) as volume, count(*) as markets from book_markets group by 1) v join classes k on v.category = k.category',
    "answers": """select id, market_maker_address, clob_token_ids, try_cast(json_extract_string(outcome_prices, '$[0]') as double) as a, try_cast(json_extract_string(outcome_prices, '$[1]') as double) as b
        from chain_markets where closed and json_valid(outcome_prices) and json_array_length(outcome_prices) = 2""",
    "winners": "select *, case when a > 0.99 then 0 else 1 end as winner from answers where (a > 0.99 and b < 0.01) or (a < 0.01 and b > 0.99)",
    "resolution": """select 'token' as kind, json_extract_string(clob_token_ids, '$[' || o || ']') as key, -1 as outcome, cast(o = winner as bigint) as won
        from winners, (values (0), (1)) v(o) union all select 'amm', lower(market_maker_address), o, cast(o = winner as bigint)
        from winners, (values (0), (1)) v(o)""",
    "swaps": """select 'token' as kind, block_number, case when maker_asset_id = '0' then taker_asset_id else maker_asset_id end as key, -1 as outcome, cast(case when maker_asset_id = '0' then maker_amount else taker_amount end as double) as usd, cast(case when maker_asset_id = '0' then taker_amount else maker_amount end as double) as tokens
        from chain_trades union all
        select 'amm', block_number, lower(fpmm_address), outcome_index, cast(amount as double), cast(outcome_tokens as double)
        from chain_legacy_trades where lower(fpmm_address) in (select lower(address) from collateral_lookup
        where collateral_symbol = 'USDC')""",
    "priced": """select s.block_number, cast(case when o = 0 then round(100*usd/tokens) else round(100 - 100*usd/tokens) end as int) as price, case when o = 0 then won else 1 - won end as won
        from swaps s join resolution r on s.kind = r.kind and s.key = r.key and s.outcome = r.outcome, (values (0), (1)) v(o)
        where usd > 0 and tokens > 0""",
    "chain_legs": "select * from priced where price between 1 and 99",
    "times": f"select block_number // {BLOCK_BUCKET} as bucket, min_by(cast(timestamp as timestamp), block_number) as ts from blocks group by 1",
}


def _sql(body: str) -> str:
    """The body behind the views that it needs, in order."""
    views = {name: " ".join(sql.split()) for name, sql in _VIEWS.items()}
    body = " ".join(body.split())
    needed, text = [], body
    for name in reversed(list(views)):
        if any(f" {name}{end}" in f" {text} " for end in (" ", ")", ",")):
            needed.insert(0, name)
            text += " " + views[name]
    return "with " + ", ".join(f"{n} as ({views[n]})" for n in needed) + " " + body


_VAR = lambda kind: f"(case when count(*) > 1 or '{kind}' = 'pop' then var_{kind}(e/100.0) end)"


def _win(where: str = "true", source: str = "legs") -> str:
    return f"""select price, count(*) as total_trades, {B('sum(won)')} as wins, {R('100.0*sum(won)/count(*)')} as win_rate from {source}
        where {where} group by price"""


def _role_sums(r: str) -> str:
    return f"{B(f'''count(*) filter (role = '{r}')''')} as {r}_trades, {B(f'''coalesce(sum(won) filter (role = '{r}'), 0)''')} as {r}_wins"


def _mispricing() -> str:
    who = ("taker", "maker", "combined")
    rates = """, """.join(f"""{R(f'100.0*{w}_wins/{w}_trades')} as {w}_win_rate,
        {R(f'100.0*{w}_wins/{w}_trades - price')} as {w}_mispricing_pp,
        {R(f'(100.0*{w}_wins/{w}_trades - price)/price*100')} as {w}_mispricing_pct""" for w in who)
    return f"""select *, cast(price as double) as implied_probability, {rates}
        from (select price, {_role_sums('taker')}, {_role_sums('maker')}, count(*) as combined_trades, {B('sum(won)')} as combined_wins
        from legs where price between 1 and 99 group by price) where taker_trades > 0 and maker_trades > 0"""


def _returns_by_role() -> str:
    exact, cols = [], []
    for r in ("taker", "maker"):
        for name, x in (("win_rate", f"{r}.win"), ("expected", "taker.price/100.0"), ("excess", f"{r}.excess"), ("var", f"{r}.var"), ("volume_usd", f"{r}.vol"), ("pnl", f"{r}.pnl"), ("se", f"sqrt({r}.var/{r}.n)"), ("z", f"""{r}.excess/nullif(sqrt({r}.var/{r}.n),
            0)""")):
            exact.append(f"{x} as {r}_{name}")
            cols.append(f"{R(f'{r}_{name}')} as {r}_{name}")
        exact.append(f"{r}.n as {r}_n")
        cols += [f"{r}_n", f"{R(two_sided(f'{r}_z'))} as {r}_p"]
    inner = f"""select taker.price, {', '.join(exact)} from m taker join m maker on taker.price = maker.price
        where taker.role = 'taker' and maker.role = 'maker'"""
    return f"select price, {', '.join(cols)} from ({inner})"


_M = """(select role, price, avg(won) as win, avg(e)/100 as excess, var_pop(e/100.0) as var, count(*) as n, sum(contracts*price)/100.0 as vol, sum(contracts*e)/100.0 as pnl
    from legs where price between 1 and 99 group by role, price)"""


def _sides(cols: str) -> str:
    by = """,
        """.join(f"{B(f'''sum({x}) filter (side = '{s}')''')} as {s}_{n}" for s in ("yes", "no") for n, x in (("n", "1"), ("won", "won"), ("contracts", "contracts"), ("se", "e"), ("cp", "contracts*price"), ("cw", "contracts*won")))
    return f"select price, {cols} from (select price, {by} from legs where role = 'maker' and price between 1 and 99 group by price)"


def _ev() -> str:
    rate = {s: f"({s}_w*1.0/nullif({s}_contracts, 0))" for s in ("yes", "no")}
    best = [f"coalesce(100.0*{rate[s]} - g.price, -100.0)" for s in ("yes", "no")]
    by = """select price, sum(count) filter (side = 'yes') as yes_contracts, coalesce(sum(count) filter (side = 'yes' and result = 'yes'), 0) as yes_w, sum(count) filter (side = 'no') as no_contracts, coalesce(sum(count) filter (side = 'no' and result = 'no'), 0) as no_w
        from (select count, result, s as side, case when s = 'yes' then yes_price else no_price end as price from book_trades t
        join resolved r on t.ticker = r.ticker, (values ('yes'), ('no')) v(s)) group by price"""
    cols = """, """.join(f"""{B(f'{s}_contracts')} as {s}_contracts, {R(rate[s])} as {s}_win_rate,
        {R(f'100.0*{rate[s]} - g.price')} as {s}_ev""" for s in rate)
    return f"""select cast(g.price as int) as price, {cols}, {R('g.price/100.0')} as implied_prob, {R(f'greatest({best[0]}, {best[1]})')} as best_ev, case when {best[0]} > {best[1]} then 'YES' else 'NO' end as best_bet
        from range(1, 100) g(price) left join ({by}) b on g.price = b.price"""


def _yes_no() -> str:
    names = [(r, s) for r in ("taker", "maker") for s in ("yes", "no")]
    sums = ", ".join(f"{B(f'''coalesce(sum(contracts) filter (role = '{r}' and side = '{s}'), 0)''')} as {r}_{s}" for r, s in names)
    rows = """select count as contracts, role, side, case when side = 'yes' then yes_price else no_price end as price
        from (select *, r as role, case when (r = 'taker') = (taker_side = 'yes') then 'yes' else 'no' end as side
        from book_trades, (values ('taker'), ('maker')) v(r))"""
    return f"""select *, {', '.join(f'{R(f'100.0*{r}_{s}/total')} as {r}_{s}_pct' for r, s in names)}
        from (select price, {sums}, {B('sum(contracts)')} as total from ({rows}) where price between 1 and 99 group by price)"""


_SIZE = "contracts*price/100.0"
_TAKER_STATS = f"""{R('avg(won)')} as win_rate, {{expected}}, {R('avg(e)/100')} as excess, {R(_VAR('samp'))} as var,
    {{rest}} {R(f'sum({_SIZE})')} as volume, count(*) as n, {R(f'sqrt({_VAR('samp')}/count(*))')} as se,
    {R(f'avg(e)/100 - 1.96*sqrt({_VAR('samp')}/count(*))')} as ci_low, {R(f'avg(e)/100 + 1.96*sqrt({_VAR('samp')}/count(*))')} as ci_high"""
_BIN = f"cast(floor(log10(greatest({_SIZE}, 0.01))*4) as int)"


def _gap(least: int) -> str:
    by = f"""select quarter, role, avg(e) as x, count(*) as n, sum(contracts*price)/100.0 as v, sqrt(var_pop(e)/count(*)) as se from legs
        group by 1, 2 having count(*) >= {least}"""
    cols = "".join(f""", {R(f'{r}.x')} as {r}_excess_pp, {r}.n as {r}_n, {R(f'{r}.v')} as {r}_volume, {R(f'{r}.se')} as {r}_se_pp,
        {R(f'{r}.x - 1.96*{r}.se')} as {r}_ci_low, {R(f'{r}.x + 1.96*{r}.se')} as {r}_ci_high""" for r in ("taker", "maker"))
    return f"""select taker.quarter{cols}, {R('maker.x - taker.x')} as gap_pp from ({by}) taker
        join ({by}) maker on taker.quarter = maker.quarter where taker.role = 'taker' and maker.role = 'maker'"""


def _meta() -> str:
    one = lambda m, x, f="format('{:,}', value)": f"select '{m}' as metric, value, {f} as formatted from (select {B(x)} as value)"
    trades, volume = "(select count(*) from book_trades)", "(select sum(count) from book_trades)"
    return " union all ".join([
        one("num_trades", trades), one("total_volume", volume), one("num_markets", """(select count(*)
            from book_markets)"""), one("num_events", """(select count(distinct event_ticker) from book_markets)"""),
        one("num_tickers", """(select count(distinct ticker)
            from book_trades)"""), one("num_trades_millions", trades, "printf('%.1f million', value/1e6)"), one("total_volume_billions", volume, "printf('$%.2f billion', value/1e9)"),
    ])


def _calibration(least: int) -> str:
    return f"""select week, {R('avg(abs(100.0*w/n - price))')} as mean_abs_deviation, {B('sum(n)')} as cumulative_legs from (
        select k.week, g.price, count(*) as n, sum(g.won) as w from (select unnest(generate_series(lo + to_days(cast((7 - dayofweek(lo)) % 7 as int)), hi, interval 7 days)) as week from (select min(created_time) as lo, max(created_time) as hi from loose_legs where price between 1 and 99)) k
        join (select price, won, created_time from loose_legs where price between 1 and 99) g on g.created_time <= k.week group by 1, 2) group by week having sum(n) >= {least}"""


def _category_returns() -> str:
    by = """select category, role, avg(e)/100 as x, sum(contracts) as c, count(*) as n, sum(contracts*price)/100.0 as v, sum(contracts*e)/100.0 as pnl
        from legs group by 1, 2"""
    excess = {r: f"100*sum({r}.x*{r}.c)/sum({r}.c)" for r in ("taker", "maker")}
    cols = "".join(f""", {R(excess[r])} as {r}_excess_pp, {B(f'sum({r}.n)')} as {r}_n, {R(f'sum({r}.v)')} as {r}_volume,
        {R(f'sum({r}.pnl)')} as {r}_pnl""" for r in excess)
    return f"""select k."group"{cols}, {R(f"{excess['maker']} - {excess['taker']}")} as gap_pp from ({by}) taker
        join ({by}) maker on taker.category = maker.category join classes k on k.category = taker.category
        where taker.role = 'taker' and maker.role = 'maker' group by k."group" """


_HIERARCHY = f"""select 1 as level, "group", null::varchar as mid, null::varchar as sub, {B('sum(volume)')} as volume from volumes group by "group"
    union all select 2, "group", mid, null, volume from kept_mid union all select 3, "group", mid, sub, volume from (
    select *, count(*) over (partition by "group", mid) as k from (select v.*, sum(volume) over (partition by "group", mid) as p from (select "group", mid, sub, {B('sum(volume)')} as volume from volumes where ("group", mid) in (select ("group", mid) from kept_mid) group by all) v) where volume >= 0.01*p) where k > 1 or sub <> mid"""
_KEPT_MID = f"""(select "group", mid, volume from (select *, count(*) over (partition by "group") as k
    from (select v.*, sum(volume) over (partition by "group") as p from (select "group", mid, {B('sum(volume)')} as volume from volumes
    group by all) v) where volume >= 0.01*p) where k > 1 or mid <> "group")"""

_DAYS = f"""select 'book' as venue, cast(created_time as date) as day, price, won from legs where price between 1 and 99 union all
    select 'chain', cast(ts as date), price, won from chain_legs c join times on c.block_number // {BLOCK_BUCKET} = times.bucket"""
_GRID = f"""(select * from (select v.venue, d.day, v.price, {B('sum(coalesce(b.n, 0)) over w')} as total, {B('sum(coalesce(b.w, 0)) over w')} as wins from (select distinct venue, price from by_day) v cross join (select distinct day from by_day) d
    left join by_day b on b.venue = v.venue and b.price = v.price and b.day = d.day window w as (partition by v.venue, v.price order by d.day)) where total > 0)"""
_KEPT = """(select day from (select day, row_number() over (order by day) as k from (select day, max(n) as n
    from (select venue, day, sum(total) as n from grid group by 1, 2) group by day) where n >= 1000) where (k - 1) % 2 = 0)"""


def _cross(body: str) -> str:
    return _sql(f"""select * from (with by_day as (select venue, day, price, count(*) as n, sum(won) as w from ({_DAYS})
        group by 1, 2, 3), grid as {_GRID}, kept_days as {_KEPT} {body})""")


_LONG = "price between 1 and 20"
_CHAIN_WIN = _win(source="chain_legs")

ORACLE_SQL: dict[str, str] = {
    "win_rate_by_price": _sql(_win()),
    "mispricing_by_price": _sql(_mispricing()),
    "maker_vs_taker_returns": _sql(f"select * from (with m as {_M} {_returns_by_role()})"),
    "maker_counterparty_excess": _sql(f"""select *
        from (with m as {_M}, both_ as (select t.price, t.excess as taker_excess, k.excess as maker_excess from m t
        join m k on t.price = k.price where t.role = 'taker' and k.role = 'maker')
        select a.price, {R('a.taker_excess')} as taker_excess, {R('coalesce(b.maker_excess, 0)')} as counterparty_excess from both_ a left
        join both_ b on b.price = 100 - a.price)"""),
    "maker_returns_by_direction": _sql(_sides(""", """.join(f"""{R(f'{s}_won*1.0/{s}_n')} as {s}_win_rate,
        {R(f'{s}_se/100.0/{s}_n')} as {s}_excess, {s}_n, {s}_contracts,
        {R(f'{s}_cp/100.0')} as {s}_volume""" for s in ("yes", "no")) + f""", {R('no_se/100.0/no_n - yes_se/100.0/yes_n')} as diff""")),
    "maker_win_rate_by_direction": _sql(_sides(f"""{R('price/100.0')} as implied_prob, """ + """,
        """.join(f"""{R(f'{s}_cw*1.0/{s}_contracts')} as {s}_win_rate, {R(f'{s}_cw*1.0/{s}_contracts - price/100.0')} as {s}_mispricing,
        {s}_n, {s}_contracts""" for s in ("yes", "no")))),
    "ev_yes_vs_no": _sql(_ev()),
    "yes_vs_no_by_price": _sql(_yes_no()),
    "trade_size_by_role": _sql(f"select role, count(*) as n, {R(f'avg({_SIZE})')} as mean, {R(f'median({_SIZE})')} as median, {R(f'stddev_pop({_SIZE})')} as std_pop, " + ", ".join(f"{R(f'quantile_cont(cast({_SIZE} as double), {q})')} as {n}" for q, n in ((0.25, "p25"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"))) + f""", {R('avg(contracts)')} as mean_contracts, {R('median(contracts)')} as median_contracts, {R(f'sum({_SIZE})')} as total
        from legs group by role"""),
    "win_rate_by_trade_size": _sql(f"""select {_BIN} as bin, {R(f'pow(10.0, {_BIN}/4.0)')} as size_bin, {_TAKER_STATS.format(expected=R('avg(price)/100') + ' as expected', rest='')}
        from legs where role = 'taker' group by {_BIN} having count(*) >= 10"""),
    "returns_by_hour": _sql(f"""select cast(hour(created_time) as int) as hour, {_TAKER_STATS.format(expected=R('avg(price)/100') + ' as avg_implied_prob', rest=B('sum(contracts)') + ' as contracts,')}
        from legs where role = 'taker' group by 1"""),
    "vwap_by_hour": _sql(f"""select cast(hour(created_time) as int) as hour, {R('sum(contracts*price)*1.0/sum(contracts)')} as vwap, {B('sum(contracts)')} as contracts, {R(f'sum({_SIZE})')} as volume, count(*) as n, {R('avg(price)')} as avg_price, {R('stddev_samp(price)')} as std, {R('stddev_samp(price)/sqrt(count(*))')} as se, {R('sum(contracts*price)*1.0/sum(contracts) - 1.96*stddev_samp(price)/sqrt(count(*))')} as ci_low, {R('sum(contracts*price)*1.0/sum(contracts) + 1.96*stddev_samp(price)/sqrt(count(*))')} as ci_high
        from legs where role = 'taker' group by 1"""),
    "volume_over_time": _sql(f"select date_trunc('quarter', created_time) as quarter, {B('sum(count)')} as volume from book_trades group by 1"),
    "longshot_volume_share": _sql(f"""select quarter, {R(f'sum({_SIZE}) filter ({_LONG})')} as longshot_volume, {B(f'sum(contracts) filter ({_LONG})')} as longshot_contracts, {B(f'count(*) filter ({_LONG})')} as longshot_n, {R(f'sum({_SIZE})')} as total_volume, {R(f'100*sum({_SIZE}) filter ({_LONG})/sum({_SIZE})')} as share_pct
        from legs where role = 'taker' group by quarter having count(*) filter ({_LONG}) > 0"""),
    "price_bucket_share_pivot": _sql("select quarter, " + ", ".join(f"{R(f'100*coalesce(sum({_SIZE}) filter (price between {b.rstrip("c").replace("-", " and ")}), 0)/sum({_SIZE})')} as p{b.rstrip('c').replace('-', '_')}" for b in BUCKETS) + f"""
        from legs where role = 'taker' group by quarter having sum({_SIZE}) >= 1000"""),
    "maker_taker_gap_over_time": _sql(_gap(100)),
    "meta_stats": _sql(_meta()),
    "calibration_deviation_over_time": _sql(_calibration(1000)),
    "position_moments": _sql("select quarter, category, role, side, price, count(*) as n, " + ", ".join(f"{B(f'sum({x})')} as {n}" for n, x in (("won", "won"), ("contracts", "contracts"), ("sp", "price"), ("se", "e"), ("se2", "e*e"), ("cp", "contracts*price"), ("ce", "contracts*e"), ("cw", "contracts*won"))) + """
        from legs group by quarter, category, role, side, price"""),
    "maker_taker_returns_by_category": _sql(_category_returns()),
    "market_types": _sql(f"""select "group", {B('sum(volume)')} as volume, {B('sum(markets)')} as markets, {R('100.0*sum(volume)/sum(sum(volume)) over ()')} as share_pct
        from volumes group by "group" """),
    "market_type_hierarchy": _sql(f"select * from (with kept_mid as {_KEPT_MID} {_HIERARCHY})"),
    "market_types_topn": _sql(f"""select "group", category, {B('sum(volume)')} as volume
        from (select "group", volume, k > 8 as rest, case when k <= 8 then category else "group" || ' Other' end as category
        from (select *, row_number() over (partition by "group" order by volume desc, category) as k from volumes ))
        group by "group", category, rest having not rest or sum(volume) > 0"""),
    "chain_market_resolution": _sql("select kind, key, cast(outcome as int) as outcome, won from resolution"),
    "chain_win_rate_by_price": _sql(_CHAIN_WIN),
    "chain_calibration_metrics": _sql(f"""select round(sum(w*pow(price/100.0 - 1, 2) + (n - w)*pow(price/100.0, 2))/sum(n), 4) + 0.0 as brier, round(-sum(w*ln(least(greatest(price/100.0, 1e-6), 1 - 1e-6)) + (n - w)*ln(1 - least(greatest(price/100.0, 1e-6), 1 - 1e-6)))/sum(n), 4) + 0.0 as log_loss, round(sum(n*abs(w*1.0/n - price/100.0))/sum(n), 4) + 0.0 as ece, {B('sum(n)')} as total_trades
        from (select price, count(*) as n, sum(won) as w from chain_legs group by price)"""),
    "chain_volume_over_time": _sql(f"""select date_trunc('quarter', ts) as quarter, {R('sum(v)/1e6')} as volume_usd
        from (select block_number // {BLOCK_BUCKET} as bucket, cast(amount as double) as v from chain_legacy_trades
        where lower(fpmm_address) in (select lower(address) from collateral_lookup where collateral_symbol = 'USDC') union all
        select block_number // {BLOCK_BUCKET}, case when maker_asset_id = '0' then taker_amount else maker_amount end from chain_trades
        where maker_asset_id = '0' or taker_asset_id = '0') x join times on times.bucket = x.bucket group by 1"""),
    "chain_trades_per_block": _sql(f"""select block_number, {B('count(*)')} as trades, cast(timestamp as timestamp) as ts
        from (select block_number from chain_trades union all select block_number from chain_legacy_trades )
        join blocks using (block_number) group by 1, 3"""),
    "cross_venue_calibration": _cross(f"""select venue, cast(day as timestamp) as day, price, total, wins, {R('100.0*wins/total')} as win_rate
        from grid join kept_days using (day)"""),
    "cross_venue_frames": _cross(f"""select venue, cast(day as timestamp) as day, price, {R('100.0*wins/total')} as win_rate, venue_total
        from (select *, {B('sum(total) over (partition by venue, day)')} as venue_total from grid join kept_days using (day))
        where venue_total >= 100"""),
    "pending_tickers": _sql("select distinct ticker from book_markets where volume >= 100 and ticker not in (select ticker from book_trades)"),
    "interpolate_blocks": _sql("""select b + k as block_number, cast(case when k = 0 then ts else ts + floor((nt - ts)*1.0*k/(nb - b)) end as bigint) as ts
        from (select b, ts, nb, nt, unnest(range(0, coalesce(nb - b, 1))) as k
        from (select b, ts, lead(b) over (order by b) as nb, lead(ts) over (order by b) as nt
        from (select block_number as b, cast(floor(epoch(cast(timestamp as timestamp))) as bigint) as ts from blocks)))"""),
    "chain_trade_measures": _sql(f"""select *, maker_asset_id = '0' as is_buy, {R('''case when (case when maker_asset_id = '0' then taker_amount else maker_amount end) > 0 then (case when maker_asset_id = '0' then maker_amount else taker_amount end)*1.0/nullif(case when maker_asset_id = '0' then taker_amount else maker_amount end, 0) else 0 end''')} as price, {R('''(case when maker_asset_id = '0' then taker_amount else maker_amount end)/1e6''')} as size, case when maker_asset_id = '0' then 'BUY' else 'SELL' end as side, case when maker_asset_id = '0' then taker_asset_id else maker_asset_id end as token
        from chain_trades"""),
    "volume_chart": _sql("""select concat(year(q), ' Q', quarter(q)) as quarter, round(v/1e3, 2) as volume_thousands
        from (select date_trunc('quarter', created_time) as q, sum(count) as v from book_trades group by 1)"""),
}
ORACLE_SQL |= INGEST_SQL
ORACLE_SQL |= {name: _sql(" ".join(body.split())) for name, body in (TESTS_SQL | JOBS_SQL).items()}
ORACLE_SQL |= {
    "top_groups": _sql(f"""select "group", {R('v')} as taker_volume, {R('t')} as taker_excess_pp, {R('k')} as maker_excess_pp
        from (select "group", taker_volume as v, taker_excess_pp as t, maker_excess_pp as k from ({exact(_category_returns())})
        order by 2 desc, 1 limit 8)"""),
    "iso_blocks": _sql("""select block_number, strftime(date_trunc('second', cast(timestamp as timestamp)), '%Y-%m-%dT%H:%M:%SZ') as timestamp
        from blocks"""),
    "volume_chart_short": _sql("""select concat('Q', quarter(q), ' ', chr(39), substr(cast(year(q) as varchar), 3)) as quarter, round(v/1e3, 2) as volume_thousands
        from (select date_trunc('quarter', created_time) as q, sum(count) as v from book_trades group by 1)"""),
}
ORACLE_SQL |= {
    f"cube_{name}": ORACLE_SQL[name]
    for name in ("win_rate_by_price", "maker_vs_taker_returns", "maker_returns_by_direction", "longshot_volume_share", "maker_taker_gap_over_time", "maker_taker_returns_by_category")
}
