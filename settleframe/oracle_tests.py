"""DuckDB SQL of the significance tests, trade by trade. Its prices, ranges and limits are spelled here, not taken from the operators."""

from __future__ import annotations

from .oracle_parts import R, exact, student, two_sided, upper

_PAID = """
    select case when taker_side = 'yes' then yes_price else no_price end as price,
        count*(case when taker_side = 'yes' then yes_price else no_price end) as taker,
        count*(case when taker_side = 'yes' then no_price else yes_price end) as maker
    from book_trades t join resolved r on t.ticker = r.ticker where r.status = 'finalized'
"""
_BINNED = f"""
    select least(10, greatest(1, cast(ceil((price - lo)/((hi - lo)/10.0)) as int))) as bin, taker, maker
    from ({_PAID}), (select min(price) as lo, max(price) as hi from ({_PAID}))
"""
_RANKED = f"""
    select bin, role, cents, rank() over w - 1 + (count(*) over (partition by bin, cents) + 1)/2.0 as rank,
        count(*) over (partition by bin, cents)*1.0 as tied
    from (select bin, 'maker' as role, maker as cents from ({_BINNED}) union all select bin, 'taker', taker from ({_BINNED}))
    window w as (partition by bin order by cents)
"""
_BY_BIN = f"""
    select bin, count(*)/2.0 as n, sum(rank) filter (role = 'maker') - (count(*)/2.0)*(count(*)/2.0 + 1)/2 as u, sum(tied*tied - 1) as ties,
        avg(cents) filter (role = 'maker')/100 as m1, avg(cents) filter (role = 'taker')/100 as m2,
        median(cents) filter (role = 'maker')/100 as d1, median(cents) filter (role = 'taker')/100 as d2
    from ({_RANKED}) group by bin having count(*) >= 200
"""
SIZES = f"""
    select bin, concat((bin - 1)*10 + 1, '-', bin*10, 'c') as price_bin, cast(n as bigint) as n_trades, {R('m1')} as maker_mean, {R('m2')} as taker_mean,
        {R('d1')} as maker_median, {R('d2')} as taker_median, {R('u')} as u, {R('1 - 2*u/(n*n)')} as rank_biserial, {R('z0')} as z,
        {R('m1/m2')} as mean_ratio, m1 > m2 as maker_larger, {R(upper('z0'))} as p
    from (select *, (u - n*n/2 - 0.5)/sqrt(n*n/12*(2*n + 1 - ties/(2*n*(2*n - 1)))) as z0 from ({_BY_BIN}))
"""

_AT_PRICES = """
    select price, side, sum(contracts)*1.0 as c, sum(contracts*won)*1.0 as w from legs
    where role = 'taker' and price in (1, 2, 3, 4, 5, 10, 15, 20, 25, 50, 75, 80, 85, 90, 95, 96, 97, 98, 99)
    group by 1, 2 having count(*) >= 100
"""
_BOTH_SIDES = f"""
    select y.price, y.c as yes_c, n.c as no_c, y.w/y.c as yes_rate, n.w/n.c as no_rate, (y.w + n.w)/(y.c + n.c) as pool
    from ({_AT_PRICES}) y join ({_AT_PRICES}) n on y.price = n.price where y.side = 'yes' and n.side = 'no'
"""
_EV = lambda s: f"(100*{s}_rate - price)/price*100"
ASYMMETRY = f"""
    select price, {R('yes_rate')} as yes_win_rate, {R('no_rate')} as no_win_rate, cast(yes_c as bigint) as yes_n, cast(no_c as bigint) as no_n,
        {R('z0')} as z, {R(_EV('yes'))} as yes_ev_pct, {R(_EV('no'))} as no_ev_pct, {R('(no_rate - yes_rate)*100')} as diff_pp,
        {R(f"{_EV('no')} - {_EV('yes')}")} as ev_diff, no_rate > yes_rate as no_better, {R(two_sided('z0'))} as p
    from (select *, case when se = 0 then 0 else (no_rate - yes_rate)/nullif(se, 0) end as z0
        from (select *, sqrt(pool*(1 - pool)*(1/yes_c + 1/no_c)) as se from ({_BOTH_SIDES})))
"""


def _welch(pairs: str) -> str:
    """``pairs`` has n1, mean1, var1 and n2, mean2, var2; adds t0, df0 and d0."""
    return f"""
    select *, (mean1 - mean2)/sqrt(var1/n1 + var2/n2) as t0,
        pow(var1/n1 + var2/n2, 2)/(pow(var1/n1, 2)/(n1 - 1) + pow(var2/n2, 2)/(n2 - 1)) as df0,
        (mean1 - mean2)/sqrt(((n1 - 1)*var1 + (n2 - 1)*var2)/(n1 + n2 - 2)) as d0
    from ({pairs})
"""


_TESTED = f"{R('t0')} as t, {R('df0')} as df, {R(student('t0', 'df0'))} as p, {R('d0')} as cohens_d"

_GROUPS = """
    select k."group", count(*)*1.0 as n, avg(e)/100 as mean, var_samp(e/100.0) as var
    from legs l join classes k on k.category = l.category where role = 'taker' group by 1 having count(*) >= 100
"""
_GROUP_PAIRS = f"""
    select o."group", b.n as n1, b.mean as mean1, b.var as var1, o.n as n2, o.mean as mean2, o.var as var2
    from ({_GROUPS}) b, ({_GROUPS}) o where b."group" = 'Finance' and o."group" <> 'Finance'
"""
GAPS = f"""
    select "group", {R('n1')} as base_n, {R('mean1')} as base_mean, {R('var1')} as base_var, {R('n2')} as other_n, {R('mean2')} as other_mean,
        {R('var2')} as other_var, {_TESTED}, {R('mean1 - mean2')} as diff
    from ({_welch(_GROUP_PAIRS)})
"""

_SPAN = """case when price between 1 and 10 then '1-10' when price between 11 and 25 then '11-25' when price between 26 and 50 then '26-50'
        when price between 51 and 75 then '51-75' when price between 76 and 90 then '76-90' when price between 91 and 99 then '91-99' end"""
_REPEATED = f"""
    select {_SPAN} as range, side, count(*) as legs, sum(w)*1.0 as n, sum(w*e)*1.0 as s, sum(w*e*e)*1.0 as s2, sum(contracts*e)*1.0/sum(contracts) as pp
    from (select *, least(contracts, 100) as w from legs where role = 'maker' and price between 1 and 99) group by 1, 2 having count(*) >= 100
"""
_MEANS = f"select range, side, legs, pp, n, s/n/100 as mean, (s2 - s*s/n)/(n - 1)/1e4 as var from ({_REPEATED})"
_RANGE_PAIRS = f"""
    select o.range, o.legs as no_legs, y.legs as yes_legs, o.pp as no_pp, y.pp as yes_pp,
        o.n as n1, o.mean as mean1, o.var as var1, y.n as n2, y.mean as mean2, y.var as var2
    from ({_MEANS}) o join ({_MEANS}) y on o.range = y.range where o.side = 'no' and y.side = 'yes'
"""
DIRECTION = f"""
    select range, {R('yes_pp')} as yes_excess_pp, {R('no_pp')} as no_excess_pp, {R('no_pp - yes_pp')} as diff_pp, no_pp > yes_pp as no_better,
        yes_legs as yes_n, no_legs as no_n, {_TESTED}
    from ({_welch(_RANGE_PAIRS)})
"""

_TAKEN = """
    select greatest(contracts*price, 1) as cents, e, log10(greatest(contracts*price, 1)/100.0) as x, e/100.0 as y from legs where role = 'taker'
"""
_RANKS = f"""
    select *, rank() over (order by cents) + (count(*) over (partition by cents) - 1)/2.0 as rx,
        rank() over (order by e) + (count(*) over (partition by e) - 1)/2.0 as ry from ({_TAKEN})
"""
_BINS = f"""
    select b, count(*)*1.0 as w, avg(x) as bx, avg(y) as by_
    from (select x, y, least(20, greatest(1, cast(ceil((x - lo)/((hi - lo)/20)) as int))) as b
        from ({_TAKEN}), (select min(x) as lo, max(x) as hi from ({_TAKEN}))) group by b
"""
_LINE = f"""
    select (sum(w)*sum(w*bx*by_) - sum(w*bx)*sum(w*by_))/(sum(w)*sum(w*bx*bx) - sum(w*bx)*sum(w*bx)) as slope,
        sum(w*bx) as sx, sum(w*by_) as sy, sum(w) as sw, sum(sqrt(w)*by_)/sum(sqrt(w)) as ybar from ({_BINS})
"""
_FITTED = f"""
    select slope, intercept, 1 - sum(sqrt(w)*pow(by_ - slope*bx - intercept, 2))/sum(sqrt(w)*pow(by_ - ybar, 2)) as r2
    from ({_BINS}), (select slope, (sy - slope*sx)/sw as intercept, ybar from ({_LINE})) group by slope, intercept
"""
_CORRELATED = f"""
    select n, p, s, n - 2.0 as df, p*sqrt((n - 2)/(1 - p*p)) as tp, s*sqrt((n - 2)/(1 - s*s)) as ts
    from (select count(*) as n, corr(x, y) as p, corr(rx, ry) as s from ({_RANKS}))
"""
PERFORMANCE = f"""
    select n, {R('p')} as pearson, {R('s')} as spearman, {R(student('tp', 'df'))} as pearson_p, {R(student('ts', 'df'))} as spearman_p,
        {R('slope')} as slope, {R('100*slope')} as slope_pp, {R('intercept')} as intercept, {R('r2')} as r2
    from ({_CORRELATED}), ({_FITTED})
"""


def _all_tests() -> str:
    """(test, metric, value) of the five tests, from their own SQL without rounding."""

    def rows(test: str, sql: str, **metrics: str) -> str:
        return " union all ".join(f"select '{test}' as test, '{m}' as metric, {R(x)} as value from ({exact(sql)})" for m, x in metrics.items())

    common = {"groups": "count(*)", "significant": "coalesce(count(*) filter (p < 0.05), 0)"}
    single = {k: f"max({k})" for k in ("pearson", "pearson_p", "spearman", "spearman_p", "slope_pp", "r2")}
    return " union all ".join([
        rows("trade_size_by_role", SIZES, **common, mean_ratio="avg(mean_ratio)"),
        rows("yes_no_asymmetry", ASYMMETRY, **common, mean_diff_pp="avg(diff_pp)"),
        rows("category_gaps", GAPS, **common, max_abs_d="max(abs(cohens_d))"),
        rows("trade_size_performance", PERFORMANCE, **single),
        rows("maker_direction", DIRECTION, **common, max_abs_d="max(abs(cohens_d))"),
    ])


TESTS_SQL = {
    "test_trade_size_by_role": SIZES,
    "test_yes_no_asymmetry": ASYMMETRY,
    "test_category_gaps": GAPS,
    "test_trade_size_performance": PERFORMANCE,
    "test_maker_direction": DIRECTION,
    "statistical_tests": f"select * from ({_all_tests()})",
}
