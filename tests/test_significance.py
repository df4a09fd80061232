"""The significance tests, percentiles and sketches against plain Python over the rows of ``test_analyses``."""

import math
import random
from collections import defaultdict
from statistics import mean, median, variance

import pytest
from pyspark.sql import functions as F
from test_analyses import OUTCOMES, ROWS, SF, brute_legs, fixture  # noqa: F401

from settleframe import registry
from settleframe.functions import quantiles
from settleframe.operators import book
from settleframe.operators import tests_of_significance as tests
from settleframe.sources.shared import stored
from settleframe.sources.tables import stand_in_tables


def _resolved_trades():
    """(taker's price, taker's cents, maker's cents) of each trade in a finalized market."""
    result = {m[0]: m[2] for m in OUTCOMES if m[1] == "finalized"}
    for _, ticker, count, yes, no, taker, _ in ROWS:
        if result.get(ticker) in ("yes", "no"):
            own, other = (yes, no) if taker == "yes" else (no, yes)
            yield own, count * own, count * other


def test_sizes_are_paired_by_the_takers_price(fixture):  # noqa: F811
    trades = list(_resolved_trades())
    low, high = min(t[0] for t in trades), max(t[0] for t in trades)
    bins = defaultdict(list)
    for price, taker, maker in trades:
        bins[max(1, math.ceil((price - low) / ((high - low) / 10)))].append((taker, maker))
    got = {r.bin: r for r in tests.trade_size_by_role(fixture, least=20).collect()}
    assert set(got) == {b for b, rows in bins.items() if len(rows) >= 20} and len(got) > 4
    for b, r in got.items():
        takers, makers = zip(*bins[b], strict=True)
        u = sum((m > t) + 0.5 * (m == t) for m in makers for t in takers)
        n = len(takers)
        assert r.n_trades == n and r.u == pytest.approx(u) and r.rank_biserial == pytest.approx(1 - 2 * u / n**2)
        assert r.taker_mean == pytest.approx(mean(takers) / 100) and r.maker_mean == pytest.approx(mean(makers) / 100)
        assert r.taker_median == pytest.approx(median(takers) / 100) and r.maker_median == pytest.approx(median(makers) / 100)
        assert r.mean_ratio == pytest.approx(mean(makers) / mean(takers)) and r.maker_larger == (mean(makers) > mean(takers))
        assert r.price_bin == f"{10 * b - 9}-{10 * b}c"


def test_makers_pay_more_where_takers_pay_little(spark):
    """Both sides of a trade pay a dollar a contract together, so the ratio of their sizes falls from many to a small part."""
    ratios = [r.mean_ratio for r in tests.trade_size_by_role(stand_in_tables(spark, SF.replace("0.001", "0.01"))).orderBy("bin").collect()]
    assert len(ratios) == 10 and ratios == sorted(ratios, reverse=True) and 16 < ratios[0] < 18 and 0.05 < ratios[-1] < 0.07


def test_no_against_yes_at_listed_prices(fixture):  # noqa: F811
    rows = defaultdict(list)
    for role, side, price, won, count, *_ in brute_legs():
        if role == "taker":
            rows[price, side].append((won, count))
    listed = (1, 2, 3, 4, 5, 10, 15, 20, 25, 50, 75, 80, 85, 90, 95, 96, 97, 98, 99)
    want = [p for p in listed if min(len(rows[p, "yes"]), len(rows[p, "no"])) >= 5]
    got = {r.price: r for r in tests.yes_no_asymmetry(fixture, least=5).collect()}
    assert sorted(got) == want and {1, 96, 99} <= set(want)
    for p, r in got.items():
        n = {s: sum(c for _, c in rows[p, s]) for s in ("yes", "no")}
        won = {s: sum(w * c for w, c in rows[p, s]) for s in ("yes", "no")}
        rate = {s: won[s] / n[s] for s in n}
        pool = (won["yes"] + won["no"]) / (n["yes"] + n["no"])
        se = math.sqrt(pool * (1 - pool) * (1 / n["yes"] + 1 / n["no"]))
        assert (r.yes_n, r.no_n) == (n["yes"], n["no"]) and r.z == pytest.approx((rate["no"] - rate["yes"]) / se if se else 0)
        assert r.diff_pp == pytest.approx(100 * (rate["no"] - rate["yes"])) and r.no_better == (rate["no"] > rate["yes"])
        assert r.ev_diff == pytest.approx((100 * rate["no"] - p) / p * 100 - (100 * rate["yes"] - p) / p * 100)
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=1e-12)


def test_makers_no_against_yes_in_ranges(fixture):  # noqa: F811
    rows = defaultdict(list)
    for role, side, price, won, count, *_ in brute_legs():
        for low, high in ((1, 10), (11, 25), (26, 50), (51, 75), (76, 90), (91, 99)):
            if role == "maker" and low <= price <= high:
                rows[f"{low}-{high}", side].append((won - price / 100, count))
    spans = {k for k, _ in rows}
    got = {r.range: r for r in tests.maker_direction(fixture, least=10).collect()}
    assert set(got) == {s for s in spans if min(len(rows[s, "yes"]), len(rows[s, "no"])) >= 10} and len(got) > 3
    for s, r in got.items():
        weighted = {k: 100 * sum(e * c for e, c in rows[s, k]) / sum(c for _, c in rows[s, k]) for k in ("yes", "no")}
        told = {k: [e for e, c in rows[s, k] for _ in range(min(c, 100))] for k in ("yes", "no")}
        a, b = told["no"], told["yes"]
        t = (mean(a) - mean(b)) / math.sqrt(variance(a) / len(a) + variance(b) / len(b))
        pooled = ((len(a) - 1) * variance(a) + (len(b) - 1) * variance(b)) / (len(a) + len(b) - 2)
        assert r.yes_excess_pp == pytest.approx(weighted["yes"]) and r.no_excess_pp == pytest.approx(weighted["no"])
        assert r.diff_pp == pytest.approx(weighted["no"] - weighted["yes"]) and r.no_better == (weighted["no"] > weighted["yes"])
        assert r.t == pytest.approx(t) and r.cohens_d == pytest.approx((mean(a) - mean(b)) / math.sqrt(pooled))
        assert (r.yes_n, r.no_n) == (len(rows[s, "yes"]), len(rows[s, "no"]))


def test_percentiles_are_exact_whatever_the_range(spark):
    draw = random.Random(8)
    rows = [("a", draw.choice([0, 1, 5, 4096, 5_000_000, 10**11]), draw.randrange(4)) for _ in range(400)]
    rows += [("b", 7, 1), ("b", 9, 2), ("b", 100, 0), ("c", 3, 0), ("d", 2**40, 10**9)]
    rows += [("e", k * k, 1) for k in range(3000)]
    freq = spark.createDataFrame(rows, "g string, v bigint, n bigint")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in quantiles.percentiles(freq, ["g"], "v", "n", shares).collect()}
    assert set(got) == {"a", "b", "d", "e"} and got["d"] == [2.0**40] * 5
    for g in ("a", "b", "e"):
        values = sorted(v for k, v, n in rows for _ in range(n) if k == g)
        want = []
        for s in shares:
            at = s * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            want.append(low + (high - low) * (at - math.floor(at)))
        assert got[g] == pytest.approx(want)
    assert quantiles.percentiles(freq.limit(0), ["g"], "v", "n", shares).count() == 0
    assert quantiles.percentiles(freq, [], "v", "n", [1.0]).first().q == [2.0**40]


def test_no_task_holds_all_sizes(fixture):  # noqa: F811
    plan = book.trade_size_by_role(fixture)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect_set" not in plan


def test_quantile_sketches_merge(spark, fixture):  # noqa: F811
    by_day = book.size_sketches(fixture, F.to_date("created_time").alias("day"))
    about = {r.role: r for r in book.sketched_sizes(by_day).collect()}
    exact = {r.role: r for r in book.trade_size_by_role(fixture).collect()}
    sizes = {r: sorted(p * c / 100 for role, _, p, _, c, *_ in brute_legs() if role == r) for r in about}
    for role, r in about.items():
        for share, q in ((0.5, r["median"]), (0.9, r.p90)):
            low, high = (sum(x < q for x in sizes[role]) / len(sizes[role]), sum(x <= q for x in sizes[role]) / len(sizes[role]))
            assert low - 0.02 <= share <= high + 0.02
        assert r.median_contracts == exact[role].median_contracts


def test_distinct_sketches_of_days_merge(spark):
    t = stand_in_tables(spark, SF.replace("0.001", "0.01"))
    days = book.ticker_sketches(t, F.to_date("created_time").alias("day"))
    by_days = quantiles.distinct_estimates(days, []).first().distinct
    at_once = quantiles.distinct_estimates(book.ticker_sketches(t), []).first().distinct
    exact = t.book_trades.select("ticker").distinct().count()
    assert abs(by_days - exact) < 0.02 * exact and abs(at_once - exact) < 0.02 * exact, (by_days, at_once, exact)
    told = {r.metric: r.value for r in book.meta_stats(t, tickers=days).collect()}
    assert told["num_tickers"] == by_days and told["num_trades"] == t.book_trades.count()


@pytest.mark.parametrize("name", [
    "statistical_tests", "test_trade_size_by_role", "test_trade_size_performance", "test_category_gaps", "test_maker_direction", "test_yes_no_asymmetry",
    "calibration_deviation_over_time", "trade_size_by_role",
])
def test_trades_are_scanned_once(spark, name, monkeypatch):
    """Counted over the result's plan and the plans of the tables that the query stores."""
    plans = []

    def noted(df, what):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return stored(df, what)

    for module in (book, tests):
        monkeypatch.setattr(module, "stored", noted)
    plans.append(registry.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString())
    assert sum("FileScan" in line and "l_orderkey" in line for p in plans for line in p.splitlines()) == 1
