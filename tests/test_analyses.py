"""Analyses against plain Python over rows of our own, invariants, plans, and the oracles at the smallest scale."""

import datetime
import json
import math
import random
from collections import Counter, defaultdict
from statistics import median, pstdev

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from settleframe import oracle, registry
from settleframe.functions import stats
from settleframe.functions.columns import sample_n
from settleframe.operators import book, categories
from settleframe.plans.legs import leg_sums, legs, merged, moments, position_cube
from settleframe.sources import ingest, landed, sinks
from settleframe.sources.tables import Tables, read_collateral, read_tables, stand_in_tables
from settleframe.streaming import incremental

SF = "/root/testdata/sf0.001"
TRADES = "trade_id string, ticker string, count bigint, yes_price int, no_price int, taker_side string, created_time timestamp_ntz"
MARKETS = "ticker string, status string, result string, volume bigint, event_ticker string"
#: a resolved YES and NO, one without event, one that is closed but not finalized, and two without outcome
OUTCOMES = [
    ("rain", "finalized", "yes", 70, "RAIN-MAY"), ("goal", "finalized", "no", 40, "GOAL7x"), ("odd", "finalized", "no", None, None),
    ("coin", "closed", "yes", 9, "RAIN-JUNE"), ("void", "finalized", "", 5, "VOID"), ("open", "open", "", 3, ""),
]


def _trades():
    """A few hundred trades in ties and repeats, in all markets and one that is unknown, at prices from 1 to 99."""
    draw, rows, start = random.Random(77), [], datetime.datetime(2023, 11, 9, 21, 17, 5, 250)
    for k in range(900):
        yes = draw.choice([1, 4, 4, 19, 20, 21, 37, 50, 50, 63, 80, 96, 99])
        ticker = draw.choice(["rain", "rain", "goal", "goal", "odd", "coin", "void", "open", "unknown"])
        at = start + datetime.timedelta(minutes=draw.randrange(400_000), microseconds=draw.randrange(1000))
        rows.append((f"t{k}", ticker, draw.choice([0, 1, 2, 2, 7, 30, 150]), yes, 100 - yes, draw.choice(["yes", "no"]), at))
    return rows


ROWS = _trades()


def brute_legs(strict=True):
    """(role, side, price, won, contracts, time, category) by plain Python."""
    market = {m[0]: m for m in OUTCOMES}
    for _, ticker, count, yes, no, taker, at in ROWS:
        _, status, result, _, event = market.get(ticker, (None, None, None, None, None))
        if result not in ("yes", "no") or (strict and status != "finalized"):
            continue
        lead = "".join(c for i, c in enumerate(event or "") if all(x.isupper() or x.isdigit() for x in event[: i + 1]))
        for role, side in (("taker", taker), ("maker", "no" if taker == "yes" else "yes")):
            yield role, side, yes if side == "yes" else no, int(side == result), count, at, lead or "independent"


@pytest.fixture(scope="module")
def fixture(spark):
    return Tables(spark.createDataFrame(ROWS, TRADES), spark.createDataFrame(OUTCOMES, MARKETS), None, None, None, None, None)


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_win_rates(fixture):
    want = defaultdict(list)
    for _, _, price, won, *_ in brute_legs():
        want[price].append(won)
    got = by(book.win_rate_by_price(fixture), "price")
    assert {p: (r.total_trades, r.wins, r.win_rate) for p, r in got.items()} == {p: (len(w), sum(w), pytest.approx(100 * sum(w) / len(w))) for p, w in want.items()}


def test_returns(fixture):
    want = defaultdict(list)
    for role, _, price, won, count, *_ in brute_legs():
        want[role, price].append((won - price / 100, count))
    got = by(book.maker_vs_taker_returns(fixture), "price")
    assert set(got) == {p for r, p in want if r == "taker"} & {p for r, p in want if r == "maker"}
    for price, r in got.items():
        for role in ("taker", "maker"):
            x = [e for e, _ in want[role, price]]
            assert r[f"{role}_n"] == len(x) and r[f"{role}_excess"] == pytest.approx(sum(x) / len(x)) and r[f"{role}_var"] == pytest.approx(pstdev(x) ** 2)
            assert r[f"{role}_pnl"] == pytest.approx(sum(e * c for e, c in want[role, price]))
            if r[f"{role}_z"] is not None:
                assert r[f"{role}_p"] == pytest.approx(math.erfc(abs(r[f"{role}_z"]) / math.sqrt(2)))


def test_sizes(fixture):
    got = by(book.trade_size_by_role(fixture), "role")
    for role in ("taker", "maker"):
        sizes = sorted(price * count / 100 for r, _, price, _, count, *_ in brute_legs() if r == role)
        at = 0.9 * (len(sizes) - 1)
        p90 = sizes[int(at)] + (at - int(at)) * (sizes[min(int(at) + 1, len(sizes) - 1)] - sizes[int(at)])
        r = got[role]
        assert r.n == len(sizes) and r.total == pytest.approx(sum(sizes)) and r["median"] == pytest.approx(median(sizes))
        assert r.std_pop == pytest.approx(pstdev(sizes)) and r.p90 == pytest.approx(p90)


def test_calibration(fixture):
    rows = [(at, price, won) for _, _, price, won, _, at, _ in brute_legs(strict=False)]
    low, high = min(r[0] for r in rows), max(r[0] for r in rows)
    week = low + datetime.timedelta(days=(6 - low.weekday()) % 7)
    want = {}
    while week <= high:
        seen = defaultdict(list)
        for at, price, won in rows:
            if at <= week:
                seen[price].append(won)
        n = sum(map(len, seen.values()))
        if n >= 50:
            want[week] = (n, pytest.approx(sum(abs(100 * sum(w) / len(w) - p) for p, w in seen.items()) / len(seen)))
        week += datetime.timedelta(days=7)
    got = book.calibration_deviation_over_time(fixture, least=50).collect()
    assert len(want) > 20 and {r.week: (r.cumulative_legs, r.mean_abs_deviation) for r in got} == want


def test_legs_mirror(fixture):
    found = book.book_legs(fixture)
    sums = by(found.groupBy("role").agg(F.sum("won").alias("w"), F.sum(F.col("contracts") * F.col("e")).alias("pnl"), F.count(F.lit(1)).alias("n")), "role")
    assert sums["taker"].w + sums["maker"].w == sums["taker"].n and sums["taker"].pnl + sums["maker"].pnl == 0
    want = Counter((role, side, price, won, count, category) for role, side, price, won, count, _, category in brute_legs())
    assert Counter(tuple(r) for r in found.select("role", "side", "price", "won", "contracts", "category").collect()) == want


def test_sums_of_trades_are_sums_of_legs(fixture):
    keys = ("role", "side", "price", "category")
    direct = legs(fixture.book_trades, fixture.book_markets).groupBy(*keys).agg(*moments())
    summed = leg_sums(fixture.book_trades, fixture.book_markets, "category").groupBy(*keys).agg(*moments())
    assert {tuple(r) for r in direct.collect()} == {tuple(r) for r in summed.collect()}
    fine = position_cube(book.book_legs(fixture).withColumn("day", F.to_date("created_time")), "day")
    assert {tuple(r) for r in merged(fine, "role", "side", "price").collect()} == {tuple(r) for r in position_cube(book.book_legs(fixture)).collect()}


def test_analyses_read_a_stored_cube(spark, fixture, tmp_path):
    book.position_moments(fixture).write.parquet(str(tmp_path / "cube"))
    cube, gone = spark.read.parquet(str(tmp_path / "cube")), Tables(*[None] * 7)
    for analysis in (book.win_rate_by_price, book.mispricing_by_price, book.maker_counterparty_excess, book.maker_win_rate_by_direction, book.longshot_volume_share):
        assert sorted(map(str, analysis(gone, cube=cube).collect())) == sorted(map(str, analysis(fixture).collect()))


@pytest.fixture
def large_markets(spark):
    """Markets that are too many to be broadcast."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["win_rate_by_price", "maker_vs_taker_returns", "returns_by_hour", "longshot_volume_share", "maker_taker_returns_by_category", "position_moments", "win_rate_by_trade_size"])
def test_trades_are_summed_below_the_join(spark, name, large_markets):
    """What is shuffled of trades are sums by ticker: between their scan and the first exchange above it stands a partial aggregate."""
    lines = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    (scan,) = [k for k, line in enumerate(lines) if "FileScan" in line and "l_orderkey" in line]
    above = next(k for k in range(scan, -1, -1) if "Exchange" in lines[k])
    assert any("HashAggregate" in line and "partial_" in line for line in lines[above:scan])
    assert "Cartesian" not in "".join(lines)


@pytest.mark.parametrize("name", ["maker_vs_taker_returns", "maker_taker_gap_over_time", "maker_returns_by_direction", "maker_taker_returns_by_category", "maker_counterparty_excess"])
def test_roles_share_one_scan_of_trades(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert sum("FileScan" in line and "l_orderkey" in line for line in plan.splitlines()) == 1


def test_first_rule_holds(spark):
    rules = categories.rules_table(spark, [("AB", "one", "m", "s"), ("ABC", "two", "m", "s"), ("B", "three", "m", "s")])
    names = spark.createDataFrame([("xabc",), ("zz",), ("",), (None,), ("b",), ("bAb",)], "category string")
    got = {r.category: (r.group, r.sub) for r in categories.classify(names, rules).collect()}
    assert got == {"xabc": ("one", "s"), "zz": ("Other", "zz"), "": ("Other", ""), None: ("Other", None), "b": ("three", "s"), "bAb": ("one", "s")}
    every = categories.rules_table(spark, [("ZZ", "one", "m", "s"), ("", "all", "m", "s")])
    assert {r.category: r.group for r in categories.classify(names, every).collect()} == {"xabc": "all", "zz": "one", "": "all", None: "Other", "b": "all", "bAb": "all"}
    assert {r.group for r in categories.classify(names, rules.limit(0)).collect()} == {"Other"}


def test_many_rules_meet_many_categories_without_a_loop(spark):
    draw = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    patterns = ["".join(draw.choice(letters) for _ in range(draw.choice([3, 4, 4, 5, 6]))) for _ in range(50_000)]
    names = ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 14))).lower() for _ in range(300)]
    rules = spark.createDataFrame([(k, p, f"g{k}", "m", "s") for k, p in enumerate(patterns)], categories.RULE_SCHEMA)
    found = categories.classify(spark.createDataFrame([(n,) for n in names], "category string"), rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {n: next((f"g{k}" for k, p in enumerate(patterns) if p in n.upper()), "Other") for n in names}
    assert {r.category: r.group for r in found.collect()} == want and 30 < sum(g == "Other" for g in want.values()) < 290


def test_student_and_normal(spark):
    #: fixed values: published two-sided 5 and 1 percent points of Student's t
    for df, five, one in ((1, 12.7062, 63.6567), (5, 2.5706, 4.0321), (10, 2.2281, 3.1693), (30, 2.0423, 2.7500), (120, 1.9799, 2.6174)):
        assert stats.student_p(five, df) == pytest.approx(0.05, abs=1e-5) and stats.student_p(-one, df) == pytest.approx(0.01, abs=1e-5)
    assert stats.student_p(0, 5) == pytest.approx(1) and stats.student_p(math.inf, 3) == 0 and math.isnan(stats.student_p(1.0, 0))
    rows = spark.createDataFrame([(1.96,), (0.0,), (-3.5,), (None,)], "z double")
    got = [tuple(r) for r in rows.select(stats.normal_two_sided_p("z"), stats.normal_upper_p("z")).collect()]
    assert got[0] == (pytest.approx(0.0499958, abs=1e-6), pytest.approx(0.0249979, abs=1e-6)) and got[1] == (1.0, 0.5) and got[3] == (None, None)
    assert got[2][1] == pytest.approx(1 - got[2][0] / 2)
    r = spark.createDataFrame([(0.5, 12), (1.0, 9), (0.3, 2)], "r double, n long").select(stats.correlation_t(F.col("r"), F.col("n")).alias("t")).collect()
    assert [x.t for x in r] == [pytest.approx(0.5 * math.sqrt(10 / 0.75)), math.inf, None]


def test_event_times(spark):
    got = [r.t for r in spark.createDataFrame([("2024-01-02T03:04:05.123Z",), ("2024-01-02T03:04:05.123456789Z",), ("2024-01-02T03:04:05Z",), ("",), (None,)], "s string").select(ingest.event_time(F.col("s")).alias("t")).collect()]
    second = datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert got == [second.replace(microsecond=123000), second.replace(microsecond=123456), second, None, None]


def test_decoding(spark):
    word = lambda n: f"{n:064x}"
    topics = [ingest.ORDER_FILLED, "0x" + word(7), "0x" + word(0xABC), "0x" + word(0xDEF)]
    good = "0x" + word(0) + word(10**60) + word(500000) + word(1000000) + word(3)
    logs = spark.createDataFrame([(1, "0xt", 0, topics, good), (2, "0xt", 1, topics, "0x12"), (3, "0xt", 2, ["0x00"], good)], "block_number bigint, transaction_hash string, log_index bigint, topics array<string>, data string")
    (row,) = ingest.chain_trade_measures(ingest.decode_order_filled(logs)).collect()
    assert row.taker_asset_id == str(10**60) and row.is_buy and row.price == 0.5 and row.maker == "0x" + "0" * 37 + "abc"


def test_dedup_and_blocks(spark):
    old, new = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 4), ("b", 3)], "k string, v int")
    assert [tuple(r) for r in ingest.dedup_append(old, new, ["k"], ["v"]).collect()] == [("b", 3)]
    samples = spark.createDataFrame([(99_999, 100), (100_003, 111), (200_001, 200_113)], "block_number bigint, ts bigint")
    got = {r.block_number: r.ts for r in ingest.interpolate_blocks(samples).collect()}
    assert len(got) == 100_003 and [got[99_999 + k] for k in range(5)] == [100, 102, 105, 108, 111] and got[200_001] == 200_113


def test_registered_blocks_keep_every_recorded_time(spark):
    recorded = stand_in_tables(spark, SF).blocks.selectExpr("block_number", "unix_timestamp(cast(timestamp as timestamp)) as ts").collect()
    samples = sorted((r.block_number, r.ts) for r in recorded)
    want = dict(samples)
    for (a, ta), (b, tb) in zip(samples, samples[1:], strict=False):
        want |= {block: ta + (tb - ta) * (block - a) // (b - a) for block in range(a, b)}
    got = [(r.block_number, r.ts) for r in registry.QUERIES["interpolate_blocks"](spark, SF).collect()]
    assert len(got) == len(want) and dict(got) == want


@pytest.mark.parametrize("name", [
    "win_rate_by_price", "ev_yes_vs_no", "trade_size_by_role", "market_types_topn", "chain_win_rate_by_price", "chain_trades_per_block", "statistical_tests",
    "maker_vs_taker_returns", "calibration_deviation_over_time", "top_groups", "iso_blocks", "interpolate_blocks", "volume_chart_short", *oracle.INGEST_SQL,
])
def test_oracles(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "orders", "events", "nation", "part"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(oracle.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = registry.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.select(*columns).fetchall()))


def test_sinks(spark, tmp_path):
    df = spark.range(25).select("id", F.when(F.col("id") > 0, "x,\"y\"").alias("s")).repartition(1)
    sinks.write_parquet(df, str(tmp_path / "p"), rows=10)
    assert len(list((tmp_path / "p").glob("*.parquet"))) == 3 and spark.read.parquet(str(tmp_path / "p")).count() == 25
    sinks.write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "c"), schema="id bigint, s string")
    sinks.write_json(df, str(tmp_path / "j"))
    assert set(back.collect()) == set(df.collect()) == set(spark.read.schema(df.schema).json(str(tmp_path / "j")).collect())


def test_landed_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"conditionId": "a", "size": "1.5"}\nnot json\n{"market": "m", "price": 0.25}\n')
    got = ingest.ingest_data_api_trades(landed.read_landed(spark, "data_api_trades", str(tmp_path))).collect()
    assert sorted((r.condition_id, r["size"], r.price) for r in got) == [("", 0.0, 0.0), ("a", 1.5, 0.0), ("m", 0.0, 0.25)]


def test_entry(spark):
    assert entry.entry(spark).columns == ["price", "total_trades", "wins", "win_rate"] and set(entry.oracle_sql()) <= set(entry.queries())
    assert stand_in_tables(spark, SF).book_trades.count() > 0


LINE = {"ticker": "rain", "count": 1, "yes_price": 40, "no_price": 60, "taker_side": "yes"}


def _land(folder, name, *trades):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(LINE | {"trade_id": k, "created_time": at} | more) for k, at, more in trades))


def _stored(spark, tmp_path):
    incremental.append_trades(spark, str(tmp_path / "landing"), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination(120)
    return sorted((r.trade_id, r["count"]) for r in incremental.stored_trades(spark, str(tmp_path / "table")).collect())


def test_appends_keep_each_trade_once_in_any_order(spark, tmp_path):
    _land(tmp_path / "landing", "a.json", ("1", "2024-06-01T12:00:00Z", {}), ("1", "2024-06-01T11:00:00Z", {"count": 5}), ("2", "2024-06-01T12:00:00Z", {}))
    assert _stored(spark, tmp_path) == [("1", 5), ("2", 1)]
    _land(tmp_path / "landing", "b.json", ("3", "2024-07-01T12:00:00Z", {}), ("2", "2024-07-01T12:00:00Z", {"count": 9}))
    assert _stored(spark, tmp_path) == [("1", 5), ("2", 1), ("3", 1)]
    _land(tmp_path / "landing", "c.json", ("4", "2024-06-10T12:00:00Z", {}), ("5", "2019-01-01T00:00:00Z", {}))  # long before what is stored
    assert _stored(spark, tmp_path) == [("1", 5), ("2", 1), ("3", 1), ("4", 1), ("5", 1)]
    for log in (tmp_path / "check" / "commits").glob("*2*"):
        log.unlink()  # the last batch was written, but the stream didn't live to say so: it runs again
    assert _stored(spark, tmp_path) == [("1", 5), ("2", 1), ("3", 1), ("4", 1), ("5", 1)]


def test_cube_counts_trades_of_markets_that_resolve_later(spark, tmp_path):
    folder, early = str(tmp_path / "cube"), spark.createDataFrame([("rain", "open", "", 1, "RAIN")], MARKETS)
    late = spark.createDataFrame([("rain", "finalized", "yes", 1, "RAIN")], MARKETS)
    source = tmp_path / "trades"
    for k, rows in enumerate((ROWS[:500], ROWS[500:])):
        spark.createDataFrame(rows, TRADES).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(TRADES).parquet(str(source))
        incremental.grow_cube(stream, folder, str(tmp_path / "check")).awaitTermination(120)
        if not k:
            assert incremental.cube_so_far(spark, folder, early).count() == 0
            assert by(incremental.pending_categories(spark, folder, early), "category")["RAIN"].n == sum(r[1] == "rain" for r in ROWS[:500])
    trades = spark.createDataFrame(ROWS, TRADES)
    want = position_cube(legs(trades, late).withColumn("day", F.to_date("created_time")), "day", "category")
    assert {tuple(r) for r in incremental.cube_so_far(spark, folder, late).collect()} == {tuple(r) for r in want.collect()}
    everything = {tuple(r) for r in position_cube(legs(trades, late)).collect()}
    assert {tuple(r) for r in incremental.cube_of_all(incremental.cube_so_far(spark, folder, late)).collect()} == everything


def test_tables_and_lookups_are_read_with_their_schemas(spark, fixture, tmp_path):
    made = stand_in_tables(spark, SF)
    for name in ("book_trades", "book_markets", "chain_trades", "chain_legacy_trades", "chain_markets", "blocks", "collateral_lookup"):
        rows = getattr(fixture if name.startswith("book") else made, name)
        rows.select(*[F.col(c).cast("int") if c == "outcome_index" else F.col(c) for c in rows.columns if c != "outcome_index"]).write.parquet(str(tmp_path / name))
    tables = read_tables(spark, str(tmp_path))
    assert {r.price: r.wins for r in book.win_rate_by_price(tables).collect()} == {r.price: r.wins for r in book.win_rate_by_price(fixture).collect()}
    assert "_fetched_at" in tables.book_trades.columns and tables.chain_markets.schema["closed"].dataType.typeName() == "boolean"
    (tmp_path / "c.json").write_text('{"0xA": {"collateral_symbol": "USDC", "collateral_address": "0x1"}, "0xB": {"collateral_symbol": null}, "0xC": {}}')
    assert sorted(map(tuple, read_collateral(spark, str(tmp_path / "c.json")).collect())) == [("0xA", "USDC", "0x1"), ("0xB", None, None), ("0xC", None, None)]


def test_samples_times_and_provenance(spark):
    rows = spark.range(5000).withColumn("v", F.col("id") % 7)
    one, two = ({r.id for r in sample_n(rows.repartition(k), 100, 5, "id").collect()} for k in (1, 6))
    assert one == two and len(one) == 100 and one != {r.id for r in sample_n(rows, 100, 6, "id").collect()}
    assert sample_n(rows, 9000, 5, "id").count() == 5000 and sample_n(rows.limit(0), 3, 5, "id").count() == 0
    for n in (0, 1, 37, 4096, 4999):
        want = sorted(rows.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(n).collect())
        assert sorted(sample_n(rows.repartition(3), n, 9, "id").collect()) == want
    large = sample_n(rows, 2500, 5, "id")
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "limit=2500" not in plan
    repeated = spark.range(9000).withColumn("k", F.lit(3)).unionByName(spark.range(50).withColumn("k", F.col("id").cast("int")))
    assert [sample_n(repeated, n, 1, "k").count() for n in (1, 40, 8000, 9050, 9999)] == [1, 40, 8000, 9050, 9050]
    times = ingest.iso_blocks(spark.createDataFrame([(1, 0), (2, 1_717_243_205), (3, None)], "block_number long, ts long")).collect()
    assert [r.timestamp for r in times] == ["1970-01-01T00:00:00Z", "2024-06-01T12:00:05Z", None]
    tagged = ingest.tag_provenance(rows.limit(2), "0xc").collect()
    assert {r._contract for r in tagged} == {"0xc"} and len({r._fetched_at for r in tagged}) == 1
    assert ingest.tag_provenance(rows.limit(1)).first()._contract is None


def test_top_groups_are_the_largest_in_order(fixture):
    every = categories.maker_taker_returns_by_category(fixture).collect()
    got = categories.top_groups(fixture, n=1).collect()
    assert [r.group for r in got] == [max(every, key=lambda r: r.taker_volume).group]


def test_entry_names_what_is_there():
    assert (entry.llm is None) == (not any(k.startswith("op1_") for k in entry.queries()))
