"""State that jobs keep: the key index of appends, levelled sums of batches, and compacted snapshots."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_analyses import LINE, MARKETS, ROWS, TRADES

from settleframe import round_trips
from settleframe.plans.legs import legs, position_cube
from settleframe.sources import ingest, landed
from settleframe.sources.manifest import Manifest, Run
from settleframe.streaming import incremental, keyindex, levels

SCHEMA = "k bigint, n bigint"


def _sums(spark, folder):
    return levels.Levels(spark, str(folder), SCHEMA, merge=lambda both: both.coalesce(1).groupBy("k").agg(F.sum("n").alias("n")))


def _batch(spark, number):
    return spark.sql(f"select * from values ({number % 7}L, 1L), ({number % 3}L, 10L) as v(k, n)")


def _added(table):
    return {r.k: r.n for r in table.read().groupBy("k").agg(F.sum("n").alias("n")).collect()}


def _want(batches):
    out = {}
    for b in batches:
        for k, n in ((b % 7, 1), (b % 3, 10)):
            out[k] = out.get(k, 0) + n
    return out


def test_sixty_four_batches_are_read_from_few_folders(spark, tmp_path):
    table = _sums(spark, tmp_path)
    most = 0
    for number in range(64):
        table.add(number, _batch(spark, number))
        runs = table.manifest.runs()
        most = max(most, len(runs))
        assert (runs[0].first, runs[-1].last) == (0, number) and all(a.last + 1 == b.first for a, b in zip(runs, runs[1:], strict=False))
    assert most <= 6 and len(runs) == 1 and runs[0].level == 6
    assert _added(table) == _want(range(64)) and table.read().count() == 7  # merged, not only listed
    kept = {p.name for p in tmp_path.glob("run-*")}
    assert len(kept) <= 8  # what the last two versions name
    table.add(63, _batch(spark, 63))
    table.add(20, _batch(spark, 20))  # runs again: no change
    assert _added(table) == _want(range(64))


def test_a_crash_before_the_manifest_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    table = _sums(spark, tmp_path)
    for number in range(3):
        table.add(number, _batch(spark, number))
    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", lambda self, runs: (_ for _ in ()).throw(OSError("the driver died")))
        with pytest.raises(OSError, match="died"):
            table.add(3, _batch(spark, 3))  # the batch's folder and the two merged ones are written, their manifest isn't
    assert _added(_sums(spark, tmp_path)) == _want(range(3)) and not table.holds(3)
    _sums(spark, tmp_path).add(3, _batch(spark, 3))
    assert _added(table) == _want(range(4)) and len(table.manifest.runs()) == 1


def test_a_reader_of_the_version_before_still_finds_its_folders(spark, tmp_path):
    table = _sums(spark, tmp_path)
    for number in range(3):
        table.add(number, _batch(spark, number))
    before = table.read()  # two runs that the next batch merges
    table.add(3, _batch(spark, 3))
    assert {r.k: r.n for r in before.groupBy("k").agg(F.sum("n").alias("n")).collect()} == _want(range(3))


def test_empty_tables(spark, tmp_path):
    assert _sums(spark, tmp_path / "none").read().count() == 0 and not _sums(spark, tmp_path / "none").holds(0)
    index = keyindex.KeyIndex(spark, str(tmp_path / "keys"))
    keys = spark.createDataFrame([("a",), (None,)], keyindex.KEYS)
    assert index.known(keys).count() == 0
    index.add(0, keys.limit(0))
    assert index.known(keys).count() == 0 and index.holds(0)


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyindex, "PER_BUCKET", 50)
    index = keyindex.KeyIndex(spark, str(tmp_path / "keys"))
    keys = lambda low, high: spark.range(low, high).select(F.col("id").cast("string").alias("key"))
    for number in range(3):
        index.add(number, keys(1000 * number, 1000 * (number + 1)))
    runs = index.levels.manifest.runs()
    assert [r.rows for r in runs] == [2000, 1000] and all(r.bits >= 4 for r in runs)
    asked = spark.createDataFrame([("5",), ("2500",), ("77777",), ("5",), (None,)], keyindex.KEYS)
    assert sorted(r.key for r in index.known(asked).collect()) == ["2500", "5"]
    files = index.candidates(asked).select(F.input_file_name().alias("f")).distinct().collect()
    read = {r.f.split("/keys/")[1].rsplit("/", 1)[0] for r in files}
    want = {f"{r.name}/bucket={b}" for r in runs for k in ("5", "2500", "77777") for b in [spark.range(1).select(keyindex.bucket(F.lit(k), r.bits)).first()[0]]}
    all_there = {f"{r.name}/{p.name}" for r in runs for p in (tmp_path / "keys" / r.name).glob("bucket=*")}
    assert read == want & all_there and len(read) <= 6 < len(all_there) / 4
    plan = index.known(asked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [bucket") == len(runs) and "PushedFilters: [IsNotNull(key)" in plan


def _land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(LINE | {"trade_id": k, "created_time": "2024-06-01T12:00:00Z"} | more) for k, more in rows))


def _appended(spark, tmp_path):
    incremental.append_trades(spark, str(tmp_path / "landing"), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination(120)
    return sorted(((r.trade_id, r["count"]) for r in incremental.stored_trades(spark, str(tmp_path / "table")).collect()), key=str)


def test_rows_without_a_key_are_no_repeats_of_each_other(spark):
    schema = "k string, l int, v int"
    old = spark.createDataFrame([("a", 1, 1), (None, 1, 1)], schema)
    new = spark.createDataFrame([("a", 1, 2), (None, 1, 5), (None, 1, 5), (None, 1, 6), ("b", None, 7), ("b", None, 7), ("b", 2, 9), ("b", 2, 8)], schema)
    got = sorted(map(tuple, ingest.dedup_append(old, new, ["k", "l"], ["v"]).collect()), key=str)
    assert got == sorted([(None, 1, 5), (None, 1, 5), (None, 1, 6), ("b", None, 7), ("b", None, 7), ("b", 2, 8)], key=str)


def test_an_append_that_died_before_its_keys_is_written_again(spark, tmp_path, monkeypatch):
    _land(tmp_path / "landing", "a.json", [("1", {}), ("2", {})])
    with monkeypatch.context() as m:
        m.setattr(keyindex.KeyIndex, "add", lambda self, batch, keys: (_ for _ in ()).throw(OSError("the driver died")))
        with pytest.raises(Exception, match="died"):
            _appended(spark, tmp_path)
    assert _appended(spark, tmp_path) == [("1", 1), ("2", 1)]
    _land(tmp_path / "landing", "b.json", [("2", {"count": 9}), ("3", {})])
    assert _appended(spark, tmp_path) == [("1", 1), ("2", 1), ("3", 1)]
    stored = incremental.key_index(spark, str(tmp_path / "table"))
    assert sorted(r.key for r in stored.levels.read().collect()) == ["1", "2", "3"]


def test_a_streamed_cube_of_many_batches(spark, tmp_path):
    source, folder = tmp_path / "trades", str(tmp_path / "cube")
    for k in range(5):
        spark.createDataFrame(ROWS[k * 180 : (k + 1) * 180], TRADES).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(TRADES).parquet(str(source))
        incremental.grow_cube(stream, folder, str(tmp_path / "check")).awaitTermination(120)
    assert [r.level for r in incremental.sums_so_far(spark, folder).manifest.runs()] == [2, 0]
    markets = spark.createDataFrame([("rain", "finalized", "yes", 1, "RAIN"), ("goal", "finalized", "no", 1, None)], MARKETS)
    want = position_cube(legs(spark.createDataFrame(ROWS, TRADES), markets).withColumn("day", F.to_date("created_time")), "day", "category")
    assert {tuple(r) for r in incremental.cube_so_far(spark, folder, markets).collect()} == {tuple(r) for r in want.collect()}


def test_compaction_of_a_folder_into_itself(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.range(5000).withColumn("v", F.col("id") % 7)
    rows.repartition(20).write.parquet(path)
    size = ingest.stored_bytes(spark, [path])
    for again in range(3):
        ingest.compact(spark, path, "id", file_bytes=size // 4, rows=1000)
        found = ingest.read_compacted(spark, path)
        assert sorted(r.id for r in found.collect()) == list(range(5000))
        files = found.groupBy(F.input_file_name()).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        spans = sorted((r.a, r.b) for r in files)
        assert 4 <= len(files) <= 12 and max(r.n for r in files) <= 1000 and all(b < a for (_, b), (a, _) in zip(spans, spans[1:], strict=False))
        assert len(list((tmp_path / "t").glob("run-*"))) == min(2, again + 1)
    before = Manifest(spark, path).runs()
    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", lambda self, runs: (_ for _ in ()).throw(OSError("the driver died")))
        with pytest.raises(OSError, match="died"):
            ingest.compact(spark, path, "v")
    assert Manifest(spark, path).runs() == before and ingest.read_compacted(spark, path).count() == 5000
    ingest.compact(spark, path, "v")  # all in one range
    assert ingest.read_compacted(spark, path).rdd.getNumPartitions() == 1 and ingest.read_compacted(spark, path).count() == 5000


def test_versions_are_renamed_into_place_and_never_replaced(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path))
    assert manifest.runs() == [] and manifest.versions() == []
    for k in range(4):
        manifest.commit([Run(f"run-{k}", first=k, last=k, rows=3)])
    assert manifest.versions() == [2, 3] and manifest.runs() == [Run("run-3", 3, 3, 0, 3, 0)] and manifest.runs(2)[0].name == "run-2"
    assert not list((tmp_path / "_manifest").glob(".*tmp*"))


SMALL = "/root/testdata/sf0.001"


def _landed(spark, tmp_path, monkeypatch, file_rows=1000):
    """Folders of the round trips go under tmp_path, their landed files are small."""
    monkeypatch.setattr(round_trips, "_folder", lambda spark, what: str(tmp_path / what))
    monkeypatch.setattr(round_trips, "FILE_ROWS", file_rows, raising=False)


def test_landed_files_stay_small_while_trades_grow(spark, tmp_path, monkeypatch):
    _landed(spark, tmp_path, monkeypatch)
    got = round_trips.appended_trades(spark, SMALL)
    trades = round_trips._numbered_trades(spark, SMALL)
    rows = [len(p.read_text().splitlines()) for p in (tmp_path / "appended" / "landing").glob("part-*")]
    assert sum(rows) == 2 * trades.count() and len(rows) >= 12 and max(rows) < 2000
    assert len(list((tmp_path / "appended" / "table").glob("batch=*"))) == round_trips.FILES
    want = {r.trade_id for r in trades.select("trade_id").collect()}
    assert got.count() == len(want) and {r.trade_id for r in got.select("trade_id").collect()} == want


def test_a_streamed_cube_reads_small_files_and_each_batch_once(spark, tmp_path, monkeypatch):
    _landed(spark, tmp_path, monkeypatch, 500)
    got = round_trips.streamed_cube(spark, SMALL)
    rows = [spark.read.parquet(str(p)).count() for p in (tmp_path / "streamed" / "trades").glob("part-*")]
    assert len(rows) >= 12 and max(rows) < 1000
    assert [(r.first, r.last) for r in incremental.sums_so_far(spark, str(tmp_path / "streamed" / "cube")).manifest.runs()] == [(0, 3), (4, 5)]
    t = round_trips.stand_in_tables(spark, SMALL)
    want = position_cube(legs(t.book_trades, t.book_markets).withColumn("day", F.to_date("created_time")), "day", "category")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    seen, table = spark.sparkContext.accumulator(0), _sums(spark, tmp_path / "once")
    for number in range(4):
        table.add(number, spark.sparkContext.parallelize(range(10), 1).map(lambda k: seen.add(1) or (k, 1)).toDF(SCHEMA))
    assert seen.value == 40 and table.read().collect() == [(k, 4) for k in range(10)]


def test_a_landed_line_is_parsed_once(spark):
    for kind in ("book_trades", "book_markets", "chain_markets", "data_api_trades"):
        plan = landed.JOBS["ingest_" + kind](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json(") == 1, kind
    lines = spark.createDataFrame([('{"ticker": "a", "count": 3}',), ("{}",), ("no JSON",), (None,)], "value string")
    got = [(r.ticker, r["count"], r.trade_id) for r in landed.parsed(lines, "book_trades").collect()]
    assert got == [("a", 3, None), (None, None, None), (None, None, None), (None, None, None)]


def test_times_of_the_usual_form_and_of_others(spark):
    day = "2024-05-06T07:08:09"
    want = {day + end: "2024-05-06 07:08:09" + out for end, out in (("Z", ""), (".5Z", ".5"), (".123456789Z", ".123456"), (".9999999Z", ".999999"), (".12345678901Z", ".123456"), ("", ""), (".25", ".25"), (".1+00:00", ".1"), ("Z\n", ""))}
    want[day + "+02:00"] = "2024-05-06 05:08:09"
    want |= dict.fromkeys(("", "Z", "soon", "2024-13-06T07:08:09Z", "2024-02-30T07:08:09.1Z", "2024-05-06T24:08:09Z"), None)
    rows = spark.createDataFrame([(t,) for t in want], "t string")
    got = {r.t: r.x for r in rows.select("t", ingest.event_time(F.col("t")).cast("string").alias("x")).collect()}
    assert got == want


def test_logs_are_made_once_and_whole_words_are_told(spark):
    for name, topics in (("decode_order_filled", 3), ("decode_amm_trades", 2)):
        plan = landed.JOBS[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("get_json_object(") == 1 and plan.count("lpad(") <= 8, name
    word = "0123456789abcdefABCDEF".ljust(64, "0")
    data = {"0x" + word * n: n >= 3 for n in range(5)}
    data |= {"0x" + word * 3 + "\n": True, "0x" + word * 3 + "0": False, "0x" + word * 2 + "g" * 64: False, "00" + word * 3: False, "0X" + word * 3: False, "0x" + word * 2 + "\u00e9" * 64: False, "": False, "0x": False}
    rows = spark.createDataFrame([(d,) for d in data] + [(None,)], "d string")
    got = {r.d: r.x for r in rows.select("d", ingest._has_words(F.col("d"), 3).alias("x")).collect()}
    assert got == data | {None: None}


def test_compaction_starts_from_small_files(spark, tmp_path, monkeypatch):
    _landed(spark, tmp_path, monkeypatch, 500)
    got = round_trips.compacted_trades(spark, SMALL)
    rows = [spark.read.parquet(str(p)).count() for p in (tmp_path / "compacted").glob("part-*")]
    assert len(rows) >= 12 and max(rows) < 1000
    trades = round_trips.stand_in_tables(spark, SMALL).book_trades
    assert got.count() == trades.count() and got.exceptAll(trades).isEmpty()


def _size(folder):
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_appends_leave_no_shuffles_and_few_landed_files(spark, tmp_path, monkeypatch):
    _landed(spark, tmp_path, monkeypatch)
    monkeypatch.setattr(round_trips, "LANDED_BYTES", 300_000, raising=False)
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {name for name in (manager.getAllFiles().apply(k).getName() for k in range(manager.getAllFiles().size())) if name.startswith("shuffle_")}
    before = shuffles()
    got = round_trips.appended_trades(spark, SMALL)
    assert not shuffles() - before and spark.conf.get(incremental.CLEANUP) == "false"  # the caller's session is as it was
    assert 0 < _size(tmp_path / "appended" / "landing") <= 400_000  # with checksums; all lines take 2 MB
    trades = round_trips._numbered_trades(spark, SMALL).dropDuplicates()
    got = got.withColumn("created_time", F.date_format("created_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")).select(trades.columns)
    assert got.count() == trades.count() and got.exceptAll(trades).isEmpty()


def test_the_oldest_files_go(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"part-{k}").write_text("x" * 10)
        os.utime(tmp_path / f"part-{k}", (1000 + k, 1000 + k))
    (tmp_path / "_SUCCESS").write_text("")
    for keep, left in ((40, "0123"), (25, "23"), (9, "")):
        ingest.drop_oldest(spark, str(tmp_path), keep)
        assert [name[-1] for _, name, _ in ingest.stored_files(spark, str(tmp_path))] == list(left)


def test_bloom_filters_are_smaller_than_their_keys(spark, tmp_path):
    index = keyindex.KeyIndex(spark, str(tmp_path / "keys"))
    index.add(0, spark.range(120_000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("key")))
    files = list((tmp_path / "keys").rglob("*.parquet"))
    assert len(files) == 4 and sum(p.stat().st_size for p in files) < 120_000 * 32
    assert index.known(spark.createDataFrame([("cfcd208495d565ef66e7dff9f98764da",), ("none",)], keyindex.KEYS)).count() == 1


def test_an_append_that_takes_too_long_fails_and_deletes_nothing(spark, tmp_path, monkeypatch):
    _landed(spark, tmp_path, monkeypatch)
    monkeypatch.setattr(round_trips, "LANDED_BYTES", 0, raising=False)
    monkeypatch.setattr(round_trips, "TIMEOUT_S", 0.001)
    with pytest.raises(TimeoutError):
        round_trips.appended_trades(spark, SMALL)
    assert list((tmp_path / "appended" / "landing").glob("part-*"))


def test_a_batch_is_parsed_once_and_takes_no_cache(spark, tmp_path, monkeypatch):
    seen, cached, plain, known = spark.sparkContext.accumulator(0), [], incremental.ingest_book_trades, keyindex.KeyIndex.candidates
    counted = F.udf(lambda key: seen.add(1) or key)
    monkeypatch.setattr(incremental, "ingest_book_trades", lambda raw: plain(raw).withColumn("trade_id", counted("trade_id")))
    monkeypatch.setattr(keyindex.KeyIndex, "candidates", lambda self, keys, but=None: cached.append("InMemory" in keys._jdf.queryExecution().withCachedData().toString()) or known(self, keys, but))
    _land(tmp_path / "landing", "a.json", [(f"a{k}", {}) for k in range(1000)])
    assert len(_appended(spark, tmp_path)) == 1000 and seen.value == 1000
    _land(tmp_path / "landing", "b.json", [(f"a{k}", {"count": 9}) for k in range(500)] + [(f"b{k}", {}) for k in range(500)])
    got = _appended(spark, tmp_path)
    assert len(got) == 1500 and all(n == 1 for _, n in got) and seen.value < 2500  # and the first rows, to see which buckets they fall into
    assert cached == [False, False]


def test_a_large_batch_reads_all_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyindex, "PER_BUCKET", 50)
    index = keyindex.KeyIndex(spark, str(tmp_path / "keys"))
    keys = lambda low, high: spark.range(low, high).select(F.col("id").cast("string").alias("key"))
    index.add(0, keys(0, 1000))
    for low, high, both in ((500, 5000, 500), (0, 100_000, 1000), (990, 1100, 10), (2000, 9000, 0)):
        assert index.known(keys(low, high)).count() == both
    late = spark.range(0, 100_000, numPartitions=4).select(F.when(F.col("id") < 50_000, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("all rows were looked at"))).alias("key"))
    assert index.candidates(late).count() == 1000
