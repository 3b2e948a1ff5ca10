"""Rules of single operators on hand-made rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidebars.functions import columns as C
from tidebars.operators import backtest as B
from tidebars.operators import bars, clean, indicators, joins, labels, metrics, models, patterns, similarity, simulate, split, stats
from tidebars.schema import feature_columns, require_binary, require_columns, require_no_nulls, resolve_probability
from tidebars.sources import files, klines
from tidebars.streaming import live

T0 = dt.datetime(2024, 1, 1)


def at(n, minutes=1):
    return T0 + dt.timedelta(minutes=n * minutes)


def closes(spark, values, minutes=1):
    rows = [("a", at(i, minutes), float(v), float(v), float(v), float(v), 1.0, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, turnover double")


def test_clean_keeps_first_and_drops_unreadable(spark):
    raw = spark.createDataFrame([("a", "2024-01-01 00:00:00", "1", 0), ("a", "2024-01-01 00:00:00", "2", 1), ("a", "nonsense", "3", 2), ("a", "2024-01-01 00:01:00", "x", 3)], "symbol string, ts string, close string, n int")
    got = [(r["ts"], r["close"]) for r in clean.clean_bars(raw, "n", ["close"]).orderBy("ts").collect()]
    assert got == [(at(0), 1.0), (at(1), None)]
    assert clean.removed_rows(raw).first()["removed"] == 2


def test_resample_keeps_partial_bars_and_skips_empty_bins(spark):
    df = closes(spark, range(1, 31)).where("minute(ts) >= 11 AND minute(ts) <> 20").where("minute(ts) < 15 OR minute(ts) >= 20")
    got = {r["ts"]: (r["open"], r["close"], r["volume"]) for r in bars.resample(df, "5 minutes").collect()}
    assert got == {at(10): (12.0, 15.0, 4.0), at(20): (22.0, 25.0, 4.0), at(25): (26.0, 30.0, 5.0)}
    assert set(bars.fan_out(df)) == {"5m", "15m", "1h", "4h", "1d"}


def test_rsi_edges_and_warm_up(spark):
    w = C.series()
    flat = closes(spark, [5] * 16).select(C.rsi(F.col("close"), 14, w).alias("r")).collect()
    rising = closes(spark, range(1, 17)).select(C.rsi(F.col("close"), 14, w).alias("r")).collect()
    assert [r["r"] for r in flat][13:] == [None, 50.0, 50.0] and rising[15]["r"] == 100.0


def test_prefix_mean_equals_rolling_mean(spark):
    w = C.series()
    df = closes(spark, [(i * 37) % 11 for i in range(60)])
    rows = df.select(C.prefix_mean(F.col("close"), 7, w).alias("a"), C.rolling(F.avg, F.col("close"), 7, w).alias("b")).collect()
    assert all(r["a"] is None and r["b"] is None or abs(r["a"] - r["b"]) < 1e-9 for r in rows)


def test_zero_volume_has_no_change(spark):
    df = closes(spark, [1, 2, 3]).withColumn("volume", F.when(F.col("close") == 1, 0.0).otherwise(1.0))
    got = [r["c"] for r in df.select(C.pct_change(F.col("volume"), 1, C.series()).alias("c")).collect()]
    assert got == [None, None, 0.0]


def test_asof_sees_a_bar_that_closes_at_the_same_time(spark):
    left = closes(spark, [1, 2, 3], 60).select("symbol", "ts", "close")
    right = spark.createDataFrame([("a", at(1, 60), 7.0), ("b", at(0, 60), 9.0)], "symbol string, ts timestamp_ntz, x double")
    assert [r["x"] for r in joins.asof_join(left, right).orderBy("ts").collect()] == [None, 7.0, 7.0]


def test_checked_joins_fail(spark):
    df = closes(spark, [1, 2])
    with pytest.raises(ValueError):
        joins.left_join_checked(df, df.limit(0).select("symbol", "ts", F.col("close").alias("c")), ["symbol", "ts"])
    with pytest.raises(ValueError):
        joins.inner_join_one_to_one(df.unionAll(df), df, ["symbol", "ts"])
    assert joins.unmatched_count(df, df.limit(1), ["symbol", "ts"]) == 1
    assert "target_return_next" in joins.with_close(df.select("symbol", "ts"), df, ["symbol", "ts"]).columns


def test_event_labels_are_inclusive_and_last_flag_is_zero(spark):
    got = labels.horizon_labels(closes(spark, [100, 101, 99.99]), 1, 0.01).orderBy("ts").collect()
    assert [r["target_pump_next_1"] for r in got] == [1, 0, 0] and [r["target_drop_next_1"] for r in got] == [0, 1, 0]
    assert labels.next_bar(closes(spark, [1, 2])).orderBy("ts").collect()[-1]["target_up_next"] == 0


def test_features_do_not_look_ahead(spark):
    values = [100 + (i * 7) % 13 for i in range(80)]
    cut = indicators.main_features(closes(spark, values[:70])).orderBy("ts").collect()
    whole = indicators.main_features(closes(spark, values)).orderBy("ts").limit(70).collect()
    assert cut == whole


def test_scaler_leaves_out_flat_features_and_windows_need_rows(spark):
    df = closes(spark, range(5)).withColumn("flat", F.lit(1.0))
    assert [r["feature"] for r in patterns.fit_scaler(df, ["close", "flat"]).collect()] == ["close"]
    assert patterns.pattern_vectors(df, ["close"], 6).count() == 0 and patterns.pattern_vectors(df, ["close"], 5).count() == 1
    wide = patterns.lag_columns(patterns.pattern_vectors(df, ["close", "flat"], 3), ["close", "flat"], 3)
    assert wide.orderBy("window_end_ts").first()["close_lag_2"] == 0.0 and wide.orderBy("window_end_ts").first()["close_lag_0"] == 2.0


def test_similarity_skips_zero_vectors_and_short_evaluations(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])], "vec_id long, vector array<float>")
    assert [r["vec_id"] for r in similarity.topk_latest(v, v.where("vec_id = 4"), 5, "vec_id", F.col("vec_id") < 4).orderBy("rank").collect()] == [2, 3]
    with pytest.raises(ValueError):
        similarity.topk_latest(v, v.where("vec_id = 1"), 1, "vec_id")
    got = similarity.topk_per_eval(v, v.where("vec_id >= 3"), 2, "vec_id").select("eval_vec_id", "vec_id").collect()
    assert {tuple(r) for r in got} == {(4, 2), (4, 3)}


def test_trades_count_an_open_one_and_no_trades_give_zeros(spark):
    rows = closes(spark, range(6)).withColumns({"position": F.when(F.minute("ts").isin(1, 2, 5), 1).otherwise(0), "gross": F.lit(0.1)})
    got = [round(r["trade_return"], 6) for r in B.trades(rows).orderBy("trade_id").collect()]
    assert got == [0.21, 0.1]
    none = B.threshold_backtest(closes(spark, range(3)).withColumns({"p": F.lit(0.0), "r": F.lit(0.01)}), "p", "r", [0.5]).first()
    assert (none["completed_trades"], none["win_rate"], none["profit_factor"]) == (0, 0.0, 0.0)


def test_correlation_of_a_constant_is_null_and_buckets_hold_one(spark):
    df = closes(spark, range(5)).withColumns({"flat": F.lit(1.0), "x": F.col("close") / 4})
    assert df.agg(stats.pearson(F.col("close"), F.col("flat")).alias("c")).first()["c"] is None
    t = stats.bucket_table(df, "x", [0.0, 0.5, 0.9, 1.000001], ["a", "b", "c"], {"m": "close"}).orderBy("bucket_order").collect()
    assert [(r["count"], r["m"]) for r in t] == [(2, 0.5), (2, 2.5), (1, 4.0)]
    assert stats.monotonic(stats.bucket_table(df.limit(1), "x", [0.0, 0.5, 2.0], ["a", "b"], {"m": "close"}), "m").first()["direction"] == "insufficient"
    assert stats.spearman(df, "close", "x").first()["spearman"] == pytest.approx(1.0)


def test_metrics_of_one_class(spark):
    df = closes(spark, range(3)).select(F.lit(1).alias("y"), (F.col("close") / 4).alias("p"))
    assert metrics.roc_auc(df, "y", "p").first()["roc_auc"] is None
    c = metrics.confusion(df.where("p < 0"), "y", "p").collect()
    assert c == [] or c[0]["f1"] == 0.0


STEPS = [  # side, entry, wait, pred, close, high, low, after -> side, wait, reason, gross
    ((0, math.nan, 0, 0.006, 100, 101, 99.9, 100.5), (1, 0, "Enter Long", 0.005)),
    ((0, math.nan, 2, 0.006, 100, 101, 99.9, 100.5), (0, 1, "Cooldown", 0.0)),
    ((1, 100.0, 0, -0.002, 100, 101, 99.9, 100.5), (0, 0, "Threshold Exit Long", 0.0)),
    ((1, 100.0, 0, -0.006, 100, 100.1, 99.5, 99.5), (-1, 0, "Reverse Long to Short", 0.005)),
    ((1, 100.0, 0, 0.0, 100, 102, 99, 100), (0, 4, "Stop Loss Long", -0.008)),
    ((-1, 100.0, 0, 0.0, 100, 100.2, 98, 99), (0, 4, "Take Profit Short", 0.015)),
    ((-1, 100.0, 0, 0.0, 100, 101, 98, 99), (0, 4, "Stop Loss Short", -0.008)),
    ((0, math.nan, 0, 0.005, 100, 101, 99, 100), (0, 0, "Hold", 0.0)),
]


@pytest.mark.parametrize("given,want", STEPS)
def test_simulation_steps(given, want):
    side, _, wait, seen = simulate.step(*given, simulate.Rules())
    assert (side, wait, seen["action_reason"]) == want[:3] and seen["gross_return"] == pytest.approx(want[3])


def test_splits_and_schema_checks(spark):
    df = closes(spark, range(10))
    assert split.split_two(df).where("split = 'train'").count() == 8
    assert [r["n_rows"] for r in split.split_periods(split.split_three(df)).orderBy("first_ts").collect()] == [7, 1, 2]
    for bad in (lambda: require_columns(df, ["nope"]), lambda: feature_columns(df.withColumn("target_x", F.lit(1)), set()), lambda: require_binary(df, "close"), lambda: require_no_nulls(df.withColumn("z", F.lit(None))), lambda: resolve_probability(["a"])):
        with pytest.raises(ValueError):
            bad()
    assert resolve_probability(["pred_proba_high_vol", "y"]) == "pred_proba_high_vol"


def test_klines_pages_and_records(spark):
    assert klines.page_ranges(0, 2_500 * 60_000)[1] == (999 * 60_000, 2_000 * 60_000)
    df = spark.createDataFrame([("a", ["60000", "1", "2", "0.5", "1.5", "10", "15"]), ("a", ["60000", "1", "2", "0.5", "1.5", "10", "15"]), ("a", ["120000", "1", "2", "1", "1", "1"]), ("a", ["180000"] + ["1"] * 6)], "symbol string, record array<string>")
    got = klines.normalise(df, end_ms=180_000).collect()
    assert [(r["ts"], r["close"]) for r in got] == [(dt.datetime(1970, 1, 1, 0, 1), 1.5)]
    calls = []

    def fails():
        calls.append(1)
        raise OSError

    assert klines.with_retry(fails, 3, fail=False, sleep=lambda s: None) is None and len(calls) == 3


def fake_fetch(symbol, begin, end):
    return [[ms, 1, 2, 0.5, 1.5, 10, 15] for ms in range(max(0, begin), end, 60_000)]


def test_kline_source_reads_ranges(spark):
    spark.dataSource.register(klines.KlineSource)
    raw = spark.read.format("klines").options(symbol="a", start_ms=0, end_ms=1_500 * 60_000, fetch="tests.test_operators:fake_fetch").load()
    assert raw.count() == 1_501 and klines.normalise(raw, 0, 1_500 * 60_000).count() == 1_500


def test_files_versions_and_upsert(spark, tmp_path):
    df = closes(spark, range(3))
    path = files.write_version(df, str(tmp_path / "bars"), now=T0)
    assert path.endswith("v=20240101_000000") and files.read_parquet(spark, path, ["ts"]).count() == 3
    files.write_csv(df, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv")).count() == 3
    merged = files.collect(df, df.withColumn("close", F.lit(9.0)).unionByName(closes(spark, range(4)).where("close = 3")))
    assert [r["close"] for r in merged.orderBy("ts").collect()] == [0.0, 1.0, 2.0, 3.0]
    assert files.resume_from(df).first()["start_ts"] == at(3) and files.completed(df, at(2)).count() == 2
    with pytest.raises(ValueError):
        files.check_modes(update=True, days=3)


def test_streaming_bars_equal_batch_bars(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(minutes=7 * i), float(i % 5), 1.0, 1.0, i) for i in range(120)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, price double, volume double, turnover double, event_id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, ts timestamp, price double, volume double, turnover double, event_id long").parquet(str(tmp_path / "in"))
    q = live.streaming_bars(stream, "1 hour").writeStream.format("memory").queryName("live_bars").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    closed = {r["ts"]: r["close"] for r in spark.table("live_bars").collect()}
    batch = spark.read.parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts"))
    want = {r["ts"]: r["close"] for r in bars.resample(batch, "1 hour", ["ts", "event_id"], "price").collect()}
    assert len(closed) >= len(want) - 2 and all(want[t] == c for t, c in closed.items())


def test_model_round_trip(spark, tmp_path):
    df = closes(spark, range(40)).withColumn("y", (F.col("close") % 2).cast("int"))
    model = models.fit_classifier(df, ["close", "volume"], "y", models.Settings(2, 0.1, 2, weighted=True))
    models.save(spark, model, str(tmp_path / "m"))
    assert models.predict_classes(models.load(spark, str(tmp_path / "m")), df).count() == 40
    with pytest.raises(ValueError):
        models.positive_weight(df.where("y = 0"), "y")


def record(ms, *more):
    return [ms, "1", "1", "1", "1", "1", "1", *more]


def served(minutes, limit=1_000):
    """A fetch over bars at the given minutes, and the log of what was asked."""
    asked = []

    def fetch(begin, end):
        asked.append((begin, end))
        return [record(m * 60_000) for m in minutes if begin <= m * 60_000 < end][:limit]

    return fetch, asked


def times(pages):
    return [[r[0] // 60_000 for r in p] for p in pages]


def test_forward_pages_overlap_and_stop_rules():
    fetch, asked = served(range(0, 25))
    assert times(klines.forward_pages(fetch, 5 * 60_000, 20 * 60_000, page=6)) == [[4, 5, 6, 7, 8, 9], [9, 10, 11, 12, 13, 14], [14, 15, 16, 17, 18, 19]]
    assert asked[0][0] == 4 * 60_000  # one bar ahead of the start
    fetch, asked = served(range(0, 9))
    assert times(klines.forward_pages(fetch, 0, 99 * 60_000, page=5))[-1] == [8] and len(asked) < 20  # the last bar again, then nothing after it
    fetch, _ = served([])
    assert not list(klines.forward_pages(fetch, 0, 9 * 60_000))
    stuck = lambda begin, end: [record(60_000)]
    assert len(list(klines.forward_pages(stuck, 60_000, 5 * 60_000, page=2))) <= 6  # an answer that stands still moves the walk a bar on
    fetch, _ = served(range(0, 12))
    assert times(klines.forward_pages(fetch, 0, 10 * 60_000, page=4, overlap=False)) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert len(list(klines.forward_pages(stuck, 3 * 60_000, 9 * 60_000, overlap=False))) == 1  # time does not advance
    assert not list(klines.forward_pages(lambda b, e: None, 0, 60_000, overlap=False))  # retries used up


def test_backward_pages_stop_rules():
    fetch, asked = served(range(100, 120))
    pages = times(klines.backward_pages(fetch, 118 * 60_000, page=8))
    assert pages[:2] == [list(range(110, 118)), list(range(103, 111))] and sorted({m for p in pages for m in p}) == list(range(100, 118))
    assert asked[1] == (103 * 60_000, 111 * 60_000)  # one bar of overlap
    assert len(pages) == 4 and pages[-1] == [100]  # the earliest bar did not move back
    fetch, asked = served(list(range(50, 55)) + list(range(90, 95)))
    assert times(klines.backward_pages(fetch, 95 * 60_000, page=10)) == [list(range(90, 95)), [90]]
    fetch, asked = served(range(90, 95))
    assert times(klines.backward_pages(fetch, 130 * 60_000, page=10, empty=3)) == [] and len(asked) == 3  # three empty answers end the walk
    assert times(klines.backward_pages(fetch, 110 * 60_000, page=10, empty=3))[0] == list(range(90, 95))  # two do not
    fetch, _ = served(range(0, 30))
    assert times(klines.backward_pages(fetch, 30 * 60_000, page=10))[-1][0] == 0  # near the epoch
    assert len(list(klines.backward_pages(fetch, 30 * 60_000, batches=2, page=10))) == 2
    assert list(klines.backward_pages(lambda b, e: [[1, 2, 3]], 60_000)) == []  # short records are no bars


def history(symbol, begin, end):
    return [record(m * 60_000) for m in range(40, 100) if begin <= m * 60_000 < end]


def catalogue():
    return ["BTC"]


def test_max_history_writes_a_version_and_guards_the_symbol(spark, tmp_path):
    options = {"fetch": "tests.test_operators:history", "catalogue": "tests.test_operators:catalogue", "page": "16"}
    path = files.max_history(spark, str(tmp_path), "BTC", options.pop("fetch"), 95 * 60_000, True, **options)
    got = spark.read.parquet(path)
    assert got.count() == 55 and got.agg(F.min("ts"), F.max("ts")).first() == (dt.datetime(1970, 1, 1, 0, 40), dt.datetime(1970, 1, 1, 1, 34))
    with pytest.raises(ValueError):
        files.max_history(spark, str(tmp_path), "BTC", "tests.test_operators:history", 95 * 60_000, False)
    for known in (None, [], ["ETH"]):
        with pytest.raises(ValueError):
            klines.require_symbol("BTC", known)
    with pytest.raises(Exception, match="catalogue"):
        files.max_history(spark, str(tmp_path), "ETH", "tests.test_operators:history", 95 * 60_000, True, **options)


def test_interpretation_of_trends(spark):
    one = spark.range(1).select(stats.interpretation(F.lit("increasing"), F.lit("mixed"), F.lit(True)).alias("m")).first()["m"]
    assert ["useful monotonic" in one[0], "does not show stable" in one[1], "improved drawdown" in one[2], len(one)] == [True, True, True, 4]


def test_equity_curves_of_a_simulation(spark):
    rows = closes(spark, [100, 101, 102, 100, 99]).withColumns({"y_pred": F.lit(0.01), "high": F.col("close"), "low": F.col("close")})
    curves = simulate.equity_curves(simulate.simulate(simulate.next_bar_view(rows))).orderBy("ts").collect()
    assert [round(r["buy_hold_equity"], 6) for r in curves] == [1.01, 1.02, 1.0, 0.99]
    assert curves[0]["strategy_equity"] < curves[0]["gross_equity"]
