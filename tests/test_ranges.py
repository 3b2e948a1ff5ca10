"""Ranges of one long series against the same operators on whole series."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidebars.functions.columns import series
from tidebars.operators import backtest, indicators, joins, labels, patterns, ranges, simulate

START = datetime(2024, 1, 1)


def walk(spark, n, symbols=("A",), seed=1):
    r, rows = random.Random(seed), []
    for s in symbols:
        price = 100.0
        for i in range(n):
            before, price = price, price * (1 + r.gauss(0, 0.006))
            high, low = max(before, price) * (1 + 0.004 * r.random()), min(before, price) * (1 - 0.004 * r.random())
            rows.append((s, START + timedelta(minutes=15 * i), before, high, low, price, float(r.randrange(5)), r.gauss(0, 0.006), r.randrange(2)))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, y_pred double, position int").repartition(5)


def same(got, want):
    assert got.columns == want.columns
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = lambda df: sorted((tuple(map(near, r)) for r in df.collect()), key=str)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) and a == b


@pytest.fixture(scope="module")
def rows(spark):
    return walk(spark, 900).unionByName(walk(spark, 70, ("B", None), 2)).persist()


@pytest.mark.parametrize("size", [37, 250])
def test_halo_windows(rows, size):
    same(ranges.halo(rows, indicators.main_features, 120, rows=size), indicators.main_features(rows))
    sma = {"a": 30, "b": 90}
    days = lambda df: indicators.day_features(df, sma)
    same(ranges.halo(rows, days, 120, 16, rows=size), days(rows))
    for f in (patterns.pattern_summary, patterns.pattern_vectors):
        apply = lambda df: f(df, ["close", "volume"], 48)
        same(ranges.halo(rows, apply, 48, rows=size, out_time="window_end_ts"), apply(rows))
    same(ranges.halo(rows, labels.next_bar, 0, 1, rows=size), labels.next_bar(rows))


def test_no_task_holds_more_than_a_chunk_and_its_halo(rows):
    seen = []

    def apply(df):
        seen.append(df.groupBy("symbol").count().agg(F.max("count"), F.count("*")).first())
        return indicators.main_features(df)

    ranges.halo(rows.where("symbol = 'A'"), apply, 120, rows=50)
    assert seen[0][0] <= 170 and seen[0][1] == 18


@pytest.mark.parametrize("size", [1, 37, 10_000])
def test_scans(rows, size):
    some = rows.where("symbol = 'B' OR symbol IS NULL OR ts < '2024-01-04'").withColumn("r", F.when(F.col("volume") > 0, F.try_divide("close", "open") - 1))
    chunks = ranges.chunked(some, rows=size)
    got = ranges.drawdown_scan(ranges.equity_scan(chunks)).drop("_pos", "_chunk")
    same(got, backtest.drawdown(backtest.equity(some)))
    same(ranges.trades_scan(chunks, r="r"), backtest.trades(some, r="r"))
    always = some.withColumn("position", F.lit(1))
    same(ranges.trades_scan(ranges.chunked(always, rows=size), r="r"), backtest.trades(always, r="r"))


@pytest.mark.parametrize("size", [10, 300])
def test_asof_join(rows, size):
    right = rows.where("volume = 1 OR symbol = 'B' AND volume = 2").select("symbol", "ts", F.col("close").alias("seen"), F.when(F.col("volume") > 1, 1).alias("flag"))
    right = right.unionByName(right.where("symbol = 'A'").withColumn("seen", F.col("seen") + 1))
    left = rows.select("symbol", (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("ts"), "close").unionByName(rows.select("symbol", "ts", "close"))
    same(ranges.asof_join_ranges(left, right, rows=size), joins.asof_join(left, right))
    same(ranges.asof_join_ranges(left, right.where("false"), rows=size), joins.asof_join(left, right.where("false")))


@pytest.mark.parametrize("size,rules", [(1, simulate.Rules()), (40, simulate.Rules()), (113, simulate.Rules(0.001, 0.0005, 0.03, 0.02, 7)), (60, simulate.Rules(0.01, 0.008, 0.02, 0.02, 0))])
def test_state_machine_in_ranges(rows, size, rules):
    some = simulate.next_bar_view(rows.where("symbol IS NOT NULL AND (symbol = 'B' OR ts < '2024-01-05')"))
    got, want = simulate.simulate_ranges(some, rules, size), simulate.simulate(some, rules)
    same(got, want)
    assert want.where("stop_loss_exit = 1 OR take_profit_exit = 1").count() > 0


def test_maps_equal_runs_from_any_state():
    r, rules = random.Random(4), simulate.Rules()
    for _ in range(60):
        price, rows = 100.0, []
        for _ in range(r.randrange(1, 40)):
            after = price * (1 + r.gauss(0, 0.004))
            rows.append((r.gauss(0, 0.003), price, max(price, after) * 1.001, min(price, after) * 0.999, after))
            price = after
        found = simulate.state_map(rows, rules)
        for state in [(0, None, w) for w in range(5)] + [(s, 100 * (1 + r.gauss(0, 0.01)), 0) for s in (1, -1) for _ in range(5)]:
            end = state
            for row in rows:
                end = simulate._after(end, row, rules)
            assert simulate.mapped(state, found, rules) == end


def test_empty_series(rows):
    none = rows.where("false").withColumn("r", F.lit(0.0))
    assert ranges.halo(none, indicators.main_features, 120).collect() == []
    assert ranges.equity_scan(ranges.chunked(none)).collect() == []
    assert simulate.simulate_ranges(simulate.next_bar_view(none)).collect() == []


def test_series_is_what_windows_see(rows):
    """A window by symbol inside a halo counts rows of the chunk only."""
    counted = ranges.halo(rows, lambda df: df.withColumn("n", F.row_number().over(series())), 3, rows=100)
    assert counted.agg(F.max("n")).first()[0] == 103
