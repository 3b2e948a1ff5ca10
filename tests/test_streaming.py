"""Streams against batch results: features by state and timers, upserts by day, restarts and replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidebars.operators import bars, indicators
from tidebars.sources.days import DayStore, upsert_stream
from tidebars.streaming import features, live

T0 = dt.datetime(2024, 1, 1)
TICKS = "symbol string, ts timestamp, price double, volume double, turnover double, event_id long"


def ticks(n, symbols=("a", "b"), seed=1):
    r, out, i = random.Random(seed), [], 0
    for k in range(n):
        for s in symbols:
            i += 1
            if r.random() < 0.9:
                out.append((s, T0 + dt.timedelta(minutes=7 * k, seconds=r.randrange(60)), 100 + r.gauss(0, 3), float(r.randrange(4)), 1.0, i))
    return out


def test_streamed_features_equal_batch_ones_over_a_restart(spark, tmp_path):
    features.use_rocksdb(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = ticks(1_400)
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    parts = [rows[:900], rows[900:1_000][::-1] + rows[850:905], rows[1_000:1_900], rows[1_900:], [("a", T0 + dt.timedelta(days=30), 1.0, 1.0, 1.0, 10**9), ("b", T0 + dt.timedelta(days=30), 1.0, 1.0, 1.0, 10**9 + 1), (None, T0, 1.0, 1.0, 1.0, 1), ("a", T0, 5.0, 1.0, 1.0, 10**9 + 2)]]

    def run():
        stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(source)
        q = features.streaming_features(stream, 3_600_000, delay="2 hours").writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()

    for i, part in enumerate(parts):  # each run starts from the checkpoint of the one before
        spark.createDataFrame(part, TICKS).coalesce(1).write.mode("append").parquet(source)
        if i != 1:
            run()
    run()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    want = bars.resample(spark.createDataFrame(rows, TICKS), "1 hour", ["ts", "event_id"], "price")
    want = {(r["symbol"], r["ts"]): r for r in indicators.main_features(want).collect()}
    found = spark.read.parquet(out).collect()
    assert len(found) == len({(r["symbol"], r["ts"]) for r in found}) == len(want)
    for r in found:
        for c in ["open", "high", "low", "close", "volume", *indicators.MAIN_FEATURES]:
            a, b = r[c], want[r["symbol"], r["ts"]][c]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9)), (c, r["ts"])
    assert sum(r["ma_120"] is not None for r in found) > 50


def minute_bars(spark, start, n, close, symbol="a"):
    rows = [(symbol, T0 + dt.timedelta(minutes=start + i), *[float(close)] * 4, 1.0, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, turnover double")


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("day=*/*.parquet")}


def test_a_batch_of_one_day_rewrites_one_day(spark, tmp_path):
    store = DayStore(spark, str(tmp_path / "s"))
    assert store.read().count() == 0
    assert store.upsert(minute_bars(spark, 0, 3 * 1_440, 1), "one")
    before = files(tmp_path / "s")
    assert store.upsert(minute_bars(spark, 1_440 + 1_000, 300, 2), "two")  # the second day, and nothing of the third
    after = files(tmp_path / "s")
    assert {k for k in before if after.get(k) == before[k]} == {k for k in before if "day=2024-01-02" not in k}
    assert store.read().count() == 3 * 1_440 and store.read().where("close = 2").count() == 0  # stored rows win
    assert store.upsert(minute_bars(spark, 3 * 1_440 - 10, 20, 3), "three")
    assert store.read().where("close = 3").count() == 10 and store.read([dt.date(2024, 1, 4)]).count() == 10
    again = files(tmp_path / "s")
    assert not store.upsert(minute_bars(spark, 0, 10, 9, "z"), "three") and files(tmp_path / "s") == again  # a replay
    assert store.upsert(minute_bars(spark, 0, 10, 9).where("false"), "none") and store.done("none")
    assert store.upsert(minute_bars(spark, 0, 1, 9).withColumn("ts", F.lit(None).cast("timestamp_ntz")), "no time")
    assert store.read().count() == 3 * 1_440 + 10


def test_a_crash_between_writes_loses_nothing(spark, tmp_path, monkeypatch):
    store = DayStore(spark, str(tmp_path / "s"))
    store.upsert(minute_bars(spark, 0, 1_440, 1), "one")
    with monkeypatch.context() as m:
        m.setattr(DayStore, "_publish", lambda self, batch: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.upsert(minute_bars(spark, 1_430, 20, 2), "two")
    for p in (tmp_path / "s").glob("day=*/*.parquet"):
        p.unlink()  # as if the day had been taken away for its new rows
    assert store.read().count() == 1_450 and store.done("two")
    assert not store.upsert(minute_bars(spark, 1_430, 20, 2), "two")


def test_streamed_upserts_and_replayed_batches(spark, tmp_path):
    source, store = str(tmp_path / "in"), DayStore(spark, str(tmp_path / "s"))
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, turnover double"
    for i in range(3):
        minute_bars(spark, i * 1_000, 1_200, i).coalesce(1).write.mode("append").parquet(source)
        for check in ("c", "c", "lost"):  # a new checkpoint brings all batches again, under the same numbers
            stream = spark.readStream.schema(schema).parquet(source)
            upsert_stream(stream, store, str(tmp_path / f"{check}{i if check == 'lost' else ''}"), "k" if check == "c" else f"l{i}").trigger(availableNow=True).start().awaitTermination()
    assert store.read().count() == 3_200
    assert {r["close"]: r["count"] for r in store.read().groupBy("close").count().collect()} == {0.0: 1_200, 1.0: 1_000, 2.0: 1_000}


def test_upsert_each_batch(spark, tmp_path):
    held, schema = [minute_bars(spark, 0, 5, 1)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, turnover double"
    minute_bars(spark, 3, 5, 2).write.parquet(str(tmp_path / "in"))

    def write(df, number):
        held.append(spark.createDataFrame(df.collect(), df.schema))

    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    live.upsert_each_batch(stream, lambda: held[-1], write, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["close"] for r in held[-1].collect()) == [1.0] * 5 + [2.0] * 3
