"""History fetched side by side against the walk, one-document reports, latest rows with counts."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import record, served
from tidebars.sources import files, klines

M = 60_000


def walked(minutes, end, page):
    fetch, asked = served(minutes)
    return {r[0] for p in klines.backward_pages(fetch, end * M, page=page) for r in p}, len(asked)


def test_probes_find_the_page_of_the_earliest_bar():
    for n in (1, 7, 64, 1_000):
        fetch, asked = served(range(5_000 - n, 5_000))
        begin = klines.history_begin(fetch, 5_000 * M, page=10)
        assert begin <= (5_000 - n) * M < begin + 10 * M and len(asked) <= 2 * n.bit_length() + 4
    assert klines.history_begin(served([])[0], 5_000 * M, page=10) is None
    assert klines.history_begin(served(range(4_960, 4_965))[0], 5_000 * M, page=10) is None  # three empty pages
    assert klines.history_begin(served(range(0, 5_000))[0], 5_000 * M, page=10) == 0
    assert klines.history_begin(served(range(0, 5_000))[0], 5_000 * M, batches=4, page=10) == 4_960 * M


@pytest.mark.parametrize("seed", range(3))
def test_side_by_side_equals_the_walk(spark, seed):
    r = random.Random(seed)
    minutes, at = [], r.randrange(100, 200)
    while at < 1_200:  # with gaps on both sides of what a page crosses
        minutes.append(at)
        at += 1 if r.random() < 0.97 else r.choice([2, 5, 8, 9, 10, 11, 25])
    for end in (1_200, 1_215):
        want, _ = walked(minutes, end, 10)
        fetch, _ = served(minutes)
        begin = klines.history_begin(fetch, end * M, page=10)
        rows = [] if begin is None else [("x", [str(v) for v in x]) for a in range(begin, end * M, 10 * M) for x in fetch(a, min(end * M, a + 10 * M))]
        bars = klines.normalise(spark.createDataFrame(rows, "symbol string, record array<string>"), end_ms=end * M)
        got = {x["ms"] for x in klines.reachable(bars, 10, rows=50).select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).collect()}
        assert got == want


def history(symbol, begin, end):
    return [record(m * M) for m in [*range(0, 50), *range(90, 400)] if begin <= m * M < end]


def test_pages_are_tasks_of_their_own(spark, tmp_path):
    spark.dataSource.register(klines.KlineSource)
    options = {"symbol": "BTC", "fetch": "tests.test_history:history", "end_ms": str(390 * M), "page": "16"}
    raw = spark.read.format("klines").options(mode="history_ranges", **options).load()
    assert raw.rdd.getNumPartitions() >= 18
    one, many = (files.max_history(spark, str(tmp_path / k), "BTC", options["fetch"], 390 * M, True, side_by_side=s, page="16") for k, s in (("a", False), ("b", True)))
    rows = lambda p: sorted(map(tuple, spark.read.parquet(p).collect()))
    assert rows(one) == rows(many) and len(rows(many)) == 300
    none = spark.read.format("klines").options(mode="history_ranges", **options | {"end_ms": str(2_000 * M)}).load()
    assert none.count() == 0


def test_report_is_one_document(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), float("nan"), [1, 2]), ("é", None, 0.5, None)], "k string, t timestamp_ntz, v double, l array<int>")
    text = files.write_report({"settings": {"k": 5, "bounds": (0.1, float("inf"))}, "rows": rows}, str(tmp_path / "r"))
    parts = list((tmp_path / "r").glob("part-*"))
    assert len(parts) == 1 and json.loads(parts[0].read_text(encoding="utf-8")) == json.loads(text)
    assert json.loads(text) == {"settings": {"k": 5, "bounds": [0.1, None]}, "rows": [{"k": "a", "t": "2024-01-01T00:00:00", "v": None, "l": [1, 2]}, {"k": "é", "t": None, "v": 0.5, "l": None}]}
    assert text.startswith('{\n  "settings"')
    with pytest.raises(ValueError):
        files.write_report({"rows": spark.range(5)}, str(tmp_path / "x"), most=4)


def test_latest_row_with_the_number_of_rows(spark):
    df = spark.createDataFrame([(1, "a"), (3, "b"), (3, "c"), (None, "z")], "window_end_ts int, s string")
    assert tuple(files.latest_row_and_count(df).first()) == (3, "c", 4)
    assert files.latest_row_and_count(df.where("false")).collect() == []
