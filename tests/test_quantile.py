"""Exact quantiles by range counts against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from tidebars.operators import labels


def plain(values, q):
    v = sorted(x for x in values if x is not None)
    at = q * (len(v) - 1)
    a, z = int(at), -int(-at // 1)
    return v[a] if a == z else (z - at) * v[a] + (at - a) * v[z]


@pytest.mark.parametrize("q", [0.0, 0.005, 0.3333, 0.7, 1.0])
@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_quantile_equals_sorting(spark, q, accuracy):
    r = random.Random(5)
    groups = {"a": [r.gauss(0, 1) for _ in range(1_000)], "b": [float(r.randrange(3)) for _ in range(400)], "hot": [7.0] * 900 + [r.random() * 14 for _ in range(100)], "one": [2.5], None: [1.0, None, 3.0], "none": [None, None]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, x double").repartition(6)
    found = {x["symbol"]: x["q"] for x in labels.quantile(df, "x", q, accuracy=accuracy).collect()}
    assert found == pytest.approx({k: plain(v, q) for k, v in groups.items() if k != "none"}, abs=1e-12)


def test_a_range_that_misses_the_rank_is_widened(spark, monkeypatch):
    df = spark.range(1_000).select(F.lit("a").alias("symbol"), F.col("id").cast("double").alias("x"))
    monkeypatch.setattr(labels.F, "percentile_approx", lambda *a: F.first(F.array(F.lit(1.0), F.lit(2.0))))
    assert labels.quantile(df, "x", 0.7).first()["q"] == pytest.approx(699.3)
