"""Histogram boosting against plain exact boosting, held-out quality, files, blocks and margins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.operators import boosting, metrics, models
from tidebars.operators.boosting import Settings


def plain(x, y, s, kind, positive):
    """Exact greedy boosting: every value of every feature is tried as a split, missing values on both sides."""
    start = 0.0 if kind == "logistic" else sum(y) / len(y)
    margin = [start] * len(y)
    cut = lambda g: math.copysign(max(abs(g) - s.l1, 0), g)
    score = lambda g, h: cut(g) ** 2 / (h + s.l2)

    def grow(rows, depth, g, h):
        G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = (boosting.LEAST_GAIN, None)
        for f in range(len(x[0])) if depth < s.depth else []:
            for v in sorted({x[i][f] for i in rows if x[i][f] is not None}):
                for missing in (False, True):
                    left = [i for i in rows if (missing if x[i][f] is None else x[i][f] <= v)]
                    lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                    if lh >= s.leaf and H - lh >= s.leaf:
                        gain = score(lg, lh) + score(G - lg, H - lh) - score(G, H)
                        if gain > best[0] + 1e-9:
                            best = (gain, left)
        if best[1] is None:
            for i in rows:
                margin[i] += -cut(G) / (H + s.l2) * s.rate
            return
        left = set(best[1])
        grow(best[1], depth + 1, g, h)
        grow([i for i in rows if i not in left], depth + 1, g, h)

    for _ in range(s.rounds):
        if kind == "logistic":
            p = [1 / (1 + math.exp(-m)) for m in margin]
            w = [positive if v == 1 else 1.0 for v in y]
            g, h = [(a - b) * c for a, b, c in zip(p, y, w)], [a * (1 - a) * c for a, c in zip(p, w)]
        else:
            g, h = [m - v for m, v in zip(margin, y)], [1.0] * len(y)
        grow(list(range(len(y))), 0, g, h)
    return margin


@pytest.mark.parametrize("kind,s,positive", [("logistic", Settings(6, 0.3, 3, 1, 1, 1.5, 0.1, 1.0), 2.5), ("squared", Settings(5, 0.5, 2, 1, 1, 3, 0.2, 0.5), 1.0)])
def test_equals_exact_boosting(spark, monkeypatch, kind, s, positive):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 16)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    r = random.Random(7)
    x = [[r.random() if r.random() > 0.1 else None, r.gauss(0, 1), r.randrange(4)] for _ in range(120)]
    y = [float((a or 0.4) + 0.3 * b + 0.2 * r.random() > 0.5) if kind == "logistic" else (a or 2.0) * b + c for a, b, c in x]
    rows = [(i, a, b, float(c), v) for i, ((a, b, c), v) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, (-1, 0.1, 0.1, 1.0, None), (-2, 0.1, 0.1, 1.0, float("nan"))], "i int, a double, b double, c double, y double").repartition(3)
    model = boosting.fit(df, ["a", "b", "c"], "y", s, kind, positive)
    found = {v["i"]: v["margin"] for v in boosting.with_margin(model, df).collect() if v["i"] >= 0}
    assert [found[i] for i in range(len(rows))] == pytest.approx(plain(x, y, s, kind, positive), abs=1e-9)


def test_remembered_margins_change_nothing(spark, monkeypatch):
    df = spark.range(500).select((F.rand(1) * 10).alias("a"), F.rand(2).alias("b")).withColumn("y", (F.col("a") * F.col("b") > 2).cast("int"))
    s = Settings(12, 0.2, 3, 0.7, 0.5)
    whole = boosting.fit(df, ["a", "b"], "y", s)
    bins, tree = whole.binned(np.random.default_rng(1).random((50, 2))), whole.trees
    for memory in (0, 1 << 20):
        monkeypatch.setattr(boosting, "MEMORY", memory)
        start = np.zeros(50)
        for k in range(1, 13):
            got = boosting._margin(f"t{memory}", "b", 0, start, tree[:k], bins)
        assert np.array_equal(got, boosting._margin("other", "b", 0, start, tree, bins))
        boosting._margin(f"t{memory}", "c", 0, start, tree, bins)
        assert len(boosting._SEEN) == 1 if memory == 0 else len(boosting._SEEN) > 1
    again = boosting.Booster.from_json(whole.to_json())
    x = np.array([[1.0, 0.5], [9.0, np.nan], [np.nan, 0.1], [100.0, -5.0]])
    assert np.array_equal(again.margins(x), whole.margins(x)) and sum(whole.importance().values()) == pytest.approx(1)


def test_learns_held_out_rows_and_survives_a_file(spark, tmp_path):
    x = spark.range(6_000).select("id", *[F.randn(k).alias(f"f{k}") for k in range(6)])
    x = x.withColumn("y", (F.col("f0") * F.col("f1") + F.col("f2") + 0.5 * F.randn(9) > 1.2).cast("int")).persist()
    train, test = x.where("id % 4 <> 0"), x.where("id % 4 = 0")
    features = [f"f{k}" for k in range(6)]
    model = models.fit_classifier(train, features, "y", Settings(60, 0.1, 4, weighted=True, leaf=3, l1=0.1))
    models.save(spark, model, str(tmp_path / "m"))
    out = models.predict_classes(models.load(spark, str(tmp_path / "m")), test)
    assert out.columns == [*test.columns, "pred_proba_0", "pred_proba_1", "pred_label"]
    assert metrics.roc_auc(out, "y", "pred_proba_1").first()[0] > 0.93
    best = [r["feature"] for r in models.importance(spark, model, 3).collect()]
    assert set(best) == {"f0", "f1", "f2"}
    values = models.predict_values(models.fit_regressor(train.withColumn("z", F.col("f0") * 2 + F.col("f1") * F.col("f2")), features, "z", Settings(80, 0.1, 5, leaf=3, l1=0.1)), test)
    error = values.agg(F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col("f0") * 2 - F.col("f1") * F.col("f2"), 2)))).first()[0]
    assert error < 0.8  # the label spreads by 2.2
    x.unpersist()


def test_odd_inputs(spark):
    one = spark.createDataFrame([(1.0, 1)], "a double, y int")
    assert boosting.fit(one, ["a"], "y", Settings(2, 0.1, 2)).margins(np.array([[1.0], [np.nan]])).tolist() != []
    nothing = spark.createDataFrame([(None, 1), (None, 0), (None, 1)], "a double, y int")
    model = boosting.fit(nothing, ["a"], "y", Settings(2, 0.1, 2))
    assert all((t.feature < 0).all() for t in model.trees)
    with pytest.raises(ValueError):
        boosting.fit(one.where("false"), ["a"], "y", Settings(2, 0.1, 2))
    with pytest.raises(ValueError):
        models.positive_weight(nothing.where("y = 0"), "y")
