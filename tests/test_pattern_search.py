"""Block search over windows against all pairs."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.operators import pattern_search, similarity

START = datetime(2024, 1, 1)
SCHEMA = "symbol string, window_end_ts timestamp_ntz, vector array<float>, up double"


def windows(n, dims, symbols=("A", "B"), seed=1):
    """Overlapping windows of a random walk, some without direction, some equal."""
    r, rows = random.Random(seed), []
    for s in symbols:
        x = [0.0]
        for _ in range(n + dims):
            x.append(0.97 * x[-1] + r.gauss(0, 1))
        for i in range(n):
            v = [0.0] * dims if i % 41 == 0 else x[i - i % 5 : i - i % 5 + dims] if i % 7 == 0 else x[i : i + dims]
            rows.append((s, START + timedelta(hours=i), v, None if i % 13 == 0 else float(i % 3)))
    return rows


def plain(rows, evals, k, hours):
    out = {}
    data = [(s, t, np.array(np.array(v, np.float32), float), u) for s, t, v, u in rows]
    for s, t, v, _ in [(s, t, np.array(np.array(v, np.float32), float), u) for s, t, v, u in evals]:
        if not v.any():
            continue
        pool = [(-round(float(w @ v / np.linalg.norm(w) / np.linalg.norm(v)), 9), u, x) for q, u, w, x in data if q == s and w.any() and u < t - timedelta(hours=hours)]
        if len(pool) >= k:
            out[s, t] = [(-a, c) for a, _, c in sorted(pool, key=lambda p: p[:2])[:k]]
    return out


@pytest.mark.parametrize("ball,at_once", [(4, 3_000), (64, 7)])
def test_equals_all_pairs(spark, monkeypatch, ball, at_once):
    monkeypatch.setattr(pattern_search, "BALL", ball)
    monkeypatch.setattr(pattern_search, "EVALS_AT_ONCE", at_once)
    rows = windows(300, 12)
    evals = [w for i, w in enumerate(rows) if i % 11 == 3] + [("C", START, [1.0] * 12, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    best, report = pattern_search.search_windows(df, spark.createDataFrame(evals, SCHEMA), 5, "INTERVAL 10 HOURS", ["up"])
    found = {}
    for r in best.orderBy("rank").collect():
        found.setdefault((r["eval_symbol"], r["eval_at"]), []).append((r["similarity"], r["up"]))
    want = plain(rows, evals, 5, 10)
    assert found.keys() == want.keys()
    for key, v in want.items():
        assert [x for x, _ in found[key]] == pytest.approx([x for x, _ in v], abs=2e-9)
        assert [y for _, y in found[key]] == [y for _, y in v] or len({round(x, 8) for x, _ in v}) < 5
    seen = report.first()
    assert 0 < seen["computed"] <= seen["pairs"]


def test_similar_windows_lie_in_few_balls(spark, monkeypatch):
    monkeypatch.setattr(pattern_search, "BALL", 16)
    t = np.arange(4_000)
    x = np.sin(t / 300) * 5 + np.cos(t / 1_700) * 9
    rows = [("A", START + timedelta(hours=int(i)), x[i : i + 48].tolist(), 1.0) for i in range(3_900)]
    df = spark.createDataFrame(rows, SCHEMA)
    best, report = pattern_search.search_windows(df, df.where("hour(window_end_ts) % 12 = 5"), 3, "INTERVAL 1 DAY", ["up"])
    seen = report.first()
    assert best.count() > 900 and seen["computed"] < 0.5 * seen["pairs"]


def test_no_windows_and_no_evaluations(spark):
    df = spark.createDataFrame(windows(30, 4), SCHEMA)
    for a, b in ((df, df.where("false")), (df.where("false"), df), (df, df.where("symbol = 'none'"))):
        best, _ = pattern_search.search_windows(a, b, 3, "INTERVAL 1 HOUR", ["up"])
        assert best.columns == ["eval_symbol", "eval_at", "rank", "similarity", "up"] and best.collect() == []


def test_same_rows_as_the_join_of_all_pairs(spark):
    df = spark.createDataFrame(windows(200, 8), SCHEMA)
    evals = df.where("hour(window_end_ts) = 7")
    best, _ = pattern_search.search_windows(df, evals, 4, "INTERVAL 1 DAY", ["up"])
    ids = lambda d: d.withColumn("id", F.concat_ws("|", "symbol", F.col("window_end_ts").cast("string")))
    apart = (F.col("symbol") == F.col("eval_symbol")) & (F.col("window_end_ts") < F.col("eval_window_end_ts") - F.expr("INTERVAL 1 DAY"))
    want = similarity.topk_per_eval(ids(df), ids(evals), 4, "id", apart)
    rows = lambda d, t: sorted((r["eval_symbol"], r[t], r["rank"], round(r["similarity"], 7)) for r in d.collect())
    assert rows(best, "eval_at") == rows(want, "eval_window_end_ts")


def test_similarity_is_not_rounded(spark):
    """Ties are told to nine places, but means and bounds are taken over the cosines themselves."""
    rows = windows(200, 8, ("A",))
    df = spark.createDataFrame(rows, SCHEMA)
    best, _ = pattern_search.search_windows(df, df.where("hour(window_end_ts) = 7"), 4, "INTERVAL 1 DAY", ["up"])
    vectors = {t: np.array(np.array(v, np.float32), float) for _, t, v, _ in rows}
    found = best.where("rank = 4").collect()
    assert found
    for r in found:
        a = vectors[r["eval_at"]]
        cosines = [b @ a / np.linalg.norm(a) / np.linalg.norm(b) for t, b in vectors.items() if b.any() and t < r["eval_at"] - timedelta(days=1)]
        assert r["similarity"] == pytest.approx(sorted(cosines)[-4], abs=1e-13)


def test_blocks_of_vectors_give_the_rows_of_the_join(spark, monkeypatch):
    """Small blocks, several passes, ties and vectors without direction; no pair reaches a join or a sort of all pairs."""
    r = random.Random(4)
    rows = [(i, [0.0] * 4 if i % 19 == 0 else [float(r.randrange(-2, 3)) for _ in range(4)], f"l{i % 7}") for i in range(400)] + [(401, [float("nan")] * 4, "x"), (None, [1.0] * 4, "n"), (500, None, "v")]
    df = spark.createDataFrame(rows, "id long, vector array<float>, label string").repartition(5)
    evals = df.where("id % 9 = 4 or id = 401 or id = 500")
    key = lambda d: sorted((x["eval_id"], x["rank"], x["id"], x["label"], x["eval_label"], str(round(x["similarity"], 8))) for x in d.collect())
    want = key(similarity.topk_per_eval(df, evals, 6, "id", F.col("id") < F.col("eval_id") - 5))
    for names in ({}, {"ROWS": 7, "COLUMNS": 5, "EVALS_AT_ONCE": 11}):
        for n, v in names.items():
            monkeypatch.setattr(similarity, n, v)
        got = similarity.topk_per_eval(df, evals, 6, "id", cutoff=F.col("id") - 5)
        assert key(got) == want and len(want) > 200
    plan = got._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "BroadcastNestedLoopJoin" not in plan
    assert similarity.topk_per_eval(df, evals.where("false"), 6, "id").collect() == [] and similarity.topk_per_eval(df.where("false"), evals, 6, "id").collect() == []
