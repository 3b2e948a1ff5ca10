"""Sliding windows of scaled features as pattern summaries and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_finite, series

LENGTHS = (16, 48, 96, 192)


def fit_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std) over the whole history, population std; features without spread are left out."""
    one = df.agg(*[F.avg(f).alias(f"{f}__m") for f in features], *[F.stddev_pop(f).alias(f"{f}__s") for f in features])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}__m").alias("mean"), F.col(f"{f}__s").alias("std")) for f in features]))
    return one.select(rows.alias("r")).select("r.*").where(is_finite(F.col("mean")) & is_finite(F.col("std")) & (F.col("std") > 0))


def scale(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """z-scores of the scaler's features. The scaler has one row for each feature, so its rows become literals."""
    rows = scaler.collect()
    return df.withColumns({r["feature"]: (F.col(r["feature"]) - r["mean"]) / r["std"] for r in rows})


def pattern_summary(df: DataFrame, features: list[str], length: int, outcomes: list[str] | None = None) -> DataFrame:
    """Window bounds, outcomes at its last row, and seven statistics of each feature over ``length`` rows."""
    w = series()
    frame = w.rowsBetween(-(length - 1), 0)
    columns = {"window_start_ts": F.lag("ts", length - 1).over(w), "_n": F.count(F.lit(1)).over(frame)}
    for f in features:
        first = F.lag(f, length - 1).over(w)
        columns |= {f"{f}_mean": F.avg(f).over(frame), f"{f}_std": F.stddev_pop(f).over(frame), f"{f}_min": F.min(f).over(frame), f"{f}_max": F.max(f).over(frame), f"{f}_last": F.col(f), f"{f}_first": first, f"{f}_change": F.col(f) - first}
    stats = [c for c in columns if c[0] != "_" and c != "window_start_ts"]
    out = df.withColumns(columns).where(F.col("_n") == length)
    return out.select("symbol", "window_start_ts", F.col("ts").alias("window_end_ts"), F.lit(length).alias("pattern_length"), *(outcomes or []), *stats)


def pattern_vectors(df: DataFrame, features: list[str], length: int, outcomes: list[str] | None = None) -> DataFrame:
    """One array<float> for each window: the last ``length`` values of each feature, oldest first, feature by feature."""
    w = series()
    frame = w.rowsBetween(-(length - 1), 0)
    arrays = [F.collect_list(F.col(f).cast("float")).over(frame) for f in features]
    out = df.withColumns({"window_start_ts": F.lag("ts", length - 1).over(w), "vector": F.concat(*arrays)})
    return out.where(F.size("vector") == length * len(features)).select("symbol", "window_start_ts", F.col("ts").alias("window_end_ts"), F.lit(length).alias("pattern_length"), *(outcomes or []), "vector")


def lag_columns(vectors: DataFrame, features: list[str], length: int) -> DataFrame:
    """Export form: one column for each feature and lag, lag 0 being the last row."""
    lags = [F.element_at("vector", k * length + length - lag).alias(f"{f}_lag_{lag}") for k, f in enumerate(features) for lag in range(length - 1, -1, -1)]
    return vectors.select(*[c for c in vectors.columns if c != "vector"], *lags)


def lag_rows(vectors: DataFrame, features: list[str], length: int) -> DataFrame:
    """Plot form: (feature, lag, value) rows, oldest first."""
    out = vectors.select("symbol", "window_end_ts", F.posexplode("vector").alias("at", "value"))
    names = F.array(*[F.lit(f) for f in features])
    return out.select("symbol", "window_end_ts", F.element_at(names, (F.floor(F.col("at") / length) + 1).cast("int")).alias("feature"), (length - 1 - F.col("at") % length).alias("lag"), "value")
