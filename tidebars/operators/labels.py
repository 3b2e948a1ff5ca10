"""Forward-looking labels. Positions count rows of the given table, whatever time lies between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ahead, flag, forward_return, pct_change, series
from ..storage import stored
from .clean import drop_incomplete
from .joins import null_safe_join

#: Size of a big move by horizon in bars.
THRESHOLDS = {4: 0.01, 16: 0.02, 96: 0.04}


def next_bar(bars: DataFrame) -> DataFrame:
    """Return to the next row and whether it is up; the last row has no return and the flag 0."""
    r = forward_return(F.col("close"), 1, series())
    return bars.withColumns({"target_return_next": r, "target_up_next": flag(r > 0)})


def quantile(df: DataFrame, column: str, q: float, keys: tuple[str, ...] = ("symbol",), accuracy: int = 10_000) -> DataFrame:
    """Exact quantile by linear interpolation over the whole column of each key, in column ``q``; nulls do not count.

    Selection by counts of ranges: a sketch gives a narrow range of values around the wanted rank, a second pass counts
    the rows below and inside it, and a third counts the distinct values inside only, whose running counts hold the
    rank. No task holds a key's column, however long it is; a value that is repeated any number of times is one row. A range
    that turns out not to hold the rank is widened to all values.
    """
    values = df.select(*keys, F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL")
    shares = [max(0.0, q - 3 / accuracy), min(1.0, q + 3 / accuracy)]
    near = values.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", shares, accuracy).alias("_b"))
    near = near.select(*keys, "_n", (q * (F.col("_n") - 1)).alias("_at"), F.col("_b")[0].alias("_low"), F.col("_b")[1].alias("_high"))
    near = near.withColumns({"_first": F.floor("_at"), "_last": F.ceil("_at")})
    known = [*keys, "_n", "_at", "_first", "_last", "_low", "_high"]
    both = null_safe_join(values, near, list(keys))
    counted = both.groupBy(*known).agg(F.count_if(F.col("_v") < F.col("_low")).alias("_below"), F.count_if(F.col("_v") <= F.col("_high")).alias("_upto"))
    holds = (F.col("_below") <= F.col("_first")) & (F.col("_last") < F.col("_upto"))
    counted = counted.withColumn("_holds", holds).withColumn("_below", F.when(holds, F.col("_below")).otherwise(F.lit(0)))
    inside = null_safe_join(values, counted, list(keys)).where(~F.col("_holds") | F.col("_v").between(F.col("_low"), F.col("_high")))
    inside = inside.groupBy(*keys, "_v", "_at", "_first", "_last", "_below").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))  # streams through the values inside
    inside = inside.withColumn("_upto", upto)
    at = lambda rank: F.min(F.when(F.col("_upto") > F.col(rank), F.col("_v")))
    found = inside.groupBy(*keys, "_at", "_first", "_last").agg(at("_first").alias("_a"), at("_last").alias("_z"))
    mixed = (F.col("_last") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.col("_first")) * F.col("_z")
    return found.select(*keys, F.when(F.col("_first") == F.col("_last"), F.col("_a")).otherwise(mixed).alias("q"))


def horizon_labels(df: DataFrame, h: int, threshold: float | None = None, q: float = 0.70) -> DataFrame:
    """The seven labels of a horizon: return, its size, volatility, big move, drop, pump, high volatility.

    High volatility is measured against the quantile of the whole column, rows that are dropped later included.
    """
    w, close, t = series(), F.col("close"), THRESHOLDS[h] if threshold is None else threshold
    r = forward_return(close, h, w)
    out = df.withColumn("_r", pct_change(close, 1, w)).withColumns({f"target_return_next_{h}": r, f"target_volatility_next_{h}": ahead(F.stddev_samp, F.col("_r"), h, w)}).drop("_r")
    r, v = F.col(f"target_return_next_{h}"), F.col(f"target_volatility_next_{h}")
    out = stored(out, "labels")  # read by each pass of the quantile
    out = null_safe_join(out, quantile(out, f"target_volatility_next_{h}", q), ["symbol"], "left")
    out = out.withColumns({f"target_abs_return_next_{h}": F.abs(r), f"target_big_move_next_{h}": flag(F.abs(r) >= t), f"target_drop_next_{h}": flag(r <= -t), f"target_pump_next_{h}": flag(r >= t)})
    return out.withColumn(f"target_volatility_high_next_{h}", flag(v >= F.col("q"))).drop("q")


def risk_labels(features: DataFrame) -> DataFrame:
    return drop_incomplete(horizon_labels(features, 4))


def swing_labels(features: DataFrame) -> DataFrame:
    return drop_incomplete(horizon_labels(horizon_labels(features, 16), 96))


def class_ratios(df: DataFrame, label: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Counts and shares of both classes; a missing class counts 0."""
    one, all_rows = F.count_if(F.col(label) == 1), F.count(label)
    return df.groupBy(*keys).agg((all_rows - one).alias("n_0"), one.alias("n_1"), F.try_divide(all_rows - one, all_rows).alias("ratio_0"), F.try_divide(one, all_rows).alias("ratio_1"))
