"""Resampling of bars or ticks to longer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Durations of the standard fan-out; each divides a day, so bins are aligned with the epoch.
TIMEFRAMES = {"5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}


def resample(df: DataFrame, duration: str, order: list[str] | None = None, price: str | None = None) -> DataFrame:
    """Bars of the duration, closed and labelled left, partial first and last ones included, empty ones absent.

    From bars, or from ticks if ``price`` names their price column. First and last values skip nulls and go by
    ``order`` (ts by default); sums of nothing are 0; bars without a price are dropped. One shuffle by
    (symbol, bin) after map-side aggregation.
    """
    order = order or ["ts"]
    o, h, lo, c = (price,) * 4 if price else ("open", "high", "low", "close")

    def edge(pick, column: str) -> Column:
        key = F.struct(*order)
        return pick(column, F.when(F.col(column).isNotNull(), key))

    grouped = df.groupBy("symbol", F.window("ts", duration).alias("bin")).agg(
        edge(F.min_by, o).alias("open"), F.max(h).alias("high"), F.min(lo).alias("low"), edge(F.max_by, c).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"), F.coalesce(F.sum("turnover"), F.lit(0.0)).alias("turnover"),
    )
    return grouped.select("symbol", F.col("bin.start").alias("ts"), "open", "high", "low", "close", "volume", "turnover").dropna(subset=["open", "high", "low", "close"])


def fan_out(df: DataFrame, **options) -> dict[str, DataFrame]:
    """All standard timeframes, each from the source itself and not from one another."""
    return {name: resample(df, duration, **options) for name, duration in TIMEFRAMES.items()}
