"""Indicator features of bars and of completed bars of longer timeframes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag, pct_change, prefix_mean, rolling, rsi, series

MAIN_FEATURES = [
    "return_1", "return_3", "return_5", "return_10", "ma_20", "ma_60", "ma_120", "ma_distance_20", "ma_distance_60", "volatility_20", "volatility_60",
    "rsi_14", "volume_change_1", "volume_ma_20", "high_low_range", "close_open_return",
]
AUX_FEATURES = ["return_1", "ma_20", "ma_60", "ma_distance_20", "trend"]


def main_features(bars: DataFrame) -> DataFrame:
    """The sixteen features of a bar. All windows share one partitioning by symbol, so there is one shuffle."""
    w, close = series(), F.col("close")
    out = bars.withColumns({f"return_{k}": pct_change(close, k, w) for k in (1, 3, 5, 10)})
    out = out.withColumns({f"ma_{n}": rolling(F.avg, close, n, w) for n in (20, 60, 120)} | {f"volatility_{n}": rolling(F.stddev_samp, F.col("return_1"), n, w) for n in (20, 60)})
    return out.withColumns(
        {f"ma_distance_{n}": F.try_divide(close, F.col(f"ma_{n}")) - 1 for n in (20, 60)}
        | {
            "rsi_14": rsi(close, 14, w), "volume_change_1": pct_change(F.col("volume"), 1, w), "volume_ma_20": rolling(F.avg, F.col("volume"), 20, w),
            "high_low_range": F.try_divide(F.col("high") - F.col("low"), close), "close_open_return": F.try_divide(close, F.col("open")) - 1,
        }
    )


def aux_features(bars: DataFrame, prefix: str, duration: str) -> DataFrame:
    """Features of a longer timeframe, stamped with the close of their bar: what is known at that time. Complete rows only."""
    w, close = series(), F.col("close")
    out = bars.withColumns({"return_1": pct_change(close, 1, w), "ma_20": rolling(F.avg, close, 20, w), "ma_60": rolling(F.avg, close, 60, w)})
    out = out.withColumns({"ma_distance_20": F.try_divide(close, F.col("ma_20")) - 1, "trend": flag(F.col("ma_20") > F.col("ma_60"))})
    return out.select("symbol", (F.col("ts") + F.expr(f"INTERVAL {duration}")).alias("ts"), *[F.col(c).alias(f"{prefix}_{c}") for c in AUX_FEATURES]).dropna()


def day_features(bars: DataFrame, sma: dict[str, int] | None = None) -> DataFrame:
    """The older feature set: close over long moving averages, RSI, Bollinger bandwidth, volume ratio, forward return."""
    w, close = series(), F.col("close")
    sma = sma or {"5d": 480, "20d": 1_920, "60d": 5_760}
    columns = {f"close_sma_{k}_ratio": F.try_divide(close, prefix_mean(close, n, w)) for k, n in sma.items()}
    columns |= {"rsi_14": rsi(close, 14, w), "bb_bandwidth_20": F.try_divide(4 * rolling(F.stddev_pop, close, 20, w), rolling(F.avg, close, 20, w)), "volume_ratio_20": F.try_divide(F.col("volume"), rolling(F.avg, F.col("volume"), 20, w)), "target": F.try_divide(F.lead(close, 16).over(w), close) - 1}
    return bars.withColumns(columns)
