"""Column expressions: guarded rolling windows over rows of a series, ratios, levels and similarity.

Series are ordered by ``ts`` within ``symbol``. A rolling value is null until its frame holds n non-null
values. Quotients are null for a zero divisor, never infinite or NaN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

BARS_A_YEAR = 35_040


def series(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("ts")


def pct_change(x: Column, k: int, w: WindowSpec) -> Column:
    return F.try_divide(x, F.lag(x, k).over(w)) - 1


def forward_return(x: Column, h: int, w: WindowSpec) -> Column:
    return F.try_divide(F.lead(x, h).over(w), x) - 1


def rolling(agg: Callable[[Column], Column], x: Column, n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def ahead(agg: Callable[[Column], Column], x: Column, h: int, w: WindowSpec) -> Column:
    """Aggregate of the next h rows, the current one excluded."""
    frame = w.rowsBetween(1, h)
    return F.when(F.count(x).over(frame) == h, agg(x).over(frame))


def prefix_mean(x: Column, n: int, w: WindowSpec) -> Column:
    """Rolling mean as a difference of running sums: its cost does not grow with n. For long frames."""
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    total, count = F.coalesce(F.sum(x).over(run), F.lit(0.0)), F.count(x).over(run)
    before = lambda c, zero: F.coalesce(F.lag(c, n).over(w), F.lit(zero))
    return F.when((count - before(count, 0)) == n, (total - before(total, 0.0)) / n)


def rsi(x: Column, n: int, w: WindowSpec) -> Column:
    """Relative strength from simple means: 100 without losses, 50 without any move."""
    step = x - F.lag(x, 1).over(w)
    gain, loss = rolling(F.avg, F.greatest(step, F.lit(0.0)), n, w), rolling(F.avg, F.greatest(-step, F.lit(0.0)), n, w)
    full = F.count(step).over(w.rowsBetween(-(n - 1), 0)) == n
    return F.when(full, F.when(loss == 0, F.when(gain == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + F.try_divide(gain, loss))))


def flag(condition: Column) -> Column:
    """1 or 0; unknown counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def safe_ratio(a: Column, b: Column) -> Column:
    """Quotient, or 0 for a zero divisor."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite(x: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(is_finite(x), x)


def risk_level(x: Column, high: float, middle: float) -> Column:
    return F.when(x >= high, "HIGH").when(x >= middle, "MEDIUM").otherwise("LOW")


def volatility_level(x: Column) -> Column:
    return risk_level(x, 0.60, 0.40)


def drop_level(x: Column) -> Column:
    return risk_level(x, 0.15, 0.07)


def direction_hint(up: Column) -> Column:
    return F.when(up >= 0.60, "BULLISH_HINT").when(up <= 0.40, "BEARISH_HINT").otherwise("NO_CLEAR_EDGE")


def action_hint(volatility: Column, drop: Column) -> Column:
    """Advice from two levels. A HIGH drop level without HIGH volatility gives NORMAL: only MEDIUM is looked at there."""
    tense = volatility == "HIGH"
    return F.when(tense & drop.isin("MEDIUM", "HIGH"), "NO_TRADE").when(tense | (drop == "MEDIUM"), "CAUTION").otherwise("NORMAL")


def position_number(position: Column) -> Column:
    return F.when(position == "Long", 1).when(position == "Short", -1).otherwise(0)


def annualised_return(total: Column, bars: Column) -> Column:
    """-1 for a total loss; a year has 35,040 bars of a quarter hour."""
    return F.when(total <= -1, -1.0).when(bars > 0, F.pow(1 + total, F.lit(float(BARS_A_YEAR)) / bars) - 1)
