"""Equity, drawdown, trades and threshold backtests. Sweeps put all parameters into one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import BARS_A_YEAR, annualised_return, safe_ratio

SIGNAL_THRESHOLDS, SIGNAL_FEE = [0.55, 0.60, 0.65, 0.70, 0.75], 0.0006
RISK_THRESHOLDS, RISK_FEE, EXPOSURES = [0.30, 0.40, 0.50, 0.60, 0.70, 0.80], 0.0006, {"cash": 0.0, "half": 0.5}
#: (name, volatility bound, drop bound)
RISK_FILTERS = [("hv040_drop007", 0.40, 0.07), ("hv050_drop010", 0.50, 0.10), ("hv060_drop015", 0.60, 0.15)]
DAY, WEEK = 96, 672


def _runs(*keys: str) -> tuple[WindowSpec, WindowSpec]:
    w = Window.partitionBy(*keys).orderBy("ts")
    return w, w.rowsBetween(Window.unboundedPreceding, 0)


def equity(df: DataFrame, r: str = "r", keys: tuple[str, ...] = ("symbol",), name: str = "equity") -> DataFrame:
    """Compounded growth; the start at 1 is not a row and not a peak."""
    return df.withColumn(name, F.product(1 + F.col(r)).over(_runs(*keys)[1]))


def drawdown(df: DataFrame, column: str = "equity", keys: tuple[str, ...] = ("symbol",), name: str = "drawdown") -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(column), F.max(column).over(_runs(*keys)[1])) - 1)


def worst_rolling(df: DataFrame, n: int, r: str = "r", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Least compounded return of n neighbouring rows; shorter frames at the start count."""
    frame = _runs(*keys)[0].rowsBetween(-(n - 1), 0)
    return df.withColumn("_c", F.product(1 + F.col(r)).over(frame) - 1).groupBy(*keys).agg(F.min("_c").alias(f"worst_{n}"))


def delayed(signal: Column, w: WindowSpec, first: float) -> Column:
    """What was decided a row ago; ``first`` ahead of any decision."""
    return F.coalesce(F.lag(signal, 1).over(w), F.lit(first))


def change(position: Column, w: WindowSpec, first: Column | None = None) -> Column:
    return F.coalesce(F.abs(position - F.lag(position, 1).over(w)), F.lit(0.0) if first is None else first)


def trades(df: DataFrame, keys: tuple[str, ...] = ("symbol",), r: str = "gross") -> DataFrame:
    """Compounded gross return of each run of rows with position 1, an open one at the end included."""
    w, run = _runs(*keys)
    starts = (F.col("position") == 1) & (F.coalesce(F.lag("position").over(w), F.lit(0)) != 1)
    marked = df.withColumn("trade_id", F.sum(starts.cast("int")).over(run)).where("position = 1")
    return marked.groupBy(*keys, "trade_id").agg(F.min("ts").alias("entry_ts"), F.count(F.lit(1)).alias("n_bars"), (F.product(1 + F.col(r)) - 1).alias("trade_return"))


def threshold_detail(df: DataFrame, proba: str, r: str, thresholds: list[float], fee: float = SIGNAL_FEE) -> DataFrame:
    """Rows of the long-or-cash test for every threshold; a signal acts one row later."""
    every = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    w, _ = _runs("symbol", "threshold")
    every = every.withColumn("position", delayed((F.col(proba) >= F.col("threshold")).cast("int"), w, 0).cast("int"))
    every = every.withColumns({"gross": F.col("position") * F.col(r), "trade": change(F.col("position"), w, F.col("position")).cast("int")})
    return every.withColumn("strategy_return", F.col("gross") - F.col("trade") * fee)


def threshold_backtest(df: DataFrame, proba: str = "pred_proba_up", r: str = "target_return_next", thresholds: list[float] | None = None, fee: float = SIGNAL_FEE) -> DataFrame:
    """One summary row for each symbol and threshold. ``number_of_trades`` counts changes of position."""
    keys = ("symbol", "threshold")
    rows = threshold_detail(df, proba, r, thresholds or SIGNAL_THRESHOLDS, fee)
    rows = drawdown(equity(rows, "strategy_return", keys), "equity", keys)
    base = rows.groupBy(*keys).agg((F.product(1 + F.col("strategy_return")) - 1).alias("total_return"), (F.product(1 + F.col(r)) - 1).alias("buy_and_hold_return"), F.min("drawdown").alias("max_drawdown"), F.sum("trade").alias("number_of_trades"))
    t, won, lost = F.col("trade_return"), F.col("trade_return") > 0, F.col("trade_return") < 0
    per = trades(rows, keys).groupBy(*keys).agg(F.count(t).alias("completed_trades"), F.count_if(won).alias("n_won"), F.avg(F.when(won, t)).alias("average_win"), F.avg(F.when(lost, t)).alias("average_loss"), F.avg(t).alias("expected_value_per_trade"), F.sum(F.when(won, t)).alias("profit"), F.abs(F.sum(F.when(lost, t))).alias("loss"))
    out = base.join(per, list(keys), "left").fillna(0, ["completed_trades", "n_won"]).fillna(0.0, ["average_win", "average_loss", "expected_value_per_trade", "profit", "loss"])
    factor = F.when(F.col("loss") > 0, F.try_divide("profit", "loss")).when(F.col("profit") > 0, float("inf")).otherwise(0.0)
    return out.withColumns({"win_rate": safe_ratio(F.col("n_won"), F.col("completed_trades")), "profit_factor": factor}).drop("n_won", "profit", "loss")


def best_threshold(summary: DataFrame) -> DataFrame:
    """For each symbol the best row by return, then drawdown, then profit factor (an infinite one counts as 1e6)."""
    factor = F.when(F.col("profit_factor") == float("inf"), 1e6).otherwise(F.col("profit_factor"))
    w = Window.partitionBy("symbol").orderBy(F.desc("total_return"), F.desc("max_drawdown"), factor.desc(), F.asc("threshold"))
    return summary.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def risk_filter_sweep(df: DataFrame, proba: str = "pred_proba_high_vol", r: str = "target_return_next", thresholds: list[float] | None = None, exposures: dict[str, float] | None = None, fee: float = RISK_FEE) -> DataFrame:
    """Always invested, but with a smaller position when risk was high a row ago: summaries by strategy and threshold."""
    keys = ("symbol", "strategy", "threshold")
    kinds = F.array(*[F.struct(F.lit(n).alias("strategy"), F.lit(x).alias("exposure"), F.lit(t).alias("threshold")) for n, x in (exposures or EXPOSURES).items() for t in thresholds or RISK_THRESHOLDS])
    rows = df.withColumn("_p", F.explode(kinds)).select("*", "_p.*").drop("_p")
    w, _ = _runs(*keys)
    rows = rows.withColumn("position", delayed(F.when(F.col(proba) >= F.col("threshold"), F.col("exposure")).otherwise(1.0), w, 1.0))
    rows = rows.withColumn("changed", change(F.col("position"), w)).withColumn("fee", F.col("changed") * fee)
    rows = rows.withColumn("strategy_return", F.col("position") * F.col(r) - F.col("fee"))
    rows = drawdown(equity(rows, "strategy_return", keys), "equity", keys)
    rows = drawdown(equity(rows, r, keys, "bh"), "bh", keys, "bh_drawdown")
    off = F.col("position") < 1
    actual = lambda c: F.col(c) == 1
    hv, dp, bm = actual("target_volatility_high_next_4"), actual("target_drop_next_4"), actual("target_big_move_next_4")
    worst = {f"worst_{d}_return": (F.product(1 + F.col("strategy_return")).over(w.rowsBetween(-(n - 1), 0)) - 1) for d, n in (("1d", DAY), ("7d", WEEK))}
    out = rows.withColumns(worst).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.product(1 + F.col("strategy_return")) - 1).alias("total_return"), (F.product(1 + F.col(r)) - 1).alias("buy_and_hold_return"),
        F.min("drawdown").alias("max_drawdown"), F.min("bh_drawdown").alias("buy_and_hold_max_drawdown"), (F.stddev_pop("strategy_return") * F.sqrt(F.lit(float(BARS_A_YEAR)))).alias("annualized_volatility"),
        F.avg("position").alias("exposure_ratio"), F.avg(off.cast("int")).alias("risk_off_ratio"), F.count_if(F.col("changed") > 0).alias("number_of_position_changes"), F.sum("fee").alias("total_fee_paid"),
        *[F.min(c).alias(c) for c in worst], F.count_if(off).alias("_off"), *[F.count_if(c).alias(f"_{k}") for k, c in (("hv", hv), ("dp", dp), ("bm", bm))], *[F.count_if(off & c).alias(f"_off_{k}") for k, c in (("hv", hv), ("dp", dp), ("bm", bm))],
    )
    c = F.col
    out = out.withColumns({
        "excess_return_vs_bh": c("total_return") - c("buy_and_hold_return"), "mdd_improvement": c("max_drawdown") - c("buy_and_hold_max_drawdown"), "annualized_return": annualised_return(c("total_return"), c("n")),
        "average_position": c("exposure_ratio"), "avoided_high_vol_ratio": safe_ratio(c("_off_hv"), c("_hv")), "missed_high_vol_ratio": safe_ratio(c("_hv") - c("_off_hv"), c("_hv")), "risk_off_precision": safe_ratio(c("_off_hv"), c("_off")),
        "risk_off_recall": safe_ratio(c("_off_hv"), c("_hv")), "avoided_drop_ratio": safe_ratio(c("_off_dp"), c("_dp")), "risk_off_during_big_move_ratio": safe_ratio(c("_off_bm"), c("_bm")),
    })
    out = out.withColumn("sharpe_like", F.when(c("annualized_volatility") > 0, c("annualized_return") / c("annualized_volatility")))
    return out.drop("n", *[x for x in out.columns if x[0] == "_"])


def similarity_filters(results: DataFrame, r: str = "actual_return_next_4", filters: list[tuple[str, float, float]] | None = None, fee: float = RISK_FEE) -> DataFrame:
    """Diagnostics of staying out when similar windows were volatile or fell, by filter (name, volatility, drop)."""
    keys = ("symbol", "filter_name")
    kinds = F.array(*[F.struct(F.lit(n).alias("filter_name"), F.lit(a).alias("threshold_high_vol"), F.lit(b).alias("threshold_drop")) for n, a, b in filters or RISK_FILTERS])
    rows = results.withColumn("_p", F.explode(kinds)).select("*", "_p.*").drop("_p")
    w, _ = _runs(*keys)
    stay = ~((F.col("similar_high_vol_ratio") >= F.col("threshold_high_vol")) | (F.col("similar_drop_ratio") >= F.col("threshold_drop")))
    rows = rows.withColumn("position", delayed(stay.cast("double"), w, 1.0)).withColumn("changed", change(F.col("position"), w))
    rows = rows.withColumn("strategy_return", F.col("position") * F.col(r) - F.col("changed") * fee)
    rows = drawdown(equity(equity(rows, "strategy_return", keys), r, keys, "bh"), "equity", keys)
    rows = drawdown(rows, "bh", keys, "bh_drawdown")
    off = F.col("position") < 1
    return rows.groupBy(*keys, "threshold_high_vol", "threshold_drop").agg(
        (F.product(1 + F.col("strategy_return")) - 1).alias("total_return"), (F.product(1 + F.col(r)) - 1).alias("buy_and_hold_return"), F.min("drawdown").alias("max_drawdown"), F.min("bh_drawdown").alias("buy_and_hold_max_drawdown"),
        F.avg("position").alias("exposure_ratio"), F.avg(off.cast("int")).alias("risk_off_ratio"), F.count_if(F.col("changed") > 0).alias("number_of_position_changes"), (F.sum("changed") * fee).alias("total_fee_paid"),
        F.avg(F.when(~off, F.col(r))).alias("avg_return_when_risk_on"), F.avg(F.when(off, F.col(r))).alias("avg_return_when_risk_off"),
        F.avg(F.when(off, F.col("actual_high_vol"))).alias("actual_high_vol_rate_when_risk_off"), F.avg(F.when(off, F.col("actual_drop"))).alias("actual_drop_rate_when_risk_off"),
    )


def zero_threshold_changes(df: DataFrame, pred: str = "y_pred") -> DataFrame:
    """How often the sign of the prediction switches a long-or-cash position, starting in cash."""
    w, _ = _runs("symbol")
    long = (F.col(pred) > 0).cast("int")
    return df.withColumn("_c", F.abs(long - F.coalesce(F.lag(long).over(w), F.lit(0)))).groupBy("symbol").agg(F.sum("_c").alias("n_changes"))
