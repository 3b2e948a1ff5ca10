"""Classification and regression metrics as distributed aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from .stats import rank_over_all, ranges

EPSILON = 2.220446049250313e-16


def confusion(df: DataFrame, label: str, score: str, thresholds: list[float] | None = None) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 for each threshold (0.5 by default); quotients by zero are 0."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds or [0.5]]))
    y, p = F.col(label) == 1, F.col(score) >= F.col("threshold")
    out = df.select(label, score, t.alias("threshold")).groupBy("threshold").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    c = F.col
    out = out.withColumns({"accuracy": safe_ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")), "precision": safe_ratio(c("tp"), c("tp") + c("fp")), "recall": safe_ratio(c("tp"), c("tp") + c("fn"))})
    return out.withColumn("f1", safe_ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


#: Bounds of the drop classifier's table (fixed values).
DROP_THRESHOLDS = [0.03, 0.05, 0.07, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50]


def alarms(df: DataFrame, label: str, score: str, thresholds: list[float] | None = None) -> DataFrame:
    """For each threshold: alarms and their share of all rows, precision, recall, F1, caught events and false alarms."""
    c = confusion(df, label, score, thresholds or DROP_THRESHOLDS)
    n = F.col("tp") + F.col("fp")
    return c.select("threshold", n.alias("n_alarms"), safe_ratio(n, n + F.col("fn") + F.col("tn")).alias("alarm_ratio"), "precision", "recall", "f1", F.col("tp").alias("n_caught"), F.col("fp").alias("n_false_alarms"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from average ranks; null if one class is missing."""
    ranked = rank_over_all(df.select(label, score), score, "_r")
    p, n = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    ones = F.sum(F.when(F.col(label) == 1, F.col("_r")))
    return ranked.agg(F.try_divide(ones - p * (p + 1) / 2, p * n).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum of precision times gain in recall over distinct scores from the top."""
    per = df.groupBy(F.col(score).alias("_score")).agg(F.count_if(F.col(label) == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    parts = per.repartitionByRange(ranges(df), F.desc("_score")).withColumn("part", F.spark_partition_id())
    totals = parts.groupBy("part").agg(F.sum("k").alias("tk"), F.sum("n").alias("tn"))
    w = Window.orderBy("part")
    base = totals.select("part", (F.sum("tk").over(w) - F.col("tk")).alias("bk"), (F.sum("tn").over(w) - F.col("tn")).alias("bn"))
    own = Window.partitionBy("part").orderBy(F.desc("_score"))
    steps = parts.join(F.broadcast(base), "part").select("k", (F.col("bk") + F.sum("k").over(own)).alias("ck"), (F.col("bn") + F.sum("n").over(own)).alias("cn"))
    return steps.agg(F.try_divide(F.sum(F.col("k") * F.col("ck") / F.col("cn")), F.sum("k")).alias("average_precision"))


def log_loss(df: DataFrame, label: str, score: str) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(EPSILON)), F.lit(1 - EPSILON))
    return df.agg(F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"))


def regression(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE, R2 (null without variance), and the percentage of equal directions, zero counting as up."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    same = (F.col(actual) >= 0) == (F.col(predicted) >= 0)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"), (100 * F.avg(same.cast("int"))).alias("direction_accuracy"))
