"""Positional splits and samples of series, in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import series


def positions(df: DataFrame) -> DataFrame:
    """``rn`` from 1 in order of time and ``n``, for each symbol."""
    return df.withColumns({"rn": F.row_number().over(series()), "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})


def split_two(df: DataFrame, share: float = 0.8) -> DataFrame:
    return positions(df).withColumn("split", F.when(F.col("rn") <= F.floor(F.col("n") * share), "train").otherwise("test")).drop("rn", "n")


def split_three(df: DataFrame, train: float = 0.70, valid: float = 0.85) -> DataFrame:
    part = F.when(F.col("rn") <= F.floor(F.col("n") * train), "train").when(F.col("rn") <= F.floor(F.col("n") * valid), "valid").otherwise("test")
    return positions(df).withColumn("split", part).drop("rn", "n")


def split_periods(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def step_sample(df: DataFrame, step: int, most: int, start: float = 0.30) -> DataFrame:
    """Every ``step``-th row from ``start`` of the series on, the last ``most`` of them."""
    at = F.col("rn") - 1 - F.floor(F.col("n") * start)
    picked = positions(df).where((at >= 0) & (at % step == 0))
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return picked.withColumn("_back", back).where(F.col("_back") <= most).drop("_back", "rn", "n")
