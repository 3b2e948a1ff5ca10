"""Cleaning, deduplication and quality reports of bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import series
from ..schema import require_columns

VALUES = ["open", "high", "low", "close", "volume", "turnover"]


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order; the order must be total for a defined survivor."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def coerce(df: DataFrame, numbers: list[str], time: str = "ts") -> DataFrame:
    """Unreadable times and numbers become null."""
    return df.withColumns({time: F.col(time).try_cast("timestamp_ntz")} | {c: F.col(c).try_cast("double") for c in numbers})


def clean_bars(raw: DataFrame, sequence: str, values: list[str] | None = None) -> DataFrame:
    """Bars with readable time, one for each (symbol, ts): the one of least ``sequence``, its place in the input."""
    values = values or [c for c in VALUES if c in raw.columns]
    rows = coerce(require_columns(raw, ["symbol", "ts", *values, sequence]), values).where("ts IS NOT NULL")
    return keep_first(rows, ["symbol", "ts"], [sequence]).drop(sequence)


def removed_rows(raw: DataFrame) -> DataFrame:
    """How many rows ``clean_bars`` drops for each symbol: unreadable times and repeats."""
    ts = F.col("ts").try_cast("timestamp_ntz")
    return raw.groupBy("symbol").agg((F.count(F.lit(1)) - F.count_distinct(ts)).alias("removed"))


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without null, NaN or infinity in the columns (all numeric ones by default)."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    keep = F.lit(True)
    for c in columns:
        keep &= F.col(c).isNotNull()
        if kinds[c] in ("double", "float"):
            keep &= ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.where(keep)


def gaps(bars: DataFrame, expected: str = "INTERVAL 1 MINUTE", other_than: bool = False) -> DataFrame:
    """Neighbouring rows further apart than expected (or, with ``other_than``, not exactly that far)."""
    before = F.lag("ts").over(series())
    step = F.expr(expected)
    rows = bars.select("symbol", before.alias("previous_ts"), "ts").where("previous_ts IS NOT NULL")
    apart = F.col("ts") - F.col("previous_ts")
    return rows.where(apart != step if other_than else apart > step).withColumn("gap_seconds", F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("previous_ts").cast("timestamp")))


def quality_report(bars: DataFrame, expected: str = "INTERVAL 1 MINUTE") -> DataFrame:
    """For each symbol: rows, first and last time, repeats after the first, null cells, steps that are not ``expected``."""
    cells = [c for c in bars.columns if c != "symbol"]
    nulls = sum((F.col(c).isNull().cast("int") for c in cells), F.lit(0))
    step = F.col("ts") - F.lag("ts").over(series())
    marked = bars.withColumns({"_nulls": nulls, "_odd": F.coalesce((step != F.expr(expected)).cast("int"), F.lit(0))})
    return marked.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        (F.count("ts") - F.count_distinct("ts") + F.greatest(F.count_if(F.col("ts").isNull()) - 1, F.lit(0))).alias("duplicates"),
        F.sum("_nulls").alias("null_cells"), F.sum("_odd").alias("odd_steps"),
    )


def upsert(existing: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Union in which existing rows win over new ones of the same key."""
    keys = keys or ["symbol", "ts"]
    both = existing.withColumn("_source", F.lit(0)).unionByName(new.withColumn("_source", F.lit(1)))
    values = [c for c in both.columns if c not in (*keys, "_source")]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct("_source", *values)).alias("v")).select(*keys, "v.*")
