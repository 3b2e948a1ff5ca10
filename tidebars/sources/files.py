"""Bar tables in files: typed reads, versioned writes, resumable collection."""

from __future__ import annotations

import json
import math
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import upsert
from ..schema import BARS
from ..storage import stored
from .klines import PAGE, KlineSource, normalise, reachable


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header and a given schema; unreadable cells are null."""
    return spark.read.schema(schema or BARS).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def latest_row(df: DataFrame, time: str = "window_end_ts") -> DataFrame:
    """The row of greatest time."""
    return df.orderBy(F.desc(time)).limit(1)


def latest_row_and_count(df: DataFrame, time: str = "window_end_ts") -> DataFrame:
    """The row of greatest time (of equal ones the greatest row) with ``n_rows``, the number of all rows, in one pass."""
    row = F.struct(time, *[c for c in df.columns if c != time])
    return df.agg(F.max(row).alias("r"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 0").select("r.*", "n_rows").select(*df.columns, "n_rows")


def write_version(df: DataFrame, base: str, partition_by: list[str] | None = None, now: datetime | None = None) -> str:
    """Write a new version beside earlier ones (a backup by construction) and return its path."""
    path = f"{base.rstrip('/')}/v={(now or datetime.now(timezone.utc)):%Y%m%d_%H%M%S}"
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(sections: dict[str, DataFrame | dict | list], path: str, most: int = 10_000) -> str:
    """One indented JSON document, a list of rows for each table, as a single text file; its text.

    Reports are summaries: a table of more than ``most`` rows is an error, as it would not fit a document. Times are ISO texts, NaN and infinities null.
    """
    whole, spark = {}, None
    for name, part in sections.items():
        if isinstance(part, DataFrame):
            spark = part.sparkSession
            rows = part.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"{name} has more than {most} rows")
            whole[name] = [_plain(r.asDict(True)) for r in rows]
        else:
            whole[name] = _plain(part)
    text = json.dumps(whole, indent=2, ensure_ascii=False)
    spark = spark or SparkSession.getActiveSession()
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def _plain(x):
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if x is None or isinstance(x, (bool, int, float, str)) else x.isoformat() if hasattr(x, "isoformat") else str(x)


def resume_from(df: DataFrame, step: str = "INTERVAL 1 MINUTE") -> DataFrame:
    """Where collection goes on for each symbol: one step after its last bar."""
    return df.groupBy("symbol").agg((F.max("ts") + F.expr(step)).alias("start_ts"))


def completed(df: DataFrame, now: datetime, duration: str = "1 minute") -> DataFrame:
    """Without the bar that is still forming at ``now``."""
    return df.where(F.col("ts") < F.window(F.lit(now).cast("timestamp_ntz"), duration).start)


def collect(existing: DataFrame | None, new: DataFrame, refresh: bool = False) -> DataFrame:
    """Existing bars win over new ones; a refresh takes the new ones alone."""
    return new if existing is None or refresh else upsert(existing, new)


def max_history(spark: SparkSession, base: str, symbol: str, fetch: str, end_ms: int, refresh: bool, batches: int = 1_000, side_by_side: bool = False, **options: str) -> str:
    """Collect all there is of a symbol by walking back from ``end_ms``, and write it as a new version beside the earlier ones; its path.

    ``side_by_side``: the earliest bar is found by probes and all pages are fetched at once, with the rows that the walk gives.

    The new history replaces what was collected before, so it needs ``refresh``.
    """
    check_modes(full=True, refresh=refresh, max_batches=batches)
    spark.dataSource.register(KlineSource)
    raw = spark.read.format("klines").options(symbol=symbol, fetch=fetch, end_ms=end_ms, mode="history_ranges" if side_by_side else "history", batches=batches, **options).load()
    bars = normalise(raw, end_ms=end_ms)
    return write_version(reachable(stored(bars, "history"), int(options.get("page", PAGE))) if side_by_side else bars, base)


def check_modes(update: bool = False, full: bool = False, refresh: bool = False, days: int | None = None, max_batches: int = 1_000) -> None:
    """Collection options that exclude or need one another, and their ranges."""
    clashes = {"update and refresh": update and refresh, "update and days": update and days is not None, "full and update": full and update, "full and days": full and days is not None, "full without refresh": full and not refresh}
    for names, bad in clashes.items():
        if bad:
            raise ValueError(f"not allowed: {names}")
    if days is not None and days <= 0 or max_batches <= 0:
        raise ValueError("days and max_batches must be positive")
