"""One long series over many tasks: halo windows, scans by summaries, and as-of joins across ranges.

A range sort gives every row its place in the series of its key; a chunk is a fixed number of neighbouring
places. Windows of bounded reach run in chunks that repeat a few rows of their neighbours (``halo``). What depends
on all rows before is computed inside each chunk, summed up to one row for each chunk, carried through those few
rows, and put together with the inner values (``carried``). Nothing is ever shuffled by the key alone but the
summaries, so a table of one key is worked on by as many tasks as it has chunks.

``time`` orders the rows of a key and is taken to be unique within it; null keys are a key of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .joins import null_safe_join

#: Rows of a chunk.
ROWS = 50_000


def numbered(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Rows with ``_pos``, their place from 0 in the series of their key. They are sorted by range and written once."""
    by = [*keys, *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_piece"), F.monotonically_increasing_id().alias("_at"))
    placed = stored(placed, "ranges")
    pieces = placed.groupBy(*keys, "_piece").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each key and range
    starts = pieces.select(*keys, "_piece", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    return null_safe_join(placed, starts, [*keys, "_piece"]).withColumn("_pos", F.col("_at") + F.col("_start")).drop("_piece", "_at", "_start")


def chunked(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",), rows: int | None = None) -> DataFrame:
    """Rows with ``_pos`` and ``_chunk``."""
    return numbered(df, keys, order).withColumn("_chunk", F.floor(F.col("_pos") / (rows or ROWS)).cast("long"))


def halo(df: DataFrame, apply: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, rows: int | None = None, key: str = "symbol", time: str = "ts", out_time: str = "ts") -> DataFrame:
    """``apply`` on chunks of each series, with the ``back`` rows before and the ``ahead`` rows after a chunk put to it.

    Inside ``apply`` the column ``key`` names series and chunk, so windows by it see the chunk and its halo only. Right for
    everything whose rows depend on no more than ``back`` rows before and ``ahead`` rows after them. ``out_time`` is the column of the
    result that holds a row's time.
    """
    size = rows or ROWS
    placed = numbered(df, (key,), (time,))
    own = F.floor(F.col("_pos") / size)
    bounds = placed.groupBy(key, own.alias("_chunk")).agg(F.min(time).alias("_low"), F.max(time).alias("_high"))
    near = F.sequence(F.floor(F.greatest(F.col("_pos") - ahead, F.lit(0)) / size), F.floor((F.col("_pos") + back) / size))
    spread = null_safe_join(placed.withColumn("_chunk", F.explode(near)), bounds, [key, "_chunk"])
    within = spread.withColumn(key, F.struct(F.col(key).alias("own"), "_chunk", F.col("_low").alias("low"), F.col("_high").alias("high"))).drop("_pos", "_chunk", "_low", "_high")
    return apply(within).where(F.col(out_time).between(F.col(f"{key}.low"), F.col(f"{key}.high"))).withColumn(key, F.col(f"{key}.own"))


def carried(df: DataFrame, keys: tuple[str, ...], summaries: dict[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
    """Chunked rows with what is known of all chunks before: (summary of a chunk, aggregate over those summaries) by name; null in the first."""
    each = df.groupBy(*keys, "_chunk").agg(*[s.alias(n) for n, (s, _) in summaries.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each key and chunk
    known = each.select(*keys, "_chunk", *[f(n).over(before).alias(n) for n, (_, f) in summaries.items()])
    return null_safe_join(df, known, [*keys, "_chunk"])


def _run(keys: tuple[str, ...]):
    w = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    return w, w.rowsBetween(Window.unboundedPreceding, 0)


def equity_scan(chunks: DataFrame, r: str = "r", keys: tuple[str, ...] = ("symbol",), name: str = "equity") -> DataFrame:
    """Compounded growth of chunked rows, as ``backtest.equity``."""
    out = carried(chunks, keys, {"_grown": (F.product(1 + F.col(r)), F.product)})
    inner = F.product(1 + F.col(r)).over(_run(keys)[1])
    return out.withColumn(name, F.coalesce(F.col("_grown") * inner, F.col("_grown"), inner)).drop("_grown")


def drawdown_scan(chunks: DataFrame, column: str = "equity", keys: tuple[str, ...] = ("symbol",), name: str = "drawdown") -> DataFrame:
    """Distance from the running peak of chunked rows, as ``backtest.drawdown``."""
    out = carried(chunks, keys, {"_peak": (F.max(column), F.max)})
    peak = F.greatest("_peak", F.max(column).over(_run(keys)[1]))
    return out.withColumn(name, F.try_divide(F.col(column), peak) - 1).drop("_peak")


def trades_scan(chunks: DataFrame, keys: tuple[str, ...] = ("symbol",), r: str = "gross", time: str = "ts") -> DataFrame:
    """Runs of rows with position 1, as ``backtest.trades``; a run may go through any number of chunks."""
    w, run = _run(keys)
    out = carried(chunks, keys, {"_last": (F.max_by("position", "_pos"), F.last)})
    before = F.coalesce(F.when(F.row_number().over(w) == 1, F.col("_last")).otherwise(F.lag("position").over(w)), F.lit(0))
    out = out.withColumn("_starts", ((F.col("position") == 1) & (before != 1)).cast("int")).drop("_last")
    out = carried(out, keys, {"_trades": (F.sum("_starts"), F.sum)})
    out = out.withColumn("trade_id", F.coalesce("_trades", F.lit(0)) + F.coalesce(F.sum("_starts").over(run), F.lit(0))).where("position = 1")
    return out.groupBy(*keys, "trade_id").agg(F.min(time).alias("entry_ts"), F.count(F.lit(1)).alias("n_bars"), (F.product(1 + F.col(r)) - 1).alias("trade_return"))


def asof_join_ranges(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("symbol",), time: str = "ts", rows: int | None = None) -> DataFrame:
    """Each left row with the last right row of its key whose time is not later, as ``joins.asof_join``, in chunks of both sides merged by time."""
    values, own = ([c for c in df.columns if c not in (*keys, time)] for df in (right, left))
    typed = lambda df, names: df.select(F.struct(*names).alias("v")).schema["v"].dataType
    a = left.select(*keys, time, F.lit(1).alias("_side"), F.struct(*own).alias("_own"), F.lit(None).cast(typed(right, values)).alias("_seen"))
    b = right.select(*keys, time, F.lit(0).alias("_side"), F.lit(None).cast(typed(left, own)).alias("_own"), F.struct(*values).alias("_seen"))
    merged = chunked(a.unionByName(b), keys, (time, "_side", "_seen"), rows)
    last = F.max_by("_seen", F.when(F.col("_seen").isNotNull(), F.col("_pos")))
    out = carried(merged, keys, {"_before": (last, lambda c: F.last(c, ignorenulls=True))})
    seen = F.coalesce(F.last("_seen", ignorenulls=True).over(_run(keys)[1]), F.col("_before"))
    return out.withColumn("_seen", seen).where("_side = 1").select(*keys, time, "_own.*", "_seen.*")
