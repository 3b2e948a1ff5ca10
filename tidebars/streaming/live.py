"""Bars of a stream of ticks or minute bars, and upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.clean import upsert


def streaming_bars(ticks: DataFrame, duration: str, price: str = "price", order: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Closed bars of a stream (symbol, ts timestamp, price, volume, turnover, order): late by at most ``delay``, repeats dropped.

    State is one row for each open bar and the keys within the watermark; bars come out when the watermark
    passes their end, so the still-forming one never does.
    """
    rows = ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", order])
    key = F.struct("ts", order)
    bars = rows.groupBy("symbol", F.window("ts", duration).alias("bin")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover")
    )
    return bars.select("symbol", F.col("bin.start").alias("ts"), "open", "high", "low", "close", "volume", "turnover")


def upsert_each_batch(stream: DataFrame, read, write, checkpoint: str) -> DataStreamWriter:
    """Merge every micro-batch into a stored table: ``read()`` gives it, ``write(df, batch)`` replaces it. Stored rows win."""

    def merge(batch: DataFrame, number: int) -> None:
        write(upsert(read(), batch), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
