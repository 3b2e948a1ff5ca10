"""Names of sampled suffixes by the difference-cover algorithm, with every step a Spark sort: triples are sorted by
range and named by their place, and names of longer prefixes are those of sorted triples of names.

This orders two thirds of all suffixes of a corpus, and moves each several times. ``suffix_dedup`` applies the same steps
to the suffixes that may repeat only, bucket by bucket; README gives the cost of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, spread_join, stored
from .superkmers import keyed

LETTER = 8


def named(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Add the dense rank of ``column`` over all rows, from 1: distinct values are sorted by range, then counted."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = stored(rows.select(column).distinct().repartitionByRange(ranges, column).select(column, F.spark_partition_id().alias("part")), "suffix-values")
    sizes = values.groupBy("part").count()  # a row for each range
    base = sizes.select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("base"))
    ranks = values.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy(column))).join(F.broadcast(base), "part")
    return spread_join(rows, ranks.select(column, (F.col("base") + F.col("rank")).alias(out)), column, "at")


def sampled_suffix_names(docs: DataFrame, depth: int = 50) -> DataFrame:
    """(key, row_hash, at, name): the suffixes that start at positions not divisible by three, named in order of at least ``depth`` bytes.

    A suffix that ends earlier comes ahead of those that go on. Null text is empty; rows that repeat count once. Only
    doc_id and text are read.
    """

    @lean
    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, row_hash, text in zip(*(batch.column(i) for i in range(3))):
                data = text.as_py().encode()
                at = np.arange(len(data))
                at = at[at % 3 != 0]
                padded = np.frombuffer(data + bytes(3 * LETTER), np.uint8)
                cut = np.lib.stride_tricks.sliding_window_view(padded, 3 * LETTER)[at] if len(at) else np.zeros((0, 3 * LETTER), np.uint8)
                whole = np.concatenate([cut, np.minimum(3 * LETTER, len(data) - at).astype(np.uint8)[:, None]], 1)
                column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(3 * LETTER + 1), len(at), [None, pa.py_buffer(np.ascontiguousarray(whole))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key.as_py(), np.int64)), pa.array(np.full(len(at), row_hash.as_py(), np.int64)), pa.array(at), column], ["key", "row_hash", "at", "triple"])

    rows = keyed(docs).select("key", "row_hash", "text").distinct().mapInArrow(triples, "key long, row_hash long, at long, triple binary")
    names, span = stored(named(rows, "triple", "name").drop("triple"), "suffix-names"), 3 * LETTER
    while span < depth:
        w = W.partitionBy("key", "row_hash", F.col("at") % 3).orderBy("at")
        later = [F.coalesce(F.lead("name", i * span // 3).over(w), F.lit(0)) for i in (1, 2)]
        names = stored(named(names.select("key", "row_hash", "at", F.struct("name", later[0].alias("second"), later[1].alias("third")).alias("names")), "names", "name").drop("names"), "suffix-names")
        span *= 3
    return names
