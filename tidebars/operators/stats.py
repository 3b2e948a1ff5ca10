"""Correlations, bucket tables, descriptions and their interpretation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: The last edge lies just above 1, so that 1 falls into the last bucket.
BUCKETS = {
    "high_vol": ("similar_high_vol_ratio", [0.0, 0.2, 0.4, 0.6, 0.8, 1.000001], ["0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0"]),
    "drop": ("similar_drop_ratio", [0.0, 0.03, 0.07, 0.15, 1.000001], ["0.00-0.03", "0.03-0.07", "0.07-0.15", "0.15-1.00"]),
    "up": ("similar_up_ratio", [0.0, 0.4, 0.5, 0.6, 1.000001], ["0.0-0.4", "0.4-0.5", "0.5-0.6", "0.6-1.0"]),
}
#: Which outcome each ratio is held against.
PAIRS = [("similar_high_vol_ratio", "actual_high_vol"), ("similar_drop_ratio", "actual_drop"), ("similar_big_move_ratio", "actual_big_move"), ("similar_up_ratio", "actual_target_up_next"), ("similar_avg_return_next_4", "actual_return_next_4")]


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are known; null if a side does not vary. An aggregate."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def average_rank(df: DataFrame, column: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ranks from 1, ties sharing their mean, over the non-null values of each key."""
    known = [*keys, F.col(column).isNull()]
    rank = F.rank().over(Window.partitionBy(*known).orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*known, column)) - 1) / 2
    return df.withColumn(name, F.when(F.col(column).isNotNull(), rank))


def ranges(df: DataFrame) -> int:
    """How many ranges values are dealt to where a whole table is ranked: the session's shuffle partitions, as a fixed count that every branch of a plan keeps."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def rank_over_all(df: DataFrame, column: str, name: str) -> DataFrame:
    """``average_rank`` over a whole table without one task holding it: ranks come from the counts of distinct values.

    Values are dealt by range; running counts within a range and the ranges' totals give each value its place.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count().repartitionByRange(ranges(df), column).withColumn("_part", F.spark_partition_id())
    counts = stored(counts, "ranks")  # both branches below see the same ranges
    counts = counts.withColumn("_in", F.sum("count").over(Window.partitionBy("_part").orderBy(column)))
    totals = counts.groupBy("_part").agg(F.sum("count").alias("_n"))
    base = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    ranks = counts.join(F.broadcast(base), "_part").select(F.col(column).alias("_value"), (F.col("_base") + F.col("_in") - (F.col("count") - 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("_value"), "left").drop("_value")


def spearman(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, x, "_rx", keys), y, "_ry", keys) if keys else rank_over_all(rank_over_all(both, x, "_rx"), y, "_ry")
    return ranked.groupBy(*keys).agg(pearson(F.col("_rx"), F.col("_ry")).alias("spearman"))


def correlations(df: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(x, y, pearson) of each pair in one pass."""
    pairs = pairs or PAIRS
    one = df.agg(*[pearson(F.col(x), F.col(y)).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("pearson")) for i, (x, y) in enumerate(pairs)])).alias("r")).select("r.*")


def rank_correlations(df: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(x, y, pearson, spearman) of each pair."""
    pairs = pairs or PAIRS
    ranked = [spearman(df, x, y).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "spearman") for x, y in pairs]
    return correlations(df, pairs).join(reduce(DataFrame.unionByName, ranked), ["x", "y"])


def bucket_of(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label whose half-open range holds x; null outside."""
    ranges = list(zip(edges, edges[1:], labels))
    return reduce(lambda c, r: c.when((x >= r[0]) & (x < r[1]), r[2]), ranges[1:], F.when((x >= ranges[0][0]) & (x < ranges[0][1]), ranges[0][2]))


def bucket_table(df: DataFrame, source: str, edges: list[float], labels: list[str], means: dict[str, str]) -> DataFrame:
    """Count and means of each bucket in order; empty buckets count 0 and have null means."""
    spark = df.sparkSession
    found = df.withColumn("bucket", bucket_of(F.col(source), edges, labels)).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), *[F.avg(c).alias(n) for n, c in means.items()])
    names = spark.createDataFrame(list(enumerate(labels)), "bucket_order int, bucket string")
    return names.join(F.broadcast(found), "bucket", "left").fillna(0, ["count"]).select("bucket_order", "bucket", "count", *means)


def describe(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), q.alias("_q"), F.max(column).alias("max"))
    return out.select(*keys, "count", "mean", "std", "min", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max")


def monotonic(table: DataFrame, value: str) -> DataFrame:
    """One row: increasing, decreasing, mixed, or insufficient for fewer than two buckets with a value. Equal steps fit both; increasing is tried first."""
    w = Window.orderBy("bucket_order")
    steps = table.where((F.col("count") > 0) & F.col(value).isNotNull()).withColumn("_b", F.lag(value).over(w))
    up, down = F.bool_and(F.col(value) >= F.col("_b")), F.bool_and(F.col(value) <= F.col("_b"))
    return steps.agg(F.when(F.count(F.lit(1)) < 2, "insufficient").when(up, "increasing").when(down, "decreasing").otherwise("mixed").alias("direction"))


def interpretation(high_vol: Column, drop: Column, drawdown_improved: Column) -> Column:
    """Array of messages for the two trends and the filter diagnostics. The texts are fixed values."""
    return F.array(
        F.when(high_vol == "increasing", "similar_high_vol_ratio shows useful monotonic risk signal.").otherwise("similar_high_vol_ratio does not show clean monotonic separation."),
        F.when(drop == "increasing", "similar_drop_ratio shows useful drop-risk separation.").otherwise("similar_drop_ratio does not show stable drop-risk separation."),
        F.when(drawdown_improved, "simple similarity risk filter improved drawdown in at least one threshold set.").otherwise("simple similarity risk filter did not improve drawdown."),
        F.lit("Risk filter results are row-sampled diagnostics, not a production trading backtest."),
    )
