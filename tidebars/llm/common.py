"""Helpers shared by the text operators: table access, shared storage, spreading of hot keys, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark sends Python workers this many bytes at a time, so that neither side holds thousands of long texts.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's limit of Arrow batches to ``BATCH_BYTES``, if it is higher. It is set once and stays: no result depends on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if most <= 0 or most > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def lean(run: Callable) -> Callable:
    """Have a function of a Python worker, on batches or on one table, leave no freed memory with the worker, which Spark keeps for later tasks."""

    @wraps(run)
    def wrapped(given):
        c = ctypes.CDLL(None)
        if hasattr(c, "mallopt"):
            c.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays of over a megabyte go back when they are freed
        out = run(given)
        if isinstance(out, Iterator):
            return _to_the_end(out)
        _give_back()
        return out

    return wrapped


def _to_the_end(out: Iterator) -> Iterator:
    try:
        yield from out
    finally:
        _give_back()


def _give_back() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    c = ctypes.CDLL(None)
    if hasattr(c, "malloc_trim"):
        c.malloc_trim(0)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Where that is unset, a temporary folder serves in local mode, and a cluster's warehouse on a cluster.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.partition("[")[0] == "local":
        base = getattr(shared_path, "own", None)
        if base is None:
            base = shared_path.own = "file://" + tempfile.mkdtemp(prefix="tidebars-")
    base = base or spark.conf.get("spark.sql.warehouse.dir") + "/_tidebars"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(remove_written)
    _WRITTEN.append((spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()))
    return path


#: Paths handed out; results are read from them lazily, so they stay until the program ends.
_WRITTEN: list[tuple] = []


def remove_written() -> None:
    """Remove the intermediate tables written so far. DataFrames that were made from them can't be read afterwards."""
    while _WRITTEN:
        path, conf = _WRITTEN.pop()
        with suppress(Exception):  # at the end of a program its JVM may be gone
            path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """While open, Spark removes an execution's shuffle files as soon as the execution ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def draw_bound(share: float) -> int:
    """Below this lies that share of all signed 64-bit numbers."""
    return int(share * (1 << 64)) - (1 << 63)


def drawn(share: float, *columns: Column | str) -> Column:
    """True for about a share of all rows, by a hash of columns: the whole 64 bits count, so no share is too small."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(F.lit("draw"), *columns) < F.lit(draw_bound(share))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in; others must not have their other letters folded."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_group_totals(rows: DataFrame, key: str, order: str, aggs: dict[str, tuple[Column, Column]], salts: int = 64) -> DataFrame:
    """Join each row with totals of its group, spreading a group over up to ``salts`` tasks.

    ``aggs`` maps a name to (aggregate over rows, aggregate over the partial column of that name).
    Rows are counted and reduced by (key, salt) first; only the totals travel to every salt that a group uses.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    partial = salted.groupBy(key, "_salt").agg(*[a.alias(n) for n, (a, _) in aggs.items()])
    total = partial.groupBy(key).agg(*[b.alias(n) for n, (_, b) in aggs.items()], F.collect_list("_salt").alias("_salts"))
    spread = total.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(spread, [key, "_salt"]).drop("_salt")


def one_row_each(docs: DataFrame, kept: DataFrame, identity: Column) -> DataFrame:
    """Rows of docs, all columns, whose doc_id and ``identity`` are in ``kept`` (doc_id, identity), null-safe; of rows that share both, the one of least text.

    A doc_id alone is no identity: rows of one doc_id with other texts are rows of their own.
    """
    key = [F.col("doc_id").isNull().alias("_null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id")]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keys = kept.select(*key, F.col("identity").alias("_same"))
    found = docs.select(whole, *key, identity.alias("_same")).join(keys, ["_null", "_id", "_same"], "left_semi")
    return found.groupBy("_null", "_id", "_same").agg(F.min_by("_row", F.coalesce(F.col("_row.text"), F.lit(""))).alias("_row")).select("_row.*")


def spread_join(rows: DataFrame, facts: DataFrame, key: str | list[str], order: str, salts: int = 64, how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows with one row of facts for each key; rows of a hot key go to up to ``salts`` tasks.

    Facts are repeated only for the salts that a key uses.
    """
    keys = [key] if isinstance(key, str) else key
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    used = salted.select(*keys, "_salt").distinct()
    return salted.join(used.join(facts, keys, how), [*keys, "_salt"]).drop("_salt")


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of edges (u, v): (node, component), component being the least node reachable.

    Rounds of contraction on two-column tables: every node points at its least neighbour, if that is less; pointers are
    followed to their ends by doubling, and each edge is then one between ends. Edges within what is joined go, so
    that a round sees far fewer than the one before. Each step is written to the shared folder; the loop ends when no
    edge is left. Only whether there are rows reaches the driver.
    """
    live, known = stored(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), label), None
    while known is None or not live.isEmpty():
        both = live.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        ends = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("end")), label)
        while True:
            jump = ends.select(F.col("node").alias("end"), F.col("end").alias("far"))
            # many nodes of a large component share one end
            ends = stored(spread_join(ends, jump, "end", "node").select("node", F.col("far").alias("end"), (F.col("far") < F.col("end")).alias("moved")), label)
            if ends.where("moved").isEmpty():
                break
            ends = ends.select("node", "end")
        ends = ends.select("node", "end")
        if known is None:
            known = ends.withColumnRenamed("end", "component")
        else:
            further = ends.select(F.col("node").alias("component"), "end")
            known = stored(spread_join(known, further, "component", "node", how="left").select("node", F.coalesce("end", "component").alias("component")), label)
        of = lambda x: ends.select(F.col("node").alias(x), F.col("end").alias(f"{x}_end"))
        joined = live.join(of("u"), "u").join(of("v"), "v").where("u_end <> v_end")
        live = stored(joined.select(F.least("u_end", "v_end").alias("u"), F.greatest("u_end", "v_end").alias("v")).distinct(), label)
    return known
