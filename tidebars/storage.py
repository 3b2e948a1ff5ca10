"""Intermediate tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

#: Paths handed out; results are read from them lazily, so they stay until the program ends.
_WRITTEN: list[tuple] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, in a temporary folder in local mode, and in the warehouse on a cluster."""
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


def remove_written() -> None:
    """Remove the tables written so far. DataFrames that were made from them can't be read afterwards."""
    while _WRITTEN:
        path, conf = _WRITTEN.pop()
        with suppress(Exception):  # at the end of a program its JVM may be gone
            path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
