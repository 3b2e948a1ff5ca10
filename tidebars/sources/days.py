"""A bar table in partitions by day: an upsert rewrites the days it touches only, once for each batch.

A batch is merged with the stored rows of its days and the merged rows are written aside first; then those days are
overwritten, and a marker says that the batch is done. A batch that comes again finds its marker and changes nothing.
After a crash in between, the merged rows lie there whole: the next call overwrites the days from them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators.clean import upsert
from ..schema import BARS


class DayStore:
    """Bars (symbol, ts, values) under ``path``, in folders ``day=...``. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = BARS):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, *parts: str):
        path = self._hadoop.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._at(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def done(self, batch: str) -> bool:
        fs, path = self._at("_commits", batch)
        return fs.exists(path)

    def read(self, days: list | None = None) -> DataFrame:
        """All rows, or those of some days, whose folders alone are read."""
        self.recover()
        return self._read(days)

    def _read(self, days: list | None = None) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("day", T.DateType())])
        fs, path = self._at()
        if not fs.exists(path) or not any(f.getPath().getName().startswith("day=") for f in fs.listStatus(path)):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)
        return (rows if days is None else rows.where(F.col("day").isin(days))).drop("day")

    def recover(self) -> None:
        """Finish batches whose merged rows were written but whose days may be written in part."""
        for batch in self._names("_staged"):
            fs, whole = self._at("_staged", batch, "_SUCCESS")
            if fs.exists(whole) and not self.done(batch):
                self._publish(batch)
            else:
                fs.delete(self._at("_staged", batch)[1], True)

    def _publish(self, batch: str) -> None:
        """Overwrite the days of the staged rows, mark the batch as done, remove the staged rows. Doing it twice changes nothing."""
        fs, staged = self._at("_staged", batch)
        rows = self.spark.read.parquet(staged.toString())
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)
        fs.create(self._at("_commits", batch)[1], True).close()
        fs.delete(staged, True)

    def upsert(self, new: DataFrame, batch: str) -> bool:
        """Merge new rows; stored ones win. False, without reading a row, for a batch that is done already. Rows without a time are left out."""
        self.recover()
        if self.done(batch):
            return False
        rows = new.where(F.col("ts").isNotNull()).select(*self.schema.names).withColumn("day", F.to_date("ts"))
        days = [r["day"] for r in rows.select("day").distinct().collect()]  # as many as the batch has days
        if days:
            merged = upsert(self._read(days), rows.drop("day")).select(*self.schema.names).withColumn("day", F.to_date("ts"))
            merged.repartition("day").write.mode("overwrite").parquet(f"{self.path}/_staged/{batch}")
            self._publish(batch)
        else:
            fs, marker = self._at("_commits", batch)
            fs.create(marker, True).close()
        return True


def upsert_stream(stream: DataFrame, store: DayStore, checkpoint: str, name: str = "stream") -> DataStreamWriter:
    """Merge every micro-batch of a stream into a store; one that is replayed after a restart changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, number: store.upsert(batch, f"{name}-{number}")).option("checkpointLocation", checkpoint)
