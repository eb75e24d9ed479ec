"""Chunked work that can be run again: a chunk's data first, then its entry in the manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import with_position


class ChunkedTable:
    """K-14: rows of a table by chunk, of which only committed chunks count.

    A chunk's rows are in ``data/chunk=<n>``, its keys in ``done/chunk=<n>``. Both are written whole, data
    first, and a chunk counts once its keys are there. A run that ends between the two leaves a folder that
    no reader sees and that the next run of this chunk's number replaces. So a chunk is never lost
    or doubled, however often it is tried. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema

    def _committed(self) -> list[int]:
        """Numbers of committed chunks: a list of folders, not of rows."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        found = [x.getPath() for x in fs.listStatus(p)]
        whole = [x for x in found if x.getName().startswith("chunk=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return sorted(int(x.getName().removeprefix("chunk=")) for x in whole)

    def _read(self, part: str, schema: T.StructType) -> DataFrame:
        done = self._committed()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{part}/chunk={n}" for n in done])

    def rows(self) -> DataFrame:
        """Rows of committed chunks."""
        return self._read("data", self.schema)

    def done(self) -> DataFrame:
        """Keys of committed chunks."""
        return self._read("done", T.StructType([self.schema[self.key]]))

    def commit(self, chunk: int, rows: DataFrame) -> None:
        """Writes a chunk; its keys are those of the rows that were written."""
        at = f"{self.path}/data/chunk={chunk}"
        rows.select(*self.schema.names).write.mode("overwrite").parquet(at)
        back = self.spark.read.schema(self.schema).parquet(at)
        self.mark(chunk, back.select(self.key).where(F.col(self.key).isNotNull()).distinct())

    def mark(self, chunk: int, keys: DataFrame) -> None:
        keys.write.mode("overwrite").parquet(f"{self.path}/done/chunk={chunk}")

    def run(self, keys: DataFrame, work: Callable[[DataFrame], DataFrame], size: int) -> int:
        """``work`` (keys -> rows) on the keys not done yet, ``size`` at a time in key order; how many chunks were committed.

        The plan of chunks is a table, so each key is in one chunk whatever is computed again. Keys for
        which ``work`` gives no row stay, and are tried in the next run. A chunk that raises ends the run;
        those before it stay committed.
        """
        left = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().join(self.done(), self.key, "left_anti")
        numbered = with_position(left, [F.col(self.key)], "position").select(self.key, F.floor(F.col("position") / size).cast("long").alias("part"))
        plan = f"{self.path}/plan"
        numbered.write.mode("overwrite").partitionBy("part").parquet(plan)
        back = self.spark.read.schema(T.StructType([self.schema[self.key], T.StructField("part", T.LongType())])).parquet(plan)
        n = back.agg(F.max("part").alias("m")).first().m
        first = max([-1, *self._committed()]) + 1
        for i in range(0 if n is None else n + 1):
            self.commit(first + i, work(back.where(F.col("part") == i).select(self.key)))
        return 0 if n is None else n + 1
