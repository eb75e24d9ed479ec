"""Helpers shared by the training-data operators: tables, cut lineage, salts."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone (the path may be in any store)."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds what goes to Python at once by bytes, where the session doesn't: rows hold whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A folder of this machine is made only where the setting is absent and the master is local, as
    in tests; elsewhere executors would not share it, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = getattr(spark, "_gritstone_dir", None)
        if made is None:
            made = "file://" + tempfile.mkdtemp(prefix="gritstone-")
            spark._gritstone_dir = made
        found = made
    return found.rstrip("/")


def written(df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts lineage so that a lost executor costs a read, not the whole history. Returned frames
    carry ``_gritstone_path`` so that loops can delete what they no longer need. ``snappy`` suits hashes.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/gritstone/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    del df  # unless the caller keeps it, its own shuffle files go too
    release()
    spark.sparkContext._jvm.System.gc()  # frames this result no longer needs let go of their shuffle files, on the executors too
    out = spark.read.schema(schema).parquet(path)
    out._gritstone_path = path
    return out


def delete(df: DataFrame | None) -> None:
    """Removes what ``written`` wrote for ``df``."""
    path = getattr(df, "_gritstone_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Gives memory that a task no longer needs back to the machine: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of the filter of ``sieved``; a fixed size.
MARKS = 1 << 22


def sieved(df: DataFrame, keys: DataFrame, *on: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ``keys``, rows whose key surely is not), by a filter of MARKS bits.

    The filter is broadcast: MARKS / 64 rows at most, whatever the input. So only rows that a join
    with ``keys`` can change need to move; the others stay where they are.
    """
    bit = F.pmod(F.xxhash64(*on), F.lit(MARKS))
    names = df.columns
    b, w, v = free(df, "bit", "word", "value")
    words = keys.select(bit.alias(b)).groupBy(F.shiftright(b, 6).alias(w)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({b} % 64 as int))")).alias(v))
    marked = df.withColumn(b, bit).withColumn(w, F.shiftright(b, 6)).join(F.broadcast(words), w, "left")
    maybe = F.coalesce(F.expr(f"getbit({v}, cast({b} % 64 as int)) = 1"), F.lit(False))
    kept = [F.col(f"`{c}`") for c in names]
    return marked.where(maybe).select(*kept), marked.where(~maybe).select(*kept)


def free(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
