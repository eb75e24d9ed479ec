"""Writers: append, partitioned, atomic replace, reports, previews, manifests."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: list[str], one_file: bool = False) -> None:
    """K-1: JSON lines sorted by key. ``one_file`` is for results known to be small."""
    out = df.orderBy(*order)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").json(path)


def append_batch(df: DataFrame, path: str, fmt: str = "json") -> None:
    """K-2, K-3, K-8: appended files; names never clash."""
    df.write.mode("append").format(fmt).save(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """K-9: a folder for each split."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K-10."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def preview(df: DataFrame, chars: int = 300) -> DataFrame:
    """K-11: text columns on one line, cut to ``chars``."""
    cut = lambda c: F.left(F.translate(F.col(c), "\n\r", "  "), F.lit(chars)).alias(c)
    return df.select(*[cut(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_report(df: DataFrame, path: str) -> None:
    """K-12: a one-row frame as one JSON object."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_rows(df: DataFrame, good: Column, target: str, rejects: str) -> None:
    """K-3: rows that pass go to the target, the others to a reject table; both appended."""
    ok = F.coalesce(good, F.lit(False))
    df.where(ok).write.mode("append").parquet(target)
    df.where(~ok).write.mode("append").parquet(rejects)


def replace(df: DataFrame, path: str) -> None:
    """K-5, K-7: written aside, then swapped, so ``df`` may read from ``path``."""
    spark = df.sparkSession
    aside, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    jvm = spark._jvm
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    if not fs.rename(p(aside), p(path)):
        raise OSError(f"cannot move {aside} to {path}")
    fs.delete(p(old), True)


def count_delta(spark: SparkSession, path: str, write) -> tuple[int, int]:
    """K-6: rows before and after a write."""
    count = lambda: spark.read.parquet(path).count()
    before = count()
    write()
    return before, count()


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """K-23: keys that are not unique."""
    return df.groupBy(*keys).count().where("count > 1")


class Manifest:
    """K-13 to K-17: processed keys in a table of their own; a chunk is committed after its data."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "key bigint"):
        self.spark, self.path, self.schema = spark, path, schema

    def load(self) -> DataFrame:
        hp = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hp.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hp):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def commit(self, keys: DataFrame) -> None:
        keys.write.mode("append").parquet(self.path)

    def pending(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.load().distinct(), keys.columns, "left_anti")

    def repair(self, data_keys: DataFrame, apply: bool = False) -> tuple[DataFrame, DataFrame]:
        """(missing, verified): committed keys without data, and with. Only ``apply`` rewrites, after a backup."""
        done = self.load().distinct()
        missing, ok = done.join(data_keys, done.columns, "left_anti"), done.join(data_keys, done.columns, "left_semi")
        if apply:
            done.write.mode("overwrite").parquet(f"{self.path}.backup")
            back = self.spark.read.schema(self.schema).parquet(f"{self.path}.backup")
            replace(back.join(data_keys, back.columns, "left_semi"), self.path)
        return missing, ok


def checkpoint_entries(df: DataFrame, text: str) -> DataFrame:
    """K-17: numbers from entries that are ints, floats or JSON lists of either."""
    one = F.col(text).try_cast("double").cast("bigint")
    many = F.transform(F.from_json(F.col(text), "array<double>"), lambda x: x.cast("bigint"))
    entry = F.when(F.trim(text).startswith("["), many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<bigint>"))
    return df.select(F.explode(entry).alias("key")).where("key is not null").distinct()


def last_good(found: DataFrame, cached: DataFrame) -> DataFrame:
    """K-15: what discovery found, else what it found last; an error where both are empty."""
    if not found.isEmpty():
        return found
    if cached.isEmpty():
        raise LookupError("discovery found nothing and there is no earlier result")
    return cached


def load_strict(df: DataFrame, good: Column, target: str) -> None:
    """K-4: rows appended, or an error and nothing written where any row is bad; Spark retries tasks itself."""
    bad = df.where(~F.coalesce(good, F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("rows that cannot be loaded")
    append_batch(df, target, "parquet")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save_checkpoint(df: DataFrame, path: str) -> None:
    """K-16: replaces what was saved."""
    replace(df, path)


def load_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """K-16: what was saved, or None."""
    fs, p = _path(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else None


def clear_checkpoint(spark: SparkSession, path: str) -> None:
    """K-16: nothing happens where there is none."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def bootstrap(spark: SparkSession, script: str) -> int:
    """K-22: runs each statement of a script whose statements end at line ends in semicolons; how many there were."""
    found = [s.strip() for s in re.split(r";[ \t]*(?:\n|$)", script)]
    found = [s for s in found if s]
    for s in found:
        spark.sql(s)
    return len(found)


def write_symbol_index(index: DataFrame, path: str) -> None:
    """K-26: JSON rows of the files that have symbols."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    index.where((size("classes") > 0) | (size("functions") > 0)).write.mode("overwrite").json(path)
