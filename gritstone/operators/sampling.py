"""Seeded, deterministic samples and splits. Order comes from md5 of key and seed, so every engine agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_percent
from ..llm.common import written
from .relational import free


def seeded(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def hash_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """F-40: keys whose md5 falls under the fraction, per cent by per cent."""
    return df.where(hash_percent(F.col(key)) < F.lit(fraction * 100))


def stratified_split(df: DataFrame, key: str, stratum: str, seed: int, test: float = 0.1, val: float = 0.1) -> DataFrame:
    """R-1, R-2, R-4: ``split`` of each key: test and val take max(1, round(share * n)) of a stratum, train the rest.

    Rounds half to even. Order within a stratum is by md5; numbers come from counts by md5's first
    byte and ranks within it, so a stratum of a third of all rows is not one task's window. A
    stratum of one goes to test, of two to test and val.
    """
    h = F.coalesce(seeded(key, seed), F.lit(""))  # a null key sorts first
    d = df.select(F.col(key).alias("k"), F.col(stratum).alias("s"), h.alias("h"), F.substring(h, 1, 2).alias("b")).distinct()
    per = d.groupBy("s", "b").agg(F.count("*").alias("c"))
    shift = per.select(
        F.col("s").alias("of"), F.col("b").alias("of_b"),
        (F.sum("c").over(Window.partitionBy("s").orderBy("b")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("s")).alias("n"),
    )  # 256 rows a stratum
    rank = F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "k"))
    r = d.withColumn("r", rank).join(shift, F.col("s").eqNullSafe(F.col("of")) & (F.col("b") == F.col("of_b")))
    place = F.col("r") + F.col("before")
    n_test = F.greatest(F.lit(1), F.bround(F.col("n") * test).cast("long"))
    n_val = F.greatest(F.lit(1), F.bround(F.col("n") * val).cast("long"))
    split = F.when(place <= n_test, "test").when(place <= n_test + n_val, "val").otherwise("train")
    return r.select(F.col("k").alias(key), F.col("s").alias(stratum), split.alias("split"))


def balanced_sample(df: DataFrame, key: str, stratum: str, n: int | Column, seed: int) -> DataFrame:
    """R-3, R-5, R-6: up to ``n`` rows of each stratum, first by md5."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(seeded(key, seed), key))
    (r,) = free(df, "r")
    return df.withColumn(r, rank).where(F.col(r) <= n).drop(r)


def scarcest_cap(df: DataFrame, key: str, stratum: str, cap: int, seed: int) -> DataFrame:
    """R-7: as many of each class as the scarcest has, ``cap`` at most.

    The first ``cap`` rows of each class are written to the shared folder, so ``df`` is made once; a class
    has fewer than ``cap`` of them only if it has no more.
    """
    top = written(balanced_sample(df, key, stratum, cap, seed), "classes")
    least = top.groupBy(stratum).count().agg(F.min("count")).first()[0]
    return balanced_sample(top, key, stratum, least or 0, seed)


def dominant_band(df: DataFrame, key: str, band: str, order: tuple[str, ...] = ("low", "medium", "high")) -> DataFrame:
    """A-23: a key's greatest band."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.lower(F.col(band)))
    return df.groupBy(key).agg(F.element_at(F.array(*map(F.lit, order)), F.max(F.greatest(rank, F.lit(1))).cast("int")).alias(band))


def size_bucket(files: Column, additions: Column) -> Column:
    """R-2: stratum by files touched and patch size."""
    f = F.when(files <= 1, "f1").when(files == 2, "f2").otherwise("f3")
    return F.concat(f, F.when(additions < 250, "_small").when(additions < 700, "_medium").otherwise("_large"))


def time_split(df: DataFrame, ts: str, cut: str) -> DataFrame:
    """R-8: train before the cut, test from it on."""
    return df.withColumn("split", F.when(F.col(ts) < F.lit(cut).cast("timestamp_ntz"), "train").otherwise("test"))


def leaks(df: DataFrame, text: str, pattern: str = r"(?i)closed_at|resolution_days") -> DataFrame:
    """R-9: rows whose input holds closure fields."""
    return df.where(F.col(text).rlike(pattern))
