"""Readers with declared schemas. Nothing is read on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """S-1, S-2, S-7, S-8: one JSON object a line; blank lines are skipped.

    Malformed lines are kept with their text in ``_corrupt_record``; ``strict`` fails on the first.
    Adds ``_file`` and ``_line_order``, an order within and across files, as file order breaks ties.
    """
    reader = spark.read.schema(T.StructType([*_struct(schema).fields, *([] if strict else [T.StructField(CORRUPT, T.StringType())])]))
    reader = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    df = reader.json(paths)
    return df.select("*", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start")).alias("_block")).withColumn(
        "_line_order", F.struct("_file", "_block", F.monotonically_increasing_id().alias("i"))
    ).drop("_file", "_block")


def split_malformed(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """S-1: (rows that read well and have a key, all others with a reason)."""
    bad = F.col(CORRUPT).isNotNull()
    good = df.where(~bad & F.col(key).isNotNull()).drop(CORRUPT)
    rejects = df.where(bad | F.col(key).isNull()).select(F.when(bad, "malformed").otherwise("missing_key").alias("reason"), CORRUPT)
    return good, rejects


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, limit: int | None = None) -> DataFrame:
    """S-3, S-27: headed CSV with quoted line breaks."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.limit(limit) if limit is not None else df


def pr_lookup(prs: DataFrame, raw_schema: T.StructType | str | str) -> DataFrame:
    """S-4: changes by linked issue, with their raw JSON read; unreadable JSON is an empty object."""
    parsed = F.coalesce(F.from_json(F.when(F.col("RAW_JSON").isin("nan", "NaN"), None).otherwise(F.col("RAW_JSON")), raw_schema), F.from_json(F.lit("{}"), raw_schema))
    return prs.where("LINKED_ISSUE_NUMBER is not null").select("*", parsed.alias("parsed"))


def read_any(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S-5, S-6: by the path's ending; anything else is an error."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "csv":
        return read_csv(spark, path, schema)
    if ending in ("jsonl", "ndjson"):
        return read_jsonl(spark, path, schema).drop(CORRUPT, "_line_order")
    if ending == "parquet":
        return spark.read.schema(schema).parquet(path)
    if ending == "json":
        return read_column_json(spark, path, schema)
    raise ValueError(f"unsupported input format: .{ending}")


def read_column_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S-6: a column-oriented object {column: {row: value}}; rows are joined on their index."""
    text = spark.read.text(path, wholetext=True)
    cols = text.select(F.from_json("value", "map<string, map<string, string>>").alias("m")).select(F.explode("m").alias("name", "cells"))
    cells = cols.select("name", F.explode("cells").alias("index", "value"))
    wide = cells.groupBy("index").pivot("name", [f.name for f in _struct(schema).fields]).agg(F.first("value"))
    return wide.select("index", *[F.col(f.name).cast(f.dataType) for f in _struct(schema).fields])


def read_symbol_index(spark: SparkSession, path: str, normalise=lambda c: c) -> DataFrame:
    """S-9: {path: {classes, functions}} as rows; of keys equal after normalising the later wins."""
    text = spark.read.text(path, wholetext=True)
    kind = "map<string, struct<classes: array<string>, functions: array<string>>>"
    rows = text.select(F.posexplode(F.map_entries(F.from_json("value", kind))).alias("i", "e"))
    keyed = rows.select(normalise(F.col("e.key")).alias("path"), F.col("i"), F.col("e.value").alias("v"))
    return keyed.groupBy("path").agg(F.max_by("v", "i").alias("v")).select("path", "v.classes", "v.functions")


def first_existing(spark: SparkSession, *paths: str | None) -> str:
    """S-10: the first path that exists, in any store Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        if p:
            hp = jvm.org.apache.hadoop.fs.Path(p)
            if hp.getFileSystem(conf).exists(hp):
                return p
    raise FileNotFoundError(f"none of {paths} exists")


SKIP_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "build", "dist", ".tox", ".mypy_cache", ".pytest_cache")
SOURCE_ENDINGS = ("py", "ts", "tsx", "js", "jsx", "go", "java", "sh", "rb", "rs")


def scan_sources(spark: SparkSession, root: str, endings: tuple[str, ...] = SOURCE_ENDINGS, skip: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """S-19: (path, text) of source files below ``root``; an init file only where it defines something.

    Spark's scans skip names that begin with ``_`` or ``.``: a checkout's ``__init__.py`` files are
    seen only if they were landed under another name, such as ``init__.py``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.regexp_replace("path", "^.*?" + "/".join(map(_quoted, root.rstrip("/").split("/")[-1:])) + "/", "")
    parts = F.split(inside, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = F.exists(dirs, lambda d: d.isin(*skip) | d.endswith(".egg-info"))
    good = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*endings)
    rows = files.where(good).select(inside.alias("path"), F.decode("content", "UTF-8").alias("text"), skipped.alias("s")).where("not s").drop("s")
    return rows.where(~F.col("path").rlike(r"(^|/)_*init__\.py$") | F.col("text").rlike(r"(?m)^\s*(class|def|async def)\s"))


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "_-" else c for c in s)


def list_files(files: DataFrame, most: int = 280) -> DataFrame:
    """S-20: the first paths in order."""
    return files.select("path").orderBy("path").limit(most)


def readme_head(files: DataFrame, lines: int = 35) -> DataFrame:
    """S-20: the first lines of the top-level readme."""
    top = files.where(F.lower("path").isin("readme.md", "readme.rst", "readme.txt", "readme"))
    return top.select("path", F.array_join(F.slice(F.split("text", "\n"), 1, lines), "\n").alias("head"))


def tracked(paths: DataFrame, suffix: str = ".py") -> DataFrame:
    """S-21."""
    return paths.where(F.col("path").endswith(suffix)).select("path").distinct()


def blob_at(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """S-22: texts at (sha, path); null where there is none."""
    return wanted.join(blobs, ["sha", "path"], "left")


def search_code(files: DataFrame, text: str, exclude: Column | None = None, limit: int = 50) -> DataFrame:
    """S-23: paths of files that hold a fixed string, in order."""
    hit = files.where(F.contains("text", F.lit(text)))
    return (hit.where(~exclude) if exclude is not None else hit).select("path").orderBy("path").limit(limit)


def point_lookup(df: DataFrame, predicate: Column, order: list[Column]) -> DataFrame:
    """S-24: the first row that fits, columns upper-cased; an error where none does."""
    row = df.where(predicate).orderBy(*order).limit(1)
    row = row.select(*[F.col(c).alias(c.upper()) for c in row.columns])
    if row.isEmpty():
        raise LookupError("no row fits")
    return row


def discover(df: DataFrame, created: str, since: str, most: int | None = None) -> DataFrame:
    """S-15 to S-17: newest first, none before ``since``, at most ``most``."""
    out = df.where(F.col(created) >= F.lit(since).cast("timestamp_ntz")).orderBy(F.desc(created))
    return out.limit(most) if most is not None else out


def discover_new(df: DataFrame, done: DataFrame, number: str, created: str, since: str, quota: int) -> DataFrame:
    """S-16: the newest ``quota`` numbers that are not ``done``, none before ``since``; changes are not told from issues."""
    new = df.where(F.col(number).isNotNull()).join(done.select(number), number, "left_anti")
    return discover(new, created, since, quota)


def one_record(df: DataFrame, key: str, number: int) -> DataFrame:
    """S-18: the record of one number; the filter reaches the scan, and no row is an empty frame."""
    return df.where(F.col(key) == number).limit(1)
