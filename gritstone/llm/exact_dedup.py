"""Exact dedup: tree-merge of digest runs in binomial rounds, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Deleted before texts are compared: the characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64, fan_in: int = 8
) -> DataFrame:
    """One row per document: the id that stays among equal texts, the group's size, the digest.

    Rows are dealt into ``runs`` runs by id. Within a run, equal digests are merged first; then
    rounds merge ``fan_in`` runs into one, each digest keeping the longest original text and,
    among those, the smallest id. A merged digest is verified by length and a second, unrelated
    hash, which are part of the key at each level. The winners travel back down the same tree, so
    a group that holds a third of all rows is never one task's work: at each level a key has at
    most ``fan_in`` rows, and at the leaves its rows are spread over all runs.

    Null text is empty; a null id sorts after all others (it stays only where no row of the group
    with that length has an id); repeated rows each give a row; an empty table gives none. Other columns
    are ignored. Rows that share the id that stays are all kept.
    """
    if runs < 1 or fan_in < 2:
        raise ValueError("runs must be 1 or more and fan_in 2 or more")
    norm = normalised(F.col(text_col))
    digests = written(
        docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("len"), norm.alias("n"))
        .select(
            "doc_id", "len",
            F.sha2(F.col("n").cast("binary"), 256).alias("text_sha256"),
            F.xxhash64("n").alias("check1"), F.octet_length("n").alias("check2"),
            F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"),
        ),
        "digests",
    )
    key = ["text_sha256", "check1", "check2"]
    best = F.min_by("best_id", F.struct(-F.col("len"), F.col("best_id").isNull(), F.col("best_id")))
    merged = lambda df, by: df.groupBy(*by, *key).agg(best.alias("best_id"), F.max("len").alias("len"), F.sum("size").alias("size"))
    levels = [merged(digests.select("run", *key, F.col("doc_id").alias("best_id"), "len", F.lit(1).cast("long").alias("size")), ["run"])]
    n = runs
    while n > 1:
        n = -(-n // fan_in)
        levels[-1] = written(levels[-1], "run")
        up = levels[-1].withColumn("run", (F.col("run") / fan_in).cast("int"))
        levels.append(merged(up, ["run"]))
    found = levels.pop().select("run", *key, F.col("best_id").alias("keep_id"), F.col("size").alias("group_size"))
    for level in reversed(levels):  # back down: each run learns the winner of its parent
        found = (
            level.select(F.col("run").alias("leaf"), (F.col("run") / fan_in).cast("int").alias("run"), *key)
            .join(found, ["run", *key])
            .select(F.col("leaf").alias("run"), *key, "keep_id", "group_size")
        )
    return digests.join(found, ["run", *key]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op3_exact_dedup": r"""
with n as (
  select doc_id, length(coalesce(text, '')) as len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
g as (
  select text_sha256, arg_min(doc_id, (-len, doc_id)) as keep_id, count(*) as group_size
  from n group by text_sha256)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, n.text_sha256
from n join g using (text_sha256)"""
}
QUERIES = {"op3_exact_dedup": op3_exact_dedup}
