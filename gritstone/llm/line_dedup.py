"""Line dedup by an exact set-similarity join with prefix, positional and length filters."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, free, sieved, table, written
from .setjoin import LINES, joined, keyed


def removed_lines(docs: DataFrame, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """(k1, k2, lines) of the rows that lose lines: the numbers, from 0, of lines that match an earlier one.

    k2 is the low half of the text's hash.
    """
    sets, first, links = joined(keyed(docs), LINES, threshold)
    sig = ["s1", "s2", "s3"]
    matched = links.select(*sig, F.lit(True).alias("matched")).distinct()
    # only sets with a match or with several lines lose any: the others need not move
    several = sets.where(~F.col("lead")).select(sig).unionByName(first.where("copies").select(sig)).unionByName(matched.select(sig))
    own = sieved(first.select(*sig, F.struct("k1", "at").alias("first")), several, *sig)[0].join(matched, sig, "left")
    lines = sieved(sets.select(*sig, "k1", "at"), several, *sig)[0]
    gone = lines.join(own, sig).where(F.coalesce("matched", F.lit(False)) | (F.col("first") < F.struct("k1", "at")))
    k2, line = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("at", 32).cast("int")
    return gone.groupBy("k1", k2.alias("k2")).agg(F.collect_set(line).alias("lines"))


def line_dedup(docs: DataFrame, threshold: Fraction = Fraction(4, 5), counts: bool = False) -> DataFrame:
    """``docs`` without the lines whose token sets have a Jaccard of ``threshold`` or more with an earlier line.

    Lines end at line feeds; tokens are what stands between ASCII white space, each counted once.
    Earlier means a smaller doc_id (null last), then a smaller line number; lines that are removed
    themselves count as earlier ones too. Lines without tokens stay.
    Rows stay, even when all their lines go (the text is then empty, or what lines without tokens
    are left); null texts stay null; rows with one id and text lose the same lines; an empty table
    gives none; other columns stay as they are, whatever their names. ``counts`` adds n_lines and
    n_removed.
    """
    gone = written(removed_lines(docs, threshold), "gone")
    names = docs.columns
    k1, k2, cut = free(docs, "k1", "k2", "lines")
    gone_ = gone.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("lines").alias(cut))
    low = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))
    placed = docs.withColumns({k1: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), k2: low})
    maybe, still = sieved(placed, gone_, k1, k2)
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(cut, i)), "\n")
    text = F.when(F.col(cut).isNotNull(), kept).otherwise(F.col("text"))
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    extra = [n_lines.alias("n_lines"), F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_removed")] if counts else []
    of = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names] + extra
    # merged at any size: what a small table spares by a broadcast, a large one could not
    moved = maybe.join(gone_.hint("merge"), [k1, k2], "left").select(*of)
    return still.withColumn(cut, F.lit(None).cast("array<int>")).select(*of).unionByName(moved)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL: dict[str, str] = {}
