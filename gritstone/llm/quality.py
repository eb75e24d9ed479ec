"""Quality classifier: boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Forest, fit
from .common import free, release, table

FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "lower", "digit", "space", "stops", "symbols", "non_ascii", "letters",
    "distinct", "repeats", "longest_run", "top_word", "lines", "line_length", "line_repeats", "symbol_words", "window_symbols_max",
    "window_symbols_mean", "window_upper_max", "window_digit_max", "window_space_max", "window_space_min", "window_stops_min",
)
WINDOW = 512


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each byte: 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 stop, 6 symbol, 7 beyond ASCII."""
    out = np.zeros(256, np.uint8)
    for k, chars in ((1, range(65, 91)), (2, range(97, 123)), (3, range(48, 58)), (4, b" \t\n\x0b\x0c\r"), (5, b".,;:?'\"()-"), (6, b"!#$%&*+/<=>@[\\]^_`{|}~"), (7, range(128, 256))):
        out[list(chars)] = k
    return out


def statistics(text: str | None) -> list[float]:
    """FEATURES of a whole text; an empty one has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    kinds = _classes()[np.frombuffer(raw, np.uint8)]
    n, m = len(raw), len(words)
    n_win = max(1, -(-(n - WINDOW // 2) // WINDOW))  # a short rest belongs to the last window
    whole = (n_win - 1) * WINDOW
    per = np.empty((n_win, 8))
    if n_win > 1:
        offset = np.repeat(np.arange(0, 8 * (n_win - 1), 8, dtype=np.int64), WINDOW)
        per[:-1] = np.bincount(offset + kinds[:whole], minlength=8 * (n_win - 1)).reshape(-1, 8)
    per[-1] = np.bincount(kinds[whole:], minlength=8)
    share = per.sum(0) / n
    per[:-1] /= WINDOW
    per[-1] /= n - whole
    ids: dict[bytes, int] = {}
    code = np.array(list(map(ids.setdefault, words, count())), dtype=np.int64)  # first place of each word
    counts = np.bincount(code)
    same = code[1:] == code[:-1]
    runs = np.diff(np.flatnonzero(np.concatenate(([True], ~same, [True]))))
    lines = raw.split(b"\n")
    odd = int(np.count_nonzero((kinds[:-1] == 6) & (kinds[1:] == 4)))
    low, high = per.min(0), per.max(0)
    return [
        np.log1p(n), np.log1p(m), n / m, *share[1:].tolist(), share[1] + share[2] + share[7],
        len(ids) / m, np.count_nonzero(same) / m, np.log1p(runs.max()), counts.max() / m,
        np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), odd / m,
        high[6], per[:, 6].mean(), high[1], high[3], high[4], low[4], low[5],
    ]


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [[float(v) for v in statistics(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])
        release()

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, "doc_id long, x array<double>")


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, target: str = "quality", **options) -> Forest:
    """Fits on at most ``sample`` labelled rows that are not held out, first by a hash of doc_id.

    Labels other than 0 and 1 are ignored; of several labels of a document the largest counts; a
    document present several times is learnt once. Without rows of both labels the forest is constant.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~_held_out())
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(marked.select("doc_id")), "doc_id")  # at most `sample` ids
    rows = (
        _features(chosen, "doc_id", "text").groupBy("doc_id").agg(F.min("x").alias("x"))
        .join(F.broadcast(marked), "doc_id").orderBy("doc_id").collect()  # at most `sample` rows
    )
    x = np.array([r.x for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r.y for r in rows], dtype=np.float64), **options)


def score(docs: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, a double: how likely label 1 is. Texts never leave their partition."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(forest.probability(np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))))
        release()

    udf = F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn(name, udf("text"))  # only texts go to Python


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts have all statistics zero and are scored like others; a null id is not
    held out; repeated rows each give a row; an empty table gives none. Other columns are not read.
    """
    forest = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1)], dtype=np.float64).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forest.probability(x))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    forest = train(docs, labels, sample)
    (name,) = free(docs, "score")
    return score(docs, forest, name).where(F.col(name) >= threshold).drop(name)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
SQL: dict[str, str] = {}
