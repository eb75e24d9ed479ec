"""Metrics of one's own: named Arrow functions with declared inputs, whose errors are values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Metrics:
    """X-2: a registry of metrics. A metric is a function of Arrow columns to numbers; no source text is run.

    ``score`` runs any number of them in one pass. A batch on which a metric raises is halved
    until single rows are left: a row that raises has a null score and its error's text, and all
    others are scored. A function that calls its neighbours' values (a mean over its batch) is not a metric.
    """

    def __init__(self) -> None:
        self._known: dict[str, tuple[Callable, dict[str, str]]] = {}

    def register(self, name: str, inputs: dict[str, str], function: Callable[..., pa.Array]) -> None:
        """``function`` takes the columns of ``inputs`` (name to type) in order, as arrays, and returns as many numbers."""
        if name in self._known:
            raise ValueError(f"{name} is registered")
        self._known[name] = function, dict(inputs)

    def row(self, name: str, inputs: dict[str, str]):
        """Registers a function of one row's values that returns a number (or None)."""

        def add(f: Callable[..., float | None]):
            self.register(name, inputs, lambda *cols: pa.array([_number(f(*v)) for v in zip(*(c.to_pylist() for c in cols))], pa.float64()))
            return f

        return add

    def check(self, df: DataFrame, names: list[str]) -> None:
        """Unknown metrics, and columns that are missing or of another type, are errors before anything runs."""
        wrong = [f"no metric {n}" for n in names if n not in self._known]
        for n in names:
            for c, t in self._known.get(n, (None, {}))[1].items():
                if c not in df.columns:
                    wrong.append(f"{n} needs column {c}")
                elif df.schema[c].dataType != T._parse_datatype_string(t):
                    wrong.append(f"{n} needs {c} as {t}, it is {df.schema[c].dataType.simpleString()}")
        if wrong:
            raise TypeError("; ".join(wrong))

    def score(self, df: DataFrame, names: list[str]) -> DataFrame:
        """``df`` with a column of each name: a struct of ``score`` and ``error``. A name that ``df`` has is an error."""
        self.check(df, names)
        taken = [n for n in names if n in df.columns]
        if taken:
            raise ValueError(f"columns {taken} are there already")
        chosen = [(n, *self._known[n]) for n in names]
        fields = df.schema.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for _, f, inputs in chosen:
                    score, error = _scored(f, [b.column(fields.index(c)) for c in inputs], b.num_rows)
                    out.append(pa.StructArray.from_arrays([score, error], names=["score", "error"]))
                yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*fields, *names])

        kind = T._parse_datatype_string("score double, error string")
        return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, kind) for n in names)]))

    def summary(self, scored: DataFrame, names: list[str]) -> DataFrame:
        """M-6, M-15: of each metric its scores' count, mean and deviation, and how many rows raised; not-a-number counts as no score."""
        long = scored.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.nanvl(F.col(f"`{n}`.score"), F.lit(None).cast("double")).alias("score"), F.col(f"`{n}`.error").alias("error")) for n in names])).alias("m"))
        return long.groupBy("m.metric").agg(F.count("m.score").alias("n"), F.avg("m.score").alias("mean"), F.stddev("m.score").alias("stdev"), F.count("m.error").alias("errors"))


def _number(x) -> float | None:
    if x is not None and (isinstance(x, bool) or not isinstance(x, int | float)):
        raise TypeError(f"a metric gives a number, not {type(x).__name__}")
    return None if x is None else float(x)


def _scored(f: Callable, cols: list[pa.Array], n: int) -> tuple[pa.Array, pa.Array]:
    try:
        got = f(*cols)
        got = got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got
        if len(got) != n:
            raise ValueError(f"{len(got)} scores for {n} rows")
        return pc.cast(got, pa.float64()), pa.nulls(n, pa.string())
    except Exception as e:
        if n <= 1:
            return pa.nulls(n, pa.float64()), pa.array([f"{type(e).__name__}: {e}"[:500]] * n, pa.string())
        half = n // 2
        a, b = _scored(f, [c.slice(0, half) for c in cols], half), _scored(f, [c.slice(half) for c in cols], n - half)
        return pa.concat_arrays([a[0], b[0]]), pa.concat_arrays([a[1], b[1]])
