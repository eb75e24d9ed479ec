"""Custom metrics: errors of single rows, types, one pass."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from gritstone.operators.custom_metrics import Metrics


def made():
    m = Metrics()

    @m.row("ratio", {"a": "int", "b": "int"})
    def ratio(a, b):
        return a / b

    @m.row("text", {"t": "string"})
    def text(t):
        return "no number" if t == "x" else len(t)

    m.register("length", {"t": "string"}, lambda t: pc.utf8_length(t))
    m.register("short", {"a": "int"}, lambda a: pa.array([1.0]))
    return m


ROWS = [(i, i % 7, "ab" * (i % 3)) for i in range(100)] + [(1, None, None), (2, 2, "x")]


def test_a_row_that_raises_leaves_the_others(spark):
    m, df = made(), spark.createDataFrame(ROWS, "a int, b int, t string").repartition(3)
    got = m.score(df, ["ratio", "text", "length"]).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.b is None:
            assert r.ratio.score is None and r.ratio.error.startswith("TypeError") and r.text.error.startswith("TypeError") and r.length == (None, None)
        elif r.b == 0:
            assert r.ratio.score is None and r.ratio.error.startswith("ZeroDivisionError")
        else:
            assert r.ratio == (r.a / r.b, None) and r.length == (len(r.t), None)
            assert r.text.error.startswith("TypeError: a metric gives a number") if r.t == "x" else r.text.score == len(r.t)
    s = {r.metric: r for r in m.summary(m.score(df, ["ratio", "text"]), ["ratio", "text"]).collect()}
    assert (s["ratio"].n, s["ratio"].errors, s["text"].errors) == (86, 16, 2)
    assert m.score(df.limit(0), ["ratio"]).count() == 0


def test_types_and_names_are_checked_first(spark):
    m, df = made(), spark.createDataFrame(ROWS, "a long, b int, t string")
    for names in (["ratio"], ["nothing"]):
        with pytest.raises(TypeError):
            m.score(df, names)
    with pytest.raises(ValueError):
        m.score(df.withColumnRenamed("b", "length"), ["length"])
    with pytest.raises(ValueError):
        m.register("ratio", {}, None)
    one = spark.createDataFrame(ROWS, "a int, b int, t string").repartition(1)
    assert {r.short.error for r in m.score(one, ["short"]).collect()} == {None}  # halved to single rows, each of which has its score
