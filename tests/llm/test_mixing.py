"""Mixing against brute force."""

import hashlib
import math
import re

import duckdb
import pytest

from gritstone.llm import mixing


def brute(rows, cycle=(1, 2, 3), most=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    total, full = sum(own.values()), set()
    while True:
        left = total - sum(most * own[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * (left / w) > most * own[s]}
        if not over:
            break
        full |= over
    target = {s: most * own[s] if s in full else weight[s] * (left / w) if w else 0 for s in names}
    number = lambda i, k: int(hashlib.sha256(f"{'' if i is None else i}:{k // 8}".encode()).hexdigest()[k % 8 * 8 :][:8], 16)

    def copies(i, s, k):
        rate = target[s] / own[s] if own[s] else 0
        return math.floor(rate) + (number(i, k) < (rate - math.floor(rate)) * 2**32)

    best = {s: min(range(32), key=lambda k: (abs(sum(size(t) * copies(i, s, k) for i, t, x in rows if x == s) - target[s]), k)) for s in names}
    return sorted(((i, t, s, size(t), own[s], target[s], copies(i, s, best[s])) for i, t, s in rows), key=str)


def rows():
    out = [(i, "word " * (i % 13), "hot") for i in range(200)]
    out += [(1000 + i, f"a\tb\x0bc  d e {i}", f"s{i % 7}") for i in range(60)]
    out += [(None, "no id here", "s1"), (None, "no id here", "s1"), (2000, None, "s2"), (2001, "", "empty"), (2002, " \n", "empty"), (2003, "null source", None), (2003, "null source", None), (2004, "x " * 200_000, "long"), (2005, "ñandú 語", "é"), (2006, "astral", "\U0001f600"), (2007, "bmp", "￿")]
    return out


@pytest.mark.parametrize("few", [True, False])
def test_matches_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(mixing, "SOURCES", 2)
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string").repartition(5)
    got = [tuple(r) for r in mixing.repetitions(docs).collect()]
    want = brute(rows())
    key = lambda r: (str(r[0]), str(r[2]), str(r[1])[:50])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[6] == w[6] and g[5] == pytest.approx(w[5])
    assert sum(r[5] for r in {r[2]: r for r in got}.values()) == pytest.approx(sum(r[3] for r in got))


def test_emits_copies_with_every_column(spark):
    docs = spark.createDataFrame([(*r, i, "n") for i, r in enumerate(rows())], "doc_id long, text string, source string, copies int, size string")
    got = [tuple(r) for r in mixing.mix(docs).select("doc_id", "text", "source").collect()]
    assert sorted(got, key=str) == sorted(((i, t, s) for i, t, s, *_, n in brute(rows()) for _ in range(n)), key=str)
    assert mixing.mix(docs).columns == docs.columns
    with pytest.raises(ValueError):
        mixing.repetitions(docs)


def test_near_targets_and_reruns_agree(spark):
    f = lambda: [tuple(r) for r in mixing.op13_source_mixing(spark, "/root/testdata/sf0.01").collect()]
    got = f()
    assert sorted(got) == sorted(f())
    taken, aim = {}, {}
    for _, size, own, target, n in got:
        assert n <= 3 * size
        taken[own, target] = taken.get((own, target), 0) + n
        aim[own, target] = target
    assert all(abs(taken[s] - aim[s]) <= 0.05 * aim[s] for s in aim)


def test_empty_tables(spark):
    assert mixing.repetitions(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.copies) for r in mixing.repetitions(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_matches_sql(spark):
    c = duckdb.connect()
    c.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in c.sql(mixing.SQL["op13_source_mixing"]).fetchall())
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.op13_source_mixing(spark, "/root/testdata/sf0.001").collect())
    assert got == want
