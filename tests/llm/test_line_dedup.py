"""Line dedup against brute force over all pairs of lines."""

import random
from fractions import Fraction

import pytest

import corpus_pipeline
from gritstone.llm.line_dedup import line_dedup, op5_line_dedup


def brute(rows, threshold, least):
    lines = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        if t is not None:
            lines += [(i, k, set(x.split())) for k, x in enumerate(t.split("\n"))]
    gone = set()
    for b, (i, k, y) in enumerate(lines):
        if len(y) >= least and any(len(x) >= least and len(x & y) >= threshold * len(x | y) for _, _, x in lines[:b]):
            gone.add((i, k))
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def rows_of(seed, n=50):
    rnd = random.Random(seed)
    vocabulary = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(300)]
    known = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 25))) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "a b c d"), (4, "a b c d"), (5, "a b c d e"), (6, "e d c b a a")]
    for i in range(7, n):
        text = []
        for _ in range(rnd.randint(1, 6)):
            words = rnd.choice(known).split()
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            text.append(" ".join(words))
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("threshold", [Fraction(4, 5), Fraction(1, 2)])
def test_matches_brute_force(spark, threshold):
    rows = rows_of(threshold.denominator)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string").repartition(3)
    out = line_dedup(docs, threshold)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == brute(rows, threshold, 1)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f\nsolo one two three four"), (1, "a b c d e f\nsolo one two three four"), (None, "a b c d e f"), (None, None)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()
    assert sorted((str(r.doc_id), str(r.text), r.n_removed) for r in got) == [
        ("1", rows[0][1], 0), ("1", rows[0][1], 0), ("None", "", 1), ("None", "None", 0),
    ]
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_and_stage_take_short_lines(spark, tmp_path):
    rows = rows_of(11) + [(i, t) for i, t in enumerate(["p", "p\nq q", "q\n\np q", "q p p", "p q r", "r q p s", "s r q p\nt s r q p", "p s q r"], 100)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows, Fraction(4, 5), 1)
    assert {r.doc_id: r.text for r in op5_line_dedup(spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()} == want


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, 8, "z"), (2, "c b a\nd", 7, 8, "z")], "doc_id long, text string, __k1 int, __lines int, __k2 string")
    assert sorted(tuple(r) for r in line_dedup(docs).collect()) == [(1, "a b c", 7, 8, "z"), (2, "d", 7, 8, "z")]


def test_texts_meet_their_lines_by_a_merge_join_at_any_size(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e"), (2, "d e\nf g")], "doc_id long, text string")
    assert "strategy=merge" in line_dedup(docs)._jdf.queryExecution().optimizedPlan().toString()
