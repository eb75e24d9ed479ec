"""Suffix-array dedup against brute force over all starts."""

import hashlib
import random
from collections import Counter

import pytest

from gritstone.llm.suffix_dedup import op4_suffix_array_dedup, owned, suffix_dedup, suffix_dedup_texts


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def texts_of(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rnd.randint(10, 80))) for _ in range(6)]
    texts = [None, "", "x", "a" * 500, "ab" * 300, "a" * 100]
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            p = p[a : a + rnd.randint(20, len(p))]
            if rnd.random() < 0.4:
                k = rnd.randrange(len(p))
                p = p[:k] + rnd.choice("xyz") + p[k + 1 :]
            parts += [p, " ".join(word() for _ in range(rnd.randint(0, 30)))]
        texts.append("".join(parts))
    return texts + texts[8:12]


@pytest.mark.parametrize("length", [32, 100])
def test_matches_brute_force(spark, length):
    texts = texts_of(length)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, anchors string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == [w[:4] for w in brute(texts, length)]


def test_texts_keep_rows_and_columns(spark):
    texts = texts_of(7, 20)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, k1 string")
    out = suffix_dedup_texts(docs, 40)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    for i, (t, w) in enumerate(zip(texts, brute(texts, 40))):
        assert got[i] == (t if w[1] == 0 else w[4].decode("utf-8", "ignore"))


def test_repeated_rows_null_ids_and_empty_table(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(90))
    rows = [(1, long), (1, long), (None, "solo " + long[::-1]), (None, None)]
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 90), (False, 90), (True, 0), (True, 0)]
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string"), 40).count() == 0


def test_chunk_edges_change_nothing():
    rnd = random.Random(8)
    raw = bytes(rnd.choice(b"abc ") for _ in range(3000)) + b"z" * 700
    whole = [x.tolist() for x in owned(raw, 100)]
    for chunk in (64, 97, 1000):
        assert [x.tolist() for x in owned(raw, 100, chunk=chunk)] == whole


def test_query_on_long_texts_with_repeats_at_every_edge(spark, tmp_path):
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    a, b = noise(530_000), noise(3_000)
    edge = 1 << 19
    parts = [a[edge - k : edge - k + 700] for k in (0, 350, 699)] + [a[:500], a[-450:], b[:399], b[500:900], b]
    rows = [(i, t, "x") for i, t in enumerate([a, b, *[noise(60) + p + noise(60) for p in parts], None, "", b])]
    spark.createDataFrame(rows, "doc_id long, text string, k1 string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op4_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: w[:4] for (i, _, _), w in zip(rows, brute([t for _, t, _ in rows], 400))}


def test_columns_of_any_name_stay(spark):
    rows = [(i, "pq rs" * 30, 5, 6, "k") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __k1 int, __k2 int, __text string")
    got = suffix_dedup_texts(docs, 100).collect()
    assert [tuple(r)[2:] for r in got] == [(5, 6, "k")] * 3 and {r.text for r in got} == {""}
