"""Lexical search against brute force and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from gritstone.llm import lexical as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def of(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=20):
    held = [(i, of(t)) for i, t in docs]
    held = [(i, len(t), Counter(t)) for i, t in held if t]
    n_docs, n_terms = len(held), sum(n for _, n, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        scored, asked = [], of(text)
        for i, n, c in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def tables(seed):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.8)) % 300}" for _ in range(4000)] + ["É", "é", "ab_cd", "x-y", "語", "THE", "the", "½"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, text(rnd.randrange(0, 60))) for i in range(500)]
    docs += [(1000 + i, "same text The w1 w2 é") for i in range(40)] + [(1000, "same text The w1 w2 é")] * 3 + [(None, "same text The w1 w2 é"), (2000, None), (2001, ""), (2002, "  ... _ "), (2003, text(60_000)), (2004, "wörd" * 500_000)]
    items = [(i, text(rnd.randrange(1, 30))) for i in range(25)] + [(100, "same text, w1 THE the é"), (101, None), (102, ""), (103, "nowhere"), (104, "w1 w1 w1"), (105, "wörd" * 500_000)]
    return docs, items


@pytest.mark.parametrize(("seed", "block"), [(16_384, 5_000), (37, 16)])
def test_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(L, "ITEMS", block)
    docs, items = tables(seed)
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in L.search(d, b).collect()), key=str)
    assert got == brute(docs, items)


def test_shards_prune_and_stay_exact():
    rnd = np.random.default_rng(3)
    weight = rnd.integers(1, 9000, 40)
    item = (np.arange(40), rnd.integers(1, 3, 40))
    whole, best, scored = {}, L.Best(20), 0
    for s in range(30):
        lists = {}
        for t in range(40):
            docs = np.flatnonzero(rnd.random(1000) < (0.4 if t < 20 else 0.01))
            if len(docs):
                lists[t] = docs, rnd.integers(1, 900_000, len(docs))
        bound = np.array([lists[t][1].max() if t in lists else 0 for t in range(40)])
        doc = np.arange(1000) + 1000 * s
        for t, (docs, part) in lists.items():
            for i, p in zip(docs, part):
                whole[1000 * s + i] = whole.get(1000 * s + i, 0) + int(weight[t] * item[1][t] * p)
        scored += L.search_shard(lists, bound, weight, item, best, doc, np.zeros(1000, bool), np.zeros(1000, np.int64))
    want = sorted((-v, k) for k, v in whole.items())[:20]
    assert [(-int(a), int(b)) for a, b in zip(best.score, best.doc)] == want and scored <= len(whole)


def test_terms_of_long_texts_are_whole(monkeypatch):
    rnd = random.Random(1)
    text = "".join(rnd.choice(["a", "B", " ", "é", "語", "_", "word", "9"]) for _ in range(5000))
    want = [t.encode() for t in of(text)]
    for chunk in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(L, "CHUNK", chunk)
        assert [t for part in L.terms(text.encode()) for t in part] == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert L.search(none, items).count() == 0
    assert L.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_matches_sql(spark):
    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert sorted(tuple(r) for r in L.op11_lexical_search(spark, sf).collect()) == sorted(c.sql(L.SQL["op11_lexical_search"]).fetchall())
