"""Quality classifier: held-out accuracy, flattened traversal against a plain walk, edge rows."""

import zlib

import numpy as np

from gritstone.llm.boosting import fit
from gritstone.llm.quality import FEATURES, quality_filter, quality_scores, statistics


def test_flat_traversal_is_a_tree_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = fit(x, y, trees=10, depth=3)

    def walk(row):
        out = f.base
        for n in f.roots:
            while f.left[n] != n:
                n = f.left[n] if row[f.feature[n]] <= f.threshold[n] else f.right[n]
            out += f.value[n]
        return out

    assert np.allclose(f.margin(x), [walk(r) for r in x])
    assert ((f.probability(x) > 0.5) == y).mean() > 0.95


def test_fit_equals_a_plain_search():
    """Every node looks at all its rows for every feature and cut."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=300) / 2 > 0.4).astype(float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    margin = np.full(len(y), np.log(share / (1 - share)))
    cuts = [sorted({np.sort(c)[int(np.floor((len(y) - 1) * k / 16))] for k in range(1, 16)}) for c in x.T]

    def grow(rows, left, g, h):
        best, pick = 1e-6, None
        gs, hs = g[rows].sum(), h[rows].sum()
        for f in range(3) if left else ():
            for c in cuts[f]:
                low = rows[x[rows, f] <= c]
                gl, hl = g[low].sum(), h[low].sum()
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                if min(hl, hs - hl) >= 1 and gain > best + 1e-9:
                    best, pick = gain, (f, c)
        if pick is None:
            margin[rows] -= 0.3 * gs / (hs + 1)
            return
        low = x[rows, pick[0]] <= pick[1]
        grow(rows[low], left - 1, g, h)
        grow(rows[~low], left - 1, g, h)

    for _ in range(6):
        p = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(y)), 3, p - y, p * (1 - p))
    assert np.allclose(fit(x, y, trees=6, depth=3, rate=0.3, bins=16).margin(x), margin, atol=1e-8)


def test_one_class_or_no_rows_is_constant():
    for y in (np.zeros(0), np.ones(5)):
        f = fit(np.zeros((len(y), 2)), y)
        assert np.ptp(f.probability(np.random.default_rng(0).normal(size=(4, 2)))) == 0


def test_statistics_have_a_value_for_any_text():
    for t in (None, "", " \n", "a", "A!! B!!", "é" * 5000, "x" * 100_000, "1 2 3\n" * 900):
        s = statistics(t)
        assert len(s) == len(FEATURES) and np.isfinite(s).all()


def rows():
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("on", "er", "ing")]
    docs, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        w = [str(rng.choice(words)) for _ in range(60)]
        docs.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w), "en", 1.0))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_edge_rows(spark):
    docs, labels = rows()
    extra = [(1000, None, None, 0.0), (1001, "", "en", 0.0), (None, "fine words here", "en", 0.0), (5, docs[5][1], "en", 0.0)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, score double").repartition(3)
    bad = [(1, None, 0), (1, 7, 0), (None, 1, 0), (2, 1, 0)]
    marked = spark.createDataFrame(labels + bad, "doc_id long, quality int, toxic int")
    got = quality_scores(d, marked).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 40 and sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) >= 0.98 * len(held)
    kept = quality_filter(d, marked)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 400} == {i for i in range(400) if i % 4}


def test_without_labels_or_documents(spark):
    docs, _ = rows()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_scores(spark.createDataFrame(docs, "doc_id long, text string, lang string, n double"), none).collect()
    assert {r.score for r in got} == {0.5}
    assert quality_scores(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0
