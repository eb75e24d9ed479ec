"""Embedding near-dedup against brute force over all pairs."""

import numpy as np
import pytest

from gritstone.llm import vector_dedup as module
from gritstone.llm.vector_dedup import vector_dedup


def brute(rows, threshold=0.98):
    ok = [i for i, (_, v, y) in enumerate(rows) if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a].add(b)
    out, root = {}, {}
    for i in range(len(rows)):
        if i not in root:
            todo, group = [i], {i}
            while todo:
                for j in links[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            for j in group:
                root[j] = min(rows[k][0] for k in group)
        out[rows[i][0]] = (len(links[i]), root[i], rows[i][0] == root[i])
    return out


@pytest.mark.parametrize("leaf", [1024, 32])
def test_matches_brute_force(spark, leaf):
    rng = np.random.default_rng(leaf)
    rows = []
    for y in (0, 1, None):
        for _ in range(8):
            c = rng.standard_normal(16)
            rows += [(0, (c + rng.standard_normal(16) * 0.09).tolist(), y) for _ in range(12)]
        rows += [(0, rng.standard_normal(16).tolist(), y) for _ in range(30)]
    rows += [(0, [1.0] + [0.0] * 15, 0)] * 20 + [(0, [2.0] + [0.0] * 15, 0)] * 3
    rows += [(0, None, 0), (0, [], 0), (0, [0.0] * 16, 0), (0, [1.0, None] * 8, 0), (0, [float("nan")] * 16, 0), (0, [1.0, 0.0], 0), (0, [1.0, 0.01], 0)]
    rows = [(int(i), v, y) for i, (_, v, y) in zip(rng.permutation(len(rows)), rows)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, id string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup(frame, leaf=leaf).collect()}
    want = brute(rows)
    found, true = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)
    assert found >= 0.98 * true
    assert leaf < 100 or got == want


def test_empty_table(spark):
    assert vector_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_a_dense_group_beyond_the_lists_is_whole(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 100, raising=False)
    rng = np.random.default_rng(3)
    c = rng.standard_normal(16)
    vectors = [(c + rng.standard_normal(16) * 0.05).tolist() for _ in range(300)] + [rng.standard_normal(16).tolist() for _ in range(30)]
    rows = [(int(i), v, int(i % 7 == 0)) for i, v in zip(rng.permutation(len(vectors)), vectors)] + [(900, vectors[0], 0), (901, vectors[0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup(frame, trees=1, max_rounds=1, leaf=8).collect()}
    assert got == brute(rows)


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (7, [1.0, 0.01], 0)]
    got = vector_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(5, 0, 5), (5, 1, 5), (7, 1, 5)]


def test_an_audit_finds_a_rare_link(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((3000, 16))
    v[1711] = v[42] + 1e-3
    reps = spark.createDataFrame([(i, 0, 16, x.tolist()) for i, x in enumerate(v)], "id long, label long, dim int, v array<double>")
    none = spark.createDataFrame([], "u long, w long, sim double")
    assert module._recall(none, none, reps, 0.98, 50) == 0.0
    assert module._recall(spark.createDataFrame([(42, 1711, 1.0)], none.schema), none, reps, 0.98, 50) == 1.0
