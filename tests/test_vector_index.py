"""The vector index against exact search."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.operators import vector_index as V
from gritstone.operators.graph import vector_topk, vector_topk_in_blocks


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(5)
    centre = rnd.normal(size=(30, 16))
    x = centre[rnd.integers(0, 30, 3000)] + rnd.normal(scale=0.6, size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(10_000 + i, rows[7][1]) for i in range(900)]  # one vector many times
    rows += [(20_000, None), (20_001, [0.0] * 16), (20_002, [float("nan")] * 16), (20_003, [1.0] * 5), (20_004, [None] * 16), (20_005, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def rows(df):
    return sorted((r.qid, r.rank, r.vid, r.score) for r in df.collect())


def asked(vectors):
    return vectors.where("vec_id % 20 = 0").selectExpr("vec_id as qid", "embedding")


def test_all_lists_equal_exact_search(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 50)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 300)
    index = V.VectorIndex.create(vectors, f"file://{tmp_path}/i")
    assert len(index.centroids) == round(3900**0.5) and index.vectors().count() == 3900
    want = rows(vector_topk(asked(vectors), vectors.where("size(embedding) = 16"), 8))
    assert rows(index.search(asked(vectors), 8, len(index.centroids))) == want


def test_probing_reads_few_folders_and_reaches_recall(spark, vectors, tmp_path):
    index = V.VectorIndex.create(vectors, f"file://{tmp_path}/i")
    one = asked(vectors).where("qid = 0")
    plan = index.search(one, 8, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    probe = index.enough_lists(asked(vectors), 8)
    assert index.recall(index.audit(asked(vectors), 8), 8, probe) >= 0.9
    got = {(q, v) for q, _, v, _ in rows(index.search(asked(vectors), 8, probe))}
    scored = {(q, v): s for q, _, v, s in rows(index.search(asked(vectors), 4000, len(index.centroids)))}
    assert got <= scored.keys()
    found = rows(index.search(asked(vectors), 8, probe))
    assert all(scored[q, v] == s for q, _, v, s in found)  # what is found is scored exactly


def test_one_list_too_few_is_noticed(spark, tmp_path):
    rnd = np.random.default_rng(1)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rnd.normal(size=(800, 24)))], "vec_id long, embedding array<double>")
    index = V.VectorIndex.create(v, f"file://{tmp_path}/i")
    q = asked(v)
    audit = index.audit(q, 8)
    assert index.recall(audit, 8, 1) < 0.9 <= index.recall(audit, 8, index.enough_lists(q, 8, probe=1))


def test_create_drop_and_empty(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/i"
    index = V.VectorIndex.create(vectors, path, lists=5)
    with pytest.raises(FileExistsError):
        V.VectorIndex.create(vectors, path)
    assert V.VectorIndex.exists(spark, path) and len(V.VectorIndex(spark, path).centroids) == 5
    index.drop()
    index.drop()
    assert not V.VectorIndex.exists(spark, path)
    none = V.VectorIndex.create(vectors.where("vec_id >= 20000 and vec_id <> 20003"), path)
    assert none.search(asked(vectors), 8, 4).count() == 0 and none.enough_lists(asked(vectors), 8) == 1
    none.drop()
    again = V.VectorIndex.create(vectors.withColumnRenamed("embedding", "list"), path, vec="list")  # a column called as ours
    assert again.search(asked(vectors).where("qid = 0"), 3, 2).count() == 3


def test_large_query_sets_meet_in_blocks(spark, vectors):
    few = vectors.where("vec_id < 400")
    want = rows(vector_topk(asked(vectors), few, 3))
    assert rows(vector_topk_in_blocks(asked(vectors), few, 3, most=10)) == want


def test_text_vectors_equal_a_plain_computation(spark, tmp_path):
    texts = [(i, f"title {i % 5}", f"Shared words, and word{i} word{i % 7} word{i % 7}") for i in range(60)] + [(100, None, None), (101, "", " .,!"), (102, "Ünï", None), (103, "x " * 50_000, "y")]
    df = spark.createDataFrame(texts, "number long, title string, body string").repartition(3)
    slot = lambda w: F.crc32(w.cast("binary"))
    got = {r.number: r.embedding for r in V.tfidf_vectors(df, "number", "title", "body", 32, slot).collect()}
    count = {i: np.bincount([zlib.crc32(w.encode()) % 32 for w in re.findall(r"[^\W_]+", f"{t or ''}\n{b or ''}".lower())], minlength=32) for i, t, b in texts}
    idf = np.log((len(texts) + 1) / (sum(c > 0 for c in count.values()) + 1))
    for i, c in count.items():
        v = c * idf
        assert got[i] is None if not np.linalg.norm(v) else np.allclose(got[i], v / np.linalg.norm(v))
    index = V.VectorIndex.create(V.tfidf_vectors(df, "number", "title", "body"), f"file://{tmp_path}/t", vid="number")
    near = rows(index.search(V.tfidf_vectors(df, "number", "title", "body").where("number = 7").withColumnRenamed("number", "qid"), 3, len(index.centroids)))
    assert near[0][2] == 7 and near[0][3] == 1.0
