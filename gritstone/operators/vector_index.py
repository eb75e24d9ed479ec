"""Vector index: centroids, inverted lists in a table partitioned by list, search of the nearest lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..llm.common import bound_batches
from .graph import SCORES, _best, _unit_rows, vector_topk

#: Lists of an index at most: centroids go to every task, this many of them.
LISTS = 4096
#: Rows that centroids are fitted on, about; every row is indexed.
SAMPLE = 50_000
#: Queries and vectors that meet in one task, about.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 16_384
#: Queries an audit compares with all rows.
AUDIT = 200
#: Words of texts that a task counts at once.
WORDS_AT_ONCE = 1 << 18


def fine(vec: str, dims: int | None = None):
    """Vectors that have a cosine with others: not null, not zero, all components finite, of length ``dims``."""
    c = F.col(vec)
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    return F.coalesce(ok if dims is None else ok & (F.size(c) == dims), F.lit(False))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return _unit_rows(lists, dims) if len(lists) else np.zeros((0, dims))


def nearest_lists(rows: DataFrame, centroids: np.ndarray, k: int, vec: str = "v") -> DataFrame:
    """``rows`` with ``list``, a row for each of the ``k`` centroids of greatest cosine; ties by number."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)  # LISTS at most
    dims = centroids.shape[1]
    k = min(k, len(centroids))
    names = [*rows.columns, "list"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        step = max(1, SCORES // len(c))
        for b in batches:
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                score = _matrix(part.column(vec), dims) @ c.T
                at = np.argmax(score, 1)[:, None] if k == 1 else np.argsort(-score, 1, kind="stable")[:, :k]
                again = part.take(pa.array(np.repeat(np.arange(part.num_rows), k)))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(at.ravel().astype(np.int32))], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())]))


def fit_centroids(sample: DataFrame, dims: int, lists: int, rounds: int = 5) -> np.ndarray:
    """Unit centroids of ``lists`` groups of ``sample`` (id, v), by k-means on cosine.

    The first are the vectors of the least hashes. A round is an aggregate: tasks add up the unit
    vectors nearest to each centroid, sums meet by (list, component), and lists times ``dims`` numbers
    reach the driver. A centroid that no vector is nearest to stays.
    """
    first = sample.orderBy(F.xxhash64("id", "v"), "id").limit(lists).select("v").toArrow().column("v").combine_chunks()
    c = _matrix(first, dims)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((lists, dims))
        for b in batches:
            np.add.at(total, b.column("list").to_numpy(), _matrix(b.column("v"), dims))
        at = np.flatnonzero(np.abs(total).sum(1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["list", "total"])

    for _ in range(rounds):
        part = nearest_lists(sample, c, 1).select("list", "v").mapInArrow(sums, "list int, total array<double>")
        rows = part.select("list", F.posexplode("total").alias("i", "x")).groupBy("list", "i").agg(F.sum("x").alias("x")).toArrow()
        new = np.zeros_like(c)
        new[rows.column("list").to_numpy(), rows.column("i").to_numpy()] = rows.column("x").to_numpy()
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(norm > 0, new / np.maximum(norm, 1e-300), c)
    return c


def topk_in_blocks(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, vid, score, rank): of each query the ``k`` vectors of greatest cosine among those of its lists; ties by id.

    ``queries`` is (qid, v, list), ``vectors`` (vid, v, list); vectors of a list have one length. Both are dealt into blocks within a
    list, as many as the list's count asks for; each pair of blocks meets in one task, multiplies as
    matrices, and keeps ``k`` of a query. So a list with a third of all vectors is many tasks, a
    query set of any size is, and neither passes the driver.
    """
    q, v = queries.select("qid", "v", "list"), vectors.select("vid", "v", "list")
    blocks = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    n = blocks(q, QUERY_BLOCK, "nq").join(blocks(v, VECTOR_BLOCK, "nv"), "list")  # LISTS rows at most
    at = lambda id_, m: F.pmod(F.xxhash64(id_), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    qs = q.join(F.broadcast(n), "list").select("list", at("qid", "nq").alias("qb"), every("nv").alias("vb"), "qid", "v")
    vs = v.join(F.broadcast(n), "list").select("list", every("nq").alias("qb"), at("vid", "nv").alias("vb"), "vid", "v")
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("vid", vectors.schema["vid"].dataType), T.StructField("score", T.DoubleType())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        dims = len(left.column("v")[0]) if len(left) else 1
        ids, vids = left.column("qid").combine_chunks(), right.column("vid").combine_chunks()
        order = pc.sort_indices(vids)
        vids, m = vids.take(order), _matrix(right.column("v").combine_chunks().take(order), dims)
        found = []
        step = max(1, SCORES // max(1, len(vids)))
        u = _matrix(left.column("v").combine_chunks(), dims) if len(vids) else np.zeros((0, dims))
        for a in range(0, len(u), step):
            score = np.rint(u[a : a + step] @ m.T * 1e6).astype(np.int64)
            size = score.shape[1]
            key = score * size - np.arange(size)  # one order of scores, then of ids
            top = np.argpartition(-key, k - 1, axis=1)[:, :k] if size > k else np.broadcast_to(np.arange(size), score.shape)
            found.append((np.repeat(np.arange(a, a + len(score)), top.shape[1]), np.take_along_axis(score, top, 1).ravel(), vids.take(pa.array(top.ravel()))))
        if not found:
            return pa.table([ids[:0], vids[:0], pa.array([], pa.float64())], names=["qid", "vid", "score"])
        q_, score_, v_ = _best(found, k)
        return pa.table([ids.take(pa.array(q_)), v_, pa.array(score_ / 1e6)], names=["qid", "vid", "score"])

    met = qs.groupBy("list", "qb", "vb").cogroup(vs.groupBy("list", "qb", "vb")).applyInArrow(best, schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vid"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


class VectorIndex:
    """K-24: an index in a folder: ``centroids`` (list, v), and ``lists`` (vid, v), partitioned by list.

    Vectors that are null or zero, hold null or non-finite components, or are not of the index's
    length are in no list, and as queries have no neighbours. Ids may repeat; each row is indexed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("list").toArrow()  # LISTS at most
        self.dims = int(rows.column("dims")[0].as_py())
        self.schema = f"vid {rows.column('vid_type')[0].as_py()}, v array<double>, list int"
        self.centroids = _matrix(rows.column("v").combine_chunks(), self.dims) if rows.column("v").null_count == 0 else np.zeros((0, self.dims))

    @classmethod
    def create(cls, vectors: DataFrame, path: str, vid: str = "vec_id", vec: str = "embedding", dims: int | None = None, lists: int | None = None, rounds: int = 5) -> VectorIndex:
        """Fits centroids and writes every vector to its list. ``dims``: the length most vectors have; ``lists``: the root of their number.

        A folder that is there is an error. Centroids are fitted on about SAMPLE rows, chosen by a
        hash. A list's rows go to as many files as its size asks for.
        """
        spark, path = vectors.sparkSession, path.rstrip("/")
        if cls.exists(spark, path):
            raise FileExistsError(path)
        v = vectors.select(F.col(vid).alias("vid"), F.col(vec).cast("array<double>").alias("v"))
        if dims is None:
            common = v.where(fine("v")).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
            dims = common.d if common else 0
        v = v.where(fine("v", dims))
        n = v.count()
        lists = max(1, min(n, LISTS, round(n**0.5) if lists is None else lists))
        schema, kind = "list int, v array<double>, dims int, vid_type string", v.schema["vid"].dataType.simpleString()
        if not n:
            v.withColumn("list", F.lit(0)).write.partitionBy("list").parquet(f"{path}/lists")
            spark.createDataFrame([(0, None, dims, kind)], schema).write.parquet(f"{path}/centroids")
            return cls(spark, path)
        part = max(SAMPLE, 20 * lists) / n
        chosen = v if part >= 1 else v.where(F.pmod(F.xxhash64("vid", F.lit("sample")), F.lit(1 << 30)) < int(part * (1 << 30)))
        sample = f"{path}/sample"
        chosen.select(F.col("vid").alias("id"), "v").write.parquet(sample)
        rows = spark.read.parquet(sample)
        c = fit_centroids(rows, dims, min(lists, rows.count()), rounds)
        _delete(spark, sample)
        nearest_lists(v, c, 1).hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")
        spark.createDataFrame([(i, x.tolist(), dims, kind) for i, x in enumerate(c)], schema).coalesce(1).write.parquet(f"{path}/centroids")  # last: an index is whole once it has them
        return cls(spark, path)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/centroids/_SUCCESS")
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def drop(self) -> None:
        """K-24: the index and its folder go; no error where it is gone."""
        _delete(self.spark, self.path)

    def vectors(self, lists: list[int] | None = None) -> DataFrame:
        """Rows of the index; of some lists, only their folders are read."""
        df = self.spark.read.schema(self.schema).parquet(f"{self.path}/lists")
        return df if lists is None else df.where(F.col("list").isin(lists))

    def search(self, queries: DataFrame, k: int, probe: int, qid: str = "qid", vec: str = "embedding") -> DataFrame:
        """V-1: (qid, vid, score, rank), the ``k`` nearest in each query's ``probe`` nearest lists, scored exactly (six digits)."""
        q = queries.select(F.col(qid).alias("qid"), F.col(vec).cast("array<double>").alias("v")).where(fine("v", self.dims))
        none = F.lit(0).alias("list")
        if not len(self.centroids):
            return topk_in_blocks(q.select("*", none).limit(0), self.vectors(), k)
        probe = min(probe, len(self.centroids))
        asked = nearest_lists(q, self.centroids, probe)
        if probe == len(self.centroids):  # every list: one is enough, and blocks deal it out
            return topk_in_blocks(q.select("*", none), self.vectors().drop("list").select("*", none), k)
        wanted = [r.list for r in asked.select("list").distinct().collect()]  # LISTS at most
        return topk_in_blocks(asked, self.vectors(None if len(wanted) == len(self.centroids) else wanted), k)

    def audit(self, queries: DataFrame, k: int, qid: str = "qid", vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
        """About AUDIT of the queries, chosen by a hash, and their true ``k`` nearest of all rows."""
        q = queries.where(fine(vec, self.dims))
        n = q.count()
        few = q if n <= AUDIT else q.where(F.pmod(F.xxhash64(qid, F.lit("audit")), F.lit(n)) < AUDIT)
        few = few.select(F.col(qid).alias("qid"), F.col(vec).cast("array<double>").alias("v"))
        truth = vector_topk(few, self.vectors(), k, "qid", "vid", "v").select("qid", "rank", "score")
        return few, self.spark.createDataFrame(truth.toArrow(), truth.schema)  # k rows for each of the few

    def recall(self, audit: tuple[DataFrame, DataFrame], k: int, probe: int) -> float:
        """Share of the true neighbours of an ``audit`` that ``probe`` lists find; scores are compared, so that ties count."""
        got = self.search(audit[0], k, probe, "qid", "v").select("qid", "rank", F.col("score").alias("got"))
        r = audit[1].join(got, ["qid", "rank"], "left").agg(F.count("*").alias("n"), F.count_if(F.col("got") >= F.col("score") - 1e-6).alias("hit")).first()
        return r.hit / r.n if r.n else 1.0

    def enough_lists(self, queries: DataFrame, k: int, least: float = 0.9, probe: int = 8, qid: str = "qid", vec: str = "embedding") -> int:
        """Lists to probe: ``probe``, and twice as many until ``least`` of the neighbours are found.

        From a quarter of the lists on, all are taken: vectors without groups spread over them anyway, and
        a search of all lists deals no query to each of its lists.
        """
        some = len(self.centroids) / 4
        audit = self.audit(queries, k, qid, vec) if probe < some else None
        while probe < some and self.recall(audit, k, probe) < least:
            probe *= 2
        return probe if probe < some else max(1, len(self.centroids))


def _pieces(sizes: np.ndarray, most: int, total: int) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows: ``most`` rows at most, and sizes of ``total`` at most unless one row alone has more."""
    upto, a = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0
    while a < len(sizes):
        b = int(np.searchsorted(upto, upto[a] + total, "right")) - 1
        b = min(max(b, a + 1), a + most, len(sizes))
        yield a, b - a
        a = b


def tfidf_vectors(rows: DataFrame, id_: str, title: str, body: str, dims: int = 384, slot: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """V-2, offline: (id, embedding): hashed word weights of title and body, of length one; null without a word that tells texts apart.

    A word is a run of letters and digits, in small letters, and counts in the place ``slot`` modulo
    ``dims`` gives. Python gets a bounded number of bytes at once and counts WORDS_AT_ONCE words, so a
    task's memory doesn't grow with rows or their lengths, one text's own words aside. A place weighs ln((texts + 1) / (texts that have it + 1)). Two passes over the texts,
    one aggregate of ``dims`` rows, which tasks get as an array; texts don't move. Null titles and
    bodies are empty; repeated rows are texts of their own.
    """
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    s = rows.select(id_, F.transform(words, lambda w: F.pmod(slot(w), F.lit(dims)).cast("int")).alias("slots"))
    bound_batches(rows.sparkSession)
    n = rows.count()
    idf = np.full(dims, np.log(n + 1.0))
    for r in s.select(F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").count().collect():  # dims at most
        idf[r["slot"]] = np.log((n + 1.0) / (r["count"] + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, n_rows in _pieces(pc.fill_null(pc.list_value_length(b.column("slots")), 0).to_numpy(zero_copy_only=False), max(1, SCORES // dims // 4), WORDS_AT_ONCE):
                part = b.slice(a, n_rows)
                slots = part.column("slots")
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(slots).to_numpy(zero_copy_only=False))
                v = np.bincount(row * dims + slots.flatten().to_numpy(), minlength=part.num_rows * dims).reshape(-1, dims) * idf
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                flat = pa.array((v / np.where(norm > 0, norm, 1)).ravel())
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dims), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pc.if_else(pa.array(norm.ravel() > 0), vectors, pa.scalar(None, vectors.type))], names=[id_, "embedding"])

    return s.mapInArrow(run, T.StructType([s.schema[id_], T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
