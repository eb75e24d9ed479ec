"""Embedding near-dedup by NN-descent over a forest of projection trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, table, written
from .components import components

LEAF = 1024  # vectors compared all with all at the leaves
GROUP = 16_384  # vectors a task holds at once
BLOCK = 4096  # vectors of a block, two of which are compared exactly at once


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid() -> Column:
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Stretches of equal keys (the first ``keys`` columns, sorted), at most GROUP rows at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for a, z in zip(at, at[1:]):
            key = tuple(c[a] for c in cols)
            if last is not None and (key != last or sum(x.num_rows for x in held) >= GROUP):
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _leaves(x: np.ndarray, rng: np.random.Generator, leaf: int) -> Iterator[np.ndarray]:
    """Row numbers of leaves of ``leaf`` rows at most, halved along random directions."""
    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            yield at
            continue
        order = at[np.argsort(x[at] @ rng.standard_normal(x.shape[1]), kind="stable")]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]


def _tree(reps: DataFrame, seed: int, k: int, threshold: float, centres: dict, bits: int, leaf: int) -> DataFrame:
    """(u, w, sim) pairs, u < w: each vector's ``k`` nearest in its leaf of one tree, and all at the threshold."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, dims, vecs = b.columns
            dim = dims.to_numpy()
            code, proj = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = _unit(vecs.take(pa.array(at)), d)
                y = labels.to_numpy()[at]
                mu = np.stack([centres.get((int(v), int(d)), np.zeros(d)) for v in y])
                p = (x - mu) @ np.random.default_rng([seed, int(d)]).standard_normal((d, bits + 1))
                code[at] = (p[:, :bits] > 0) @ (1 << np.arange(bits))
                proj[at] = p[:, bits]
            yield pa.RecordBatch.from_arrays([labels, dims, pa.array(code), pa.array(proj), ids, vecs], names=["label", "dim", "code", "proj", "id", "v"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, t in enumerate(_runs(batches, 3)):
            dim = t.column("dim")[0].as_py()
            x = _unit(t.column("v").combine_chunks(), dim)
            ids = t.column("id").to_numpy()
            for at in _leaves(x, np.random.default_rng([seed, n]), leaf):
                s = x[at] @ x[at].T
                np.fill_diagonal(s, -2.0)
                keep = s >= threshold
                if len(at) > 1:
                    m = min(k, len(at) - 1)
                    best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    keep[np.arange(len(at))[:, None], best] = True
                i, j = np.nonzero(np.triu(keep | keep.T, 1))
                yield _pairs(ids[at[i]], ids[at[j]], s[i, j])

    rows = reps.mapInArrow(coded, "label long, dim int, code long, proj double, id long, v array<double>")
    rows = rows.repartitionByRange("label", "dim", "code", "proj").sortWithinPartitions("label", "dim", "code", "proj")
    return rows.mapInArrow(near, "u long, w long, sim double")


def _pairs(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    keep = a != b
    a, b, sim = a[keep], b[keep], sim[keep]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sim)], names=["u", "w", "sim"])


def _lists(pairs: DataFrame, k: int, longest: int, threshold: float) -> DataFrame:
    """Neighbour lists (u, w, sim): the ``k`` nearest, and up to ``longest`` of those at the threshold.

    A list whose ``k`` nearest all reach the threshold is saturated; it grows as ``longest`` doubles.
    """
    both = pairs.select("u", "w", "sim").unionByName(pairs.select(F.col("w").alias("u"), F.col("u").alias("w"), "sim"))
    by = Window.partitionBy("u").orderBy(F.desc("sim"), "w")
    ranked = both.withColumn("r", F.row_number().over(by)).where(F.col("r") <= longest)
    return ranked.where((F.col("r") <= k) | (F.col("sim") >= threshold)).select("u", "w", "sim")


def _local_join(lists: DataFrame, reps: DataFrame, members: int, seed: int, threshold: float) -> DataFrame:
    """Pairs among the neighbours, either way, of each vector: at the threshold or better than what one of them has."""
    worst = lists.groupBy("u").agg(F.min("sim").alias("worst"))
    either = lists.select(F.col("u").alias("mid"), F.col("w").alias("m")).unionByName(lists.select(F.col("w").alias("mid"), F.col("u").alias("m"))).distinct()
    by = Window.partitionBy("mid").orderBy(F.xxhash64("mid", "m", F.lit(seed)))  # a fresh choice each round
    some = either.withColumn("r", F.row_number().over(by)).where(F.col("r") <= members).drop("r")
    vec = reps.select(F.col("id").alias("m"), "dim", "v").join(worst.withColumnRenamed("u", "m"), "m", "left")
    rows = some.join(vec, "m").select("mid", "m", "dim", F.coalesce("worst", F.lit(-1.0)).alias("worst"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for t in _runs(batches, 1):
            if t.num_rows < 2:
                continue
            x = _unit(t.column("v").combine_chunks(), t.column("dim")[0].as_py())
            ids, worst_ = t.column("m").to_numpy(), t.column("worst").to_numpy()
            s = x @ x.T
            i, j = np.nonzero(np.triu((s >= threshold) | (s > np.minimum(worst_[:, None], worst_[None, :])), 1))
            out.append((ids[i], ids[j], s[i, j]))
            size += len(i)
            if size > 100_000:
                yield _pairs(*(np.concatenate(c) for c in zip(*out)))
                out, size = [], 0
        if out:
            yield _pairs(*(np.concatenate(c) for c in zip(*out)))

    return rows.repartition("mid").sortWithinPartitions("mid").mapInArrow(run, "u long, w long, sim double").dropDuplicates(["u", "w"])


#: An audit asks four times as many vectors until it has met so many true links, or has asked all vectors or so many.
MET, ASKED = 50, 6_400


def _recall(links: DataFrame, pairs: DataFrame, reps: DataFrame, threshold: float, queries: int) -> float:
    """Share of true links, found by brute force against all vectors, that are in ``links``.

    ``queries`` vectors are asked first. Where they have fewer than MET true links, four times as many are,
    up to all vectors or ASKED, half of them at random. So a table of rare links is not taken for
    one without: if 3,200 random vectors have none, under one in 1,000 has one (at odds of 19 to 1).
    """
    n = reps.count()
    while True:
        found, true = _audit(links, pairs, reps, threshold, queries)
        if true >= MET or queries >= min(2 * n, ASKED):
            return found / true if true else 1.0
        queries = min(4 * queries, ASKED)


def _audit(links: DataFrame, pairs: DataFrame, reps: DataFrame, threshold: float, queries: int) -> tuple[int, int]:
    """(known, all) true links of ``queries`` vectors.

    Half of the vectors are among those whose nearest known neighbour is at the threshold or next to it.
    """
    some = lambda df, n: df.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(n)
    close = pairs.where(F.col("sim") >= threshold - 0.02)
    close = close.select(F.col("u").alias("id")).unionByName(close.select(F.col("w").alias("id"))).distinct()
    asked = some(reps.join(close, "id", "left_semi"), queries // 2).unionByName(some(reps, queries - queries // 2)).dropDuplicates(["id"])
    asked = asked.toArrow()  # `queries` vectors at most
    if not asked.num_rows:
        return 0, 0
    ids, labels, dims = (asked.column(c).to_numpy() for c in ("id", "label", "dim"))
    unit = {int(d): _unit(asked.column("v").combine_chunks().take(pa.array(np.flatnonzero(dims == d))), d) for d in np.unique(dims)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column(2).to_numpy()
            for d in np.unique(dim):
                if int(d) not in unit:
                    continue
                at, q = np.flatnonzero(dim == d), np.flatnonzero(dims == d)
                s = unit[int(d)] @ _unit(b.column(3).take(pa.array(at)), d).T
                other, label = b.column(0).to_numpy()[at], b.column(1).to_numpy()[at]
                i, j = np.nonzero((s >= threshold) & (labels[q][:, None] == label[None, :]))
                yield _pairs(ids[q][i], other[j], s[i, j])

    true = reps.mapInArrow(run, "u long, w long, sim double").dropDuplicates(["u", "w"])
    got = true.join(links.select("u", "w", F.lit(1).alias("hit")), ["u", "w"], "left").agg(F.count("*"), F.count("hit")).first()
    return got[1], got[0]


def _exact(reps: DataFrame, size: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n) from comparing all vectors of a label, block against block.

    Rows with a = b add ``n`` rows to the links of a; the others join what is connected within two
    blocks. So a dense group gives rows in proportion to its size per pair of blocks, not its square.
    """
    per = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    rows = reps.join(per, ["label", "dim"]).join(size, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("label", "dim", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "block", "id", "size", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 4):
            x = _unit(t.column("v").combine_chunks(), t.column("dim")[0].as_py())
            ids, sizes, block = (t.column(c).to_numpy() for c in ("id", "size", "block"))
            near = np.zeros((len(x), len(x)), bool)
            for a in range(0, len(x), 512):
                near[a : a + 512] = x[a : a + 512] @ x.T >= threshold
            if t.column("lo")[0].as_py() != t.column("hi")[0].as_py():
                near &= block[:, None] != block[None, :]
            near |= near.T
            np.fill_diagonal(near, False)
            n = np.array([sizes[r].sum() for r in near], dtype=np.int64)
            left, of = near.any(axis=1), np.arange(len(x))
            for i in range(len(x)):
                if left[i]:
                    front = np.array([i])
                    left[i] = False
                    while len(front):
                        front = np.flatnonzero(near[front].any(axis=0) & left)
                        left[front] = False
                        of[front] = i
            ties = np.flatnonzero(of != np.arange(len(x)))
            some = np.flatnonzero(n)
            a, b = np.concatenate([ids[some], ids[of[ties]]]), np.concatenate([ids[some], ids[ties]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([n[some], np.zeros(len(ties), np.int64)]))], names=["a", "b", "n"])

    keys = ["label", "dim", "lo", "hi"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, n long")


def vector_dedup(
    vectors: DataFrame, threshold: float = 0.98, k: int = 6, trees: int = 3, max_rounds: int = 6, recall: float = 0.98,
    queries: int = 400, sample: int = 5_000, leaf: int = LEAF, id_col: str = "vec_id",
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; vectors link within a label at a cosine of ``threshold``.

    Equal vectors of a label are one node. Lists start from ``trees`` trees, then rounds join
    neighbours of neighbours; the threshold links of all rounds are kept. Rounds end once a round
    adds under half a percent of links and the audit (``queries`` vectors against all) finds
    ``recall``; a failed audit adds a tree. Where the audit still fails after ``max_rounds``, as in
    dense groups too large for the lists, all vectors of a label are compared exactly, in blocks;
    that costs the square of a label. The trees' centres come from ``sample`` vectors at most.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; so do vectors of different lengths, and rows without an id. Rows repeated with one
    id count as vectors of their own. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = _valid() & F.col("vec_id").isNotNull()
    per = rows.where(fine).groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size"))
    for seed in range(20):  # a class's id is a hash of label and vector; no two classes may share one
        classes = written(per.withColumn("id", F.xxhash64(F.lit(seed), "label", "embedding")), "classes")
        if classes.groupBy("id").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("classes of vectors could not be told apart")
    reps = written(classes.select("id", "label", F.size("embedding").cast("int").alias("dim"), F.col("embedding").alias("v")), "reps")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits = min(20, max(0, math.ceil(math.log2(max(1, largest) / (2 * leaf)))))
    seen = reps.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()  # `sample` vectors at most
    groups: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(zip(seen.column("label").to_pylist(), seen.column("dim").to_pylist())):
        groups.setdefault(key, []).append(i)
    v = seen.column("v").combine_chunks()
    centres = {key: _unit(v.take(pa.array(at)), key[1]).mean(0) for key, at in groups.items()}

    keep = ["u", "w", "sim"]
    pairs = None
    for t in range(trees):
        one = _tree(reps, t, k, threshold, centres, bits, leaf)
        pairs = one if pairs is None else pairs.unionByName(one)
    pairs = written(pairs.dropDuplicates(["u", "w"]), "pairs")
    longest = 2 * k
    for n in range(max_rounds):
        links = pairs.where(F.col("sim") >= threshold)
        before = links.count()
        lists = written(_lists(pairs, k, longest, threshold), "lists")
        more = _local_join(lists, reps, members=min(64, 16 << n), seed=n, threshold=threshold)
        nxt = pairs.select(keep).unionByName(more.select(keep)).dropDuplicates(["u", "w"])
        nxt = written(nxt, "pairs")
        delete(pairs)
        delete(lists)
        pairs, longest = nxt, 2 * longest
        links = pairs.where(F.col("sim") >= threshold)
        after = links.count()
        if after - before <= 0.005 * after:
            done = _recall(links, pairs, reps, threshold, queries) >= recall
            if done:
                break
            extra = _tree(reps, trees + n, k, threshold, centres, bits, leaf)
            nxt = written(pairs.select(keep).unionByName(extra.select(keep)).dropDuplicates(["u", "w"]), "pairs")
            delete(pairs)
            pairs = nxt
    else:  # what the last round or its tree added counts too
        done = _recall(pairs.where(F.col("sim") >= threshold), pairs, reps, threshold, queries) >= recall
    size = classes.select("id", "size")
    if done:
        links = written(pairs.where(F.col("sim") >= threshold).select("u", "w"), "links")
        delete(pairs)
        sides = links.unionByName(links.select(F.col("w").alias("u"), F.col("u").alias("w")))
        degree = sides.join(size.withColumnRenamed("id", "w"), "w").groupBy("u").agg(F.sum("size").alias("others")).withColumnRenamed("u", "id")
        comp = components(links.select(F.col("u").alias("a"), F.col("w").alias("b")))
    else:
        delete(pairs)
        exact = written(_exact(reps, size, threshold), "exact")
        degree = exact.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
        comp = components(exact.select("a", "b"))
    known = classes.join(degree, "id", "left").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = known.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = known.join(least, "component").select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    linked = rows.where(fine).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_embedding_near_dedup": op8_embedding_near_dedup}
SQL: dict[str, str] = {}
