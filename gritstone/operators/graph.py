"""Property graph tables, traversals as joins, and vector retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clamp01
from .relational import percentiles

SCORES = 1 << 20  # scores a task holds at once
ROWS = 1 << 13  # vectors that a task compares with queries at once
WORDS = 100_000  # different words of a query set that go to every task


def issue_graph(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G-1: issue nodes and resolved_by edges."""
    nodes = issues.select(F.col("issue_number").alias("number"), "issue.title", F.substring(F.coalesce("issue.body", F.lit("")), 1, 800).alias("body"), "issue.created_at")
    return nodes, issues.select(F.col("issue_number").alias("issue"), F.explode("resolved_by_prs").alias("pr")).distinct()


def pr_graph(prs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G-2: change nodes and touches edges."""
    nodes = prs.select(F.col("pr_number").alias("number"), "pr.title", F.substring(F.coalesce("pr.body", F.lit("")), 1, 1000).alias("body"), "pr.merged_at")
    return nodes, prs.select(F.col("pr_number").alias("pr"), F.explode("files.filename").alias("filename")).where("filename is not null").distinct()


def review_graph(prs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G-3: review nodes, reviewed_in edges, and applies_to edges where a file is named."""
    r = prs.select("pr_number", F.explode("reviews").alias("x")).select(F.concat(F.col("x.id").cast("string"), F.lit("_review")).alias("id"), F.col("pr_number").alias("pr"), "x.body", "x.state", F.lit(None).cast("string").alias("filename"), F.lit(None).cast("string").alias("diff_hunk"), F.lit(False).alias("is_inline_comment"))
    c = prs.select("pr_number", F.explode("review_comments").alias("x")).select(F.concat(F.col("x.id").cast("string"), F.lit("_comment")).alias("id"), F.col("pr_number").alias("pr"), "x.body", F.lit("COMMENTED").alias("state"), F.col("x.path").alias("filename"), "x.diff_hunk", F.lit(True).alias("is_inline_comment"))
    every = r.unionByName(c)
    return every.drop("pr", "filename").dropDuplicates(["id"]), every.select(F.col("id").alias("review"), "pr").distinct(), every.where("filename is not null").select(F.col("id").alias("review"), "filename").distinct()


def yes_samples(nodes: DataFrame, resolved: DataFrame, pr_nodes: DataFrame, touches: DataFrame) -> DataFrame:
    """G-4: issues with a change: change texts and touched files."""
    per = resolved.join(pr_nodes.select(F.col("number").alias("pr"), F.col("body").alias("pr_body")), "pr").join(touches.groupBy("pr").agg(F.sort_array(F.collect_set("filename")).alias("files")), "pr", "left")
    return nodes.join(per.groupBy("issue").agg(F.sort_array(F.collect_set("pr_body")).alias("pr_bodies"), F.array_distinct(F.flatten(F.sort_array(F.collect_list(F.coalesce("files", F.array().cast("array<string>")))))).alias("files")).withColumnRenamed("issue", "number"), "number")


def no_samples(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """G-5: issues without a change."""
    return nodes.join(resolved.select(F.col("issue").alias("number")), "number", "left_anti")


def cosine(a: Column, b: Column) -> Column:
    """V-1: cosine in double precision; null where a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def _bounded(queries: DataFrame, most: int, what: str = "queries") -> DataFrame:
    """A stated query set; more than ``most`` is an error, never a cut."""
    n = queries.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} {what}; run them in blocks")
    return queries


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, qid: str = "qid", vid: str = "vec_id", vec: str = "embedding", most: int = 10_000) -> DataFrame:
    """V-1: the ``k`` nearest by cosine (six digits) of each query, self included; ties by id.

    A stated query set against all rows: at most ``most`` queries (more is an error) go to every
    task as one matrix of unit vectors, and a task keeps its ``k`` best of a query before anything
    moves. ROWS vectors meet SCORES // ROWS queries at a time, so a task's memory is bounded, however
    many queries and vectors there are. Vectors that are null, zero or hold null or non-finite components have no neighbours;
    neither have vectors of different lengths.
    """
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    asked = _bounded(queries.where(fine), most).select(F.col(qid).alias("qid"), F.col(vec).cast("array<double>").alias("v")).toArrow()  # `most` rows at most
    ids = asked.column("qid").combine_chunks()
    sets = {d: (at, _unit_rows(asked.column("v").combine_chunks().take(pa.array(at)), d)) for d, at in _by_size(asked.column("v").combine_chunks())}

    most_held = max(SCORES // 2, 4 * k * len(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, kind = 0, None
        for b in batches:
            kind = b.column(0).type
            for d, rows in _by_size(b.column(1)):
                if d not in sets:
                    continue
                at, q = sets[d]
                for a in range(0, len(rows), ROWS):
                    part = b.take(pa.array(rows[a : a + ROWS]))
                    part = part.take(pc.sort_indices(part.column(0)))
                    m = _unit_rows(part.column(1), d).T
                    n = m.shape[1]
                    step = max(1, SCORES // n)
                    for c in range(0, len(at), step):
                        score = np.rint(q[c : c + step] @ m * 1e6).astype(np.int64)
                        best = np.argpartition(np.arange(n) - score * n, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), score.shape)  # one order of scores, then of ids
                        held.append((np.repeat(at[c : c + step], best.shape[1]), np.take_along_axis(score, best, 1).ravel(), part.column(0).take(pa.array(best.ravel()))))
                        size += best.size
                        if size > most_held:
                            held = [_best(held, k)]
                            size = 2 * len(held[0][0])
        if held:
            q_, score_, v_ = _best(held, k)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q_)), v_, pa.array(score_ / 1e6)], names=["qid", "vid", "score"])

    cols = vectors.where(fine).select(F.col(vid).alias("vid"), F.col(vec).cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("qid", queries.schema[qid].dataType), T.StructField("vid", vectors.schema[vid].dataType), T.StructField("score", T.DoubleType())])
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vid"))
    return cols.mapInArrow(run, schema).withColumn("rank", rank).where(F.col("rank") <= k)


def _by_size(lists: pa.Array) -> list[tuple[int, np.ndarray]]:
    """(length, places of the lists of that length)."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return [(int(d), np.flatnonzero(size == d)) for d in np.unique(size)]


def _unit_rows(lists: pa.Array, dim: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(held: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ``k`` best (query, score, id) of each query."""
    q, score = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    v = pa.concat_arrays([h[2] for h in held])
    place = np.empty(len(q), np.int64)
    place[pc.sort_indices(v).to_numpy()] = np.arange(len(q))
    order = np.lexsort((place, -score, q))
    first = np.searchsorted(q[order], q[order])
    keep = order[np.arange(len(order)) - first < k]
    return q[keep], score[keep], v.take(pa.array(keep))


def vector_topk_in_blocks(queries: DataFrame, vectors: DataFrame, k: int, qid: str = "qid", vid: str = "vec_id", vec: str = "embedding", most: int = 10_000) -> DataFrame:
    """V-1 for a query set of any size: over ``most`` queries meet the vectors in blocks, by one shuffle and without the driver."""
    if queries.limit(most + 1).count() <= most:
        return vector_topk(queries, vectors, k, qid, vid, vec, most)
    from .vector_index import fine, topk_in_blocks

    every = lambda df, id_, name: df.where(fine(vec)).select(F.col(id_).alias(name), F.col(vec).cast("array<double>").alias("v"), F.size(vec).alias("list"))
    return topk_in_blocks(every(queries, qid, "qid"), every(vectors, vid, "vid"), k)


def retrieve_files(top: DataFrame, resolved: DataFrame, touches: DataFrame) -> DataFrame:
    """G-6: from neighbours (self dropped after the top k) to changes to files, with similarity."""
    near = top.where("qid <> vid").select("qid", F.col("vid").alias("issue"), "score")
    return near.join(resolved, "issue").join(touches, "pr").select("qid", "issue", "score", "pr", "filename")


def rank_files(rows: DataFrame, k: int = 6) -> DataFrame:
    """G-7: files by summed similarity; ties by name."""
    s = rows.groupBy("qid", "filename").agg(F.sum("score").alias("weight"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("weight"), "filename"))).where(F.col("rank") <= k)


def cotouched(touches: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """G-8: files changed together with each seed file, by number of changes; the seed itself is left out.

    Two equi-joins by change; a change with very many files gives many pairs only if it holds a seed.
    """
    hit = touches.join(seeds.select(F.col("filename").alias("seed")).distinct(), F.col("filename") == F.col("seed")).select("pr", "seed")
    n = hit.join(touches, "pr").where("filename <> seed").groupBy("seed", "filename").agg(F.countDistinct("pr").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("n"), "filename"))).where(F.col("rank") <= k)


def idioms(touches: DataFrame, pr_nodes: DataFrame, seeds: DataFrame, k: int = 20, chars: int = 220) -> DataFrame:
    """G-9: texts of a file's newest changes."""
    r = touches.join(seeds.select("filename").distinct(), "filename", "left_semi").join(pr_nodes.select(F.col("number").alias("pr"), "body"), "pr").where("body <> ''")
    rank = F.row_number().over(Window.partitionBy("filename").orderBy(F.desc("pr")))
    return r.withColumn("rank", rank).where(F.col("rank") <= k).select("filename", "pr", F.left("body", F.lit(chars)).alias("body"), "rank")


def change_counts(touches: DataFrame) -> DataFrame:
    """G-10."""
    return touches.groupBy("filename").agg(F.countDistinct("pr").alias("n"), F.first(F.lit(None).cast("double")).alias("ci_pass_rate"))


def friction(reviews: DataFrame, applies: DataFrame, k: int = 2, least: int = 20, chars: int = 100) -> DataFrame:
    """G-11: a file's first ``k`` review texts, then only those over ``least`` characters."""
    r = applies.join(reviews.select(F.col("id").alias("review"), "body"), "review")
    rank = F.row_number().over(Window.partitionBy("filename").orderBy("review"))
    top = r.withColumn("r", rank).where(F.col("r") <= k)
    said = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("r", "body"))), lambda x: x.body), lambda b: F.length(b) > least)
    return top.groupBy("filename").agg(F.array_join(F.transform(said, lambda b: F.left(b, F.lit(chars))), " | ").alias("friction"))


def label_stats(issues: DataFrame) -> DataFrame:
    """G-12: days open by label: mean, median and 90 % (interpolated). A label of any size is spread over tasks."""
    e = issues.select(F.explode("labels").alias("label"), "days_open")
    p = percentiles(e, "days_open", {"p50": 0.5, "p90": 0.9}, ["label"]).select(F.col("label").alias("l"), "p50", "p90")
    m = e.groupBy("label").agg(F.count("*").alias("n"), F.avg("days_open").alias("avg"))
    return m.join(p, F.col("label").eqNullSafe(F.col("l")), "left").select("label", "n", "avg", "p50", "p90")


def pr_history(touches: DataFrame, pr_nodes: DataFrame, seeds: DataFrame, k: int = 20) -> DataFrame:
    """G-12: the newest changes that touch any of the files."""
    return touches.join(seeds.select("filename").distinct(), "filename", "left_semi").select("pr").distinct().join(pr_nodes.withColumnRenamed("number", "pr"), "pr").orderBy(F.desc("pr")).limit(k)


def retrieval_confidence(scores: Column, weights: Column) -> Column:
    """A-25: confidence from neighbour scores and file weights; three digits.

    0.45 of the mean of the top three, 0.35 of the margin of the best file, 0.20 of concentration
    (1 less the share of greatest entropy); HIGH from 0.72, MEDIUM from 0.45.
    """
    s, w = F.sort_array(scores, False), F.sort_array(weights, False)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    top3 = F.slice(s, 1, 3)
    mean3 = clamp01(total(top3) / F.greatest(F.size(top3), F.lit(1)))
    best, second = F.get(w, F.lit(0)), F.coalesce(F.get(w, F.lit(1)), F.lit(0.0))
    margin = clamp01((best - second) / F.greatest(best, F.lit(1e-9)))
    sum_ = total(w)
    p = F.transform(F.filter(w, lambda x: x > 0), lambda x: x / sum_)
    entropy = -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.ln(x + 1e-12))
    spread = F.when(F.size(p) == 0, 1.0).otherwise(clamp01(entropy / F.greatest(F.ln(F.greatest(F.size(p), F.lit(1)).cast("double")), F.lit(1e-9))))
    raw = clamp01(mean3 * 0.45 + margin * 0.35 + (1 - spread) * 0.20)
    none = (F.size(s) <= 0) | (F.size(w) <= 0)
    return F.struct(
        F.when(none, 0.0).otherwise(F.round(raw, 3)).alias("raw"),
        F.when(none, "LOW").when(raw >= 0.72, "HIGH").when(raw >= 0.45, "MEDIUM").otherwise("LOW").alias("bucket"),
        F.when(none, 0.0).otherwise(F.round(clamp01(F.get(s, F.lit(0))), 3)).alias("sim_top1"), F.when(none, 0.0).otherwise(F.round(mean3, 3)).alias("sim_top3_mean"),
        F.when(none, 0.0).otherwise(F.round(margin, 3)).alias("margin_norm"), F.when(none, 1.0).otherwise(F.round(spread, 3)).alias("entropy_norm"),
        F.greatest(F.size(w), F.lit(0)).alias("candidate_count"),
    )


def keyword_rank(index: DataFrame, words: DataFrame, k: int = 40, noisy: str | None = None) -> DataFrame:
    """O-4, O-5: indexed files by keywords: 2 for each in the path, 1 for each symbol that holds one.

    ``words`` is (qid, words array), a query set of any size; its different words, WORDS at most (more
    is an error), go to every task. Files in which the same words count the same are one profile, and
    queries with the same words one ask: an ask meets the profiles that hold one of its words. An
    ask's best ``k`` files are in its best ``k`` profiles, by score and first path, and among a
    profile's first ``k`` paths.
    """
    i = index.where(~F.col("path").rlike(noisy)) if noisy else index
    asked = words.select("qid", F.array_sort(F.filter("words", lambda w: w.isNotNull())).alias("ask"))
    asks = asked.select("ask").distinct().withColumn("w", F.explode("ask")).groupBy("ask", "w").agg(F.count("*").alias("times"))
    known = _bounded(asks.select("w").distinct(), WORDS, "words").agg(F.collect_list("w").alias("__w"))
    symbols = F.transform(F.concat(F.coalesce("classes", F.array().cast("array<string>")), F.coalesce("functions", F.array().cast("array<string>"))), F.lower)
    low = i.select("path", F.lower("path").alias("__p"), symbols.alias("__s")).join(F.broadcast(known))
    count = lambda w: F.when(F.contains(F.col("__p"), w), 2).otherwise(0) + F.size(F.filter("__s", lambda s: F.contains(s, w)))
    held = F.filter(F.transform(F.array_sort("__w"), lambda w: F.struct(w.alias("w"), count(w).alias("n"))), lambda x: x.n > 0)
    file = low.select("path", held.alias("profile")).where(F.size("profile") > 0)
    first = file.withColumn("r", F.row_number().over(Window.partitionBy("profile").orderBy("path"))).where(F.col("r") <= k).select("profile", "path")
    counts = first.groupBy("profile").agg(F.min(F.struct("path")).alias("least")).select("profile", "least", F.explode("profile").alias("x"))
    score = F.sum(F.col("times") * F.col("x.n")).cast("int").alias("score")
    best = asks.join(counts, F.col("w") == F.col("x.w")).groupBy("ask", "profile", "least").agg(score)
    top = lambda df, of, then: df.withColumn("rank", F.row_number().over(Window.partitionBy(of).orderBy(F.desc("score"), then))).where(F.col("rank") <= k)
    files = top(best, "ask", "least").select("ask", "profile", "score").join(first, "profile").select("ask", "path", "score")
    return top(asked.join(top(files, "ask", "path").drop("rank"), "ask").select("qid", "path", "score"), "qid", "path")


def nearest_tests(sources: DataFrame, tests: DataFrame, k: int = 8) -> DataFrame:
    """O-6: test files for a source: 3 for its directory, 2 for its stem; then by path. Equi-joins on either.

    Only the first ``k`` tests, by path, of a directory, of a stem, and of both together can be
    among a source's best ``k``: of those before them no more than ``k`` score higher. So a
    directory with most of all tests gives ``k`` rows to a source. A path counts once.
    """
    dir_ = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+?)(?:\.\w+)?$", 1), r"^test_|_test$", "")
    s = sources.select(F.col("path").alias("source"), dir_(F.col("path")).alias("d"), stem(F.col("path")).alias("n")).distinct()
    t = tests.select("path", dir_(F.col("path")).alias("td"), stem(F.col("path")).alias("tn")).distinct()
    score = F.when(F.col("d") == F.col("td"), 3).otherwise(0) + F.when(F.col("n") == F.col("tn"), 2).otherwise(0)

    def met(on: dict[str, str]) -> DataFrame:
        first = t.withColumn("r", F.row_number().over(Window.partitionBy(*on).orderBy("path"))).where(F.col("r") <= k)
        return s.join(first, [F.col(b) == F.col(a) for a, b in on.items()]).select("source", "path", score.alias("score"))

    r = met({"td": "d"}).unionByName(met({"tn": "n"})).unionByName(met({"td": "d", "tn": "n"})).distinct()
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "path"))).where(F.col("rank") <= k)


def nearest_symbols(symbols: DataFrame, touched: DataFrame, k: int) -> DataFrame:
    """O-7: a file's symbols by distance from its first touched line."""
    j = symbols.join(touched.groupBy("path").agg(F.min("line").alias("line")), "path").withColumn("distance", F.abs(F.col("lo") - F.col("line")))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy("distance", "lo", "name"))).where(F.col("rank") <= k)


def context_symbols(symbols: Column, ranges: Column, most: int = 8, untouched_below: int = 6) -> Column:
    """O-8: touched symbols first, then by line; ``most`` in all, untouched ones only while under ``untouched_below``."""
    hit = lambda s: F.exists(ranges, lambda r: (r.lo <= s.hi) & (r.hi >= s.lo))
    touched = F.slice(F.array_sort(F.filter(symbols, hit)), 1, most)
    others = F.array_sort(F.filter(symbols, lambda s: ~hit(s)))
    room = F.greatest(F.lit(0), F.least(F.lit(untouched_below), F.lit(most)) - F.size(touched))
    return F.concat(touched, F.slice(others, 1, room))


def first_alias_in_index(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """F-15: (id, path) of the first alias the index knows."""
    e = wanted.select("id", F.posexplode("aliases").alias("pos", "path")).join(index.select("path"), "path", "left_semi")
    return e.groupBy("id").agg(F.min_by("path", "pos").alias("path"))


def similar_edges(queries: DataFrame, vectors: DataFrame, k: int = 5, vid: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """G-13: (src, dst, score, rank) edges from each vector of a stated set to the ``k`` most similar others."""
    top = vector_topk_in_blocks(queries.select(F.col(vid).alias("qid"), vec), vectors, k + 1, "qid", vid, vec).where("qid <> vid")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vid"))
    return top.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("qid").alias("src"), F.col("vid").alias("dst"), "score", "rank")


def text_vector(title: Column, body: Column, dim: int = 64) -> Column:
    """V-2, offline: signed word counts of title and body in ``dim`` hashed places, of length one; null without words."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    sign = lambda h: F.when(h < 0, -1.0).otherwise(1.0)
    at = lambda hs, i: F.aggregate(F.filter(hs, lambda h: F.pmod(h, F.lit(dim)) == i), F.lit(0.0), lambda a, h: a + sign(h))
    counts = once(F.transform(words, lambda w: F.xxhash64(w)), lambda hs: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: at(hs, i)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return once(counts, lambda v: once(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))))


def code_spans(index: DataFrame, issues: DataFrame, k: int = 20) -> DataFrame:
    """P-33: an issue's first ``k`` symbols (by path, then line) that hold one of its words, or whose file's name does.

    ``index`` is (path, symbols array of name, type, start_line, end_line); ``issues``, a query set of
    any size, is (qid, text). Words are those of over three letters and nothing but letters, so a word
    lies within a run of letters of a name. Different words and runs meet by the word's first four
    letters; a run brings its first ``k`` symbols, a word the first ``k`` of its runs, and an issue the
    first ``k`` of its words. A symbol that is listed twice counts once.
    """
    said = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, "^[.,;:!?()\\[\\]{}\"'`#]+|[.,;:!?()\\[\\]{}\"'`#]+$", ""))
    words = F.array_distinct(F.filter(said, lambda w: w.rlike(r"^\p{L}{4,}$")))
    asked = issues.select("qid", F.explode(words).alias("word")).distinct()
    span = ["path", "start_line", "symbol", "type", "end_line"]
    first = lambda df, of: df.withColumn("rank", F.row_number().over(Window.partitionBy(of).orderBy(*span))).where(F.col("rank") <= k)
    rows = index.select("path", F.explode("symbols").alias("s")).select("path", F.col("s.start_line").alias("start_line"), F.col("s.name").alias("symbol"), F.col("s.type").alias("type"), F.col("s.end_line").alias("end_line")).distinct()
    runs = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(\p{L}{4,})"), 1)
    every = F.array_union(runs(F.regexp_extract("path", r"([^/]*)$", 1)), runs(F.col("symbol")))
    of_run = first(rows.select(*span, F.explode(every).alias("run")), "run").select("run", *span)
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - 3), lambda i: F.substring(F.col("run"), i, F.lit(4))))
    known = asked.select("word", F.substring("word", 1, 4).alias("four")).distinct()
    met = known.join(of_run.select("run").distinct().withColumn("four", F.explode(starts)), "four").where(F.contains("run", F.col("word"))).select("word", "run")
    of_word = first(met.join(of_run, "run").select("word", *span).distinct(), "word").select("word", *span)
    hit = first(asked.join(of_word, "word").select("qid", *span).distinct(), "qid")
    return hit.select("qid", "path", "symbol", "type", "start_line", "end_line", "rank")


def symbol_counts(index: DataFrame) -> DataFrame:
    """A-26: classes, functions and files of a symbol index."""
    size = lambda c: F.sum(F.coalesce(F.size(F.coalesce(c, F.array().cast("array<string>"))), F.lit(0))).cast("long")
    return index.agg(size("classes").alias("classes"), size("functions").alias("functions"), F.count("*").alias("files"))
