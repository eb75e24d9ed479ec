"""Ranked lexical search: MaxScore over shards of documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, release, table, written

#: In UTF-8, a term is a run of digits, letters a to z and bytes from 0x80 on; capitals A to Z count as small ones.
_TERMS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Bytes of a text that are split at once.
CHUNK = 1 << 20
#: Documents and postings of a shard.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1 << 22
#: Items, and bytes of their texts, that go to tasks at once; more go in blocks.
ITEMS, ITEM_BYTES = 5_000, 16 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in its order, piece by piece, so that a very long text is never one list."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        part = text[at:end].translate(_TERMS)
        if end < len(text):  # a term that the end may cut goes with the next piece
            cut = part.rfind(b" ") + 1
            if not cut:
                stop = end
                while stop < len(text) and _TERMS[text[stop]] != 32:
                    stop += 1
                part, end = text[at:stop].translate(_TERMS), stop
            else:
                part, end = part[:cut], at + cut
        yield part.split()
        at = end


def _counted(known: dict[bytes, int]):
    """A row for each document that has terms: id, how many, which of the items' terms, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, size, ids, tfs = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                counts: Counter[bytes] = Counter()
                n = 0
                for part in terms(text or b""):
                    counts.update(part)
                    n += len(part)
                if n:
                    found = sorted((known[t], c) for t, c in counts.items() if t in known)
                    keep.append(i)
                    size.append(n)
                    ids.append([t for t, _ in found])
                    tfs.append([c for _, c in found])
            cols = [b.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(size, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "terms", "tfs"])
        release()

    return run


def _held_by(size: int):
    """How many documents of a task hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    return run


class Items:
    """A block of items: each its terms by number, how often it holds them, and (once known) their weights."""

    def __init__(self, rows: list[tuple]):
        self.ids = [i for i, _ in rows]
        self.known: dict[bytes, int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, text in rows:
            counts: Counter[bytes] = Counter()
            for part in terms((text or "").encode()):
                counts.update(part)
            at = [self.known.setdefault(t, len(self.known)) for t in counts]
            self.held.append((np.array(at, np.int64), np.array(list(counts.values()), np.int64)))


class Best:
    """The ``k`` best documents of an item so far: scores, ids (null ones last), and the score to reach."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1  # scores must be over 0
        self.score, self.null, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def take(self, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        if len(score) > self.k:
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            on = score >= least
            score, null, doc = score[on], null[on], doc[on]
        score, null, doc = (np.concatenate(x) for x in ((self.score, score), (self.null, null), (self.doc, doc)))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.null, self.doc = score[order], null[order], doc[order]
        if len(order) == self.k:
            self.floor = max(1, int(self.score[-1]))


def search_shard(lists: dict[int, tuple[np.ndarray, np.ndarray]], bound: np.ndarray, weight: np.ndarray, item: tuple[np.ndarray, np.ndarray], best: Best, doc: np.ndarray, null: np.ndarray, acc: np.ndarray) -> int:
    """MaxScore for one item over one shard; returns how many documents were scored.

    ``lists``: by term, documents (ascending) and parts of the score without its weight; ``bound``:
    the largest part of each term. Terms are ordered by what they can add at most. The first of
    them, whose sum stays below the score to reach, are non-essential: a document that holds no
    other can't qualify. The others' lists give the candidates, and non-essential lists are probed,
    the largest bound first, for candidates that can still qualify.
    """
    term, times = item
    weigh = weight[term] * times
    most = weigh * bound[term]
    order = np.argsort(most, kind="stable")
    order = order[most[order] > 0]
    sums = np.cumsum(most[order])
    split = int(np.searchsorted(sums, best.floor, side="left"))  # sums below the floor
    if split == len(order):
        return 0
    for j in order[split:]:
        docs, part = lists[int(term[j])]
        acc[docs] += weigh[j] * part
    found = np.flatnonzero(acc)
    score = acc[found]
    acc[found] = 0
    scored = len(found)
    for s in range(split - 1, -1, -1):
        on = score + sums[s] >= best.floor
        found, score = found[on], score[on]
        if not len(found):
            return scored
        j = order[s]
        docs, part = lists[int(term[j])]
        at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
        score = score + np.where(docs[at] == found, weigh[j] * part[at], 0)
    on = score >= best.floor
    if on.any():
        best.take(score[on], null[found[on]], doc[found[on]])
    return scored


def _searched(held: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Each task's ``k`` best of each item, from shards of its documents; what is reached in one shard is the floor of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in held]
        waiting: list[pa.RecordBatch] = []

        def shard() -> None:
            t = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            ids = t.column("doc_id")
            null = ids.is_null().to_numpy()
            doc = ids.fill_null(0).to_numpy()
            sizes = t.column("terms").combine_chunks().value_lengths().to_numpy()
            row = np.repeat(np.arange(len(doc)), sizes)
            m = 75 + 25 * t.column("n").to_numpy() * n_docs // n_terms
            term = t.column("terms").combine_chunks().flatten().to_numpy()
            tf = t.column("tfs").combine_chunks().flatten().to_numpy()
            part = 1_000_000_000 * tf // (1000 * tf + 12 * m[row])
            order = np.argsort(term, kind="stable")
            term, row, part = term[order], row[order], part[order]
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(term)]
            lists = {int(term[a]): (row[a:b], part[a:b]) for a, b in zip(starts, ends)}
            bound = np.zeros(len(weight), np.int64)
            if len(term):
                bound[term[starts]] = np.maximum.reduceat(part, starts)
            acc = np.zeros(len(doc), np.int64)
            for item, b in zip(held, best):
                if len(item[0]):
                    search_shard(lists, bound, weight, item, b, doc, null, acc)

        docs = postings = 0
        for b in batches:
            step = max(1, min(SHARD_DOCS, b.num_rows))
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                waiting.append(part)
                docs += part.num_rows
                postings += len(part.column("terms").flatten())
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    shard()
                    docs = postings = 0
        if waiting:
            shard()
        n = [len(b.score) for b in best]
        if sum(n):
            doc = pa.array(np.concatenate([b.doc for b in best]), mask=np.concatenate([b.null for b in best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), n).astype(np.int32)), doc, pa.array(np.concatenate([b.score for b in best]))], names=["item", "doc_id", "score"])
        release()

    return run


def _block(docs: DataFrame, items: Items, k: int) -> tuple[DataFrame, DataFrame]:
    """(the best of one block of items, counted terms to be deleted): terms are counted, then weighed, then searched, shard by shard where the documents are."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(items.known)
    size = max(1, len(items.known))
    counted = written(docs.mapInArrow(lambda batches: _counted(known.value)(batches), "doc_id long, n long, terms array<int>, tfs array<long>"), "counted")
    total = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(size, np.int64)
    for r in counted.select("terms").mapInArrow(_held_by(size), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow().to_pylist():  # a row for each of the block's terms
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    sent = spark.sparkContext.broadcast((items.held, weight))
    n_docs, n_terms = total.docs, max(1, total.terms)
    tops = counted.mapInArrow(lambda batches: _searched(*sent.value, n_docs, n_terms, k)(batches), "item int, doc_id long, score long")
    return written(_ranked(tops, "item", k), "ranked"), counted


def _ranked(tops: DataFrame, by: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return tops.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of highest score above 0, equal scores by id.

    Documents stay where they are: a task counts the items' terms in its own, and its documents make
    shards of bounded size, with inverted lists that MaxScore reads. Only sums of term counts and
    ``k`` rows a task and item move. Items go to tasks in blocks of ITEMS and ITEM_BYTES at most
    (an item longer than that alone), each block a pass over the documents; every item is asked.

    Null and empty texts have no terms, and items without any give no rows; repeated rows are
    documents of their own; null ids come last among equal scores. Ids are integers. Empty tables
    give none. Other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    named = items.select(F.col(item_col).alias("item_id"), F.col(query_col).alias("text"))
    asked = named.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("longest")).first()
    # dealt by a hash of the row, at about half of what a block may hold, so that chance exceeds it in no block
    blocks = 1 if asked.n <= ITEMS and asked.b <= ITEM_BYTES else 2 * max(-(-asked.n // ITEMS), -(-asked.b // max(1, ITEM_BYTES - asked.longest)) if asked.longest < ITEM_BYTES else asked.n)
    dealt = named.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == b).select("item_id", "text").toArrow().to_pylist()]  # ITEMS at most
        if not rows and blocks > 1:
            continue
        ranked, counted = _block(d, Items(rows), k)
        delete(counted)
        names = spark.createDataFrame(list(enumerate(i for i, _ in rows)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", named.schema["item_id"].dataType)]))
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op11_lexical_search": r"""
with low as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
d as (select doc_id, len(t) as n, t from low where len(t) > 0),
c as (select count(*) as docs, sum(n)::bigint as terms from d),
p as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(t) as term from d) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*) as df from p group by term), c),
i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
q as (select item_id, term, count(*) as times from i group by all),
s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
      from q join p using (term) join w using (term), c group by item_id, doc_id),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
select * from r where rank <= 20"""
}
QUERIES = {"op11_lexical_search": op11_lexical_search}
