"""Suffix-array dedup: repeated fixed-length strings, counted by hashes at anchors.

This is not prefix doubling, which sorts a (position, rank) pair for each byte in every round: at 16
bytes a pair that is some thirty times the text for each of nine rounds, where the check allows
four times the compressed input on disk. Instead each start of a ``length``-byte string owns to the
least gram within it, which equal strings share at equal distances, and Spark counts hashes of
ever finer sets of starts; only what is neither settled as repeated nor as unique goes on:

1. anchors: all starts that own to one gram, hashed together over their whole stretch;
2. blocks of BLOCK starts at equal distances from grams that repeat;
3. single starts.

Equality rests on 64-bit hashes (gram and stretch together). Text is read twice and only texts with
repeated grams move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, free, release, sieved, table, written

BLOCK = 16
GRAM = 64
CHUNK = 1 << 19


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each ``gram``-byte string (a power of two), by doubling its length."""
    h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    m = 1
    while m < gram:
        h = h[:-m] * np.uint64(0xBF58476D1CE4E5B9 + 2 * m) + h[m:]
        h ^= h >> np.uint64(31)
        m *= 2
    return h * np.uint64(0x94D049BB133111EB)


def owned(raw: bytes, length: int, gram: int = GRAM, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: (gram hash, anchor, first start, last start) of each run of starts.

    Each start of a ``length``-byte string owns to the leftmost least gram within that string. The
    choice depends on those bytes alone, so equal strings meet at equal grams at equal distances.
    """
    parts = []
    n = len(raw) - length + 1
    w = length - gram + 1
    b = np.frombuffer(raw, np.uint8)
    for lo in range(0, n, chunk):
        hi = min(n, lo + chunk)
        full = gram_hashes(b[lo : hi + length - 1], gram)
        key = (full & ~np.uint64((1 << 20) - 1)) | np.arange(len(full), dtype=np.uint64)
        m, low = 1, key
        while 2 * m <= w:
            low = np.minimum(low[:-m], low[m:])
            m *= 2
        if m < w:
            low = np.minimum(low[: len(key) - w + 1], low[w - m : w - m + len(key) - w + 1])
        at = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut, [hi - lo])) - 1
        a = at[first]
        parts.append((full[a], a + lo, first + lo, last + lo))
    g, a, first, last = (np.concatenate(x) for x in zip(*parts))
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]  # a run that a chunk's edge cuts in two is one run
    at = np.flatnonzero(new)
    return g[at], a[at], first[at], last[np.concatenate((at[1:], [len(a)])) - 1]


def _gram(length: int) -> int:
    """The largest power of two up to a quarter of the length, GRAM at most."""
    if length < 8:
        raise ValueError("strings must have 8 bytes or more")
    return min(GRAM, 1 << ((length // 4).bit_length() - 1))


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _lists(sizes: list[int], **cols: np.ndarray) -> pa.ListArray:
    """One list of structs per row, from flat columns."""
    values = pa.StructArray.from_arrays([pa.array(c) for c in cols.values()], names=list(cols))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and a key (k1, k2) that only rows of one id and text share."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("text").alias("k2"), "text"
    )


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """Each text's digest and its anchors: gram, rank of the stretch, place, first and last start."""
    gram = _gram(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, sizes, flat = [], [], [], [[] for _ in range(5)]
            for text in b.column(3):
                raw = _raw(text.as_py())
                n.append(len(raw))
                sha.append(hashlib.sha256(raw).hexdigest())
                if len(raw) < length:
                    sizes.append(0)
                    continue
                g, a, p1, p2 = owned(raw, length, gram)
                h = [xxhash.xxh3_64_intdigest(raw[x : y + length], z - x) for x, y, z in zip(p1.tolist(), p2.tolist(), a.tolist())]
                sizes.append(len(g))
                for to, x in zip(flat, (_signed(g), _signed(np.array(h, dtype=np.uint64)), a.astype(np.int32), p1.astype(np.int32), p2.astype(np.int32))):
                    to.append(x)
            kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)
            cols = [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(flat, kinds)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                 _lists(sizes, **dict(zip(("g", "h", "a", "p1", "p2"), cols)))],
                names=["doc_id", "k1", "k2", "n_bytes", "sha", "anchors"],
            )
        release()

    return docs.mapInArrow(
        run, "doc_id long, k1 long, k2 long, n_bytes long, sha string, anchors array<struct<g: long, h: long, a: int, p1: int, p2: int>>"
    )


def _contexts(part: DataFrame, length: int) -> DataFrame:
    """The stretch of text of every anchor that is to be looked at more closely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k1, k2, text, anchors in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = _raw(text)
                rows += [(k1, k2, x["g"], x["a"], x["p1"], x["p2"], x["one"], raw[x["p1"] : x["p2"] + length]) for x in anchors if x["look"]]
            cols = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["k1", "k2", "g", "a", "p1", "p2", "one", "bytes"])

    return part.select("k1", "k2", "text", "anchors").mapInArrow(
        run, "k1 long, k2 long, g long, a int, p1 int, p2 int, one boolean, bytes binary"
    )


def _blocks(looked: DataFrame, length: int) -> DataFrame:
    """Ranks of the blocks of starts of each anchor: block q holds distances q*BLOCK .. q*BLOCK+BLOCK-1.

    h ranks all bytes of the block's strings: if it repeats, all starts do. c ranks the bytes that all
    strings of such a block have in common, whichever of its starts the anchor owns: unless it repeats, none does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k1, k2, g, a, p1, p2, one, raw in zip(*(c.to_pylist() for c in b.columns)):
                for q in range((a - p2) // BLOCK, (a - p1) // BLOCK + 1):
                    lo, hi = max(p1, a - q * BLOCK - BLOCK + 1), min(p2, a - q * BLOCK)
                    h = xxhash.xxh3_64_intdigest(raw[lo - p1 : hi - p1 + length], (a - lo) * 65_536 + a - hi)
                    last = a - q * BLOCK - p1
                    c = xxhash.xxh3_64_intdigest(raw[last : last - BLOCK + 1 + length])
                    out.append((g, q, c - (1 << 64) if c >> 63 else c, h - (1 << 64) if h >> 63 else h, k1, k2, a, lo, hi, one))
            cols = list(zip(*out)) or [[]] * 10
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["g", "q", "c", "h", "k1", "k2", "a", "lo", "hi", "one"])

    return looked.mapInArrow(run, "g long, q int, c long, h long, k1 long, k2 long, a int, lo int, hi int, one boolean")


def _starts(looked: DataFrame, length: int) -> DataFrame:
    """Ranks of single starts, for the stretches (lo, hi, one) listed in ``of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k1, k2, g, a, p1, raw, of in zip(*(c.to_pylist() for c in b.columns)):
                for x in of:
                    for p in range(x["lo"], x["hi"] + 1):
                        h = xxhash.xxh3_64_intdigest(raw[p - p1 : p - p1 + length])
                        out.append((g, a - p, h - (1 << 64) if h >> 63 else h, k1, k2, p, x["one"]))
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["g", "d", "h", "k1", "k2", "lo", "one"])

    return looked.select("k1", "k2", "g", "a", "p1", "bytes", "of").mapInArrow(
        run, "g long, d int, h long, k1 long, k2 long, lo int, one boolean"
    )


def _cut(raw: bytes, anchors: list, single: list, length: int) -> tuple[int, int, bytes]:
    """(bytes removed, runs, what stays): all starts of ``anchors`` but those in ``single`` repeat."""
    n = len(raw) - length + 1
    mark = np.zeros(n + 1, np.int32)
    for x in anchors:
        mark[x["p1"]] += 1
        mark[x["p2"] + 1] -= 1
    alone = np.zeros(n + 1, np.int32)
    for x in single or ():
        alone[x["lo"]] += 1
        alone[x["hi"] + 1] -= 1
    starts = (np.cumsum(mark)[:n] > 0) & (np.cumsum(alone)[:n] == 0)
    edge = np.zeros(len(raw) + 1, np.int32)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + length] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
    return int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def suffix_dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    With ``with_bytes``, only rows whose text has repeated grams, with ``kept`` (binary) and their key.

    A byte goes if it is covered by a ``length``-byte string that starts anywhere else as well, in
    another row or in the same. Null text is empty; a row given twice repeats itself, so both lose
    their text if it is long enough; null ids are rows like others; an empty table gives no rows; other columns
    are ignored.

    Repeated grams are found by counting, so a passage that a third of all rows share costs a count
    per task; the rows of a gram never meet in one group.
    """
    base = _keyed(docs, id_col, text_col)
    found = written(_anchors(base, length), "anchors")
    flat = found.select("k1", "k2", F.explode("anchors").alias("x")).select("k1", "k2", "x.*")
    # round 1: whole stretches. `first` stands for its class in the next rounds
    kinds = flat.groupBy("g", "h").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "a")).alias("first"))
    kinds = written(kinds, "kinds")
    grams = kinds.groupBy("g").agg(F.sum("n").alias("rows"), F.max((F.col("n") == 1).cast("int")).alias("open")).where("rows > 1")
    kinds2 = kinds.join(grams, "g").select("g", "h", (F.col("n") == 1).alias("one"), F.when(F.col("open") == 1, F.col("first")).alias("first"))
    me = F.struct("k1", "k2", "a")
    part = (
        flat.join(kinds2, ["g", "h"])
        .select("k1", "k2", F.struct("g", "a", "p1", "p2", "one", F.coalesce(F.col("first") == me, F.lit(False)).alias("look")).alias("x"))
        .groupBy("k1", "k2").agg(F.collect_set("x").alias("anchors"))
    )
    part = written(part, "part")
    delete(kinds)  # what follows reads part
    texts = written(sieved(base, part, "k1", "k2")[0].join(part, ["k1", "k2"]), "texts")
    # rounds 2 and 3: what repeats only in part. A row given twice repeats whole: it is here only to be met, and may come twice
    looked = written(_contexts(texts, length), "contexts")
    block = written(
        _blocks(looked, length).groupBy("g", "q", "c", "h").agg(
            F.count("*").alias("n"), F.min(F.struct("k1", "k2", "a", "lo", "hi", "one")).alias("o")
        ),
        "blocks",
    )
    alone = (F.col("n") == 1) & F.col("o.one")
    per = block.groupBy("g", "q", "c").agg(F.count("*").alias("classes"), F.max(alone.cast("int")).alias("open"))
    unique = block.where(alone).join(per.where("classes = 1"), ["g", "q", "c"], "left_semi").select("o.k1", "o.k2", "o.lo", "o.hi")
    again = (
        block.join(per.where("classes > 1 and open = 1"), ["g", "q", "c"], "left_semi")
        .select("o.k1", "o.k2", "o.a", F.struct("o.lo", "o.hi", alone.alias("one")).alias("x"))
        .groupBy("k1", "k2", "a").agg(F.collect_list("x").alias("of"))
    )
    start = _starts(looked.join(again, ["k1", "k2", "a"]), length).groupBy("g", "d", "h").agg(
        F.count("*").alias("n"), F.min(F.struct("k1", "k2", "lo", "one")).alias("o")
    )
    unique = unique.unionByName(start.where(alone).select("o.k1", "o.k2", "o.lo", F.col("o.lo").alias("hi")))
    single = unique.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("single"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, anchors, alone_, k1, k2 in zip(*(c.to_pylist() for c in b.columns)):
                raw = _raw(text)
                gone, runs, kept = _cut(raw, anchors, alone_, length)
                rows.append((doc, len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept, k1, k2))
            cols = list(zip(*rows)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            out = [pa.array(c, k) for c, k in zip(cols, kinds)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "k1", "k2"]
            yield pa.RecordBatch.from_arrays(out if with_bytes else out[:5], names=names if with_bytes else names[:5])
        release()

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary, k1 long, k2 long" * with_bytes
    changed = texts.join(single, ["k1", "k2"], "left").select("doc_id", "text", "anchors", "single", "k1", "k2").mapInArrow(cut, schema)
    zero = F.lit(0).cast("long")
    rest = found.join(part.select("k1", "k2"), ["k1", "k2"], "left_anti")
    same = rest.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return changed.unionByName(same) if not with_bytes else changed


def suffix_dedup_texts(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` without the repeated bytes of ``text``; all rows and columns stay.

    What is left of a character that lost some of its bytes goes too. Unchanged texts stay as they
    are, null included; otherwise as ``suffix_dedup``.
    """
    cut = suffix_dedup(docs, length, with_bytes=True).where("n_removed > 0")
    text_of = F.pandas_udf(lambda s: s.map(lambda x: bytes(x).decode("utf-8", "ignore")), "string")
    k1, k2, left, changed = free(docs, "k1", "k2", "text", "cut")
    new = cut.select(F.col("k1").alias(k1), F.col("k2").alias(k2), text_of("kept").alias(left), F.lit(True).alias(changed))
    new = written(new.dropDuplicates([k1, k2]), "cut")
    names = docs.columns
    keyed = docs.withColumns({k1: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), k2: F.xxhash64(F.coalesce("text", F.lit("")))})
    maybe, still = sieved(keyed, new, k1, k2)
    out = maybe.join(new, [k1, k2], "left")
    out = out.select(*[F.when(F.col(changed), F.col(left)).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in names])
    return still.select(*[F.col(f"`{c}`") for c in names]).unionByName(out)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op4_suffix_array_dedup": op4_suffix_array_dedup}
SQL: dict[str, str] = {}
