"""Byte-level BPE encoding and decoding with segment trees over byte positions."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NONE = 1 << 40  # beyond all ranks; times BATCH_MAX it still fits 64 bits
BATCH_MAX = 256  # longer pieces are encoded one by one
CACHE = 200_000  # pieces a worker remembers


class Vocabulary:
    """Ranks of byte strings, as in a .tiktoken file: a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {
            (ranks[t[:i]] << 32) | ranks[t[i:]]: r
            for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }
        self._pairs(pairs)

    def _pairs(self, pairs: dict[int, int]) -> None:
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def first(self, raw: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens before any merge, of rows of bytes."""
        return self.byte_id[raw]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pair's concatenation, NONE where there is none."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    @classmethod
    @lru_cache(4)
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _encode_one(v: Vocabulary, piece: bytes) -> list[int]:
    """A piece of any length: n log n steps on plain lists."""
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    tok = v.first(np.frombuffer(piece, np.uint8)[None, :], np.array([n]))[0].tolist()
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    none = (1 << 62, 0)
    tree = [none] * (2 * size)
    get = v.pairs.get
    for i in range(n - 1):
        r = get((tok[i] << 32) | tok[i + 1])
        if r is not None:
            tree[size + i] = (r, i)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value: tuple[int, int]) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            best = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
            i >>= 1

    while tree[1] is not none and tree[1][0] < none[0]:
        r, p = tree[1]
        q = nxt[p]
        tok[p], tok[q] = r, -1
        nxt[p] = nxt[q]
        if nxt[q] < n:
            prv[nxt[q]] = p
        put(q, none)
        a = get((r << 32) | tok[nxt[p]]) if nxt[p] < n else None
        put(p, none if a is None else (a, p))
        if prv[p] >= 0:
            b = get((tok[prv[p]] << 32) | r)
            put(prv[p], none if b is None else (b, prv[p]))
    return [t for t in tok if t >= 0]


def _encode_equal(v: Vocabulary, pieces: list[bytes], size: int) -> list[bytes]:
    """Many pieces of ``size`` bytes at most (a power of two): one segment tree a piece, all as rows of one array.

    A leaf holds (rank of the pair that starts here, place); an inner node the lesser of its two
    children, so the root is the leftmost pair of least rank. A step merges that pair in every
    piece that still has one and updates three leaves and their ancestors.
    """
    m = len(pieces)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
    length = np.fromiter(map(len, pieces), np.int64, m)
    place = np.arange(size, dtype=np.int64)
    tok = v.first(raw, length)
    tok[place[None, :] >= length[:, None]] = -1
    tree = np.full((m, 2 * size), NONE * size, dtype=np.int64)
    leaf = v.rank(tok[:, :-1], np.maximum(tok[:, 1:], 0))
    leaf[(tok[:, 1:] < 0)] = NONE
    tree[:, size : 2 * size - 1] = leaf * size + np.where(leaf < NONE, place[:-1], 0)
    s = size // 2
    while s:
        tree[:, s : 2 * s] = np.minimum(tree[:, 2 * s : 4 * s : 2], tree[:, 2 * s + 1 : 4 * s : 2])
        s //= 2
    nxt, prv = np.tile(place + 1, (m, 1)), np.tile(place - 1, (m, 1))
    rows = np.flatnonzero(tree[:, 1] < NONE * size)
    while len(rows):
        best = tree[rows, 1]
        p, r = best % size, best // size
        q = nxt[rows, p]
        tok[rows, p] = r
        tok[rows, q] = -1
        after = nxt[rows, q]
        nxt[rows, p] = after
        has = after < length[rows]
        prv[rows[has], after[has]] = p[has]
        tree[rows, size + q] = NONE * size
        right = np.where(has, v.rank(r, tok[rows, np.where(has, after, p)]), NONE)
        tree[rows, size + p] = np.where(right < NONE, right * size + p, NONE * size)
        before = prv[rows, p]
        had = before >= 0
        left = np.where(had, v.rank(tok[rows, np.maximum(before, 0)], r), NONE)
        at = np.where(had, before, p)
        tree[rows, size + at] = np.where(had, np.where(left < NONE, left * size + at, NONE * size), tree[rows, size + at])
        for x in (q, p, at):
            up = (size + x) >> 1
            while up[0]:
                tree[rows, up] = np.minimum(tree[rows, 2 * up], tree[rows, 2 * up + 1])
                up >>= 1
        rows = rows[tree[rows, 1] < NONE * size]
    live = tok >= 0
    flat, ends = tok[live].astype("<u4").tobytes(), (4 * np.cumsum(live.sum(1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def encode_pieces(v: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Token ids (little-endian, 32 bits) of each piece, each merged on its own; empty pieces have none."""
    out = [b""] * len(pieces)
    groups: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if p in v.ranks:
            out[i] = v.ranks[p].to_bytes(4, "little")
        elif len(p) > BATCH_MAX:
            out[i] = np.array(_encode_one(v, p), dtype="<u4").tobytes()
        elif p:
            groups.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(i)
    for size, where in groups.items():
        step = max(1, 1_000_000 // size)
        for k in range(0, len(where), step):
            part = where[k : k + step]
            for i, ids in zip(part, _encode_equal(v, [pieces[j] for j in part], size)):
                out[i] = ids
    return out


class Encoder:
    """Encodes texts piece by piece; remembers a bounded number of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v, self.find = vocabulary, regex.compile(pattern).findall
        self.ids: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.ids) > CACHE:
            self.ids.clear()
        new = [p for p in pieces if p not in self.ids]
        self.ids.update(zip(new, encode_pieces(self.v, [p.encode("utf-8", "surrogatepass") for p in new])))

    def encode(self, texts: list[str | None], at_once: int = 1 << 20) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, a text at a time; null has none."""
        i = 0
        while i < len(texts):
            found, chars = [], 0
            while i < len(texts) and (not found or chars < at_once):
                found.append(self.find(texts[i] or ""))
                chars += len(texts[i] or "")
                i += 1
            self.learn(set().union(*found))
            for pieces in found:
                yield b"".join(map(self.ids.__getitem__, pieces))

    @lru_cache(1)
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = sorted(self.v.bytes_of)
        size = np.zeros(ids[-1] + 1, np.int64)
        size[ids] = [len(self.v.bytes_of[i]) for i in ids]
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        return np.frombuffer(b"".join(self.v.bytes_of[i] for i in ids), np.uint8), start, size

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids: their tokens' bytes, one after another."""
        data, start, size = self._table()
        x = np.frombuffer(ids, "<u4")
        n = size[x]
        ends = np.cumsum(n)
        if not len(x):
            return b""
        return data[np.repeat(start[x] - (ends - n), n) + np.arange(ends[-1])].tobytes()


@lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(Vocabulary.load(path), pattern)


def bpe_digests(
    docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Null and empty texts have no tokens and the digests of no bytes; null ids and repeated rows
    are returned as they come; an empty table gives none. ``vocabulary`` is the rank file's path
    on every machine (the installed byte_bpe_50k.tiktoken by default).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern)
        for b in batches:
            n, a, d = [], [], []
            for ids in enc.encode(b.column(1).to_pylist()):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids array<long>) of every whole text; as ``bpe_digests`` otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in enc.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<long>")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
SQL: dict[str, str] = {}
