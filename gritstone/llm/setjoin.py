"""Exact set-similarity join over units of text (lines, or whole documents as sets of shingles).

Tokens are ordered by rarity; prefix, length and positional filters, and a filter by parities,
choose candidates; the Jaccard of their real tokens decides. Candidates come from a cheap hash of
tokens that gives equal tokens equal values, so it can add candidates and never lose one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, n_tasks, release, sieved, written
from .components import components

HASH_BITS = 40  # of a token's hash, below its level: of 32 bits, chance pairs grow with the square of the table
TOKEN_BYTES = HASH_BITS // 8 + 1
SLOTS = 1 << 24  # counters of the rarity sketch, which only orders tokens; a fixed size
PROBE = 1 << 26  # bits of the filter of tokens that a second look is for; a fixed size
MARKS = 1 << 22  # bits of the filter of units to be verified; a fixed size
BLOCKS = 64  # rows in which a sketch or filter reaches the driver
AT_ONCE = 1 << 20  # bytes of text handled together; one longer text is handled alone
REMEMBER = 200_000  # units a task remembers, so as to give their prefix once
WINDOW = 1024  # earliest units of a token and size that others of it are compared with at first
ENOUGH = 6  # candidates of a unit and token given at first
MOST = 1 << 18  # rows of a bucket compared at once
PAIRS = 1 << 18  # pairs of rows compared at once
RUN = 1 << 18  # rows of a stretch of tokens
SLICE = 1 << 16  # of them, unfolded at once, about
DEALT = 1 << 20  # numbers dealt at once
_ODD = 0x9E3779B97F4A7C15


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(2)
def _powers(n: int, base: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def mix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(k)
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: np.ndarray, breaks: np.ndarray, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the words of ``raw``, which end at ASCII white space and before each of ``breaks``."""
    n = len(raw)
    ink = (raw != 32) & ((raw < 9) | (raw > 13))
    cut = np.zeros(n + 1, bool)
    cut[breaks] = True
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | cut[1:n]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:] | cut[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, side="right")))
        a, size = int(start[i]), int(end[j - 1] - start[i])
        size_ = 1 << size.bit_length()
        p = np.zeros(size + 1, np.uint64)
        np.cumsum(_letters()[raw[a : a + size]] * _powers(size_, _ODD)[:size], out=p[1:])
        at = start[i:j] - a
        out[i:j] = (p[end[i:j] - a] - p[at]) * _powers(size_, pow(_ODD, -1, 1 << 64))[at]
        i = j
    return mix(out, 0xD6E8FEB86659FD93), start


@dataclass
class Units:
    """Token hashes of a stretch of texts, flat, and what unit each belongs to (non-decreasing)."""

    h: np.ndarray
    of: np.ndarray
    row: np.ndarray  # of each unit: its text's place in the stretch
    line: np.ndarray
    raw: np.ndarray  # of each unit: a hash of the bytes it is made from


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lines_of(texts: pa.Array, whole: bool = True) -> Units:
    """Lines (between line feeds) that have words; a line's tokens are its words."""
    raw, offsets = _bytes(texts)
    h, start = word_hashes(raw, offsets)
    none = np.zeros(0, np.int64)
    if not whole:
        return Units(h, none, none, none, none)
    ends = np.flatnonzero(raw == 10)
    edge = np.union1d(np.searchsorted(start, ends), np.searchsorted(start, offsets))  # numbers of words at which a line may begin
    at = edge[edge < len(h)]
    row = np.searchsorted(offsets, start[at], side="right") - 1
    before = np.searchsorted(ends, start[at])
    line = before - np.searchsorted(ends, offsets[:-1])[row]
    hashes = np.zeros(0, np.uint64)
    if len(at):
        first = np.maximum(offsets[row], np.concatenate(([0], ends + 1))[before])
        last = np.minimum(offsets[row + 1], np.concatenate((ends, [len(raw)]))[before])
        view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
        hashes = np.array([digest(view[a:z]) for a, z in zip(first.tolist(), last.tolist())], dtype=np.uint64)
    return Units(h, np.repeat(np.arange(len(at)), np.diff(np.concatenate((at, [len(h)])))), row, line, hashes)


def shingles_of(width: int) -> Callable[[pa.Array, bool], Units]:
    """Whole texts, as sets of their ``width``-word shingles; A-Z is lower-cased. Fewer words are one shingle."""

    def units(texts: pa.Array, whole: bool = True) -> Units:
        raw, offsets = _bytes(texts)
        raw = np.where((raw > 64) & (raw < 91), raw + np.uint8(32), raw)
        h, start = word_hashes(raw, offsets)
        words = np.searchsorted(start, offsets)  # of each text: its first word
        n = np.diff(words)
        joined = np.zeros(len(h), np.uint64)
        for k in range(width):  # a short text's shingle is what it has
            joined[: len(h) - k] = joined[: len(h) - k] * np.uint64(0xC2B2AE3D27D4EB4F) + h[k:]
        row = np.repeat(np.arange(len(n)), n)
        keep = np.arange(len(h)) - words[row] <= np.maximum(n[row] - width, 0)
        joined = mix(joined, 0xBF58476D1CE4E5B9)
        for i in np.flatnonzero((n > 0) & (n < width)).tolist():
            joined[words[i]] = hash(tuple(h[words[i] : words[i + 1]].tolist())) & (1 << 64) - 1
        empty = np.flatnonzero(n == 0)
        h, row = joined[keep], row[keep]
        if len(empty):  # a text without words has one shingle, the empty one
            at = np.searchsorted(row, empty)
            h, row = np.insert(h, at, np.uint64(1)), np.insert(row, at, empty)
        hashes = np.zeros(0, np.uint64)
        if whole:
            view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
            hashes = np.array([digest(view[a:z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())], dtype=np.uint64)
        return Units(h, row, np.arange(len(n)), np.zeros(len(n), np.int64), hashes)

    return units


def text_shingles(width: int) -> Callable[[bytes], list[bytes]]:
    def words(text: bytes) -> list[bytes]:
        found = text.split()
        return [b" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))]

    return words


@dataclass
class Kind:
    """What a unit is: hashed in bulk; cut from a text and split into tokens where candidates are verified."""

    bulk: Callable[[pa.Array, bool], Units]
    cut: Callable[[bytes], list[bytes]]
    words: Callable[[bytes], list[bytes]]
    sketch: bool = False  # large sets: their parities tell little, so candidates are compared by counts first


LINES = Kind(lines_of, lambda text: text.split(b"\n"), bytes.split)


def shingles(width: int) -> Kind:
    return Kind(shingles_of(width), lambda text: [text.lower()], text_shingles(width), sketch=True)


def stretches(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, pa.Array]]:
    """(from, to, texts) of stretches of a batch that are small enough to handle together."""
    col = b.column(at)
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < b.num_rows:
        z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + AT_ONCE, side="right")))
        yield a, z, col.slice(a, z - a)
        a = z


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))


def _steps(x: np.ndarray) -> bytes:
    """Sorted numbers by their differences, which take about a byte each."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(np.diff(x, prepend=np.int32(0)).view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes, "zstd", asbytes=True)


def _summed(data: pa.Buffer, n: int) -> np.ndarray:
    """The ``n`` numbers of which ``_steps`` made ``data``."""
    if not n:
        return np.zeros(0, np.int32)
    raw = pa.decompress(data, 4 * n, "zstd")
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).ravel(), dtype=np.int32)


DEALT_ROWS = "block int, n int, x binary"


class _Dealt:
    """Numbers of a task, dealt by their highest bits into BLOCKS rows of bytes, as soon as there are DEALT of them."""

    def __init__(self, bits: int):
        self.shift = bits - BLOCKS.bit_length() + 1
        self.held: list[np.ndarray] = []

    def rows(self) -> pa.RecordBatch:
        x = np.sort(np.concatenate(self.held) if self.held else np.zeros(0, np.int32))
        cut = np.searchsorted(x, np.arange(BLOCKS + 1, dtype=np.int64) << self.shift)
        self.held = []
        parts = [_steps(x[a:z] & ((1 << self.shift) - 1)) for a, z in zip(cut, cut[1:])]
        cols = [pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(np.diff(cut).astype(np.int32)), pa.array(parts, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["block", "n", "x"])


def _gathered(rows: DataFrame, bits: int, finish: Callable[[np.ndarray], bytes]) -> list[bytes]:
    """``finish`` of the counts of each block's numbers (of ``bits`` bits), summed over all tasks, by block."""
    wide = 1 << (bits - BLOCKS.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(wide, np.int64)
        give = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([finish(total)], pa.binary())], names=["block", "x"])
        for b in batches:
            for i, k in enumerate(b.column(0).to_pylist()):
                if block is not None and k != block:
                    yield give()
                    total[:] = 0
                block = k
                x = _summed(b.column(2)[i].as_buffer(), b.column(1)[i].as_py())
                if len(x):
                    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
                    total[x[at]] += np.diff(np.append(at, len(x)))
        if block is not None:
            yield give()
        release()

    found = rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, x binary").toArrow()  # BLOCKS rows
    out = {k: x for k, x in zip(found.column("block").to_pylist(), found.column("x").to_pylist())}
    empty = finish(np.zeros(wide, np.int64))
    return [out.get(k, empty) for k in range(BLOCKS)]


def rarity(base: DataFrame, kind: Kind) -> np.ndarray:
    """A level from 0 (a token that occurs once) to 255, from SLOTS counts over all texts."""
    bits = SLOTS.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = _Dealt(bits)
        size = 0
        for b in batches:
            for _, _, texts in stretches(b, 0):
                h = kind.bulk(texts, False).h
                dealt.held.append((h >> np.uint64(64 - bits)).astype(np.int32))
                size += len(h)
                if size >= DEALT:
                    yield dealt.rows()
                    size = 0
        yield dealt.rows()
        release()

    def level(n: np.ndarray) -> bytes:
        return np.minimum(np.where(n < 2, 0, 1 + np.floor(np.log2(np.maximum(n, 1)) * 6)), 255).astype(np.uint8).tobytes()

    return np.frombuffer(b"".join(_gathered(base.select("text").mapInArrow(run, DEALT_ROWS), bits, level)), np.uint8)


def _lists(token: np.ndarray, size: np.ndarray) -> pa.Array:
    """Lists of tokens of TOKEN_BYTES bytes each."""
    data = np.ascontiguousarray(token.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES])
    offsets = np.concatenate(([0], TOKEN_BYTES * np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _tokens(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, size of each list)."""
    _, offsets, data = lists.buffers()
    offsets = np.frombuffer(offsets, np.int32)[lists.offset : lists.offset + len(lists) + 1]
    out = np.zeros(((offsets[-1] - offsets[0]) // TOKEN_BYTES, 8), np.uint8)
    if len(out):
        out[:, :TOKEN_BYTES] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(-1, TOKEN_BYTES)
    return out.view(np.int64).ravel(), np.diff(offsets) // TOKEN_BYTES


def _sketches(h: np.ndarray, of: np.ndarray, n: np.ndarray) -> pa.Array:
    """Of each set (of size ``n``; none for 0) the counts of its tokens by their hashes' highest bits, four to eight tokens a count."""
    bits = np.where(n > 0, np.maximum(4, 1 + np.floor(np.log2(np.maximum(n >> 3, 1))).astype(np.int64)), 0)
    wide = np.where(n > 0, np.int64(1) << bits, 0)
    start = np.cumsum(wide) - wide
    some = n[of] > 0
    of = of[some]
    counts = np.bincount(start[of] + (mix(h[some], 0xFF51AFD7ED558CCD) >> (64 - bits[of]).astype(np.uint64)).astype(np.int64), minlength=int(wide.sum()))
    data = np.minimum(counts, 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(start, wide.sum()).astype(np.int32)), pa.py_buffer(data)])


def apart(x: bytes, y: bytes) -> int:
    """Two sets differ in as many tokens as this or more: the sum of the differences of their sketches' counts, at the shorter one's length."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    m = min(len(a), len(b))
    return int(np.abs(a.reshape(m, -1).sum(1) - b.reshape(m, -1).sum(1)).sum())


def unit_sets(base: DataFrame, kind: Kind, threshold: Fraction, level: np.ndarray) -> DataFrame:
    """Every unit: its place (k1, at), signature (s1, s2, s3), size, raw hash and, in rows that ``lead``, its prefix and sketch.

    A task gives a set's prefix when it meets the set, and again at an earlier place or once it has
    forgotten it. Sets so small that one token more or less falls below the threshold match equal
    sets only, which need no prefix.
    """
    p, q = threshold.numerator, threshold.denominator
    bits = SLOTS.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        for b in batches:
            for a, z, texts in stretches(b, 2):
                u = kind.bulk(texts, True)
                units = len(u.row)
                rare = level[(u.h >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
                token = (rare << np.uint64(HASH_BITS)) | (u.h & np.uint64((1 << HASH_BITS) - 1))
                order = None
                if units < 1 << (56 - HASH_BITS):
                    key = (u.of.astype(np.uint64) << np.uint64(HASH_BITS + 8)) | token
                    order = np.argsort(key)
                    key, h = key[order], u.h[order]
                    if np.any((key[1:] == key[:-1]) & (h[1:] != h[:-1])):
                        order = None  # different tokens of one key: their order must be everywhere the same
                if order is None:
                    order = np.lexsort((u.h, token, u.of))
                of, h, token = u.of[order], u.h[order], token[order]
                keep = np.ones(len(h), bool)
                keep[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
                of, h, token = of[keep], h[keep], token[keep]
                n = np.bincount(of, minlength=units)
                start = np.cumsum(n) - n
                if units:
                    s1 = np.add.reduceat(mix(h, 0x9E3779B97F4A7C15), start)
                    # parity of the tokens that fall on each of 128 bits: sets differ in as many tokens as their parities in bits, or more
                    bit = mix(h, 0xC2B2AE3D27D4EB4F) >> np.uint64(57)
                    one, high = np.uint64(1) << (bit & np.uint64(63)), bit >> np.uint64(6) == 1
                    s2 = np.bitwise_xor.reduceat(np.where(high, one, np.uint64(0)), start)
                    s3 = np.bitwise_xor.reduceat(np.where(high, np.uint64(0), one), start)
                else:
                    s1 = s2 = s3 = np.zeros(0, np.uint64)
                k1 = b.column(0).to_numpy()[a:z][u.row]
                at = (u.line.astype(np.int64) << 32) | (b.column(1).to_numpy()[a:z][u.row] & 0xFFFFFFFF)
                if len(seen) > REMEMBER:
                    seen.clear()
                lead = np.zeros(units, bool)
                for i, (x, y, place) in enumerate(zip(s1.tolist(), s2.tolist(), zip(k1.tolist(), at.tolist()))):
                    if (known := seen.get((x, y))) is None or place < known:
                        seen[x, y] = place
                        lead[i] = True
                prefix = np.where(lead & (n * (q - p) >= p), n - (-(-n * p // q)) + 1, 0)
                take = np.arange(len(h)) - np.repeat(start, n) < np.repeat(prefix, n)
                prefixes = _lists(token[take], prefix)
                sketches = _sketches(h, of, np.where(prefix > 0, n, 0) if kind.sketch else np.zeros(units, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1), pa.array(at), _signed(s1), _signed(s2), _signed(s3), pa.array(n.astype(np.int32)), _signed(u.raw), pa.array(lead), prefixes, sketches],
                    names=["k1", "at", "s1", "s2", "s3", "n", "raw", "lead", "prefix", "sketch"],
                )
        release()

    return base.select("k1", "k2", "text").mapInArrow(run, "k1 long, at long, s1 long, s2 long, s3 long, n int, raw long, lead boolean, prefix binary, sketch binary")


def first_places(sets: DataFrame) -> DataFrame:
    """One row per different set, with its earliest place, and whether several rows lead for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, [None]):
            if b is not None and held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            elif b is None:
                b = held
            if b is None or not b.num_rows:
                continue
            new = np.ones(b.num_rows, bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (b.column(i).to_numpy() for i in range(3))])
            at = np.flatnonzero(new)
            copies = np.diff(np.concatenate((at, [b.num_rows]))) > 1
            held = b.slice(int(at[-1]), 2)  # its set may go on
            found = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(copies)], names=[*found.schema.names, "copies"]).slice(0, len(at) - 1)
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([held.num_rows > 1] * held.num_rows)], names=[*held.schema.names, "copies"]).slice(0, 1)
        release()

    cols = ["s1", "s2", "s3", "k1", "at", "n", "raw", "prefix", "sketch"]
    rows = sets.where("lead").select(cols).repartition("s1").sortWithinPartitions("s1", "s2", "s3", "k1", "at")
    return rows.mapInArrow(run, "s1 long, s2 long, s3 long, k1 long, at long, n int, raw long, prefix binary, sketch binary, copies boolean")


def _slot(token: np.ndarray) -> np.ndarray:
    return (mix(token.view(np.uint64), 0x94D049BB133111EB) >> np.uint64(65 - PROBE.bit_length())).astype(np.int32)


def _filter(tokens: DataFrame) -> np.ndarray:
    """A filter of PROBE bits of the tokens: those not in it surely are not there."""
    bits = PROBE.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt, size = _Dealt(bits), 0
        for b in batches:
            dealt.held.append(_slot(b.column(0).to_numpy()))
            size += len(dealt.held[-1])
            if size >= DEALT:
                yield dealt.rows()
                size = 0
        yield dealt.rows()
        release()

    rows = tokens.mapInArrow(run, DEALT_ROWS)
    return np.frombuffer(b"".join(_gathered(rows, bits, lambda n: np.packbits(n > 0, bitorder="little").tobytes())), np.uint8)


COLUMNS = ("token", "k1", "at", "np", "s2", "s3")


def _probed(b: pa.RecordBatch, passing: np.ndarray | None = None) -> list[np.ndarray]:
    """COLUMNS of the tokens of a batch's prefixes (those that pass the filter, if there is one): np holds size and position."""
    t, size = _tokens(b.column(0))
    of = np.repeat(np.arange(b.num_rows), size)
    pos = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
    keep = slice(None)
    if passing is not None:
        slot = _slot(t)
        keep = np.flatnonzero((passing[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1)
    of = of[keep]
    k1, at, n, s2, s3 = (b.column(i).to_numpy()[of] for i in range(1, 6))
    return [t[keep], k1, at, (n.astype(np.int64) << 32) | pos[keep], s2, s3]


def _prefixes(first: DataFrame) -> DataFrame:
    return first.where(F.octet_length("prefix") > 0).select("prefix", "k1", "at", "n", "s2", "s3")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE tokens in their prefixes, or one prefix more."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)) // TOKEN_BYTES
        a = 0
        while a < b.num_rows:
            z = 1 + int(np.searchsorted(size[:-1], (size[a - 1] if a else 0) + SLICE, side="left"))
            yield b.slice(a, z - a)
            a = z


def _rows(first: DataFrame, passing: np.ndarray) -> DataFrame:
    """A row of COLUMNS for each token that passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            c = _probed(b, passing)
            for a in range(0, max(1, len(c[0])), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 17)]) for x in c], names=list(COLUMNS))
        release()

    return _prefixes(first).mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS))


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, those of equal place together: they compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(x: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _packed(first: DataFrame, buckets: int) -> DataFrame:
    """The rows of all tokens, as bytes of many at once, dealt into ``buckets`` by token; a bucket's share of a task is one row.

    ``rest`` holds all COLUMNS but the token, which is as good as random and doesn't compress.

    No filter goes before it: one of a fixed size passes few rows of a small table and nearly all of a large one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in chain(_slices(batches), [None]):
            if b is not None:
                held.append(_probed(b))
                size += len(held[-1][0])
            if size >= RUN or b is None and size:
                c = [np.concatenate(x) for x in zip(*held)]
                held, size = [], 0
                bucket = (mix(c[0].view(np.uint64), 0xFF51AFD7ED558CCD) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(cut))
                for i in range(0, len(some), 64):  # a large batch would stay in the memory of the JVM as a whole
                    token, rest = [], []
                    for k in some[i : i + 64].tolist():
                        x = order[cut[k] : cut[k + 1]]
                        token.append(_planes(c[0][x]))
                        rest.append(pa.compress(b"".join(_planes(y[x]) for y in c[1:]), "zstd", asbytes=True))
                    cols = [pa.array(some[i : i + 64].astype(np.int32)), pa.array(token, pa.binary()), pa.array(rest, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["bucket", "token", "rest"])
        release()

    return _prefixes(first).mapInArrow(run, "bucket int, token binary, rest binary")


def _unpacked(b: pa.RecordBatch, i: int) -> list[np.ndarray]:
    """COLUMNS of a row of ``_packed``."""
    token, many = b.column(1)[i].as_buffer(), len(COLUMNS) - 1
    rest = pa.decompress(b.column(2)[i].as_buffer(), many * token.size, "zstd")
    return [_numbers(token), *(_numbers(rest.slice(j * token.size, token.size)) for j in range(many))]


def _meet(packed: DataFrame, threshold: Fraction, window: int = WINDOW, enough: int = ENOUGH) -> DataFrame:
    """Pairs of units that share a token and pass the filters: x is the earlier one, (k1, at) and the rest are y's.

    Each unit is compared with the ``window`` earliest of its token in each step of sizes that its
    partners can have, up to ``enough`` candidates. If there
    may be more, a row without x says so; ``_rest`` sees to those where that matters. So of a token's
    rows no more than that need to stay in memory, however many there are.
    """
    p, q = threshold.numerator, threshold.denominator

    def compare(c: list[np.ndarray]) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        """The pairs among rows (COLUMNS), and the rows that must stay to be compared with others."""
        order = np.lexsort((c[2], c[1]))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        step = np.floor(np.log(c[3] >> 32) / np.log(q / p) + 1e-9).astype(np.int64)  # partners' are one apart at most
        key = (np.unique(c[0], return_inverse=True)[1].astype(np.int64) << 20) | (step << 1)  # sizes below 2^31 have fewer than 2^19 steps for all but thresholds next to 1
        order = np.lexsort((place, key))
        c, key, place = [x[order] for x in c], key[order], place[order]
        token, k1, at, np_, s2, s3 = c
        n, pos = np_ >> 32, np_ & 0xFFFFFFFF
        short = pos < n + (-(2 * p * n) // (p + q)) + 1
        total = len(key)
        new = np.ones(total, bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        end = np.concatenate((first[1:], [total]))
        group = np.cumsum(new) - 1
        rank = np.arange(total) - first[group]
        more, given, found = np.zeros(total, bool), np.zeros(total, np.int32), []
        for apart in (-1, 0, 1):
            g = np.searchsorted(key[first], key[first] + 2 * apart)
            g_ = np.minimum(g, len(first) - 1)
            there = (g < len(first)) & (key[first[g_]] == key[first] + 2 * apart)
            begin, size = np.where(there, first[g_], 0)[group], np.where(there, end[g_] - first[g_], 0)[group]
            y = np.flatnonzero((size > 0) & (given < enough) if apart else (rank > 0) & (given < enough))
            lo = 0
            for hi in [w for w in (2, 8, 32, 128) if w < window] + [window]:
                y = y[size[y] > lo]
                y = y[place[begin[y] + lo] < place[y]]
                at_once = max(1, PAIRS // (hi - lo))
                for a in range(0, len(y), at_once):
                    part = y[a : a + at_once]
                    many = np.minimum(size[part], hi) - lo
                    v = np.repeat(part, many)
                    u = np.arange(len(v)) - np.repeat(np.cumsum(many) - many, many) + begin[v] + lo
                    both = n[u] + n[v]
                    wide = both * (q - p) // (p + q)
                    ok = np.bitwise_count((s2[u] ^ s2[v]).view(np.uint64)) <= wide
                    ok &= place[u] < place[v]
                    u, v, both, wide = u[ok], v[ok], both[ok], wide[ok]
                    far = np.bitwise_count((s2[u] ^ s2[v]).view(np.uint64)).astype(np.int64) + np.bitwise_count((s3[u] ^ s3[v]).view(np.uint64))
                    ok = far <= wide
                    ok &= (np.minimum(n[u], n[v]) * q >= np.maximum(n[u], n[v]) * p) & np.where(n[u] <= n[v], short[u], short[v])
                    rest = np.minimum(n[u] - pos[u], n[v] - pos[v]) + np.minimum(pos[u], pos[v])
                    ok &= rest * (p + q) >= both * p
                    u, v = u[ok], v[ok]
                    if len(v):
                        found.append((u, v, far[ok]))
                        np.add.at(given, v, 1)
                lo = hi
                y = y[size[y] > lo]
                y = y[place[begin[y] + lo] < place[y]]
                full = given[y] >= enough
                more[y[full]] = True
                y = y[~full]
            more[y] = True  # later than window of them
            more |= (given >= enough) if apart < 1 else False
        u, v, far = (np.concatenate(s) for s in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        some = np.flatnonzero(more)
        none = np.concatenate([np.zeros(len(u), bool), np.ones(len(some), bool)])
        u, v = np.concatenate([u, some]), np.concatenate([v, some])
        cols = [pa.array(k1[u], mask=none), pa.array(at[u], mask=none), pa.array(k1[v]), pa.array(at[v]), *(pa.array(a[v], mask=~none) for a in (token, np_, s2, s3)), pa.array(np.concatenate([far, some]), mask=none)]
        return pa.RecordBatch.from_arrays(cols, names=["xk1", "xat", "k1", "at", "token", "np", "s2", "s3", "far"]), [x[rank <= window] for x in (token, k1, at, np_, s2, s3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        bucket, size, most = None, 0, MOST
        for b in chain(batches, [None]):
            for i in range(b.num_rows if b is not None else 1):
                k = b.column(0)[i].as_py() if b is not None else None
                if size and (k != bucket or size >= most):
                    c, held = [np.concatenate(x) for x in zip(*held)], []
                    out, stay = compare(c)
                    yield out
                    held = [stay] if k == bucket else []
                    size = len(stay[0]) if held else 0
                    most = max(MOST, 2 * size)
                bucket = k
                if b is not None:
                    held.append(_unpacked(b, i))
                    size += len(held[-1][0])
        release()

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "xk1 long, xat long, k1 long, at long, token long, np long, s2 long, s3 long, far long")


def _rest(found: DataFrame, rows: DataFrame, threshold: Fraction, apart_from: DataFrame | None) -> DataFrame:
    """Pairs that ``_meet`` left out, of units y in ``found``; with ``apart_from`` (node, component) only across components.

    One join by token, which Spark can split where a token is frequent.
    """
    p, q = threshold.numerator, threshold.denominator
    y = found.select("token", *[F.col(c).alias(f"y{c}") for c in ("k1", "at", "np", "s2", "s3")])
    x = rows.select("token", *[F.col(c).alias(f"x{c}") for c in ("k1", "at", "np", "s2", "s3")])
    size = lambda v: F.shiftright(f"{v}np", 32)
    pos = lambda v: F.col(f"{v}np").bitwiseAND(F.lit(0xFFFFFFFF))
    least, most = F.least(size("x"), size("y")), F.greatest(size("x"), size("y"))
    rest = F.least(size("x") - pos("x"), size("y") - pos("y")) + F.least(pos("x"), pos("y"))
    apart = sum(F.bit_count(F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))) for c in ("s2", "s3"))
    both = size("x") + size("y")
    ok = (F.struct("xk1", "xat") < F.struct("yk1", "yat")) & (least * q >= most * p) & (rest * (p + q) >= both * p) & (apart * (p + q) <= both * (q - p))
    if apart_from is not None:
        for v in ("x", "y"):
            node = F.xxhash64(f"{v}k1", f"{v}at")
            of = apart_from.select(F.col("id").alias(f"{v}node"), F.col("component").alias(f"{v}c"))
            side = (x if v == "x" else y).withColumn(f"{v}node", node).join(of, f"{v}node", "left")
            side = side.withColumn(f"{v}c", F.coalesce(f"{v}c", f"{v}node")).drop(f"{v}node")
            x, y = (side, y) if v == "x" else (x, side)
        ok = ok & (F.col("xc") != F.col("yc"))
    return x.join(y.hint("merge"), "token").where(ok).select("xk1", "xat", F.col("yk1").alias("k1"), F.col("yat").alias("at"), apart.alias("far")).distinct()


def _near(pairs: DataFrame, first: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs that may reach the threshold by their sketches, so that only texts of likely partners are cut into tokens and move."""
    p, q = threshold.numerator, threshold.denominator
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xn, n, x, y = (c.to_pylist() for c in b.columns[-4:])
            ok = [apart(u, v) * (p + q) <= (i + j) * (q - p) for i, j, u, v in zip(xn, n, x, y)]
            yield b.filter(pa.array(ok, pa.bool_())).select(names)
        release()

    own = first.where(F.octet_length("sketch") > 0).select("k1", "at", "n", "sketch")
    x = own.withColumnsRenamed({"k1": "xk1", "at": "xat", "n": "xn", "sketch": "x"})
    both = pairs.join(x, ["xk1", "xat"]).join(own, ["k1", "at"])
    return both.select(*names, "xn", "n", "x", "sketch").mapInArrow(run, pairs.schema)


def _marks(raw: DataFrame) -> np.ndarray:
    """A filter of MARKS bits of ``raw``: values not in it are surely absent."""
    bit = raw.select(F.pmod("raw", F.lit(MARKS)).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("v"))
    rows = words.toArrow()  # MARKS / 64 rows at most
    out = np.zeros(MARKS // 64, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _members(base: DataFrame, wanted: np.ndarray, kind: Kind) -> DataFrame:
    """(raw, tokens) of the units whose raw hash the filter lets pass; a task gives each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            for _, _, texts in stretches(b, 0):
                raws, lists = [], []
                for text in texts.cast(pa.large_binary()).to_pylist():
                    for unit in kind.cut(text or b""):
                        r = digest(unit)
                        if wanted[r & (MARKS - 1)] and r not in seen:
                            if len(seen) > REMEMBER:
                                seen.clear()
                            seen.add(r)
                            raws.append(r)
                            lists.append(np.fromiter(map(digest, set(kind.words(unit))), np.uint64))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
                flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([_signed(np.array(raws, dtype=np.uint64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(flat))], names=["raw", "tokens"])
        release()

    return base.select("text").mapInArrow(run, "raw long, tokens array<long>").dropDuplicates(["raw"])


def _verified(base: DataFrame, first: DataFrame, pairs: DataFrame, kind: Kind, threshold: Fraction, all_of: bool) -> DataFrame:
    """The pairs whose real tokens reach the threshold; unless ``all_of``, of each y whose likeliest pair does only that.

    Only texts that may hold one of the pairs' units are read in Python, and none moves.
    """
    p, q = threshold.numerator, threshold.denominator
    ends = written(pairs.select(F.col("xk1").alias("k1"), F.col("xat").alias("at")).unionByName(pairs.select("k1", "at")).distinct(), "ends", "snappy")
    maybe, _ = sieved(first.select("k1", "at", "raw", "s1", "s2", "s3"), ends, "k1", "at")
    raw = written(maybe.join(ends, ["k1", "at"], "left_semi"), "raw", "snappy")
    members = raw.join(_members(sieved(base, ends, "k1")[0], _marks(raw), kind), "raw").select("k1", "at", "s1", "s2", "s3", "tokens")
    members = written(members, "members", "snappy")
    x = members.select(F.col("k1").alias("xk1"), F.col("at").alias("xat"), F.col("tokens").alias("x"))
    both = F.size(F.array_intersect("x", "tokens"))

    def true(pairs: DataFrame) -> DataFrame:
        links = pairs.select("xk1", "xat", "k1", "at").join(x, ["xk1", "xat"]).join(members, ["k1", "at"])
        links = links.where(both * (p + q) >= (F.size("x") + F.size("tokens")) * p)
        return written(links.select("xk1", "xat", "k1", "at", "s1", "s2", "s3"), "links", "snappy")

    if all_of:
        links = true(pairs)
    else:
        best = pairs.groupBy("k1", "at").agg(F.min(F.struct("far", "xk1", "xat")).alias("x")).select("x.xk1", "x.xat", "k1", "at")
        links = true(best)
        others = pairs.join(links.select("k1", "at"), ["k1", "at"], "left_anti")
        links = links.unionByName(true(others))
    delete(ends)
    delete(raw)
    delete(members)
    return links


def keyed(docs: DataFrame) -> DataFrame:
    """text, and its place: k1 is the id (null: the greatest), k2 tells rows of one id apart by their texts."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"), "text")


def joined(base: DataFrame, kind: Kind, threshold: Fraction, connect: bool = False, window: int = WINDOW, enough: int = ENOUGH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every unit, its different sets at their earliest places, links between those).

    A link is (xk1, xat, k1, at, and that set's s1, s2, s3), x earlier. Links given are true ones, and enough: every set with
    an earlier partner has such a link; with ``connect``, sets connected by any links are
    connected by these. So a family of near copies gives links in proportion to its size.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    sets = written(unit_sets(base, kind, threshold, rarity(base, kind)), "sets", "snappy")
    first = written(first_places(sets), "first", "snappy")
    buckets = 4 * n_tasks(base.sparkSession)
    found = written(_meet(_packed(first, buckets), threshold, window, enough), "found", "snappy")
    place = ["xk1", "xat", "k1", "at"]
    likely = lambda pairs: _near(pairs, first, threshold) if kind.sketch else pairs
    pairs = written(likely(found.where("xk1 is not null").groupBy(place).agg(F.min("far").alias("far"))), "pairs", "snappy")
    links = _verified(base, first, pairs, kind, threshold, connect)
    more = found.where("xk1 is null")
    of = None
    if connect:
        of = components(links.select(F.xxhash64("xk1", "xat").alias("a"), F.xxhash64("k1", "at").alias("b")))
    else:
        more = more.join(links.select("k1", "at").distinct(), ["k1", "at"], "left_anti")
    more = written(more, "more", "snappy")
    if not more.isEmpty():
        rest = written(likely(_rest(more, _rows(first, _filter(more.select("token"))), threshold, of)), "rest", "snappy")
        links = links.unionByName(_verified(base, first, rest, kind, threshold, connect))
    delete(found)
    return sets, first, links
