"""Best-fit packing with swap-based local search, over the counts of piece lengths."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import count as count_from
from itertools import takewhile

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import Vocabulary, encode_pieces
from .common import release, table, written

CACHE = 300_000  # words a task remembers
Bins = Counter  # pattern (lengths, longest first) -> how many bins are filled so


class StemVocabulary(Vocabulary):
    """Merges of a tokenizer file whose words end in a marked token; ids of merges are in their order."""

    def __init__(self, path: str, end: str = "</w>"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, self.ranks = model["vocab"], {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        name = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.byte_id = np.array([ids[name[b]] for b in range(256)], dtype=np.int64)
        self.last_id = np.array([ids[name[b] + end] for b in range(256)], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [ids[a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError("ids of merges must be in the order of merges")
        self._pairs({(ids[a] << 32) | ids[b]: i for (a, b), i in zip(merges, made)})

    def first(self, raw: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = self.byte_id[raw]
        rows = np.arange(len(raw))
        out[rows, length - 1] = self.last_id[raw[rows, length - 1]]
        return out


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases and never merges across white space or from letters to signs.

    Words are remembered. A new one of plain letters, maybe with ASCII signs after them, is taken
    apart there and its letters merged in large batches; all others go through the tokenizer.
    """

    PLAIN = re.compile(r"([^\W\d_]+)([^\w\s'<]*)")

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.stems = StemVocabulary(path)
        self.ids: dict[bytes, bytes] = {}
        self.stem_ids: dict[str, bytes] = {}

    def forget(self) -> None:
        """Lets go of the words; workers live on after a task."""
        self.ids, self.stem_ids = {}, {}

    def _ask(self, words: list[str]) -> list[bytes]:
        """Words through the tokenizer, a line break between two: tokens are dealt back by their places."""
        enc = self.tok.encode("\n".join(words), add_special_tokens=False)
        ends = np.cumsum(np.array([len(w) + 1 for w in words]))
        at = np.searchsorted(ends, np.array([o[0] for o in enc.offsets], dtype=np.int64), side="right")
        ids = np.array(enc.ids, dtype="<u4")
        cut = np.searchsorted(at, np.arange(len(words) + 1))
        return [ids[cut[k] : cut[k + 1]].tobytes() for k in range(len(words))]

    def _learn(self, words: list[bytes]) -> None:
        odd, plain = [], []
        for w in words:
            text = w.decode("utf-8", "surrogatepass")
            if text.isascii() and text.isalpha():
                plain.append((w, text.lower(), ""))
                continue
            m = self.PLAIN.fullmatch(text)
            # up to U+024F lower case keeps the length (but for U+0130) and letters are whole
            if m and m[1].isalpha() and m[2].isascii() and (text.isascii() or max(m[1]) < "\u0250" and "\u0130" not in text):
                plain.append((w, m[1].lower(), m[2]))
            else:
                odd.append((w, text))
        new = list({s for _, s, _ in plain if s not in self.stem_ids})
        self.stem_ids.update(zip(new, encode_pieces(self.stems, [s.encode() for s in new])))
        tails = list({t for _, _, t in plain if t and t not in self.stem_ids})
        for k in range(0, len(tails), 5_000):
            self.stem_ids.update(zip(tails[k : k + 5_000], self._ask(tails[k : k + 5_000])))
        self.stem_ids[""] = b""
        for w, s, t in plain:
            self.ids[w] = self.stem_ids[s] + self.stem_ids[t]
        for k in range(0, len(odd), 5_000):
            part = odd[k : k + 5_000]
            self.ids.update(zip([w for w, _ in part], self._ask([t for _, t in part])))

    def encode(self, texts: list[str | None], at_once: int = 1 << 20) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null has none."""
        i = 0
        while i < len(texts):
            found: list[list[bytes] | bytes] = []
            size = 0
            while i < len(texts) and (not found or size < at_once):
                text = texts[i] or ""
                size += len(text)
                i += 1
                if "<|" in text:  # a special token's name may hold white space in other vocabularies
                    found.append(np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
                else:
                    found.append(text.encode("utf-8", "surrogatepass").split())
            if len(self.ids) > CACHE:
                self.forget()
            new = [w for w in set().union(*(f for f in found if isinstance(f, list))) if w not in self.ids]
            self._learn(new)
            for f in found:
                yield f if isinstance(f, bytes) else b"".join(map(self.ids.__getitem__, f))


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(
    docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut every ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    rows.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )
        enc.forget()
        release()

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Bins for ``counts`` (length: how many): the longest piece left, then what fits best, again and again.

    As many equal bins as the counts allow are made at once, so the work is bounded by the number
    of different lengths, not of pieces.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError(f"lengths must be 1 to {capacity}")
    lengths = sorted(left)
    bins: Bins = Counter()
    while lengths:
        used: Counter = Counter()
        room, hi = capacity, len(lengths)
        while room and hi:
            hi = bisect_right(lengths, room, 0, hi)
            while hi and left[lengths[hi - 1]] <= used[lengths[hi - 1]]:
                hi -= 1
            if hi:
                used[lengths[hi - 1]] += 1
                room -= lengths[hi - 1]
        many = min(left[k] // n for k, n in used.items())
        bins[tuple(sorted(used.elements(), reverse=True))] += many
        for k, n in used.items():
            left[k] -= n * many
            if not left[k]:
                lengths.remove(k)
                del left[k]
    return bins


def _some(b: tuple) -> dict[tuple, int]:
    """Sizes of one piece or two of a bin; equal lengths count once, so a bin of 2,048 has 2,100 entries at most."""
    n = Counter(b)
    kinds = sorted(n, reverse=True)
    pairs = {(x, y): x + y for i, x in enumerate(kinds) for y in kinds[i:] if x != y or n[x] > 1}
    return {(x,): x for x in kinds} | pairs


def _exchange(a: tuple, b: tuple, capacity: int) -> tuple[tuple, tuple] | None:
    """The exchange between bins a (fuller) and b that raises squared fill most, or None."""
    gap = capacity - sum(a)
    best, move = 0, None
    singles, outs = _some(b), {(): 0} | _some(a)
    order = sorted((v, k) for k, v in outs.items())
    sums = [v for v, _ in order]
    for take, size in singles.items():
        # what a gains must lie in 1..gap: give back the least that fits
        at = bisect_right(sums, size - gap - 1)
        while at < len(order):
            v, give = order[at]
            gain = size - v
            if gain <= best:
                break
            if len(take) + len(give) <= 3 and not (len(take) == 2 and not give):
                best, move = gain, (take, give)
                break
            at += 1
    if move is None:
        return None
    take, give = move
    na, nb = Counter(a), Counter(b)
    na.subtract(give)
    na.update(take)
    nb.subtract(take)
    nb.update(give)
    return tuple(sorted(na.elements(), reverse=True)), tuple(sorted(nb.elements(), reverse=True))


def local_search(bins: Bins, capacity: int) -> Bins:
    """Moves and exchanges (one for one, two for one) between underfull bins until none raises squared fill.

    The emptiest kind of bin gives to the underfull ones, fullest first, all equal pairs at once; a
    kind that can give nothing rests until a new kind appears, and then meets that one. Ends at the lower bound of bins or
    when nothing moves: each exchange raises squared fill, so it ends. Never makes more bins.
    """
    total = sum(sum(p) * n for p, n in bins.items())
    bound = -(-total // capacity)
    bins = Counter(bins)
    count = sum(bins.values())
    open_ = sorted((sum(p), p) for p in bins if sum(p) < capacity)
    clock = count_from(1)
    born = {p: next(clock) for _, p in open_}  # in order of birth: a kind is born anew when a second bin of it comes
    tried: dict[tuple, int] = {}  # a giver has met all partners born up to this

    def add(p: tuple, n: int) -> None:
        if not p:
            return
        if bins[p] < 2 and sum(p) < capacity:
            if not bins[p]:
                insort(open_, (sum(p), p))
            born.pop(p, None)
            born[p] = next(clock)
        bins[p] += n

    def drop(p: tuple, n: int) -> None:
        bins[p] -= n
        if not bins[p]:
            del bins[p]
            if sum(p) < capacity:
                open_.remove((sum(p), p))
                del born[p]

    def partners(giver: tuple) -> list[tuple]:
        """Kinds as full as the giver or fuller that it has not met, fullest first."""
        upto = tried.get(giver, 0)
        new = list(takewhile(lambda p: born[p] > upto, reversed(born)))
        return sorted((p for p in new if sum(p) >= sum(giver)), key=lambda p: (-sum(p), p))

    while count > bound:
        newest = next(reversed(born.values()), 0)
        giver = next((p for _, p in open_ if tried.get(p, 0) < newest), None)
        if giver is None:
            break
        for p in partners(giver):
            same = p == giver
            if same and bins[p] < 2:
                continue
            found = _exchange(p, giver, capacity)
            if found and sum(found[0]) ** 2 + sum(found[1]) ** 2 > sum(p) ** 2 + sum(giver) ** 2:
                many = bins[p] // 2 if same else min(bins[p], bins[giver])
                drop(p, many)
                drop(giver, many)
                for x in found:
                    add(x, many)
                if not found[1]:
                    count -= many
                tried.pop(giver, None)
                break
        else:
            tried[giver] = newest
    return bins


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, salts: int = 64) -> DataFrame:
    """One row per piece: its ids' checksum, the sequence it is in and its place there.

    Only the number of pieces of each length (``capacity`` numbers at most) reaches the driver,
    which packs lengths; pieces then take the slots of their length by rank. Ranks are counted
    within (length, salt) and shifted by the salts before, so a length that a third of all pieces
    share is spread over tasks. Null and empty texts are the end id alone, one piece of length 1;
    null ids and repeated rows are packed like others; an empty table gives no rows.
    """
    part = written(
        pieces(docs, capacity, vocabulary).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces"
    )
    per = written(part.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    bins = local_search(best_fit(counts, capacity), capacity)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # length: (first sequence, offset, copies)
    sequence = 0
    for pattern, many in sorted(bins.items()):
        at = 0
        for size in pattern:
            slots.setdefault(size, []).append((sequence, at, many))
            at += size
        sequence += many
    first, offset, begin, of = [], [], [], {}
    for size, found in slots.items():
        of[size] = (len(first), len(first) + len(found))
        n = 0
        for a, b, many in found:
            first.append(a)
            offset.append(b)
            begin.append(n)
            n += many
    lo, hi = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    for size, (a, b) in of.items():
        lo[size], hi[size] = a, b
    first_a, offset_a, begin_a = (np.array(x, dtype=np.int64) for x in (first, offset, begin))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << 48
        key = np.repeat(np.arange(capacity + 1), hi - lo) * wide
        order = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)]) if len(first_a) else np.zeros(0, np.int64)
        key = key + begin_a[order]
        for b in batches:
            size, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            slot = order[np.searchsorted(key, size * wide + rank, side="right") - 1] if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(first_a[slot] + rank - begin_a[slot]), pa.array(offset_a[slot])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = per.select("length", "salt", before.alias("shift"))
    by = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = part.withColumn("rank", F.row_number().over(by)).join(shift, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") - 1 + F.col("shift")).cast("long").alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
SQL: dict[str, str] = {}
