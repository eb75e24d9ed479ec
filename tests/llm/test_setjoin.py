"""The set join's links against brute force, also where its first look is too short, and its hashing against plain splitting."""

import random
import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from gritstone.llm import setjoin
from gritstone.llm.setjoin import LINES, joined, keyed, lines_of, shingles, shingles_of, word_hashes


def family(seed, n=60):
    rnd = random.Random(seed)
    base = [[f"f{seed}x{k}" for k in range(30)], [f"g{k}" for k in range(30)]]
    rows = []
    for i in range(n):
        words = list(base[i % 2])
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(30)] = f"n{rnd.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    return rows


def close(a, b):
    return len(a & b) * 5 >= 4 * len(a | b)


@pytest.mark.parametrize("window,enough", [(1, 1), (3, 2), (1024, 16)])
def test_every_set_with_an_earlier_partner_has_a_link(spark, window, enough):
    rows = family(1)
    sets = {}
    for i, t in rows:  # of equal sets the earliest stands for all
        if set(t.split()) not in sets.values():
            sets[i] = set(t.split())
    base = keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    _, _, links = joined(base, LINES, Fraction(4, 5), window=window, enough=enough)
    got = {(r.xk1, r.k1) for r in links.collect()}
    assert all(close(sets[a], sets[b]) for a, b in got)
    assert {b for _, b in got} == {b for b in sets if any(a < b and close(sets[a], sets[b]) for a in sets)}


@pytest.mark.parametrize("window,enough", [(1, 1), (2, 1)])
def test_connect_keeps_components(spark, window, enough):
    rows = family(2)
    base = keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    _, _, links = joined(base, shingles(2), Fraction(1, 2), connect=True, window=window, enough=enough)
    sets = {}
    for i, t in rows:
        found = {tuple(t.split()[k : k + 2]) for k in range(29)}
        if found not in sets.values():
            sets[i] = found

    def roots(pairs):
        root = {i: i for i in sets}
        for a, b in pairs:
            old, new = root[b], root[a]
            root = {i: new if r == old else r for i, r in root.items()}
        return {frozenset(i for i in root if root[i] == r) for r in set(root.values())}

    want = [(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])]
    assert roots((r.xk1, r.k1) for r in links.collect()) == roots(want)


def test_word_hashes_follow_words():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab\n \t\x0b\u00e9\u3000") for _ in range(rnd.randint(0, 60))) for _ in range(200)] + ["x" * 1000 + " y"]
    raw = b"".join(t.encode() for t in texts)
    breaks = np.cumsum([0] + [len(t.encode()) for t in texts])
    h, _ = word_hashes(np.frombuffer(raw, np.uint8), breaks, block=64)
    words = [w for t in texts for w in t.encode().split()]
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words)) == len(set(zip(h.tolist(), words)))


def test_units_follow_lines_and_shingles():
    texts = [None, "", " \n", "a b\n\nc a", "c a", "A b C d", "a B c", "\n\nq"]
    u = lines_of(pa.array(texts))
    assert list(zip(u.row.tolist(), u.line.tolist())) == [(3, 0), (3, 2), (4, 0), (5, 0), (6, 0), (7, 2)]
    assert np.bincount(u.of).tolist() == [2, 2, 2, 4, 3, 1]
    assert u.raw[1] == u.raw[2]  # equal lines
    s = shingles_of(3)(pa.array(texts[:7]))
    assert np.bincount(s.of).tolist() == [1, 1, 1, 2, 1, 2, 1]
    h = s.h.tolist()
    assert h[0] == h[1] == h[2] and h[6] == h[8] and h[5] != h[0]


def test_sketches_tell_large_sets_apart_and_lose_no_pair():
    rnd = np.random.default_rng(3)
    a = rnd.integers(1, 2**63, 4000).astype(np.uint64)
    sets = [a, np.concatenate((a[:3600], rnd.integers(1, 2**63, 350).astype(np.uint64))), a[:3300], rnd.integers(1, 2**63, 4000).astype(np.uint64)]
    sizes = np.array([len(x) for x in sets])
    got = setjoin._sketches(np.concatenate(sets), np.repeat(np.arange(4), sizes), sizes).to_pylist()
    for i in range(4):
        for j in range(4):
            assert setjoin.apart(got[i], got[j]) <= len(set(sets[i].tolist()) ^ set(sets[j].tolist()))
    assert setjoin.apart(got[0], got[3]) * 9 > 8000  # 128 parities never differ in more than 128 of the 888 allowed


def test_every_token_of_a_prefix_goes_to_its_bucket(spark):
    base = keyed(spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(40)], "doc_id long, text string").repartition(3))
    sets = setjoin.unit_sets(base, LINES, Fraction(4, 5), np.zeros(setjoin.SLOTS, np.uint8))
    first = setjoin.first_places(sets)
    rows = setjoin._packed(first, 4).collect()
    assert sum(len(r.token) // 8 for r in rows) == 40 * 5  # as many as a large table's, where no token is known to be alone
    assert all(len(setjoin._tokens(pa.array([bytes(r.prefix)], pa.binary()))[0]) == 5 for r in first.collect())


def test_numbers_dealt_to_the_driver_take_a_byte_each_and_come_back(spark):
    x = np.random.default_rng(4).integers(0, setjoin.SLOTS, 1 << 19).astype(np.int32)
    dealt = setjoin._Dealt(24)
    dealt.held = [x]
    rows = dealt.rows()
    assert sum(map(len, rows.column("x").to_pylist())) < 1.5 * len(x)
    counts = setjoin._gathered(spark.createDataFrame(pa.Table.from_batches([rows, rows])), 24, lambda n: n.astype(np.uint8).tobytes())
    assert b"".join(counts) == (2 * np.bincount(x, minlength=setjoin.SLOTS)).astype(np.uint8).tobytes()


def test_tokens_move_in_few_bytes(spark):
    rnd = random.Random(6)
    texts = ["\n".join(" ".join(f"w{rnd.randrange(3000)}" for _ in range(9)) for _ in range(20)) for _ in range(100)]
    base = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    rows = setjoin._packed(setjoin.first_places(setjoin.unit_sets(base, LINES, Fraction(4, 5), np.zeros(setjoin.SLOTS, np.uint8))).coalesce(1), 4).collect()
    assert sum(len(x) for r in rows for x in r[1:]) < 40 * sum(len(r.token) // 8 for r in rows)


def test_prefixes_of_a_batch_unfold_in_bounded_memory(spark):
    class Frame:
        def where(self, _):
            return self

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    n, many = 10_000, 80
    data = np.random.default_rng(5).bytes(n * many * setjoin.TOKEN_BYTES)
    lists = [data[i : i + many * setjoin.TOKEN_BYTES] for i in range(0, len(data), many * setjoin.TOKEN_BYTES)]
    k = np.arange(n)
    cols = [pa.array(lists, pa.binary()), pa.array(k), pa.array(k), pa.array(np.full(n, 400, np.int32)), pa.array(k), pa.array(k)]
    batch = pa.RecordBatch.from_arrays(cols, names=["prefix", "k1", "at", "n", "s2", "s3"])
    run = setjoin._packed(Frame(), 200)
    tracemalloc.start()
    tokens = sum(len(t) // 8 for b in run(iter([batch])) for t in b.column(1).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens == n * many and peak < 60e6
