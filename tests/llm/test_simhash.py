"""SimHash near-dedup against brute force over all pairs of fingerprints."""

import random

import xxhash
from pyspark.sql import functions as F

from gritstone.llm.simhash import fingerprint, hamming_links, simhash_dedup, simhash_filter


def slow_fingerprint(text, width=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def texts_of(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(50)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(0, 400))] for _ in range(12)]
    texts = [None, "", "  \n", "ONE", "one two", "a b c", "A\u00a0B É c d", "x y z " * 300]
    for b in base:
        for _ in range(5):
            c = list(b)
            for _ in range(rnd.randint(0, 3)):
                if c:
                    c[rnd.randrange(len(c))] = rnd.choice(words)
            texts.append(" ".join(c))
    return texts


def brute(ids, fps):
    root = list(range(len(ids)))
    find = lambda i: i if root[i] == i else find(root[i])
    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                root[find(a)] = find(b)
    return [min((ids[j] for j in range(len(ids)) if find(j) == find(i) and ids[j] is not None), default=None) for i in range(len(ids))]


def test_fingerprints():
    for t in texts_of(1):
        for width in (3, 5):
            assert fingerprint(t, width) == slow_fingerprint(t, width)


def test_matches_brute_force(spark):
    texts = texts_of(2)
    ids = [*random.Random(3).sample(range(1000), len(texts))]
    ids[10] = None
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp string").repartition(3)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup(docs).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert got == {(i, f"{f:016x}", c) for i, f, c in zip(ids, fps, brute(ids, fps))}
    kept = simhash_filter(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in zip(ids, brute(ids, fps)) if i == c}


def test_links_meet_all_pairs_of_small_distance(spark):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        g = f
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            g ^= 1 << b
        fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b) for r in hamming_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert got == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_dedup(empty).count() == 0 and simhash_filter(empty).agg(F.count("*")).first()[0] == 0


def test_filter_judges_rows_of_one_id_by_their_texts(spark):
    from gritstone.llm.simhash import simhash_filter

    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text, 1), (5, text, 2), (5, "quite another text of its own", 3)]
    got = simhash_filter(spark.createDataFrame(rows, "doc_id long, text string, __id int"))
    assert got.columns == ["doc_id", "text", "__id"] and sorted(r["__id"] for r in got.collect()) == [1, 3]
