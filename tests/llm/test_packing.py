"""Packing: ids against the library, complete and gapless sequences, bounds on their number."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gritstone.llm.packing import _exchange, best_fit, local_search, pack, word_encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "  ", "Don't I'LL they'Re", "ÀÉ é e\u0301 İstanbul ŉ K ſ", "a\x1cb x\u3000y z\u00a0w", "12345 1,2.3", "<|endoftext|> hi <|x", "onwh,!! 'tis (a)b",
    "日本 語", "🙂 ok", "x" * 700, "under_score foo_", "\x85next", "a\u0301b ª² ß ǅ", "tion" * 90,
]


def test_ids_match_the_library():
    tok, enc = Tokenizer.from_file(PATH), word_encoder(PATH)
    for t, ids in zip(ODD, enc.encode(ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids, t


def check(rows, texts, capacity):
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for i, parts in by_doc.items():
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [(r.start, r.length) for r in parts] == [(a, min(capacity, len(ids) - a)) for a in range(0, len(ids), capacity)]
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), -(-sum(r.length for r in rows) // capacity)


def test_sequences_are_complete_and_gapless(spark):
    rnd = random.Random(1)
    texts = dict(enumerate([*ODD, *(" ".join(rnd.choice(["one", "two", "Three,", "vier"]) for _ in range(rnd.randint(0, 300))) for _ in range(120))]))
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, length long").repartition(4)
    bins, bound = check(pack(docs, capacity=128, salts=4).collect(), texts, 128)
    assert bins <= bound * 1.05 + 1


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string"), capacity=8).collect()
    assert sorted(r.length for r in rows) == [1, 2, 3, 3] and len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert len({r.sequence_id for r in rows}) == 2
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_local_search_keeps_pieces_and_never_adds_bins():
    rng = np.random.default_rng(0)
    for low, high in ((1, 100), (20, 60), (34, 50), (51, 60)):
        counts = Counter(rng.integers(low, high, 2000).tolist())
        bins = best_fit(counts, 100)
        after = local_search(bins, 100)
        for b in (bins, after):
            assert all(sum(p) <= 100 for p in b)
            assert Counter({k: v for k, v in sum((Counter({x: n * p.count(x) for x in set(p)}) for p, n in b.items()), Counter()).items()}) == counts
        assert sum(after.values()) <= sum(bins.values())


def test_local_search_empties_bins():
    assert sum(local_search(Counter({(6, 2): 1, (5, 3): 1, (4,): 1}), 10).values()) == 2


def test_search_ends_only_where_no_pair_of_bins_gains():
    random.seed(3)
    for lengths in ([random.randint(1, 3) for _ in range(400)], [random.randint(30, 60) for _ in range(90)], [random.randint(31, 36) for _ in range(300)]):
        counts = Counter(lengths)
        bins = local_search(best_fit(counts, 100), 100)
        assert Counter(x for p, n in bins.items() for x in p for _ in range(n)) == counts
        if sum(bins.values()) == -(-sum(lengths) // 100):
            continue
        loose = sorted((p for p in bins if sum(p) < 100), key=sum)
        for i, b in enumerate(loose):
            for a in loose[i:]:
                if a == b and bins[a] < 2:
                    continue
                found = _exchange(a, b, 100)
                assert not found or sum(map(lambda x: sum(x) ** 2, found)) <= sum(a) ** 2 + sum(b) ** 2
