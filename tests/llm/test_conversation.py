"""Conversation repair against a search of all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from gritstone.llm import conversation as C

LEGAL = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute(rows):
    """``rows``: (conv, turn, role, text). Cheapest edits by a search in the order of (cost, audit)."""
    out = {}
    for conv in {r[0] for r in rows}:
        t = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if k == 0:
                continue
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            t += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        t.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).digest()))
        seen, fault = set(), []
        for _, role, text in t:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "-")
            seen.add((role, text))
        turns = {x[0] for x in t if x[0] is not None}
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, state, lines = heapq.heappop(heap)
            if i == len(t) and state in ("", "a"):
                break
            if (i, state) in done:
                continue
            done.add((i, state))
            for role in ("user", "assistant"):
                if (state, role[0]) in LEGAL:
                    heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*lines, f"{role}:")))
            if i < len(t):
                _, role, text = t[i]
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
                if fault[i] in "-t":
                    more = 5 * (fault[i] == "t")
                    if (state, role[:1]) in LEGAL:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
                    for role in ("user", "assistant"):
                        if (state, role[0]) in LEGAL:
                            heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, role[0], (*lines, f"{role}:{text}")))
        bad = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(t, t[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, fault.count("b"), fault.count("d"), fault.count("t"), bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = [tuple(r) for r in C.repair_report(df).collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


def made(seed, n=150):
    rnd = random.Random(seed)
    out = []
    for c in range(n):
        for k in range(rnd.randrange(1, 14)):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "Users", None])
            out.append((None if c == 3 else c, rnd.choice([None, k, k, k, k + 7]), role, rnd.choice(["Yes.", "No", " \t", "", "Why?", "é!", "end.\n", "語", None, f"line {k}\nmore {c}."])))
    return out


@pytest.mark.parametrize("segment", [512, 2])
def test_matches_search(spark, monkeypatch, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)
    rows = made(segment)
    assert report(spark, rows) == brute(rows)


def test_hot_conversation_repeats_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", 16)
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i % 90}.") for i in range(400)] + [(1, 77, "user", "again and again.")] * 150
    rows += [(2, 1, "user", "long " * 300_000 + "."), (2, 2, "assistant", "x" * 1_000_000), (3, 1, "user", "Hi."), (3, 1, "user", "Hi.")]
    assert report(spark, rows) == brute(rows)


def test_dropped_and_empty(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    got = report(spark, [(9, gone, "user", "Hi.")])
    assert got == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert C.repair_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string, conv string")).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in C.op12_conversation_repair(spark, sf).collect()}
    assert got == brute(rows)


def test_repaired_rows_hold_the_grammar(spark):
    rows = C.damage(spark.createDataFrame(made(5, 40), "conv_id long, turn long, role string, text string"))
    got = C.repair(rows).rows(rows).orderBy("conv", "part", "seg", "step").collect()
    for conv in {r.conv for r in got}:
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in got if r.conv == conv))
