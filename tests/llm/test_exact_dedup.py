"""Exact dedup against brute force."""

import hashlib

from gritstone.llm.exact_dedup import exact_dedup


def brute(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    out = []
    for i, t in rows:
        group = [(j, u) for j, u in rows if norm(u) == norm(t)]
        keep = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a b "), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r"), (8, "a\u00a0b"), (9, "é"), (10, "e\u0301"), (11, "x" * 100_000), (12, "x" * 100_000)]
    rows += [(100 + i, "hot  text" if i % 7 else "hot text!") for i in range(200)] + [(None, "ab"), (None, "only null"), (2, "ab")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, run string").repartition(5)
    for runs, fan in ((64, 8), (5, 2), (1, 2)):
        got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs, runs=runs, fan_in=fan).collect()), key=str)
        assert got == brute(rows)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
