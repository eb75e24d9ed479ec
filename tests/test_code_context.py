"""Stabbing joins, symbol windows and supporting files against plain computations."""

import random

from pyspark.sql import functions as F

from gritstone.operators import code_context as C


def test_stab_equals_all_pairs(spark):
    rnd = random.Random(2)
    spans = [(k, lo, lo + rnd.choice([0, 0, 1, 2, 5, 63, 64, 65, 500]), f"s{i}") for i, (k, lo) in enumerate((rnd.choice("aab"), rnd.randrange(-20, 700)) for _ in range(300))]
    spans += [("a", 1, 1000, "whole"), ("a", 10, 20, "left"), ("a", 21, 30, "right"), ("a", 12, 15, "inner"), ("a", 12, 15, "twin"), ("a", 9, 3, "backwards"), ("a", None, 3, "open"), (None, 1, 9, "no key"), ("hot", 5, 5, "one")]
    points = [(k, i, p) for i, (k, p) in enumerate([(rnd.choice("ab"), rnd.randrange(-30, 1300)) for _ in range(400)] + [("a", 20), ("a", 21), ("a", 12), ("a", 15), ("a", None), (None, 2)] + [("hot", 5)] * 50)]
    s = spark.createDataFrame(spans, "k string, lo int, hi int, name string").repartition(3)
    p = spark.createDataFrame(points, "k string, id int, line int")
    want = [(i, n) for k, i, x in points for kk, lo, hi, n in spans if None not in (k, x, kk, lo) and k == kk and lo <= x <= hi]
    assert sorted((r.id, r.name) for r in C.stab(p, s, ["k"], "line").collect()) == sorted(want)
    best = {}
    for k, i, x in points:
        held = [(-lo, hi, n) for kk, lo, hi, n in spans if None not in (k, x, kk, lo) and k == kk and lo <= x <= hi]
        if held:
            best[i] = min(held)[2]
    assert {r.id: r.name for r in C.innermost(p, s, ["k"], "line", ["id"]).collect()} == best
    assert C.stab(p, s.limit(0), ["k"], "line").count() == 0


def plain_context(symbols, hunks, n):
    """The rule, file by file, as a loop."""
    out = []
    for lo, hi, name, kind in sorted(symbols):
        touched = any(lo <= x <= hi for a, b in hunks for x in range(a, b + 1))
        if touched or len(out) < 6:
            out.append((not touched, max(1, lo - 8), lo, hi, name, kind, min(n, hi + 8)))
    if symbols:
        return [(r, x[4], x[5], x[1], x[6], not x[0]) for r, x in enumerate(sorted(out)[:8], 1)]
    return [(i, f"hunk_{i}", C.FALLBACK_TYPE, max(1, a - 8), min(n, b + 1 + 8), True) for i, (a, b) in enumerate(hunks[:6], 1)]


def test_context_equals_the_rule(spark):
    rnd = random.Random(4)
    symbols, hunks, files, want = [], [], [], []
    for f in range(60):
        n = rnd.randrange(5, 300)
        own = [] if f % 6 == 0 else [(lo, min(n, lo + rnd.randrange(40)), f"f{i}", rnd.choice(["class", "function"])) for i, lo in enumerate(sorted(rnd.sample(range(1, n + 1), min(n, rnd.randrange(1, 25)))))]
        cuts = [(a, a + rnd.randrange(6)) for a in sorted(rnd.sample(range(1, n + 20), rnd.randrange(9)))]
        symbols += [(f, *s) for s in own]
        hunks += [(f, i, a, b) for i, (a, b) in enumerate(cuts, 1)]
        files.append((f, n))
        want += [(f, *r) for r in plain_context(own, cuts, n)]
    got = C.structural_context(
        spark.createDataFrame(symbols, "file int, lo int, hi int, name string, kind string").repartition(3), spark.createDataFrame(hunks, "file int, nth int, lo int, hi int"),
        spark.createDataFrame(files, "file int, n_lines int"), ["file"],
    )
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


CODE = """import os

class A:
    def one(self):
        return 1

    class Inner:
        def two(self):
            return 2


async def three():
    return os
"""


def test_python_context_of_texts(spark):
    blobs = spark.createDataFrame([(1, "a.py", CODE), (2, "b.py", "def (:\nx\n"), (3, "c.txt", CODE), (4, "d.py", ""), (5, "e.py", None)], "file int, path string, text string")
    patch = "--- a\n+++ b\n@@ -8,2 +8,3 @@\n x\n@@ -1 +1 @@\n-y\n"
    patches = spark.createDataFrame([(i, patch) for i in range(1, 6)], "file int, patch string")
    got = {(r.file, r.rank): r for r in C.python_context(blobs, patches, ["file"]).collect()}
    assert [(got[1, i].symbol, got[1, i].touched) for i in range(1, 6)] == [("A", True), ("Inner", True), ("two", True), ("one", False), ("three", False)]
    assert got[1, 5].code.endswith("return os") and got[1, 5].start_line == 4 and got[1, 5].end_line == 13
    assert (got[2, 1].symbol, got[2, 1].symbol_type, got[2, 1].start_line, got[2, 1].end_line, got[2, 1].code) == ("hunk_1", C.FALLBACK_TYPE, 1, 2, "def (:\nx")
    assert not any(f == 3 for f, _ in got) and got[4, 1].code == patch and got[5, 2].symbol == "hunk_2"


def test_supporting_windows_on_literal_files(spark):
    text = {
        "src/main.py": "import util\nfrom pkg import *\nfrom pkg.deep import thing, other\nfrom . import near\nimport util\nimport gone\n\ndef run():\n    pass\n\ndef quiet():\n    pass\n",
        "src/util.py": "x = 1\n" * 100, "pkg/__init__.py": "", "pkg/deep/thing.py": "y = 2", "src/near.py": "", "lib/other_caller.py": "prerun(1)\n", "b_caller.py": "run()\n", "a.txt": "run()",
        "n1.py": "n", "n2.py": "n",
    }
    text |= {f"c{i}.py": "run()" for i in range(6)}
    blobs = spark.createDataFrame([("s1", p, t) for p, t in text.items()] + [("s2", "src/util.py", "run()")], "snapshot string, path string, text string")
    shape = C.outlines(blobs, ["snapshot", "path"])
    tasks = spark.createDataFrame([(1, "s1"), (2, "s1"), (3, "s2")], "task int, snapshot string")
    kind = "task int, path string, nth int, ranges array<struct<lo:int,hi:int>>"
    changed = spark.createDataFrame([(1, "src/main.py", 0, [(8, 8)]), (1, "n2.py", 1, None), (2, "src/main.py", 0, []), (3, "src/util.py", 0, [(1, 1)])], kind)
    near = spark.createDataFrame([(1, "n2.py", 0), (1, "n1.py", 1), (1, "src/util.py", 2), (1, "missing.py", 3)] + [(2, f"c{i}.py", i) for i in range(6)] + [(2, "a.txt", 9), (2, "n1.py", 10), (2, "n2.py", 11), (2, "b_caller.py", 12), (2, "src/near.py", 13)], "task int, path string, nth int")
    got = {}
    for r in C.supporting_windows(tasks, changed, near, shape).orderBy("task", "rank").collect():
        got.setdefault(r.task, []).append((r.path, r.source, r.line_end))
    assert got[1] == [
        ("src/util.py", "resolved_import::import", 70), ("pkg/__init__.py", "resolved_import::import_from_star", 1), ("pkg/deep/thing.py", "resolved_import::import_from", 1),
        ("n1.py", C.BY_COTOUCH, 1), *[(p, "rg_callee_occurrence::run", 1) for p in ("b_caller.py", "c0.py", "c1.py", "c2.py")],
    ]
    assert len(got[2]) == 12 and [p for p, _, _ in got[2]][3:] == [*(f"c{i}.py" for i in range(6)), "a.txt", "n1.py", "n2.py"]
    assert 3 not in got


def test_outlines_leave_in_pieces(spark, monkeypatch):
    """Pieces of three files give what one piece gives."""
    monkeypatch.setattr(C, "FILES", 3)
    df = spark.range(10).select("id", F.format_string("def f%d(): pass", "id").alias("text")).coalesce(1)
    out = C.outlines(df, ["id"])
    assert sorted((r.id, r.symbols[0].name) for r in out.collect()) == [(i, f"f{i}") for i in range(10)]
    monkeypatch.setattr(C, "FILES", 1 << 20)
    assert sorted((r.id, r.symbols[0].name) for r in C.outlines(df, ["id"]).collect()) == [(i, f"f{i}") for i in range(10)]


def test_symbols_are_marked_without_pairs_and_as_by_brute_force(spark, monkeypatch):
    import random

    from gritstone.operators import code_context as C

    monkeypatch.setattr(C, "stab", None)  # each symbol and hunk moves once, not once a length of blocks
    rnd = random.Random(5)
    symbols = [(k, lo, lo + rnd.randint(-1, 30), f"s{i}", "function") for k in (1, 2, None) for i, lo in enumerate(rnd.sample(range(1, 300), 25))] + [(1, None, 5, "n", "class")]
    hunks = [(k, i + 1, lo, rnd.choice([None, lo - 1, lo, lo + rnd.randint(0, 6)])) for k in (1, 2, None) for i, lo in enumerate(rnd.sample(range(1, 300), 9))] + [(2, 10, None, 8)]
    s = spark.createDataFrame(symbols, "f long, lo int, hi int, name string, kind string")
    h = spark.createDataFrame(hunks, "f long, nth int, lo int, hi int")
    monkeypatch.setattr(C, "MOST_SYMBOLS", 1000)
    got = {(r.f, r.symbol) for r in C.structural_context(s, h, spark.createDataFrame([(1, 400), (2, 400)], "f long, n_lines int"), ["f"]).where("touched").collect()}
    begins = lambda s, h: s[1] <= h[2] <= s[2]
    holds = lambda s, h: h[3] is not None and h[2] <= s[1] <= h[3]
    ok = lambda s, h: s[0] is not None and s[0] == h[0] and s[1] is not None and h[2] is not None and (begins(s, h) or holds(s, h))
    assert got == {(x[0], x[3]) for x in symbols if any(ok(x, y) for y in hunks)}


def test_endings_that_begin_as_no_name_does_do_not_move(spark):
    from gritstone.operators import code_context as C

    shape = spark.createDataFrame([("s", "a.py", ["o123", "xo123"]), ("s", "b.txt", ["o123"])], "snapshot string, path string, called array<string>")
    names = spark.createDataFrame([("s", "o123")], "snapshot string, name string")
    found = C.call_index(shape, names)
    assert [tuple(r) for r in found.collect()] == [("s", "o123", "a.py")]
    assert "initials" in found._jdf.queryExecution().analyzed().toString()
