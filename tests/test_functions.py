"""Scalar functions on literal rows, quirks included."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from gritstone.functions import diffs as D
from gritstone.functions import symbols as SY
from gritstone.functions import text as X
from gritstone.functions import times as TM


def one(spark, expr, **cols):
    row = spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v))).alias(k) for k, v in cols.items()])
    return row.select(expr.alias("x")).first().x


def test_links(spark):
    t = "Fixes #1, closes: #2 and resolved #3; see https://github.com/a/b/issues/44 fix#5"
    assert one(spark, X.closing_links(F.col("t")), t=t) == [1, 3, 5]
    assert one(spark, X.closing_links_loose(F.col("t")), t=t) == [1, 2, 3, 5]
    assert one(spark, X.issue_url_links(F.col("t")), t=t) == [44]
    body = spark.createDataFrame([("ends in fixes", [("#2",), ("x",)])], "b string, c array<struct<body: string>>")
    assert body.select(X.link_text(F.col("b"), F.col("c"))).first()[0] == "ends in fixes#2 x"
    assert body.select(X.closing_links(X.link_text(F.col("b"), F.col("c")))).first()[0] == [2]


def test_stripping_and_truncation(spark):
    assert one(spark, X.strip_closure_signals(F.col("t")), t="LGTM merged, Merging this; closed_at") == "[STRIPPED] [STRIPPED], [STRIPPED]; [STRIPPED]"
    assert one(spark, X.truncate(F.col("t"), 3), t="abcd") == "abc"
    assert one(spark, X.truncate_tokens(F.col("t"), 1), t="abcdef") == "abcd..."
    assert one(spark, X.first_words(F.col("t"), 2), t=" a\nb  c ") == "a b"
    assert one(spark, X.approx_tokens(F.col("t")), t="abc") == 1 and one(spark, X.word_tokens(F.col("t")), t=" a  b\n") == 2
    text = "<!-- x\ny -->Keep this\n---\n![i](u) see https://a.b/c\nThank you for contributing!\n<img src=x>\n  and  that"
    assert one(spark, X.clean_pr_body(F.col("t")), t=text) == "Keep this see and that"


def test_reasons(spark):
    r = X.no_change_reason(F.col("t"), F.col("b"))
    assert one(spark, r, t="Dupe of 3", b="") == X.DUPLICATE_REASON and one(spark, r, t="a", b="Works as intended") == X.INVALID_REASON
    long = one(spark, r, t="word " * 40, b="")
    assert long.endswith("word.).") and len(long) <= len(X.UNLINKED_REASON) + 140
    assert one(spark, X.label_reason(F.col("l"), F.col("s")), l=["Kind:Question"], s="x") == "question"


def test_paths(spark):
    assert one(spark, X.normalize_path_loose(F.col("p")), p="./.github\\x") == "github/x"
    assert one(spark, X.normalize_path(F.col("p")), p="././.github\\x") == ".github/x"
    moves = ((r"^core/", "core/src/core/"), (r"_", "-"))
    assert one(spark, X.path_aliases(F.col("p"), moves), p="./core/a_b.py") == ["core/a_b.py", "core/src/core/a_b.py", "core/a-b.py"]


def test_keywords_and_labels(spark):
    got = one(spark, X.keywords(F.col("t")), t="The DagRun fails in my_task_id at src/models/dag.py with the Scheduler")
    assert {"dagrun", "my_task_id", "src/models/dag.py", "scheduler", "dag", "task"} <= set(got)
    p = X.parse_labels(F.col("t"))
    assert one(spark, p, t='["a", "b"]') == ["a", "b"] and one(spark, p, t='[{"name": "a"}]') == ["a"] and one(spark, p, t="a, b,") == ["a", "b"]
    assert one(spark, p, t=None) == []


def test_hash_percent(spark):
    rows = spark.range(300).select("id", X.hash_percent(F.col("id")).alias("p")).collect()
    assert all(r.p == int(hashlib.md5(str(r.id).encode()).hexdigest(), 16) % 100 for r in rows)


def test_generated_text(spark):
    assert one(spark, X.teacher_adjustment(F.col("t")), t="ADJUSTMENT: -0.9\nREASON: x") == -0.3
    assert one(spark, X.teacher_adjustment(F.col("t")), t="none") == 0.0
    assert one(spark, X.teacher_reason(F.col("t")), t="ADJUSTMENT: 0.1\nREASON: because so\nz") == "because so"
    assert one(spark, X.blended_score(F.col("p"), F.col("a")), p=0.5, a=0.1) == pytest.approx(0.54)
    assert one(spark, X.verdict(F.col("t")), t="VERDICT: revise, not ACCEPT") == "REVISE" and one(spark, X.verdict(F.col("t")), t="hm") == "UNKNOWN"
    assert one(spark, X.predicted_files(F.col("t")), t="FILES:\n- a/b.py\n- `c.py`\n- a/b.py\n\nPLAN: x") == ["a/b.py", "c.py"]
    assert one(spark, X.strip_fences(F.col("t")), t="```diff\n--- a\n```") == "--- a"
    assert one(spark, X.json_object(F.col("t")), t='x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert one(spark, X.touched_files(F.col("t")), t="--- a/x\n+++ b/x.py\n+++ b/y.py\n") == ["x.py", "y.py"]
    assert one(spark, X.chosen_text(F.col("t")), t="a CHOSEN: b CHOSEN: c") == "b CHOSEN: c"
    assert one(spark, X.issue_reference(F.col("t")), t="see issue 12") == 12 and one(spark, X.issue_reference(F.col("t")), t="x") is None
    plan = one(spark, X.parse_plan(F.col("t"), F.lit("d.py")), t='{"summary": "s", "spans": [{"file": "a", "start_line": -3, "end_line": 0}]}')
    assert plan.summary == "s" and plan.spans[0].start_line == 1 and plan.spans[0].end_line == 1
    assert one(spark, X.parse_plan(F.col("t"), F.lit("d.py")), t="rubbish").spans[0].file == "d.py"
    assert one(spark, X.has_prose(F.col("t")), t="a\nb\nc\nd") and not one(spark, X.has_prose(F.col("t")), t="--- a\n+++ b\n@@ -1 +1 @@\n-a\n+b")
    assert one(spark, X.jitter_days(F.col("t"), F.col("k"), 1), t="A: 1\nDAYS_OPEN: 20\nB", k=4).startswith("A: 1\nDAYS_OPEN: ")
    assert one(spark, X.score_bar(F.col("s")), s=0.5) == "█" * 5 + "░" * 5


def test_times(spark):
    p = TM.parse_ts(F.col("t"))
    assert one(spark, p, t="2024-01-02T03:04:05Z") == one(spark, p, t="2024-01-02 05:04:05+02:00") == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert all(one(spark, p, t=t) is None for t in ("None", "null", "", "x", None))
    assert one(spark, TM.parse_ts_drop_offset(F.col("t")), t="2024-01-02T05:04:05+02:00") == dt.datetime(2024, 1, 2, 5, 4, 5)
    a, b = dt.datetime(2024, 1, 1, 0, 59), dt.datetime(2024, 1, 1, 1, 1)
    assert one(spark, TM.boundary_days(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(1 / 24)
    assert one(spark, TM.elapsed_days(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(2 / 1440)
    t = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 15, 23), dt.datetime(2024, 1, 2)]
    assert one(spark, TM.max_gap_days(F.col("t"), floor=True), t=t) == 13 and one(spark, TM.max_gap_days(F.col("t")), t=t[:1]) is None


PATCH = "@@ -1,3 +1,4 @@\n a\n-b\n+B\n+C\n c\n@@ -9 +10 @@\n-x\n+y"
BASE = "a\nb\nc\nd\ne\nf\ng\nh\nx\n"


def test_diffs(spark):
    h = one(spark, D.hunk_headers(F.col("p")), p=PATCH)
    assert [tuple(x) for x in h] == [(1, 3, 1, 4), (9, 1, 10, 1)]
    assert D.apply_patch(BASE, PATCH) == "a\nB\nC\nc\nd\ne\nf\ng\nh\ny\n"
    assert D.apply_patch("a\nz\nc\n", PATCH) is None and D.apply_patch(BASE, "text") is None
    assert D.apply_patch("a\nb", "@@ -2 +2 @@\n-b\n\\ No newline at end of file\n+c\n\\ No newline at end of file") == "a\nc"
    df = spark.createDataFrame([(BASE, PATCH), (None, PATCH)], "b string, p string")
    assert [r.x for r in df.select(D.apply_patch_udf("b", "p").alias("x")).collect()] == [D.apply_patch(BASE, PATCH), None]
    assert [r.x for r in df.select(D.counts_agree(F.col("p")).alias("x")).collect()] == [True, True]
    assert [r.x for r in spark.createDataFrame([("a = 1",), ("a = ",)], "c string").select(D.compiles_udf("c").alias("x")).collect()] == [True, False]
    assert one(spark, D.first_hunk(F.col("p")), p="pre\n" + PATCH) == "@@ -1,3 +1,4 @@\n a\n-b\n+B\n+C\n c"
    assert one(spark, D.first_hunk(F.col("p"), True), p="pre\n" + PATCH).startswith("pre\n@@ -1,3")
    assert one(spark, D.overlaps(D.touched_ranges(D.hunk_headers(F.col("p"))), F.lit(4), F.lit(9)), p=PATCH)
    assert not one(spark, D.overlaps(D.touched_ranges(D.hunk_headers(F.col("p"))), F.lit(5), F.lit(9)), p=PATCH)
    full = "--- a/x\n+++ b/x\n" + PATCH
    assert one(spark, D.is_valid_diff(F.col("p")), p=full) and not one(spark, D.is_valid_diff(F.col("p")), p=PATCH)
    assert one(spark, D.starts_as_diff(F.col("p")), p=full) and one(spark, D.has_changes(F.col("p")), p=PATCH)


def test_windows_in_a_row(spark):
    v = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((5, 9), (1, 3), (4, 4), (20, 30), (6, 7))])
    assert [tuple(r) for r in one(spark, D.merge_intervals(v))] == [(1, 9), (20, 30)]
    assert [tuple(r) for r in one(spark, D.clip_to_budget(D.merge_intervals(v), 12))] == [(1, 9), (20, 22)]
    assert [tuple(r) for r in one(spark, D.primary_windows(F.lit(10), D.hunk_headers(F.lit(PATCH))))] == [(1, 10)]
    assert [tuple(r) for r in one(spark, D.primary_windows(F.lit(1000), D.hunk_headers(F.lit("@@ -500,2 +500,2 @@"))))] == [(460, 541)]
    assert one(spark, D.numbered(F.lit("a\nb\nc"), F.lit(2), F.lit(3))) == "     2|b\n     3|c"


CODE = "import os.path\nfrom a.b import c\nfrom . import z\nclass A:\n    def m(self):\n        pass\n\nasync def f():\n    pass\n"


def test_symbols(spark):
    assert SY.python_symbols(CODE) == [("class", "A", 4, 6), ("function", "m", 5, 6), ("function", "f", 8, 9)]
    assert SY.python_symbols("def (") == []
    spark.udtf.register("python_symbols", SY.PythonSymbols)
    spark.udtf.register("import_targets", SY.ImportTargets)
    df = spark.createDataFrame([(CODE,)], "code string")
    df.createOrReplaceTempView("code_rows")
    assert [r.name for r in spark.sql("select s.name from code_rows, lateral python_symbols(code) s").collect()] == ["A", "m", "f"]
    got = {r.candidate for r in spark.sql("select s.candidate from code_rows, lateral import_targets(code, array('', 'src/')) s").collect()}
    assert {"os/path.py", "src/a/b/c.py", "a/b/__init__.py"} <= got
    s = one(spark, SY.textual_symbols(F.lit("x/a.go"), F.lit("type T struct {}\nfunc (t T) Go() {}\nfunc Main() {}")))
    assert s.classes == ["T"] and s.functions == ["Go", "Main"]
    assert one(spark, SY.textual_symbols(F.lit("x/readme.md"), F.lit("t"))).functions == ["readme"]
    assert one(spark, SY.index_line(F.lit("p"), F.array(F.lit("A")), F.array().cast("array<string>"))) == "p\n  classes: A"
