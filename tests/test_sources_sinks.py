"""Readers, writers, manifests and the paged source, on files of our own."""

import json

import pytest
from pyspark.sql import functions as F

from gritstone import schema
from gritstone.operators.relational import dedup_latest
from gritstone.sources import readers as R
from gritstone.sources import sinks as K
from gritstone.sources import chunks as CH
from gritstone.sources import records as RC
from gritstone.sources.paged import PagedSource


def test_jsonl_blank_malformed_and_missing_key(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"issue_number": 1, "extracted_at": "1", "repo": "first"}\n\n{"issue_number": 1, "extracted_at": "1", "repo": "second"}\n{broken\n{"repo": "no key"}\n')
    df = R.read_jsonl(spark, str(tmp_path / "*.jsonl"), schema.RAW_ISSUE).cache()
    good, bad = R.split_malformed(df, "issue_number")
    assert good.count() == 2 and {r.reason for r in bad.collect()} == {"malformed", "missing_key"}
    one = good.select("issue_number", "repo", "extracted_at", F.col("_line_order.i").alias("i"))
    assert [r.repo for r in dedup_latest(one, "issue_number", F.coalesce("extracted_at", F.lit("")), F.col("i")).collect()] == ["first"]
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_jsonl(spark, str(tmp_path / "*.jsonl"), schema.RAW_ISSUE, strict=True).collect()


def test_csv_json_and_dispatch(spark, tmp_path):
    (tmp_path / "a.csv").write_text('PR_NUMBER,LINKED_ISSUE_NUMBER,PR_TITLE,STATE,IS_MERGED,REVIEW_COUNT,CREATED_AT,RAW_JSON\n1,7,"two\nlines",closed,true,2,x,"{""pr_number"": 1}"\n2,,t,open,false,0,x,nan\n3,8,t,open,false,0,x,nan\n')
    df = R.read_any(spark, str(tmp_path / "a.csv"), schema.PR_CSV)
    assert df.count() == 3 and df.where("PR_NUMBER = 1").first().PR_TITLE == "two\nlines"
    looked = {r.LINKED_ISSUE_NUMBER: r.parsed.pr_number for r in R.pr_lookup(df, schema.RAW_PR).collect()}
    assert looked == {7: 1, 8: None}
    (tmp_path / "e.json").write_text(json.dumps({"prompt": {"0": "a", "1": "b"}, "n": {"0": 1, "1": 2}}))
    assert sorted((r["index"], r.prompt, r.n) for r in R.read_any(spark, str(tmp_path / "e.json"), "prompt string, n int").collect()) == [("0", "a", 1), ("1", "b", 2)]
    with pytest.raises(ValueError):
        R.read_any(spark, "x.orc", "a int")
    (tmp_path / "i.json").write_text(json.dumps({"./a.py": {"classes": ["A"], "functions": []}, "a.py": {"classes": ["B"], "functions": ["f"]}}))
    idx = R.read_symbol_index(spark, str(tmp_path / "i.json"), lambda c: F.regexp_replace(c, r"^\./", "")).collect()
    assert [(r.path, r.classes) for r in idx] == [("a.py", ["B"])]
    assert R.first_existing(spark, None, str(tmp_path / "none"), str(tmp_path / "i.json")).endswith("i.json")


def test_source_scan(spark, tmp_path):
    for p, t in {"r/a.py": "x", "r/b/init__.py": "", "r/c/init__.py": "class A: pass", "r/c/__init__.py": "class B: pass", "r/build/d.py": "x", "r/e.egg-info/f.py": "x", "r/g.bin": "x", "r/README.md": "1\n2"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    files = R.scan_sources(spark, str(tmp_path / "r"))
    assert sorted(r.path for r in files.collect()) == ["a.py", "c/init__.py"]
    assert [r.path for r in R.search_code(files, "class A").collect()] == ["c/init__.py"]
    md = R.scan_sources(spark, str(tmp_path / "r"), ("md",))
    assert R.readme_head(md, 1).first().head == "1" and R.list_files(files, 1).count() == 1


def test_lookup_raises(spark):
    df = spark.createDataFrame([(1, "Title")], "n int, title string")
    assert R.point_lookup(df, F.col("title").ilike("tit%"), [F.col("n")]).columns == ["N", "TITLE"]
    with pytest.raises(LookupError):
        R.point_lookup(df, F.col("n") == 2, [F.col("n")])


def fetch(page):
    return [{"n": 10 * page + i} for i in range(2)] if page < 4 else []


def test_paged_source(spark):
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").option("pages", 5).option("pages_per_task", 2).option("fetch", "tests.test_sources_sinks.fetch").load()
    assert sorted(json.loads(r.record)["n"] for r in df.collect()) == [10, 11, 20, 21, 30, 31]


def full(page):
    return [{"n": 10 * page + i} for i in range(3)] if page < 5 else [{"n": 50}] if page == 5 else []


@pytest.mark.parametrize("per_task", [1, 2, 3, 9])
@pytest.mark.parametrize("most", [1, 3, 4, 12, 13, 99])
def test_paged_source_caps_all_partitions(spark, per_task, most):
    spark.dataSource.register(PagedSource)
    read = lambda **o: [json.loads(r.record)["n"] for r in spark.read.format("paged").options(pages=9, pages_per_task=per_task, max_items=most, fetch="tests.test_sources_sinks.full", **o).load().collect()]
    want = [r["n"] for p in range(1, 9) for r in full(p)][:most]
    assert sorted(read()) == sorted(read(per_page=3)) == want


def asked(page):
    if page not in (2, 3):
        raise ValueError(page)
    return [page]


def test_paged_source_fetches_only_the_pages_asked_for(spark):
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("paged").options(pages=9, pages_per_task=2, push_filters=True, fetch="tests.test_sources_sinks.asked").load()
        assert sorted(r.page for r in df.where("page >= 2 and page < 4").collect()) == [2, 3]
        assert [r.page for r in df.where("page in (3, 12)").collect()] == [3] and df.where("page > 9").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def service(part, key, page):
    """Stands for the service: two changes, an issue, long lists, and calls that fail."""
    if part in ("pr", "issue"):
        if key == 3:
            raise OSError("gone")
        if key == 4:
            return None
        return {"number": key, "title": f"t{key}", "body": "Fixes #7", "head": {"sha": f"sha{key}"}, "labels": [{"name": "bug"}, {"name": ""}]}
    if part == "requested_reviewers":
        return {"users": [{"login": "ann"}, {"login": "bob"}], "teams": []}
    if part == "comments":
        return [{"body": "closes #8", "created_at": "x"}]
    if part == "files":
        return [{"filename": f"f{i}"} for i in range(100 * (page - 1), min(100 * page, 205))]
    if part == "reviews" and key == 2:
        raise TimeoutError("slow")
    if part == "reviews":
        return [{"id": 1, "state": "APPROVED", "user": {"login": "ann"}}]
    if part == "check_runs":
        return [{"name": "tests", "conclusion": "success"}, {"name": "lint", "conclusion": {"sha1": "failure", "sha2": "neutral"}[key]}]
    return []


def test_records_are_assembled_from_endpoints(spark):
    numbers = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (None,)], "number long")
    name = "tests.test_sources_sinks.service"
    parts = RC.fetch_parts(numbers, "number", name, RC.CHANGE_PARTS)
    runs = RC.fetch_parts(RC.head_shas(parts), "sha", name, RC.COMMIT_PARTS)
    linked = spark.createDataFrame([(1, 7)], "number long, linked_issue_number long")
    df = RC.assemble_changes(parts, runs, linked, "o/r", "2026-01-01")
    from gritstone.schema import RAW_ISSUE, RAW_PR

    kind = spark.createDataFrame([], RAW_PR).schema
    assert [(f.name, f.dataType) for f in df.drop("failed").schema] == [(f.name, f.dataType) for f in kind]
    got = {r.pr_number: r for r in df.collect()}
    assert set(got) == {1, 2} and len(got[1].files) == 205 and got[1].linked_issue_number == "7" and got[2].linked_issue_number is None
    assert (got[1].ci_conclusion, got[2].ci_conclusion) == ("failure", "mixed") and got[1].silent_reviewers == ["bob"] and got[2].silent_reviewers == ["ann", "bob"]
    assert got[2].failed == ["reviews"] and got[2].reviews == [] and got[1].failed == []
    issues = RC.assemble_issues(RC.fetch_parts(numbers, "number", name, RC.ISSUE_PARTS), "o/r", "2026-01-01")
    assert [(f.name, f.dataType) for f in issues.drop("failed").schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], RAW_ISSUE).schema]
    one = {r.issue_number: r for r in issues.collect()}
    assert set(one) == {1, 2} and sorted(one[1].linked_pr_numbers) == [7, 8] and one[1].label_names == ["bug"] and one[1].sub_issues == []


def test_chunks_survive_a_failure_between_data_and_manifest(spark, tmp_path):
    t = CH.ChunkedTable(spark, f"file://{tmp_path}/t", "key", spark.createDataFrame([], "key long, v string").schema)
    keys = spark.createDataFrame([(i,) for i in range(10)] + [(3,), (None,)], "key long")
    work = lambda k: k.where("key <> 5").withColumn("v", F.format_string("v%d", "key"))
    whole, t.mark = t.mark, lambda chunk, rows: whole(chunk, rows) if chunk < 1 else (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        t.run(keys, work, 3)
    assert sorted(r.key for r in t.rows().collect()) == [0, 1, 2] == sorted(r.key for r in t.done().collect())  # the second chunk's data is there, and isn't seen
    t.mark = whole
    assert t.run(keys, work, 3) == 3
    assert sorted(r.key for r in t.rows().collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert t.run(keys, work, 3) == 1 and t.rows().count() == 9  # a key without a row is tried again
    assert t.run(keys, lambda k: k.withColumn("v", F.lit("late")), 3) == 1 and t.run(keys, work, 3) == 0 and t.rows().count() == 10


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\nc"), (1, "a")], "k int, t string")
    p = str(tmp_path / "t")
    K.replace(df, p)
    K.replace(spark.read.parquet(p).where("k = 1"), p)
    assert [r.k for r in spark.read.parquet(p).collect()] == [1]
    assert K.count_delta(spark, p, lambda: K.append_batch(df, p, "parquet")) == (1, 3)
    assert [r.k for r in K.duplicates(spark.read.parquet(p), ["k"]).collect()] == [1]
    K.write_jsonl(df, str(tmp_path / "j"), ["k"], one_file=True)
    assert [r.k for r in spark.read.json(str(tmp_path / "j")).collect()] == [1, 2]
    K.write_csv(K.preview(df), str(tmp_path / "c"))
    assert "b c" in {r.t for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()}
    K.write_report(df.agg(F.count("*").alias("n")), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0]) == {"n": 2}
    K.load_rows(df, F.col("k") > 1, str(tmp_path / "ok"), str(tmp_path / "no"))
    assert spark.read.parquet(str(tmp_path / "no")).first().k == 1
    K.write_splits(df.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().split == "train"


def test_manifest_resumes_and_repairs(spark, tmp_path):
    m = K.Manifest(spark, str(tmp_path / "m"))
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key bigint")
    assert m.pending(keys(1, 2)).count() == 2
    m.commit(keys(1))
    m.commit(keys(3))
    assert [r.key for r in m.pending(keys(1, 2)).collect()] == [2]
    missing, ok = m.repair(keys(1))
    assert [r.key for r in missing.collect()] == [3] and [r.key for r in ok.collect()] == [1] and m.load().count() == 2
    m.repair(keys(1), apply=True)
    assert [r.key for r in m.load().collect()] == [1]
    e = K.checkpoint_entries(spark.createDataFrame([("1",), ("2.0",), ("[3, 4.0]",), ("x",), (None,)], "t string"), "t")
    assert sorted(r.key for r in e.collect()) == [1, 2, 3, 4]
    assert K.last_good(keys(), keys(5)).first().key == 5
    with pytest.raises(LookupError):
        K.last_good(keys(), keys())
