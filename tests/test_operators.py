"""Operators on literal rows: invariants, ties and quirks."""

import json
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone import schema
from gritstone.functions import diffs as D
from gritstone.functions.text import hash_percent
from gritstone.operators import datasets as DS
from gritstone.operators import feedback as FB
from gritstone.operators import graph as G
from gritstone.operators import issues as I
from gritstone.operators import labels as L
from gritstone.operators import metrics as M
from gritstone.operators import relational as R
from gritstone.operators import sampling as S


def _joined_rows(df):
    """Rows that the joins of ``df`` give when it runs."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        nodes, n = [df._jdf.queryExecution().executedPlan()], 0
        for p in nodes:
            nodes += [p.children().apply(i) for i in range(p.children().size())]
            if "Join" in p.nodeName():
                n += p.metrics().apply("numOutputRows").value()
        return n
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_dedup_latest_keeps_first_of_equal_versions(spark):
    df = spark.createDataFrame([(1, "b", 2, "x"), (1, "b", 1, "y"), (1, "a", 0, "z"), (2, None, 5, "w"), (None, "c", 1, "n")], "k int, v string, s int, t string")
    once = R.dedup_latest(df, "k", F.coalesce("v", F.lit("")), F.col("s"))
    assert sorted((r.k, r.t) for r in once.collect()) == [(1, "y"), (2, "w")]
    assert sorted(R.dedup_latest(once, "k", F.coalesce("v", F.lit("")), F.col("s")).collect()) == sorted(once.collect())


def test_rank_values(spark):
    values = [5.0, 1.0, 2.0, 2.0, 2.0, 9.0, 7.0, 3.0, 8.0, 4.0]
    r = R.rank_value(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v", {"p33": "floor(n * 0.33)", "p50": "floor(n / 2)", "p90": "floor(0.9 * (n - 1))"}).first()
    s = sorted(values)
    assert (r.n, r.p33, r.p50, r.p90, r["min"], r["max"]) == (10, s[3], s[5], s[8], 1.0, 9.0)
    line = R.summary_line(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (line.p50, line.p90) == (3, s[8])  # the rule's place is int(0.9 * (n - 1))


def test_positions_are_consecutive(spark):
    df = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "v int").repartition(5)
    assert sorted((r.position, r.v) for r in R.with_position(df, [F.col("v")]).collect()) == [(i, i) for i in range(1000)]


def test_upsert_and_insert(spark):
    t = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t2"), (None, "n", "t3")], "k int, v string, c string")
    s = spark.createDataFrame([(2, "B", "s2"), (3, "C", "s3")], "k int, v string, c string")
    assert sorted(map(str, R.upsert(t, s, ["k"], ["c"]).collect())) == sorted(map(str, spark.createDataFrame([(1, "a", "t1"), (None, "n", "t3"), (2, "B", "t2"), (3, "C", "s3")], t.schema).collect()))
    n = spark.createDataFrame([(3, "x", "2"), (3, "y", "1"), (1, "z", "0")], t.schema)
    assert [(r.k, r.v) for r in R.insert_new(t, n, ["k"], [F.col("c")]).collect()] == [(3, "y")]


@pytest.mark.parametrize("one_in", [1 << 14, 8, 1])
def test_order_statistics_of_groups_by_ranges(spark, monkeypatch, one_in):
    monkeypatch.setattr(R, "CUT_ONE_IN", one_in)
    monkeypatch.setattr(R, "RANGES", 16)
    rows = [("hot", (i * 7919) % 5003 / 4) for i in range(9000)] + [(f"g{i % 40}", float(i % 9)) for i in range(900)] + [(None, float(i)) for i in range(50)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {}
    for g in {g for g, v in rows if v is not None}:
        v = sorted(v for k, v in rows if k == g and v is not None)
        at = lambda q: v[int(q * (len(v) - 1))] + (v[min(len(v) - 1, int(q * (len(v) - 1)) + 1)] - v[int(q * (len(v) - 1))]) * (q * (len(v) - 1) % 1)  # noqa: B023, E731
        want[g] = (len(v), v[0], round(at(0.5), 6), round(at(0.9), 6), v[-1], v[len(v) // 3])
    p = {r.g: r for r in R.percentiles(df, "v", {"p50": 0.5, "p90": 0.9}, ["g"]).collect()}
    t = {r.g: r for r in R.rank_value(df, "v", {"third": "floor(n / 3)"}, ["g"]).collect()}
    assert {g: (r.n, r.min, round(r.p50, 6), round(r.p90, 6), r.max, t[g].third) for g, r in p.items()} == want
    if one_in == 8:  # the hot group is many ranges, of like size
        c = df.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("c"))
        plan = R._running_by(c, ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()
        assert "__range" in plan.split("windowspecdefinition", 1)[1]


def test_upsert_keeps_one_row_of_a_key(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, __row string, __hit int")
    s = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (1, None, None), (3, "x", 5), (3, "x", 5), (None, "n", 1), (None, "n", 1)], t.schema)
    got = sorted((tuple(r) for r in R.upsert(t, s, ["k"], ["__hit"], F.col("__hit")).collect()), key=str)
    assert got == sorted([(1, "new", 1), (2, "b", 1), (3, "x", 5), (None, "n", 1), (None, "n", 1)], key=str)


def test_helper_columns_leave_the_callers(spark):
    df = spark.createDataFrame([(1, 3, "r", "a", 7), (1, 5, "r", "z", 8), (2, 4, "r", "s", 9)], "k int, v int, __r string, __s string, __m int")
    for out in (R.top_per_group(df, ["k"], [F.col("v")], 5), S.balanced_sample(df, "v", "k", 5, 1), R.stop_at_budget(df, ["k"], ["v"], "v", 99), R.insert_new(df.limit(0), df, ["v"], [F.col("k")])):
        assert sorted(map(tuple, out.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    assert sorted(r.position for r in R.with_position(df, [F.col("v")]).where("__m > 0 and __s is not null").collect()) == [0, 1, 2]
    ab = df.withColumnsRenamed({"__r": "__a", "__s": "__z"})
    assert set(ab.columns) < set(R.first_last(ab, ["k"], ["v"], 1).columns)
    odd = df.select("k", F.col("v").alias("__before"), (F.col("v") + 1).alias("__island"), F.col("v").cast("timestamp").alias("__g"))
    assert {tuple(r) for r in R.merge_intervals(odd, ["k"], "__before", "__island").collect()} == {(1, 3, 6), (2, 4, 5)}
    assert {tuple(r) for r in R.max_gap(odd, ["k"], "__g").collect()} == {(1, 2.0, 2), (2, None, 1)}


def test_helper_columns_of_builders_leave_the_callers(spark, corpus):
    odd = spark.createDataFrame([(i, i % 3, i % 2, "x") for i in range(60)], "n int, c int, before int, __h string")
    want = {r.n: r.split for r in S.stratified_split(odd.withColumnRenamed("c", "stratum"), "n", "stratum", 3).collect()}
    assert {r.n: r.split for r in S.stratified_split(odd, "n", "c", 3).collect()} == want and len(want) == 60
    assert S.stratified_split(odd.withColumnsRenamed({"n": "k", "before": "s2"}), "k", "c", 3).columns == ["k", "c", "split"]
    v = spark.createDataFrame([("1", "a" * 40, "--- a\n+++ b", ["x"], ["x"], 5)], "id string, base_sha string, diff string, touched_files array<string>, allowed_edit_files array<string>, __twice int")
    assert DS.validation_errors(v).first()["__twice"] == 5
    labels = spark.createDataFrame([(1, "accepted", 7), (2, "too_short", 8), (3, None, 9)], "feedback_id int, qc_status string, __new int")
    new = spark.createDataFrame([(2, "accepted", 6), (1, "accepted", 5)], labels.schema)
    assert sorted(map(tuple, FB.replace_unaccepted(labels, new).collect()), key=str) == sorted([(1, "accepted", 7), (3, None, 9), (2, "accepted", 6), (1, "accepted", 5)], key=str)
    issues, prs = corpus
    p = I.enrich(issues, prs.withColumn("__first", F.lit(4)), I.issue_pr_edges(issues, prs))[1]
    assert {r["__first"] for r in p.collect()} == {4}


def test_budgets_and_windows(spark):
    df = spark.createDataFrame([("a", i, 4) for i in range(5)], "g string, o int, size int")
    assert [r.kept for r in R.clip_budget(df, ["g"], ["o"], "size", 10).orderBy("o").collect()] == [4, 4, 2]
    assert R.stop_at_budget(df, ["g"], ["o"], "size", 10).count() == 2
    assert R.first_last(df, ["g"], ["o"], 3).count() == 5
    inv = R.invert_map(spark.createDataFrame([(1, [7, 8], 0), (2, [8], 1)], "k int, items array<int>, s int"), "k", "items", "s", True)
    assert sorted((r.item, r.k) for r in inv.collect()) == [(7, 1), (8, 2)]


def test_splits(spark):
    df = spark.createDataFrame([(i, "big" if i < 100 else "one" if i == 100 else "two") for i in range(103)], "id int, s string")
    rows = S.stratified_split(df, "id", "s", 1).collect()
    c = Counter((r.s, r.split) for r in rows)
    assert len(rows) == 103 and c["big", "test"] == c["big", "val"] == 10 and c["one", "test"] == 1 and c["two", "test"] == c["two", "val"] == 1
    assert rows and sorted(rows) == sorted(S.stratified_split(df.repartition(7), "id", "s", 1).collect())
    assert S.balanced_sample(df, "id", "s", 5, 1).groupBy("s").count().agg(F.max("count")).first()[0] == 5
    assert S.scarcest_cap(df, "id", "s", 250, 1).count() == 3
    frac = S.hash_sample(df, "id", 0.5)
    assert frac.count() == df.where(hash_percent(F.col("id")) < 50).count()
    assert R.is_disjoint(frac, df.join(frac, "id", "left_anti"), "id")
    b = S.dominant_band(spark.createDataFrame([(1, "low"), (1, "High"), (2, "low"), (2, None)], "k int, b string"), "k", "b").collect()
    assert sorted((r.k, r.b) for r in b) == [(1, "high"), (2, "low")]


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "UNKNOWN"), ("c", "c")], "t string, p string")
    m = {r["class"]: r for r in M.class_metrics(df, "t", "p", ["a", "b", "c"]).collect()}
    assert (m["a"].precision, m["a"].recall, m["b"].precision, m["b"].recall, m["b"].support) == (1.0, 0.5, 0.5, 0.5, 2)
    call = "array<struct<tool_name: string, tool_input: string>>"
    t = spark.createDataFrame([
        ([("a", "1"), ("b", None)], [("a", "1"), ("b", "9")]), ([("a", None), ("a", None)], [("a", "1")]), ([("a", "1"), ("b", "2")], [("b", "2"), ("a", "1"), ("c", "3")]), ([("a", "1")], []),
    ], f"r {call}, g {call}")
    r, g = F.col("r"), F.col("g")
    got = t.select(M.trajectory_exact(r, g), M.trajectory_in_order(r, g), M.trajectory_any_order(r, g), M.trajectory_precision(r, g), M.trajectory_recall(r, g)).collect()
    assert [tuple(x) for x in got] == [(1, 1, 1, 1, 1), (0, 1, 0, 1, 0.5), (0, 0, 1, pytest.approx(2 / 3), 1), (0, 1, 0, 0, 0)]
    ev = spark.createDataFrame([([(([("hi", None), (None, ("tool", "{}"))],),), (([("bye", None)],),), (([],),)],)], "e array<struct<content: struct<parts: array<struct<text: string, function_call: struct<name: string, args: string>>>>>>")
    assert ev.select(M.final_response(F.col("e"))).first()[0] == "bye" and ev.select(M.tool_calls(F.col("e"))).first()[0][0].tool_name == "tool"
    assert spark.range(1).select(M.judge_scores(F.lit('{"x": 9, "y": 0}'), ("x", "y"))).first()[0] == 3.0
    judged = {'{"x": 5}': 4.0, '```json\n{"x": 4.9, "y": 1}\n```': 2.5, "{}": 3.0, '{"x": null, "y": 5}': None, '{"x": "good", "y": 5}': None, "none": None, "": None}
    rows = spark.createDataFrame([(k, v) for k, v in judged.items()] + [(None, None)], "raw string, want double").withColumn("got", M.judge_scores(F.col("raw"), ("x", "y")))
    assert [(r.raw, r.got) for r in rows.collect()] == [(r.raw, r.want) for r in rows.collect()]
    e = F.array().cast("array<string>")
    assert spark.range(1).select(M.scope_compliance(e, e)).first()[0] == 1.0 and spark.range(1).select(M.file_recall(e, e)).first()[0] is None


def test_vectors_and_confidence(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id int, embedding array<double>")
    top = G.vector_topk(v.where("vec_id = 1").select(F.col("vec_id").alias("qid"), "embedding"), v, 2).collect()
    assert [(r.vid, r.rank) for r in sorted(top, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    c = lambda s, w: spark.range(1).select(G.retrieval_confidence(F.array(*map(F.lit, s)).cast("array<double>"), F.array(*map(F.lit, w)).cast("array<double>"))).first()[0]
    assert c([], []).bucket == "LOW" and c([], []).entropy_norm == 1.0
    assert c([0.9], [2.0]).entropy_norm == 0.0 and c([0.9, 0.9, 0.9], [2.0]).bucket == "HIGH"
    f = G.friction(spark.createDataFrame([("1", "x" * 30), ("2", "short"), ("3", "y" * 30)], "id string, body string"), spark.createDataFrame([("1", "f"), ("2", "f"), ("3", "f")], "review string, filename string"))
    assert f.first().friction == "x" * 30


def issue(n, created, closed=None, body="", timeline=(), comments=(), linked=(), user=None, labels=()):
    return json.dumps({"issue_number": n, "repo": "r", "extracted_at": "1", "linked_pr_numbers": list(linked), "timeline": list(timeline), "comments": list(comments), "issue": {"number": n, "title": f"t{n}", "body": body, "state": "closed" if closed else "open", "created_at": created, "closed_at": closed, "user": user, "labels": [{"name": x} for x in labels], "assignees": []}})


def pull(n, created, linked=None, **more):
    head = {"number": n, "title": f"p{n}", "created_at": created, "state": "closed"} | more.pop("pr", {})
    return json.dumps({"pr_number": n, "repo": "r", "extracted_at": "1", "linked_issue_number": linked, "pr": head} | more)


def frame(spark, rows, ddl):
    return spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", ddl).alias("x")).select("x.*")


@pytest.fixture(scope="module")
def corpus(spark):
    say = lambda t, b="x": {"body": b, "created_at": t, "user": {"login": "u"}}
    issues = frame(spark, [
        issue(1, "2024-01-01T00:00:00Z", "2024-01-15T00:00:00Z", "- [ ] a", [{"event": "assigned", "created_at": "2024-01-02T00:00:00Z"}, {"event": "unassigned", "created_at": "2024-01-03T00:00:00Z"}, {"event": "odd", "created_at": None}, {"event": "odd", "created_at": "2024-01-02T00:00:00Z"}], [say("2024-01-05T00:00:00Z"), say("2024-02-05T00:00:00Z", "fixes #12"), say(None)], [12]),
        issue(2, "2024-01-01T00:00:00Z", body="see", user={"login": "x[bot]", "type": "User"}, labels=("bug", "")),
        issue(3, None),
    ], schema.RAW_ISSUE)
    review = {"id": 5, "state": "CHANGES_REQUESTED", "body": "please change this and that", "submitted_at": "2024-01-12T00:00:00Z", "user": {"login": "r"}}
    patch = "@@ -1,2 +1,2 @@\n a\n-b\n+c"
    prs = frame(spark, [
        pull(11, "2024-01-02T00:00:00Z", "1", reviews=[review], check_runs=[{"conclusion": "failure"}], pr={"base": {"sha": "s"}}, files=[{"filename": "x.py", "status": "modified", "patch": patch, "additions": 1, "deletions": 1}]),
        pull(12, "2024-01-03T00:00:00Z", "None", pr={"body": "Closes: #2, fixes #99", "merged_at": "2024-01-05T00:00:00Z"}, files=[{"filename": "./.x/y.py", "patch": patch}], check_runs=[{"conclusion": "success"}, {"conclusion": None}]),
        pull(13, "2024-01-03T00:00:00Z", None, silent_reviewers=["q"], files=None),
    ], schema.RAW_PR)
    return issues, prs


def test_clean_and_link(spark, corpus):
    issues, prs = corpus
    assert [r.login for r in I.bot_report(issues, F.col("issue.user")).collect()] == ["x[bot]"]
    assert {r.pr_number: r.c for r in prs.select("pr_number", I.ci_conclusion(F.col("check_runs")).alias("c")).collect()} == {11: "failure", 12: "success", 13: "none"}
    edges = I.issue_pr_edges(issues, prs)
    assert {(r.issue, r.pr, r.source) for r in edges.collect()} == {(1, 11, 1), (1, 12, 2), (2, 12, 3), (1, 12, 5)}
    i, p = I.enrich(issues, prs, edges)
    assert {r.issue_number: r.resolved_by_prs for r in i.collect()} == {1: [11, 12], 2: [12], 3: []}
    assert {r.pr_number: (r.linked_issue_number, r.linked_issue_numbers) for r in p.collect()} == {11: (1, [1]), 12: (1, [1, 2]), 13: (None, [])}
    s = I.link_statistics(i, p).first()
    assert s.with_pr + s.without_pr == s.issues == 3 and s.linked + s.standalone == s.prs == 3 and s.ci_none + s.ci_success + s.ci_failure + s.ci_mixed == 3
    flat = {r.issue_number: r for r in I.flatten_issues(issues).collect()}
    assert flat[1].days_open == 14 and flat[2].labels == ["bug"] and flat[3].created_at is None
    assert I.flatten_prs(prs).where("pr_number = 12").first().days_to_merge == 2
    assert I.feature_row(issues).where("issue_number = 1").first().hours_to_first_comment == 96


def test_snapshots_and_scores(spark, corpus):
    issues, prs = corpus
    tiers = lambda **k: {(r.issue_number, r.days_open) for r in I.snapshots(issues, (7, 14, 28), **k).collect()}
    assert tiers(gate="strict") == {(1, 7), (2, 7), (2, 14), (2, 28)}
    assert tiers(gate="inclusive") == {(1, 7), (1, 14), (2, 7), (2, 14), (2, 28)}
    assert tiers(gate="closed") == {(1, 7), (1, 14), (1, 28)}
    s = I.snapshots(issues, (14,), gate="inclusive")
    one = s.where("issue_number = 1").first()
    assert one.issue.state == "open" and one.issue.closed_at is None and len(one.comments) == 1 and [e.event for e in one.timeline] == ["assigned", "unassigned", "odd"]
    assert len(I.snapshots(issues, (14,), gate="inclusive", batch_form=True).where("issue_number = 1").first().timeline) == 3
    linked = I.attach_prs(s, prs)
    r = I.programmatic_score(linked).where("issue_number = 1").first()
    fired = {k: v for k, v in r.asDict().items() if k.startswith("sig_") and v}
    assert fired == {"sig_resolution_days": pytest.approx(0.2545), "sig_first_review": 0.15, "sig_closed_unmerged": 0.15, "sig_assignee_change": 0.10, "sig_sub_issues": 0.05, "sig_ci_failed": 0.15}
    assert r.prog_score == pytest.approx(sum(fired.values()), abs=1e-4)
    b = I.batch_score(s, prs).where("issue_number = 1").first()
    assert 0 < b.prog_score <= 1
    assert [r.b for r in spark.createDataFrame([(0.34,), (0.35,), (0.65,)], "s double").select(I.band_fixed(F.col("s")).alias("b")).collect()] == ["low", "medium", "high"]


def test_labels(spark, corpus):
    issues, prs = corpus
    s = I.attach_prs(I.snapshots(issues, (14,), gate="inclusive"), prs)
    answers = spark.createDataFrame([(1, "T+14", "scorer", "ADJUSTMENT: 0.2\nREASON: slow"), (1, "T+14", "reasoner", "it is slow"), (1, "T+14", "critic", '{"verdict": "ACCEPT"}')], schema.TEACHER)
    full = L.scorer_labels(s, answers, 1.0).where("issue_number = 1").first()
    assert full.label.label_source == "hybrid" and full.label.score == pytest.approx(full.label.programmatic_score + 0.08, abs=2e-4)
    assert L.scorer_labels(s, answers, 0.0).where("label.label_source = 'hybrid'").count() == 0
    assert L.planner_labels(s).first().label.files == ["x.py"] and L.patcher_labels(s).first().label.additions == 1
    assert L.critic_labels(s, answers).first().label.verdict == "REVISE"
    assert L.build_labels("reasoner", s, answers).first().label.narrative == "it is slow"
    done = L.build_labels("scorer", s, answers)
    assert L.build_labels("scorer", s, answers, done).count() == 0 and L.label_statistics(done).first().n == done.count()
    with pytest.raises(ValueError):
        L.build_labels("nobody", s, answers)
    pr = "struct<merged_at: string, state: string>"
    rv = "array<struct<state: string>>"
    rows = spark.createDataFrame([((None, "open"), [("CHANGES_REQUESTED",)]), ((None, "closed"), [("CHANGES_REQUESTED",)]), (("x", "closed"), [("APPROVED",)]), ((None, "open"), [("DISMISSED",)]), ((None, "open"), None)], f"p {pr}, r {rv}")
    assert [r.v for r in rows.select(L.review_verdict(F.col("p"), F.col("r")).alias("v")).collect()] == ["REJECT", "REVISE", "ACCEPT", "REVISE", None]
    assert L.cost_estimate(s).count() == 5


def test_graph_and_datasets(spark, corpus):
    issues, prs = corpus
    i, p = I.enrich(issues, prs, I.issue_pr_edges(issues, prs))
    nodes, resolved = G.issue_graph(i)
    pr_nodes, touches = G.pr_graph(p)
    reviews, reviewed, applies = G.review_graph(p)
    assert {r.id for r in reviews.collect()} == {"5_review"} and applies.count() == 0 and reviewed.count() == 1
    assert {r.number: sorted(r.files) for r in G.yes_samples(nodes, resolved, pr_nodes, touches).collect()} == {1: ["./.x/y.py", "x.py"], 2: ["./.x/y.py"]}
    assert [r.number for r in G.no_samples(nodes, resolved).collect()] == [3]
    blobs = spark.createDataFrame([("s", "x.py", "a\nb\n")], "sha string, path string, text string")
    out = DS.patcher_examples(prs, blobs).collect()
    assert len(out) == 1 and out[0].path == "x.py" and out[0].input.endswith("     3|")
    reasons = prs.select("pr_number", DS.drop_reason(F.col("files"), F.col("pr.additions")).alias("reason"))
    assert {r.pr_number: r.reason for r in reasons.collect()} == {11: None, 12: None, 13: "no_files_json"}
    assert DS.drop_report(reasons).first().n == 1
    c = DS.critic_examples(prs).collect()
    assert Counter(r.label for r in c) == {"REJECT": 1, "ACCEPT": 1}
    ranked = spark.createDataFrame([(1, "x.py", 1)], "qid long, filename string, rank int")
    conf = spark.createDataFrame([(1,)], "qid long").select("qid", F.struct(F.lit("HIGH").alias("bucket")).alias("confidence"))
    ex = DS.planner_examples(G.yes_samples(nodes, resolved, pr_nodes, touches), G.no_samples(nodes, resolved), ranked, conf)
    assert {r.label for r in ex.collect()} <= {"YES", "NO"} and DS.coverage(ex).count() >= 1
    assert [r.x for r in spark.createDataFrame([("a/tests/x.py",), ("a/conftest.py",), ("a/x.py",)], "p string").select(DS.is_test_path(F.col("p")).alias("x")).collect()] == [True, True, False]
    v = spark.createDataFrame([("1", "a" * 40, "--- a\n+++ b", ["x"], ["x"]), ("2", "z", "no", ["y"], ["x"]), ("2", "z", "no", ["y"], [])], "id string, base_sha string, diff string, touched_files array<string>, allowed_edit_files array<string>")
    e = {r.id: set(r.errors) for r in DS.validation_errors(v).where("size(allowed_edit_files) = 1").collect()}
    assert e == {"1": set(), "2": {"duplicate_id", "bad_sha", "not_unified", "touched_outside_allowed"}}


def test_feedback(spark):
    m = spark.createDataFrame([("t", "1.1", 0, "hi", None), ("t", "1.9", 1, "yo", None), ("t", "2.0", 2, "bot says", "B"), ("t", "3.0", 3, "again", "B"), ("u", "1.0", 0, "only bot", "B")], "thread string, ts string, seq int, text string, bot_id string")
    got = FB.prompt_and_rejected(m, spark.createDataFrame([("t", "3.0"), ("u", "1.0")], "thread string, ts string")).collect()
    assert [(r.prompt_text, r.rejected_text) for r in got] == [("yo", "again")]
    ev = spark.sql("select * from values (1L, timestamp'2024-01-01 10:00:00', 'p', 'bad'), (2L, timestamp'2024-01-08 23:00:00', 'q', 'same text'), (3L, timestamp'2024-01-09 00:00:00', 'r', 'x') t(id, created_at, prompt_text, rejected_text)")
    ans = spark.createDataFrame([(1, "CHOSEN: a good answer"), (2, "CHOSEN: same text"), (3, "CHOSEN: no")], "id long, raw string")
    lab = FB.teacher_labels(ev, ans, "m", "r")
    assert {r.feedback_id: r.qc_status for r in lab.collect()} == {1: "accepted", 2: "identical", 3: "too_short"}
    assert [r.id for r in FB.unlabelled(ev, lab, "2024-01-01", "2024-01-08").collect()] == [2]
    new = lab.where("feedback_id = 2").withColumn("qc_status", F.lit("accepted"))
    assert Counter(r.qc_status for r in FB.replace_unaccepted(lab, new).collect()) == {"accepted": 2, "too_short": 1}
    rows = FB.preference_rows(ev, lab.withColumns({"id": F.col("feedback_id"), "labeled_at": F.col("feedback_id")}))
    assert [(r.prompt, r.chosen) for r in rows.collect()] == [("p", "a good answer")]
    assert FB.run_record(rows, "x", "2024-01-01", "2024-01-07", "ok").first().row_count == 1


def test_keyword_rank_and_tests(spark):
    idx = spark.createDataFrame([("core/dag.py", ["DagBag"], ["parse_dag"]), ("core/x.py", [], ["other"]), ("tests/test_dag.py", None, None)], "path string, classes array<string>, functions array<string>")
    words = spark.createDataFrame([(1, ["dag", "bag"])], "qid int, words array<string>")
    assert [(r.path, r.score) for r in G.keyword_rank(idx, words, noisy="^tests/").collect()] == [("core/dag.py", 2 + 1 + 1 + 1)]
    with pytest.raises(ValueError):
        G._bounded(words, 0)
    near = G.nearest_tests(idx.where("path = 'core/dag.py'"), spark.createDataFrame([("tests/test_dag.py",), ("core/test_z.py",), ("tests/q.py",)], "path string")).collect()
    assert [(r.path, r.score) for r in sorted(near, key=lambda r: r["rank"])] == [("core/test_z.py", 3), ("tests/test_dag.py", 2)]
    s = "array<struct<lo: int, hi: int, name: string>>"
    df = spark.createDataFrame([([(i * 10, i * 10 + 5, str(i)) for i in range(9)], [(41, 42)])], f"s {s}, r array<struct<lo: int, hi: int>>")
    assert [x.name for x in df.select(G.context_symbols(F.col("s"), F.col("r"))).first()[0]] == ["4", "0", "1", "2", "3", "5"]
    al = G.first_alias_in_index(spark.createDataFrame([(1, ["a", "core/x.py", "core/dag.py"])], "id int, aliases array<string>"), idx)
    assert al.first().path == "core/x.py"


def test_vector_topk_runs_in_blocks(spark):
    from gritstone.operators import graph

    v = spark.createDataFrame([(i, [float(i % 7), float(i % 11) + 1.0, 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    q = v.withColumnRenamed("vec_id", "qid")
    with pytest.raises(ValueError):
        graph.vector_topk(q, v, 3, most=40)
    rows = lambda df: sorted((r.qid, r.vid, r.score, r["rank"]) for r in df.collect())
    assert rows(graph.vector_topk_in_blocks(q, v, 3, most=40)) == rows(graph.vector_topk(q, v, 3))


def test_registered_topk_has_no_cap(spark, tmp_path):
    from gritstone.plans import catalog

    e = spark.range(0, 200_060, 20).selectExpr("id as vec_id", "array(1.0D, cast(id as double)) as embedding")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog.QUERIES["vector_topk"](spark, str(tmp_path)).columns == ["qid", "vid", "score", "rank"]


def test_asof_attach_with_nulls_and_repeated_rows(spark):
    from pyspark.sql import functions as F

    from gritstone.operators import relational as R

    left = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "x", 1), (None, "y", 9)], "k int, note string, cut int")
    right = spark.createDataFrame([(1, 4, 10), (1, 6, 11), (2, 3, 12), (None, 1, 13)], "k int, t int, item int")
    got = R.asof_attach(left, right, ["k"], F.col("t") <= F.col("cut"), F.col("item"), "seen").collect()
    assert sorted((str(r.k), r.note or "", r.seen) for r in got) == [("1", "", [10]), ("1", "", [10]), ("2", "x", []), ("None", "y", [])]


def test_stratified_split_keeps_null_keys(spark):
    from gritstone.operators import sampling as S

    df = spark.createDataFrame([(None, "a"), (1, "a"), (2, "a")], "id int, s string")
    assert S.stratified_split(df, "id", "s", 1).count() == 3


def test_vector_topk_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    vs = [(i, [float(rnd.randint(-2, 2)) for _ in range(3)]) for i in range(80)] + [(90, None), (91, []), (92, [0.0] * 3), (93, [1.0, None, 2.0]), (94, [float("nan"), 1.0, 1.0]), (95, [1.0, 1.0])]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>").repartition(3)
    ok = {i: v for i, v in vs if v and None not in v and any(v) and not any(x != x for x in v)}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    want = set()
    for q, a in ok.items():
        near = sorted((-round(cosine(a, b), 6), i) for i, b in ok.items() if len(a) == len(b))[:4]
        want |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(near)}
    got = {(r.qid, r.vid, round(r.score, 6), r["rank"]) for r in G.vector_topk(df.withColumnRenamed("vec_id", "qid"), df, 4).collect()}
    assert got == want
    edges = G.similar_edges(df.where("vec_id < 5"), df, 2).collect()
    assert all(e.src != e.dst for e in edges) and {e["rank"] for e in edges} == {1, 2}


def test_nearest_tests_meet_few_rows_of_a_large_directory(spark):
    src = [(f"d{i % 2}/m{i}.py",) for i in range(0, 60, 3)] + [("e/m1.py",), ("none/x.py",)]
    tests = [(f"d{i % 2}/test_m{i}.py",) for i in range(60)] + [(f"d0/m{i}_test.{e}",) for i in range(0, 12, 6) for e in ("py", "js", "ts", "go", "rb")] + [(f"z{i}/test_m1.py",) for i in range(20)]
    cut = lambda p: (p.rpartition("/")[0], re.sub("^test_|_test$", "", p.rpartition("/")[2].rpartition(".")[0]))
    want = set()
    for (s,) in src:
        hits = sorted((-(3 * (cut(s)[0] == cut(t)[0]) + 2 * (cut(s)[1] == cut(t)[1])), t) for (t,) in tests)
        want |= {(s, t, -w, n + 1) for n, (w, t) in enumerate(hits[:8]) if w}
    df = lambda rows: spark.createDataFrame(rows, "path string").repartition(3)
    near = G.nearest_tests(df(src), df(tests + tests[:5]))
    assert {tuple(r) for r in near.select("source", "path", "score", "rank").collect()} == want
    # 2,000 sources and 2,000 tests in one directory: a source meets k rows, not all
    one = spark.range(2000).select(F.format_string("d/m%04d.py", "id").alias("path"))
    big = G.nearest_tests(one, spark.range(2000).select(F.format_string("d/test_m%04d.py", "id").alias("path")))
    assert _joined_rows(big) < 100_000 and big.count() == 16_000


def test_vector_topk_in_small_pieces(spark, monkeypatch):
    """Pieces of 7 vectors and 3 queries give what one piece gives, ties by id."""
    v = [[float((i * 7) % 5 - 2), float((i * 3) % 7 - 3), 1.0] for i in range(60)]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id int, embedding array<double>").repartition(2)
    ask = lambda: sorted(map(tuple, G.vector_topk(df.withColumnRenamed("vec_id", "qid"), df, 4).collect()))
    whole = ask()
    monkeypatch.setattr(G, "ROWS", 7)
    monkeypatch.setattr(G, "SCORES", 21)
    assert ask() == whole and len(whole) == 240


def test_code_spans_of_many_queries(spark):
    names = ["RedBolt", "red ring", "ringer", "étéÉté x", "bolt", "a_ring9bolt", None]
    rows = [(f"d/{'ring' if i % 7 == 0 else ''}{i}.py", [(names[i % 7], "t", i % 5, i)] * (1 + (i == 3))) for i in range(300)]
    said = ["ring", "(bolt) red x1 Ring.", "étéété", "zzzz", None, "ingers inge"]
    issues = [(i, said[i % 6]) for i in range(12_000)]
    index = spark.createDataFrame(rows, "path string, symbols array<struct<name: string, type: string, start_line: int, end_line: int>>")
    got = G.code_spans(index, spark.createDataFrame(issues, "qid int, text string"), 4).where("qid < 6 or qid > 11993").collect()
    want = set()
    for i, text in issues[:6] + issues[-6:]:
        words = {w for w in (x.strip(".()") for x in (text or "").lower().split()) if len(w) > 3 and w.isalpha()}
        hits = {(p, s[0][2], s[0][0] or "") for p, s in rows if any(w in (s[0][0] or "").lower() or w in p.partition("/")[2] for w in words)}
        want |= {(i, *h, n + 1) for n, h in enumerate(sorted(hits)[:4])}
    assert {(r.qid, r.path, r.start_line, r.symbol or "", r["rank"]) for r in got} == want and len(got) == len(want)


def test_keyword_rank_of_many_queries(spark):
    rows = [(f"src/{'ring' if i % 11 == 0 else 'x'}{i * 37 % 300:03d}.py", [["Red Bolt", "hot ring", "ring"][i % 3]], None if i % 4 else ["BOLT", "e"]) for i in range(300)]
    asks = [["ring", "bolt"], ["bolt", "bolt", "e"], [""], ["zz"], None, ["red", None, "ring"], []]
    queries = [(i, asks[i % 7]) for i in range(12_000)]
    index = spark.createDataFrame([*rows, (None, ["ring bolt"], None)], "path string, classes array<string>, functions array<string>")
    got = G.keyword_rank(index, spark.createDataFrame(queries, "qid int, words array<string>"), 5, "/x00").where("qid < 7 or qid > 11992").collect()
    want = set()
    for q, words in queries[:7] + queries[-7:]:
        score = lambda p, c, f: sum(2 * (w in p) + sum(w in s.lower() for s in c + (f or [])) for w in words or [] if w is not None)  # noqa: E731, B023
        hits = sorted((-score(*r), r[0]) for r in rows if "/x00" not in r[0])
        want |= {(q, p, -s, n + 1) for n, (s, p) in enumerate(hits[:5]) if s}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    every = G.keyword_rank(index, spark.createDataFrame([(1, ["ring", "bolt"])], "qid int, words array<string>"), 500)
    assert every.where("path is null").count() == 1


def test_text_vectors(spark):
    rows = [("Fix the scheduler", "it hangs"), ("fix THE scheduler", "it; hangs"), (None, None), ("other words", "here")]
    v = [r[0] for r in spark.createDataFrame(rows, "t string, b string").select(G.text_vector(F.col("t"), F.col("b"), 16)).collect()]
    assert v[0] == v[1] and v[2] is None and len(v[3]) == 16
    assert abs(sum(x * x for x in v[3]) - 1) < 1e-9


def test_code_spans(spark):
    sym = "path string, symbols array<struct<name: string, type: string, start_line: int, end_line: int>>"
    index = spark.createDataFrame([("core/dag.py", [("DagRun", "class", 5, 9), ("helper", "function", 1, 2)]), ("ui/scheduler.ts", [("x", "function", 1, 1)]), ("e.py", None)], sym)
    got = G.code_spans(index, spark.createDataFrame([(1, "The Scheduler, (dagrun) a2b dag"), (2, None)], "qid int, text string")).collect()
    assert sorted((r.qid, r.path, r.symbol, r["rank"]) for r in got) == [(1, "core/dag.py", "DagRun", 1), (1, "ui/scheduler.ts", "x", 2)]
    counted = G.symbol_counts(spark.createDataFrame([("a", ["A"], ["f", "g"]), ("b", None, [])], "path string, classes array<string>, functions array<string>")).first()
    assert tuple(counted) == (1, 2, 2)


def test_reasoner_texts(spark):
    row = (1, [("labeled",), ("closed",), (None,), ("assigned",)], [(7, [("APPROVED", " good work ", ("ann",)), ("COMMENTED", "  ", ("bob",))], [("see this line", "a.py", 0, 12, None)]), (None, None, None)])
    ddl = """k int, timeline array<struct<event: string>>, prs array<struct<pr_number: bigint, reviews: array<struct<state: string, body: string, user: struct<login: string>>>,
        review_comments: array<struct<body: string, path: string, line: bigint, original_line: bigint, user: struct<login: string>>>>>"""
    r = spark.createDataFrame([row, (2, None, None)], ddl).select("k", L.reasoner_timeline(F.col("timeline")).event.alias("e"), L.review_text(F.col("prs")).alias("t")).orderBy("k").collect()
    assert r[0].e == ["labeled", "assigned"] and r[1].e == []
    assert r[0].t.reviews == "[PR #7 \u2014 APPROVED by ann]: good work" and r[0].t.inline == "[? on a.py:12]: see this line"
    assert tuple(r[1].t) == ("", "")


def test_strict_critic_labels(spark):
    def pr(n, merged=None, reviews=(), notes=(), runs=(), patch="+x", files=1):
        return (n, {"merged_at": merged}, [{"filename": f"f{i}.py", "patch": patch} for i in range(files)], [{"state": s, "body": b} for s, b in reviews], [{"body": b, "diff_hunk": "@@"} for b in notes], [{"name": a, "conclusion": c} for a, c in runs])

    long_ = "this needs a good deal of rework"
    rows = [
        pr(1, None, [("CHANGES_REQUESTED", long_)], ["an inline note that is long enough"]), pr(2, "t", [("CHANGES_REQUESTED", long_)], ["an inline note that is long enough"]),
        pr(3, "t"), pr(4, "t", [("APPROVED", "LGTM"), ("APPROVED", "very well tested, thanks")], files=2), pr(5, "t", runs=[("Unit Tests", "failure")]), pr(6, "t", runs=[("labeler", "failure")]),
        pr(7, None, [("CHANGES_REQUESTED", "   " + "x" * 18 + "    ")]), pr(8, "t", notes=["```suggestion\nsome long suggested line"]), pr(9, "t", patch=None), (10, None, None, None, None, None),
    ]
    ddl = """pr_number bigint, pr struct<merged_at: string>, files array<struct<filename: string, patch: string>>, reviews array<struct<state: string, body: string>>,
        review_comments array<struct<body: string, diff_hunk: string>>, check_runs array<struct<name: string, conclusion: string>>"""
    got = {r.pr_number: (r.label, r.reasoning) for r in DS.strict_critic_label(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {
        1: ("REJECT", long_), 2: ("REVISE", "an inline note that is long enough"), 3: ("ACCEPT", DS.NO_FINDINGS["one"]), 4: ("ACCEPT", "very well tested, thanks"), 5: (None, None),
        6: ("ACCEPT", DS.NO_FINDINGS["one"]), 7: (None, None), 8: (None, None), 9: (None, None), 10: (None, None),
    }
    pools = DS.pooled([spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(3,)], "k int")], "k", 1)
    assert sorted(r.k for r in pools.collect()) == [1, 2, 3]


def test_checkpoints_loads_and_bootstrap(spark, tmp_path):
    from gritstone.sources import readers, sinks

    at = f"{tmp_path}/cp"
    assert sinks.load_checkpoint(spark, at, "n int") is None
    sinks.save_checkpoint(spark.createDataFrame([(1,), (2,)], "n int"), at)
    sinks.save_checkpoint(spark.createDataFrame([(3,)], "n int"), at)
    assert [r.n for r in sinks.load_checkpoint(spark, at, "n int").collect()] == [3]
    sinks.clear_checkpoint(spark, at)
    sinks.clear_checkpoint(spark, at)
    assert sinks.load_checkpoint(spark, at, "n int") is None
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    with pytest.raises(ValueError):
        sinks.load_strict(df, F.col("s") != "", f"{tmp_path}/t")
    sinks.load_strict(df, F.col("n") > 0, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    assert sinks.bootstrap(spark, "create or replace temp view boot_a as select ';' as x;\n\ncreate or replace temp view boot_b as select 2 as y;") == 2
    assert spark.table("boot_a").first().x == ";"
    index = spark.createDataFrame([("a", ["A"], None), ("b", [], []), ("c", None, ["f"])], "path string, classes array<string>, functions array<string>")
    sinks.write_symbol_index(index, f"{tmp_path}/index")
    assert sorted(r.path for r in spark.read.schema("path string").json(f"{tmp_path}/index").collect()) == ["a", "c"]
    items = spark.createDataFrame([(1, "2020-01-01"), (2, "2021-01-01"), (3, "2018-01-01"), (4, "2022-01-01"), (None, "2023-01-01")], "number int, day string").withColumn("created_at", F.col("day").cast("timestamp_ntz"))
    got = readers.discover_new(items, spark.createDataFrame([(4,)], "number int"), "number", "created_at", "2019-01-01", 1)
    assert [r.number for r in got.collect()] == [2]
    assert readers.one_record(items, "number", 3).first().day == "2018-01-01"


def test_a_patch_meets_its_text_once(spark, corpus):
    prs = corpus[1]
    blobs = spark.createDataFrame([("a" * 40, "x.py", "a\nb")], "sha string, path string, text string")
    plan = DS.patcher_examples(prs, blobs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("_udf(") <= 2  # called once, its result used once
    rows = [("a", "@@ -1 +1 @@\n-a\n+def (", True), ("a", "@@ -1 +1 @@\n-a\n+def (", False), ("a", "@@ -1 +1 @@\n-b\n+c", False), (None, "x", True), ("a", "@@ -1 +1 @@\n-a\n+b = 1", True)]
    df = spark.createDataFrame(rows, "b string, p string, python boolean")
    assert [r.x for r in df.select(D.fits_udf("b", "p", "python").alias("x")).collect()] == [False, True, False, False, True]
    names = ["A.PY", "x.pyc", "Dockerfile", "a/Doc\u212aerfile", "x.md\n", "py", None, "Makefile", "b.Toml"]
    allowed = spark.createDataFrame([(n,) for n in names], "n string").select(DS.allowed_path(F.col("n")).alias("x")).collect()
    assert [r.x for r in allowed] == [True, False, True, True, True, False, False, False, True]


def test_changes_go_to_their_issue_once(spark, corpus):
    issues, prs = corpus
    s = I.snapshots(issues, (7, 14, 28))
    few = I.attach_prs(s, prs, ("files",))
    moves = [x for x in few._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert not any("snapshot_tier" in x for x in moves) and "reviews" not in few.select("linked_prs").schema.simpleString()
    every = I.attach_prs(s, prs)
    assert "reviews" in every.select("linked_prs").schema.simpleString()
    ids = lambda df: {(r.issue_number, r.snapshot_tier): [p.pr_number for p in r.linked_prs] for r in df.collect()}
    assert ids(few) == ids(every)
    for r in every.collect():
        assert all(p.pr.created_at <= r.snapshot_date.isoformat() for p in r.linked_prs)
    row = lambda df: [tuple(r) for r in df.select("issue_number", "label").orderBy("issue_number", "snapshot_tier").collect()]
    assert row(L.patcher_labels(few)) == row(L.patcher_labels(every))
    assert row(L.planner_labels(I.attach_prs(s, prs, L.PARTS["planner"]))) == row(L.planner_labels(every))


def test_links_do_not_need_the_lines_of_changes(spark):
    from gritstone.plans import activity as A

    d = "/root/testdata/sf0.001"
    e = A.edges(spark, d)
    assert "l_orderkey" not in e._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: Counter(tuple(r) for r in df.select("issue", "pr", "source").collect())
    assert rows(e) == rows(I.issue_pr_edges(A.issues(spark, d), A.changes(spark, d)))


def test_scarcest_cap_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def label(i):
        made.add(1)
        return "a" if i % 10 == 0 else "b"

    df = spark.range(100).select("id", label("id").alias("label"))
    got = S.scarcest_cap(df, "id", "label", 50, 1)
    assert Counter(r.label for r in got.collect()) == {"a": 10, "b": 10} and made.value <= 100
    plain = S.balanced_sample(df, "id", "label", 10, 1)
    assert {r.id for r in got.collect()} == {r.id for r in plain.collect()}
    assert Counter(r.label for r in S.scarcest_cap(df, "id", "label", 4, 1).collect()) == {"a": 4, "b": 4}
    assert S.scarcest_cap(df.where("id < 0"), "id", "label", 4, 1).count() == 0


def test_words_are_counted_in_bounded_pieces():
    from gritstone.operators.vector_index import _pieces

    sizes = np.array([5, 5, 0, 30, 1, 1, 1, 1, 0, 0])
    got = list(_pieces(sizes, 3, 10))
    assert [x for a, n in got for x in range(a, a + n)] == list(range(len(sizes)))
    assert all(n <= 3 and (n == 1 or sizes[a : a + n].sum() <= 10) for a, n in got)
    assert list(_pieces(np.array([], int), 3, 10)) == []
