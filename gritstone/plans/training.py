"""Queries on labels and training sets: an order is a change, its lines are files, reviews, notes, checks and commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets as DS
from ..operators import graph as G
from ..operators import issues as I
from ..operators import labels as L
from ..operators import relational as R
from ..operators import sampling as S
from .activity import TIERS, _iso, _text, issues
from .activity import changes as plain_changes
from .catalog import SQL, _t, query

#: What a line says, in both dialects: its file, that file's patch, a review, a note.
_PATH = """case when l_partkey % 9 = 0 then 'tests/test_p' || (l_partkey % 50) || '.py' when l_partkey % 11 = 0 then 'p' || (l_partkey % 50) || '.lock'
  when l_partkey % 8 = 0 then 'setup.cfg' else 'src/d' || (l_partkey % 5) || '/p' || (l_partkey % 50) || '.py' end"""
_PATCH = """case when l_quantity > 40 then null when l_quantity > 38 then '' when l_suppkey % 10 = 7 then 'Binary files differ'
  when l_partkey % 199 = 0 then '@@ -1 +1,3000 @@' || repeat(chr(10) || '+xy', 3000)
  when l_quantity > 25 then '@@ -1,2 +1 @@' || chr(10) || ' a' || chr(10) || '-b' else '@@ -3 +3 @@' || chr(10) || '-a' || chr(10) || '+b' || chr(10) || '@@ -9 +9 @@' || chr(10) || '-c' || chr(10) || '+d' end"""
_REVIEW = "case l_partkey % 3 when 0 then 'please change the loop in part ' || l_partkey when 1 then 'LGTM' else '  reads well, thanks  ' end"
_NOTE = "case l_partkey % 4 when 0 then '```suggestion' || chr(10) || 'a better line of code' when 1 then 'split this into two parts, as in ' || l_partkey when 2 then 'nit' end"
_STATE = "case l_suppkey % 5 when 0 then 'CHANGES_REQUESTED' when 1 then 'DISMISSED' when 2 then 'COMMENTED' else 'APPROVED' end"
_CHECK = "case l_partkey % 3 when 0 then 'Static checks' when 1 then 'Docs' else 'Tests / core' end"
_COMMIT = "case when l_partkey % 10 = 0 then '' else 'Change ' || l_partkey || chr(10) || 'more' end"
_HUNK = "case when l_suppkey % 2 = 0 then '@@ -1 +1 @@' else '' end"
_CONCLUSION = "case l_returnflag when 'R' then 'failure' when 'A' then 'success' end"


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Change records in full, their parts in the order of the lines (one shuffle by order, of the plain columns: texts and lists are made after it)."""
    path, who = F.expr(_PATH), F.struct(_text("s", [F.col("l_suppkey")]).alias("login"))
    at = _iso(F.col("l_shipdate"))
    file = F.struct(path.alias("filename"), F.when(F.col("l_linestatus") == "O", "added").otherwise("modified").alias("status"), F.expr(_PATCH).alias("patch"), F.col("l_quantity").cast("int").alias("additions"), F.col("l_linenumber").alias("deletions"))
    review = F.struct(F.expr(_STATE).alias("state"), F.expr(_REVIEW).alias("body"), at.alias("submitted_at"), who.alias("user"))
    note = F.struct(F.expr(_NOTE).alias("body"), path.alias("path"), F.expr(_HUNK).alias("diff_hunk"), who.alias("user"))
    run = F.struct(F.expr(_CHECK).alias("name"), F.expr(_CONCLUSION).alias("conclusion"))
    commit = F.struct(F.struct(F.expr(_COMMIT).alias("message")).alias("commit"))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    part = lambda c, on=None: F.transform(F.sort_array(F.collect_list(F.struct(place.alias("at"), c.alias("x")) if on is None else F.when(on, F.struct(place.alias("at"), c.alias("x"))))), lambda v: v.x)
    flag = F.col("l_returnflag")
    lines = _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    lines = lines.withColumnRenamed("l_orderkey", "o_orderkey").repartition("o_orderkey").groupBy("o_orderkey").agg(
        part(file).alias("files"), part(review, flag == "R").alias("reviews"), part(note, (flag == "A") & (F.col("l_discount") > 0.05)).alias("review_comments"),
        part(run, F.col("l_linestatus") == "F").alias("check_runs"), part(commit, F.col("l_tax") > 0.04).alias("commits"), F.sum("l_quantity").cast("int").alias("additions"),
    )
    k, shut = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    end = F.when(shut, _iso(F.col("o_orderdate")))
    pr = F.struct(
        k.alias("number"), _text("Order ", [k]).alias("title"), F.lit(None).cast("string").alias("body"), F.when(shut, "closed").otherwise("open").alias("state"), _iso(F.col("o_orderdate")).alias("created_at"),
        end.alias("closed_at"), F.when(k % 2 == 0, end).alias("merged_at"), F.col("additions"), F.struct(F.sha1(k.cast("string").cast("binary")).alias("sha")).alias("base"),
    )
    o = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").join(lines, "o_orderkey", "left")
    linked = F.when(k % 3 == 0, F.col("o_custkey").cast("string")).otherwise("None")
    return o.select(k.alias("pr_number"), F.lit("r").alias("repo"), linked.alias("linked_issue_number"), pr.alias("pr"), "files", "reviews", "review_comments", "check_runs", "commits", F.array().cast("array<string>").alias("silent_reviewers"))


_AT = "order by l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_P = f"""ls as (select *, {_PATH} as path, {_PATCH} as patch from lineitem),
pl as (select l_orderkey as k, list({{'path': path, 'patch': patch, 'status': case when l_linestatus = 'O' then 'added' else 'modified' end, 'a': l_quantity::int, 'd': l_linenumber}} {_AT}) as files,
  list({{'state': {_STATE}, 'body': {_REVIEW}, 'who': 's' || l_suppkey}} {_AT}) filter (l_returnflag = 'R') as rv,
  list({{'body': coalesce({_NOTE}, ''), 'hunk': {_HUNK}}} {_AT}) filter (l_returnflag = 'A' and l_discount > 0.05) as nt,
  list({{'name': {_CHECK}, 'said': {_CONCLUSION}}} {_AT}) filter (l_linestatus = 'F') as ck, list({_COMMIT} {_AT}) filter (l_tax > 0.04) as cm, sum(l_quantity)::int as additions from ls group by 1),
p as (select o_orderkey as k, o_custkey as cust, o_orderdate as made, o_orderstatus = 'F' as closed, o_orderstatus = 'F' and o_orderkey % 2 = 0 as merged, coalesce(files, []) as files, coalesce(rv, []) as rv, coalesce(nt, []) as nt,
  coalesce(ck, []) as ck, coalesce(cm, []) as cm, coalesce(additions, 0) as additions from orders left join pl on k = o_orderkey),
pt as (select *, list_filter(files, lambda f: f.patch is not null and f.patch <> '') as patched from p)"""

# --- critic examples --------------------------------------------------------------------------

_CLEAN = "case when len(files) = 1 then 'single file' when len(list_filter(files, lambda f: contains(f.path, 'test'))) > 0 then 'has tests' else 'clean patch' end"
_FIRST = "case when contains(patched[1].patch, '@@ ') then split_part(patched[1].patch, chr(10) || '@@ ', 1) else '' end"


@query(f"""
with {_P}, q as (select *, list_filter(rv, lambda r: r.state = 'CHANGES_REQUESTED' and length(r.body) > 20) as asked, list_filter(nt, lambda c: c.hunk <> '' and length(c.body) > 20 and not starts_with(c.body, '```')) as notes,
  len(list_filter(nt, lambda c: c.hunk <> '' and length(c.body) > 20)) as long_notes, len(list_filter(rv, lambda r: r.state = 'CHANGES_REQUESTED')) as barred from pt where len(patched) > 0),
l as (select *, case when not merged and closed and len(asked) + len(notes) > 0 then 'REJECT' when merged and len(asked) + len(notes) > 0 then 'REVISE' when merged and barred + long_notes = 0 then 'ACCEPT' end as label from q),
w as (select *, left(case label when 'REJECT' then coalesce(asked[1].body, notes[1].body) when 'REVISE' then coalesce(notes[1].body, asked[1].body) else {_CLEAN} end, 400) as why,
  row_number() over (partition by label order by md5(k || ':42'), k) as r from l where label is not null),
n as (select min(c) as c from (select count(*) as c from w group by label)),
ap as (select path, l_orderkey * 100 + l_linenumber as id, {_REVIEW} as body from ls where l_returnflag = 'R' and l_partkey % 3 <> 1),
fr as (select path, coalesce(string_agg(left(body, 100), ' | ' order by r) filter (length(body) > 20), '') as f from (select *, row_number() over (partition by path order by id, body) as r from ap) where r <= 2 group by path),
h as (select k, string_agg(f, chr(10) order by f) as f from (select distinct w.k, fr.f from (select k, unnest(files).path as path from w where r <= 250) w join fr using (path)) group by k)
select k as pr_number, label, 'PR: Order ' || k || chr(10) || 'HISTORY: ' || coalesce(h.f, 'none') || chr(10) || 'DIFF:' || chr(10) || {_FIRST} as input, 'VERDICT: ' || label || chr(10) || 'REASONING: ' || why as output
from w left join h using (k) where r <= least(250, (select c from n))""")
def critic_examples(spark, d):
    """L-26, P-26, R-7, F-22, G-11: rejected, revised and accepted changes, as many of each, with what reviews said of their files."""
    path, rid = F.expr(_PATH), F.col("l_orderkey") * 100 + F.col("l_linenumber")
    r = _t(spark, d, "lineitem").where("l_returnflag = 'R' and l_partkey % 3 <> 1").select(path.alias("filename"), F.expr(_REVIEW).alias("body"), rid.alias("n"))
    r = r.select("filename", "body", F.concat(F.lpad(F.col("n").cast("string"), 18, "0"), F.lit(":"), "body", "filename").alias("id"))  # the order of review ids is that of texts
    reviews, applies = r.select("id", "body").distinct(), r.select(F.col("id").alias("review"), "filename").distinct()
    return DS.critic_examples(changes(spark, d), G.friction(reviews, applies))


@query(f"""
with {_P}, q as (select *, list_filter(rv, lambda r: r.state = 'CHANGES_REQUESTED' and length(trim(r.body)) > 20) as asked, list_filter(nt, lambda c: c.hunk <> '' and length(c.body) > 20 and not starts_with(c.body, '```suggestion')) as notes,
  len(list_filter(nt, lambda c: c.hunk <> '' and length(c.body) > 20)) + len(list_filter(rv, lambda r: r.state = 'CHANGES_REQUESTED')) as barred,
  len(list_filter(ck, lambda c: c.said = 'failure' and c.name <> 'Docs')) as failed, list_filter(rv, lambda r: r.state = 'APPROVED' and length(trim(r.body)) > 10) as spoken from pt),
l as (select *, case when len(patched) = 0 then null when not merged and len(asked) + len(notes) > 0 then 'REJECT' when merged and len(asked) + len(notes) > 0 then 'REVISE' when merged and barred + failed = 0 then 'ACCEPT' end as label from q)
select k as pr_number, label, case label when 'REJECT' then coalesce(trim(asked[1].body), notes[1].body) when 'REVISE' then coalesce(notes[1].body, trim(asked[1].body)) when 'ACCEPT' then coalesce(trim(spoken[1].body), {_CLEAN}) end as reasoning from l""")
def strict_critic_rows(spark, d):
    """P-27: every change by the stricter rules."""
    return DS.strict_critic_label(changes(spark, d)).select("pr_number", "label", "reasoning")


# --- labels of snapshots ----------------------------------------------------------------------

#: Snapshots, and of each the change that resolves it.
_SNAPS = f"""iss as (select c_custkey as n, min(o_orderdate) as created, case when c_custkey % 3 <> 0 then max(o_orderdate) + interval 1 day end as closed from customer join orders on o_custkey = c_custkey group by 1),
snap as (select n, tier, created + to_days(tier) as cut from iss, (values (7), (15), (400), (900)) t(tier) where closed is null or closed > created + to_days(tier)),
rs as (select n, tier, arg_min(pt, (case when closed then 0 else 1 end) * 1000000000000 + k) as r from snap join pt on cust = n and k % 3 = 0 and made <= cut group by all)"""


def _snapshots(spark: SparkSession, d: str, prs: DataFrame, parts: tuple[str, ...] = I.PR_PARTS) -> DataFrame:
    return I.attach_prs(I.snapshots(issues(spark, d), TIERS), prs, parts)


def _answers(s: DataFrame) -> DataFrame:
    """What a teacher says of snapshots: of some nothing, of some something useless."""
    n = F.col("issue_number")
    score = F.when(n % 7 == 0, "no idea").otherwise(_text("ADJUSTMENT: 0.", [n % 5], "\nREASON: because ", [n]))
    critic = F.when(n % 5 == 0, '{"verdict": "MAYBE"}').otherwise(_text('ok: {"verdict": "', [F.when(n % 2 == 0, "ACCEPT").otherwise("REJECT")], '", "reasoning": "r', [n], '"}'))
    given = {"scorer": F.when(n % 2 == 0, score), "reasoner": F.when(n % 3 > 0, _text("slow, says ", [n])), "critic": critic}
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), c.alias("raw")) for m, c in given.items()])).alias("x")
    return s.select("issue_number", "snapshot_tier", rows).select("issue_number", "snapshot_tier", "x.*").where("raw is not null")


_PERCENT = "(('0x' || substr(md5(n::varchar), 1, 16))::uhugeint * 18446744073709551616 + ('0x' || substr(md5(n::varchar), 17, 16))::uhugeint) % 100"
_SCORED = f"""ps as ({SQL["snapshot_scores"]}),
ask as (select issue_number as n, *, {_PERCENT.replace("n::", "issue_number::")} < 20 and issue_number % 2 = 0 as asked, case when issue_number % 7 = 0 then 0 else least(0.3, (issue_number % 5) / 10) end as adj from ps),
sl as (select *, case when asked then round(least(1, prog_score + 0.4 * adj), 4) else prog_score end as score from ask)"""
_BAND = "case when score < 0.35 then 'low' when score < 0.65 then 'medium' else 'high' end"


@query(f"""
with {_SCORED}
select issue_number, snapshot_tier, score, {_BAND} as band_name, case when score < 0.35 then 1 when score < 0.65 then 2 else 3 end as band, case when asked then 'hybrid' else 'programmatic' end as label_source,
  case when asked and issue_number % 7 <> 0 then 'because ' || issue_number else '' end as reasoning from sl""")
def scorer_label_rows(spark, d):
    """L-15, F-40, F-41, X-4: scores, in a sample blended with what the teacher says."""
    s = _snapshots(spark, d, plain_changes(spark, d).withColumn("commits", F.array().cast("array<struct<commit: struct<message: string>>>")))
    x = L.scorer_labels(s, _answers(s))
    return x.select("issue_number", "snapshot_tier", "label.score", "label.band_name", "label.band", "label.label_source", "label.reasoning")


@query(f"with {_SCORED} select issue_number, snapshot_tier, 'slow, says ' || issue_number as narrative, score, {_BAND} as band_name, 0 as n_references from sl where issue_number % 3 > 0")
def reasoner_label_rows(spark, d):
    """L-16, J-6: the teacher's narrative with the scorer's score."""
    s = _snapshots(spark, d, plain_changes(spark, d).withColumn("commits", F.array().cast("array<struct<commit: struct<message: string>>>")))
    x = L.build_labels("reasoner", s, _answers(s))
    return x.select("issue_number", "snapshot_tier", "label.narrative", "label.score", "label.band_name", F.size("label.references").alias("n_references"))


@query(f"""
with {_P}, {_SNAPS}
select n as issue_number, 'T+' || tier as snapshot_tier, array_to_string(list_transform(r.files, lambda f: f.path), ',') as files,
  array_to_string(list_sort(list_distinct(list_transform(r.files, lambda f: case when contains(f.path, '/') then regexp_replace(f.path, '/[^/]*$', '') else '.' end))), ',') as directories,
  array_to_string(list_sort(list_distinct(list_transform(r.files, lambda f: f.status))), ',') as change_types, array_to_string(list_transform(list_filter(r.cm, lambda m: m <> ''), lambda m: split_part(m, chr(10), 1)), ' → ') as summary
from rs where len(r.files) > 0""")
def planner_label_rows(spark, d):
    """L-17, L-19, J-3: files, directories, kinds and commits of the change that resolves each snapshot."""
    x = L.planner_labels(_snapshots(spark, d, changes(spark, d), L.PARTS["planner"]))
    text = lambda c: F.array_join(f"label.{c}", ",").alias(c)
    return x.select("issue_number", "snapshot_tier", text("files"), text("directories"), text("change_types"), "label.summary")


@query(f"""
with {_P}, {_SNAPS}
select n as issue_number, 'T+' || tier as snapshot_tier, len(r.patched) as n_files, list_sum(list_transform(r.patched, lambda f: f.a))::bigint as additions, list_sum(list_transform(r.patched, lambda f: f.d))::bigint as deletions,
  md5(array_to_string(list_transform(r.patched, lambda f: f.path || ':' || f.status || ':' || case when length(f.patch) > 8192 then left(f.patch, 8192) || chr(10) || '... [truncated]' else f.patch end), '|')) as patches
from rs where len(r.patched) > 0""")
def patcher_label_rows(spark, d):
    """L-18: patches, long ones cut with a mark, and totals."""
    x = L.patcher_labels(_snapshots(spark, d, changes(spark, d), L.PARTS["patcher"]))
    one = F.transform("label.patches", lambda f: F.concat(f.filename, F.lit(":"), f.status, F.lit(":"), f.patch))
    return x.select("issue_number", "snapshot_tier", "label.n_files", "label.additions", "label.deletions", F.md5(F.array_join(one, "|")).alias("patches"))


@query(f"""
with {_P}, {_SNAPS}, s as (select n, tier, r, len(list_filter(r.rv, lambda x: x.state = 'APPROVED')) > 0 as ok, len(list_filter(r.rv, lambda x: x.state = 'CHANGES_REQUESTED')) > 0 as no, len(list_filter(r.rv, lambda x: x.state = 'DISMISSED')) > 0 as gone,
  {_PERCENT} < 30 and n % 5 <> 0 as asked from rs),
v as (select *, case when ok and not no then 'ACCEPT' when no and r.closed then 'REVISE' when no then 'REJECT' when gone then 'REVISE' end as seen from s)
select n as issue_number, 'T+' || tier as snapshot_tier, coalesce(seen, case when n % 2 = 0 then 'ACCEPT' else 'REJECT' end) as verdict, case when seen is null then 'synthetic' else 'real_review' end as label_source,
  case when seen is null then 'r' || n end as reasoning, coalesce(array_to_string(list_transform(r.rv[1:5], lambda x: x.who || ' ' || x.state), ','), '') as excerpts from v where seen is not null or asked""")
def critic_label_rows(spark, d):
    """L-20, L-21, F-43: verdicts from reviews, else in a sample from the teacher."""
    s = _snapshots(spark, d, changes(spark, d), L.PARTS["critic"])
    x = L.critic_labels(s, _answers(s))
    who = F.transform("label.reviews", lambda r: F.concat(r.reviewer, F.lit(" "), r.state))
    return x.select("issue_number", "snapshot_tier", "label.verdict", "label.label_source", "label.reasoning", F.array_join(who, ",").alias("excerpts"))


@query(f"""
with {_P}, {_SNAPS}, t as (select count(*) as n from snap),
d as (select 'planner' as model, n, tier from rs where len(r.files) > 0 union all select 'patcher', n, tier from rs where len(r.patched) > 0)
select 'labels of ' || model as what, count(*)::double as n, count(distinct n)::double as issues from d where tier <> 7 group by model
union all select 'cost of ' || m.model, t.n * m.per, null from t, (values ('scorer', 0.0005), ('reasoner', 0.004), ('planner', 0.0), ('patcher', 0.0), ('critic', 0.001)) m(model, per)""")
def label_resume(spark, d):
    """L-22 to L-25, K-8, X-1: labels of snapshots that have none yet, counted, and what asking costs."""
    s = _snapshots(spark, d, changes(spark, d), tuple(dict.fromkeys(L.PARTS["planner"] + L.PARTS["patcher"])))
    answers = _answers(s)
    done = s.where("snapshot_tier = 'T+7'").select("issue_number", "snapshot_tier")
    made = L.build_labels("planner", s, answers, done).drop("label").unionByName(L.build_labels("patcher", s, answers, done).drop("label"))
    number = lambda c: F.col(c).cast("double").alias(c)
    stats = L.label_statistics(made).select(_text("labels of ", [F.col("model")]).alias("what"), number("n"), number("issues"))
    cost = L.cost_estimate(I.snapshots(issues(spark, d), TIERS)).select(_text("cost of ", [F.col("model")]).alias("what"), F.col("cost").cast("double").alias("n"), F.lit(None).cast("double").alias("issues"))
    return stats.unionByName(cost)


# --- gates, records, reports ------------------------------------------------------------------

_OK = "not regexp_matches(f.path, '[.]lock$')"
_TOKENS = "case when f.patch is null or f.patch = '' then 0 else len(list_filter(regexp_split_to_array(f.patch, '[ \\n]+'), lambda w: w <> '')) end"
_GATES = f"""g as (select *, list_filter(patched, lambda f: {_OK}) as kept, coalesce(list_sum(list_transform(files, lambda f: {_TOKENS})), 0) as tokens from pt),
rn as (select *, case when len(files) = 0 then 'no_files_json' when len(kept) = 0 then 'no_allowed_patch' when len(files) > 3 then 'too_many_files' when additions > 350 then 'too_many_additions'
  when tokens > 1200 then 'too_many_patch_tokens' when len(list_filter(kept, lambda f: not starts_with(f.patch, '@@ '))) > 0 then 'invalid_unified_diff' end as reason from g)"""


@query(f"""
with {_P}, {_GATES}
select reason, count(*) as n from rn where reason is not null group by 1 union all select 'kept', count(*) from rn where reason is null
union all select 'cheap', count(*) from rn where additions <= 350 and tokens <= 1200 and len(files) <= 3 and len(kept) > 0""")
def patch_gates(spark, d):
    """P-17, P-18, P-19, P-21, A-18: why changes are left out, and what the cheap gates let through."""
    p = changes(spark, d)
    r = p.select(DS.drop_reason(F.col("files"), F.col("pr.additions")).alias("reason"))
    count = lambda df, name: df.agg(F.lit(name).alias("reason"), F.count("*").alias("n"))
    return DS.drop_report(r).unionByName(count(r.where("reason is null"), "kept")).unionByName(count(DS.cheap_prefilter(p), "cheap"))


@query(f"""
with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, {_PATH} as path, case when l_linenumber = 7 then null when l_linenumber = 6 then '' else (l_orderkey * 10 + l_linenumber) % 5000 || '' end as id from lineitem),
n as (select id, count(*) as c from x group by id)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, array_to_string(list_filter([case when x.id is null or x.id = '' then 'missing_id' end, case when c > 1 then 'duplicate_id' end, case when l_partkey % 6 = 0 then 'bad_sha' end,
  case when l_suppkey % 4 = 0 then 'not_unified' end, case when l_quantity > 45 then 'no_allowed_files' end, case when l_quantity > 45 or l_partkey % 7 = 0 then 'touched_outside_allowed' end], lambda e: e is not null), ',') as errors
from x left join n on x.id = n.id""")
def record_errors(spark, d):
    """P-23, U-7, F-23: what is wrong with each record."""
    x = _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    key = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) % 5000).cast("string")
    sha = F.sha1(F.col("l_orderkey").cast("string").cast("binary"))
    x = x.withColumns({
        "id": F.when(F.col("l_linenumber") == 6, "").when(F.col("l_linenumber") < 7, key), "base_sha": F.when(F.col("l_partkey") % 6 == 0, F.left(sha, F.lit(39))).otherwise(sha),
        "diff": F.when(F.col("l_suppkey") % 4 == 0, "+++ b").otherwise("--- a\n+++ b"), "touched_files": F.array(F.expr(_PATH)),
        "allowed_edit_files": F.when(F.col("l_quantity") > 45, F.array().cast("array<string>")).when(F.col("l_partkey") % 7 == 0, F.array(F.lit("elsewhere"))).otherwise(F.array(F.expr(_PATH), F.lit("more"))),
    })
    return DS.validation_errors(x).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.array_join("errors", ",").alias("errors"))


@query(f"""
with {_P}, u as (select cust, k, unnest(files).path as f, unnest(range(1, len(files) + 1)) as i from p),
o as (select cust, f, min(k * 100 + i) as place from u group by all), w as (select cust, string_agg(f, ',' order by place) as files, count(*) as n_files from o group by cust),
m as (select count(*) as issues, avg(n) as mean, max(n) as max from (select cust, count(*) as n from p group by cust))
select b.cust as issue_number, coalesce(files, '') as files, coalesce(n_files, 0) as n_files, m.issues, round(m.mean, 4) as mean, m.max from (select distinct cust from p) b left join w on w.cust = b.cust cross join m""")
def issue_files(spark, d):
    """A-19, A-20: the files of all changes of an issue, once each, in order; changes per issue."""
    p = changes(spark, d).select("pr_number", "files.filename").withColumnRenamed("filename", "files")
    rows = p.join(_t(spark, d, "orders", F.col("o_orderkey").alias("pr_number"), F.col("o_custkey").alias("issue_number")), "pr_number")
    files = DS.files_of_issue(rows.withColumn("files", F.coalesce("files", F.array().cast("array<string>"))), "issue_number", "files", "pr_number")
    of = DS.prs_per_issue(rows, "issue_number").select("issues", F.round("mean", 4).alias("mean"), "max")
    return files.select("issue_number", F.array_join("files", ",").alias("files"), F.size("files").cast("long").alias("n_files")).crossJoin(F.broadcast(of))  # one row


@query("""
with b as (select o_custkey as k, case max(case when o_totalprice < 100000 then 1 when o_totalprice < 250000 then 2 else 3 end) when 1 then 'low' when 2 then 'medium' else 'high' end as band from orders group by 1),
r as (select *, row_number() over (partition by band order by md5(k || ':42'), k) as r, count(*) over (partition by band) as n from b),
s as (select band, case when r <= greatest(1, round_even(n * 0.1, 0)) then 'test' when r <= 2 * greatest(1, round_even(n * 0.1, 0)) then 'val' else 'train' end as split from r),
c as (select split, band, count(*) as n from s group by all)
select split, band, n, round(100.0 * n / sum(n) over (partition by split), 2) as pct from c""")
def band_splits(spark, d):
    """A-23, A-24, R-4: customers by their greatest band, split by band, counted with shares."""
    band = F.when(F.col("o_totalprice") < 100000, "low").when(F.col("o_totalprice") < 250000, "medium").otherwise("high")
    b = S.dominant_band(_t(spark, d, "orders", "o_custkey", "o_totalprice").select(F.col("o_custkey").alias("k"), band.alias("band")), "k", "band")
    c = R.counts(S.stratified_split(b, "k", "band", 42), "split", "band").select("split", "band", "n")
    of = c.groupBy("split").agg(F.sum("n").alias("all"))  # three rows
    return c.join(of, "split").select("split", "band", "n", F.round(100.0 * F.col("n") / F.col("all"), 2).alias("pct"))
