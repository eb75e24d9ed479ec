"""Registered queries on issue and change records: the operators themselves, on records made from the driver's tables.

A customer is an issue, an order is a change of it, its lines are reviews, checks and files. Each
query calls the library's operators; its SQL derives the same values from the plain tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feedback as FB
from ..operators import graph as G
from ..operators import issues as I
from ..operators import relational as R
from .catalog import _t, query

#: Ages (days) of the snapshots here.
TIERS = (7, 15, 400, 900)


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p[0].cast("string") for p in parts])


def issues(spark: SparkSession, d: str) -> DataFrame:
    """Issue records: one a customer, with comments and timeline from its orders (two shuffles by customer)."""
    k, at = F.col("o_orderkey"), _iso(F.col("o_orderdate"))
    kind = F.element_at(F.array(*map(F.lit, ("assigned", "labeled", "connected", "added_to_project", "unassigned"))), (k % 5 + 1).cast("int"))
    source = F.struct(F.struct(k.alias("number"), F.lit(None).cast("struct<url: string>").alias("pull_request")).alias("issue"))
    comment = F.struct(F.when(k % 6 == 0, _text("fixes #", [k])).otherwise("note").alias("body"), at.alias("created_at"), F.struct(_text("u", [k % 7]).alias("login")).alias("user"))
    per = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.collect_list(F.when(k % 3 == 0, comment)).alias("comments"),
        F.collect_list(F.struct(kind.alias("event"), F.when(k % 7 != 0, at).alias("created_at"), source.alias("source"))).alias("timeline"),
        F.collect_list(F.when(k % 5 == 0, k)).alias("linked_pr_numbers"),
    )
    n = F.col("c_custkey")
    body = F.when(n % 4 == 0, _text("- [ ] step closes #", [n + 1])).when(n % 4 > 1, "plain text")
    shut = F.when(n % 3 != 0, F.col("last") + F.expr("interval 1 day"))
    login = F.when(n % 10 == 0, _text("robot", [n % 3], "[bot]")).otherwise(_text("user", [n % 50]))
    issue = F.struct(
        n.alias("number"), F.col("c_name").alias("title"), body.alias("body"), F.when(shut.isNull(), "open").otherwise("closed").alias("state"), F.lit(None).cast("string").alias("state_reason"),
        _iso(F.col("first")).alias("created_at"), _iso(shut).alias("closed_at"), F.lit(None).cast("string").alias("updated_at"),
        F.struct(login.alias("login"), F.when(n % 11 == 0, "Bot").otherwise("User").alias("type")).alias("user"),
        F.array(F.struct(F.col("c_mktsegment").alias("name")), F.struct(F.when(n % 2 == 0, "even").otherwise("").alias("name"))).alias("labels"),
        F.array_repeat(F.struct(F.lit("a").alias("login")), (n % 3).cast("int")).alias("assignees"), F.when(n % 5 == 0, F.struct(_text("m", [n % 4]).alias("title"))).alias("milestone"),
        F.lit(None).cast("struct<login: string>").alias("closed_by"),
    )
    c = _t(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").join(per, "c_custkey", "left")
    return c.select(n.alias("issue_number"), F.lit("r").alias("repo"), "linked_pr_numbers", issue.alias("issue"), "comments", "timeline")


def _said(k: Column, c: Column) -> list[Column]:
    """A change's title and body."""
    title = F.when(k % 10 == 3, _text("fix #", [c + 2])).otherwise(_text("Order ", [k])).alias("title")
    return [title, F.when(k % 4 == 0, _text("Resolves: #", [c])).when(k % 4 == 1, _text("see https://github.com/a/b/issues/", [c + 1])).alias("body")]


def _linked(k: Column, c: Column) -> Column:
    return F.when(k % 3 == 0, c.cast("string")).otherwise("None").alias("linked_issue_number")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Link evidence: read from what changes say and list, all of which stands in orders; their lines are not made for it."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = _t(spark, d, "orders", "o_orderkey", "o_custkey").select(k.alias("pr_number"), _linked(k, c), F.struct(*_said(k, c)).alias("pr"))
    return I.issue_pr_edges(issues(spark, d), p)


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Change records: one an order, with reviews, checks and files from its lines."""
    at, who = _iso(F.col("l_shipdate")), F.struct(_text("s", [F.col("l_suppkey")]).alias("login"))
    rid = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    path = _text("src/p", [F.col("l_partkey") % 50], ".py")
    review = F.struct(rid.alias("id"), F.lit("COMMENTED").alias("state"), F.lit("said").alias("body"), at.alias("submitted_at"), who.alias("user"))
    inline = F.struct(rid.alias("id"), F.lit("inline").alias("body"), path.alias("path"), F.lit("@@").alias("diff_hunk"))
    run = F.struct(F.when(F.col("l_returnflag") == "R", "failure").when(F.col("l_returnflag") == "A", "success").alias("conclusion"), at.alias("started_at"), at.alias("completed_at"))
    lines = _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("last"), F.collect_list(F.when(F.col("l_returnflag") == "R", review)).alias("reviews"), F.collect_list(F.when(F.col("l_returnflag") == "A", inline)).alias("review_comments"),
        F.collect_list(F.when(F.col("l_linestatus") == "F", run)).alias("check_runs"), F.collect_list(F.struct(path.alias("filename"))).alias("files"),
        F.collect_list(F.when(F.col("l_quantity") > 45, who)).alias("requested"),
    )
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    shut = F.when(F.col("o_orderstatus") == "F", _iso(F.col("last")))
    pr = F.struct(
        k.alias("number"), *_said(k, c),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"), _iso(F.col("o_orderdate")).alias("created_at"), shut.alias("closed_at"),
        F.when(k % 2 == 0, shut).alias("merged_at"), F.col("requested").alias("requested_reviewers"),
    )
    o = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").join(lines, "o_orderkey", "left")
    return o.select(
        k.alias("pr_number"), F.lit("r").alias("repo"), _linked(k, c), pr.alias("pr"), "reviews", "review_comments",
        "check_runs", "files", I.silent_reviewers(F.col("requested"), F.col("reviews")).alias("silent_reviewers"), F.array().cast("array<string>").alias("commits"),
    )


# The same records as plain SQL: issues, changes, link evidence, snapshots.
_ISS = """iss as (select c_custkey as n, c_name, c_mktsegment, min(o_orderdate) as created,
  case when c_custkey % 3 <> 0 then max(o_orderdate) + interval 1 day end as closed, count(o_orderkey) as n_orders,
  count(*) filter (o_orderkey % 3 = 0) as n_comments, count(*) filter (o_orderkey % 5 = 0) as n_listed
  from customer left join orders on c_custkey = o_custkey group by c_custkey, c_name, c_mktsegment)"""
_LN = """ln as (select l_orderkey as k, max(l_shipdate) as last, count(*) filter (l_returnflag = 'R') as n_reviews, min(l_shipdate) filter (l_returnflag = 'R') as first_review,
  count(*) as n_files, count(*) filter (l_linestatus = 'F') as n_runs, count(*) filter (l_linestatus = 'F' and l_returnflag <> 'N') as n_said,
  count(*) filter (l_linestatus = 'F' and l_returnflag = 'R') as n_failed, count(*) filter (l_linestatus = 'F' and l_returnflag = 'A') as n_passed from lineitem group by 1)"""
_EDGES = """edges as (select * from (
  select o_custkey as issue, o_orderkey as pr, 1 as source from orders where o_orderkey % 3 = 0
  union all select o_custkey, o_orderkey, 2 from orders where o_orderkey % 5 = 0
  union all select o_custkey, o_orderkey, 3 from orders where o_orderkey % 4 = 0
  union all select o_custkey + 2, o_orderkey, 3 from orders where o_orderkey % 10 = 3
  union all select o_custkey + 1, o_orderkey, 4 from orders where o_orderkey % 4 = 1
  union all select o_custkey, o_orderkey, 5 from orders where o_orderkey % 6 = 0
  union all select c_custkey, c_custkey + 1, 5 from customer where c_custkey % 4 = 0 and c_custkey + 1 in (select o_orderkey from orders))
  where issue in (select c_custkey from customer))"""
_TIERS = "(values (7), (15), (400), (900)) t(tier)"
_SNAP = f"snap as (select n, created, closed, tier, created + to_days(tier) as cut from iss, {_TIERS} where created is not null and (closed is null or closed > created + to_days(tier)))"
_BATCH = f"""snap as (select n, created, closed, tier, created + to_days(tier) as cut from iss, {_TIERS}
  where created is not null and (closed is null or (closed >= created + to_days(tier) and epoch(closed - created) / 86400 <= 528)))"""


def _links(undated: str) -> str:
    """Linked changes of a snapshot; ``undated`` says what becomes of events without a date."""
    return f"""links as (
  select n, tier, o_orderkey as pr from snap join orders on o_custkey = n where o_orderkey % 5 = 2 and ({undated})
  union select n, tier, o_orderkey from snap join orders on o_custkey = n where o_orderkey % 6 = 0 and o_orderdate <= cut
  union select n, tier, n + 1 from snap where n % 4 = 0)"""


_KEPT = "o_orderkey % 7 = 0 or o_orderdate <= cut"
_DROPPED = "o_orderkey % 7 <> 0 and o_orderdate <= cut"


# --- cleaning and flat rows -------------------------------------------------------------------


@query("""
with u as (select c_custkey as n, case when c_custkey % 10 = 0 then 'robot' || (c_custkey % 3) || '[bot]' else 'user' || (c_custkey % 50) end as login from customer)
select login, count(*) as n from u where n % 10 = 0 or n % 11 = 0 group by login""")
def bot_report(spark, d):
    """P-1, P-2, A-2."""
    return I.bot_report(issues(spark, d), F.col("issue.user"))


@query(f"""
with {_ISS}
select n as issue_number, left(c_name, 10) as title, case when closed is null then 'open' else 'closed' end as state,
  case when n % 4 = 0 then length('- [ ] step closes #' || (n + 1)) when n % 4 = 1 then 0 else 10 end as body_length,
  case when n % 2 = 0 then [c_mktsegment, 'even'] else [c_mktsegment] end as labels, n % 5 = 0 as has_milestone, n % 3 as assignee_count,
  n_comments as comment_count, n_listed as linked_pr_count, date_diff('hour', created, closed) / 24.0 as days_open from iss""")
def issue_rows(spark, d):
    """P-3, P-5, P-6, F-36."""
    return I.flatten_issues(issues(spark, d), 10).select("issue_number", "title", "state", "body_length", "labels", "has_milestone", "assignee_count", "comment_count", "linked_pr_count", "days_open")


@query(f"""
with {_LN}
select o_orderkey as pr_number, case when o_orderstatus = 'F' then 'closed' else 'open' end as state,
  o_orderstatus = 'F' and o_orderkey % 2 = 0 and last is not null as is_merged, case when o_orderkey % 3 = 0 then o_custkey end as linked_issue_number,
  coalesce(n_files, 0) as file_count, coalesce(n_reviews, 0) as review_count, coalesce(n_runs, 0) > 0 as has_ci,
  case when coalesce(n_said, 0) = 0 then 'none' when n_failed = 0 then 'success' else 'failure' end as ci_conclusion,
  case when o_orderstatus = 'F' and o_orderkey % 2 = 0 then date_diff('hour', o_orderdate, last) / 24.0 end as days_to_merge
from orders left join ln on k = o_orderkey""")
def change_rows(spark, d):
    """P-4, P-7, J-2 (numbers from text)."""
    return I.flatten_prs(changes(spark, d)).select("pr_number", "state", "is_merged", "linked_issue_number", "file_count", "review_count", "has_ci", "ci_conclusion", "days_to_merge")


@query("""
select l_orderkey as pr_number, list_sort(list(distinct 's' || l_suppkey)) as silent from lineitem l where l_quantity > 45
  and not exists (select 1 from lineitem r where r.l_orderkey = l.l_orderkey and r.l_suppkey = l.l_suppkey and r.l_returnflag = 'R') group by 1""")
def silent_reviewers(spark, d):
    """P-8."""
    return changes(spark, d).where(F.size("silent_reviewers") > 0).select("pr_number", F.array_sort(F.array_distinct("silent_reviewers")).alias("silent"))


# --- links ------------------------------------------------------------------------------------


@query(f"with {_EDGES} select source, count(*) as matches from edges group by source")
def link_evidence(spark, d):
    """J-1, F-1 to F-4: matches of the five sources."""
    return I.link_counts(edges(spark, d))


@query(f"with {_EDGES} select c_custkey as issue_number, coalesce(list_sort(list(distinct pr) filter (pr is not null)), []) as resolved_by_prs, count(pr) > 0 as has_linked_pr from customer left join edges on issue = c_custkey group by 1")
def issues_enriched(spark, d):
    """J-1, J-2, U-1: issues with their changes."""
    i, p = issues(spark, d), changes(spark, d)
    return I.enrich(i, p, edges(spark, d))[0].select("issue_number", "resolved_by_prs", "has_linked_pr")


@query(f"""
with {_EDGES}, first as (select pr, arg_min(issue, source * 100000000000 + issue) as f, list_sort(list(distinct issue)) as all_ from edges group by pr)
select o_orderkey as pr_number, coalesce(all_, []) as linked_issue_numbers, coalesce(case when o_orderkey % 3 = 0 then o_custkey end, f) as linked_issue_number
from orders left join first on pr = o_orderkey""")
def changes_enriched(spark, d):
    """J-2: changes with their issues; a missing link is filled."""
    i, p = issues(spark, d), changes(spark, d)
    return I.enrich(i, p, edges(spark, d))[1].select("pr_number", "linked_issue_numbers", "linked_issue_number")


@query(f"""
with {_EDGES}, {_LN},
a as (select count(*) as issues, count(*) filter (c_custkey in (select issue from edges)) as with_pr, count(*) filter (c_custkey not in (select issue from edges)) as without_pr from customer),
p as (select *, case when coalesce(n_said, 0) = 0 then 'none' when n_failed = 0 then 'success' else 'failure' end as ci from orders left join ln on k = o_orderkey)
select a.*, (select count(*) from orders) as prs, count(*) filter (o_orderkey in (select pr from edges)) as linked, count(*) filter (o_orderkey not in (select pr from edges)) as standalone,
  count(*) filter (o_orderstatus = 'F' and o_orderkey % 2 = 0 and last is not null) as merged, avg(case when n_reviews > 0 then 1 else 0 end) as share_reviewed,
  count(*) filter (ci = 'none') as ci_none, count(*) filter (ci = 'success') as ci_success, count(*) filter (ci = 'failure') as ci_failure, 0 as ci_mixed
from p, a group by all""")
def link_statistics(spark, d):
    """A-3 to A-6."""
    i, p = issues(spark, d), changes(spark, d)
    return I.link_statistics(*I.enrich(i, p, edges(spark, d)))


# --- snapshots and scores ---------------------------------------------------------------------


@query(f"""
with {_ISS}, {_SNAP}, {_links(_KEPT)},
seen as (select n, tier, count(*) filter (o_orderkey % 3 = 0 and o_orderdate <= cut) as comment_count,
  count(*) filter (o_orderkey % 7 = 0 or (o_orderdate <= cut and o_orderkey % 5 <> 3)) as n_events from snap join orders on o_custkey = n group by all)
select n as issue_number, 'T+' || tier as snapshot_tier, comment_count, n_events, (select count(*) from links l where l.n = seen.n and l.tier = seen.tier) as linked_pr_count,
  'open' as state, false as tells_end from seen""")
def snapshot_rows(spark, d):
    """L-12, P-10 to P-12, P-14, P-15, F-5, U-3: issues as of a date; nothing tells how they ended."""
    s = I.snapshots(issues(spark, d), TIERS)
    tells = F.coalesce(F.col("issue.closed_at"), F.col("issue.closed_by.login"), F.col("issue.updated_at")).isNotNull() | (F.col("issue.state") != "open")
    return s.select("issue_number", "snapshot_tier", "comment_count", F.size("timeline").alias("n_events"), "linked_pr_count", "state", tells.alias("tells_end"))


@query(f"""
with {_ISS}, snap as (select n, created, tier, created + to_days(tier) as cut from iss, {_TIERS} where closed is not null), {_links(_KEPT)},
c as (select n, tier, count(*) filter (o_orderkey % 3 = 0 and o_orderdate <= cut) as c from snap join orders on o_custkey = n group by all),
f as (select c.*, (select count(*) from links l where l.n = c.n and l.tier = c.tier) as p from c)
select 'T+' || tier as snapshot_tier, count(*) as n, avg(c) as avg_comments, avg(p) as avg_prs, count(*) filter (p > 0) as with_pr, count(*) filter (p = 0) as without_pr from f group by 1""")
def snapshot_report(spark, d):
    """A-9, P-9: closed issues at every age."""
    return I.snapshot_report(I.snapshots(issues(spark, d), TIERS, gate="closed"))


@query(f"""
with {_ISS}, {_SNAP}, {_links(_KEPT)}
select n as issue_number, 'T+' || tier as snapshot_tier, list_sort(list(pr)) as official from links join snap using (n, tier) join orders on o_orderkey = pr where o_orderdate <= cut group by all""")
def official_changes(spark, d):
    """J-7."""
    return I.official_prs(I.snapshots(issues(spark, d), TIERS), changes(spark, d))


@query(f"""
with {_ISS}, {_SNAP}, {_LN},
quiet as (select distinct l_orderkey as k from lineitem l where l_quantity > 45 and not exists (select 1 from lineitem r where r.l_orderkey = l.l_orderkey and r.l_suppkey = l.l_suppkey and r.l_returnflag = 'R')),
pr as (select n, tier, bool_or(floor(epoch(first_review - o_orderdate) / 86400) > 7) as late, bool_or(n_reviews > 3) as many, bool_or(o_orderstatus = 'F' and (o_orderkey % 2 = 1 or last is null)) as unmerged,
  bool_or(o_orderkey in (select k from quiet)) as quiet, bool_or(n_failed > 0 and n_passed = 0) as failed
  from snap join orders on o_custkey = n and o_orderkey % 3 = 0 and o_orderdate <= cut left join ln on k = o_orderkey group by all),
times as (select n, tier, created as t from snap union all select n, tier, cut from snap union all select n, tier, o_orderdate from snap join orders on o_custkey = n and o_orderkey % 3 = 0 and o_orderdate <= cut),
gaps as (select n, tier, max(g) as gap from (select n, tier, floor(epoch(t - lag(t) over (partition by n, tier order by t)) / 86400) as g from times) group by all),
moves as (select n, tier, count(*) as m from snap join orders on o_custkey = n and o_orderkey % 5 in (0, 4) and ({_KEPT}) group by all)
select n as issue_number, 'T+' || tier as snapshot_tier, round(least(1.0, round(least(tier / 22.0, 1.0) * 0.4, 4) + case when late then 0.15 else 0 end + case when many then 0.1 else 0 end
  + case when unmerged then 0.15 else 0 end + case when gap > 14 then 0.15 else 0 end + case when m > 1 then 0.1 else 0 end + case when quiet then 0.1 else 0 end
  + case when n % 4 = 0 then 0.05 else 0 end + case when failed then 0.15 else 0 end), 4) as prog_score
from snap left join pr using (n, tier) left join gaps using (n, tier) left join moves using (n, tier)""")
def snapshot_scores(spark, d):
    """L-1 to L-10, J-3, W-1 to W-4: the signals of each snapshot, summed and clamped."""
    s = I.attach_prs(I.snapshots(issues(spark, d), TIERS), changes(spark, d))
    return I.programmatic_score(s).select("issue_number", "snapshot_tier", "prog_score")


@query(f"""
with {_ISS}, {_BATCH}, {_links(_DROPPED)},
rv as (select l.n, l.tier, o_orderkey, o_orderdate, cut, o_orderstatus = 'F' and max(l_shipdate) <= cut and o_orderkey % 2 = 1 as unmerged,
  count(*) filter (l_quantity > 45) as asked, count(*) filter (l_returnflag = 'R' and l_shipdate <= cut) as reviews, min(l_shipdate) filter (l_returnflag = 'R' and l_shipdate <= cut) as first_review,
  count(*) filter (l_linestatus = 'F' and l_returnflag = 'R' and l_shipdate <= cut) as bad, count(*) filter (l_linestatus = 'F' and l_returnflag = 'A' and l_shipdate <= cut) as good
  from links l join snap using (n, tier) join orders on o_orderkey = pr and o_orderdate <= cut left join lineitem on l_orderkey = o_orderkey group by l.n, l.tier, o_orderkey, o_orderdate, cut, o_orderstatus),
pr as (select n, tier, sum(case when epoch(first_review - o_orderdate) / 86400 > 7 then 0.15 else 0 end + case when reviews > 3 then 0.1 else 0 end + case when unmerged then 0.15 else 0 end
  + case when asked > 0 and reviews = 0 then 0.1 else 0 end + case when bad > 0 and good = 0 then 0.15 else 0 end) as w from rv group by all),
cm as (select n, tier, cut, o_orderdate as t, lag(o_orderdate) over (partition by n, tier order by o_orderdate) as b, count(*) over (partition by n, tier) as c from snap join orders on o_custkey = n and o_orderkey % 3 = 0 and o_orderdate <= cut),
gaps as (select n, tier, max(epoch(case when c = 1 then cut - t else t - b end)) / 86400 as gap from cm group by all),
ev as (select n, tier, count(*) filter (o_orderkey % 5 = 0) as m, count(*) filter (o_orderkey % 5 = 3) as planned from snap join orders on o_custkey = n and {_DROPPED} group by all)
select n as issue_number, 'T+' || tier as snapshot_tier, round(least(1.0, least(tier / 82.0, 1.0) * 0.4 + case when gap > 14 then 0.15 else 0 end + case when m > 1 then 0.1 else 0 end
  + case when planned > 0 then 0.05 else 0 end + coalesce(w, 0)), 4) as prog_score
from snap left join pr using (n, tier) left join gaps using (n, tier) left join ev using (n, tier)""")
def batch_scores(spark, d):
    """L-11, J-5, P-13, P-16: signals as of the date, added for every change."""
    s = I.snapshots(issues(spark, d), TIERS, gate="inclusive", batch_form=True)
    return I.batch_score(s, changes(spark, d)).select("issue_number", "snapshot_tier", F.round("prog_score", 4).alias("prog_score"))


# --- graph ------------------------------------------------------------------------------------


@query(f"""
with {_EDGES}, t as (select distinct l_orderkey as pr, 'src/p' || (l_partkey % 50) || '.py' as f from lineitem)
select issue as number, list_sort(list(distinct f) filter (f is not null)) as files, count(distinct case when e.pr % 4 = 0 then 'Resolves: #' || o_custkey when e.pr % 4 = 1 then 'see https://github.com/a/b/issues/' || (o_custkey + 1) else '' end) as n_bodies
from (select distinct issue, pr from edges) e join orders on o_orderkey = e.pr left join t on t.pr = e.pr group by 1 having count(f) > 0""")
def graph_yes_samples(spark, d):
    """G-1, G-2, G-4: issues with a change: texts and touched files."""
    i, p = issues(spark, d), changes(spark, d)
    nodes, resolved = G.issue_graph(I.enrich(i, p, edges(spark, d))[0])
    s = G.yes_samples(nodes, resolved, *G.pr_graph(p)).where(F.size("files") > 0)
    return s.select("number", F.array_sort("files").alias("files"), F.size("pr_bodies").alias("n_bodies"))


@query(f"with {_EDGES} select c_custkey as number, c_name as title from customer where c_custkey not in (select issue from edges where source = 2)")
def graph_no_samples(spark, d):
    """G-1, G-5: issues that list no change themselves."""
    i, p = issues(spark, d), changes(spark, d)
    return G.no_samples(*G.issue_graph(I.enrich(i, p, edges(spark, d).where("source = 2"))[0])).select("number", "title")


@query("""
with r as (select distinct l_orderkey as pr, l_orderkey * 100 + l_linenumber as id, l_returnflag as f, 'src/p' || (l_partkey % 50) || '.py' as path from lineitem where l_returnflag <> 'N')
select 'review' as part, count(distinct (id, f)) as n from r union all select 'reviewed_in', count(distinct (id, f, pr)) from r union all select 'applies_to', count(distinct (id, path)) from r where f = 'A'""")
def graph_reviews(spark, d):
    """G-3."""
    parts = zip(("review", "reviewed_in", "applies_to"), G.review_graph(changes(spark, d)))
    a, b, c = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts]
    return a.unionByName(b).unionByName(c)


@query("""
with i as (select p_partkey, lower('src/' || replace(p_name, ' ', '/') || '_' || p_partkey || '.py') as path, lower(p_type) as sym from part),
q as (select * from (values (1, ['green', 'brass']), (2, ['steel', 'p', 'zz'])) v(qid, words)),
s as (select qid, path, list_sum(list_transform(words, lambda w: case when contains(path, w) then 2 else 0 end + case when contains(sym, w) then 1 else 0 end))::bigint as score from i, q),
r as (select *, row_number() over (partition by qid order by score desc, path) as rank from s where score > 0)
select qid, path, score, rank from r where rank <= 10""")
def keyword_files(spark, d):
    """O-4: files by keywords in path and symbols."""
    path = F.lower(F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".py")))
    index = _t(spark, d, "part", "p_partkey", "p_name", "p_type").select(path.alias("path"), F.array("p_type").alias("classes"), F.array().cast("array<string>").alias("functions"))
    words = spark.createDataFrame([(1, ["green", "brass"]), (2, ["steel", "p", "zz"])], "qid int, words array<string>")
    return G.keyword_rank(index, words, 10).select("qid", "path", F.col("score").cast("bigint").alias("score"), "rank")


# --- feedback and sets ------------------------------------------------------------------------


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events", "event_id", "ts", "event_type").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "event_type", _text("prompt ", [F.col("event_id")]).alias("prompt_text"), _text("answer ", [F.col("event_id") % 9]).alias("rejected_text"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    e, i = _feedback(spark, d), F.col("id")
    raw = F.when(i % 6 == 0, "short").when(i % 6 == 1, F.col("rejected_text")).otherwise(_text("a better answer ", [i]))
    return FB.teacher_labels(e.where(i % 2 == 0), e.select("id", raw.alias("raw")), "m", "run")


@query("""
select event_id as id from events where cast(ts as date) between date '2024-01-08' and date '2024-01-14' and not (event_id % 2 = 0 and event_id % 6 <> 0)""")
def feedback_without_label(spark, d):
    """J-8, L-30, P-30: events of a week whose label is missing or not accepted."""
    return FB.unlabelled(_feedback(spark, d), _labels(spark, d), "2024-01-08", "2024-01-14").select("id")


@query("""
select event_id as feedback_id, 'new' as teacher_run_id, 'accepted' as qc_status from events where event_id % 6 = 0
union all select event_id, 'run', 'accepted' from events where event_id % 6 in (2, 4)
union all select event_id, 'new', 'accepted' from events where event_id % 12 = 2""")
def labels_replaced(spark, d):
    """K-21: a new label takes the place of one that was not accepted; accepted ones stay."""
    old = _labels(spark, d)
    new = old.where("feedback_id % 6 = 0 or feedback_id % 12 = 2").withColumns({"teacher_run_id": F.lit("new"), "qc_status": F.lit("accepted")})
    return FB.replace_unaccepted(old, new).select("feedback_id", "teacher_run_id", "qc_status")


@query("""
select event_id as feedback_id, 'prompt ' || event_id as prompt, 'a better answer ' || event_id as chosen, 'answer ' || (event_id % 9) as rejected from events
where event_id % 6 in (2, 4) and cast(ts as date) between date '2024-01-08' and date '2024-01-14'""")
def preference_pairs(spark, d):
    """J-9, K-18: accepted labels of a week with their prompts."""
    labels = _labels(spark, d).withColumn("labeled_at", F.lit("2024-01-15"))
    return FB.preference_rows(_feedback(spark, d), labels, "2024-01-08", "2024-01-14")
