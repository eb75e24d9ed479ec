"""Issues and changes: cleaning, links, snapshots as of a date, programmatic scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.times import boundary_days, elapsed_days, max_gap_days, parse_ts, whole_days
from .relational import free

# Timeline events that snapshots keep.
KEEP_EVENTS = (
    "labeled", "unlabeled", "assigned", "unassigned", "cross-referenced", "connected", "review_requested", "review_request_removed",
    "commented", "committed", "milestoned", "demilestoned", "renamed", "locked", "unlocked", "merged", "closed", "reopened",
    "marked_as_duplicate", "unmarked_as_duplicate", "transferred",
)
# Ages (days) at which the age signals saturate, by module; they differ on purpose.
SCORER_P90_DAYS, BATCH_P75_DAYS, BATCH_MAX_LIFE_DAYS = 22, 82, 528
TIERS_SCORE, TIERS_SNAPSHOT, TIERS_DAG = (1, 7, 14, 28, 45, 60), (7, 15, 22, 29, 36, 44), (7, 14)


def is_bot(user: Column) -> Column:
    """P-1: type Bot, or a login that ends in [bot]; no user is no bot."""
    return F.coalesce(user.type == "Bot", F.lit(False)) | F.coalesce(user.login.endswith("[bot]"), F.lit(False))


def bot_report(df: DataFrame, user: Column) -> DataFrame:
    """P-2, A-2: removed rows by login."""
    return df.where(is_bot(user)).groupBy(user.login.alias("login")).agg(F.count("*").alias("n"))


def label_names(labels: Column) -> Column:
    """P-6."""
    return F.transform(F.filter(F.coalesce(labels, F.array()), lambda x: x["name"].isNotNull() & (x["name"] != "")), lambda x: x["name"])


def ci_conclusion(runs: Column) -> Column:
    """P-7: none, success, failure or mixed."""
    c = F.filter(F.transform(F.coalesce(runs, F.array()), lambda r: r.conclusion), lambda x: x.isNotNull() & (x != ""))
    return (
        F.when(F.size(c) == 0, "none").when(F.forall(c, lambda x: x == "success"), "success")
        .when(F.exists(c, lambda x: x.isin("failure", "timed_out", "cancelled")), "failure").otherwise("mixed")
    )


def silent_reviewers(requested: Column, reviews: Column) -> Column:
    """P-8: requested logins without a review, in request order."""
    done = F.filter(F.transform(F.coalesce(reviews, F.array()), lambda r: r.user.login), lambda x: x.isNotNull())
    return F.filter(F.transform(F.coalesce(requested, F.array()), lambda u: u.login), lambda x: ~F.array_contains(done, x))


def flatten_issues(df: DataFrame, title_chars: int = 2000) -> DataFrame:
    """P-3, P-5: one flat row an issue."""
    i = F.col("issue")
    created, closed = parse_ts(i.created_at), parse_ts(i.closed_at)
    return df.select(
        "issue_number", "repo", F.left(F.coalesce(i.title, F.lit("")), F.lit(title_chars)).alias("title"), i.state.alias("state"),
        F.length(F.coalesce(i.body, F.lit(""))).alias("body_length"), label_names(i.labels).alias("labels"), i.milestone.isNotNull().alias("has_milestone"),
        i.milestone.title.alias("milestone"), F.size(F.coalesce(i.assignees, F.array())).alias("assignee_count"),
        F.size(F.coalesce(F.col("comments"), F.array())).alias("comment_count"), F.size(F.coalesce(F.col("linked_pr_numbers"), F.array())).alias("linked_pr_count"),
        boundary_days(created, closed).alias("days_open"), created.alias("created_at"), closed.alias("closed_at"), F.to_json(F.struct("*")).alias("raw_json"),
    )


def flatten_prs(df: DataFrame, title_chars: int = 2000) -> DataFrame:
    """P-4, P-5: one flat row a change."""
    p = F.col("pr")
    created, merged = parse_ts(p.created_at), parse_ts(p.merged_at)
    size = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    return df.select(
        "pr_number", "repo", F.left(F.coalesce(p.title, F.lit("")), F.lit(title_chars)).alias("title"), p.state.alias("state"), merged.isNotNull().alias("is_merged"),
        normal_number(F.col("linked_issue_number")).alias("linked_issue_number"), size("files").alias("file_count"), size("reviews").alias("review_count"),
        (size("check_runs") > 0).alias("has_ci"), ci_conclusion(F.col("check_runs")).alias("ci_conclusion"), boundary_days(created, merged).alias("days_to_merge"),
        created.alias("created_at"), merged.alias("merged_at"), F.to_json(F.struct("*")).alias("raw_json"),
    )


def normal_number(x: Column) -> Column:
    """J-2: a number from text; None, null, empty and rubbish are null."""
    return F.trim(x).try_cast("double").cast("bigint")


def issue_pr_edges(issues: DataFrame, prs: DataFrame) -> DataFrame:
    """J-1: (issue, pr, source, seq) evidence from five sources; both ends known where the source demands it.

    ``source`` ranks 1 linked field, 2 the issue's list, 3 closing words in the change's body and
    title, 4 issue urls there, 5 closing words in the issue's text; ``seq`` orders within a source.
    """
    pid, iid = F.col("pr_number"), F.col("issue_number")
    said = prs.select(pid.alias("pr"), F.concat_ws("\n", "pr.title", "pr.body").alias("text"))  # texts alone, so that the rest of a change need not be made
    listed = issues.select(iid.alias("issue"), F.explode("linked_pr_numbers").alias("pr"), F.lit(2).alias("source"))
    closing = issues.select(iid.alias("issue"), F.explode(X.closing_links(X.link_text(F.col("issue.body"), F.col("comments")))).alias("pr"), F.lit(5).alias("source"))
    sources = [
        prs.select(normal_number(F.col("linked_issue_number")).alias("issue"), pid.alias("pr"), F.lit(1).alias("source")),
        listed.unionByName(closing).join(prs.select(pid.alias("pr")), "pr", "left_semi"),
        said.select(F.explode(X.closing_links_loose(F.col("text"))).alias("issue"), "pr", F.lit(3).alias("source")),
        said.select(F.explode(X.issue_url_links(F.col("text"))).alias("issue"), "pr", F.lit(4).alias("source")),
    ]
    out = sources[0].select("issue", "pr", "source")
    for s in sources[1:]:
        out = out.unionByName(s.select("issue", "pr", "source"))
    return out.where("issue is not null and pr is not null").join(issues.select(iid.alias("issue")), "issue", "left_semi")


def link_counts(edges: DataFrame) -> DataFrame:
    """J-1: matches by source, before they are made unique."""
    return edges.groupBy("source").agg(F.count("*").alias("matches"))


def link_map(edges: DataFrame) -> DataFrame:
    """J-1: each issue's changes, sorted."""
    return edges.select("issue", "pr").distinct().groupBy("issue").agg(F.array_sort(F.collect_list("pr")).alias("resolved_by_prs"))


def enrich(issues: DataFrame, prs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-2: issues with resolved_by_prs and has_linked_pr; changes with linked_issue_numbers and a filled linked_issue_number.

    The first linked issue is that of the first source, then of the smallest number.
    """
    i = issues.join(link_map(edges).withColumnRenamed("issue", "issue_number"), "issue_number", "left")
    i = i.withColumn("resolved_by_prs", F.coalesce("resolved_by_prs", F.array().cast("array<bigint>"))).withColumn("has_linked_pr", F.size("resolved_by_prs") > 0)
    (first,) = free(prs, "first")
    back = edges.groupBy(F.col("pr").alias("pr_number")).agg(
        F.array_sort(F.collect_set("issue")).alias("linked_issue_numbers"), F.min_by("issue", F.struct("source", "issue")).alias(first)
    )
    p = prs.join(back, "pr_number", "left").withColumn("linked_issue_numbers", F.coalesce("linked_issue_numbers", F.array().cast("array<bigint>")))
    return i, p.withColumn("linked_issue_number", F.coalesce(normal_number(F.col("linked_issue_number")), first)).drop(first)


def link_statistics(issues: DataFrame, prs: DataFrame) -> DataFrame:
    """A-3 to A-6: counts of linked and standalone rows, merges, CI and reviews."""
    a = issues.agg(F.count("*").alias("issues"), F.count_if("has_linked_pr").alias("with_pr"), F.count_if(~F.col("has_linked_pr")).alias("without_pr"))
    b = prs.agg(
        F.count("*").alias("prs"), F.count_if(F.size("linked_issue_numbers") > 0).alias("linked"), F.count_if(F.size("linked_issue_numbers") == 0).alias("standalone"),
        F.count_if(F.col("pr.merged_at").isNotNull()).alias("merged"), F.avg((F.size(F.coalesce(F.col("reviews"), F.array())) > 0).cast("int")).alias("share_reviewed"),
        *[F.count_if(ci_conclusion(F.col("check_runs")) == c).alias(f"ci_{c}") for c in ("none", "success", "failure", "mixed")],
    )
    return a.crossJoin(b)  # one row each


def timeline_links(timeline: Column, disconnected: bool = False) -> Column:
    """F-5: changes a timeline names."""
    kinds = ["connected", "disconnected"] if disconnected else ["connected"]
    hit = F.filter(
        F.coalesce(timeline, F.array()),
        lambda e: e.source.issue.number.isNotNull() & (((e.event == "cross-referenced") & e.source.issue.pull_request.isNotNull()) | e.event.isin(*kinds)),
    )
    return F.array_sort(F.array_distinct(F.transform(hit, lambda e: e.source.issue.number)))


def comments_asof(comments: Column, cut: Column) -> Column:
    """P-10."""
    return F.filter(F.coalesce(comments, F.array()), lambda c: F.coalesce(parse_ts(c.created_at) <= cut, F.lit(False)))


def timeline_asof(timeline: Column, cut: Column, keep: tuple[str, ...] | None = KEEP_EVENTS, keep_undated: bool = True) -> Column:
    """P-11 (dag form): up to the cut and of a kept kind; events without a readable date stay whatever their kind.

    P-13 (batch form): ``keep=None, keep_undated=False``: undated events go, all kinds stay.
    """

    def fits(e: Column) -> Column:
        ts = parse_ts(e.created_at)
        kind = e.event.isin(*keep) if keep else F.lit(True)
        return F.when(ts.isNull(), F.lit(keep_undated)).otherwise((ts <= cut) & F.coalesce(kind, F.lit(False)))

    return F.filter(F.coalesce(timeline, F.array()), fits)


def mask_closure(issue: Column) -> Column:
    """P-12: the issue as if still open."""
    null = F.lit(None)
    return (
        issue.withField("state", F.lit("open")).withField("closed_at", null.cast("string")).withField("state_reason", null.cast("string"))
        .withField("closed_by", F.lit(None).cast("struct<login: string>")).withField("updated_at", null.cast("string"))
    )


def snapshots(issues: DataFrame, tiers: tuple[int, ...] = TIERS_DAG, gate: str = "strict", batch_form: bool = False) -> DataFrame:
    """L-12, P-9 to P-16: each issue as of creation + N days, if it was open then. One scan, no shuffle.

    ``gate``: ``strict`` (P-15) needs closing after the cut; ``inclusive`` (P-16) takes closing at
    the cut as well, and drops lives over BATCH_MAX_LIFE_DAYS; ``closed`` (P-9) takes closed issues
    only, whatever their age.
    """
    i = issues.withColumns({"__created": parse_ts(F.col("issue.created_at")), "__closed": parse_ts(F.col("issue.closed_at"))}).where("__created is not null")
    s = i.withColumn("__tier", F.explode(F.array(*map(F.lit, tiers)))).withColumn("snapshot_date", F.col("__created") + F.make_dt_interval(F.col("__tier")))
    if gate == "strict":
        s = s.where("__closed is null or __closed > snapshot_date")
    elif gate == "inclusive":
        s = s.where("__closed is null or __closed >= snapshot_date").where(F.col("__closed").isNull() | (elapsed_days(F.col("__created"), F.col("__closed")) <= BATCH_MAX_LIFE_DAYS))
    elif gate == "closed":
        s = s.where((F.col("issue.state") == "closed") & F.col("__closed").isNotNull())
    else:
        raise ValueError("gate must be strict, inclusive or closed")
    comments = comments_asof(F.col("comments"), F.col("snapshot_date"))
    timeline = timeline_asof(F.col("timeline"), F.col("snapshot_date"), *((None, False) if batch_form else ()))
    s = s.withColumns({"comments": comments, "timeline": timeline})
    links = F.array_sort(F.array_union(timeline_links(F.col("timeline")), X.closing_links(X.link_text(F.col("issue.body"), F.col("comments")))))
    s = s.withColumns({"linked_pr_numbers": links, "issue": mask_closure(F.col("issue"))})
    return s.select(
        "issue_number", "repo", F.col("issue.title").alias("title"), F.lit("open").alias("state"), label_names(F.col("issue.labels")).alias("labels"),
        F.size(F.coalesce(F.col("issue.assignees"), F.array())).alias("assignee_count"), F.col("issue.milestone.title").alias("milestone"),
        F.size("comments").alias("comment_count"), F.size("linked_pr_numbers").alias("linked_pr_count"), F.col("__created").alias("created_at"),
        "snapshot_date", F.col("__tier").alias("days_open"), F.concat(F.lit("T+"), F.col("__tier").cast("string")).alias("snapshot_tier"),
        "issue", "comments", "timeline", "linked_pr_numbers", F.col("__closed").alias("final_closed_at"),
    )


def snapshot_report(s: DataFrame) -> DataFrame:
    """A-9."""
    return s.groupBy("snapshot_tier").agg(F.count("*").alias("n"), F.avg("comment_count").alias("avg_comments"), F.avg("linked_pr_count").alias("avg_prs"), F.count_if(F.col("linked_pr_count") > 0).alias("with_pr"), F.count_if(F.col("linked_pr_count") == 0).alias("without_pr"))


#: Parts of a change record beside its number and ``pr``.
PR_PARTS = ("reviews", "check_runs", "silent_reviewers", "files", "review_comments", "commits")


def attach_prs(s: DataFrame, prs: DataFrame, parts: tuple[str, ...] = PR_PARTS) -> DataFrame:
    """J-3: with each snapshot the changes linked to its issue and created by its date (left).

    ``parts`` are those of a change that the caller reads; others don't move. An issue's changes are
    gathered once, in order, and each of its snapshots takes those of its date: one shuffle by issue.
    """
    n, c, every = free(s, "n", "c", "every")
    p = prs.select(normal_number(F.col("linked_issue_number")).alias(n), parse_ts(F.col("pr.created_at")).alias(c), F.struct("pr_number", "pr", *parts).alias("x")).where(F.col(n).isNotNull() & F.col(c).isNotNull())
    got = p.groupBy(n).agg(F.array_sort(F.collect_list(F.struct(F.col(c).alias("c"), "x")), lambda a, b: a.x.pr_number.cast("int") - b.x.pr_number.cast("int")).alias(every))
    upto = F.transform(F.filter(every, lambda v: v.c <= F.col("snapshot_date")), lambda v: v.x)
    return s.join(got, F.col("issue_number") == F.col(n), "left").withColumn("linked_prs", F.coalesce(upto, F.array())).drop(n, every)


def official_prs(s: DataFrame, prs: DataFrame) -> DataFrame:
    """J-7: listed changes that existed by the date, with those found in text."""
    known = prs.select(F.col("pr_number").alias("n"), parse_ts(F.col("pr.created_at")).alias("c"))
    e = s.select("issue_number", "snapshot_tier", "snapshot_date", F.explode("linked_pr_numbers").alias("n")).join(known, "n").where("c <= snapshot_date")
    return e.groupBy("issue_number", "snapshot_tier").agg(F.array_sort(F.collect_set("n")).alias("official"))


def _any_pr(test) -> Column:
    return F.exists("linked_prs", lambda p: F.coalesce(test(p), F.lit(False)))


def scorer_signals() -> dict[str, Column]:
    """L-2 to L-10 over ``attach_prs``: each fires once a snapshot."""
    first_review = lambda p: F.array_min(F.transform(F.coalesce(p.reviews, F.array()), lambda r: parse_ts(r.submitted_at)))
    conclusions = lambda p: F.filter(F.transform(F.coalesce(p.check_runs, F.array()), lambda c: c.conclusion), lambda x: x.isNotNull() & (x != ""))
    times = F.concat(F.array("created_at", "snapshot_date"), F.transform("comments", lambda c: parse_ts(c.created_at)))
    moved = F.size(F.filter("timeline", lambda e: e.event.isin("assigned", "unassigned")))
    body = F.coalesce(F.col("issue.body"), F.lit(""))
    on = lambda c, w: F.when(c, w).otherwise(0.0)
    fired = {
        "resolution_days": F.when(F.col("days_open").isNull(), 0.0).otherwise(F.bround(F.least(F.col("days_open") / SCORER_P90_DAYS, F.lit(1.0)) * 0.4, 4)),
        "first_review": on(_any_pr(lambda p: whole_days(parse_ts(p.pr.created_at), first_review(p)) > 7), 0.15),
        "review_cycles": on(_any_pr(lambda p: F.size(F.coalesce(p.reviews, F.array())) > 3), 0.10),
        "closed_unmerged": on(_any_pr(lambda p: (F.lower(p.pr.state) == "closed") & p.pr.merged_at.isNull()), 0.15),
        "comment_gap": on(F.coalesce(max_gap_days(times, floor=True) > 14, F.lit(False)), 0.15),
        "assignee_change": on(moved > 1, 0.10),
        "no_review": on(_any_pr(lambda p: F.size(F.coalesce(p.silent_reviewers, F.array().cast("array<string>"))) > 0), 0.10),
        "sub_issues": on(body.contains("- [ ]") | body.contains("- [x]"), 0.05),
        "ci_failed": on(_any_pr(lambda p: F.exists(conclusions(p), lambda c: c.isin("failure", "timed_out", "cancelled")) & ~F.exists(conclusions(p), lambda c: c.isin("success", "neutral", "skipped"))), 0.15),
    }
    return fired


def programmatic_score(s: DataFrame) -> DataFrame:
    """L-1: the signals' sum within 0 and 1, as prog_score; the signals stay as columns."""
    sig = scorer_signals()
    out = s.withColumns({f"sig_{k}": c for k, c in sig.items()})
    return out.withColumn("prog_score", F.bround(X.clamp01(sum((F.col(f"sig_{k}") for k in sig), F.lit(0.0))), 4))


def batch_score(s: DataFrame, prs: DataFrame) -> DataFrame:
    """L-11: the batch form: signals as of the date, added for every change, 1 at most; age saturates at BATCH_P75_DAYS."""
    cut = F.col("snapshot_date")
    upto = lambda ts: F.coalesce(parse_ts(ts) <= cut, F.lit(False))
    e = s.select("issue_number", "snapshot_tier", "snapshot_date", F.explode(F.array_distinct("linked_pr_numbers")).alias("pr_number"))
    p = e.join(prs.select("pr_number", "pr", "reviews", "check_runs"), "pr_number").where(parse_ts(F.col("pr.created_at")) <= cut)
    reviews = F.filter(F.coalesce(F.col("reviews"), F.array()), lambda r: upto(r.submitted_at))
    first = F.array_min(F.transform(reviews, lambda r: parse_ts(r.submitted_at)))
    runs = F.filter(F.coalesce(F.col("check_runs"), F.array()), lambda c: upto(F.coalesce(c.completed_at, c.started_at)))
    merged = F.col("pr.merged_at").isNotNull() & ~F.col("pr.merged_at").isin("None", "null", "")
    on = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    each = (
        on(elapsed_days(parse_ts(F.col("pr.created_at")), first) > 7, 0.15) + on(F.size(reviews) > 3, 0.10) + on(upto(F.col("pr.closed_at")) & ~merged, 0.15)
        + on((F.size(F.coalesce(F.col("pr.requested_reviewers"), F.array())) > 0) & (F.size(reviews) == 0), 0.10)
        + on(F.exists(runs, lambda c: c.conclusion.eqNullSafe("failure")) & ~F.exists(runs, lambda c: c.conclusion.eqNullSafe("success")), 0.15)
    )
    by_pr = p.select("issue_number", "snapshot_tier", each.alias("w")).groupBy("issue_number", "snapshot_tier").agg(F.sum("w").alias("pr_score"))
    times = F.transform("comments", lambda c: parse_ts(c.created_at))
    gap = F.when(F.size("comments") >= 2, max_gap_days(times)).when(F.size("comments") == 1, elapsed_days(F.array_min(times), cut))
    own = (
        F.least(F.col("days_open") / BATCH_P75_DAYS, F.lit(1.0)) * 0.4 + on(gap > 14, 0.15) + on(F.size(F.filter("timeline", lambda e: e.event == "assigned")) > 1, 0.10)
        + on(F.exists("timeline", lambda e: e.event == "added_to_project"), 0.05)
    )
    out = s.join(by_pr, ["issue_number", "snapshot_tier"], "left")
    return out.withColumn("prog_score", F.least(F.lit(1.0), own + F.coalesce("pr_score", F.lit(0.0)))).drop("pr_score")


def band_fixed(score: Column) -> Column:
    """L-13."""
    return F.when(score < 0.35, "low").when(score < 0.65, "medium").otherwise("high")


def band_quantile(df: DataFrame, score: str, thresholds: DataFrame) -> DataFrame:
    """L-14: Low up to p33, Medium up to p66, else High; ``thresholds`` is one row (A-12)."""
    band = F.when(F.col(score) <= F.col("p33"), "Low").when(F.col(score) <= F.col("p66"), "Medium").otherwise("High")
    return df.crossJoin(F.broadcast(thresholds.select("p33", "p66"))).withColumn("band", band).drop("p33", "p66")


def feature_row(issues: DataFrame) -> DataFrame:
    """P-31, D25: scalar features of an issue for online scoring."""
    i, body = F.col("issue"), F.coalesce(F.col("issue.body"), F.lit(""))
    created = parse_ts(i.created_at)
    first = lambda kinds: F.array_min(F.transform(F.filter(F.coalesce("timeline", F.array()), lambda e: e.event.isin(*kinds)), lambda e: parse_ts(e.created_at)))
    return issues.select(
        "issue_number", "repo", F.length(i.title).alias("title_length"), F.length(body).alias("body_length"), body.rlike("```").alias("has_code"),
        body.rlike(r"(?i)traceback|stack ?trace").alias("has_trace"), body.rlike(r"(?i)steps to reproduce|how to reproduce").alias("has_steps"),
        F.size(label_names(i.labels)).alias("n_labels"), F.size(F.coalesce(F.col("comments"), F.array())).alias("n_comments"),
        F.size(F.array_distinct(F.transform(F.coalesce(F.col("comments"), F.array()), lambda c: c.user.login))).alias("n_commenters"),
        (elapsed_days(created, F.array_min(F.transform(F.coalesce(F.col("comments"), F.array()), lambda c: parse_ts(c.created_at)))) * 24).alias("hours_to_first_comment"),
        (elapsed_days(created, first(("labeled",))) * 24).alias("hours_to_first_label"), (elapsed_days(created, first(("assigned",))) * 24).alias("hours_to_first_assignment"),
        F.hour(created).alias("created_hour"), F.dayofweek(created).alias("day_of_week"), F.dayofweek(created).isin(1, 7).alias("weekend"),
    )


def risk_ranking(df: DataFrame, score: str, key: str, n: int = 5) -> DataFrame:
    """O-3: the top ``n`` by score; a reason is asked for from 0.65 on."""
    return df.orderBy(F.desc(score), key).limit(n).withColumns({"band": band_fixed(F.col(score)), "wants_reason": F.col(score) >= 0.65})
