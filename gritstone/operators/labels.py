"""Label builders: scorer, reasoner, planner, patcher, critic. Teacher answers come from a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .issues import band_fixed, programmatic_score

PATCH_CHARS = 8192
COST_PER_SNAPSHOT = {"scorer": 0.0005, "reasoner": 0.004, "planner": 0.0, "patcher": 0.0, "critic": 0.001}


def _teacher(s: DataFrame, answers: DataFrame, model: str) -> DataFrame:
    """X-4: the teacher's text of each snapshot; of several the first in text order."""
    t = answers.where(F.col("model") == model).groupBy("issue_number", "snapshot_tier").agg(F.min("raw").alias("raw"))
    return s.join(t, ["issue_number", "snapshot_tier"], "left")


def scorer_labels(s: DataFrame, answers: DataFrame, fraction: float = 0.2) -> DataFrame:
    """L-15: programmatic score; sampled snapshots with an answer blend in the teacher's adjustment."""
    t = _teacher(programmatic_score(s), answers, "scorer")
    asked = (X.hash_percent(F.col("issue_number")) < F.lit(fraction * 100)) & F.col("raw").isNotNull()
    adjustment = F.when(asked, X.teacher_adjustment(F.col("raw"))).otherwise(0.0)
    score = F.when(asked, X.blended_score(F.col("prog_score"), adjustment)).otherwise(F.col("prog_score"))
    label = F.struct(
        score.alias("score"), F.array_position(F.array(*map(F.lit, ("low", "medium", "high"))), band_fixed(score)).cast("int").alias("band"), band_fixed(score).alias("band_name"),
        F.col("prog_score").alias("programmatic_score"), adjustment.alias("adjustment"), F.when(asked, "hybrid").otherwise("programmatic").alias("label_source"),
        F.when(asked, X.teacher_reason(F.col("raw"))).otherwise("").alias("reasoning"),
    )
    return t.select("issue_number", "snapshot_tier", F.lit("scorer").alias("model"), scorer_input().alias("input"), label.alias("label"))


def scorer_input() -> Column:
    """F-47: the scorer's prompt: facts, body, first and last three comments; closure signals stripped."""
    c = F.array_sort("comments", lambda a, b: F.when(F.coalesce(a.created_at, F.lit("")) < F.coalesce(b.created_at, F.lit("")), -1).when(F.coalesce(a.created_at, F.lit("")) > F.coalesce(b.created_at, F.lit("")), 1).otherwise(0))
    n = F.size(c)
    part = F.when(n <= 6, c).otherwise(F.concat(F.slice(c, 1, 3), F.slice(c, F.greatest(n - 2, F.lit(1)), 3)))
    said = F.array_join(F.transform(part, lambda x: F.concat(F.lit("- "), X.truncate(x.body, 300))), "\n")
    facts = F.concat_ws("\n", F.concat(F.lit("TITLE: "), F.coalesce("title", F.lit(""))), F.concat(F.lit("DAYS_OPEN: "), F.col("days_open").cast("string")), F.concat(F.lit("LABELS: "), F.array_join("labels", ", ")), F.concat(F.lit("COMMENTS: "), F.col("comment_count").cast("string")))
    return X.strip_closure_signals(F.concat_ws("\n", facts, X.truncate(F.col("issue.body"), 2000), said))


def reasoner_labels(s: DataFrame, answers: DataFrame, scores: DataFrame) -> DataFrame:
    """L-16, J-6: the teacher's narrative with the scorer's score (0.0 where there is none; of several the latest given)."""
    t = _teacher(s, answers, "reasoner").join(scores.select("issue_number", "snapshot_tier", F.col("label.score").alias("score")), ["issue_number", "snapshot_tier"], "left")
    score = F.coalesce("score", F.lit(0.0))
    label = F.struct(F.col("raw").alias("narrative"), score.alias("score"), band_fixed(score).alias("band_name"), X.cross_references(F.col("timeline")).alias("references"))
    return t.where("raw is not null").select("issue_number", "snapshot_tier", F.lit("reasoner").alias("model"), scorer_input().alias("input"), label.alias("label"))


def resolving_pr(prs: Column) -> Column:
    """L-19: the first change merged or closed, else the first; null without changes."""
    done = F.filter(prs, lambda p: p.pr.merged_at.isNotNull() | (p.pr.state == "closed"))
    return F.coalesce(F.get(done, F.lit(0)), F.get(prs, F.lit(0)))


def planner_labels(s: DataFrame) -> DataFrame:
    """L-17: files, their directories, kinds of change, first lines of commits, and a summary."""
    p = s.withColumn("p", resolving_pr(F.col("linked_prs"))).where("p is not null")
    files = F.coalesce(F.col("p.files"), F.array())
    names = F.transform(files, lambda f: f.filename)
    dirs = F.array_sort(F.array_distinct(F.transform(names, lambda x: F.when(x.contains("/"), F.regexp_replace(x, "/[^/]*$", "")).otherwise("."))))
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform(files, lambda f: f.status), lambda x: x.isNotNull())))
    commits = F.filter(F.transform(F.coalesce(F.col("p.commits"), F.array()), lambda c: F.get(F.split(c.commit.message, "\n"), F.lit(0))), lambda x: x.isNotNull() & (x != ""))
    label = F.struct(names.alias("files"), dirs.alias("directories"), kinds.alias("change_types"), commits.alias("commits"), F.array_join(commits, " → ").alias("summary"))
    return p.where(F.size(names) > 0).select("issue_number", "snapshot_tier", F.lit("planner").alias("model"), scorer_input().alias("input"), label.alias("label"))


def patcher_labels(s: DataFrame) -> DataFrame:
    """L-18: patches, long ones cut with a mark, and totals."""
    p = s.withColumn("p", resolving_pr(F.col("linked_prs"))).where("p is not null")
    files = F.filter(F.coalesce(F.col("p.files"), F.array()), lambda f: f.patch.isNotNull() & (f.patch != ""))
    cut = lambda x: F.when(F.length(x) > PATCH_CHARS, F.concat(F.left(x, F.lit(PATCH_CHARS)), F.lit("\n... [truncated]"))).otherwise(x)
    total = lambda c: F.aggregate(files, F.lit(0).cast("bigint"), lambda a, f: a + F.coalesce(f[c], F.lit(0)))
    label = F.struct(
        F.transform(files, lambda f: F.struct(f.filename.alias("filename"), f.status.alias("status"), cut(f.patch).alias("patch"))).alias("patches"),
        total("additions").alias("additions"), total("deletions").alias("deletions"), F.size(files).alias("n_files"),
    )
    return p.where(F.size(files) > 0).select("issue_number", "snapshot_tier", F.lit("patcher").alias("model"), scorer_input().alias("input"), label.alias("label"))


def review_verdict(pr: Column, reviews: Column) -> Column:
    """L-20: ACCEPT, REVISE, REJECT or null from reviews. As in the reference REJECT needs a change that is neither merged nor closed."""
    has = lambda state: F.exists(F.coalesce(reviews, F.array()), lambda r: F.coalesce(r.state == state, F.lit(False)))
    done = pr.merged_at.isNotNull() | F.coalesce(pr.state == "closed", F.lit(False))
    return (
        F.when(has("APPROVED") & ~has("CHANGES_REQUESTED"), "ACCEPT").when(has("CHANGES_REQUESTED") & done, "REVISE")
        .when(has("CHANGES_REQUESTED"), "REJECT").when(has("DISMISSED"), "REVISE")
    )


def critic_labels(s: DataFrame, answers: DataFrame, fraction: float = 0.3) -> DataFrame:
    """L-20, L-21: a verdict from reviews, else (sampled) the teacher's, if its JSON holds one."""
    t = _teacher(s.withColumn("p", resolving_pr(F.col("linked_prs"))).where("p is not null"), answers, "critic")
    real = review_verdict(F.col("p.pr"), F.col("p.reviews"))
    said = F.from_json(X.json_object(F.col("raw")), "verdict string, reasoning string")
    made = F.when((X.hash_percent(F.col("issue_number")) < F.lit(fraction * 100)) & said.verdict.isin("ACCEPT", "REVISE", "REJECT"), said.verdict)
    excerpts = F.transform(F.slice(F.coalesce(F.col("p.reviews"), F.array()), 1, 5), lambda r: F.struct(F.coalesce(r.user.login, F.lit("?")).alias("reviewer"), r.state.alias("state"), X.truncate(r.body, 300).alias("body")))
    label = F.struct(F.coalesce(real, made).alias("verdict"), F.when(real.isNotNull(), "real_review").otherwise("synthetic").alias("label_source"), F.when(real.isNull(), said.reasoning).alias("reasoning"), excerpts.alias("reviews"))
    return t.where(F.coalesce(real, made).isNotNull()).select("issue_number", "snapshot_tier", F.lit("critic").alias("model"), scorer_input().alias("input"), label.alias("label"))


#: X-1, L-23: builders by model, each (snapshots with changes, answers) -> labels.
BUILDERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "scorer": scorer_labels, "planner": lambda s, _: planner_labels(s), "patcher": lambda s, _: patcher_labels(s), "critic": critic_labels,
    "reasoner": lambda s, a: reasoner_labels(s, a, scorer_labels(s, a)),
}


#: Parts of changes that a builder reads, for ``attach_prs``; the others need not move.
PARTS = {"planner": ("files", "commits"), "patcher": ("files",), "critic": ("reviews",)}


def build_labels(model: str, s: DataFrame, answers: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """L-22, K-8: labels of snapshots that are not labelled yet."""
    if model not in BUILDERS:
        raise ValueError(f"no label builder for {model}")
    todo = s if done is None else s.join(done.select("issue_number", "snapshot_tier").distinct(), ["issue_number", "snapshot_tier"], "left_anti")
    return BUILDERS[model](todo, answers)


def label_statistics(labels: DataFrame) -> DataFrame:
    """L-25."""
    return labels.groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("issue_number").alias("issues"))


def cost_estimate(s: DataFrame, per: dict[str, float] = COST_PER_SNAPSHOT) -> DataFrame:
    """L-24: cost by model from the number of snapshots."""
    n = s.agg(F.count("*").alias("n"))
    return n.select(F.explode(F.create_map(*[x for k, v in per.items() for x in (F.lit(k), F.col("n") * v)])).alias("model", "cost"))


#: The timeline events a reasoner sees.
REASONER_EVENTS = ("assigned", "labeled", "cross-referenced", "review_requested")


def reasoner_timeline(timeline: Column) -> Column:
    """P-29: only the events a reasoner sees; null is empty."""
    return F.filter(F.coalesce(timeline, F.array()), lambda e: e.event.isin(*REASONER_EVENTS))


def review_text(prs: Column, reviews_chars: int = 600, inline_chars: int = 400) -> Column:
    """O-12: (reviews, inline) of an array of change records: a line for each text that is not blank, in order, then cut.

    Signals of the outcome are stripped; a review gives 300 characters, an inline comment 200.
    """
    said = lambda x: F.trim(F.coalesce(x.body, F.lit(""))) != ""
    clean = lambda x, n: F.left(X.strip_closure_signals(F.trim(x.body)), F.lit(n))
    who = lambda x: F.coalesce(x.user.login, F.lit("?"))
    or_none = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def of_reviews(pr: Column) -> Column:
        number = F.coalesce(pr.pr_number.cast("string"), F.lit("?"))
        line = lambda r: F.concat(F.lit("[PR #"), number, F.lit(" \u2014 "), or_none(r.state), F.lit(" by "), who(r), F.lit("]: "), clean(r, 300))
        return F.transform(F.filter(F.coalesce(pr.reviews, F.array()), said), line)

    def of_inline(pr: Column) -> Column:
        at = lambda c: F.coalesce(F.when(c.line != 0, c.line), c.original_line)
        line = lambda c: F.concat(F.lit("["), who(c), F.lit(" on "), or_none(c.path), F.lit(":"), or_none(at(c)), F.lit("]: "), clean(c, 200))
        return F.transform(F.filter(F.coalesce(pr.review_comments, F.array()), said), line)

    joined = lambda f, n: F.left(F.array_join(F.flatten(F.transform(F.coalesce(prs, F.array()), f)), "\n"), F.lit(n))
    return F.struct(joined(of_reviews, reviews_chars).alias("reviews"), joined(of_inline, inline_chars).alias("inline"))
