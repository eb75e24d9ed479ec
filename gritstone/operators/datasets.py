"""Training sets: planner, critic and patcher examples, their gates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import diffs as D
from ..functions import text as X
from .relational import free
from .sampling import balanced_sample, scarcest_cap, seeded

EXTENSIONS = ("py", "md", "rst", "yaml", "yml", "toml", "cfg", "ini", "sh", "ts", "tsx", "js", "json", "sql", "txt")
NO_FINDINGS = {"one": "single file", "tests": "has tests", "clean": "clean patch"}


def allowed_path(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """P-19: an allowed ending (of ASCII letters and digits), or a bare dockerfile, in small letters or not (the Kelvin sign is a K)."""
    return F.coalesce(path.rlike(rf"(?i)\.(?:{'|'.join(extensions)})$|(^|/)doc[k\u212a]erfile$"), F.lit(False))


def is_test_path(path: Column) -> Column:
    """P-20."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    return p.rlike(r"/(tests|test|testing)/") | name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py") | (name.startswith("test") & name.endswith(".py"))


def is_noisy_path(path: Column) -> Column:
    """P-28."""
    return F.lower(path).rlike(r"(^|/)(changelog|newsfragments|docs|images?|node_modules|dist|build|vendor)(/|$)|\.(lock|svg|png|min\.js)$|(package-lock\.json|yarn\.lock)$")


def has_allowed_patch(files: Column) -> Column:
    """P-18."""
    return F.exists(F.coalesce(files, F.array()), lambda f: allowed_path(f.filename) & f.patch.isNotNull() & (f.patch != ""))


def count_text(text: Column, part: str) -> Column:
    """P-17: how often a fixed string is in a text."""
    t = F.coalesce(text, F.lit(""))
    return ((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)).cast("int")


def cheap_prefilter(prs: DataFrame, additions: int = 350, tokens: int = 1200, files: int = 3) -> DataFrame:
    """P-17: small enough to be worth building; before anything costly."""
    text = F.array_join(F.transform(F.coalesce("files", F.array()), lambda f: F.coalesce(f.patch, F.lit(""))), "\n")
    named = count_text(F.to_json(F.struct("files")), '"filename"')
    return prs.where(F.coalesce(F.col("pr.additions"), F.lit(0)) <= additions).where(X.word_tokens(text) <= tokens).where(named <= files).where(has_allowed_patch(F.col("files")))


def drop_reason(files: Column, additions: Column, max_files: int = 3, max_additions: int = 350, max_tokens: int = 1200) -> Column:
    """P-21: the first gate a record fails; null if none."""
    fs = F.coalesce(files, F.array())
    text = F.array_join(F.transform(fs, lambda f: F.coalesce(f.patch, F.lit(""))), "\n")
    kept = F.filter(fs, lambda f: allowed_path(f.filename) & f.patch.isNotNull() & (f.patch != ""))
    return (
        F.when(F.size(fs) == 0, "no_files_json").when(F.size(kept) == 0, "no_allowed_patch").when(F.size(fs) > max_files, "too_many_files")
        .when(F.coalesce(additions, F.lit(0)) > max_additions, "too_many_additions").when(X.word_tokens(text) > max_tokens, "too_many_patch_tokens")
        .when(F.exists(kept, lambda f: ~f.patch.rlike("(?md)" + D.HUNK)), "invalid_unified_diff")
    )


def drop_report(df: DataFrame, reason: str = "reason") -> DataFrame:
    """P-21, A-18: rows by reason."""
    return df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    """P-22."""
    return [c for c in needed if c not in df.columns]


def validation_errors(df: DataFrame) -> DataFrame:
    """P-23: an array of error codes a record (id, base_sha, diff, touched_files, allowed_edit_files)."""
    (twice,) = free(df, "twice")
    n = df.groupBy("id").agg((F.count("*") > 1).alias(twice))
    d = df.join(n, "id", "left")
    code = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    errors = F.array_compact(F.array(
        code(F.col("id").isNull() | (F.col("id") == ""), "missing_id"), code(F.col(twice), "duplicate_id"), code(~F.coalesce(F.col("base_sha"), F.lit("")).rlike("^[0-9a-f]{40}$"), "bad_sha"),
        code(~D.is_git_diff(F.col("diff")), "not_unified"), code(F.size("allowed_edit_files") <= 0, "no_allowed_files"), code(F.size(F.array_except("touched_files", "allowed_edit_files")) > 0, "touched_outside_allowed"),
    ))
    return d.withColumn("errors", errors).drop(twice)


def sanitize_prs(raw: Column) -> Column:
    """P-24: only the safe fields of a JSON list of changes."""
    return F.from_json(raw, "array<struct<number: bigint, title: string, state: string, merged: boolean, additions: bigint, deletions: bigint, changed_files: bigint>>")


def compress_comments(comments: Column, n: int = 3, chars: int = 100) -> Column:
    """P-25: the first comments on a line each, and how many more there are."""
    c = F.coalesce(comments, F.array())
    lines = F.transform(F.slice(c, 1, n), lambda x: F.concat(F.lit("- "), F.left(X.collapse(F.coalesce(x.body, F.lit(""))), F.lit(chars))))
    more = F.when(F.size(c) > n, F.array(F.concat(F.lit("+"), (F.size(c) - n).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(lines, more), "\n")


def critic_examples(prs: DataFrame, friction: DataFrame | None = None, cap: int = 250, seed: int = 42) -> DataFrame:
    """L-26, P-26: reject, revise and accept examples, as many of each as the rarest, in seeded order.

    A rejected change is closed unmerged with a substantial change request or inline comment; a
    revised one is merged with one; an accepted one is merged without. No approval is asked for.
    """
    reviews, inline = F.coalesce("reviews", F.array()), F.coalesce("review_comments", F.array())
    asked = F.filter(reviews, lambda r: (r.state == "CHANGES_REQUESTED") & (F.length(F.coalesce(r.body, F.lit(""))) > 20))
    notes = F.filter(inline, lambda c: c.diff_hunk.isNotNull() & (c.diff_hunk != "") & (F.length(F.coalesce(c.body, F.lit(""))) > 20) & ~c.body.startswith("```"))
    any_note = F.exists(inline, lambda c: c.diff_hunk.isNotNull() & (c.diff_hunk != "") & (F.length(F.coalesce(c.body, F.lit(""))) > 20))
    first = lambda a: F.get(a, F.lit(0)).body
    merged, closed = F.col("pr.merged_at").isNotNull(), F.col("pr.state") == "closed"
    p = prs.where(F.exists(F.coalesce("files", F.array()), lambda f: f.patch.isNotNull() & (f.patch != "")))
    p = p.withColumns({"__asked": asked, "__notes": notes})
    clean = F.when(F.size("files") == 1, NO_FINDINGS["one"]).when(F.exists("files", lambda f: F.lower(f.filename).contains("test")), NO_FINDINGS["tests"]).otherwise(NO_FINDINGS["clean"])
    label = (
        F.when(~merged & closed & ((F.size("__asked") > 0) | (F.size("__notes") > 0)), "REJECT").when(merged & ((F.size("__asked") > 0) | (F.size("__notes") > 0)), "REVISE")
        .when(merged & ~F.exists(reviews, lambda r: r.state.eqNullSafe("CHANGES_REQUESTED")) & ~any_note, "ACCEPT")
    )
    why = F.when(F.col("label") == "REJECT", F.coalesce(first(F.col("__asked")), first(F.col("__notes")))).when(F.col("label") == "REVISE", F.coalesce(first(F.col("__notes")), first(F.col("__asked")))).otherwise(clean)
    rows = p.withColumn("label", label).where("label is not null").withColumn("reasoning", F.left(why, F.lit(400)))
    rows = rows.withColumn("hunk", D.first_hunk(F.get(F.filter("files", lambda f: f.patch.isNotNull() & (f.patch != "")), F.lit(0)).patch, True))
    few = scarcest_cap(rows.select("pr_number", "label", "pr.title", "reasoning", "hunk", F.transform("files", lambda f: f.filename).alias("files")), "pr_number", "label", cap, seed)
    if friction is not None:
        said = few.select("pr_number", F.explode("files").alias("filename")).join(friction, "filename").groupBy("pr_number").agg(F.array_join(F.array_sort(F.collect_set("friction")), "\n").alias("friction"))
        few = few.join(said, "pr_number", "left")
    else:
        few = few.withColumn("friction", F.lit(None).cast("string"))
    prompt = F.concat_ws("\n", F.concat(F.lit("PR: "), F.coalesce("title", F.lit(""))), F.concat(F.lit("HISTORY: "), F.coalesce("friction", F.lit("none"))), F.concat(F.lit("DIFF:\n"), F.coalesce("hunk", F.lit(""))))
    out = F.concat(F.lit("VERDICT: "), F.col("label"), F.lit("\nREASONING: "), F.col("reasoning"))
    return few.select("pr_number", "label", prompt.alias("input"), out.alias("output")).orderBy(seeded("pr_number", seed))


def planner_examples(yes: DataFrame, no: DataFrame, ranked: DataFrame, confidence: DataFrame, n: int = 1500, seed: int = 42) -> DataFrame:
    """L-27: samples with and without a change, with retrieved files and a confidence, as prompt and target."""
    files = ranked.groupBy(F.col("qid").alias("number")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "filename"))), lambda x: x.filename).alias("retrieved"))
    plan = X.clean_pr_body(F.array_join("pr_bodies", "\n"))
    a = yes.where(F.size("files") > 0).select("number", "title", "body", "files", plan.alias("plan"), F.lit("YES").alias("label"))
    b = no.select("number", "title", "body", F.array().cast("array<string>").alias("files"), X.no_change_reason(F.col("title"), F.col("body")).alias("plan"), F.lit("NO").alias("label"))
    rows = balanced_sample(a.unionByName(b).where("plan <> ''"), "number", "label", n, seed)
    rows = rows.join(files, "number", "left").join(confidence.select(F.col("qid").alias("number"), "confidence"), "number", "left")
    prompt = F.concat_ws("\n", F.concat(F.lit("ISSUE: "), F.coalesce("title", F.lit(""))), X.truncate(F.col("body"), 800), F.concat(F.lit("RELATED: "), F.array_join(F.coalesce("retrieved", F.array().cast("array<string>")), ", ")), F.concat(F.lit("CONFIDENCE: "), F.coalesce("confidence.bucket", F.lit("LOW"))))
    target = F.concat_ws("\n", F.concat(F.lit("REQUIRES_CODE_CHANGE: "), F.col("label")), F.when(F.col("label") == "YES", F.concat(F.lit("FILES: "), F.array_join("files", ", "))), F.concat(F.lit("PLAN: "), F.left("plan", F.lit(600))))
    return rows.select("number", "label", prompt.alias("input"), target.alias("output"), X.chat_prompt(F.lit("You plan changes."), prompt, target).alias("text"))


def coverage(df: DataFrame) -> DataFrame:
    """A-16, A-17: samples by label with retrieved context, token sizes, missing parts."""
    return df.groupBy("label").agg(
        F.count("*").alias("n"), F.round(100.0 * F.avg((~F.col("input").rlike(r"(?m)^RELATED: *$")).cast("int")), 2).alias("pct_with_context"),
        F.avg(X.approx_tokens(F.col("text"))).alias("avg_tokens"), F.count_if(~F.contains("output", F.lit("PLAN:"))).alias("missing_plan"),
    )


def patcher_examples(prs: DataFrame, blobs: DataFrame) -> DataFrame:
    """L-29: single-file changes whose patch applies to the base text: windows, numbered text, target diff.

    Cheap gates come first (the number of files, then those that read texts), Python (applying, compiling) last and only on what they leave.
    """
    few = cheap_prefilter(prs.where(F.size("files").between(1, 3))).where(drop_reason(F.col("files"), F.col("pr.additions")).isNull())
    f = few.select("pr_number", F.col("pr.title").alias("title"), F.col("pr.base.sha").alias("sha"), F.explode("files").alias("f")).select("pr_number", "title", "sha", X.normalize_path(F.col("f.filename")).alias("path"), "f.patch").where(allowed_path(F.col("path")) & (F.col("patch") != ""))
    t = f.join(blobs, ["sha", "path"]).where(D.fits_udf("text", "patch", F.coalesce(F.col("path").endswith(".py"), F.lit(False))))
    lines, heads, windows = "__lines", "__heads", "__windows"  # each is made once a row, however often it is used
    t = t.withColumns({lines: F.split("text", "\n"), heads: D.hunk_headers(F.col("patch"))}).withColumn(windows, D.primary_windows(F.size(lines), F.col(heads)))
    shown = F.array_join(F.transform(windows, lambda w: D.numbered_lines(F.col(lines), w.lo, w.hi)), "\n...\n")
    meta = F.struct(F.col(heads).alias("hunks"), F.col(windows).alias("windows"), is_test_path(F.col("path")).alias("is_test"), X.word_tokens(F.col("patch")).alias("patch_tokens"))
    return t.select("pr_number", "path", F.concat_ws("\n", F.concat(F.lit("TASK: "), "title"), F.concat(F.lit("FILE: "), "path"), shown).alias("input"), F.col("patch").alias("output"), meta.alias("meta"))


def with_code_context(examples: DataFrame, structural: DataFrame, supporting: DataFrame, task: str = "pr_number", path: str = "path") -> DataFrame:
    """L-29 with F-31 and F-32: ``examples`` with ``structural`` (symbol windows of the file) and ``supporting`` (files that help), in rank order.

    ``structural`` is (task, path, rank, symbol, ..., touched), ``supporting`` (task, rank, path, source, ...), both of
    bounded size for each example. An example without any has empty arrays.
    """

    def gathered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in (*keys, "rank")]
        return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", *rest))).alias(name))

    s, t = gathered(structural, [task, path], "structural"), gathered(supporting.withColumnsRenamed({path: "file"} if path in supporting.columns else {}), [task], "supporting")
    j = examples.join(s, [task, path], "left").join(t, task, "left")
    return j.select(*examples.columns, F.coalesce("structural", F.array().cast(s.schema["structural"].dataType)).alias("structural"), F.coalesce("supporting", F.array().cast(t.schema["supporting"].dataType)).alias("supporting"))


def files_of_issue(rows: DataFrame, issue: str, files: str, order: str) -> DataFrame:
    """A-20: all changes' files of an issue, once each, in order."""
    return rows.groupBy(issue).agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(files).alias("f")))), lambda x: x.f))).alias(files))


def prs_per_issue(rows: DataFrame, issue: str) -> DataFrame:
    """A-19."""
    return rows.groupBy(issue).agg(F.count("*").alias("n")).agg(F.count("*").alias("issues"), F.avg("n").alias("mean"), F.max("n").alias("max"))


#: Conclusions that fail, parts of the names of checks that count, approvals that say nothing.
FAILED = ("failure", "timed_out", "action_required")
KEY_CHECKS = ("static checks", "tests", "ci/cd", "build", "lint", "mypy")
PLAIN_APPROVALS = ("lgtm", "lgtm!", "+1", "looks good", "approved")


def strict_critic_label(prs: DataFrame) -> DataFrame:
    """P-27: ``prs`` with label and reasoning (null where no rule fits), by the stricter rules.

    Texts are trimmed before they are measured; suggestions give no reason; a failed check that
    counts bars acceptance; an approval's own words are the reason where they say something.
    """
    body = lambda x: F.trim(F.coalesce(x.body, F.lit("")))
    reviews, inline, runs = (F.coalesce(c, F.array()) for c in ("reviews", "review_comments", "check_runs"))
    long_note = lambda c: F.coalesce(c.diff_hunk != "", F.lit(False)) & (F.length(body(c)) > 20)
    asked = F.filter(reviews, lambda r: r.state.eqNullSafe("CHANGES_REQUESTED") & (F.length(body(r)) > 20))
    notes = F.filter(inline, lambda c: long_note(c) & ~body(c).startswith("```suggestion"))
    counts = lambda c: F.lower(F.coalesce(c["name"], F.lit(""))).rlike("|".join(KEY_CHECKS))
    failed = F.exists(runs, lambda c: F.coalesce(c.conclusion.isin(*FAILED), F.lit(False)) & counts(c))
    barred = F.exists(reviews, lambda r: r.state.eqNullSafe("CHANGES_REQUESTED")) | F.exists(inline, long_note)
    spoken = F.filter(reviews, lambda r: r.state.eqNullSafe("APPROVED") & (F.length(body(r)) > 10) & ~F.lower(body(r)).isin(*PLAIN_APPROVALS))
    first = lambda a: body(F.get(a, F.lit(0)))
    merged = F.col("pr.merged_at").isNotNull()
    patched = F.exists(F.coalesce("files", F.array()), lambda f: F.coalesce(f.patch != "", F.lit(False)))
    signal = (F.size(asked) > 0) | (F.size(notes) > 0)
    label = F.when(~patched, None).when(~merged & signal, "REJECT").when(merged & signal, "REVISE").when(merged & ~barred & ~failed, "ACCEPT")
    by_review = F.when(F.size(asked) > 0, first(asked)).otherwise(first(notes))
    by_note = F.when(F.size(notes) > 0, first(notes)).otherwise(first(asked))
    names = F.transform("files", lambda f: F.lower(f.filename))
    clean = F.when(F.size("files") == 1, NO_FINDINGS["one"]).when(F.exists(names, lambda f: F.contains(f, F.lit("test"))), NO_FINDINGS["tests"]).otherwise(NO_FINDINGS["clean"])
    accept = F.when(F.size(spoken) > 0, F.left(first(spoken), F.lit(300))).otherwise(clean)
    why = F.when(label == "REJECT", F.left(by_review, F.lit(400))).when(label == "REVISE", F.left(by_note, F.lit(400))).when(label == "ACCEPT", accept)
    return prs.withColumns({"label": label, "reasoning": why})


def pooled(pools: list[DataFrame], key: str, seed: int) -> DataFrame:
    """U-5: all pools' rows in one seeded order."""
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p)
    return out.orderBy(seeded(key, seed))
