"""Text expressions: links, stripping, truncation, paths, keywords, generated-text parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must equal the reference's for right results.
CLOSES = r"(?i)(?:fix(?:es|ed)?|close[sd]?|resolve[sd]?)\s*#(\d+)"
CLOSES_LOOSE = r"(?i)(?:fix(?:es|ed)?|close[sd]?|resolve[sd]?)[:\s]*#(\d+)"
CLOSURE_SIGNALS = (
    r"(?i)lgtm", r"(?i)fixed\s+in", r"(?i)resolved\s+by", r"(?i)closing\s+#\d+", r"(?i)merged", r"(?i)merging\s+this",
    r"(?i)resolution_days", r"(?i)closed_at",
)
COMPONENTS = (
    "scheduler", "executor", "dag", "task", "operator", "sensor", "hook", "provider", "trigger", "xcom", "variable", "connection",
    "webserver", "api", "model", "database", "migration",
)
TEMPLATE_LINES = (
    "licensed to the apache software foundation", "contributor license agreements", "you may not use this file except in compliance", "thank you for contributing",
    "pull request guidelines", "read the pull request guidelines", "add meaningful description above",
)
DUPLICATE_WORDS = ("duplicate", "dupe of", "closing as duplicate", "superseded by")
INVALID_WORDS = ("wontfix", "won't fix", "invalid", "not a bug", "by design", "works as intended")
DUPLICATE_REASON = "This was closed as a duplicate or superseded report, so it does not define a new repository code-change task."
INVALID_REASON = "Maintainers marked this invalid, by design, or otherwise not requiring a code change."
UNLINKED_REASON = (
    "This ticket was closed without a linked fixing PR in the source data, so this training label is NO (context snippet: %s)."
)


def _numbers(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), lambda x: x.cast("bigint"))


def closing_links(text: Column) -> Column:
    """F-1: numbers after a closing keyword."""
    return _numbers(text, CLOSES)


def closing_links_loose(text: Column) -> Column:
    """F-2: as F-1, with colons and blanks before the number."""
    return _numbers(text, CLOSES_LOOSE)


def issue_url_links(text: Column, host: str = "github.com") -> Column:
    """F-3: numbers of issue urls."""
    return _numbers(text, rf"https?://{host.replace('.', chr(92) + '.')}/[^/\s]+/[^/\s]+/issues/(\d+)")


def link_text(body: Column, comments: Column) -> Column:
    """F-4: body and comment bodies; blanks between comments, none between body and first comment."""
    return F.concat(F.coalesce(body, F.lit("")), F.array_join(F.transform(F.coalesce(comments, F.array()), lambda c: F.coalesce(c.body, F.lit(""))), " "))


def strip_closure_signals(text: Column) -> Column:
    """F-6: signals of the outcome become [STRIPPED], in order; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for p in CLOSURE_SIGNALS:
        text = F.regexp_replace(text, p, "[STRIPPED]")
    return text


def truncate(text: Column, n: int) -> Column:
    """F-7."""
    return F.left(F.coalesce(text, F.lit("")), F.lit(n))


def truncate_tokens(text: Column, tokens: int, suffix: str = "...") -> Column:
    """F-8: cut at four characters a token, with a suffix where something was cut."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > 4 * tokens, F.concat(F.left(t, F.lit(4 * tokens)), F.lit(suffix))).otherwise(t)


def first_words(text: Column, n: int) -> Column:
    """F-9."""
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), 1, n), " ")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_pr_body(text: Column, drop: tuple[str, ...] = TEMPLATE_LINES) -> Column:
    """F-10: without HTML comments, images, urls, template lines and separators; one line."""
    t = F.coalesce(text, F.lit(""))
    for p in (r"(?s)<!--.*?-->", r"!\[[^\]]*\]\([^)]+\)", r"https?://\S+"):
        t = F.regexp_replace(t, p, " ")
    lines = F.transform(F.split(t, r"\r\n|[\n\r]"), lambda x: F.trim(x))

    def keep(x: Column) -> Column:
        low = F.lower(x)
        bad = low.startswith("<img") | low.startswith("![](") | x.rlike(r"^[-=*_]*$")
        for d in drop:
            bad = bad | low.contains(d)
        return ~bad

    return collapse(F.array_join(F.filter(lines, keep), " "))


def no_change_reason(title: Column, body: Column) -> Column:
    """F-11: a sentence why an issue without a linked change needs none."""
    blob = F.lower(collapse(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))))
    any_of = lambda words: F.greatest(*[blob.contains(w).cast("int") for w in words]) == 1
    hint = first_words(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))), 32)
    head = F.left(hint, F.lit(137))
    cut = F.when(F.length(hint) > 140, F.concat(F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.*) ", 1), F.lit("")), head), F.lit("."))).otherwise(hint)
    return (
        F.when(any_of(DUPLICATE_WORDS), F.lit(DUPLICATE_REASON))
        .when(any_of(INVALID_WORDS), F.lit(INVALID_REASON))
        .otherwise(F.format_string(UNLINKED_REASON, cut))
    )


def label_reason(labels: Column, state_reason: Column) -> Column:
    """F-12: reason by label names and state."""
    low = F.transform(F.coalesce(labels, F.array().cast("array<string>")), F.lower)
    has = lambda w: F.exists(low, lambda x: x.contains(w))
    return (
        F.when(has("duplicate"), "duplicate").when(has("invalid"), "invalid").when(has("wontfix"), "wontfix").when(has("question"), "question")
        .when(state_reason == "not_planned", "not_planned").otherwise("no_code_change")
    )


def normalize_path_loose(path: Column) -> Column:
    """F-13: forward slashes; all leading dots and slashes go, so ``.github`` loses its dot."""
    return F.regexp_replace(F.trim(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))), r"^[./]+", "")


def normalize_path(path: Column) -> Column:
    """F-14: forward slashes; only leading ``./`` go."""
    return F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def path_aliases(path: Column, moves: tuple[tuple[str, str], ...]) -> Column:
    """F-15: the path and what it becomes under each (pattern, replacement), in order, once each."""
    p = normalize_path_loose(path)
    return F.filter(F.array_distinct(F.array(p, *[F.regexp_replace(p, a, b) for a, b in moves])), lambda x: x != "")


def keywords(text: Column, components: tuple[str, ...] = COMPONENTS, roots: tuple[str, ...] = ("src",)) -> Column:
    """F-16, F-17: lower-case CamelCase names, snake_case names, source paths, and components the text mentions."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    found = lambda s, p: F.regexp_extract_all(s, F.lit(p), F.lit(0))
    paths = found(t, rf"(?:{'|'.join(roots)})/[a-zA-Z0-9_/]+\.py")
    parts = [
        F.transform(found(t, r"\b[A-Z][a-zA-Z0-9]+\b"), F.lower), found(low, r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"), F.transform(paths, F.lower),
        F.filter(F.array(*map(F.lit, components)), lambda k: F.contains(low, k)),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def approx_tokens(text: Column) -> Column:
    """F-33: a token for four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("int")


def word_tokens(text: Column) -> Column:
    """F-33: white-space tokens."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))


def parse_labels(text: Column) -> Column:
    """F-34: a JSON list of names or of objects with a name, else a comma list."""
    plain = F.from_json(text, "array<string>")
    named = F.transform(F.from_json(text, "array<struct<name: string>>"), lambda x: x["name"])
    is_list, is_named = F.trim(text).startswith("["), text.rlike(r"^\s*\[\s*\{")
    comma = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.when(is_named, named).when(is_list, plain).otherwise(comma), F.array().cast("array<string>"))


def clamp01(x: Column) -> Column:
    """F-39."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def hash_percent(key: Column) -> Column:
    """F-40: the md5 of the key's text as a number, modulo 100; word by word, as 2^32 mod 100 is 96."""
    h = F.md5(key.cast("string"))
    acc = F.lit(0).cast("bigint")
    for i in range(4):
        acc = (acc * 96 + F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")) % 100
    return acc.cast("int")


def teacher_adjustment(raw: Column) -> Column:
    """F-41: the number after ADJUSTMENT:, within 0.3 either way; 0 where there is none."""
    x = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?i)ADJUSTMENT:\s*([+-]?\d*\.?\d+)", 1)
    n = x.try_cast("double")
    return F.when(n.isNull(), 0.0).otherwise(F.greatest(F.lit(-0.3), F.least(F.lit(0.3), n)))  # least and greatest skip nulls


def teacher_reason(raw: Column) -> Column:
    """F-41: the line after REASON:."""
    return F.trim(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?i)REASON:\s*([^\n]*)", 1))


def blended_score(programmatic: Column, adjustment: Column) -> Column:
    """F-41: 0.6 p + 0.4 (p + adjustment), clamped, four digits."""
    return F.bround(clamp01(programmatic * 0.6 + (programmatic + adjustment) * 0.4), 4)


def verdict(text: Column, classes: tuple[str, ...] = ("ACCEPT", "REVISE", "REJECT")) -> Column:
    """F-42: class after VERDICT:, else the first class named, else UNKNOWN."""
    alternatives = "|".join(classes)
    t = F.upper(F.coalesce(text, F.lit("")))
    a, b = F.regexp_extract(t, rf"VERDICT:\s*({alternatives})", 1), F.regexp_extract(t, rf"\b({alternatives})\b", 1)
    return F.when(a != "", a).when(b != "", b).otherwise("UNKNOWN")


def reasoning(text: Column) -> Column:
    """F-42: what follows REASONING:."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?is)REASONING:\s*(.*)$", 1))


def requires_change(text: Column) -> Column:
    """F-42: YES or NO after the class key, else UNKNOWN."""
    x = F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)REQUIRES_CODE_CHANGE:\s*(YES|NO)", 1))
    return F.when(x != "", x).otherwise("UNKNOWN")


def predicted_files(text: Column, key: str = "FILES", most: int = 6) -> Column:
    """F-42: the file list after a key: bullets or commas, unique, in order."""
    block = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?is){key}:\s*(.*?)(?:\n\s*\n|\n[A-Z_]+:|$)", 1)
    items = F.transform(F.split(block, r"[\n,]"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*`]+|[`\s]+$", "")))
    return F.slice(F.array_distinct(F.filter(items, lambda x: x.rlike(r"^[\w./\-]+\.\w+$"))), 1, most)


def strip_fences(text: Column) -> Column:
    """F-43: a text without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\n?", ""), r"\n?```$", "")


def json_object(text: Column) -> Column:
    """F-43: from the first brace to the last."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)


def touched_files(diff: Column) -> Column:
    """F-43: files a diff writes."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(diff, F.lit("")), F.lit(r"(?m)^\+\+\+ b/(.+)$"), F.lit(1)))


def chosen_text(raw: Column, marker: str = "CHOSEN:") -> Column:
    """F-44: what follows the first marker, else all."""
    t = F.coalesce(raw, F.lit(""))
    return F.trim(F.when(F.contains(t, F.lit(marker)), F.regexp_extract(t, rf"(?s){marker}(.*)$", 1)).otherwise(t))


def message_text(text: Column, blocks: Column) -> Column:
    """F-45: the text, else the blocks' texts by line."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.array_join(F.filter(blocks, lambda b: b.isNotNull() & (b != "")), "\n"), F.lit(""))


def issue_reference(text: Column) -> Column:
    """F-46: the number of ``#12``, ``issue 12`` or an issue url."""
    p = r"(?i)(?:/issues/|#|\bissue\s+#?)(\d+)"
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), F.lit("")).cast("bigint")


def chat_prompt(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """F-47: turns in the im_start and im_end template."""
    turn = lambda who, t: F.concat(F.lit(f"<|im_start|>{who}\n"), t, F.lit("<|im_end|>\n"))
    end = turn("assistant", assistant) if assistant is not None else F.lit("<|im_start|>assistant\n")
    return F.concat(turn("system", system), turn("user", user), end)


def jitter_days(text: Column, key: Column, seed: int, spread: int = 3) -> Column:
    """F-48: DAYS_OPEN in a prompt moved by up to ``spread`` days, one at least; seeded by the key."""
    days = F.regexp_extract(text, r"(?i)DAYS_OPEN:\s*(\d+)", 1)
    moved = F.greatest(F.lit(1), days.try_cast("bigint") + F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2 * spread + 1)) - spread)
    return F.when(days != "", F.concat(F.regexp_extract(text, r"(?is)^(.*?DAYS_OPEN:\s*)\d+", 1), moved.cast("string"), F.regexp_extract(text, r"(?is)DAYS_OPEN:\s*\d+(.*)$", 1))).otherwise(text)


def drop_tier(text: Column) -> Column:
    """F-48: without the SNAPSHOT_TIER line."""
    return F.regexp_replace(text, r"(?m)^SNAPSHOT_TIER:.*\n?", "")


def cross_references(timeline: Column) -> Column:
    """F-49: ``PR #n`` or ``Issue #n`` of cross-referenced events, once each, in order."""
    refs = F.filter(F.coalesce(timeline, F.array()), lambda e: (e.event == "cross-referenced") & e.source.issue.number.isNotNull())
    name = lambda e: F.concat(F.when(e.source.issue.pull_request.isNotNull(), "PR #").otherwise("Issue #"), e.source.issue.number.cast("string"))
    return F.array_distinct(F.transform(refs, name))


def score_bar(score: Column, width: int = 10) -> Column:
    """F-50: filled and empty cells."""
    n = F.round(clamp01(score) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def risk_message(number: Column, title: Column, score: Column, band: Column, reason: Column) -> Column:
    """F-50: a result as chat text."""
    return F.concat_ws("\n", F.concat(F.lit("*#"), number.cast("string"), F.lit("* "), title), F.concat(score_bar(score), F.lit(" "), F.format_number(score, 2), F.lit(" "), band), reason)


PLAN = "struct<requires_change: boolean, summary: string, spans: array<struct<file: string, start_line: int, end_line: int>>>"


def parse_plan(raw: Column, default_file: Column) -> Column:
    """F-52: a plan from JSON text; lines are 1 at least and in order; without spans the default file's first line."""
    p = F.from_json(json_object(raw), PLAN)
    line = lambda x: F.greatest(F.coalesce(x, F.lit(1)), F.lit(1))
    spans = F.transform(
        F.coalesce(p.spans, F.array().cast("array<struct<file: string, start_line: int, end_line: int>>")),
        lambda s: F.struct(s["file"].alias("file"), line(s["start_line"]).alias("start_line"), F.greatest(line(s["end_line"]), line(s["start_line"])).alias("end_line")),
    )
    default = F.array(F.struct(default_file.alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line")))
    return F.struct(F.coalesce(p.summary, F.lit("")).alias("summary"), F.when(F.size(spans) > 0, spans).otherwise(default).alias("spans"))


def has_prose(diff: Column, most: int = 3) -> Column:
    """F-53: more than ``most`` lines that are no diff lines."""
    lines = F.split(F.coalesce(diff, F.lit("")), "\n")
    return F.size(F.filter(lines, lambda x: (F.trim(x) != "") & ~x.rlike(r"^(diff |index |--- |\+\+\+ |@@|[ +\-\\]|new file|deleted file|similarity|rename )"))) > most


def structure_score(text: Column, keys: tuple[str, ...]) -> Column:
    """F-53: the share of keys the text has."""
    return sum((F.contains(F.coalesce(text, F.lit("")), F.lit(k)).cast("double") for k in keys), F.lit(0.0)) / len(keys)
