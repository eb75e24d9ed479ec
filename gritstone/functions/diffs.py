"""Unified diffs: headers, predicates, windows, application, compile checks."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def hunk_headers(patch: Column) -> Column:
    """F-21: (old_start, old_count, new_start, new_count) of each header; a missing count is 1."""
    heads = F.filter(F.split(F.coalesce(patch, F.lit("")), "\n"), lambda x: x.rlike(HUNK))
    group = lambda x, i: F.coalesce(F.nullif(F.regexp_extract(x, HUNK, i), F.lit("")), F.lit("1")).cast("int")
    return F.transform(
        heads,
        lambda x: F.struct(group(x, 1).alias("old_start"), group(x, 2).alias("old_count"), group(x, 3).alias("new_start"), group(x, 4).alias("new_count")),
    )


def first_hunk(patch: Column, keep_preamble: bool = False) -> Column:
    """F-22: the text up to the second header, with or without what stands before the first."""
    pattern = r"(?s)^(.*?@@ .*?)(?=\n@@ |$(?!\n))" if keep_preamble else r"(?s)(@@ .*?)(?=\n@@ |$(?!\n))"
    found = F.regexp_extract(F.coalesce(patch, F.lit("")), pattern, 1)
    return F.when(found != "", found)


def is_git_diff(text: Column) -> Column:
    """F-23: has both file lines."""
    t = F.coalesce(text, F.lit(""))
    return t.contains("--- ") & t.contains("+++ ")


def starts_as_diff(text: Column) -> Column:
    """F-23: starts with a file line or a git header."""
    t = F.ltrim(F.coalesce(text, F.lit("")))
    return t.startswith("--- ") | t.startswith("diff --git")


def is_valid_diff(text: Column) -> Column:
    """F-23: file lines and a hunk header, each on a line of its own."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(r"(?m)^--- ") & t.rlike(r"(?m)^\+\+\+ ") & t.rlike("(?m)" + HUNK)


def has_changes(text: Column) -> Column:
    """F-23: a header, and a line added or removed."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike("(?m)" + HUNK) & t.rlike(r"(?m)^[+-](?![+-]{2} )")


def counts_agree(text: Column) -> Column:
    """F-23: every header's counts are those of its hunk's lines."""

    def check(s: pd.Series) -> pd.Series:
        return s.map(lambda t: bool(t) and _counts_agree(t))

    return F.pandas_udf(check, "boolean")(text)


def _hunks(patch: str) -> list[tuple[tuple[int, int, int, int], list[str]]]:
    out: list[tuple[tuple[int, int, int, int], list[str]]] = []
    for line in patch.split("\n"):
        m = re.match(HUNK, line)
        if m:
            a, b, c, d = (int(x) if x is not None else 1 for x in m.groups())
            out.append(((a, b, c, d), []))
        elif out and line[:1] in (" ", "+", "-", "\\"):
            out[-1][1].append(line)
    return out


def _counts_agree(patch: str) -> bool:
    found = _hunks(patch)
    return bool(found) and all(
        sum(x[0] in " -" for x in lines) == head[1] and sum(x[0] in " +" for x in lines) == head[3] for head, lines in found
    )


def apply_patch(base: str | None, patch: str | None) -> str | None:
    """F-24: the text after a single-file patch; null where context or removed lines differ."""
    if base is None or not patch:
        return None
    lines = base.split("\n")
    ended = lines[-1] == ""
    if ended:
        lines.pop()
    hunks, out, at = _hunks(patch), [], 0
    if not hunks:
        return None
    for (start, count, _, _), body in hunks:
        begin = start - 1 if count else start
        if begin < at or begin > len(lines):
            return None
        out += lines[at:begin]
        at = begin
        for x in body:
            if x[0] == "\\":
                ended = False
            elif x[0] == "+":
                out.append(x[1:])
            else:
                if at >= len(lines) or lines[at] != x[1:]:
                    return None
                if x[0] == " ":
                    out.append(lines[at])
                at += 1
    out += lines[at:]
    return "\n".join(out) + ("\n" if ended and out else "")


@F.pandas_udf(T.StringType())
def apply_patch_udf(base: pd.Series, patch: pd.Series) -> pd.Series:
    return pd.Series([apply_patch(a, b) for a, b in zip(base, patch)], dtype=object)


def compiles(text: str | None) -> bool:
    try:
        ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def compiles_udf(code: pd.Series) -> pd.Series:
    """F-25: the text parses as Python."""
    return code.map(compiles)


@F.pandas_udf(T.BooleanType())
def fits_udf(base: pd.Series, patch: pd.Series, python: pd.Series) -> pd.Series:
    """F-24, F-25: the patch applies and, where the file is ``python``, the result parses.

    A text meets a patch once, and only results that must parse are parsed; equal ones of a batch once.
    """
    known: dict[tuple, bool] = {}

    def fits(*row) -> bool:
        if row not in known:
            after = apply_patch(row[0], row[1])
            known[row] = after is not None and (not row[2] or compiles(after))
        return known[row]

    return pd.Series([fits(*row) for row in zip(base, patch, python)], dtype=bool)


def touched_ranges(headers: Column) -> Column:
    """F-26: (lo, hi) of the new side's lines of each hunk; a hunk without new lines touches its place."""
    return F.transform(
        headers, lambda h: F.struct(h.new_start.alias("lo"), (h.new_start + F.greatest(h.new_count, F.lit(1)) - 1).alias("hi"))
    )


def overlaps(ranges: Column, lo: Column, hi: Column) -> Column:
    """F-26: whether lines lo..hi meet any range; nothing is expanded."""
    return F.exists(ranges, lambda r: (r.lo <= hi) & (r.hi >= lo))


def merge_intervals(intervals: Column) -> Column:
    """W-8 in a row: overlapping and adjacent (lo, hi) made one, in order."""
    kind = "array<struct<lo: int, hi: int>>"
    ordered = F.array_sort(F.transform(intervals, lambda r: F.struct(r.lo.cast("int").alias("lo"), r.hi.cast("int").alias("hi"))))
    return F.aggregate(ordered, F.array().cast(kind), _merge)


def _merge(acc: Column, r: Column) -> Column:
    last = F.try_element_at(acc, F.lit(-1))
    joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last.lo.alias("lo"), F.greatest(last.hi, r.hi).alias("hi"))))
    return F.when(F.coalesce(r.lo <= last.hi + 1, F.lit(False)), joined).otherwise(F.concat(acc, F.array(r)))


def clip_to_budget(intervals: Column, budget: int) -> Column:
    """W-9 in a row: ordered intervals until ``budget`` lines are used; the last is cut."""
    kind = "struct<left: int, out: array<struct<lo: int, hi: int>>>"

    def step(acc: Column, r: Column) -> Column:
        span = r.hi - r.lo + 1
        take = F.least(span, acc.left)
        return F.when(
            take > 0,
            F.struct((acc.left - take).cast("int").alias("left"), F.concat(acc.out, F.array(F.struct(r.lo.cast("int").alias("lo"), (r.lo + take - 1).cast("int").alias("hi")))).alias("out")),
        ).otherwise(acc)

    zero = F.struct(F.lit(budget).alias("left"), F.array().cast("array<struct<lo: int, hi: int>>").alias("out")).cast(kind)
    return F.aggregate(intervals, zero, step, lambda acc: acc.out)


def primary_windows(n_lines: Column, headers: Column, whole: int = 380, pad: int = 40, budget: int = 280) -> Column:
    """F-30: the whole file if short, else padded hunk windows, merged and cut to a budget."""
    padded = F.transform(
        headers,
        lambda h: F.struct(F.greatest(F.lit(1), h.old_start - pad).alias("lo"), F.least(n_lines, h.old_start + F.greatest(h.old_count, F.lit(1)) - 1 + pad).alias("hi")),
    )
    all_lines = F.array(F.struct(F.lit(1).alias("lo"), n_lines.cast("int").alias("hi")))
    return F.when(n_lines <= whole, all_lines).otherwise(clip_to_budget(merge_intervals(padded), budget))


def numbered(text: Column, lo: Column, hi: Column) -> Column:
    """F-29: lines lo..hi, each after its number in six places and a bar."""
    return numbered_lines(F.split(text, "\n"), lo, hi)


def numbered_lines(lines: Column, lo: Column, hi: Column) -> Column:
    """F-29 for a text that is split already."""
    part = F.slice(lines, lo, F.greatest(hi - lo + 1, F.lit(0)))
    n = lambda i: (i + lo).cast("string")
    pad = lambda s: F.when(F.length(s) < 6, F.lpad(s, 6, " ")).otherwise(s)
    return F.array_join(F.transform(part, lambda x, i: F.concat(pad(n(i)), F.lit("|"), x)), "\n")
