"""Whole issue and change records from endpoints: parts are fetched side by side, and meet by number."""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import issues as I
from ..schema import RAW_ISSUE, RAW_PR

#: The endpoints of a record. Of the first set each gives one object, of the second pages of a list.
ISSUE_PARTS = (("issue",), ("comments", "timeline", "sub_issues"))
CHANGE_PARTS = (("pr", "requested_reviewers"), ("files", "reviews", "review_comments", "commits"))
COMMIT_PARTS = ((), ("check_runs",))


def fetch_parts(keys: DataFrame, key: str, fetch: str, parts: tuple[tuple[str, ...], tuple[str, ...]], per_page: int = 100, tries: int = 3) -> DataFrame:
    """S-11 to S-13: (key, part, body JSON, error): one row for each key and endpoint.

    ``fetch`` is the dotted name of a function (part, key, page) that executors can import. Each
    (key, endpoint) is a row of its own, dealt out by both, so that a record's endpoints are fetched
    side by side. A list goes on to its next page until one has fewer than ``per_page`` records. A
    call that fails ``tries`` times is an error in its row and fails no other. Null keys go.
    """
    one, many = parts
    ask = keys.select(key).where(F.col(key).isNotNull()).distinct().select(key, F.explode(F.array(*[F.lit(p) for p in (*one, *many)])).alias("part")).repartition(key, "part")
    module, _, name = fetch.rpartition(".")

    def call(f, part: str, k, page: int):
        for n in range(tries):
            try:
                return f(part, k, page)
            except Exception:
                if n + 1 == tries:
                    raise

    def get(f, part: str, k) -> tuple[str | None, str | None]:
        try:
            if part in one:
                body = call(f, part, k, 1)
                return (json.dumps(body), None) if isinstance(body, dict) else (None, f"not an object: {type(body).__name__}")
            rows: list = []
            page = 1
            while True:
                more = call(f, part, k, page)
                if not isinstance(more, list):
                    return None, f"not a list: {type(more).__name__}"
                rows += more
                if len(more) < per_page:
                    return json.dumps(rows), None
                page += 1
        except Exception as e:  # the call's error is the row's value
            return None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = getattr(import_module(module), name)
        for b in batches:
            for i, (k, part) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):  # a call a row: its body goes on at once
                body, error = get(f, part, k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([body], pa.string()), pa.array([error], pa.string())], names=[key, "part", "body", "error"])

    return ask.mapInArrow(run, T.StructType([ask.schema[key], *T._parse_datatype_string("part string, body string, error string").fields]))


def _wide(parts: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """A row a key: each part's body, and ``failed``, the parts that gave an error."""
    body = [F.max(F.when(F.col("part") == n, F.col("body"))).alias(n) for n in names]
    return parts.groupBy(key).agg(*body, F.sort_array(F.collect_set(F.when(F.col("error").isNotNull(), F.col("part")))).alias("failed"))


def _parse(schema: T.StructType, name: str) -> Column:
    return F.from_json(F.col(name), schema[name].dataType).alias(name)


def assemble_issues(parts: DataFrame, repo: str, extracted_at: str) -> DataFrame:
    """S-11: one RAW_ISSUE record a number, and ``failed``. Without its main part a number gives no record, and so stays to be fetched."""
    s = T._parse_datatype_string(RAW_ISSUE)
    w = _wide(parts, "number", (*ISSUE_PARTS[0], *ISSUE_PARTS[1])).where("issue is not null")
    r = w.select("number", "failed", *[_parse(s, c) for c in ("issue", "comments", "timeline", "sub_issues")])
    links = F.array_distinct(X.closing_links(X.link_text(F.col("issue.body"), F.col("comments"))))
    more = {"issue_number": F.col("number"), "repo": F.lit(repo), "extracted_at": F.lit(extracted_at), "_extracted_at": F.lit(None).cast("string"), "label_names": I.label_names(F.col("issue.labels")), "linked_pr_numbers": links}
    return r.withColumns(more).select(*s.names, "failed")


def assemble_changes(parts: DataFrame, runs: DataFrame, linked: DataFrame, repo: str, extracted_at: str) -> DataFrame:
    """S-12: one RAW_PR record a number, and ``failed``.

    ``parts`` by number (CHANGE_PARTS), ``runs`` by sha (COMMIT_PARTS, of ``head_shas``), ``linked``
    (number, linked_issue_number). Reviews or reviewers that failed count as none; other parts that
    failed are null. Without its main part a number gives no record.
    """
    s = T._parse_datatype_string(RAW_PR)
    w = _wide(parts, "number", (*CHANGE_PARTS[0], *CHANGE_PARTS[1])).where("pr is not null")
    r = w.select("number", F.col("failed").alias("f1"), *[_parse(s, c) for c in ("pr", "requested_reviewers", *CHANGE_PARTS[1])])
    c = _wide(runs, "sha", ("check_runs",)).select(F.col("sha"), _parse(s, "check_runs"), F.col("failed").alias("f2"))
    j = r.withColumn("sha", F.col("pr.head.sha")).join(c, "sha", "left").join(linked.select("number", F.col("linked_issue_number").cast("string")), "number", "left")
    none = F.struct(F.array().cast("array<struct<login:string>>").alias("users"), F.array().cast("array<struct<name:string>>").alias("teams"))
    j = j.withColumns({"requested_reviewers": F.coalesce("requested_reviewers", none), "reviews": F.coalesce("reviews", F.array().cast(s["reviews"].dataType)), "check_runs": F.coalesce("check_runs", F.array().cast(s["check_runs"].dataType))})
    more = {
        "pr_number": F.col("number"), "repo": F.lit(repo), "extracted_at": F.lit(extracted_at), "_extracted_at": F.lit(None).cast("string"), "ci_conclusion": I.ci_conclusion(F.col("check_runs")),
        "silent_reviewers": I.silent_reviewers(F.col("requested_reviewers.users"), F.col("reviews")), "failed": F.concat("f1", F.coalesce("f2", F.array().cast("array<string>"))),
    }
    return j.withColumns(more).select(*s.names, "failed")


def head_shas(parts: DataFrame) -> DataFrame:
    """(sha) of the changes' heads, for the endpoints that go by commit."""
    return parts.where("part = 'pr'").select(F.get_json_object("body", "$.head.sha").alias("sha")).where("sha is not null").distinct()
