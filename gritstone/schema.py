"""Declared schemas of the engine's records, as DDL. Nothing is inferred."""

from __future__ import annotations

_USER = "struct<login: string, type: string>"


def _ddl(text: str) -> str:
    return " ".join(text.split())


RAW_ISSUE = _ddl(
    f"""issue_number bigint, repo string, extracted_at string, _extracted_at string, label_names array<string>,
    linked_pr_numbers array<bigint>,
    issue struct<number: bigint, title: string, body: string, state: string, state_reason: string, created_at: string,
      closed_at: string, updated_at: string, comments: int, user: {_USER}, labels: array<struct<name: string>>,
      assignees: array<struct<login: string>>, milestone: struct<title: string>, closed_by: struct<login: string>>,
    comments array<struct<body: string, created_at: string, user: struct<login: string>>>,
    timeline array<struct<event: string, created_at: string,
      source: struct<issue: struct<number: bigint, pull_request: struct<url: string>>>>>,
    sub_issues array<struct<number: bigint>>"""
)
RAW_PR = _ddl(
    f"""pr_number bigint, repo string, extracted_at string, _extracted_at string, linked_issue_number string, ci_conclusion string,
    silent_reviewers array<string>,
    requested_reviewers struct<users: array<struct<login: string>>, teams: array<struct<name: string>>>,
    pr struct<number: bigint, title: string, body: string, state: string, created_at: string, closed_at: string,
      merged_at: string, additions: bigint, deletions: bigint, changed_files: bigint, base: struct<sha: string>,
      head: struct<sha: string>, user: {_USER}, requested_reviewers: array<struct<login: string>>>,
    files array<struct<filename: string, status: string, patch: string, additions: bigint, deletions: bigint>>,
    reviews array<struct<id: bigint, state: string, body: string, submitted_at: string, user: struct<login: string>>>,
    review_comments array<struct<id: bigint, body: string, path: string, diff_hunk: string, line: bigint,
      original_line: bigint, user: struct<login: string>>>,
    commits array<struct<commit: struct<message: string>>>,
    check_runs array<struct<name: string, conclusion: string, started_at: string, completed_at: string>>"""
)
SNAPSHOT = _ddl(
    """ISSUE_NUMBER bigint, REPO string, TITLE string, STATE string, LABELS string, ASSIGNEE_COUNT int, MILESTONE string,
    COMMENT_COUNT_AT_SNAPSHOT int, LINKED_PR_COUNT_AT_SNAPSHOT int, CREATED_AT timestamp_ntz, SNAPSHOT_DATE timestamp_ntz,
    DAYS_OPEN int, SNAPSHOT_TIER string, RAW_JSON_SNAPSHOT string"""
)
PR_CSV = _ddl(
    """PR_NUMBER bigint, LINKED_ISSUE_NUMBER bigint, PR_TITLE string, STATE string, IS_MERGED boolean, REVIEW_COUNT int,
    CREATED_AT string, RAW_JSON string"""
)
TEACHER = _ddl("issue_number bigint, snapshot_tier string, model string, raw string")
FEEDBACK = _ddl(
    """id bigint, created_at timestamp, slack_team_id string, channel_id string, message_ts string, user_id string,
    prompt_text string, rejected_text string, metadata string, reaction string"""
)
