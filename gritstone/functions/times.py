"""Time parsing and differences. Unreadable times are null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ts(text: Column) -> Column:
    """F-35: ISO text with ``T`` or a blank, an offset or ``Z``; ``None``, ``null`` and rubbish are null. In UTC."""
    t = F.trim(text)
    usable = t.isNotNull() & ~F.lower(t).isin("none", "null", "nan", "")
    return F.when(usable, F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00"))).cast("timestamp_ntz")


def parse_ts_drop_offset(text: Column) -> Column:
    """F-35, scorer's form: the offset is dropped without converting."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"(Z|[+-]\d\d:?\d\d)$", "")).cast("timestamp_ntz")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def elapsed_days(start: Column, end: Column) -> Column:
    """F-37: exact difference in days."""
    return (_micros(end) - _micros(start)) / F.lit(86_400_000_000.0)


def whole_days(start: Column, end: Column) -> Column:
    """Whole days elapsed, rounded down."""
    return F.floor(elapsed_days(start, end))


def boundary_days(start: Column, end: Column) -> Column:
    """F-36: hour boundaries crossed, over 24. 00:59 to 01:01 crosses one."""
    hour = lambda t: F.unix_seconds(F.date_trunc("HOUR", t).cast("timestamp"))
    return (hour(end) - hour(start)) / 3600 / 24.0


def week_bounds(today: Column | None = None) -> tuple[Column, Column]:
    """F-51: the last seven days, ends included."""
    end = today if today is not None else F.current_date()
    return F.date_sub(end, 7), end


def max_gap_days(times: Column, floor: bool = False) -> Column:
    """W-1 to W-3: largest gap between consecutive times of an array, in days; null for fewer than two."""
    s = F.array_sort(F.filter(times, lambda t: t.isNotNull()))
    n = F.size(s)
    pairs = F.zip_with(F.slice(s, 1, F.greatest(n - 1, F.lit(0))), F.slice(s, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: elapsed_days(a, b))
    gap = F.when(n >= 2, F.array_max(pairs))
    return F.floor(gap) if floor else gap
