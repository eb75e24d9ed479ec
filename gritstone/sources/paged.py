"""A paged record source as a Python data source: one partition a page range."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual


class _Pages(InputPartition):
    def __init__(self, first: int, last: int, most: int | None):
        self.first, self.last, self.most = first, last, most


class PagedSource(DataSource):
    """S-13, S-14: ``spark.read.format("paged")`` over pages of JSON records.

    Options: ``pages`` (how many), ``pages_per_task``, and ``fetch``, the dotted name of a
    function (page) -> list of records that executors can import. A page that returns nothing ends
    its range. Records are returned as (page, record JSON).

    ``max_items`` is a cap on all records, the first in page order, whatever the partitions are.
    With ``per_page``, the size of every page but the last, pages beyond the cap are not planned and
    each range knows how much the ranges before it give; without it one task reads page after page.

    With ``push_filters``, filters on ``page`` (=, in, <, <=, >, >=) choose the pages that are fetched;
    the session's ``spark.sql.python.filterPushdown.enabled`` must be set, or Spark raises. A cap counts
    before filters, so under one nothing is pushed.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema) -> DataSourceReader:
        return (_Filtered if self.options.get("push_filters", "").lower() == "true" else _Reader)(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages, self.step = int(options.get("pages", 1)), int(options.get("pages_per_task", 1))
        self.fetch, self.most, self.size = options["fetch"], int(options.get("max_items", 0)), int(options.get("per_page", 0))
        self.low, self.high, self.only = 1, self.pages, None

    def partitions(self) -> list[InputPartition]:
        if self.only is not None:
            return [_Pages(p, p + 1, None) for p in sorted(self.only) if self.low <= p <= self.high] or [_Pages(1, 1, None)]
        last, step = self.high, self.step
        if self.most and self.size:
            last = min(last, -(-self.most // self.size))
        elif self.most:
            step = max(1, last)
        left = lambda a: max(0, self.most - (a - 1) * self.size) if self.most else None
        return [_Pages(a, min(a + step, last + 1), left(a)) for a in range(self.low, last + 1, step)] or [_Pages(1, 1, None)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        from importlib import import_module

        module, _, name = self.fetch.rpartition(".")
        fetch = getattr(import_module(module), name)
        n = 0
        for page in range(partition.first, partition.last):
            records = fetch(page)
            if not records:
                return
            for r in records:
                if partition.most is not None and n >= partition.most:
                    return
                n += 1
                yield page, json.dumps(r, sort_keys=True)


class _Filtered(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if self.most or getattr(f, "attribute", None) != ("page",):
                yield f
            elif isinstance(f, EqualTo | In):
                only = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = only if self.only is None else self.only & only
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f
