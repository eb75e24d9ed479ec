"""Code context around changes: outlines of files, stabbing joins, symbol windows, supporting files."""

from __future__ import annotations

import ast
import gc
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where modules are looked for, budgets, and the names of what a window comes from.
MODULE_PREFIXES = ("", "src", "lib", "packages")
PAD_LINES, MOST_SYMBOLS, UNTOUCHED_BEFORE, MOST_FALLBACK = 8, 8, 6, 6
MOST_WINDOWS, MOST_IMPORTS, MOST_CALLERS, CALLED_SYMBOLS, HEAD_LINES = 12, 12, 4, 3, 70
FALLBACK_TYPE = "fallback_hunk_window"
BY_IMPORT, BY_COTOUCH, BY_CALL = "resolved_import::", "graphrag_co_touch_neighbor", "rg_callee_occurrence::"

#: Files whose outlines a task holds at once.
FILES = 128

#: Where lines end: as Python's splitlines.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Where statements hold others, in the order of their fields.
_BODIES = ("body", "handlers", "orelse", "finalbody", "cases")
_OUTLINE = "parses boolean, n_lines int, symbols array<struct<lo int, hi int, name string, kind string>>, imports array<struct<module string, kind string>>, called array<string>"


def outline(text: str | None) -> tuple[bool, int, list[dict], list[dict], list[str]]:
    """F-18, F-27, F-28 of one file: whether it parses, its lines, symbols by line, imports in tree order, and words that stand before a bracket.

    An import names the files it may mean, without prefix and ending: that of the module, or, of
    names taken from a module, those of the names. Relative imports are left out.
    """
    text = text or ""
    n, called = len(text.splitlines()), sorted(set(re.findall(r"(\w+)\(", text)))
    try:
        nodes = list(_statements(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False, n, [], [], called
    symbols, imports = [], []
    for x in nodes:
        if isinstance(x, ast.Expr):
            continue
        if isinstance(x, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            symbols.append({"lo": x.lineno, "hi": x.end_lineno, "name": x.name, "kind": "class" if isinstance(x, ast.ClassDef) else "function"})
        elif isinstance(x, ast.Import):
            imports += [{"module": a.name.replace(".", "/"), "kind": "import"} for a in x.names]
        elif isinstance(x, ast.ImportFrom) and not x.level and x.module:
            base = x.module.replace(".", "/")
            imports += [{"module": base, "kind": "import_from_star"} if a.name == "*" else {"module": f"{base}/{a.name}", "kind": "import_from"} for a in x.names]
    return True, n, sorted(symbols, key=lambda s: (s["lo"], s["hi"])), imports, called


@lru_cache(None)
def _holds(kind: type) -> tuple[str, ...]:
    return tuple(part for part in _BODIES if part in kind._fields)


def _statements(tree: ast.AST) -> Iterator[ast.AST]:
    """Statements in the order of ``ast.walk``; definitions and imports stand in no expression, so those are passed by."""
    level = [tree]
    while level:
        yield from level
        level = [y for x in level for part in _holds(type(x)) for y in getattr(x, part)]


def outlines(blobs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """X-5: ``keys`` and the outline of each file; files are parsed by Arrow batches, and their texts stay behind."""
    schema = T.StructType([*(blobs.schema[k] for k in keys), *T._parse_datatype_string(_OUTLINE).fields])
    kinds = [T.StructField("x", f.dataType) for f in schema.fields[len(keys) :]]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(a, FILES) for x in batches for a in range(0, x.num_rows, FILES)):
            gc.disable()  # trees hold no cycles, and looking for some takes long
            try:
                found = [outline(t) for t in b.column(len(keys)).to_pylist()]
            finally:
                gc.enable()
            cols = [pa.array([f[i] for f in found], a) for i, a in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *cols], names=schema.names)

    return blobs.select(*keys, text).mapInArrow(run, schema)


def landed(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back: files are parsed once, whatever reads their outlines."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- stabbing join -----------------------------------------------------------------------------


def stab(points: DataFrame, spans: DataFrame, key: list[str], at: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Every pair of a point and a span lo..hi (both included) of the same ``key`` that holds it, with the columns of both.

    A span is cut into blocks of lengths that are powers of two, two a length at most; a point looks
    in the one block of each length that holds it. So the join is one of equal keys, every pair
    meets in exactly one block, nothing is tried in vain, and a long span is a few dozen rows. Lengths
    go up to the longest span's. Null ends or points, and spans that end before they begin, meet nothing.
    Keys are compared as by ``=``; columns other than ``key`` may not have the same name.
    """
    longest = spans.agg(F.max(F.col(hi).cast("long") - F.col(lo).cast("long") + 1).alias("n")).first().n
    levels = max(1, int(longest or 1).bit_length())
    two = lambda e: F.lit(1 << e).cast("long")

    def nodes(e: int) -> Column:
        a, b = F.ceil(F.col(lo) / two(e)), F.floor((F.col(hi) + 1) / two(e))  # blocks of this length inside the span: a..b-1
        left = F.when((a < b) & (F.abs(a) % 2 == 1), F.struct(F.lit(e).alias("e"), a.cast("long").alias("b")))
        right = F.when((a < b) & (F.abs(b) % 2 == 1), F.struct(F.lit(e).alias("e"), (b - 1).cast("long").alias("b")))
        # below the top, blocks that a longer one holds are left to it; at the top all that remain stay (two at most)
        return F.array(left, right) if e < levels - 1 else F.transform(F.when(a < b, F.sequence(a, b - 1)), lambda x: F.struct(F.lit(e).alias("e"), x.cast("long").alias("b")))

    names = (set(points.columns) | set(spans.columns), "__block")
    block = names[1]
    while block in names[0]:
        block += "_"
    cut = F.filter(F.flatten(F.filter(F.array(*[nodes(e) for e in range(levels)]), lambda x: x.isNotNull())), lambda x: x.isNotNull())
    s = spans.where((F.col(lo) <= F.col(hi))).withColumn(block, F.explode(cut))
    p = points.where(F.col(at).isNotNull()).withColumn(block, F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.floor(F.col(at) / two(e)).cast("long").alias("b")) for e in range(levels)])))
    return p.join(s, [*key, block]).drop(block)


def innermost(points: DataFrame, spans: DataFrame, key: list[str], at: str, id_: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Each point (told by ``key`` and ``id_``) that any span holds, with the span that begins last, of those the one that ends first, of those the least by its other columns."""
    held = stab(points, spans, key, at, lo, hi)
    own = [c for c in spans.columns if c not in key]
    order = F.struct((-F.col(lo)).alias("a"), F.col(hi).alias("b"), *own)
    best = held.groupBy(*key, *id_).agg(F.min(order).alias("m"), *[F.first(c).alias(c) for c in points.columns if c not in {*key, *id_}])
    return best.select(*points.columns, *[F.col(f"m.{c}").alias(c) for c in own])


# --- symbols around a change -------------------------------------------------------------------


def old_lines(headers: Column) -> Column:
    """F-26, before the change: (lo, hi) of the lines each hunk takes; a hunk that takes none touches its place."""
    return F.transform(headers, lambda h: F.struct(h.old_start.alias("lo"), (h.old_start + F.greatest(h.old_count, F.lit(1)) - 1).alias("hi")))


def structural_context(symbols: DataFrame, hunks: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """F-32: of each file, symbols around what a change touches, or else the change's own windows.

    ``symbols`` is (key, lo, hi, name, kind), ``hunks`` (key, nth, lo, hi), lines before the change,
    nth from 1, ``files`` (key, n_lines); a key is one file of one change. A symbol stays if a
    hunk touches it, or if it is among its file's first UNTOUCHED_BEFORE by line; touched
    ones come first, then by line, MOST_SYMBOLS in all, PAD_LINES more on both sides. A file without
    symbols gives its first MOST_FALLBACK hunks, and one line more at their ends. Files that
    ``files`` doesn't have are left out. Rows: key, rank, symbol, symbol_type, start_line, end_line, touched.

    A symbol is touched if a hunk that begins at its last line or before reaches its first: the greatest
    end of those hunks tells, a running one over a file's symbols and hunks in order of lines. So each moves once.
    """
    by = lambda *o: F.row_number().over(Window.partitionBy(*key).orderBy(*o))
    one = ["lo", "hi", "name", "kind"]
    order = [F.col("lo"), F.col("hi"), F.col("name"), F.col("kind")]
    at, reach, touched = "__at", "__reach", "__touched"
    h = hunks.where(F.col("lo").isNotNull()).select(*key, *[F.lit(None).cast(symbols.schema[c].dataType).alias(c) for c in one], F.col("lo").cast("long").alias(at), F.greatest("lo", "hi").cast("long").alias(reach))
    s = symbols.select(*key, *one, F.greatest("lo", "hi").cast("long").alias(at), F.lit(None).cast("long").alias(reach))
    furthest = F.max(reach).over(Window.partitionBy(*key).orderBy(at))  # of rows at the same line, too
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in key])
    marked = s.withColumn("own", F.lit(True)).unionByName(h.withColumn("own", F.lit(False))).withColumn(touched, F.coalesce((furthest >= F.col("lo")) & known, F.lit(False))).where("own")
    # a file's first by line stay, and the touched ones; equal symbols count once
    some = marked.withColumn("nth", by(*order)).where(F.col(touched) | (F.col("nth") <= UNTOUCHED_BEFORE))
    kept = some.groupBy(*key, *one).agg(F.max(touched).alias("touched")).join(files, key)
    start, end = F.greatest(F.lit(1), F.col("lo") - PAD_LINES), F.least(F.col("n_lines"), F.col("hi") + PAD_LINES)
    kept = kept.select(*key, F.col("name").alias("symbol"), F.col("kind").alias("symbol_type"), start.alias("start_line"), end.alias("end_line"), "touched", "lo", "hi")
    ranked = kept.withColumn("rank", by(F.desc("touched"), "start_line", "lo", "hi", "symbol", "symbol_type")).where(F.col("rank") <= MOST_SYMBOLS).drop("lo", "hi")
    bare = hunks.where(F.col("nth") <= MOST_FALLBACK).join(files, key).join(symbols.select(*key).distinct(), key, "left_anti")
    own = bare.select(
        *key, F.concat(F.lit("hunk_"), F.col("nth").cast("string")).alias("symbol"), F.lit(FALLBACK_TYPE).alias("symbol_type"), F.greatest(F.lit(1), F.col("lo") - PAD_LINES).alias("start_line"),
        F.least(F.col("n_lines"), F.col("hi") + 1 + PAD_LINES).alias("end_line"), F.lit(True).alias("touched"), F.col("nth").cast("int").alias("rank"),
    )
    return ranked.unionByName(own).select(*key, "rank", "symbol", "symbol_type", "start_line", "end_line", "touched")


def python_context(blobs: DataFrame, patches: DataFrame, key: list[str], shape: DataFrame | None = None) -> DataFrame:
    """F-32 with texts: ``blobs`` (key, path, text), ``patches`` (key, patch); adds ``code``, the lines of each window.

    ``shape`` is their outlines, best ``landed``: they are read several times.
    Only files whose path ends in .py; of one without lines, the patch stands for its code. A file without a patch shows its first symbols.
    """
    from ..functions.diffs import hunk_headers

    py = blobs.where(F.col("path").endswith(".py"))
    shape = outlines(py, key) if shape is None else shape
    lines = old_lines(hunk_headers(F.col("patch")))
    hunks = patches.select(*key, F.posexplode(lines).alias("i", "h")).select(*key, (F.col("i") + 1).alias("nth"), "h.lo", "h.hi")
    rows = structural_context(shape.select(*key, F.inline("symbols")), hunks, shape.select(*key, "n_lines"), key)
    code = F.array_join(F.slice(F.split("text", LINE_END), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    with_text = rows.join(py.select(*key, "path", "text"), key).join(patches.select(*key, "patch"), key, "left")
    return with_text.withColumn("code", F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.col("patch")).otherwise(code)).drop("text", "patch")


# --- supporting files --------------------------------------------------------------------------


def import_targets(shape: DataFrame, files: DataFrame) -> DataFrame:
    """F-28: (snapshot, path, nth, target, kind): files of the snapshot that a file's imports mean, MOST_IMPORTS of a file at most, in order.

    ``shape`` is (snapshot, path, imports), ``files`` (snapshot, path). An import's candidates stand
    by path; a target that an earlier import gave in the same way counts once.
    """
    names = F.array(*[F.concat(F.lit(f"{p}/" if p else ""), F.col("i.module"), F.lit(e)) for p in MODULE_PREFIXES for e in (".py", "/__init__.py")])
    wanted = shape.select("snapshot", "path", F.posexplode("imports").alias("at", "i")).select("snapshot", "path", "at", F.col("i.kind").alias("kind"), F.explode(names).alias("target"))
    found = wanted.join(files.select("snapshot", F.col("path").alias("target")).distinct(), ["snapshot", "target"])
    once = found.groupBy("snapshot", "path", "target", "kind").agg(F.min("at").alias("at"))
    nth = F.row_number().over(Window.partitionBy("snapshot", "path").orderBy("at", "target", "kind"))
    return once.withColumn("nth", nth).where(F.col("nth") <= MOST_IMPORTS).select("snapshot", "path", "nth", "target", "kind")


def call_index(shape: DataFrame, names: DataFrame) -> DataFrame:
    """Callers, by name: (snapshot, name, path) of files that hold ``name(`` anywhere; ``names`` is (snapshot, name).

    A text search finds a name at the end of a longer word, too; so each word before a bracket stands
    under each of its endings that begins as some name does, and the join is one of equal names.
    """
    initials = names.agg(F.collect_set(F.substring("name", 1, 1)).alias("initials"))  # as many as there are letters, at most
    w = shape.where(F.col("path").endswith(".py")).select("snapshot", "path", F.explode("called").alias("w")).crossJoin(F.broadcast(initials))
    begins = F.filter(F.sequence(F.lit(1), F.length("w")), lambda i: F.array_contains("initials", F.substring(F.col("w"), i, F.lit(1))))
    ends = w.select("snapshot", "path", F.explode(F.transform(begins, lambda i: F.substring(F.col("w"), i, F.length("w")))).alias("name"))
    return ends.join(names.select("snapshot", "name").distinct(), ["snapshot", "name"], "left_semi").distinct()


def supporting_windows(tasks: DataFrame, changed: DataFrame, neighbours: DataFrame, shape: DataFrame) -> DataFrame:
    """F-31: up to MOST_WINDOWS files that help with a change: what its files import, files changed with them, callers of what it touches.

    ``tasks`` is (task, snapshot); ``changed`` (task, path, nth, ranges array of lo, hi), the change's
    own files in order; ``neighbours`` (task, path, nth), best first; ``shape`` the ``outlines`` of
    the snapshots' files by (snapshot, path). Rows: task, rank, path, source, line_start, line_end.

    Order: imports of each changed file (.py) by its place, then neighbours, then, by changed path,
    the first CALLED_SYMBOLS touched symbols (all, where no line is known) with MOST_CALLERS files
    each, by path. Changed files themselves never count, nor files the snapshot doesn't have; a
    file counts once, for its first source. So windows of other symbols of a changed file, which the
    original also looks for, never come to be, and are not built here. A window is a file's first HEAD_LINES lines; an empty file's is 1..1.
    """
    mine = changed.join(tasks, "task")
    py = mine.where(F.col("path").endswith(".py"))
    files = shape.select("snapshot", "path")
    imports = import_targets(shape.join(py.select("snapshot", "path").distinct(), ["snapshot", "path"], "left_semi"), files)
    one = py.select("task", "snapshot", "path", F.col("nth").alias("place")).join(imports, ["snapshot", "path"])
    key = lambda *c: F.struct(*[x.alias(f"k{i}") for i, x in enumerate(c)])
    none, at = F.lit(""), lambda c: F.col(c).cast("long")
    a = one.select("task", "snapshot", F.col("target").alias("path"), F.concat(F.lit(BY_IMPORT), "kind").alias("source"), key(F.lit(1), at("place"), none, at("nth"), none).alias("order"))
    b = neighbours.join(tasks, "task").select("task", "snapshot", "path", F.lit(BY_COTOUCH).alias("source"), key(F.lit(2), at("nth"), none, F.lit(0).cast("long"), none).alias("order"))
    hit = lambda s: (F.size("ranges") == 0) | F.exists("ranges", lambda r: (r.lo <= s.hi) & (r.hi >= s.lo))
    touched = F.slice(F.array_sort(F.transform(F.filter("symbols", hit), lambda s: F.struct(s.lo.alias("lo"), (-s.hi).alias("hi"), s["name"].alias("name")))), 1, CALLED_SYMBOLS)
    called = py.select("task", "snapshot", "path", F.coalesce("ranges", F.array().cast("array<struct<lo:int,hi:int>>")).alias("ranges")).join(shape.select("snapshot", "path", "symbols"), ["snapshot", "path"])
    called = called.select("task", "snapshot", F.col("path").alias("from"), F.posexplode(touched).alias("i", "s")).select("task", "snapshot", "from", "i", F.col("s.name").alias("name"))
    hits = called.join(call_index(shape, called), ["snapshot", "name"]).join(changed.select("task", "path"), ["task", "path"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("task", "from", "i").orderBy("path"))
    hits = hits.withColumn("n", nth).where(F.col("n") <= MOST_CALLERS)
    c = hits.select("task", "snapshot", "path", F.concat(F.lit(BY_CALL), "name").alias("source"), key(F.lit(3), at("i") * 0, F.col("from"), at("i"), F.col("path")).alias("order"))
    every = a.unionByName(b).unionByName(c).join(changed.select("task", "path"), ["task", "path"], "left_anti")
    first = every.groupBy("task", "snapshot", "path").agg(F.min_by("source", "order").alias("source"), F.min("order").alias("order"))
    known = first.join(shape.select("snapshot", "path", "n_lines"), ["snapshot", "path"])
    rank = F.row_number().over(Window.partitionBy("task").orderBy("order", "path"))
    ranked = known.withColumn("rank", rank).where(F.col("rank") <= MOST_WINDOWS)
    return ranked.select("task", "rank", "path", "source", F.lit(1).alias("line_start"), F.greatest(F.lit(1), F.least(F.col("n_lines"), F.lit(HEAD_LINES))).alias("line_end"))
