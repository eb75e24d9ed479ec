"""Queries on source files: a customer is a file, its orders are functions that call the next order's, closed orders are changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.diffs import hunk_headers
from ..operators import code_context as C
from ..operators import datasets as DS
from .catalog import _shared, _t, query

#: Lines of each function, of each file, and of each change, as the texts below have them.
_FILES = """
with o as (select o_custkey as c, o_orderkey as k, o_orderstatus as st, (4 + coalesce(sum(o_orderkey % 4 + 2) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0))::int as lo from orders),
f as (select c, (3 + sum(k % 4 + 2))::int as n_lines from o group by c),
s as (select c, lo, (lo + k % 4 + 1)::int as hi, 'o' || k as name, 'function' as kind from o where c % 7 > 0
  union all select c, 3, n_lines, 'C' || c, 'class' from f where c % 7 > 0),
h as (select c, row_number() over (partition by c order by k) as nth, (k % 60 + 1)::int as lo, (k % 60 + greatest(k % 5, 1))::int as hi from o where st = 'F'),
t as (select s.*, exists (select 1 from h where h.c = s.c and h.lo <= s.hi and h.hi >= s.lo) as touched from s)"""


def _orders(spark, d):
    return _t(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").withColumnsRenamed({"o_custkey": "c", "o_orderkey": "k", "o_orderstatus": "st"})


def _blobs(spark, d):
    """(c, path, text): Python; every seventh file doesn't parse."""
    each = lambda b: F.array_join(F.transform(F.array_sort(F.collect_list("k")), b), "\n")
    body = lambda k: F.concat(F.format_string("    def o%d(self):", k), F.repeat(F.format_string("\n        o%d()", k + 1), (k % 4 + 1).cast("int")))
    g = _orders(spark, d).groupBy("c").agg(each(body).alias("functions"))
    first = F.when(F.col("c") % 7 == 0, F.lit("def (:")).otherwise(F.format_string("import c%d", F.col("c") + 1))
    head = F.concat_ws("\n", first, F.format_string("from c%d import *", F.col("c") + 2), F.format_string("class C%d:", F.col("c")))
    return g.select("c", F.format_string("src/c%d.py", F.col("c")).alias("path"), F.concat_ws("\n", head, "functions").alias("text"))


def _shape(spark, d, blobs, keys):
    return C.landed(C.outlines(blobs, keys), _shared(spark, "outlines"))


def _patches(spark, d):
    """(c, patch): hunks at the orders that are closed."""
    k = _orders(spark, d).where("st = 'F'").groupBy("c").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    head = lambda k: F.format_string("@@ -%d,%d +%d @@", k % 60 + 1, k % 5, k % 60 + 1)
    return k.select("c", F.array_join(F.transform("ks", head), "\n").alias("patch"))


def _hunks(spark, d):
    h = F.posexplode(C.old_lines(hunk_headers(F.col("patch")))).alias("i", "h")
    return _patches(spark, d).select("c", h).select("c", (F.col("i") + 1).alias("nth"), "h.lo", "h.hi")


@query(_FILES + """, p as (select *, row_number() over (partition by c order by lo, hi, name, kind) as pos from t),
k as (select c, name as symbol, kind as symbol_type, greatest(1, lo - 8) as start_line, least(n_lines, hi + 8) as end_line, touched, lo, hi from p join f using (c) where touched or pos <= 6),
r as (select *, row_number() over (partition by c order by touched desc, start_line, lo, hi, symbol) as rank from k)
select c, rank, symbol, symbol_type, start_line, end_line, touched from r where rank <= 8
union all select h.c, nth, 'hunk_' || nth, 'fallback_hunk_window', greatest(1, lo - 8), least(n_lines, hi + 9), true from h join f using (c) where h.c % 7 = 0 and nth <= 6""")
def structural_context(spark, d):
    """F-32, F-26, O-8: symbols around each file's change; hunks where a file doesn't parse."""
    return C.python_context(_blobs(spark, d), _patches(spark, d), ["c"], _shape(spark, d, _blobs(spark, d), ["c"])).select("c", "rank", "symbol", "symbol_type", "start_line", "end_line", "touched")


@query(_FILES + """, j as (select h.c, h.nth, h.lo as line, s.name as symbol, s.hi - s.lo + 1 as n_lines, row_number() over (partition by h.c, h.nth order by s.lo desc, s.hi, s.name) as r
from h join s on s.c = h.c and h.lo between s.lo and s.hi) select c, nth, line, symbol, n_lines from j where r = 1""")
def innermost_symbol(spark, d):
    """F-26, F-27: the innermost symbol that holds a change's first line, by a stabbing join."""
    s = _shape(spark, d, _blobs(spark, d), ["c"]).select("c", F.inline("symbols"))
    got = C.innermost(_hunks(spark, d).select("c", "nth", F.col("lo").alias("line")), s, ["c"], "line", ["nth"])
    return got.select("c", "nth", "line", F.col("name").alias("symbol"), (F.col("hi") - F.col("lo") + 1).alias("n_lines"))


#: Files that help with each file's change.
_HELP = """, own as (select c from f),
i as (select own.c, own.c + 1 as x, 'resolved_import::import' as source, 1 as g, 0 as a from own where c % 7 > 0
  union all select c, c + 2, 'resolved_import::import_from_star', 1, 1 from own where c % 7 > 0
  union all select c, c + 3, 'graphrag_co_touch_neighbor', 2, 0 from own
  union all select c, c + 4, 'graphrag_co_touch_neighbor', 2, 1 from own),
y as (select t.c, t.name, row_number() over (partition by t.c order by t.lo, -t.hi, t.name) - 1 as pos from t join own using (c) where touched or not exists (select 1 from h where h.c = t.c)),
e as (select c, x, source, g, a from i union all
  select y.c, o.c, 'rg_callee_occurrence::' || name, 3, pos from y join o on 'o' || (o.k + 1) = y.name where pos < 3 and o.c <> y.c),
u as (select e.c, x, n_lines, arg_min(source, g * 100 + a) as source, min(g * 100 + a) as ord from e join f on f.c = e.x where e.x <> e.c group by e.c, x, n_lines)"""


@query(_FILES + _HELP + """
select c, row_number() over (partition by c order by ord, 'src/c' || x || '.py') as rank, 'src/c' || x || '.py' as path, source, 1 as line_start, greatest(1, least(n_lines, 70)) as line_end from u""")
def supporting_windows(spark, d):
    """F-31, F-28: files that help with each file's change: imports, files changed with it, callers."""
    blobs = _blobs(spark, d).withColumn("snapshot", F.lit("s"))
    return _helping(spark, d, _shape(spark, d, blobs, ["snapshot", "path"])).withColumnRenamed("task", "c")


def _helping(spark, d, shape):
    mine = _orders(spark, d).select("c").distinct()
    ranges = _patches(spark, d).select("c", C.old_lines(hunk_headers(F.col("patch"))).alias("ranges"))
    path = lambda c: F.format_string("src/c%d.py", c)
    changed = mine.join(ranges, "c", "left").select(F.col("c").alias("task"), path(F.col("c")).alias("path"), F.lit(0).alias("nth"), "ranges")
    near = mine.select(F.col("c").alias("task"), F.posexplode(F.array(F.col("c") + 3, F.col("c") + 4)).alias("nth", "x")).select("task", path(F.col("x")).alias("path"), "nth")
    return C.supporting_windows(mine.select(F.col("c").alias("task"), F.lit("s").alias("snapshot")), changed, near, shape)


@query(_FILES + _HELP + """, p as (select *, row_number() over (partition by c order by lo, hi, name, kind) as pos from t),
n as (select c, least(8, count(*)) as n_symbols, least(8, count(*) filter (touched)) as n_touched from p where touched or pos <= 6 group by c
  union all select c, least(6, count(*)), least(6, count(*)) from h where c % 7 = 0 group by c)
select own.c, coalesce(n_symbols, 0) as n_symbols, coalesce(n_touched, 0) as n_touched, (select count(*) from u where u.c = own.c) as n_supporting,
  coalesce((select arg_min(source, ord) from u where u.c = own.c), 'none') as first_source from own left join n on n.c = own.c""")
def patcher_context(spark, d):
    """L-29, F-31, F-32: examples of each file's change with the symbols around it and the files that help."""
    blobs = _blobs(spark, d).withColumn("snapshot", F.lit("s"))
    shape = _shape(spark, d, blobs, ["snapshot", "path"])
    examples = blobs.select(F.col("c").alias("pr_number"), "path")
    own = shape.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("pr_number"), "path", "n_lines", "symbols")
    key = ["pr_number", "path"]
    hunks = _hunks(spark, d).select(F.col("c").alias("pr_number"), F.format_string("src/c%d.py", "c").alias("path"), "nth", "lo", "hi")
    around = C.structural_context(own.select(*key, F.inline("symbols")), hunks, own.select(*key, "n_lines"), key)
    e = DS.with_code_context(examples, around, _helping(spark, d, shape).withColumnRenamed("task", "pr_number"))
    touched = F.size(F.filter("structural", lambda x: x.touched))
    first = F.coalesce(F.get("supporting", F.lit(0)).source, F.lit("none"))
    return e.select(F.col("pr_number").alias("c"), F.size("structural").alias("n_symbols"), touched.alias("n_touched"), F.size("supporting").alias("n_supporting"), first.alias("first_source"))
