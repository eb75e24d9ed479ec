"""Registered queries: each operator family on the driver's tables, with the same query in SQL."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.diffs import merge_intervals as merge_in_row
from ..functions.times import boundary_days, elapsed_days, max_gap_days
from ..operators import feedback as FB
from ..operators import graph as G
from ..operators import issues as I
from ..operators import metrics as M
from ..operators import relational as R
from ..operators import sampling as S
from ..operators.vector_index import VectorIndex, tfidf_vectors
from ..streaming import streams as ST

#: Makes the lines of an order unique; line numbers alone repeat.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


# --- deduplication, filters, projections -------------------------------------------------------


@query("""
with l as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) r from orders)
select c_mktsegment, count(*) as n_customers, round(sum(o_totalprice), 2) as total
from l join customer on o_custkey = c_custkey where r = 1 and o_orderstatus <> 'F' group by c_mktsegment""")
def latest_open_by_segment(spark, d):
    """A-1, P-2, J-2, A-4: each customer's latest order, without closed ones, counted by segment."""
    o = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    last = R.dedup_latest(o, "o_custkey", F.col("o_orderdate"), F.col("o_orderkey")).where("o_orderstatus <> 'F'")
    c = _t(spark, d, "customer", "c_custkey", "c_mktsegment")
    j = last.join(c, last.o_custkey == c.c_custkey)
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("n_customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
select o_custkey, o_orderkey, o_orderdate, o_totalprice from
  (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) r from orders) where r = 1""")
def dedup_latest(spark, d):
    """A-1."""
    o = _t(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return R.dedup_latest(o, "o_custkey", F.col("o_orderdate"), F.col("o_orderkey"))


@query("select event_type, count(*) as n from events where event_type <> 'error' group by event_type")
def predicate_filter_count(spark, d):
    """P-1, P-2, A-2."""
    return R.counts(_t(spark, d, "events", "event_type").where("event_type <> 'error'"), "event_type")


@query("""
select event_id, left(event_type, 4) as kind, length(props) as props_length, cast(json_extract(props, '$.k') as bigint) as k,
       json_extract(props, '$.missing') is not null as has_missing from events""")
def flatten_variant(spark, d):
    """P-3 to P-5: JSON projected to columns; unreadable JSON gives nulls."""
    v = F.try_parse_json("props")
    return _t(spark, d, "events", "event_id", "event_type", "props").select(
        "event_id", F.left("event_type", F.lit(4)).alias("kind"), F.length("props").alias("props_length"), F.try_variant_get(v, "$.k", "bigint").alias("k"),
        F.try_variant_get(v, "$.missing", "string").isNotNull().alias("has_missing"),
    )


@query("""
select l_orderkey, l_linenumber, date_diff('hour', o_orderdate, l_shipdate) / 24.0 as boundary_days,
       round(date_diff('microsecond', o_orderdate, l_shipdate) / 86400000000.0, 6) as elapsed
from lineitem join orders on l_orderkey = o_orderkey""")
def hour_boundary_days(spark, d):
    """F-36, F-37: hour boundaries against elapsed time."""
    j = _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").join(_t(spark, d, "orders", "o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", boundary_days(F.col("o_orderdate"), F.col("l_shipdate")).alias("boundary_days"), F.round(elapsed_days(F.col("o_orderdate"), F.col("l_shipdate")), 6).alias("elapsed"))


# --- joins, links, graph ----------------------------------------------------------------------


@query("""
with e as (
  select l_orderkey as issue, l_partkey as pr, 1 as source from lineitem where l_returnflag = 'R'
  union all select l_orderkey, l_partkey, 2 from lineitem where l_quantity > 40
  union all select l_orderkey, l_suppkey, 3 from lineitem where l_discount > 0.08)
select issue, list_sort(list(distinct pr)) as resolved_by_prs from e
where issue in (select o_orderkey from orders where o_orderstatus <> 'P') group by issue""")
def link_union(spark, d):
    """J-1, U-1: evidence from several sources, unique, sorted by issue."""
    l = _t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_discount")  # noqa: E741
    one = lambda c, pr, n: l.where(c).select(F.col("l_orderkey").alias("issue"), F.col(pr).alias("pr"), F.lit(n).alias("source"))
    e = one("l_returnflag = 'R'", "l_partkey", 1).unionByName(one("l_quantity > 40", "l_partkey", 2)).unionByName(one("l_discount > 0.08", "l_suppkey", 3))
    known = _t(spark, d, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("issue"))
    return I.link_map(e.join(known, "issue", "left_semi"))


@query("""
with e as (
  select l_orderkey as issue, 1 as source from lineitem where l_returnflag = 'R'
  union all select l_orderkey, 2 from lineitem where l_quantity > 40)
select source, count(*) as matches from e group by source""")
def link_source_counts(spark, d):
    """J-1: matches by source, before they are made unique."""
    l = _t(spark, d, "lineitem", "l_returnflag", "l_quantity")  # noqa: E741
    return I.link_counts(l.where("l_returnflag = 'R'").select(F.lit(1).alias("source")).unionByName(l.where("l_quantity > 40").select(F.lit(2).alias("source"))))


@query("""
select c_custkey, coalesce(list_sort(list(o_orderkey) filter (o_orderkey is not null)), []) as orders, round(coalesce(sum(o_totalprice), 0.0), 2) as total
from customer left join orders on c_custkey = o_custkey group by c_custkey""")
def enrich_left_default(spark, d):
    """J-2, J-6: left join with an empty list and 0.0 as defaults."""
    o = _t(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return R.left_default(_t(spark, d, "customer", "c_custkey"), o, ["c_custkey"], {"orders": F.array().cast("array<bigint>"), "total": F.lit(0.0)})


@query("""
with f as (select o_custkey, min(o_orderdate) as first_date from orders group by o_custkey)
select f.o_custkey, first_date, list_sort(list(o_orderkey)) as seen from f join orders o
on f.o_custkey = o.o_custkey and o.o_orderdate <= f.first_date + interval 90 day group by f.o_custkey, first_date""")
def asof_attach(spark, d):
    """J-3, P-10: what existed within 90 days of a customer's first order."""
    o = _t(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"))
    return R.asof_attach(first, o, ["o_custkey"], F.col("o_orderdate") <= F.col("first_date") + F.expr("interval 90 days"), F.col("o_orderkey"), "seen")


@query("""
with s as (select l_orderkey, max(l_shipdate) as closed from lineitem group by l_orderkey),
t as (select * from (values (7), (14), (28)) v(days))
select o_orderkey, days as tier_days, o_orderdate + to_days(days::int) as snapshot_date
from orders join s on o_orderkey = l_orderkey cross join t where closed > o_orderdate + to_days(days::int)""")
def tier_explode_gate(spark, d):
    """L-12, P-15: a snapshot for each tier at which the order is still open."""
    closed = _t(spark, d, "lineitem", "l_orderkey", "l_shipdate").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("closed"))
    o = _t(spark, d, "orders", "o_orderkey", "o_orderdate").join(closed, "o_orderkey").withColumn("tier_days", F.explode(F.array(*map(F.lit, (7, 14, 28)))))
    return o.withColumn("snapshot_date", F.col("o_orderdate") + F.make_dt_interval("tier_days")).where("closed > snapshot_date").select("o_orderkey", "tier_days", "snapshot_date")


@query("""
with l as (select l_orderkey, count(*) as n, max(l_quantity) as q, max(l_discount) as disc, bool_or(l_returnflag = 'R') as ret from lineitem group by l_orderkey),
s as (select o_orderkey, least(1.0, greatest(0.0, least(o_totalprice / 400000.0, 1.0) * 0.4
  + case when n > 4 then 0.15 else 0.0 end + case when q > 45 then 0.1 else 0.0 end + case when ret then 0.15 else 0.0 end
  + case when disc > 0.08 then 0.1 else 0.0 end)) as score from orders join l on o_orderkey = l_orderkey)
select o_orderkey, round(score, 3) as score, case when score < 0.35 then 'low' when score < 0.65 then 'medium' else 'high' end as band from s""")
def signal_score(spark, d):
    """L-1, L-11, L-13: weighted signals, clamped, in fixed bands."""
    l = _t(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_discount", "l_returnflag").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"), F.max("l_discount").alias("disc"), F.bool_or(F.col("l_returnflag") == "R").alias("ret"))  # noqa: E741
    j = _t(spark, d, "orders", "o_orderkey", "o_totalprice").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    on = lambda c, w: F.when(c, w).otherwise(0.0)
    score = X.clamp01(F.least(F.col("o_totalprice") / 400000.0, F.lit(1.0)) * 0.4 + on(F.col("n") > 4, 0.15) + on(F.col("q") > 45, 0.1) + on(F.col("ret"), 0.15) + on(F.col("disc") > 0.08, 0.1))
    return j.select("o_orderkey", F.round(score, 3).alias("score"), I.band_fixed(score).alias("band"))


@query("""
with s as (select o_orderkey, round(o_totalprice / 500000.0, 9) as score from orders where o_orderstatus = 'O')
select o_orderkey, score, case when score < 0.35 then 'low' when score < 0.65 then 'medium' else 'high' end as band, score >= 0.65 as wants_reason
from s order by score desc, o_orderkey limit 5""")
def top_risk_items(spark, d):
    """O-3: the five riskiest open orders."""
    o = _t(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus").where("o_orderstatus = 'O'")
    return I.risk_ranking(o.select("o_orderkey", F.round(F.col("o_totalprice") / 500000.0, 9).alias("score")), "score", "o_orderkey", 5)


# --- ranks and windows ------------------------------------------------------------------------


@query("""
with r as (select o_totalprice as v, row_number() over (order by o_totalprice) - 1 as i, count(*) over () as n from orders)
select max(n) as n, min(v) as "min", max(v) filter (i = floor(n * 0.25)) as p25, max(v) filter (i = n // 2) as p50,
       max(v) filter (i = floor(n * 0.75)) as p75, max(v) filter (i = floor(0.9 * (n - 1))) as p90, max(v) as "max" from r""")
def rank_percentiles(spark, d):
    """A-8, A-11, A-14: values at floored places, not interpolated."""
    places = {"p25": "floor(n * 0.25)", "p50": "floor(n / 2)", "p75": "floor(n * 0.75)", "p90": "floor(0.9 * (n - 1))"}
    return R.rank_value(_t(spark, d, "orders", "o_totalprice"), "o_totalprice", places)


@query("""
with r as (select o_orderpriority as p, o_totalprice as v, row_number() over (partition by o_orderpriority order by o_totalprice) - 1 as i, count(*) over (partition by o_orderpriority) as n from orders)
select p as o_orderpriority, max(n) as n, min(v) as "min", max(v) filter (i = n // 2) as p50, max(v) as "max" from r group by p""")
def rank_percentiles_by_group(spark, d):
    """A-7 by group."""
    return R.rank_value(_t(spark, d, "orders", "o_orderpriority", "o_totalprice"), "o_totalprice", {"p50": "floor(n / 2)"}, ["o_orderpriority"])


@query("""
with r as (select o_orderkey, o_totalprice as v, row_number() over (order by o_totalprice) - 1 as i, count(*) over () as n from orders),
t as (select max(v) filter (i = floor(n * 0.33)) as p33, max(v) filter (i = floor(n * 0.66)) as p66 from r)
select case when v <= p33 then 'Low' when v <= p66 then 'Medium' else 'High' end as band, count(*) as n, min(v) as lowest from r cross join t group by 1""")
def band_quantile(spark, d):
    """A-12, L-14, A-13."""
    o = _t(spark, d, "orders", "o_totalprice")
    t = R.rank_value(o, "o_totalprice", {"p33": "floor(n * 0.33)", "p66": "floor(n * 0.66)"})
    return I.band_quantile(o, "o_totalprice", t).groupBy("band").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lowest"))


@query("""
with g as (select user_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) as gap from events)
select user_id, max(gap) / 1e6 as max_gap_s, count(*) as n from g group by user_id""")
def max_gap(spark, d):
    """W-1 to W-3 over rows."""
    return R.max_gap(_t(spark, d, "events", "user_id", "ts"), ["user_id"], "ts")


@query("""
with g as (select user_id, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts)) / 86400e6 as gap from events)
select user_id, round(max(gap), 6) as gap_days from g group by user_id""")
def max_gap_in_row(spark, d):
    """W-1 to W-3 in a row: over an array of times."""
    e = _t(spark, d, "events", "user_id", "ts").groupBy("user_id").agg(F.collect_list("ts").alias("t"))
    return e.select("user_id", F.round(max_gap_days(F.col("t")), 6).alias("gap_days"))


@query("""
with r as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as a, row_number() over (partition by user_id order by ts desc, event_id desc) as z from events)
select user_id, event_id, case when a <= 3 then 'first' else 'last' end as edge from r where a <= 3 or z <= 3""")
def first_last_k(spark, d):
    """W-5, W-7: a user's first and last three events."""
    return R.first_last(_t(spark, d, "events", "user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", "edge")


@query("""
with e as (select distinct user_id, epoch_us(ts) // 60000000 as lo, epoch_us(ts) // 60000000 + 720 as hi from events),
b as (select *, max(hi) over (partition by user_id order by lo, hi rows between unbounded preceding and 1 preceding) as before from e),
i as (select *, sum(case when lo <= before + 1 then 0 else 1 end) over (partition by user_id order by lo, hi rows unbounded preceding) as island from b)
select user_id, min(lo) as lo, max(hi) as hi from i group by user_id, island""")
def interval_merge(spark, d):
    """W-8 over rows: twelve-hour intervals of a user made one where they touch."""
    lo = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    e = _t(spark, d, "events", "user_id", "ts").select("user_id", lo.alias("lo"), (lo + 720).alias("hi"))
    return R.merge_intervals(e, ["user_id"], "lo", "hi")


@query("""
with e as (select distinct l_orderkey, l_linenumber * 5 as lo, l_linenumber * 5 + cast(l_quantity as int) // 8 as hi from lineitem),
b as (select *, max(hi) over (partition by l_orderkey order by lo, hi rows between unbounded preceding and 1 preceding) as before from e),
i as (select *, sum(case when lo <= before + 1 then 0 else 1 end) over (partition by l_orderkey order by lo, hi rows unbounded preceding) as island from b),
m as (select l_orderkey, island, min(lo) as lo, max(hi) as hi from i group by l_orderkey, island)
select l_orderkey, count(*) as n_islands, sum(hi - lo + 1)::bigint as covered from m group by l_orderkey""")
def interval_merge_in_row(spark, d):
    """W-8 in a row: over an array of intervals."""
    lo = F.col("l_linenumber") * 5
    e = _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey").agg(F.collect_list(F.struct(lo.alias("lo"), (lo + F.floor(F.col("l_quantity") / 8).cast("int")).alias("hi"))).alias("v"))
    m = e.select("l_orderkey", merge_in_row(F.col("v")).alias("m"))
    return m.select("l_orderkey", F.size("m").alias("n_islands"), F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x.hi - x.lo + 1).alias("covered"))


@query("""
with w as (select l_orderkey, l_linenumber, cast(l_quantity as int) as size, sum(cast(l_quantity as int)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding) as s from lineitem)
select l_orderkey, l_linenumber, greatest(0, least(size, 100 - (s - size)))::bigint as kept from w where greatest(0, least(size, 100 - (s - size))) > 0""")
def budget_clip(spark, d):
    """W-9: a running budget; the last piece is cut."""
    e = _t(spark, d, "lineitem", "l_orderkey", *LINE_ORDER, "l_quantity").withColumn("size", F.col("l_quantity").cast("int"))
    return R.clip_budget(e, ["l_orderkey"], LINE_ORDER, "size", 100).select("l_orderkey", "l_linenumber", F.col("kept").cast("bigint").alias("kept"))


@query("""
with w as (select l_orderkey, l_linenumber, sum(cast(l_quantity as int)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding) as s from lineitem)
select l_orderkey, l_linenumber from w where s <= 100""")
def budget_stop(spark, d):
    """W-10, W-11: everything before the first piece over the budget."""
    e = _t(spark, d, "lineitem", "l_orderkey", *LINE_ORDER, "l_quantity").withColumn("size", F.col("l_quantity").cast("int"))
    return R.stop_at_budget(e, ["l_orderkey"], LINE_ORDER, "size", 100).select("l_orderkey", "l_linenumber")


@query("""
select event_id, round(sum(value) over (partition by user_id order by epoch_us(ts) // 1000000 range between 86400 preceding and current row), 4) as used from events""")
def window_usage(spark, d):
    """A-22, T-7: use over the last day."""
    return R.window_usage(_t(spark, d, "events", "event_id", "user_id", "ts", "value"), ["user_id"], "ts", "value", 86_400).select("event_id", F.round("used", 4).alias("used"))


@query("""
with w as (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as item from documents)
select length(item) as size, count(*) as n from w group by 1""")
def word_size_frequency(spark, d):
    """A-4: counts of exploded items."""
    w = _t(spark, d, "documents", "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("item"))
    return w.groupBy(F.length("item").cast("bigint").alias("size")).agg(F.count("*").alias("n"))


@query("""
with e as (select lang as item, min(doc_id) as first, count(*) as n from documents group by lang) select item, n from e order by n desc, first limit 3""")
def label_frequency(spark, d):
    """A-4: the most frequent labels; ties by first appearance."""
    return R.frequency(_t(spark, d, "documents", "doc_id", "lang"), F.array("lang"), 3, F.col("doc_id"))


# --- samples, splits, sets --------------------------------------------------------------------


@query("""
with h as (select o_orderkey, md5(cast(o_orderkey as varchar)) as m from orders),
w as (select o_orderkey, ('0x' || substr(m, 1, 8))::bigint as a, ('0x' || substr(m, 9, 8))::bigint as b, ('0x' || substr(m, 17, 8))::bigint as c, ('0x' || substr(m, 25, 8))::bigint as d from h)
select o_orderkey from w where ((((((a % 100) * 96 + b) % 100) * 96 + c) % 100) * 96 + d) % 100 < 30""")
def hash_sample(spark, d):
    """F-40: 30 per cent of keys by md5."""
    return S.hash_sample(_t(spark, d, "orders", "o_orderkey"), "o_orderkey", 0.3)


@query("""
with k as (select distinct doc_id, quality from labels),
r as (select *, row_number() over (partition by quality order by md5(doc_id || ':42'), doc_id) as r, count(*) over (partition by quality) as n from k)
select doc_id, quality, case when r <= greatest(1, round_even(n * 0.1, 0)) then 'test'
  when r <= greatest(1, round_even(n * 0.1, 0)) * 2 then 'val' else 'train' end as split from r""")
def stratified_split(spark, d):
    """R-1, R-2, R-4."""
    return S.stratified_split(_t(spark, d, "labels", "doc_id", "quality"), "doc_id", "quality", 42)


@query("""
with r as (select doc_id, toxic, row_number() over (partition by toxic order by md5(doc_id || ':7'), doc_id) as r from labels) select doc_id, toxic from r where r <= 40""")
def balanced_sample(spark, d):
    """R-3, R-5, R-6: a sampling operator; 40 of each class."""
    return S.balanced_sample(_t(spark, d, "labels", "doc_id", "toxic"), "doc_id", "toxic", 40, 7)


@query("""
with c as (select min(n) as cap from (select count(*) as n from labels group by quality)),
r as (select doc_id, quality, row_number() over (partition by quality order by md5(doc_id || ':7'), doc_id) as r from labels)
select doc_id, quality from r, c where r <= least(cap, 250)""")
def scarcest_cap(spark, d):
    """R-7."""
    return S.scarcest_cap(_t(spark, d, "labels", "doc_id", "quality"), "doc_id", "quality", 250, 7).select("doc_id", "quality")


@query("select o_orderkey, case when o_orderdate < timestamp '1996-01-01' then 'train' else 'test' end as split from orders")
def time_split(spark, d):
    """R-8."""
    return S.time_split(_t(spark, d, "orders", "o_orderkey", "o_orderdate"), "o_orderdate", "1996-01-01").select("o_orderkey", "split")


@query("select doc_id from documents where regexp_matches(text, '(?i)license|copyright')")
def leak_rows(spark, d):
    """R-9: rows whose text holds forbidden terms."""
    return S.leaks(_t(spark, d, "documents", "doc_id", "text"), "text", r"(?i)license|copyright").select("doc_id")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O' and o_orderpriority = '1-URGENT')")
def anti_join(spark, d):
    """J-8, J-12, G-5: customers without an urgent open order."""
    o = _t(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'")
    return R.without_done(_t(spark, d, "customer", "c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def semi_join(spark, d):
    """K-17, U-2."""
    return R.verified(_t(spark, d, "documents", "doc_id"), _t(spark, d, "labels", "doc_id"), ["doc_id"])


@query("""
select 'intersect' as op, count(*) as n from (select l_partkey from lineitem where l_quantity > 45 intersect select l_partkey from lineitem where l_discount > 0.08)
union all select 'except', count(*) from (select l_partkey from lineitem where l_quantity > 45 except select l_partkey from lineitem where l_discount > 0.08)
union all select 'union', count(*) from (select l_partkey from lineitem where l_quantity > 45 union select l_partkey from lineitem where l_discount > 0.08)""")
def set_ops(spark, d):
    """U-1, U-2, U-6."""
    l = _t(spark, d, "lineitem", "l_partkey", "l_quantity", "l_discount")  # noqa: E741
    a, b = l.where("l_quantity > 45").select("l_partkey"), l.where("l_discount > 0.08").select("l_partkey")
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return one("intersect", a.intersect(b)).unionByName(one("except", a.subtract(b))).unionByName(one("union", a.union(b).distinct()))


@query("""
select s_suppkey, s_name, case when s_suppkey % 7 = 0 then round(s_acctbal * 2, 2) else s_acctbal end as s_acctbal, s_nationkey from supplier
union all select s_suppkey + 1000000, s_name, round(s_acctbal * 2, 2), s_nationkey from supplier where s_suppkey % 7 = 1""")
def upsert_merge(spark, d):
    """K-5, K-21: changed rows replace theirs, new ones are added, names stay as they were."""
    base = _t(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    changed = base.where("s_suppkey % 7 = 0").withColumns({"s_name": F.lit("changed"), "s_acctbal": F.round(F.col("s_acctbal") * 2, 2)})
    new = base.where("s_suppkey % 7 = 1").withColumns({"s_suppkey": F.col("s_suppkey") + 1_000_000, "s_acctbal": F.round(F.col("s_acctbal") * 2, 2)})
    return R.upsert(base, changed.unionByName(new), ["s_suppkey"], keep_on_match=["s_name"])


@query("""
with r as (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events where event_id % 3 > 0)
select event_id, user_id, event_type from r where r = 1 and (user_id, event_type) not in (select user_id, event_type from events where event_id % 3 = 0)""")
def insert_new(spark, d):
    """K-20: the first event of a key that is not known yet."""
    e = _t(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    return R.insert_new(e.where("event_id % 3 = 0"), e.where("event_id % 3 > 0"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "event_type")


# --- vectors and retrieval --------------------------------------------------------------------

_TOPK = """
with q as (select vec_id as qid, label as ql, embedding::double[] as q from embeddings where vec_id % 20 = 0),
s as (select qid, ql, vec_id as vid, label as vl, round(list_cosine_similarity(q, embedding::double[]), 6) as score from q cross join embeddings),
t as (select *, row_number() over (partition by qid order by score desc, vid) as rank from s)"""


def _topk(spark, d, k=8):
    e = _t(spark, d, "embeddings", "vec_id", "embedding")
    return G.vector_topk_in_blocks(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e, k)


@query(_TOPK + " select qid, vid, round(score, 4) as score, rank from t where rank <= 8 and qid <> vid")
def vector_topk(spark, d):
    """V-1, G-6: eight nearest of each query, self dropped after the cut."""
    return _topk(spark, d).where("qid <> vid").select("qid", "vid", F.round("score", 4).alias("score"), "rank")


@query(_TOPK + """, n as (select qid, vl, sum(score) as w from t where rank <= 8 and qid <> vid group by qid, vl),
r as (select *, row_number() over (partition by qid order by round(w, 4) desc, vl) as rank from n) select qid, vl as label, round(w, 4) as weight, rank from r where rank <= 6""")
def graph_rank_files(spark, d):
    """G-6, G-7: neighbours' labels by summed similarity."""
    top = _topk(spark, d).where("qid <> vid").join(_t(spark, d, "embeddings", "vec_id", "label").withColumnRenamed("vec_id", "vid"), "vid")
    r = G.rank_files(top.select("qid", F.col("label").alias("filename"), "score").groupBy("qid", "filename").agg(F.round(F.sum("score"), 4).alias("score")))
    return r.select("qid", F.col("filename").alias("label"), F.round("weight", 4).alias("weight"), "rank")


@query(_TOPK + """, k as (select * from t where rank <= 8 and qid <> vid),
g as (select qid, vl, sum(score) as w from k group by qid, vl),
a as (select qid, avg(score) filter (rank <= 3 or r2 <= 3) as m3 from (select *, row_number() over (partition by qid order by score desc, vid) as r2 from k) where r2 <= 3 group by qid),
w as (select qid, list_sort(list(w), 'DESC') as ws, sum(w) as tot from g group by qid),
x as (select w.qid, least(greatest(m3, 0), 1) as m3, least(greatest((ws[1] - coalesce(ws[2], 0)) / greatest(ws[1], 1e-9), 0), 1) as margin,
  least(greatest(list_sum([-(v / tot) * ln(v / tot + 1e-12) for v in ws if v > 0]) / greatest(ln(greatest(len([v for v in ws if v > 0]), 1)), 1e-9), 0), 1) as ent, len(ws) as c from w join a using (qid))
select qid, round(m3, 3) as sim_top3_mean, round(margin, 3) as margin_norm, round(ent, 3) as entropy_norm, c as candidate_count from x""")
def retrieval_confidence(spark, d):
    """A-25: confidence of each query's neighbours."""
    top = _topk(spark, d).where("qid <> vid").join(_t(spark, d, "embeddings", "vec_id", "label").withColumnRenamed("vec_id", "vid"), "vid")
    w = top.groupBy("qid", "label").agg(F.sum("score").alias("w")).groupBy("qid").agg(F.collect_list("w").alias("ws"))
    s = top.groupBy("qid").agg(F.collect_list("score").alias("ss")).join(w, "qid").select("qid", G.retrieval_confidence(F.col("ss"), F.col("ws")).alias("c"))
    return s.select("qid", F.col("c.sim_top3_mean").alias("sim_top3_mean"), F.col("c.margin_norm").alias("margin_norm"), F.col("c.entropy_norm").alias("entropy_norm"), F.col("c.candidate_count").alias("candidate_count"))


@query(_TOPK + """, n as (select qid, vid, score, row_number() over (partition by qid order by score desc, vid) as rank from t where rank <= 6 and qid <> vid)
select qid as src, vid as dst, round(score, 4) as score, rank from n where rank <= 5""")
def similar_edges(spark, d):
    """G-13: edges to the five most similar others."""
    e = _t(spark, d, "embeddings", "vec_id", "embedding")
    return G.similar_edges(e.where("vec_id % 20 = 0"), e).withColumn("score", F.round("score", 4))


def _index(spark, d) -> tuple[VectorIndex, DataFrame]:
    e = _t(spark, d, "embeddings", "vec_id", "embedding")
    return VectorIndex.create(e, _shared(spark, "vectors")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query(_TOPK + " select qid, vid, round(score, 4) as score, rank from t where rank <= 8")
def vector_index_all_lists(spark, d):
    """K-24, V-1: an index's search through all its lists: exact."""
    index, q = _index(spark, d)
    return index.search(q, 8, len(index.centroids)).select("qid", "vid", F.round("score", 4).alias("score"), "rank")


@query()
def vector_index_search(spark, d):
    """K-24, V-1: an index's search through as many lists as an audit of 200 queries asks for (0.9 of the neighbours found)."""
    index, q = _index(spark, d)
    return index.search(q, 8, index.enough_lists(q, 8)).select("qid", "vid", F.round("score", 4).alias("score"), "rank")


@query("""
with d as (select doc_id, [x for x in regexp_split_to_array(lower(concat(source, chr(10), text)), '[^\\p{L}\\p{N}]+') if x <> ''] as w from documents),
u as (select doc_id, ('0x' || substr(md5(unnest(w)), 1, 8))::bigint % 384 as slot from d),
t as (select doc_id, slot, count(*) as tf from u group by all),
i as (select slot, ln(((select count(*) from documents) + 1.0)::double / (count(*) + 1)) as idf from t group by slot),
v as (select doc_id, slot, tf * idf as v from t join i using (slot)),
n as (select doc_id, sqrt(sum(v * v)) as norm from v group by doc_id)
select doc_id, count(*) filter (v > 0) as n_places, round(max(v / norm), 5) as largest, round(sum(v / norm), 4) as total from v join n using (doc_id) where norm > 0 group by doc_id""")
def text_vectors(spark, d):
    """V-2: hashed word weights of documents."""
    slot = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long")
    v = tfidf_vectors(_t(spark, d, "documents", "doc_id", "source", "text"), "doc_id", "source", "text", 384, slot).where("embedding is not null")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return v.select("doc_id", F.size(F.filter("embedding", lambda x: x > 0)).alias("n_places"), F.round(F.array_max("embedding"), 5).alias("largest"), F.round(total, 4).alias("total"))


@query("""
with w as (select len(string_split_regex(trim(text, e' \\t\\n\\x0b\\x0c\\r'), '[ \\t\\n\\x0b\\x0c\\r]+')) as k from documents),
r as (select k, row_number() over (order by k) - 1 as i, count(*) over () as n from w)
select max(n) as n, min(k) as min, max(k) filter (i = n // 2) as median, max(k) filter (i = (n * 9) // 10) as p90, max(k) as max, count(*) filter (k > 500) as over from r""")
def token_report(spark, d):
    """A-21: words of documents, and those beyond a limit."""
    w = F.size(F.split(F.trim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), r"[ \t\n\x0b\f\r]+")).alias("k")
    return R.token_report(_t(spark, d, "documents", "text").select(w), "k", 500)


@query("select s_suppkey, s_acctbal from supplier order by s_acctbal, s_suppkey limit 5")
def weakest(spark, d):
    """O-11: suppliers of the least balance."""
    return R.weakest(_t(spark, d, "supplier", "s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey")


@query("""
with w as (select doc_id, string_split(text, ' ') as w from documents)
select doc_id, len(list_distinct(w)) as n_unique, w[1] as first, array_to_string(list_sort(list_distinct(w)), ' ') as sorted from w""")
def unique_words(spark, d):
    """W-12, U-4: words of texts once each, in order and sorted."""
    w = _t(spark, d, "documents", "doc_id", "text").select("doc_id", F.split("text", " ").alias("w"))
    u = w.select("doc_id", R.unique_in_order(F.col("w")).alias("u"), R.unique_sorted(F.col("w")).alias("s"))
    return u.select("doc_id", F.size("u").alias("n_unique"), F.get("u", F.lit(0)).alias("first"), F.array_join("s", " ").alias("sorted"))


@query("""
with q as (select p_partkey as qid, unnest(string_split(lower(p_name), ' ')) as w from part where p_partkey % 20 = 0),
u as (select distinct qid, w from q where regexp_full_match(w, '[a-z]{4,}')),
s as (select 'part/' || p_partkey || '.py' as path, p_name as symbol, p_size as start_line from part),
h as (select distinct qid, path, symbol, start_line from u join s on contains(lower(symbol), w) or contains(lower(regexp_extract(path, '([^/]*)$', 1)), w)),
r as (select *, row_number() over (partition by qid order by path, start_line, symbol) as rank from h) select qid, path, symbol, start_line, rank from r where rank <= 20""")
def code_spans(spark, d):
    """P-33: parts as symbols, searched with the words of parts' names."""
    p = _t(spark, d, "part", "p_partkey", "p_name", "p_size")
    s = F.struct(F.col("p_name").alias("name"), F.lit("type").alias("type"), F.col("p_size").alias("start_line"), F.col("p_size").alias("end_line"))
    index = p.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.array(s).alias("symbols"))
    asked = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("text"))
    return G.code_spans(index, asked).select("qid", "path", "symbol", "start_line", "rank")


@query("""
with s as (select distinct l_partkey as seed from lineitem where l_partkey % 20 = 0),
h as (select distinct l_orderkey, l_partkey as seed from lineitem where l_partkey in (select seed from s)),
n as (select seed, l_partkey as part, count(distinct lineitem.l_orderkey) as n from h join lineitem using (l_orderkey) where l_partkey <> seed group by 1, 2),
r as (select *, row_number() over (partition by seed order by n desc, part) as rank from n) select seed, part, n, rank from r where rank <= 5""")
def cotouch(spark, d):
    """G-8: parts ordered together with the seeds."""
    t = _t(spark, d, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("pr"), F.col("l_partkey").alias("filename")).distinct()
    return G.cotouched(t, t.where("filename % 20 = 0"), 5).select("seed", F.col("filename").alias("part"), "n", "rank")


@query("select l_partkey as part, count(distinct l_orderkey) as n from lineitem group by 1")
def change_counts(spark, d):
    """G-10."""
    t = _t(spark, d, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("pr"), F.col("l_partkey").alias("filename"))
    return G.change_counts(t).select(F.col("filename").alias("part"), "n")


@query("""
select o_orderpriority as label, count(*) as n, round(avg(o_totalprice), 4) as avg, round(quantile_cont(o_totalprice, 0.5), 4) as p50, round(quantile_cont(o_totalprice, 0.9), 4) as p90 from orders group by 1""")
def label_stats(spark, d):
    """G-12: interpolated percentiles by label."""
    o = _t(spark, d, "orders", "o_orderpriority", "o_totalprice").select(F.array("o_orderpriority").alias("labels"), F.col("o_totalprice").alias("days_open"))
    return G.label_stats(o).select("label", "n", *[F.round(c, 4).alias(c) for c in ("avg", "p50", "p90")])


@query("""
with w as (select doc_id, (case when contains(lower(source), 'src1') then 2 else 0 end) + (case when contains(lower(text), 'tion') then 1 else 0 end) + (case when contains(lower(text), 'heit') then 1 else 0 end) as score from documents)
select doc_id, score from w where score > 0 order by score desc, doc_id limit 40""")
def keyword_rank(spark, d):
    """Documents by keywords, as expressions; the operator is in keyword_rank_quiet."""
    i = _t(spark, d, "documents", "doc_id", "source", "text")
    hit = lambda c, w: F.contains(F.lower(c), F.lit(w)).cast("int")
    score = 2 * hit("source", "src1") + hit("text", "tion") + hit("text", "heit")
    return i.select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(40)


@query("""
with w as (select p_partkey as qid, string_split(lower(p_name), ' ') as words from part where p_partkey % 20 = 0),
i as (select 'src/' || lower(p_brand) || '/' || p_partkey || '.py' as path, lower(p_name) as symbol, lower(p_type) as kind from part where p_size <> 1),
s as (select qid, path, list_sum([case when contains(path, x) then 2 else 0 end + case when contains(symbol, x) then 1 else 0 end + case when contains(kind, x) then 1 else 0 end for x in words])::bigint as score from w cross join i),
r as (select *, row_number() over (partition by qid order by score desc, path) as rank from s where score > 0) select qid, path, score, rank from r where rank <= 10""")
def keyword_rank_quiet(spark, d):
    """O-4, O-5: parts as indexed files, asked with the words of parts' names; noisy paths are left out."""
    p = _t(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    noise = F.when(F.col("p_size") == 1, "vendor/").otherwise("src/")
    index = p.select(F.concat(noise, F.lower("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.array("p_name").alias("classes"), F.array("p_type").alias("functions"))
    words = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("qid"), F.split(F.lower("p_name"), " ").alias("words"))
    return G.keyword_rank(index, words, 10, "^vendor/").select("qid", "path", F.col("score").cast("long").alias("score"), "rank")


@query(_TOPK + """, k as (select qid, vid, round(score, 4) as score from t where rank <= 8 and qid <> vid),
r as (select distinct l_suppkey as issue, l_orderkey as pr from lineitem where l_quantity > 48), f as (select distinct l_orderkey as pr, l_partkey as part from lineitem where l_quantity > 48)
select qid, vid as issue, score, count(*) as n_files from k join r on r.issue = k.vid join f using (pr) group by all""")
def graph_retrieve_files(spark, d):
    """G-6: from neighbours over suppliers' orders to parts: paths by neighbour."""
    line = _t(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_partkey", "l_quantity").where("l_quantity > 48")
    resolved = line.select(F.col("l_suppkey").alias("issue"), F.col("l_orderkey").alias("pr")).distinct()
    touches = line.select(F.col("l_orderkey").alias("pr"), F.col("l_partkey").alias("filename")).distinct()
    rows = G.retrieve_files(_topk(spark, d), resolved, touches)
    return rows.groupBy("qid", "issue", F.round("score", 4).alias("score")).agg(F.count("*").alias("n_files"))


# --- text -------------------------------------------------------------------------------------


@query(r"""
select doc_id, length(trim(regexp_replace(regexp_replace(text, 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g'))) as n_clean,
  array_to_string([x for x in regexp_split_to_array(text, '\s+') if x <> ''][1:5], ' ') as head from documents""")
def text_clean(spark, d):
    """F-9, F-10: urls out, white space collapsed, first words."""
    t = _t(spark, d, "documents", "doc_id", "text")
    return t.select("doc_id", F.length(X.collapse(F.regexp_replace("text", r"https?://\S+", " "))).alias("n_clean"), X.first_words(F.col("text"), 5).alias("head"))


@query(r"""
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text, '(?i)lgtm', '[STRIPPED]', 'g'), '(?i)fixed\s+in', '[STRIPPED]', 'g'), '(?i)resolved\s+by', '[STRIPPED]', 'g'), '(?i)closing\s+#\d+', '[STRIPPED]', 'g'),
  '(?i)merged', '[STRIPPED]', 'g'), '(?i)merging\s+this', '[STRIPPED]', 'g'), '(?i)resolution_days', '[STRIPPED]', 'g'), '(?i)closed_at', '[STRIPPED]', 'g')) as stripped from documents""")
def strip_signals(spark, d):
    """F-6."""
    return _t(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(X.strip_closure_signals(F.col("text"))).alias("stripped"))


@query(r"""select page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) as n_links, coalesce(list_aggregate(regexp_extract_all(html, 'href="([^"]*)"', 1), 'max'), '') as last_link from pages""")
def regex_links(spark, d):
    """F-1 to F-3: all matches of a pattern's group."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return _t(spark, d, "pages", "page_id", "html").select("page_id", F.size(links).alias("n_links"), F.coalesce(F.array_max(links), F.lit("")).alias("last_link"))


@query("""
select doc_id, greatest(1, length(text) // 4) as approx_tokens, len([x for x in regexp_split_to_array(text, '[ \\t\\n\\r]+') if x <> '']) as words from documents""".replace("\\\\", "\\"))
def token_estimates(spark, d):
    """F-33."""
    return _t(spark, d, "documents", "doc_id", "text").select("doc_id", X.approx_tokens(F.col("text")).alias("approx_tokens"), F.size(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda x: x != "")).alias("words"))


@query("""
with m as (select *, last_value(case when role = 'user' and trim(text) <> '' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as prompt from conversations)
select conv_id, turn, md5(prompt) as prompt, md5(text) as rejected from m where role = 'assistant' and prompt is not null""")
def prompt_pairs(spark, d):
    """J-13: an answer and the nearest question before it."""
    c = _t(spark, d, "conversations", "conv_id", "turn", "role", "text")
    m = c.select(F.col("conv_id").alias("thread"), F.col("turn").alias("ts"), F.col("turn").alias("seq"), "text", F.when(F.col("role") != "user", F.col("role")).alias("bot_id"))
    p = FB.prompt_and_rejected(m, c.where("role = 'assistant'").select(F.col("conv_id").alias("thread"), F.col("turn").alias("ts")))
    return p.select(F.col("thread").alias("conv_id"), F.col("ts").alias("turn"), F.md5("prompt_text").alias("prompt"), F.md5("rejected_text").alias("rejected"))


@query("""with r as (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as r from conversations) select conv_id, turn from r where r <= 10""")
def recent_history(spark, d):
    """W-7, T-4."""
    return R.top_per_group(_t(spark, d, "conversations", "conv_id", "turn"), ["conv_id"], [F.desc("turn")], 10)


# --- metrics ----------------------------------------------------------------------------------


def _predictions(spark, d):
    j = _t(spark, d, "labels", "doc_id", "quality", "toxic").join(_t(spark, d, "documents", "doc_id", "n_chars"), "doc_id")
    return j.withColumn("pred", F.when(F.col("n_chars") > 900, 1).otherwise(0))


_PRED = "with p as (select quality, toxic, n_chars, case when n_chars > 900 then 1 else 0 end as pred from labels join documents using (doc_id)) "


@query(_PRED + """, c as (select count(*) filter (quality = 1 and pred = 1) as tp, count(*) filter (quality = 0 and pred = 1) as fp, count(*) filter (quality = 1 and pred = 0) as fn, count(*) filter (quality = 0 and pred = 0) as tn from p)
select tp, fp, fn, tn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy from c""")
def confusion_prf(spark, d):
    """M-1."""
    m = M.binary_metrics(_predictions(spark, d), F.col("quality") == 1, F.col("pred") == 1)
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(_PRED + """, k as (select unnest(['0', '1']) as class),
c as (select class, count(*) filter (quality::varchar = class and pred::varchar = class) as tp, count(*) filter (quality::varchar <> class and pred::varchar = class) as fp, count(*) filter (quality::varchar = class and pred::varchar <> class) as fn from p cross join k group by class),
f as (select *, 2 * tp / (2 * tp + fp + fn) as f1, tp + fn as support from c)
select round(avg(f1), 6) as f1_macro, round(sum(f1 * support) / sum(support), 6) as f1_weighted from f""")
def macro_f1(spark, d):
    """M-2, M-3."""
    p = _predictions(spark, d).select(F.col("quality").cast("string").alias("t"), F.col("pred").cast("string").alias("p"))
    m = M.macro_metrics(M.class_metrics(p, "t", "p", ["0", "1"]))
    return m.select(F.round("f1_macro", 6).alias("f1_macro"), F.round("f1_weighted", 6).alias("f1_weighted"))


@query("""
with g as (select l_orderkey, list(distinct l_partkey) as gold, list(l_partkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq from lineitem group by l_orderkey)
select l_orderkey, round(len(list_intersect(gold, seq[1:2])) / len(gold), 6) as recall_2, round(len(list_intersect(gold, seq[1:4])) / len(gold), 6) as recall_4 from g""")
def recall_at_k(spark, d):
    """M-4: gold items among those of the first k generations."""
    g = _t(spark, d, "lineitem", "l_orderkey", *LINE_ORDER).groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("gold"), F.transform(F.array_sort(F.collect_list(F.struct(*LINE_ORDER))), lambda x: F.array(x.l_partkey)).alias("seq"))
    return g.select("l_orderkey", *[F.round(M.recall_at(F.col("gold"), F.col("seq"), k), 6).alias(f"recall_{k}") for k in (2, 4)])


@query("""
with g as (select user_id, list(event_type order by ts, event_id) as seq from events group by user_id)
select user_id, case when len(seq) = 2 and seq[1] = 'view' and seq[2] = 'click' then 1.0::double else 0.0::double end as exact,
  round((least(1, len([x for x in seq if x = 'view'])) + least(1, len([x for x in seq if x = 'click']))) / len(seq), 6) as precision,
  (least(1, len([x for x in seq if x = 'view'])) + least(1, len([x for x in seq if x = 'click']))) / 2 as recall from g""")
def trajectory_metrics(spark, d):
    """M-10, M-12: each user's events against a reference of two calls."""
    call = lambda n, i: F.struct(n.alias("tool_name"), i.cast("string").alias("tool_input"))
    e = _t(spark, d, "events", "user_id", "event_id", "ts", "event_type").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    ref, got = F.array(call(F.lit("view"), F.lit(None)), call(F.lit("click"), F.lit(None))), F.transform("s", lambda x: call(x.event_type, F.lit("x")))
    return e.select("user_id", M.trajectory_exact(ref, got).alias("exact"), F.round(M.trajectory_precision(ref, got), 6).alias("precision"), M.trajectory_recall(ref, got).alias("recall"))


@query("select event_type, round(avg(value), 6) as mean, round(median(value), 6) as median, min(value) as min, max(value) as max from events group by 1")
def latency(spark, d):
    """M-9."""
    return M.latency(_t(spark, d, "events", "event_type", "value"), "event_type", "value").select("event_type", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "min", "max")


@query("select round(avg(value), 6) as mean, round(stddev(value), 6) as stdev from events")
def mean_stdev(spark, d):
    """M-15."""
    return M.mean_stdev(_t(spark, d, "events", "value"), "value").select(F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"))


# --- streaming --------------------------------------------------------------------------------


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder of ``spark.checkpoint.dir``; one of this machine only where that is unset and the master local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix=f"gritstone-{name}-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stream(spark, d, build) -> DataFrame:
    """Runs a stream over the events table to its end and returns what it wrote, from the shared folder."""
    out = _shared(spark, "stream")
    events = _t(spark, d, "events")
    # a folder, or one file named by a pattern
    src = spark.readStream.schema(events.schema).format("parquet").load(f"{d}/events.parquet*")
    df = build(src)
    q = df.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


@query("select user_id, event_type, count(*) as n from (select distinct user_id, event_type from events) group by 1, 2")
def stream_dedup(spark, d):
    """T-2, T-3: each key once, by a stream with a watermark."""
    out = _stream(spark, d, lambda s: ST.dedup_events(s.withColumn("t", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "t", "3650 days").select("user_id", "event_type"))
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def hourly_rollup(spark, d):
    """T-9: tumbling hours, as a batch over the same operator."""
    h = ST.hourly(_t(spark, d, "events", "ts", "event_type", "value"), "ts", ["event_type"], "value")
    return h.select("start", "event_type", "n", F.round("total", 4).alias("total"))
