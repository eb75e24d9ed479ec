"""Queries on work that goes in steps: chunks, rounds, assembled records, metrics of one's own."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.custom_metrics import Metrics
from ..sources import records as RC
from ..sources.chunks import ChunkedTable
from ..streaming import streams as ST
from .catalog import _shared, _t, query


@query("select o_custkey as key, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_orderstatus = 'P' group by 1")
def chunk_commit(spark, d):
    """K-14: customers' pending orders summed in chunks, each committed after its data; customers without one stay."""
    o = _t(spark, d, "orders", "o_custkey", "o_orderstatus", "o_totalprice").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "key")
    t = ChunkedTable(spark, _shared(spark, "chunks"), "key", T._parse_datatype_string("key bigint, n bigint, total double"))
    c = _t(spark, d, "customer", "c_custkey").withColumnRenamed("c_custkey", "key")
    sums = o.groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    t.run(c, lambda keys: sums.join(keys, "key"), max(1, -(-c.count() // 4)))
    return t.rows()


@query("""
with o as (select o_orderkey % 5 as need, o_orderstatus as status from orders)
select least(greatest(need, 1), 3) as rounds, need <= 3 as done, status, count(*) as n from o group by all""")
def feedback_rounds(spark, d):
    """T-6: rows go round until they are done, three times at most."""
    o = _t(spark, d, "orders", "o_orderkey", "o_orderstatus").select((F.col("o_orderkey") % 5).alias("need"), F.col("o_orderstatus").alias("status"), F.lit(0).cast("long").alias("have"))
    step = lambda df: df.withColumn("have", F.col("have") + 1).withColumn("done", F.col("have") >= F.col("need"))
    return ST.bounded_rounds(o, step, _shared(spark, "rounds"), 3).groupBy("rounds", "done", "status").agg(F.count("*").alias("n"))


METRICS = Metrics()


@METRICS.row("price_by_discount", {"l_extendedprice": "double", "l_discount": "double"})
def _price_by_discount(price, discount):
    return price / discount  # raises where there is none


METRICS.register("quantity", {"l_quantity": "double"}, lambda q: q)


@query("""
select 'price_by_discount' as metric, count(*) filter (l_discount <> 0) as n, round(avg(l_extendedprice / nullif(l_discount, 0)), 2) as mean, count(*) filter (l_discount = 0) as errors from lineitem
union all select 'quantity', count(l_quantity), round(avg(l_quantity), 2), 0 from lineitem""")
def custom_metrics(spark, d):
    """X-2, M-6: two metrics in one pass; rows on which one raises are errors, not the end."""
    names = ["price_by_discount", "quantity"]
    s = METRICS.score(_t(spark, d, "lineitem", "l_extendedprice", "l_discount", "l_quantity"), names)
    return METRICS.summary(s, names).select("metric", "n", F.round("mean", 2).alias("mean"), "errors")


@query("""
with l as (select l_orderkey as k, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_discount from lineitem),
r as (select k, list(distinct l_suppkey) filter (l_returnflag = 'R') as reviewed from l group by k),
f as (select l.k, count(*) as n_files, count(*) filter (l_returnflag = 'R') as n_reviews,
  count(*) filter (l_returnflag <> 'N' and not list_contains(coalesce(reviewed, []), l_suppkey)) as n_silent,
  case when count(*) filter (l_discount > 0.02) = 0 then 'none' when count(*) filter (l_discount > 0.02 and l_linestatus = 'O') = count(*) filter (l_discount > 0.02) then 'success'
    when count(*) filter (l_discount > 0.02 and l_linestatus <> 'O' and l_partkey % 2 = 0) > 0 then 'failure' else 'mixed' end as ci
  from l join r using (k) group by l.k)
select o_orderkey as pr_number, o_orderstatus as state, coalesce(n_files, 0) as n_files, coalesce(case when o_orderpriority = '5-LOW' then 0 else n_reviews end, 0) as n_reviews,
  coalesce(ci, 'none') as ci_conclusion, case when o_orderpriority = '5-LOW' then 1 else 0 end as n_failed
from orders left join f on k = o_orderkey where o_orderstatus <> 'P'""")
def assembled_changes(spark, d):
    """S-12, S-13, P-7: one nested record a change, from parts as endpoints give them.

    The main part of a pending order failed, so it is left out; reviews of one of low priority failed.
    """
    o = _t(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select(F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("priority"))
    line = _t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount").withColumnRenamed("l_orderkey", "number")
    listed = lambda df, x: df.groupBy("number").agg(F.to_json(F.collect_list(x)).alias("body"))
    part = lambda name, df, bad=None: df.select("number", F.lit(name).alias("part"), "body" if bad is None else F.when(~bad, F.col("body")).alias("body"), F.lit(None).cast("string").alias("error") if bad is None else F.when(bad, "failed").alias("error"))
    head = F.struct(F.concat(F.lit("s"), F.col("number").cast("string")).alias("sha")).alias("head")
    main = o.select("number", "state", F.to_json(F.struct("number", "state", head)).alias("body"))
    login = F.struct(F.col("l_suppkey").cast("string").alias("login"))
    asked = line.where("l_returnflag <> 'N'").groupBy("number").agg(F.to_json(F.struct(F.collect_list(login).alias("users"))).alias("body"))
    files = listed(line, F.struct(F.col("l_partkey").cast("string").alias("filename")))
    reviews = listed(line.where("l_returnflag = 'R'"), F.struct(F.lit("APPROVED").alias("state"), login.alias("user")))
    parts = part("pr", main, F.col("state") == "P").unionByName(part("files", files)).unionByName(part("requested_reviewers", asked)).unionByName(part("reviews", o.join(reviews, "number", "left"), F.col("priority") == "5-LOW"))
    end = F.when(F.col("l_linestatus") == "O", "success").when(F.col("l_partkey") % 2 == 0, "failure").otherwise("neutral")
    runs = listed(line.where("l_discount > 0.02"), F.struct(end.alias("conclusion")))
    runs = runs.select(F.concat(F.lit("s"), F.col("number").cast("string")).alias("sha"), F.lit("check_runs").alias("part"), "body", F.lit(None).cast("string").alias("error"))
    linked = o.select("number", F.lit(None).cast("long").alias("linked_issue_number")).limit(0)
    r = RC.assemble_changes(parts, runs, linked, "o/r", "2026-01-01T00:00:00")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return r.select("pr_number", "pr.state", F.greatest(size(F.col("files")), F.lit(0)).alias("n_files"), size(F.col("reviews")).alias("n_reviews"), "ci_conclusion", F.size("failed").alias("n_failed"))
