"""Queries through files: what is written to the shared folder and read back, rejects, loads, checkpoints, file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import relational as R
from ..operators import sampling as S
from ..sources import readers as RD
from ..sources import sinks as K
from .activity import _text
from .catalog import _shared, _t, query
from .code import _blobs


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("price"))


def _said(df: DataFrame, what: str) -> DataFrame:
    return df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))


@query("""
with o as (select o_orderkey as k, o_custkey as c from orders), g as (select c, arg_max(k, (k % 3 = 0, -k)) as latest, count(*) + count(*) filter (k % 3 = 0) as n from o where k % 10 > 2 group by c)
select 'customer ' || c as what, latest, n from g union all select 'malformed', null, count(*) from o where k % 10 = 0 union all select 'missing_key', null, count(*) from o where k % 10 = 1""")
def jsonl_batches(spark, d):
    """S-1, S-2, K-2, A-1: batches of JSON lines appended, read back with what is wrong in them; the latest row of each key."""
    k, path = F.col("k"), _shared(spark, "jsonl")
    line = lambda version: F.when(k % 10 == 0, _text("{broken ", [k])).when(k % 10 == 1, _text('{"repo": "', [k], '"}')).when(k % 10 == 2, "  ").otherwise(_text('{"issue_number": ', [F.col("c")], ', "extracted_at": "', [version], '", "repo": "', [k], '"}')).alias("value")
    o = _orders(spark, d)
    K.append_batch(o.select(line(F.lit(1))), path, "text")
    K.append_batch(o.where("k % 3 = 0 and k % 10 > 2").select(line(F.lit(2))), path, "text")
    good, bad = RD.split_malformed(RD.read_jsonl(spark, path, schema.RAW_ISSUE), "issue_number")
    good = good.select("issue_number", "extracted_at", F.col("repo").cast("bigint").alias("latest"))
    last = R.dedup_latest(good, "issue_number", F.coalesce("extracted_at", F.lit("")), F.col("latest"))
    n = good.groupBy("issue_number").agg(F.count("*").alias("n"))
    rows = last.join(n, "issue_number").select(_text("customer ", [F.col("issue_number")]).alias("what"), "latest", "n")
    return rows.unionByName(bad.groupBy(F.col("reason").alias("what")).agg(F.lit(None).cast("bigint").alias("latest"), F.count("*").alias("n")))


@query("""
select o_orderkey as number, 'say "' || o_orderkey || '", then' || case when o_orderkey % 4 = 0 then chr(10) else ' ' end || 'stop' as title, case when o_orderkey % 5 = 0 then null else o_orderkey end as parsed,
  left('say "' || o_orderkey || '", then stop', 12) as preview from orders where o_orderkey % 3 = 0""")
def csv_round_trip(spark, d):
    """K-10, K-11, S-3 to S-6: rows with quotes, line breaks and raw JSON, through CSV; previews on one line."""
    k, path = F.col("k"), f"{_shared(spark, 'rows')}.csv"
    title = _text('say "', [k], '", then', [F.when(k % 4 == 0, "\n").otherwise(" ")], "stop")
    raw = F.when(k % 5 == 0, "nan").otherwise(_text('{"pr_number": ', [k], "}"))
    rows = _orders(spark, d).select(
        k.alias("PR_NUMBER"), F.when(k % 3 == 0, F.col("c")).alias("LINKED_ISSUE_NUMBER"), title.alias("PR_TITLE"), F.col("st").alias("STATE"), (k % 2 == 0).alias("IS_MERGED"), F.lit(0).alias("REVIEW_COUNT"),
        F.lit("x").alias("CREATED_AT"), raw.alias("RAW_JSON"),
    )
    K.write_csv(rows, path)
    read = RD.pr_lookup(RD.read_any(spark, path, schema.PR_CSV), schema.RAW_PR)
    out = read.select(F.col("PR_NUMBER").alias("number"), F.col("PR_TITLE").alias("title"), F.col("parsed.pr_number").alias("parsed"), F.col("PR_TITLE").alias("preview"))
    cut = K.preview(out.select("number", "preview"), 12)
    return out.drop("preview").join(cut, "number")


@query("""
with r as (select o_custkey, o_orderstatus as st, o_orderkey as k, row_number() over (partition by o_orderstatus order by md5(o_orderkey || ':7'), o_orderkey) as r, count(*) over (partition by o_orderstatus) as n from orders),
s as (select st, k, case when r <= greatest(1, round_even(n * 0.1, 0)) then 'test' when r <= 2 * greatest(1, round_even(n * 0.1, 0)) then 'val' else 'train' end as split from r)
select split, st, count(*) as n, sum(k)::bigint as keys from s group by all""")
def split_files(spark, d):
    """K-9, R-4, A-10: splits written to a folder each, read back and counted."""
    path = _shared(spark, "splits")
    K.write_splits(S.stratified_split(_orders(spark, d), "k", "st", 7), path)
    return spark.read.schema("k bigint, st string, split string").json(path).groupBy("split", "st").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("""
with o as (select o_orderkey as k, o_custkey as c, o_totalprice as price from orders), good as (select * from o where price > 50000)
select 'loaded' as what, count(*) as n from good union all select 'rejected', count(*) from o where not price > 50000
union all select 'before', count(*) from good union all select 'after', 2 * count(*) from good where k % 2 = 0 union all select 'odd', 0 union all select 'delta', count(*) from good where k % 2 = 0
union all select 'twice', count(*) from good where k % 2 = 0 union all select 'one json', count(*) from good where k % 2 = 0""")
def table_loads(spark, d):
    """K-1, K-3 to K-7, K-12, K-23: loads with rejects, replaced tables, counts around a write, keys that come twice, reports."""
    path = _shared(spark, "loads")
    o, read = _orders(spark, d), lambda p: spark.read.schema("k bigint, c bigint, st string, price double").parquet(f"{path}/{p}")
    K.load_rows(o, F.col("price") > 50000, f"{path}/rows", f"{path}/rejects")
    loaded, rejected = _said(read("rows"), "loaded"), _said(read("rejects"), "rejected")
    K.replace(read("rows"), f"{path}/even")
    before = read("even").count()  # one number; the table is replaced next
    K.replace(read("even").where("k % 2 = 0"), f"{path}/even")
    old, new = K.count_delta(spark, f"{path}/even", lambda: K.load_strict(read("rows").where("k % 2 = 0"), F.col("price") > 50000, f"{path}/even"))
    twice = K.duplicates(read("even"), ["k"])
    K.write_report(_said(twice, "one json"), f"{path}/report")
    K.write_jsonl(twice, f"{path}/twice", ["k"])
    report = spark.read.schema("what string, n bigint").json(f"{path}/report")
    whole = spark.range(1).select(F.explode(F.create_map(F.lit("before"), F.lit(before).cast("bigint"), F.lit("delta"), F.lit(new - old).cast("bigint"))).alias("what", "n"))
    out = loaded.unionByName(rejected).unionByName(whole).unionByName(_said(read("even"), "after")).unionByName(_said(read("even").where("k % 2 = 1"), "odd"))
    return out.unionByName(_said(spark.read.schema("k bigint, count bigint").json(f"{path}/twice"), "twice")).unionByName(report)


@query("""
with o as (select o_orderkey as k, o_orderkey % 4 = 0 as done, o_orderkey % 8 = 0 as has from orders)
select case when not done then 'pending' when has then 'verified' else 'missing' end as what, k as key from o union all select 'kept', k from o where has union all select 'cached', k from o where done""")
def checkpoint_cycle(spark, d):
    """K-13, K-15 to K-17, J-12: what is still to do, what is marked without data, the repaired marks, and what discovery found last."""
    path, key = _shared(spark, "marks"), F.col("k")
    o = _orders(spark, d)
    entry = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, _text([key], ".0")).otherwise(_text("[", [key], ", ", [key], ".0]"))
    m = K.Manifest(spark, f"{path}/marks")
    m.commit(K.checkpoint_entries(o.where("k % 4 = 0").select(entry.alias("text")), "text"))
    K.save_checkpoint(m.load(), f"{path}/found")
    pending, data = m.pending(o.select(key.alias("key"))), o.where("k % 8 = 0").select(key.alias("key"))
    missing, good = (df.withColumn("what", F.lit(name)) for df, name in zip(m.repair(data), ("missing", "verified")))
    fixed = K.Manifest(spark, f"{path}/fixed")
    fixed.commit(m.load())
    fixed.repair(data, apply=True)
    cached = K.last_good(o.where("k < 0").select(key.alias("key")), K.load_checkpoint(spark, f"{path}/found", "key bigint"))
    parts = [pending.withColumn("what", F.lit("pending")), missing, good, fixed.load().withColumn("what", F.lit("kept")), cached.withColumn("what", F.lit("cached"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("what", "key")


@query("""
with f as (select o_custkey as c, count(*) as n, bool_or(o_orderkey % 32 = 5) as holds from orders group by 1),
h as (select 'src/c' || c || '.py' as path from f where holds order by 1 limit 50)
select 'found' as what, path, null::bigint as n from h union all select 'at', 'src/c' || c || '.py', case when c % 3 > 0 then n end from f where c % 2 = 0
union all select 'tracked', null, count(*) from f where c % 2 = 1""")
def code_lookups(spark, d):
    """S-21 to S-23: tracked paths by ending, texts at a commit, files that hold a fixed string."""
    b = _blobs(spark, d)
    tracked = RD.tracked(b.select(F.when(F.col("c") % 2 == 0, F.replace("path", F.lit(".py"), F.lit(".md"))).otherwise(F.col("path")).alias("path")))
    needle = F.when(F.exists(F.transform(F.regexp_extract_all("text", F.lit(r"def o(\d+)"), F.lit(1)), lambda x: x.cast("bigint")), lambda x: x % 32 == 5), "\n# needle").otherwise("")
    marked = b.select("path", F.concat("text", needle).alias("text"))
    found = RD.search_code(marked, "needle")
    wanted = b.where("c % 2 = 0").select(F.lit("s").alias("sha"), "path")
    at = RD.blob_at(b.where("c % 3 > 0").select(F.lit("s").alias("sha"), "path", "text"), wanted)
    n = F.when(F.col("text").isNotNull(), F.size(F.regexp_extract_all("text", F.lit(r"def o\d+"), F.lit(0)))).cast("bigint")
    none = F.lit(None).cast("bigint").alias("n")
    return found.select(F.lit("found").alias("what"), "path", none).unionByName(at.select(F.lit("at").alias("what"), "path", n.alias("n"))).unionByName(tracked.agg(F.lit("tracked").alias("what"), F.lit(None).cast("string").alias("path"), F.count("*").alias("n")))
