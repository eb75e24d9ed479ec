"""Queries on evaluation and on the small rules of texts, scores and times, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import symbols as SY
from ..functions import text as X
from ..functions import times as TM
from ..operators import datasets as DS
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import relational as R
from ..sources import sinks as K
from .activity import _text
from .catalog import _shared, _t, query
from .code import _blobs, _shape


@query("""
select event_id as id, left('event number ' || event_id, 9) as cut, case when event_id % 2 = 0 then 'event nu...' else 'ev' end as by_tokens, case event_id % 6 when 0 then 'duplicate' when 1 then 'wontfix' when 2 then 'not_planned' else 'no_code_change' end as reason,
  case event_id % 4 when 0 then 'a,b ' || event_id when 1 then 'x ' || event_id when 2 then 'p,q' else '' end as labels, least(greatest(event_id % 7 / 4 - 0.25, 0.0), 1.0) as clamped,
  repeat('█', round(least(greatest(event_id % 7 / 4 - 0.25, 0.0), 1.0) * 10)::int) || repeat('░', 10 - round(least(greatest(event_id % 7 / 4 - 0.25, 0.0), 1.0) * 10)::int) as bar,
  'A: 1' || chr(10) || 'B: ' || event_id as without_tier, case event_id % 3 when 0 then 'said ' || event_id when 1 then 'one' || chr(10) || event_id else '' end as message,
  'dagrun,my_task_' || event_id || ',scheduler,src/a/b_' || event_id || '.py' as words from events""")
def text_rules(spark, d):
    """F-7, F-8, F-12, F-16, F-34, F-39, F-45, F-48, F-50: small rules of texts."""
    i = F.col("id")
    e = _t(spark, d, "events", "event_id").select(F.col("event_id").alias("id"))
    names = F.when(i % 6 == 0, F.array(F.lit("Kind:Duplicate"), F.lit("x"))).when(i % 6 == 1, F.array(F.lit("y"), F.lit("WontFix"))).otherwise(F.array(F.lit("z")))
    listed = F.when(i % 4 == 0, _text('["a", "b ', [i], '"]')).when(i % 4 == 1, _text('[{"name": "x ', [i], '"}]')).when(i % 4 == 2, " p, ,q ")
    score = i % 7 / 4 - 0.25
    tiered = _text("A: 1\nSNAPSHOT_TIER: T+", [i], "\nB: ", [i])
    said, blocks = F.when(i % 3 == 0, _text(" said ", [i], " ")).otherwise(" "), F.when(i % 3 == 1, F.array(F.lit("one"), F.lit(""), F.col("id").cast("string"))).otherwise(F.array().cast("array<string>"))
    words = X.keywords(_text("DagRun of my_task_", [i], " in src/a/b_", [i], ".py, Scheduler"), ("scheduler", "webserver"))
    return e.select(
        "id", X.truncate(_text("event number ", [i]), 9).alias("cut"), X.truncate_tokens(F.when(i % 2 == 0, "event number").otherwise("ev"), 2).alias("by_tokens"),
        X.label_reason(names, F.when(i % 6 == 2, "not_planned")).alias("reason"), F.array_join(X.parse_labels(listed), ",").alias("labels"), X.clamp01(score).alias("clamped"), X.score_bar(score).alias("bar"),
        X.drop_tier(tiered).alias("without_tier"), F.trim(X.message_text(said, blocks)).alias("message"), F.array_join(F.filter(words, lambda w: ~w.startswith("b_")), ",").alias("words"),
    )


@query("""
with o as (select o_orderkey as k, o_orderdate as t from orders)
select k, case k % 6 when 3 then null when 4 then null when 5 then null when 1 then t - interval 90 minute else t end as read, case when k % 6 < 3 then t end as without_offset, (t::date - 7)::date as week_start from o""")
def time_texts(spark, d):
    """F-35, F-51: times as texts give them, and the week before a day."""
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    text = lambda f: F.date_format(t, f)
    said = F.when(k % 6 == 0, F.concat(text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k % 6 == 1, F.concat(text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30"))).when(k % 6 == 2, text("yyyy-MM-dd HH:mm:ss")).when(k % 6 == 3, "None").when(k % 6 == 4, "soon")
    o = _t(spark, d, "orders", "o_orderkey", "o_orderdate").withColumn("said", said)
    return o.select(k.alias("k"), TM.parse_ts(F.col("said")).alias("read"), TM.parse_ts_drop_offset(F.col("said")).alias("without_offset"), TM.week_bounds(t.cast("date"))[0].alias("week_start"))


@query("""
with l as (select l_orderkey as k, count(*) as n, list(l_partkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) filter (l_returnflag = 'R') as calls,
  list(l_suppkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) filter (l_returnflag = 'A') as said from lineitem group by 1)
select k, coalesce(array_to_string(list_transform(calls, lambda x: 'tool' || (x % 5) || '(' || x || ')'), ' '), '') as calls, case when said is not null then 'answer ' || said[-1] end as answer from l""")
def agent_events(spark, d):
    """M-13, M-14: tool calls and the last text of each run's events."""
    part = "struct<text: string, function_call: struct<name: string, args: string>>"
    flag, p = F.col("l_returnflag"), F.col("l_partkey")
    call = F.struct(F.lit(None).cast("string").alias("text"), F.struct(_text("tool", [p % 5]).alias("name"), p.cast("string").alias("args")).alias("function_call")).cast(part)
    text = F.struct(F.when(flag == "A", _text("answer ", [F.col("l_suppkey")])).otherwise("").alias("text"), F.lit(None).cast("struct<name: string, args: string>").alias("function_call")).cast(part)
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    parts = F.when(flag == "R", F.array(call)).when(flag == "A", F.array(text)).when(F.col("l_suppkey") % 2 == 0, F.array(text))
    g = _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.struct(F.struct(parts.alias("parts")).alias("content")).alias("e")))).alias("es"))
    events = F.transform("es", lambda x: x.e)
    calls = F.transform(M.tool_calls(events), lambda c: F.concat(c.tool_name, F.lit("("), c.tool_input, F.lit(")")))
    return g.select("k", F.array_join(calls, " ").alias("calls"), M.final_response(events).alias("answer"))


@query("""
with j as (select o_orderpriority as p, o_orderkey % 2 = 0 as ok, case when o_orderkey % 9 = 0 then null else (least(5, 1 + o_orderkey % 7) + 3) / 2 end as s from orders)
select p, round(avg(s), 4) as mean, round(avg(s) filter (ok), 4) as mean_correct, round(avg(s) filter (not ok), 4) as mean_incorrect, count(s) as n from j group by p""")
def judge_by_label(spark, d):
    """M-7, M-8: judges' scores by label, of right and wrong answers; unreadable ones don't count."""
    k = F.col("o_orderkey")
    raw = F.when(k % 9 == 0, "no score").otherwise(_text('{"fit": ', [1 + k % 7], "}"))
    o = _t(spark, d, "orders", "o_orderkey", "o_orderpriority").select(F.col("o_orderpriority").alias("p"), (k % 2 == 0).alias("ok"), M.judge_scores(raw, ("fit", "tone")).alias("s"))
    r = M.judge_summary(o, "s", "p", F.col("ok"))
    return r.select("p", *[F.round(c, 4).alias(c) for c in ("mean", "mean_correct", "mean_incorrect")], "n")


@query("""
with i as (select o_custkey as c, o_orderkey % 40 as item, o_orderkey as k from orders), f as (select item, arg_min(c, (k, c)) as first, arg_max(c, (k, c)) as last from i group by item),
v as (select o_totalprice as v, row_number() over (order by o_totalprice) - 1 as r, count(*) over () as n from orders where o_totalprice > 1000)
select 'item ' || item as what, first as a, last as b from f
union all select 'line', (select n from v limit 1), (select floor(median(v))::bigint from v)
union all select 'least', (select floor(min(v))::bigint from v), (select floor(v)::bigint from v where r = floor(0.9 * (n - 1)))""")
def maps_and_lines(spark, d):
    """J-4, A-15: a map turned round, first or last wins; a line that sums up a column."""
    o = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    rows = o.select(F.col("o_custkey").alias("c"), F.array(F.col("o_orderkey") % 40).alias("items"), F.col("o_orderkey").alias("k"))
    first, last = (R.invert_map(rows, "c", "items", "k", w) for w in (False, True))
    item = first.columns[0] if first.columns[0] != "c" else first.columns[1]
    both = first.select(F.col(item).alias("i"), F.col("c").alias("a")).join(last.select(F.col(item).alias("i"), F.col("c").alias("b")), "i").select(_text("item ", [F.col("i")]).alias("what"), "a", "b")
    s = R.summary_line(o.where("o_totalprice > 1000"), "o_totalprice")
    whole = lambda c: F.floor(c).cast("bigint")
    lines = s.select(F.explode(F.array(F.struct(F.lit("line").alias("what"), F.col("n").cast("bigint").alias("a"), whole("p50").alias("b")), F.struct(F.lit("least").alias("what"), whole("min").alias("a"), whole("p90").alias("b")))).alias("x")).select("x.*")
    return both.unionByName(lines)


@query("""
with o as (select o_custkey as c, count(*) as n, list(o_orderkey order by o_orderkey) as ks from orders group by 1),
s as (select c, case when c % 7 = 0 then 0 else 1 end as classes, case when c % 7 = 0 then 0 else n end as functions, ks from o)
select 'src/c' || c || '.py' as path, 'src/c' || c || '.py' || chr(10) || '  classes: C' || c || chr(10) || '  functions: ' || array_to_string(list_transform(ks[1:8], lambda k: 'o' || k), ', ') as line from s where classes > 0
union all select 'all', sum(classes)::bigint || ' ' || sum(functions)::bigint || ' ' || count(*) filter (classes > 0) from s""")
def symbol_index(spark, d):
    """F-18, F-20, K-26, A-26, X-5: symbols of files, by Arrow batches, as an index in files and as lines of a prompt."""
    path = _shared(spark, "index")
    s = _shape(spark, d, _blobs(spark, d).select("path", "text"), ["path"])
    names = lambda kind: F.array_sort(F.filter(F.transform(F.filter("symbols", lambda x: x["kind"] == kind), lambda x: x["name"]), lambda x: x.isNotNull()))
    by_number = F.transform(F.array_sort(F.transform(names("function"), lambda x: F.struct(F.substring(x, 2, 18).cast("bigint").alias("k"), x.alias("x")))), lambda x: x.x)
    K.write_symbol_index(s.select("path", names("class").alias("classes"), by_number.alias("functions")), path)
    index = spark.read.schema("path string, classes array<string>, functions array<string>").json(path)
    n = G.symbol_counts(index).select(F.lit("all").alias("path"), F.concat_ws(" ", *[F.col(c).cast("string") for c in ("classes", "functions", "files")]).alias("line"))
    return index.select("path", SY.index_line(F.col("path"), F.col("classes"), F.col("functions")).alias("line")).unionByName(n)


@query("""
with c as (select o_custkey as k, list('by  order' || chr(10) || o_orderkey order by o_orderkey) as said, count(*) as n from orders group by 1)
select k, array_to_string(list_transform(said[1:3], lambda x: '- ' || regexp_replace(x, '\\s+', ' ', 'g')) || case when n > 3 then ['+' || (n - 3) || ' more'] else [] end, chr(10)) as comments,
  case when k % 5 = 0 then null else 'change ' || k end as title, case when k % 5 = 0 then null else k % 2 = 0 end as merged from c""")
def compressed_context(spark, d):
    """P-24, P-25: comments in few lines, and the safe fields of listed changes."""
    k = F.col("o_custkey")
    o = _t(spark, d, "orders", "o_custkey", "o_orderkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("at"), _text("by  order\n", [F.col("o_orderkey")]).alias("body")))).alias("c"))
    raw = F.when(k % 5 == 0, "[]").otherwise(_text('[{"number": 1, "title": "change ', [k], '", "merged": ', [k % 2 == 0], ', "closed_at": "later"}]'))
    one = F.get(DS.sanitize_prs(raw), F.lit(0))
    return o.select(k.alias("k"), DS.compress_comments(F.col("c")).alias("comments"), one["title"].alias("title"), one.merged.alias("merged"))
