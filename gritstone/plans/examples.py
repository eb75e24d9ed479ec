"""Queries on training examples, generated texts, paths and retrieval around a change, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diffs as D
from ..functions import text as X
from ..operators import datasets as DS
from ..operators import graph as G
from ..operators import labels as L
from ..operators import metrics as M
from .activity import _text
from .catalog import _t, query
from .training import _AT, _GATES, _NOTE, _P, _PATH, _REVIEW, _STATE, changes

# --- patcher examples --------------------------------------------------------------------------

#: A file's text at an order's commit: of some the patch doesn't apply, of some the result doesn't parse, some are long.
_BASE = "concat_ws(chr(10), 'a', 'b', 'a', case when k % 4 = 1 then 'def (' else 'x' end, repeat('x' || chr(10), 3) || 'x', case when k % 4 = 0 then 'y' else 'c' end, repeat('x' || chr(10), case when k % 4 = 3 then 490 else 2 end))"


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    b = _t(spark, d, "lineitem", "l_orderkey", "l_partkey").select(k.alias("k"), F.expr(_PATH).alias("path")).distinct()
    return b.select(F.sha1(F.col("k").cast("string").cast("binary")).alias("sha"), "path", F.expr(_BASE).alias("text"))


@query(f"""
with {_P}, {_GATES}, u as (select k, unnest(kept) as f from rn where reason is null and len(files) <= 3 and additions <= 350 and tokens <= 1200),
t as (select k, f.path as path, f.patch as patch, string_split({_BASE}, chr(10)) as ls, starts_with(f.patch, '@@ -1,2') as one from u),
a as (select * from t where (one or k % 4 <> 0) and (not ends_with(path, '.py') or k % 4 <> 1)),
w as (select *, case when len(ls) <= 380 then len(ls) when one then 42 else 49 end as hi from a)
select k as pr_number, path, md5('TASK: Order ' || k || chr(10) || 'FILE: ' || path || chr(10) || array_to_string(list_transform(range(1, hi + 1), lambda i: lpad(i::varchar, 6, ' ') || '|' || ls[i]), chr(10))) as input,
  case when one then 1 else 2 end as n_hunks, hi as last_line, starts_with(path, 'tests/') as is_test, len(regexp_split_to_array(patch, '\\s+')) as patch_tokens from w""")
def patcher_examples(spark, d):
    """L-29, F-24, F-25, F-29, F-30: changes whose patch applies and parses, with the numbered lines around them."""
    e = DS.patcher_examples(changes(spark, d), _blobs(spark, d))
    return e.select("pr_number", "path", F.md5("input").alias("input"), F.size("meta.hunks").alias("n_hunks"), F.get("meta.windows", F.lit(0)).hi.alias("last_line"), "meta.is_test", "meta.patch_tokens")


# --- planner examples --------------------------------------------------------------------------

_BODY = "case c_custkey % 6 when 0 then 'Works as intended' when 3 then case when c_custkey % 4 = 3 then 'Closing as duplicate' else 'plain' end else 'wanted: ' || c_custkey end"


def _planner(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey")
    c = _t(spark, d, "customer", "c_custkey", "c_name", "c_nationkey").withColumns({"title": F.col("c_name"), "body": F.expr(_BODY)})
    body = F.array(_text("<!-- a template -->Mend https://a.b/c part ", [n], "\n---"), F.lit("Thank you for contributing!\nand more"))
    files = F.array(_text("src/n", [F.col("c_nationkey")], ".py"), F.lit("src/all.py"))
    yes = c.where(n % 3 != 0).select(n.alias("number"), "title", "body", files.alias("files"), body.alias("pr_bodies"))
    no = c.where(n % 3 == 0).select(n.alias("number"), "title", "body")
    found = F.explode(F.array(F.struct(F.lit(2).alias("rank"), F.lit("src/all.py").alias("filename")), F.struct(F.lit(1).alias("rank"), _text("src/n", [F.col("c_nationkey")], ".py").alias("filename")))).alias("x")
    ranked = c.where(n % 4 > 0).select(n.alias("qid"), found).select("qid", "x.*")
    sure = c.where(n % 5 > 0).select(n.alias("qid"), F.struct(F.when(n % 2 == 0, "HIGH").otherwise("MEDIUM").alias("bucket")).alias("confidence"))
    return DS.planner_examples(yes, no, ranked, sure)


_PLANNED = f"""b as (select c_custkey as n, c_name as title, {_BODY} as body, 'src/n' || c_nationkey || '.py' as f, c_custkey % 3 <> 0 as yes from customer),
w as (select *, case when yes then 'Mend part ' || n || ' and more' when n % 6 = 0 then '{X.INVALID_REASON}' when n % 4 = 3 then '{X.DUPLICATE_REASON}'
  else replace('{X.UNLINKED_REASON}', '%s', title || ' ' || body) end as plan, row_number() over (partition by yes order by md5(n || ':42'), n) as r from b),
e as (select n as number, case when yes then 'YES' else 'NO' end as label, 'ISSUE: ' || title || chr(10) || body || chr(10) || 'RELATED: ' || case when n % 4 > 0 then f || ', src/all.py' else '' end || chr(10)
    || 'CONFIDENCE: ' || case when n % 5 = 0 then 'LOW' when n % 2 = 0 then 'HIGH' else 'MEDIUM' end as input,
  'REQUIRES_CODE_CHANGE: ' || case when yes then 'YES' || chr(10) || 'FILES: ' || f || ', src/all.py' else 'NO' end || chr(10) || 'PLAN: ' || left(plan, 600) as output, n % 4 > 0 as found from w where r <= 1500),
x as (select *, '<|im_start|>system' || chr(10) || 'You plan changes.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || input || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || output || '<|im_end|>' || chr(10) as text from e)"""


@query(f"with {_PLANNED} select number, label, input, output, md5(text) as text from x")
def planner_examples(spark, d):
    """L-27, R-3, F-10, F-11, F-47: issues with and without a change, as prompt and target."""
    return _planner(spark, d).withColumn("text", F.md5("text"))


@query(f"""
with {_PLANNED} select label, count(*) as n, round(100.0 * count(*) filter (found) / count(*), 2) as pct_with_context, round(avg(greatest(1, length(text) // 4)), 4) as avg_tokens,
  count(*) filter (not contains(output, 'PLAN:')) as missing_plan from x group by label""")
def planner_coverage(spark, d):
    """A-16, A-17: samples by label with retrieved context, token sizes, missing parts."""
    return DS.coverage(_planner(spark, d)).withColumn("avg_tokens", F.round("avg_tokens", 4))


# --- paths and generated text ------------------------------------------------------------------

_NAME = """case p_partkey % 7 when 0 then './.github/' when 1 then '././core/' when 2 then 'a' || chr(92) || 'tests' || chr(92) when 3 then 'docs/' when 4 then '/' when 5 then 'x/node_modules/' else 'core/Test/' end
  || case p_partkey % 5 when 0 then 'test_' when 1 then 'p_' when 2 then 'Dockerfile' else 'm' end || case when p_partkey % 5 = 2 then '' else p_partkey || case p_partkey % 4 when 0 then '.py' when 1 then '.PNG' when 2 then '.lock' else '_test.py' end end"""


@query(f"""
with n as (select p_partkey, {_NAME} as p from part), s as (select *, replace(p, chr(92), '/') as s, lower(replace(p, chr(92), '/')) as l, regexp_replace(replace(p, chr(92), '/'), '^[./]+', '') as loose from n)
select p_partkey, loose, regexp_replace(s, '^([.]/)+', '') as strict, array_to_string(list_distinct([loose]) || list_filter([regexp_replace(loose, '^core/', 'lib/core/')], lambda x: x <> loose), ',') as aliases,
  coalesce(regexp_matches(lower(p), '[.](py|md|rst|yaml|yml|toml|cfg|ini|sh|ts|tsx|js|json|sql|txt)$') or regexp_matches(lower(p), '(^|/)dockerfile$'), false) as allowed,
  regexp_matches(l, '/(tests|test|testing)/') or regexp_matches(l, '(^|/)test_[^/]*$') or ends_with(l, '_test.py') or regexp_matches(l, '(^|/)test[^/]*[.]py$') as is_test,
  regexp_matches(lower(p), '(^|/)(docs|node_modules)/') or regexp_matches(lower(p), '[.](lock|png)$') as noisy from s""")
def path_rules(spark, d):
    """F-13 to F-15, P-19, P-20, P-28: what is made of a path, and what it is taken for."""
    p = _t(spark, d, "part", "p_partkey").withColumn("p", F.expr(_NAME))
    c = F.col("p")
    return p.select(
        "p_partkey", X.normalize_path_loose(c).alias("loose"), X.normalize_path(c).alias("strict"), F.array_join(X.path_aliases(c, (("^core/", "lib/core/"),)), ",").alias("aliases"),
        DS.allowed_path(c).alias("allowed"), DS.is_test_path(c).alias("is_test"), DS.is_noisy_path(c).alias("noisy"),
    )


@query("""
with e as (select event_id as id, event_id % 4 as a, event_id % 5 as b, event_id % 6 as f from events)
select id, case a when 0 then 'ACCEPT' when 1 then 'REJECT' when 2 then 'REVISE' else 'UNKNOWN' end as verdict, case when a = 0 then 'because ' || id when a = 1 then 'none' || chr(10) || 'given' else '' end as reasoning,
  case b when 0 then 'YES' when 1 then 'NO' else 'UNKNOWN' end as requires_change, case when b = 0 then 'src/a.py,b/c_' || id || '.md' when b = 1 then 'x.py,y.py' else '' end as files,
  case f when 0 then id when 1 then 7 when 2 then id + 1 end as reference, case when f < 3 then 'good ' || id else 'all of ' || id end as chosen,
  case b when 0 then (least(2 * a + 1, 5) + 3) / 2 when 1 then 3.0 when 2 then 5.0 when 4 then 3.5 end as judged, case when a = 0 then 'file.py:' || greatest(1, id % 9) || '-' || greatest(1, id % 9, 4) else 'default.py:1-1' end as plan from e""")
def generated_texts(spark, d):
    """F-42 to F-44, F-46, F-52, M-7: what is read from generated texts."""
    e = _t(spark, d, "events", "event_id").select(F.col("event_id").alias("id"))
    i = F.col("id")
    a = F.when(i % 4 == 0, _text("Verdict:  accept\nREASONING: because ", [i])).when(i % 4 == 1, "I would reject this.\nreasoning: none\ngiven").when(i % 4 == 2, "Perhaps REVISE or REJECT")
    b = F.when(i % 5 == 0, _text("REQUIRES_CODE_CHANGE: yes\nFILES:\n- `src/a.py`\n* b/c_", [i], ".md\n- src/a.py\n- not a file\n\nPLAN: none")).when(i % 5 == 1, "requires_code_change: NO\nfiles: x.py, y.py\nPLAN: z.py").when(i % 5 == 2, "")
    f = F.when(i % 6 == 0, _text("see #", [i])).when(i % 6 == 1, "as issue 7 says").when(i % 6 == 2, _text("https://github.com/a/b/issues/", [i + 1]))
    chosen = F.when(i % 6 < 3, _text("so CHOSEN: good ", [i], " ")).otherwise(_text(" all of ", [i]))
    judged = F.when(i % 5 == 0, _text('{"fit": ', [i % 4 * 2 + 1], ', "tone": 3}')).when(i % 5 == 1, '{"tone": 3}').when(i % 5 == 2, '{"fit": 9, "tone": 17}').when(i % 5 == 3, "none").otherwise('```json\n{"fit": 4.7}\n```')
    plan = F.when(i % 4 == 0, _text('{"requires_change": true, "spans": [{"file": "file.py", "start_line": ', [i % 9], ', "end_line": 4}]}')).when(i % 4 == 1, "no plan").when(i % 4 == 2, '{"spans": []}')
    span = F.get(X.parse_plan(plan, F.lit("default.py")).spans, F.lit(0))
    return e.select(
        "id", X.verdict(a).alias("verdict"), X.reasoning(a).alias("reasoning"), X.requires_change(b).alias("requires_change"), F.array_join(X.predicted_files(b), ",").alias("files"), X.issue_reference(f).alias("reference"),
        X.chosen_text(chosen).alias("chosen"), M.judge_scores(judged, ("fit", "tone")).alias("judged"), F.concat(span["file"], F.lit(":"), span.start_line.cast("string"), F.lit("-"), span.end_line.cast("string")).alias("plan"),
    )


@query(f"""
with {_P}, q as (select k, list_distinct(list_transform(files, lambda f: f.path)) as gold, list_distinct(list_transform(list_filter(files, lambda f: f.status = 'added'), lambda f: f.path)) as said, patched from pt),
m as (select k, gold, said, len(list_intersect(gold, said)) as hit, len(patched) > 0 and contains(patched[1].patch, '@@ -') as valid, list_filter(said, lambda f: not ends_with(f, '.lock')) as ok from q)
select k as pr_number, valid, case when len(gold) > 0 then hit / len(gold) end as recall, case when len(said) = 0 then 1.0 else len(ok) / len(said) end as scope from m""")
def patch_metrics(spark, d):
    """M-5, U-8, F-23: validity, recall of files and scope of what would be changed."""
    p = changes(spark, d)
    files = F.coalesce("files", F.array())
    names = lambda c: F.array_distinct(F.transform(c, lambda f: f.filename))
    said, first = names(F.filter(files, lambda f: f.status == "added")), F.get(F.filter(files, lambda f: F.coalesce(f.patch != "", F.lit(False))), F.lit(0)).patch
    text = F.concat(F.lit("--- a/x\n+++ b/x\n"), F.coalesce(first, F.lit("")))
    allowed = F.filter(names(files), lambda x: ~x.endswith(".lock"))
    return p.select("pr_number", D.is_valid_diff(text).alias("valid"), M.file_recall(said, names(files)).alias("recall"), M.scope_compliance(said, allowed).alias("scope"))


@query(f"""
with t as (select l_orderkey as k, list('[PR #' || l_orderkey || ' — ' || {_STATE} || ' by s' || l_suppkey || ']: ' || left(case when l_partkey % 3 = 1 then '[STRIPPED]' else trim({_REVIEW}) end, 300) {_AT}) filter (l_returnflag = 'R') as rv,
  list('[s' || l_suppkey || ' on ' || {_PATH} || ':]: ' || {_NOTE} {_AT}) filter (l_returnflag = 'A' and l_discount > 0.05 and l_partkey % 4 < 3) as nt from lineitem group by 1)
select o_orderkey as pr_number, left(coalesce(array_to_string(rv, chr(10)), ''), 600) as reviews, left(coalesce(array_to_string(nt, chr(10)), ''), 400) as inline from orders left join t on k = o_orderkey""")
def reviewer_texts(spark, d):
    """O-12, F-6: what reviews and notes say, a line each, without signals of the outcome."""
    line = lambda c: F.struct(c.body.alias("body"), c.path.alias("path"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("original_line"), c.user.alias("user"))
    p = changes(spark, d).withColumn("review_comments", F.transform("review_comments", line))
    return p.select("pr_number", L.review_text(F.array(F.struct("pr_number", "reviews", "review_comments"))).alias("x")).select("pr_number", "x.*")


# --- retrieval around a change ------------------------------------------------------------------

_DIR = "'d' || (p_size % 10) || case when p_partkey % 2 = 0 then '/sub' else '' end"


@query(f"""
with s as (select {_DIR} || '/m' || (p_partkey // 2) || '.py' as source, {_DIR} as d, 'm' || (p_partkey // 2) as n from part where p_partkey % 4 = 0),
t as (select {_DIR} || '/test_m' || (p_partkey // 2) || '.py' as path, {_DIR} as d, 'm' || (p_partkey // 2) as n from part where p_partkey % 4 in (1, 2)),
j as (select source, path, case when s.d = t.d then 3 else 0 end + case when s.n = t.n then 2 else 0 end as score from s join t on s.d = t.d or s.n = t.n),
r as (select *, row_number() over (partition by source order by score desc, path) as rank from j)
select source, path, score, rank from r where rank <= 8""")
def nearest_tests(spark, d):
    """O-6: tests of a source by directory and stem."""
    folder = F.expr(_DIR)
    p = _t(spark, d, "part", "p_partkey", "p_size")
    name = lambda mark: F.concat(folder, F.lit(mark), F.floor(F.col("p_partkey") / 2).cast("string"), F.lit(".py")).alias("path")
    n = F.col("p_partkey") % 4
    return G.nearest_tests(p.where(n == 0).select(name("/m")), p.where(n.isin(1, 2)).select(name("/test_m"))).select("source", "path", "score", "rank")


@query(f"""
with t as (select distinct {_PATH} as f, l_orderkey as pr from lineitem), b as (select t.*, 'said of ' || pr || repeat(' and more', 40) as body from t where pr % 3 > 0),
r as (select *, row_number() over (partition by f order by pr desc) as rank from b where f in (select f from t group by f having count(*) % 2 = 0))
select f as filename, pr, left(body, 220) as body, rank from r where rank <= 20""")
def file_idioms(spark, d):
    """G-9: texts of a file's newest changes."""
    t = _t(spark, d, "lineitem", "l_orderkey", "l_partkey").select(F.expr(_PATH).alias("filename"), F.col("l_orderkey").alias("pr")).distinct()
    seeds = t.groupBy("filename").agg(F.count("*").alias("n")).where("n % 2 = 0").select("filename")
    n = F.col("o_orderkey")
    nodes = _t(spark, d, "orders", "o_orderkey").select(n.alias("number"), F.when(n % 3 > 0, _text("said of ", [n], " and more" * 40)).otherwise("").alias("body"))
    return G.idioms(t, nodes, seeds)


@query("""
with s as (select o_custkey as path, o_orderkey as name, (o_orderkey % 97)::int as lo from orders where o_orderstatus <> 'P'),
t as (select o_custkey as path, min(o_orderkey % 60)::int as line from orders where o_orderstatus = 'P' group by 1),
r as (select path, name, lo, abs(lo - line) as distance, row_number() over (partition by path order by abs(lo - line), lo, name) as rank from s join t using (path))
select path, name, distance, rank from r where rank <= 3""")
def nearest_symbols(spark, d):
    """O-7: a file's symbols by distance from its first touched line."""
    o = _t(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("name"), "o_orderstatus")
    s = o.where("o_orderstatus <> 'P'").select("path", "name", (F.col("name") % 97).cast("int").alias("lo"))
    t = o.where("o_orderstatus = 'P'").select("path", (F.col("name") % 60).cast("int").alias("line"))
    return G.nearest_symbols(s, t, 3).select("path", "name", "distance", "rank")
