"""Mixing sources to target weights: tokens by source, repetition rates, seeded copies; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, free, n_tasks, table, written

#: Numbers of 32 bits that a document may draw with; a digest holds eight.
DRAWS = 32
#: All sources are broadcast up to so many, and so many bytes of names; beyond, those with a task's share of all rows.
SOURCES, NAME_BYTES = 10_000, 1 << 20


def words(text: Column) -> Column:
    """Words of a text, as runs of other characters than [\\x20\\x09-\\x0D]; each becomes one character, so no list is made."""
    return F.length(F.regexp_replace(F.ltrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")).cast("long")


def draw(id_: Column, k: Column) -> Column:
    """The ``k``-th of a document's DRAWS numbers from 0 to 2^32 - 1, by its id alone."""
    digest = F.sha2(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.floor(k / 8)).cast("binary"), 256)
    return F.conv(F.substring(digest, k % 8 * 8 + 1, F.lit(8)), 16, 10).cast("long")


def drawn(rate: Column, value: Column) -> Column:
    """Copies at ``rate``: its whole part, and one more where the draw falls below its fraction."""
    return F.floor(rate) + F.when(value < (rate - F.floor(rate)) * F.lit(4294967296.0), 1).otherwise(0)


def cycle_weights(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """``sources`` with ``weight``: ``cycle`` dealt out again and again over sources by code point, null last.

    Sources are sorted in ranges, numbered within a range, and shifted by the ranges before.
    """
    spark = sources.sparkSession
    ranged = written(sources.repartitionByRange(n_tasks(spark), F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1 + F.col("before")
    weight = F.get(F.array(*[F.lit(float(x)) for x in cycle]), F.pmod(place, F.lit(len(cycle))).cast("int"))
    return ranged.join(F.broadcast(shift), "part").withColumn("weight", weight).select(*sources.columns, "weight")


def with_targets(sources: DataFrame, most: float) -> DataFrame:
    """``sources`` (source, rows, source_size, weight) with ``target``: all sizes shared by weight, none over ``most`` times its own.

    Each round shares what sources at their limit leave among the others, until none is above; a
    round is one aggregate over the sources, of which two sums reach the driver. A round that
    changes anything adds a source to those at their limit, so rounds end.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first().t
    limit, unit = F.col("source_size") * F.lit(float(most)), 0.0
    full = F.col("weight") <= 0
    while True:
        open_ = F.when(~full, F.col("weight")).otherwise(0.0)
        got = sources.agg(F.coalesce(F.sum(open_), F.lit(0.0)).alias("w"), F.coalesce(F.sum(F.when(full & (F.col("weight") > 0), limit)), F.lit(0.0)).alias("c")).first()
        if got.w <= 0 or (total - got.c) / got.w <= unit:
            break
        unit = (total - got.c) / got.w
        full = (F.col("weight") <= 0) | (F.col("weight") * F.lit(unit) > limit)
    return sources.withColumn("target", F.when(F.col("weight") <= 0, 0.0).otherwise(F.least(F.col("weight") * F.lit(unit), limit)))


def _with_source(df: DataFrame, found: DataFrame, source: str, spark: SparkSession) -> DataFrame:
    """``df`` with its source's row of ``found`` (source, rows, ...).

    Few sources are broadcast. Of many, those with more than a task's share of all rows are, at most
    one a task; the others' rows meet by source, where no key holds more than that share.
    """
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("b"), F.coalesce(F.sum("rows"), F.lit(0)).alias("r")).first()
    new = [c for c in found.columns if c not in ("source", "rows")]
    key = free(df, "source")[0]
    side = found.withColumnRenamed("source", key)
    on = lambda d: d[source].eqNullSafe(F.col(key))
    if size.n <= SOURCES and size.b <= NAME_BYTES:
        return df.join(F.broadcast(side.drop("rows")), on(df)).select(*[df[c] for c in df.columns], *new)
    hot = F.col("rows") > size.r / n_tasks(spark)
    large, small = side.where(hot).drop("rows"), side.where(~hot).drop("rows")
    few = df.join(F.broadcast(large), on(df)).select(*[df[c] for c in df.columns], *new)
    rest = df.join(F.broadcast(large.select(key)), on(df), "left_anti")
    return few.unionByName(rest.join(small.hint("merge"), on(rest)).select(*[rest[c] for c in df.columns], *new))


def repetitions(
    docs: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), most: float = 3, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", names: tuple[str, str, str, str] = ("size", "source_size", "target", "copies"),
) -> DataFrame:
    """``docs`` with its words, its source's words and target, and how often the mix takes it.

    A source's rate is its target by its words. A document is taken floor(rate) times, and once
    more with a probability of the rate's fraction, drawn from digests of its id. They give DRAWS
    numbers; each source uses the one of them that comes nearest to its target, the first of
    those equal. So reruns agree, and no document is taken over ``most`` times.

    Null texts have no words. Sources without words have a target of 0. Rows of one id draw alike;
    rows without an id do, too. An empty table gives none. Columns of ``docs`` stay; ``names`` may not be among them.
    """
    if {c.lower() for c in docs.columns} & {c.lower() for c in names}:
        raise ValueError(f"columns called {names} are in the way; give other names")
    spark = docs.sparkSession
    narrow = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "sizes")
    by_source = narrow.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    aimed = written(with_targets(written(cycle_weights(by_source, cycle), "weights"), most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = aimed.select("source", "rows", "source_size", "target", rate.alias("rate"))
    tried = _with_source(narrow, aimed, "source", spark).groupBy("source").agg(
        F.first("target").alias("aim"), *[F.sum(F.col("size") * drawn(F.col("rate"), draw(F.col("id"), F.lit(k)))).alias(f"t{k}") for k in range(DRAWS)]
    )
    off = F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("aim")).alias("off"), F.lit(k).alias("k")) for k in range(DRAWS)])
    draws = tried.select("source", F.array_min(off).k.alias("k"))
    s, n, a, r, k = free(docs, "source_size", "size", "target", "rate", "k")
    final = written(aimed.join(draws.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "rows", F.col("source_size").alias(s), F.col("target").alias(a), F.col("rate").alias(r), F.col("k").alias(k)), "rates")
    delete(narrow)
    out = _with_source(docs.withColumn(n, words(F.col(text_col))), final, source_col, spark)
    copies = drawn(F.col(r), draw(F.col(id_col), F.col(k))).cast("int")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(n).alias(names[0]), F.col(s).alias(names[1]), F.col(a).alias(names[2]), copies.alias(names[3]))


def mix(docs: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), most: float = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as ``repetitions`` says, with all its columns. Texts don't move."""
    names = free(docs, "size", "source_size", "target", "copies")
    out = repetitions(docs, cycle, most, id_col, text_col, source_col, tuple(names))
    again = free(out, "copy")[0]
    return out.withColumn(again, F.explode(F.array_repeat(F.lit(1), F.col(names[3])))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return repetitions(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = {
    "op13_source_mixing": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         [sha256(concat(doc_id::varchar, ':', j)) for j in range(4)] as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight, 3.0::double * source_size as most from s),
o as (select *, (sum(source_size) over ())::double as total,
        coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as below,
        (sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following))::double as above from w),
u as (select coalesce(max((total - below) / above) filter (most / weight >= (total - below) / above), 0) as unit from o),
t as (select source, source_size, least(weight::double * unit, most) as target,
        case when source_size > 0 then least(weight::double * unit, most) / source_size else 0 end as rate from w, u),
k as (select unnest(range(32)) as k),
c as (select d.doc_id, d.size, t.source, t.source_size, t.target, k.k,
        (floor(t.rate) + case when ('0x' || substr(d.h[k.k // 8 + 1], k.k % 8 * 8 + 1, 8))::bigint < (t.rate - floor(t.rate)) * 4294967296 then 1 else 0 end)::bigint * d.size as taken
      from d join t on d.source is not distinct from t.source cross join k),
b as (select source, arg_min(k, (abs(got - target), k)) as k from (select source, k, sum(taken) as got, any_value(target) as target from c group by source, k) group by source)
select c.doc_id, c.size, c.source_size, c.target, c.taken from c join b on c.source is not distinct from b.source and c.k = b.k"""
}
QUERIES = {"op13_source_mixing": op13_source_mixing}
