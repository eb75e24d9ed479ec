"""Deduplication, aggregates, windows, ranks, sets and upserts over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def free(df: DataFrame, *names: str) -> list[str]:
    """``names`` as columns that ``df`` doesn't have: helper columns never replace a caller's."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while f"__{n}".lower() in taken:
            n += "_"
        taken.add(f"__{n}".lower())
        out.append(f"__{n}")
    return out


def dedup_latest(df: DataFrame, key: str | list[str], version: Column, sequence: Column) -> DataFrame:
    """A-1: of each key the row with the greatest version; of equal versions the first in sequence.

    One aggregate with map-side combine, so a hot key costs a row per task. Rows without a key go.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(version.alias("v"), (-sequence).alias("s"))
    best = df.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def counts(df: DataFrame, *by: str) -> DataFrame:
    """A-2, A-10, A-13, A-24: rows by key."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def frequency(df: DataFrame, items: Column, top: int, sequence: Column) -> DataFrame:
    """A-4: the most frequent items of an array column; ties by first appearance."""
    e = df.select(F.explode(items).alias("item"), sequence.alias("seq"))
    return e.groupBy("item").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first", "item").limit(top).select("item", "n")


def rank_value(df: DataFrame, value: str, places: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Values at 0-based places of the sorted column; ``places`` maps names to SQL over ``n``.

    A-7 ``floor(n / 2)``, A-8 ``floor(n / 10)``, A-11 and A-12 ``floor(n * 0.33)``, A-14
    ``floor(0.9 * (n - 1))``. Values are counted first and ranked by running counts within ranges of
    values, so a window holds a range's distinct values, not a group's, and not rows.
    """
    by = by or []
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    r = _running_by(c, by, value) if by else _running(c, value)
    hit = lambda e: F.max(F.when((F.col("upto") > F.expr(e)) & (F.col("upto") - F.col("c") <= F.expr(e)), F.col(value)))
    return r.groupBy(*by).agg(F.max("n").alias("n"), F.min(value).alias("min"), *[hit(e).alias(k) for k, e in places.items()], F.max(value).alias("max"))


def _running(c: DataFrame, value: str, ranges: int = 256) -> DataFrame:
    """Running counts in order of ``value`` without one task for all: within ranges, then shifted by the ranges before."""
    cuts = c.select(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 4 * ranges).alias("q"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((ranges - 1).bit_length()))])  # a binary search for the number of cuts below
    below = F.aggregate(steps, F.lit(0), lambda r, s: r + F.when(F.get("q", r + s - 1) < F.col(value), s).otherwise(0))
    part = c.crossJoin(F.broadcast(cuts)).withColumn("r", below).drop("q")  # one row of cuts
    sums = part.groupBy("r").agg(F.sum("c").alias("s"))
    shift = sums.select("r", (F.sum("s").over(Window.orderBy("r")) - F.col("s")).alias("shift"), F.sum("s").over(Window.partitionBy()).alias("n"))
    within = F.sum("c").over(Window.partitionBy("r").orderBy(value))
    return part.withColumn("w", within).join(F.broadcast(shift), "r").select(value, "c", (F.col("w") + F.col("shift")).alias("upto"), "n")  # `ranges` rows


#: One value in so many, by its hash, is a candidate for a cut of its group; a group has so many ranges at most.
CUT_ONE_IN, RANGES = 1 << 14, 256


def _running_by(c: DataFrame, by: list[str], value: str) -> DataFrame:
    """Running counts of each group in order of ``value``: within ranges of the group's values, then shifted by the ranges before.

    Cuts are values chosen by a hash, so they are the same whenever they are computed. A group
    with few values has none and is one range; one with nine tenths of all values is RANGES of
    them, none much larger than the others.
    """
    g, q, r, shift, w = free(c, "group", "cuts", "range", "shift", "within")
    keyed = c.withColumn(g, F.struct(*by))  # nulls within a struct are equal
    some = keyed.where(F.pmod(F.xxhash64(value), F.lit(CUT_ONE_IN)) == 0).groupBy(g).agg(F.sort_array(F.collect_list(value)).alias(q))
    thin = F.filter(F.col(q), lambda x, i: F.pmod(i, F.ceil(F.size(q) / (RANGES - 1)).cast("int")) == 0)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((RANGES - 1).bit_length()))])  # a binary search for the number of cuts below
    below = F.aggregate(steps, F.lit(0), lambda a, s: a + F.when(F.get(q, a + s - 1) < F.col(value), s).otherwise(0))
    part = keyed.join(some.select(g, thin.alias(q)), g, "left").withColumn(r, F.coalesce(below, F.lit(0))).drop(q)
    sums = part.groupBy(g, r).agg(F.sum("c").alias(w))
    before = sums.select(g, r, (F.sum(w).over(Window.partitionBy(g).orderBy(r)) - F.col(w)).alias(shift), F.sum(w).over(Window.partitionBy(g)).alias("n"))  # RANGES rows a group
    within = part.withColumn(w, F.sum("c").over(Window.partitionBy(g, r).orderBy(value)))
    return within.join(before, [g, r]).select(*by, value, "c", (F.col(w) + F.col(shift)).alias("upto"), "n")


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """A-7, G-12, M-9: values at shares of each group's sorted rows, interpolated between neighbours; with n, min and max."""
    places = {}
    for k, x in shares.items():
        places |= {f"{k}_lo": f"floor({x!r}D * (n - 1))", f"{k}_hi": f"ceil({x!r}D * (n - 1))"}
    r = rank_value(df, value, places, by)
    at = lambda k, x: F.lit(x) * (F.col("n") - 1) - F.floor(F.lit(x) * (F.col("n") - 1))
    between = [(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * at(k, x)).alias(k) for k, x in shares.items()]
    return r.select(*(by or []), "n", "min", *between, "max")


def summary_line(df: DataFrame, value: str) -> DataFrame:
    """A-15: n, min, median cut to an integer, the value at 90 % of the last place (cut too), max; in one pass of ranges."""
    places = {"lo": "floor((n - 1) / 2)", "hi": "floor(n / 2)", "p90": "floor(0.9D * (n - 1))"}
    whole = lambda c: c.cast("bigint")
    return rank_value(df, value, places).select("n", "min", whole((F.col("lo") + F.col("hi")) / 2).alias("p50"), whole(F.col("p90")).alias("p90"), "max")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """W-7, O-9, O-10, R-5: the first ``n`` rows of each group. Spark prunes each task's rows to ``n`` first."""
    (r,) = free(df, "r")
    return df.withColumn(r, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(r) <= n).drop(r)


def first_last(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """W-5: the first and last ``k`` rows of each group, each row once; ``edge`` says which."""
    up, down = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    a, z = free(df, "a", "z")
    return (
        df.withColumns({a: F.row_number().over(up), z: F.row_number().over(down)})
        .where((F.col(a) <= k) | (F.col(z) <= k))
        .withColumn("edge", F.when(F.col(a) <= k, "first").otherwise("last")).drop(a, z)
    )


def first_last_items(items: Column, key, k: int) -> Column:
    """W-5 in a row: first and last ``k`` of an array by a key (missing keys sort first)."""
    s = F.array_sort(F.transform(items, lambda x, i: F.struct(F.coalesce(key(x), F.lit("")).alias("k"), i.alias("i"), x.alias("x"))))
    n = F.size(s)
    part = F.when(n <= 2 * k, s).otherwise(F.concat(F.slice(s, 1, k), F.slice(s, F.greatest(n - k + 1, F.lit(1)), k)))
    return F.transform(part, lambda x: x["x"])


def max_gap(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    """W-1 to W-3 over rows: the largest gap between consecutive times of each group, in seconds."""
    w = Window.partitionBy(*by).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    (g,) = free(df, "g")
    return df.withColumn(g, gap).groupBy(*by).agg((F.max(g) / 1e6).alias("max_gap_s"), F.count("*").alias("n"))


def merge_intervals(df: DataFrame, by: list[str], lo: str, hi: str, adjacent: int = 1) -> DataFrame:
    """W-8 over rows: overlapping and adjacent intervals of each group made one."""
    w = Window.partitionBy(*by).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b, i = free(df, "before", "island")
    island = F.sum(F.when(F.col(lo) <= F.col(b) + adjacent, 0).otherwise(1)).over(w)
    df = df.select(*by, lo, hi).distinct()  # so that no two rows tie in the order
    return df.withColumn(b, before).withColumn(i, island).groupBy(*by, i).agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop(i)


def clip_budget(df: DataFrame, by: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """W-9 over rows: sizes kept in order until the budget is used; the last is cut."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.lit(budget) - (F.sum(size).over(w) - F.col(size))
    return df.withColumn("kept", F.greatest(F.lit(0), F.least(F.col(size), left))).where("kept > 0")


def stop_at_budget(df: DataFrame, by: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """W-10, W-11: rows before the first that would exceed the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    (s,) = free(df, "s")
    return df.withColumn(s, F.sum(size).over(w)).where(F.col(s) <= budget).drop(s)


def window_usage(df: DataFrame, by: list[str], ts: str, value: str, seconds: int = 60) -> DataFrame:
    """A-22, T-7: the sum over the last ``seconds`` before and at each row."""
    w = Window.partitionBy(*by).orderBy(F.unix_seconds(F.col(ts).cast("timestamp"))).rangeBetween(-seconds, 0)
    return df.withColumn("used", F.sum(value).over(w))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep_on_match: list[str] = (), newest: Column | None = None) -> DataFrame:
    """K-5: source rows replace target rows of their key; ``keep_on_match`` columns keep the target's value.

    Of source rows with one key, one stays: that with the greatest ``newest`` (a null is least), of those
    the one with the greatest hash of its columns. A null key never matches: such rows of both sides
    all stay. The caller writes aside and swaps.
    """
    names = target.columns
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rest = [c for c in source.columns if c not in keys]
    order = F.struct((F.lit(0) if newest is None else newest).alias("v"), F.xxhash64(*source.columns).alias("h"))
    (row,) = free(source, "row")
    one = source.where(known).groupBy(*keys).agg(F.max_by(F.struct(F.lit(0).alias("any"), *rest), order).alias(row))
    one = one.select(*[F.col(c) if c in keys else F.col(row)[c].alias(c) for c in source.columns])
    out = target.join(one.select(*keys), keys, "left_anti").select(*names)
    if keep_on_match:
        held = dict(zip(keep_on_match, free(source, *keep_on_match)))
        (hit,) = free(source.withColumns({h: F.lit(0) for h in held.values()}), "hit")
        old = target.select(*keys, *[F.col(c).alias(h) for c, h in held.items()], F.lit(True).alias(hit))
        one = one.join(old, keys, "left").select(*[F.when(F.col(hit), F.col(held[c])).otherwise(F.col(c)).alias(c) if c in held else F.col(c) for c in names])
    return out.unionByName(one.select(*names)).unionByName(source.where(~known).select(*names))


def insert_new(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """K-20: the source's rows with a new key, of equal keys the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    (r,) = free(source, "r")
    return source.withColumn(r, F.row_number().over(w)).where(F.col(r) == 1).drop(r).join(target.select(*keys), keys, "left_anti").select(*source.columns)


def without_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """K-8, K-13, J-12: rows whose key is not done yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def verified(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """K-17, U-2: rows whose key is done."""
    return df.join(done.select(*keys).distinct(), keys, "left_semi")


def left_default(df: DataFrame, other: DataFrame, on: list[str], defaults: dict[str, Column]) -> DataFrame:
    """J-2, J-6: a left join with defaults where nothing matches."""
    return df.join(other, on, "left").select(*df.columns, *[F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()])


def asof_attach(df: DataFrame, other: DataFrame, on: list[str], condition: Column, item: Column, name: str) -> DataFrame:
    """J-3: the other side's rows of the key that existed by then, as an array; empty where none did.

    Nulls in other columns of ``df`` change nothing, and rows that repeat each get the array once; a
    null key finds nothing.
    """
    distinct = df.distinct()
    hit = distinct.join(other, on).where(condition)
    agg = hit.groupBy(*df.columns).agg(F.array_sort(F.collect_list(item)).alias(name))
    old = {c: f"{c}_{name}" for c in df.columns}
    agg = agg.select(*[F.col(c).alias(old[c]) for c in df.columns], name)
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in old.items()]
    return df.join(agg, same, "left").select(*df.columns, F.coalesce(F.col(name), F.array()).alias(name))


def invert_map(df: DataFrame, key: str, items: str, sequence: str, last_wins: bool) -> DataFrame:
    """J-4: item to key; where several keys hold an item, the last or the first in sequence."""
    e = df.select(F.col(key), F.explode(items).alias("item"), sequence)
    pick = F.max_by if last_wins else F.min_by
    return e.groupBy("item").agg(pick(key, F.col(sequence)).alias(key))


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """J-10, J-11: 0-based positions in an order: numbered within sorted ranges, then shifted by the ranges before."""
    m, p, i, n, shift = free(df, "m", "p", "i", "n", "s")
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(m, F.monotonically_increasing_id())
    part = sorted_.withColumns({p: F.shiftright(m, 33), i: F.col(m).bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = part.groupBy(p).agg(F.count("*").alias(n))
    before = sizes.select(p, (F.sum(n).over(Window.orderBy(p)) - F.col(n)).alias(shift))  # one row a partition
    return part.join(F.broadcast(before), p).withColumn(name, F.col(i) + F.col(shift)).drop(m, p, i, shift)


def is_disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    """U-6, R-9."""
    return a.select(key).intersect(b.select(key)).isEmpty()


def weakest(df: DataFrame, metric: str, key: str, n: int = 5) -> DataFrame:
    """O-11: the ``n`` rows of the least metric (null counts last); ties by key."""
    return df.orderBy(F.asc_nulls_last(metric), key).limit(n)


def token_report(df: DataFrame, tokens: str, most: int) -> DataFrame:
    """A-21: least, middle, 90 % and greatest token count, and how many rows have more than ``most``."""
    places = rank_value(df, tokens, {"median": "floor(n / 2)", "p90": "floor(n * 0.9)"})
    over = df.agg(F.count(F.when(F.col(tokens) > most, 1)).alias("over"))
    return places.crossJoin(over).select("n", "min", "median", "p90", "max", "over")  # one row each


def unique_in_order(items: Column) -> Column:
    """W-12: each item at its first place only."""
    return F.array_distinct(items)


def unique_sorted(items: Column) -> Column:
    """U-4: different items, sorted, as the original's order is not defined."""
    return F.array_sort(F.array_distinct(items))
