"""Classification, retrieval, patch, judge and trajectory metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_fences
from .relational import percentiles

MISSING_SCORE = 3.0  # fixed value: a judge's dimension that is not given


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def binary_metrics(df: DataFrame, true: Column, pred: Column) -> DataFrame:
    """M-1: confusion counts, precision, recall, F1, accuracy; zero where a denominator is."""
    c = df.agg(
        F.count_if(true & pred).alias("tp"), F.count_if(~true & pred).alias("fp"), F.count_if(true & ~pred).alias("fn"), F.count_if(~true & ~pred).alias("tn")
    )
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"))


def class_metrics(df: DataFrame, true: str, pred: str, classes: list[str]) -> DataFrame:
    """M-2, M-3: precision, recall, F1 and support of each class. Predictions outside ``classes`` count as missed."""
    pairs = df.where(F.col(true).isin(classes)).groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    each = pairs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.when((F.col("t") == c) & (F.col("p") == c), F.col("n")).otherwise(0).alias("tp"), F.when((F.col("t") != c) & (F.col("p") == c), F.col("n")).otherwise(0).alias("fp"), F.when((F.col("t") == c) & ~F.col("p").eqNullSafe(c), F.col("n")).otherwise(0).alias("fn")) for c in classes])).alias("x")).select("x.*")
    s = each.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select("class", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def macro_metrics(per_class: DataFrame) -> DataFrame:
    """M-2, M-3: macro and weighted F1 over ``class_metrics``."""
    return per_class.agg(F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    """M-2."""
    return df.groupBy(true, pred).agg(F.count("*").alias("n"))


def recall_at(gold: Column, generations: Column, k: int) -> Column:
    """M-4, U-8: share of gold files among those of the first ``k`` generations; null without gold."""
    seen = F.array_distinct(F.flatten(F.slice(generations, 1, k)))
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(gold, seen)) / F.size(F.array_distinct(gold)))


def scope_compliance(predicted: Column, allowed: Column) -> Column:
    """M-5: share of predicted files within the allowed ones; 1 if nothing is predicted."""
    n = F.size(predicted)
    return F.when(n == 0, 1.0).otherwise(F.size(F.filter(predicted, lambda f: F.array_contains(allowed, f))) / n)


def file_recall(predicted: Column, gold: Column) -> Column:
    """M-5; null without gold."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(gold, predicted)) / F.size(F.array_distinct(gold)))


def hunk_overlap(predicted: Column, gold: Column) -> Column:
    """M-5: share of gold hunk headers also predicted; null without gold."""
    return file_recall(predicted, gold)


def mean_by(df: DataFrame, by: str, values: list[str]) -> DataFrame:
    """M-6: means that skip nulls and NaN."""
    return df.groupBy(by).agg(*[F.avg(F.when(~F.isnan(v), F.col(v))).alias(v) for v in values])


def judge_scores(raw: Column, dims: tuple[str, ...]) -> Column:
    """M-7: the mean of dimension scores from JSON (also in a code fence), each cut to a whole number within 1 to 5.

    A dimension that is missing counts MISSING_SCORE; the score is null where the text is no JSON object or a
    dimension's value is no number (null too).
    """
    x = F.from_json(strip_fences(raw), "map<string, string>")
    value = lambda d: F.when(F.map_contains_key(x, F.lit(d)), F.try_element_at(x, F.lit(d)).try_cast("double")).otherwise(MISSING_SCORE)
    clamp = lambda v: F.when(v.isNotNull(), F.least(F.greatest(v.cast("int").cast("double"), F.lit(1.0)), F.lit(5.0)))  # noqa: E731  (least and greatest skip nulls)
    return F.when(x.isNotNull(), sum((clamp(value(d)) for d in dims), F.lit(0.0)) / len(dims))


def judge_summary(df: DataFrame, score: str, label: str, correct: Column) -> DataFrame:
    """M-8: mean judge score by label, and of right and wrong rows."""
    s = F.col(score)
    return df.groupBy(label).agg(F.avg(s).alias("mean"), F.avg(F.when(correct, s)).alias("mean_correct"), F.avg(F.when(~correct, s)).alias("mean_incorrect"), F.count(s).alias("n"))


def latency(df: DataFrame, by: str, value: str) -> DataFrame:
    """M-9: mean, median (interpolated), least and greatest value of each group, which may be of any size."""
    p = percentiles(df, value, {"median": 0.5}, [by]).withColumnRenamed(by, "k")
    m = df.groupBy(by).agg(F.avg(value).alias("mean"))
    return m.join(p, F.col(by).eqNullSafe(F.col("k")), "left").select(by, "mean", "median", "min", "max")


def mean_stdev(df: DataFrame, value: str) -> DataFrame:
    """M-15."""
    return df.agg(F.avg(value).alias("mean"), F.stddev(value).alias("stdev"))


def calls_match(ref: Column, got: Column) -> Column:
    """M-10: same tool, and same input where the reference gives one."""
    return (ref.tool_name == got.tool_name) & (ref.tool_input.isNull() | (ref.tool_input == got.tool_input))


def trajectory_exact(ref: Column, got: Column) -> Column:
    """M-10: same length and each call matches."""
    same = F.forall(F.zip_with(ref, got, calls_match), lambda x: F.coalesce(x, F.lit(False)))
    return F.when((F.size(ref) == F.size(got)) & same, 1.0).otherwise(0.0)


def trajectory_in_order(ref: Column, got: Column) -> Column:
    """M-11: calls to the reference's tools match in order. As in the reference a missing tail still scores 1."""
    names = F.transform(ref, lambda r: r.tool_name)
    mine = F.filter(got, lambda g: F.array_contains(names, g.tool_name))
    n = F.least(F.size(ref), F.size(mine))
    same = F.forall(F.zip_with(F.slice(ref, 1, n), F.slice(mine, 1, n), calls_match), lambda x: F.coalesce(x, F.lit(False)))
    return F.when(same, 1.0).otherwise(0.0)


def greedy_matches(ref: Column, got: Column) -> Column:
    """M-12: how many reference calls find a call of their own, first come, first served."""

    def step(left: Column, r: Column) -> Column:
        hit = F.transform(left, lambda g: F.coalesce(calls_match(r, g), F.lit(False)))
        at = F.array_position(hit, F.lit(True))
        return F.when(at > 0, F.filter(left, lambda g, i: i != (at - 1).cast("int"))).otherwise(left)

    return F.size(got) - F.size(F.aggregate(ref, got, step))


def trajectory_any_order(ref: Column, got: Column) -> Column:
    return F.when(greedy_matches(ref, got) == F.size(ref), 1.0).otherwise(0.0)


def trajectory_precision(ref: Column, got: Column) -> Column:
    return _ratio(greedy_matches(ref, got).cast("double"), F.size(got))


def trajectory_recall(ref: Column, got: Column) -> Column:
    return _ratio(greedy_matches(ref, got).cast("double"), F.size(ref))


def tool_calls(events: Column) -> Column:
    """M-13: the function calls of an event list as (tool_name, tool_input)."""
    calls = F.flatten(F.transform(events, lambda e: F.filter(F.coalesce(e.content.parts, F.array()), lambda p: p.function_call.isNotNull())))
    return F.transform(calls, lambda p: F.struct(p.function_call["name"].alias("tool_name"), p.function_call["args"].alias("tool_input")))


def final_response(events: Column) -> Column:
    """M-14: the last event's text that is not empty."""
    texts = F.transform(events, lambda e: F.array_join(F.transform(F.coalesce(e.content.parts, F.array()), lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    return F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(-1))
