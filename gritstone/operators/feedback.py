"""Feedback events, preference labels and their weekly export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chosen_text
from .relational import free

KEY = ["channel_id", "message_ts", "user_id"]


def is_thumbs_down(name: Column) -> Column:
    """P-32: three spellings."""
    return F.replace(F.lower(name), F.lit(":"), F.lit("")).isin("-1", "thumbsdown", "thumbs_down")


def prompt_and_rejected(messages: DataFrame, reacted: DataFrame) -> DataFrame:
    """J-13: with each reacted message the nearest earlier human message with text of its thread.

    Order is by whole seconds, then by place in the input (``seq``).
    """
    human = F.col("bot_id").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")
    w = Window.partitionBy("thread").orderBy(F.floor(F.col("ts").cast("double")), "seq").rowsBetween(Window.unboundedPreceding, -1)
    m = messages.withColumn("prompt_text", F.last(F.when(human, F.col("text")), ignorenulls=True).over(w))
    return m.join(reacted.select("thread", "ts"), ["thread", "ts"], "left_semi").where("prompt_text is not null").select("thread", "ts", "prompt_text", F.col("text").alias("rejected_text"))


def unlabelled(events: DataFrame, labels: DataFrame, start: str, end: str) -> DataFrame:
    """J-8: events of the days start to end, both included, without an accepted label."""
    day = F.to_date("created_at")
    accepted = labels.where("qc_status = 'accepted'").select(F.col("feedback_id").alias("id"))
    return events.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(accepted, "id", "left_anti")


def quality(chosen: Column, rejected: Column) -> Column:
    """P-30: accepted if 8 characters or more and not what was rejected."""
    c = F.trim(F.coalesce(chosen, F.lit("")))
    return F.when(F.length(c) < 8, "too_short").when(c == F.trim(F.coalesce(rejected, F.lit(""))), "identical").otherwise("accepted")


def teacher_labels(events: DataFrame, answers: DataFrame, model: str, run: str) -> DataFrame:
    """L-30: labels from answers (id, raw), with their quality."""
    c = chosen_text(F.col("raw"))
    return events.join(answers, "id").select(F.col("id").alias("feedback_id"), c.alias("chosen_text"), F.lit(model).alias("teacher_model"), F.lit(run).alias("teacher_run_id"), quality(c, F.col("rejected_text")).alias("qc_status"))


def replace_unaccepted(labels: DataFrame, new: DataFrame) -> DataFrame:
    """K-21: new labels take the place of labels of their event that were not accepted."""
    (hit,) = free(labels, "hit")
    keys = new.select("feedback_id").distinct().withColumn(hit, F.lit(True))
    kept = labels.join(keys, "feedback_id", "left").where(F.col(hit).isNull() | (F.col("qc_status") == "accepted")).drop(hit)
    return kept.unionByName(new)


def preference_rows(events: DataFrame, labels: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """J-9, K-18: accepted (prompt, chosen, rejected), of a week or all; one row a label, in order of labelling."""
    e = events if start is None else events.where(F.to_date("created_at").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    j = e.join(labels.where("qc_status = 'accepted'").withColumnRenamed("id", "label_id"), F.col("id") == F.col("feedback_id"))
    return j.orderBy("labeled_at", "id").select(F.col("id").alias("feedback_id"), F.col("prompt_text").alias("prompt"), F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected"))


def run_record(rows: DataFrame, run_id: str, start: str, end: str, status: str) -> DataFrame:
    """K-19: one row about a run."""
    return rows.agg(F.count("*").cast("int").alias("row_count")).select(F.lit(run_id).alias("run_id"), F.lit(start).cast("date").alias("week_start"), F.lit(end).cast("date").alias("week_end"), F.lit(status).alias("status"), "row_count")
