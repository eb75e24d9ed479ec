"""Structured Streaming forms: resumable ingestion, idempotent events, windows, histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """T-1: new files of a folder; the query's checkpoint remembers which are done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet"):
    """T-1: all that is there now, chunk by chunk; a rerun goes on where the last one ended."""
    return stream.writeStream.format(fmt).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_events(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """T-2, T-3: each key once within the delay; state older than that is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def hourly(stream: DataFrame, ts: str, by: list[str], value: str, delay: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """T-9: counts and sums by tumbling (or sliding) windows; late rows within the delay still count."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = stream.withWatermark(ts, delay).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, ts: str, by: list[str], gap: str, delay: str = "1 hour") -> DataFrame:
    """Sessions by gap; a Spark convenience the reference has no operator for."""
    g = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def alerts(stream: DataFrame, score: str, threshold: float = 0.8) -> DataFrame:
    """T-8: rows at the threshold or over."""
    return stream.where(F.col(score) >= threshold)


class LastMessages(StatefulProcessor):
    """T-4: after each batch the last ``n`` texts of a session, kept as one state value."""

    def __init__(self, n: int = 10):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "items array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items = list(self.state.get()[0]) if self.state.exists() else []
        for part in rows:
            items += part.sort_values("ts")["text"].tolist()
        items = items[-self.n :]
        self.state.update((items,))
        yield pd.DataFrame({"session": [key[0]], "items": [items]})

    def close(self) -> None:
        pass


def bounded_rounds(open_rows: DataFrame, step, folder: str, most: int = 3) -> DataFrame:
    """T-6: ``step`` (frame -> frame with ``done``) on rows that are not done, ``most`` times; rounds are counted.

    Each round's rows are written to ``folder`` (a new one, shared by all executors) and read
    from there, so ``step`` sees a row once a round, however often the result is read, and a step that
    does not give the same twice (a model) is kept as it was. A round that leaves nothing open is the last.
    """
    spark, rounds = open_rows.sparkSession, []
    rows = open_rows.withColumns({"done": F.lit(False), "rounds": F.lit(0)})
    for n in range(1, most + 1):
        after = step(rows.where("not done")).withColumns({"done": F.coalesce(F.col("done"), F.lit(False)), "rounds": F.lit(n)})
        at = f"{folder.rstrip('/')}/round={n}"
        after.write.parquet(at)
        rows = spark.read.schema(after.schema).parquet(at)
        rounds.append(rows)
        if rows.where("not done").isEmpty():
            break
    if not rounds:
        return rows
    out = rounds[-1]
    for r in rounds[:-1]:
        out = out.unionByName(r.where("done"))
    return out
