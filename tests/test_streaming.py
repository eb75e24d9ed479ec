"""Streams against the same result in batch."""

import datetime as dt

from pyspark.sql import functions as F

from gritstone.streaming import streams as ST

ROWS = [(1, "a", dt.datetime(2024, 1, 1, 0, 5), 1.0), (1, "a", dt.datetime(2024, 1, 1, 0, 6), 2.0), (2, "b", dt.datetime(2024, 1, 1, 2, 0), 3.0), (2, "b", dt.datetime(2024, 1, 1, 2, 59), 4.0), (3, "c", dt.datetime(2024, 1, 3), 0.9)]


def source(spark, path):
    df = spark.createDataFrame(ROWS, "k int, t string, ts timestamp, v double")
    df.coalesce(1).write.mode("append").parquet(path)
    return ST.file_stream(spark, path, df.schema)


def drained(q):
    q.awaitTermination()


def test_ingest_resumes(spark, tmp_path):
    src = source(spark, str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    drained(ST.ingest(src, out, state))
    drained(ST.ingest(src, out, state))
    assert spark.read.parquet(out).count() == len(ROWS)
    source(spark, str(tmp_path / "in"))
    drained(ST.ingest(src, out, state))
    assert spark.read.parquet(out).count() == 2 * len(ROWS)


def test_dedup_and_alerts(spark, tmp_path):
    s = ST.dedup_events(source(spark, str(tmp_path / "in")), ["k", "t"], "ts", "7 days")
    drained(ST.ingest(s, str(tmp_path / "out"), str(tmp_path / "state")))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 3 and ST.alerts(out, "v", 0.8).count() == 3


def test_hourly_closes_windows_behind_the_watermark(spark, tmp_path):
    h = ST.hourly(source(spark, str(tmp_path / "in")), "ts", ["t"], "v")
    drained(ST.ingest(h, str(tmp_path / "out"), str(tmp_path / "state")))
    batch = ST.hourly(spark.createDataFrame(ROWS, "k int, t string, ts timestamp, v double"), "ts", ["t"], "v")
    got, want = set(spark.read.parquet(str(tmp_path / "out")).collect()), set(batch.collect())
    assert {r.t for r in got} == {"a", "b"} and got <= want and len(want) == 3
    s = ST.sessions(spark.createDataFrame(ROWS, "k int, t string, ts timestamp, v double"), "ts", ["t"], "10 minutes")
    assert s.count() == 4


def test_bounded_rounds(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, 0) for i in range(5)], "need int, have int")

    def step(d):
        def once(batches):
            for b in batches:
                calls.add(len(b))
                yield b.assign(have=b["have"] + 1, luck=__import__("random").random())

        return d.select("need", "have").mapInPandas(once, "need int, have int, luck double").withColumn("done", F.col("have") >= F.col("need"))

    out = ST.bounded_rounds(df, step, f"file://{tmp_path}/r", 3)
    for _ in range(2):
        assert sorted((r.need, r.rounds, r.done) for r in out.collect()) == [(0, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False)]
    assert calls.value == 5 + 3 + 2  # one call a row and round
    assert {(r.need, r.luck) for r in out.collect()} == {(r.need, r.luck) for r in out.collect()}
    assert ST.bounded_rounds(df.where("need < 2"), step, f"file://{tmp_path}/s", 9).count() == 2
