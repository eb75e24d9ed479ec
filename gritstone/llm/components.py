"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (id, component) of every node in ``edges`` (a, b, both long), component = smallest id.

    Each round needs the neighbours' minimum per node (an aggregate with map-side combine) and a
    join, so no node's neighbours meet in one group. Rounds are written to the shared folder; only
    a count and a checksum reach the driver. Self loops and repeated edges are ignored; nodes
    without an edge to another node are not returned.
    """
    cur = written(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        "edges",
    )
    state = _state(cur)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        sym = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = written(large, "star")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(low.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        nxt = written(small, "edges")
        new = _state(nxt)
        delete(large)
        delete(cur)
        cur = nxt
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (
        cur.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("id"), "component")
        .unionByName(cur.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
        .groupBy("id").agg(F.min("component").alias("component"))
    )
