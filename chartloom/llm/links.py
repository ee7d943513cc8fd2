"""Connected components of links between ids, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.shared import saved


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id of ``edges`` (a, b); the component is its smallest id.

    Large and small stars alternate until nothing changes.  A star sends each
    edge once; the smallest neighbour comes from an aggregate that combines
    before the exchange and a join that the engine splits where a hub is hot.
    No links are collected; a round passes two counts to the driver.
    """
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        # large star: larger neighbours of each id go to its smallest neighbour
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, "links-large")
        # small star: smaller neighbours, and the id itself, go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = saved(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links-small")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    members = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
