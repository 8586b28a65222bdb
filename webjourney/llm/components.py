"""Connected components of a graph that is far larger than any one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webjourney.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id each vertex of ``edges`` (a, b) reaches; vertices without edges are absent.

    Large-star and small-star steps alternate until nothing changes; each step hangs neighbours on the smallest one
    and is written to the shared folder, so the plan stays short and lost executors cost one step.
    """
    pairs = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())

    def summary() -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    state = summary()
    while state[0]:
        both = pairs.union(pairs.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        pairs = stored(small.select("a", "m").union(small.where("b > m").select("b", "m")).toDF("a", "b").distinct())
        now = summary()
        if now == state:
            break
        state = now
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        pairs.select("b", "b").distinct())
