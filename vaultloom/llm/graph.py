"""Connected components on edge tables, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, spread_join


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node of `edges` (a, b): label is the smallest node that can be reached.

    Large-star and small-star steps alternate until the edges are stars. Minima are summed partly before the shuffle and
    joined back by node, with the edges of a node that has very many dealt over several tasks. Each step is a written table.
    """
    now = scratch(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    last = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, least.drop("n"), ["u"], least.select("u", "n"), ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch(large, f"{name}-large")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, small_least.drop("n"), ["u"], small_least.select("u", "n"), ["v"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        before, now = now, scratch(small.select("e.u", "e.v").where("u <> v").distinct(), name)
        discard(before, large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
