"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b), for every node of an edge.

    Alternates large-star and small-star steps on the edge table: each node's neighbours are linked to the smallest one
    around, first the larger neighbours, then the smaller.  Rounds grow with the logarithm of the longest path; minima
    are combined before the shuffle, hot nodes are left to Spark's skew join, and each round is written to the shared
    folder.  Only the number of changed edges comes to the driver.
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("m", "u").alias("m"))
        large = both.join(lowest, both["u"] == lowest["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(low, large["u"] == low["n"])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v")))
        after = stored(small.where("u <> v").distinct(), "links")
        changed = after.join(links, ["u", "v"], "left_anti").limit(1).count()
        same = not changed and after.count() == links.count()
        dropped(links)
        links = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
