"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the component's smallest node.

    Each round joins nodes to their smallest neighbour twice.  Smallest
    neighbours are found by a partial aggregate and joined back, so a node with
    very many neighbours is split by Spark's skew handling.  Every round is
    written to the shared folder, and starts by looking whether any edge is left
    that does not lead straight to a root.
    """
    spark = edges.sparkSession
    now, path = C.stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:  # a logarithmic number of rounds, whatever the edges
        # Done once all edges lead from leaves straight to a root.
        if now.groupBy("u").count().where("count > 1").isEmpty() and now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        large, mid = C.stored(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small, new = C.stored(small, "edges")
        C.dropped(spark, mid, path)
        now, path = small, new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
