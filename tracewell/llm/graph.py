"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that links reach.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest; rounds grow with the
    logarithm of the number of nodes. Only counts reach the driver.
    """
    by = W.partitionBy("u")
    cur, last = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(by))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.where("u <> v").distinct().withColumn("m", F.min("v").over(by))
        older, cur = cur, written(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m")).distinct())
        discard(older)
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    roots = cur.select("v").distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v")).distinct()
