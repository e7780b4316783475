"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's smallest node.

    Each round points the larger neighbours of a node to its smallest one, then the
    smaller ones; minima are taken before the shuffle, and a hub's rows stay apart
    until Spark joins them, so a large component is no single group.  The rounds end
    when the edges are stars around their roots.
    """
    link = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    now = written(edges.where("a <> b").select(*link).distinct(), "links")
    state = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a")
        now = written(small.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
                      .unionByName(down.select("a", F.col("low").alias("b"))).distinct(), "links")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
