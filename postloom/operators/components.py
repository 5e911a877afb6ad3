"""Connected components of an edge table, in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.session import written


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node each node of the edges (a, b) is connected to.

    Each round links the larger neighbours of a node to its least neighbour, then
    the smaller ones.  Ends when every node is linked to its root alone.
    """
    links = written(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = links.select(F.col("hi").alias("a"), F.col("lo").alias("b")).union(links.select("lo", "hi"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        links = written(
            both.where("b > a").join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).distinct(), "large-star")
        least = links.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = links.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = written(moved.where("hi != lo").union(least).distinct(), "small-star")
    roots = links.select("lo").distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        roots.select(F.col("lo").alias("node"), F.col("lo").alias("root")))
