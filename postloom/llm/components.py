"""Connected components of an edge table, in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import attach
from postloom.session import written


def _linked_to_least(edges: DataFrame, only_larger: bool) -> DataFrame:
    """Link every node's neighbours to the least node among it and them.

    ``only_larger``: only neighbours above the node move (large star); else
    edges point to lower nodes, and the node itself moves with them (small star).
    """
    least = edges.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    least = least.withColumn("least", F.least("u", "least"))
    joined = attach(edges, least, ["u"], "n")
    if only_larger:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).union(
            least.select("u", F.col("least").alias("v"))
        )
    return moved.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of ``edges`` (u, v) the least node it is connected to.

    Alternates large and small star until nothing changes.  A node with very
    many neighbours is summed up before the shuffle and looked up by ``attach``.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    edges = written(edges, "edges")
    if not edges.limit(1).count():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = None
    while True:
        both = written(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges-both")
        large = _linked_to_least(both, True)
        large = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large-star")
        edges = written(_linked_to_least(large, False), "small-star")
        now = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h"), F.countDistinct("u").alias("d")
        ).first()
        if mark == now:  # every node points at its least node
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
