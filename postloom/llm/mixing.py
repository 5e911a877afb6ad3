"""Mixing sources to target weights by nested hash thresholds.

Every document has a 60-bit hash.  A source takes whole passes over all its
documents plus those whose hash lies below a threshold.  The threshold comes
from histograms: sizes summed by source and the hash's first 10 bits give the
bucket in which the budget runs out; only that boundary bucket is split by the
next 10 bits, and so on.  Documents are then filtered, never sorted.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import attach, or_empty, tagged
from postloom.session import written

BITS, LEVELS = 10, 6


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, LF, VT, FF and CR."""
    marked = F.concat(F.lit(" "), F.translate(or_empty(text), "\t\n\x0b\x0c\r", "     "))
    return F.regexp_count(marked, F.lit(" [^ ]")).cast("long")


def hash60(seed: int, id_col: Column, text: Column) -> Column:
    """60 bits of md5 over seed, id and text: the same in every run, layout and engine."""
    parts = F.concat_ws(":", F.lit(str(seed)), tagged(id_col), F.md5(or_empty(text)))
    return F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], budget: float, max_passes: float) -> DataFrame:
    """key, source_size, n, target: one row per source, targets by water filling.

    Sources in code-point order, null last, get ``weights`` in turn and share
    ``budget`` times all sizes; none gets more than ``max_passes`` times its
    size, and what is cut off is shared by weight among the others.  In order
    of cap / weight the capped sources come first; the level of the others is
    what the caps leave, divided by the weights left.  The windows here run
    over one row per source.
    """
    per = sizes.groupBy("key").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.first("source").alias("source")
    )
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(max_passes))
    per = per.withColumn("full_at", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    used = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", (F.sum("source_size").over(every) * budget - cut) / (F.sum("weight").over(every) - used))
    open_level = F.max(F.when(F.col("full_at") > F.col("level"), F.col("level"))).over(every)
    return per.select(
        "key", "source_size", "n", F.coalesce(F.least("cap", F.col("weight") * open_level), "cap").alias("target")
    )


def mix(
    docs: DataFrame, weights: list[float] = (5, 2, 1), budget: float = 1.5, max_passes: float = 2.0, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, hash, size, source_size, target, copies.

    ``copies`` times the document is in the mix.  Null texts have size 0, null
    sources are a source of their own.  Rows alike in id and text share one
    hash and one fate.  Reruns agree.  An empty table gives no rows.
    """
    sizes = written(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), tagged(F.col(source_col)).alias("key"),
            word_count(F.col(text_col)).alias("size"), hash60(seed, F.col(id_col), F.col(text_col)).alias("hash"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sizes, list(weights), budget, max_passes)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = written(
        targets.withColumn("whole", whole.cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0.0))
        .withColumn("edge", F.col("source_size").cast("double")).withColumn("edge_n", F.col("n")),
        "mix-state",
    )
    level = 0
    while level < LEVELS and state.where("edge_n > 1").limit(1).count():
        state = written(_refined(sizes, state, level), "mix-state")
        level += 1
    spare = BITS * (LEVELS - level)
    nearer = F.when(F.col("rest") - F.col("below") > F.col("edge") / 2, 1).otherwise(0)
    cuts = state.select(
        "key", "source_size", "target", "n", "whole",
        F.shiftleft(F.col("prefix") + nearer.cast("long"), spare).alias("threshold"),
    )
    return attach(sizes, cuts, ["key"], "n").select(
        "id", "hash", "size", "source_size", "target",
        F.least(
            F.col("whole") + (F.col("hash") < F.col("threshold")).cast("long"), F.lit(math.ceil(max_passes)).cast("long")
        ).alias("copies"),
    )


def _refined(sizes: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """Split each source's boundary bucket by the next bits of the hash."""
    left = BITS * (LEVELS - level)
    inside = attach(sizes.select("key", "hash", "size"), state.select("key", "prefix", "n"), ["key"], "n").where(
        F.shiftright("hash", left) == F.col("prefix")
    )
    buckets = inside.groupBy("key", F.shiftright("hash", left - BITS).alias("bucket")).agg(
        F.sum("size").cast("double").alias("sum"), F.count(F.lit(1)).alias("rows")
    )
    known = buckets.join(state.select("key", "rest", "below"), "key")
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("before", F.col("below") + F.coalesce(F.sum("sum").over(upto), F.lit(0.0)))
    # The boundary is the last bucket that begins within the budget.
    found = known.where(F.col("before") <= F.col("rest")).groupBy("key").agg(
        F.max(F.struct("bucket", "before", "sum", "rows")).alias("b")
    )
    return state.drop("prefix", "below", "edge", "edge_n").join(found, "key").select(
        *[c for c in state.columns if c not in ("prefix", "below", "edge", "edge_n")],
        F.col("b.bucket").alias("prefix"), F.col("b.before").alias("below"),
        F.col("b.sum").alias("edge"), F.col("b.rows").alias("edge_n"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, **how) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as it is taken."""
    taken = mix(docs, seed=seed, id_col=id_col, text_col=text_col, **how)
    key = F.concat_ws("/", tagged(F.col("id")), F.col("hash").cast("string"))
    copies = taken.groupBy(key.alias("key")).agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"), hash60(seed, F.col(id_col), F.col(text_col)).alias("hash"),
    ).select("row", key.alias("key"))
    both = rows.join(copies, "key")
    return both.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
