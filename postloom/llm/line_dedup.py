"""Line de-duplication against levelled sorted runs of line hashes.

Runs hold one row per line key seen so far: its 128-bit hash and the document
that owns it.  They are bucketed and sorted by hash.  A batch of documents
merge-anti-joins every run, and what is left, one owner per key, becomes a new
run of level 0.  When a level holds ``fan`` runs, they merge into one run of the
next level, so a batch meets at most ``fan`` - 1 runs per level.  A line stays
where its document owns it; all other occurrences go.

All joins are on hashes plus, at the end, the document, so a line that is in
every document skews nothing: it is one row per run and one per document.  That
last join leaves the buckets of the runs for that reason; it is one join, of all
runs together.  What goes is gathered per row of the input, known by its id and
two hashes of its text, so an id on very many rows gathers nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.common import SPACES, lower_ascii, or_empty
from postloom.session import new_folder, written

HASH = ["h1", "h2"]
OWNER = ["none", "id"]  # rows without id (none) count as one last document
ROW = [*OWNER, "t1", "t2"]


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """Levelled runs of (h1, h2, owner), as bucketed tables over files in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = 2):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """Take in a batch of (h1, h2, id) and, where ids may be missing, none; its ids must not be below earlier ones."""
        if "none" not in keys.columns:
            keys = keys.withColumn("none", F.lit(False))
        fresh = keys.groupBy(*HASH).agg(F.min(F.struct(*OWNER)).alias("owner"))
        for run in self.tables():
            fresh = fresh.join(run, HASH, "left_anti")
        self._put(0, fresh)

    def _put(self, level: int, run: DataFrame) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
            .option("path", new_folder(self.spark, "line-run")).saveAsTable(name)
        )
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan:
            names, self.levels[level] = self.levels[level], []
            merged = self.spark.table(names[0])
            for other in names[1:]:  # co-bucketed: merged bucket by bucket, no exchange
                side = self.spark.table(other).withColumnRenamed("owner", "other")
                merged = merged.join(side, HASH, "full_outer").select(*HASH, F.coalesce("owner", "other").alias("owner"))
            self._put(level + 1, merged)
            self._drop(names)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_dropped", T.LongType())]))
def _without(text: pd.Series, hashes: pd.Series, gone: pd.Series) -> pd.DataFrame:
    kept, dropped = [], []
    for t, h, g in zip(text, hashes, gone):
        if g is None or not len(g):
            kept.append(t)
            dropped.append(0)
            continue
        stay = ~np.isin(h, g)
        kept.append("\n".join(line for line, s in zip(t.split("\n"), stay) if s))
        dropped.append(int(len(stay) - stay.sum()))
    return pd.DataFrame({"text": kept, "n_dropped": dropped})


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4,
    fan: int = 2, buckets: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_dropped, text (without the lines that go).

    A line's key is the line without surrounding white space, A-Z lower-cased.
    Keys of at least ``min_chars`` characters stay only in the smallest id that
    has them, there as often as they occur.  Null and empty texts are one empty
    line.  Rows that share an id count as one document, rows without id as one
    last document.  Documents are taken in ``batches`` of rising ids; the result
    does not depend on their number.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    ident = F.col(id_col).cast("long")
    base = docs.select(
        ident.isNull().alias("none"), F.coalesce(ident, F.lit(0)).alias("id"), or_empty(F.col(text_col)).alias("text"),
    ).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), "text")})
    key_hash = lambda k: F.when(F.length(k) >= min_chars, F.xxhash64(k)).otherwise(F.lit(0).cast("long"))
    keys_of = F.transform(F.split("text", "\n"), line_key)  # in an array, so that each key is made once

    some = F.when(~F.col("none"), F.col("id"))
    cuts = sorted(set(base.agg(F.percentile_approx(some, [i / batches for i in range(1, batches)]).alias("c")).first()["c"] or []))
    batch = F.when(F.col("none"), len(cuts)).otherwise(sum([(F.col("id") > c).cast("int") for c in cuts], F.lit(0)))
    hashed = base.select(*ROW, F.explode(keys_of).alias("key")).where(F.length("key") >= min_chars).select(
        batch.alias("batch"), *ROW, F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")
    )
    keys = written(hashed, "line-keys")
    runs = LineRuns(spark, buckets, fan)
    try:
        for b in range(len(cuts) + 1):
            runs.add(keys.where(F.col("batch") == b).select(*HASH, *OWNER))
        owned = [run.select("owner.*", *HASH) for run in runs.tables()]
        gone = keys.select(*ROW, *HASH).join(reduce(DataFrame.unionByName, owned), [*OWNER, *HASH], "left_anti")
        gone = written(gone.groupBy(*ROW).agg(F.collect_set("h1").alias("gone")), "lines-gone")
    finally:
        runs.close()

    cleaned = base.join(gone, ROW, "left")
    hashes = F.when(F.col("gone").isNotNull(), F.transform(keys_of, key_hash))  # only where a line goes
    out = cleaned.select(
        "none", "id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), _without("text", hashes, "gone").alias("out")
    )
    return out.select(
        F.when(~F.col("none"), F.col("id")).alias("id"), "n_lines", "out.n_dropped", "out.text"
    )
