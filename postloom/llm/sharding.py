"""Sharding: a two-pass external shuffle.

Pass 1 scatters the rows uniformly into buckets small enough for a task's
memory, by seeded hashes.  Pass 2 gives each bucket a Fisher-Yates shuffle and
writes it.  A shard is a folder of shuffled buckets; its rows are numbered
through all of them.

The shard is the one whose seeded hash with the row's id is the largest
(rendezvous hashing), so id and shard count decide, and one more shard takes
rows only into itself.  Within its shard a row goes to a bucket by a hash over
its place in the input, so even one id that holds a third of all rows fills
buckets evenly.  The number of buckets per shard follows the bytes it gets, and
the number of tasks that of the buckets: however much there is, a task gets the
same few buckets and holds one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.session import new_folder

TASK_BUCKETS = 2  # buckets a task shuffles, one after the other


def shard_of(id_col: Column, shards: int, seed: int) -> Column:
    """Shard of an id by rendezvous hashing; all null ids go to one shard."""
    drawn = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(F.xxhash64(F.lit(seed), s, id_col).alias("draw"), s.alias("shard")),
    )
    return F.array_max(drawn)["shard"]


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8 for the id."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _shuffler(seed: int):
    """Shuffle bucket after bucket; rows come sorted by shard, bucket and their places in the input."""

    def shuffled(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        shard, bucket = rows.column("shard")[0].as_py(), rows.column("bucket")[0].as_py()
        order = np.arange(rows.num_rows)
        np.random.default_rng([seed, shard, bucket]).shuffle(order)  # Fisher-Yates
        pos = np.arange(rows.num_rows)
        for at in range(0, len(order), 1024):  # few rows at a time, so that a column of texts stays small
            some = rows.take(pa.array(order[at : at + 1024])).drop_columns(["place"]).combine_chunks()
            yield from some.append_column("pos", pa.array(pos[at : at + 1024], pa.int64())).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            shards, buckets = b.column("shard").to_numpy(), b.column("bucket").to_numpy()
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(buckets) != 0)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if at == to:
                    continue
                own = (shards[at], buckets[at])
                if held and own != key:
                    yield from shuffled(held)
                    held = []
                key = own
                held.append(b.slice(at, to - at))
        if held:
            yield from shuffled(held)

    return run


def write_shards(
    docs: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
    bucket_bytes: int = 16 << 20, folder: str | None = None,
) -> str:
    """Write ``docs`` as ``shards`` shuffled shards; returns the folder.

    Layout: ``shard=<n>/`` with columns row (all columns of ``docs`` as one
    struct, so no name can clash), bucket, pos.  Nulls in any column are kept;
    repeated rows are written as often as they occur; a row larger than a
    bucket has its bucket nearly alone; an empty table gives an empty folder.
    ``docs`` should be a table: rows are told apart by their place in it.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "shards")
    shard = shard_of(F.col(id_col), shards, seed)
    sized = docs.select(shard.alias("shard"), record_bytes(F.col(text_col)).alias("size"))
    need = {r["shard"]: r["bytes"] for r in sized.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    counts = [-(-need.get(s, 0) // bucket_bytes) or 1 for s in range(shards)]
    buckets = F.array(*[F.lit(n) for n in counts])
    starts = F.array(*[F.lit(sum(counts[:s])) for s in range(shards)])
    tasks = -(-sum(counts) // TASK_BUCKETS)  # the buckets, numbered through all shards, go to tasks in turn
    place = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), shard.alias("shard"),
        F.monotonically_increasing_id().alias("place"),
    )
    scattered = place.withColumn(
        "bucket",
        F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.element_at(buckets, F.col("shard") + 1)).cast("int"),
    )
    schema = T.StructType([f for f in scattered.schema if f.name != "place"] + [T.StructField("pos", T.LongType())])
    number = F.element_at(starts, F.col("shard") + 1) + F.col("bucket")
    dealt = scattered.repartitionById(tasks, (number % tasks).cast("int")).sortWithinPartitions("shard", "bucket", "place")
    shuffled = dealt.mapInArrow(_shuffler(seed), schema)
    (
        shuffled.sortWithinPartitions("shard", "bucket", "pos")
        .write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    )
    return folder


def read_shards(docs: DataFrame, folder: str) -> DataFrame:
    """Rows of the shards: row, shard, slot (gapless from 0 in each shard, in file order)."""
    schema = T.StructType([
        T.StructField("row", docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).schema["row"].dataType),
        T.StructField("bucket", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("shard", T.IntegerType()),
    ])
    rows = docs.sparkSession.read.schema(schema).parquet(folder)
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, ["shard", "bucket"]).select("row", "shard", (F.col("start") + F.col("pos")).alias("slot"))
