"""The postings table as loads leave it: buckets of consecutive ids, and a log of recent loads.

    buckets/bucket=<n>/   postings with id // bucket_rows = n
    new/load=<n>/         postings that load n added
    seen/load=<n>/        ids of stored postings that load n saw again, and when
    staged/load=<n>/      the buckets that folding up to load n is about to replace
    steps/                one small row per step done

A load appends to the log only.  Folding rewrites the buckets that its loads
touch and no others, by dynamic partition overwrite; new ids fill the last
buckets.  So what is written follows the batches, not the table.

Any step may be repeated.  A load's log is replaced by its own repetition.  A
fold first stages what the buckets will hold; once that is noted, a repetition
starts from there, as the buckets may be half replaced.  Until the fold is
noted, readers leave out bucket rows above the highest id noted before and take
these from the log; sightings may be applied twice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_ROWS = 100_000
SEEN = T.StructType([T.StructField("id", T.LongType()), T.StructField("last_seen_at", T.TimestampNTZType())])
STEP = "load bigint, step string, top bigint, bucket_rows bigint"


class Folded(NamedTuple):
    load: int  # loads up to this one are in the buckets
    top: int  # the highest id among them
    bucket_rows: int


def _note(spark: SparkSession, folder: str, load: int, step: str, top: int, bucket_rows: int) -> None:
    spark.createDataFrame([(load, step, top, bucket_rows)], STEP).write.mode("append").parquet(f"{folder}/steps")


def folded(spark: SparkSession, folder: str) -> Folded:
    steps = spark.read.schema(STEP).parquet(f"{folder}/steps").where("step = 'folded'")
    return Folded(*steps.agg(F.max(F.struct("load", "top", "bucket_rows")).alias("s")).first()["s"])


def bucket(id_col: Column, bucket_rows: int) -> Column:
    return F.floor(id_col / bucket_rows).cast("int")


def create_store(jobs: DataFrame, folder: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """Lay a postings table out in buckets, as the state before load 0."""
    spark = jobs.sparkSession
    rows = jobs.withColumn("bucket", bucket(F.col("id"), bucket_rows))
    rows.repartition("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/buckets")
    jobs.limit(0).write.parquet(f"{folder}/new/load=-1")
    spark.createDataFrame([], SEEN).write.parquet(f"{folder}/seen/load=-1")
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/buckets")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    _note(spark, folder, -1, "folded", top, bucket_rows)


def _buckets(spark: SparkSession, folder: str, schema: T.StructType, done: Folded) -> DataFrame:
    rows = spark.read.schema(_with(schema, "bucket", T.IntegerType())).parquet(f"{folder}/buckets")
    return rows.where(F.col("id") <= done.top)


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def _log(spark: SparkSession, folder: str, part: str, schema: T.StructType, after: int, upto: int) -> DataFrame:
    """Rows that loads ``after`` < n <= ``upto`` left in one part of the log; other loads' files are not read."""
    rows = spark.read.schema(_with(schema, "load", T.LongType())).parquet(f"{folder}/{part}")
    return rows.where((F.col("load") > after) & (F.col("load") <= upto)).drop("load")


def sighted(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Postings after sightings (id, last_seen_at): seen ones are active, stamped with the latest."""
    latest = seen.groupBy("id").agg(F.max("last_seen_at").alias("_at"))
    hit = F.col("_at").isNotNull()
    return rows.join(latest, "id", "left").withColumns({
        "last_seen_at": F.coalesce("_at", "last_seen_at"), "updated_at": F.coalesce("_at", "updated_at"),
        "is_active": hit | F.col("is_active"),
    }).drop("_at")


def _sighted_in_buckets(rows: DataFrame, seen: DataFrame, bucket_rows: int) -> DataFrame:
    """``sighted`` with the bucket of each row; rows and sightings meet in the exchange by bucket, the only one."""
    at = bucket(F.col("id"), bucket_rows)
    sightings = seen.select("id", F.col("last_seen_at").alias("_at"), F.lit(True).alias("_sighting"))
    both = rows.withColumn("_sighting", F.lit(False)).unionByName(sightings, allowMissingColumns=True)
    both = both.withColumn("bucket", at).repartition("bucket")
    latest = both.withColumn("_at", F.max("_at").over(Window.partitionBy("bucket", "id"))).where("NOT _sighting")
    hit = F.col("_at").isNotNull()
    return latest.withColumns({
        "last_seen_at": F.coalesce("_at", "last_seen_at"), "updated_at": F.coalesce("_at", "updated_at"),
        "is_active": hit | F.col("is_active"),
    }).drop("_at", "_sighting")


def stored_keys(spark: SparkSession, folder: str, schema: T.StructType, before: int) -> tuple[DataFrame, int]:
    """(id, url and fingerprint of all postings that loads below ``before`` left; the highest id)."""
    done = folded(spark, folder)
    names = ["id", "url", "fingerprint"]
    new = _log(spark, folder, "new", schema, done.load, before - 1)
    top = new.agg(F.coalesce(F.max("id"), F.lit(done.top)).alias("m")).first()["m"]
    return _buckets(spark, folder, schema, done).select(*names).unionByName(new.select(*names)), top


def read_store(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All postings after every load so far."""
    done = folded(spark, folder)
    last = 2**62
    new = _log(spark, folder, "new", schema, done.load, last)
    seen = _log(spark, folder, "seen", SEEN, done.load, last)
    rows = _buckets(spark, folder, schema, done).drop("bucket").unionByName(new)
    return sighted(rows, seen).select(*schema.names)


def append_load(folder: str, load: int, new: DataFrame, seen: DataFrame) -> None:
    new.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/new/load={load}")
    seen.select("id", "last_seen_at").write.mode("overwrite").parquet(f"{folder}/seen/load={load}")


def fold(spark: SparkSession, folder: str, schema: T.StructType, upto: int) -> None:
    """Bring the log up to load ``upto`` into the buckets; only buckets it touches are read and rewritten."""
    done = folded(spark, folder)
    if done.load >= upto:
        return
    steps = spark.read.schema(STEP).parquet(f"{folder}/steps")
    new = _log(spark, folder, "new", schema, done.load, upto)
    top = new.agg(F.coalesce(F.max("id"), F.lit(done.top)).alias("m")).first()["m"]
    path = f"{folder}/staged/load={upto}"
    with_bucket = _with(schema, "bucket", T.IntegerType())
    if steps.where((F.col("step") == "staged") & (F.col("load") == upto)).isEmpty():
        seen = _log(spark, folder, "seen", SEEN, done.load, upto)
        at = bucket(F.col("id"), done.bucket_rows).alias("bucket")
        # at most one number per bucket folder
        touched = sorted(r["bucket"] for r in new.select(at).union(seen.select(at)).distinct().collect())
        old = _buckets(spark, folder, schema, done).where(F.col("bucket").isin(touched)).drop("bucket")
        rows = _sighted_in_buckets(old.unionByName(new), seen, done.bucket_rows).select(*schema.names, "bucket")
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        _note(spark, folder, upto, "staged", top, done.bucket_rows)
    staged = spark.read.schema(with_bucket).parquet(path)
    (
        # a staged file holds whole buckets already
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/buckets")
    )
    _note(spark, folder, upto, "folded", top, done.bucket_rows)
