"""Exact de-duplication: a tree merge of sorted digest runs.

Every input partition becomes a run: one row per digest with its best id and
its number of rows.  Runs lie bucketed by digest and sorted within the buckets,
so the same bucket of all runs is in one file and runs merge there: after the
runs are laid out, no row moves between tasks again.  In each round ``fan``
neighbouring runs merge into one; of equal digests the best id stays, so a hot
text never brings more than ``fan`` rows together, however many copies it has.
Rows only merge when digest, byte length and a second hash agree.  The verdicts
on texts that occur more than once then go back to the rows, those of hot texts
by broadcast.

Only DataFrame functions are used.  Each level is written to the shared folder,
so a lost executor costs a re-read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import attach, lower_ascii, or_empty, tagged
from postloom.session import new_folder, written

KEY = ["digest", "size", "proof"]
BUCKET_ROWS = 1 << 21


def _best(keep: str, value: Column) -> Column:
    return F.min(value) if keep == "smallest" else F.max(value)


def _laid(level: DataFrame, buckets: int) -> str:
    """Name of the table, over files in the shared folder, that holds a level's runs by bucket."""
    name = f"digest_run_{uuid.uuid4().hex}"
    path = new_folder(level.sparkSession, "digest-run")
    level.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
    return name


def _merged(level: DataFrame, fan: int, keep: str) -> DataFrame:
    """Every ``fan`` neighbouring runs as one; bucket by bucket, without an exchange."""
    return (
        level.withColumn("run", F.floor(F.col("run") / fan).cast("int"))
        .groupBy(*KEY, "run").agg(_best(keep, F.col("best")).alias("best"), F.sum("n").alias("n"))
    )


def _verdicts(rows: DataFrame, order: Column, keep: str, fan: int) -> DataFrame:
    """Per digest of more than one row its best row and their number."""
    spark = rows.sparkSession
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.max("run").alias("last")).first()
    setting = lambda name: int(spark.conf.get(f"spark.sql.{name}"))
    buckets = min(max(setting("shuffle.partitions"), -(-known["n"] // BUCKET_ROWS)), setting("sources.bucketing.maxBuckets"))
    runs = (known["last"] or 0) + 1
    first = rows.groupBy(*KEY, "run").agg(_best(keep, order).alias("best"), F.count(F.lit(1)).alias("n"))
    name = _laid(first.repartition(buckets, *KEY), buckets)
    try:
        while runs > 1:
            below, name = name, _laid(_merged(spark.table(name), fan, keep), buckets)
            spark.sql(f"DROP TABLE {below}")
            runs = -(-runs // fan)
        return written(spark.table(name).where("n > 1").select(*KEY, "best", "n"), "verdicts")
    finally:
        spark.sql(f"DROP TABLE {name}")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise=lower_ascii, fan: int = 16,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest (sha256, binary).

    Texts are equal when ``normalise`` makes them identical; null counts as
    empty.  ``keep`` is "smallest" or "largest".  A null id is kept only when
    no row of its group has an id.  Of repeated rows (same id and text) one is
    kept.  An empty table gives no rows; other columns are not looked at.
    """
    text = normalise(or_empty(F.col(text_col)))
    rows = written(
        docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
            "id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").alias("size"),
            F.xxhash64("t").alias("proof"), F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    if keep == "smallest":
        order = F.struct(F.col("id").isNull().alias("none"), "id", F.col("row").alias("row"))
    else:
        order = F.struct(F.col("id").isNotNull().alias("some"), "id", (-F.col("row")).alias("row"))
    judged = attach(rows, _verdicts(rows, order, keep, fan), KEY, "n")
    number = F.abs(F.col("best.row"))
    return judged.select(
        "id",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(number == F.col("row"), F.lit(True)).alias("kept"),
        "digest",
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise=lower_ascii, fan: int = 16,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Among rows alike in id and text, which cannot be told apart by id, the one
    with the smallest hash over all columns stays.
    """
    kept = exact_duplicates(docs, id_col, text_col, keep, normalise, fan).where("kept")
    key = F.concat_ws("/", tagged(F.col("id")), F.hex("digest"))
    digest = F.unhex(F.sha2(normalise(or_empty(F.col(text_col))), 256))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), digest.alias("digest"))
    rows = packed.select("row", key.alias("key")).join(kept.select(key.alias("key")), "key", "left_semi")
    one = rows.groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*")
