"""Session settings, lineage cuts and size checks shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings a cluster job should start with.  Partition sizes follow the data
# through AQE; page batches stay small because one page may hold megabytes.
# State of streams, one row per fingerprint ever seen, is kept off the heap.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.variant.allowDuplicateKeys": "true",  # of a repeated JSON key the last value counts
    "spark.sql.files.maxPartitionBytes": str(128 << 20),
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "postloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only on a local master, where driver and
    executors are one process; on a cluster the setting has to be there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="postloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_made: ContextVar[list[str] | None] = ContextVar("step folders of the innermost block", default=None)


def new_folder(spark: SparkSession, label: str) -> str:
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(folder)
    return folder


@contextmanager
def steps_cleared(spark: SparkSession) -> Iterator[None]:
    """Folders that ``new_folder`` names within the block are deleted at its end.

    For jobs that store their result elsewhere: a DataFrame that reads a step
    cannot be used after the block.  Blocks may be nested, and each clears its own
    folders only.  They go through the file system they lie on, also when the block fails.
    What a stream's batch function writes in its own thread is not cleared.
    """
    made: list[str] = []
    outer = _made.set(made)
    try:
        yield
    finally:
        _made.reset(outer)
        settings = spark._jsparkSession.sessionState().newHadoopConf()
        for folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(settings).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    The copy survives the loss of any executor, costs one pass (a reliable
    RDD checkpoint runs the plan twice) and gives later steps column pruning
    and real file sizes to plan with.
    """
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def within(df: DataFrame, max_rows: int, max_bytes: int, width) -> bool:
    """True when ``df`` has at most max_rows rows and max_bytes of payload.

    ``width`` is a Column with the payload bytes of a row.  The scan stops
    after max_rows + 1 rows, so the check itself is bounded.
    """
    row = (
        df.select(width.cast("long").alias("w")).limit(max_rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("b"))
        .first()
    )
    return row["n"] <= max_rows and row["b"] <= max_bytes
