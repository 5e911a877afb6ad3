"""Reading and writing the engine's tables, pages and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import schemas
from postloom.sources.frontier import DEFAULT_SETTINGS

TABLES = {
    "users": schemas.USERS,
    "criteria": schemas.CRITERIA,
    "jobs": schemas.JOBS,
    "matched_jobs": schemas.MATCHES,
}


def src_html_files(spark: SparkSession, folder: str) -> DataFrame:
    """Saved pages, one row per file: url (the file's path) and html."""
    pages = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    return pages.select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a small scan over all cores; a scan with splits enough stays as it is.

    For scans only: counting the splits of anything else would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def src_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, ready for the per-page extractors."""
    return spread(spark.read.parquet(path))


def sink_html(pages: DataFrame, folder: str) -> None:
    """Land raw pages for later extraction."""
    pages.write.mode("append").parquet(folder)


def src_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables below one folder; a table without files yet is empty."""
    empty = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    out = {}
    for name, frame in empty.items():
        found = spark.read.option("pathGlobFilter", "*.parquet")
        try:
            out[name] = found.schema(frame.schema).parquet(f"{folder}/{name}")
        except Exception as error:  # the reader raises when the folder is missing
            if "PATH_NOT_FOUND" not in str(error):
                raise
            out[name] = frame
    return out


def src_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table read in ``parts`` key ranges; needs a driver on the classpath."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def sink_append(rows: DataFrame, folder: str) -> None:
    """Append a batch, laid out by board.

    Rows of a large board stay spread over the tasks that hold them, so a
    board with a third of all rows is written by many tasks, not one.
    """
    rows.write.mode("append").partitionBy("job_board").parquet(folder)


def write_version(table: DataFrame, folder: str, version: int) -> str:
    """Write a whole table as a new version; a repeated write replaces itself."""
    path = f"{folder}/version={version}"
    table.write.mode("overwrite").parquet(path)
    return path


def read_version(spark: SparkSession, folder: str, version: int, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/version={version}")


def src_settings(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One settings row from a JSON file; without a file, the defaults.

    Columns: ``global`` (struct) and ``scrapers`` (map name -> settings).
    """
    if path is not None:
        try:
            return spark.read.option("multiLine", True).schema(schemas.SETTINGS).json(path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    shared = F.struct(
        F.array(*[F.lit(k) for k in DEFAULT_SETTINGS["keywords"]]).alias("keywords"),
        F.lit(DEFAULT_SETTINGS["location"]).alias("location"),
        F.lit(DEFAULT_SETTINGS["max_pages"]).alias("max_pages"),
        F.lit(True).alias("parallel"), F.lit(3).alias("max_workers"),
        F.lit(None).cast("array<double>").alias("delay_range"),
    )
    on = F.try_parse_json(F.lit('{"enabled":true}')).cast("map<string,variant>")
    sources = F.create_map(*[x for name in ("doda", "green", "indeed") for x in (F.lit(name), on)])
    return spark.range(1).select(shared.alias("global"), sources.alias("scrapers"))


def seed_rows(spark: SparkSession, as_of: str) -> dict[str, DataFrame]:
    """The four tables with one sample user, criteria row, posting and match."""
    at = F.lit(as_of).cast("timestamp_ntz")

    def table(_table: str, **values) -> DataFrame:
        fields = spark.createDataFrame([], TABLES[_table]).schema.fields
        return spark.range(1).select(*[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
        ])

    lit = F.lit
    return {
        "users": table("users", id=lit(1), name=lit("Aoi Example"), email=lit("aoi@example.org"),
                       access_token=lit("sample-token"), created_at=at),
        "criteria": table(
            "criteria", id=lit(1), user_id=lit(1),
            keywords=F.array(*map(lit, ["spark", "data pipeline", "sql"])),
            locations=F.array(*map(lit, ["Osaka", "Sapporo"])),
            min_salary=lit(5_500_000), max_salary=lit(8_000_000), remote_preference=lit(False),
            created_at=at, updated_at=at),
        "jobs": table(
            "jobs", id=lit(1), title=lit("Data Pipeline Engineer"), company=lit("Umbrella Weather KK"),
            description=lit("Builds Spark jobs for rain forecasts."),
            salary_text=lit("年収600万円～750万円"), location=lit("Osaka"),
            url=lit("https://jobs.example.org/rain/7"), job_board=lit("green"),
            scraped_at=at, updated_at=at, is_active=lit(True)),
        "matched_jobs": table("matched_jobs", id=lit(1), user_id=lit(1), job_id=lit(1),
                              match_score=lit(0.6), matched_at=at),
    }
