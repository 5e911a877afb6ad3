"""Counts over postings, users, matches and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_WIDTH = 45


def agg_totals(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_active")).alias("active"),
        F.count_if(~F.col("is_active")).alias("inactive"),
    )


def agg_board_status(jobs: DataFrame) -> DataFrame:
    """Active and inactive postings per board, by board."""
    return jobs.groupBy("job_board").agg(
        F.count_if(F.col("is_active")).alias("active"), F.count_if(~F.col("is_active")).alias("inactive"),
    ).orderBy("job_board")


def agg_by_board(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("job_board").agg(F.count(F.lit(1)).alias("found"))


def agg_board_number(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_distinct("job_board").alias("boards"))


def board_map(jobs: DataFrame) -> DataFrame:
    """All board counts as one map; collected after counting, one entry per board."""
    entries = F.array_sort(F.collect_list(F.struct("job_board", "found")))
    return agg_by_board(jobs).agg(F.map_from_entries(entries).alias("by_board"))


def agg_api_stats(jobs: DataFrame, users: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of totals with the board counts."""
    count = F.count(F.lit(1)).alias("n")
    return agg_totals(jobs).select(
        F.col("total").alias("total_jobs"), F.col("active").alias("active_jobs"),
        users.agg(count).scalar().alias("total_users"), matches.agg(count).scalar().alias("total_matches"),
        board_map(jobs).scalar().alias("by_board"),
    )


def agg_run_totals(runs: DataFrame) -> DataFrame:
    """Sums over all sources, and how many runs succeeded."""
    return runs.agg(
        *[F.sum(c).alias(c) for c in ("jobs_scraped", "jobs_added", "duplicates", "errors")],
        F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"),
    )


def agg_run_rollup(runs: DataFrame) -> DataFrame:
    """Sums per source and, with a null name, over all."""
    return runs.rollup("name").agg(
        *[F.sum(c).alias(c) for c in ("jobs_scraped", "jobs_added", "duplicates", "errors")])


def one_decimal(c: Column) -> Column:
    """A number that is not negative with one decimal, rounded by its exact binary value, a tie to the even digit."""
    a, b = c * 8, c * 2  # both exact; what their sum loses decides where it looks like a tie
    tenths = a + b
    second = tenths - a
    lost = (a - (tenths - second)) + (b - second)
    low = F.floor(tenths)
    whole = (
        F.when((tenths - low != 0.5) | (lost == 0), F.rint(tenths).cast("bigint"))
        .when(lost > 0, low + 1).otherwise(low)
    )
    return F.concat(F.floor(whole / 10).cast("string"), F.lit("."), (whole % 10).cast("string"))


def agg_run_report(runs: DataFrame) -> DataFrame:
    """Report lines by source; long error messages are cut for display."""
    return runs.orderBy("name", "duration_seconds", "jobs_scraped").select(
        "name", F.when(F.col("success"), "✓").otherwise("✗").alias("status"),
        "jobs_scraped", "jobs_added", "duplicates",
        F.concat(one_decimal(F.col("duration_seconds")), F.lit("s")).alias("time"),
        F.concat(F.left("error_message", F.lit(ERROR_WIDTH)), F.lit("...")).alias("error"),
    )


def agg_user_child_counts(users: DataFrame, criteria: DataFrame, matches: DataFrame) -> DataFrame:
    """Criteria rows and matches of every user."""
    def counts(rows: DataFrame, out: str) -> DataFrame:
        return rows.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias(out))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        users.select("id").join(counts(criteria, "criteria_count"), "id", "left")
        .join(counts(matches, "match_count"), "id", "left")
        .select("id", zero("criteria_count"), zero("match_count"))
    )
