"""Expiry, integrity reports, deletes and schema steps."""

from __future__ import annotations

import secrets

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STALE_DAYS = 7


def is_stale(last_seen_type, as_of, days: int = STALE_DAYS, board: str | None = None) -> Column:
    cutoff = F.lit(as_of).cast(last_seen_type) - F.make_dt_interval(F.lit(days))
    stale = F.col("is_active") & (F.col("last_seen_at") < cutoff)
    if board:
        stale = stale & (F.col("job_board") == board)
    return F.coalesce(stale, F.lit(False))


def expire_stale(jobs: DataFrame, as_of, days: int = STALE_DAYS, board: str | None = None) -> DataFrame:
    """Deactivate postings not seen for ``days``; one never stamped stays.

    ``expired`` marks the rows changed, its sum is the number of them; where
    there is an ``updated_at`` these rows get ``as_of``.
    """
    stale = is_stale(jobs.schema["last_seen_at"].dataType, as_of, days, board)
    after = jobs.withColumn("expired", stale).withColumn("is_active", F.col("is_active") & ~F.col("expired"))
    return touched(after, "expired", as_of)


def touched(rows: DataFrame, changed: str, as_of) -> DataFrame:
    """Stamp ``updated_at``, if there is one, of the rows marked by ``changed``."""
    if as_of is None or "updated_at" not in rows.columns:
        return rows
    now = F.lit(as_of).cast(rows.schema["updated_at"].dataType)
    return rows.withColumn("updated_at", F.when(F.col(changed), now).otherwise(F.col("updated_at")))


def check_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once; null keys are free to repeat."""
    return (
        rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("found")).where("found > 1")
    )


def check_fk(children: DataFrame, key: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose key has no parent."""
    known = parents.select(F.col(parent_key).alias("_parent"))
    return children.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_parent"), "left_anti")


def check_not_null(rows: DataFrame, names: list[str]) -> DataFrame:
    """Number of nulls per column that must not have any."""
    counts = rows.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names])
    return counts.unpivot([], names, "name", "nulls")


def cascade_delete(children: DataFrame, key: str, deleted: DataFrame, deleted_key: str = "id") -> DataFrame:
    """Child rows left when the parents in ``deleted`` go."""
    gone = deleted.select(F.col(deleted_key).alias("_gone"))
    return children.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def migrate_updated_at(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("updated_at", F.col("scraped_at"))


def migrate_jobs_v2(jobs: DataFrame) -> DataFrame:
    """Replace ``salary`` by text and annual bounds; the old text is not carried over."""
    return jobs.withColumns({
        "salary_text": F.lit(None).cast("string"),
        "salary_annual_min": F.lit(None).cast("bigint"),
        "salary_annual_max": F.lit(None).cast("bigint"),
    }).drop("salary")


def migrate_last_seen(jobs: DataFrame) -> DataFrame:
    """Add fingerprint, sighting and activity; sightings start at the scrape time."""
    have = set(jobs.columns)
    seen = F.coalesce("last_seen_at", "scraped_at") if "last_seen_at" in have else F.col("scraped_at")
    columns = {"last_seen_at": seen}
    if "fingerprint" not in have:
        columns["fingerprint"] = F.lit(None).cast("string")
    columns["is_active"] = F.coalesce(F.col("is_active"), F.lit(True)) if "is_active" in have else F.lit(True)
    return jobs.withColumns(columns)


def random_token() -> Column:
    """43 url-safe characters from 32 bytes of the system's cryptographic source.

    Every evaluation draws anew: write the table before it is read twice.
    """
    draw = F.pandas_udf(lambda rows: pd.Series([secrets.token_urlsafe(32) for _ in rows]), T.StringType())
    return draw.asNondeterministic()(F.monotonically_increasing_id())


def stable_token(key: Column, salt: str) -> Column:
    """Token derived from a key and a secret, for repeatable runs."""
    return F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)


def migrate_tokens(users: DataFrame, salt: str | None = None) -> DataFrame:
    """Give every user without an access token one."""
    fresh = random_token() if salt is None else stable_token(F.col("id"), salt)
    return users.withColumn("access_token", F.coalesce("access_token", fresh))


def migrate_down(table: DataFrame, step: str) -> DataFrame:
    """Undo one schema step."""
    if step == "tokens":
        return table.drop("access_token")
    if step == "last_seen":
        return table.drop("is_active", "last_seen_at", "fingerprint")
    if step == "jobs_v2":
        return table.withColumn("salary", F.lit(None).cast("string")).drop(
            "salary_annual_max", "salary_annual_min", "salary_text")
    if step == "updated_at":
        return table.drop("updated_at")
    raise ValueError(f"unknown step {step!r}")
