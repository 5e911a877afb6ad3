"""How well one posting fits one user's criteria, as Column expressions.

Texts and criteria are normalised once per row (``prepare_jobs``,
``prepare_criteria``) before any pairing, never once per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.criteria import json_list_coerce
from postloom.functions.text import norm_match

# Points for title keywords, description keywords, place, salary.
TITLE_POINTS, DESCRIPTION_POINTS, LOCATION_POINTS, SALARY_POINTS = 40, 30, 15, 15


def _items(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def prepare_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.withColumns({
        "title_n": norm_match(F.col("title")),
        "description_n": norm_match(F.col("description")),
        "location_n": norm_match(F.col("location")),
    })


def latest_criteria(criteria: DataFrame) -> DataFrame:
    """Newest criteria row per user, the higher id on a tie.

    An aggregate rather than a window: it combines on the map side, so a user
    with a very long history is not collected into one task.
    """
    row = F.max_by(F.struct(*criteria.columns), F.struct("updated_at", "id"))
    return criteria.groupBy(F.col("user_id").alias("_user")).agg(row.alias("r")).select("r.*")


def stored_criteria(criteria: DataFrame) -> DataFrame:
    """Criteria rows whose lists are stored as JSON text (keywords_json, locations_json), with the lists read.

    A bare string counts as a list of one, anything else that is no list as none.
    """
    return criteria.withColumns({
        "keywords": json_list_coerce(F.col("keywords_json")), "locations": json_list_coerce(F.col("locations_json")),
    }).drop("keywords_json", "locations_json")


def prepare_criteria(criteria: DataFrame) -> DataFrame:
    """Add the normalised lists; blank keywords stay, as they count in the ratio."""
    return criteria.withColumns({
        "keywords_n": F.transform(_items(F.col("keywords")), norm_match),
        "locations_n": F.transform(_items(F.col("locations")), norm_match),
    })


def kw_hits(text_n: Column, keywords: Column) -> Column:
    """Keywords found in the text, in their stored spelling, duplicates kept."""
    def hit(k):
        n = norm_match(k)
        return (n != "") & F.contains(text_n, n)

    return F.filter(_items(keywords), hit)


def loc_hit(location_n: Column, locations: Column) -> Column:
    """First wanted place contained in the posting's place, or null."""
    def hit(x):
        n = norm_match(x)
        return (n != "") & F.contains(location_n, n)

    return F.get(F.filter(_items(locations), hit), 0)


def salary_overlap(job_min: Column, job_max: Column, user_min: Column, user_max: Column) -> Column:
    """Do the two salary ranges touch?  A bound of 0 counts as missing.

    A posting whose only bound is 0 overlaps nothing.
    """
    low = F.coalesce(F.nullif(job_min, F.lit(0)), job_max)
    high = F.coalesce(F.nullif(job_max, F.lit(0)), job_min)
    want_low, want_high = F.coalesce(user_min, F.lit(0)), F.nullif(user_max, F.lit(0))
    touches = low.isNotNull() & (want_high.isNull() | (low <= want_high)) & (high >= want_low)
    return (
        F.when(job_min.isNull() & job_max.isNull(), False)
        .when(user_min.isNull() & user_max.isNull(), True)
        .otherwise(F.coalesce(touches, F.lit(False)))
    )


def points(part: Column, whole: Column, weight: int) -> Column:
    """Share of ``weight``, cut to whole points; 0 when there is no whole."""
    return F.when(whole > 0, (part / whole * weight).cast("int")).otherwise(0)


def keyword_points(n: Column, title: Column, described: Column, only_described: Column) -> tuple[Column, Column]:
    """Title and description points from hit counts.

    With every keyword in the title, any description hit earns full points.
    """
    rest = n - title
    bonus = F.when((n > 0) & (described > 0), DESCRIPTION_POINTS).otherwise(0)
    return (
        points(title, n, TITLE_POINTS),
        F.when(rest > 0, points(only_described, rest, DESCRIPTION_POINTS)).otherwise(bonus),
    )


def match_score(pairs: DataFrame) -> DataFrame:
    """Add ``score`` (0-100) and ``details`` to rows holding a prepared job and its criteria."""
    c = F.col
    found = pairs.withColumns({
        "_t": kw_hits(c("title_n"), c("keywords")),
        "_d": kw_hits(c("description_n"), c("keywords")),
        "_place": loc_hit(c("location_n"), c("locations")),
        "_pay": salary_overlap(
            c("salary_annual_min"), c("salary_annual_max"), c("min_salary"), c("max_salary")
        ),
    }).withColumn("_u", F.filter("_d", lambda k: ~F.array_contains(c("_t"), k)))
    title, described = keyword_points(F.size(_items(c("keywords"))), F.size("_t"), F.size("_d"), F.size("_u"))
    place = F.when(c("_place").isNotNull(), LOCATION_POINTS).otherwise(0)
    pay = F.when(c("_pay"), SALARY_POINTS).otherwise(0)
    details = F.struct(
        c("_t").alias("title_keywords_matched"),
        c("_u").alias("description_keywords_matched"),
        c("_place").isNotNull().alias("location_matched"),
        c("_place").alias("location_value"),
        c("_pay").alias("salary_in_range"),
        F.struct(c("salary_annual_min").alias("min"), c("salary_annual_max").alias("max")).alias("salary_value"),
        F.struct(
            title.alias("title"), described.alias("description"),
            place.alias("location"), pay.alias("salary"),
        ).alias("scores"),
    )
    return (
        found.withColumn("details", details)
        .withColumn("score", title + described + place + pay)
        .drop("_t", "_d", "_u", "_place", "_pay")
    )
