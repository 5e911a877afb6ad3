"""Filtered, sorted and paged listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.labels import iso_ts, score_percent

TOP_MATCHES = 20
PER_PAGE, MIN_PER_PAGE, MAX_PER_PAGE = 20, 5, 100


def f_board(jobs: DataFrame, board: str | None) -> DataFrame:
    return jobs.where(F.col("job_board") == board) if board else jobs


def _like(c: Column, text: str) -> Column:
    """Case-insensitive containment; % and _ in the text stay wildcards, a backslash is itself."""
    return F.ilike(c, F.lit("%" + text.replace("\\", "\\\\") + "%"))


def f_location(jobs: DataFrame, text: str | None) -> DataFrame:
    return jobs.where(_like(F.col("location"), text)) if text else jobs


def f_search(jobs: DataFrame, text: str | None) -> DataFrame:
    return jobs.where(_like(F.col("title"), text) | _like(F.col("company"), text)) if text else jobs


def f_active(jobs: DataFrame, active: str | None) -> DataFrame:
    if active not in ("true", "false"):
        return jobs
    return jobs.where(F.col("is_active") == (active == "true"))


def f_min_score(matches: DataFrame, percent: float | None) -> DataFrame:
    """Stored scores run from 0 to 1, the form asks for percent."""
    return matches if percent is None else matches.where(F.col("match_score") >= F.lit(percent) / 100)


def f_match_user(matches: DataFrame, user_id: int) -> DataFrame:
    return matches.where(F.col("user_id") == user_id)


def j_match_job(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Matches with their posting."""
    return matches.drop("id").join(jobs.withColumnRenamed("id", "job_id"), "job_id")


def _match_columns() -> list[Column]:
    return [
        *[F.col(c) for c in (
            "job_id", "title", "company", "location", "salary_text", "salary_annual_min",
            "salary_annual_max", "url", "job_board")],
        score_percent(F.col("match_score")).alias("match_score"), iso_ts(F.col("matched_at")).alias("matched_at"),
    ]


def topk_matches(matches: DataFrame, jobs: DataFrame, user_id: int, limit: int = TOP_MATCHES) -> DataFrame:
    """A user's best matches, best first."""
    joined = j_match_job(f_match_user(matches, user_id), jobs)
    return joined.orderBy(F.desc("match_score"), "job_id").limit(limit).select(*_match_columns())


def topk_matches_all_users(matches: DataFrame, jobs: DataFrame, limit: int = TOP_MATCHES) -> DataFrame:
    """Best matches of every user; ranks are cut in each task before the shuffle."""
    best = Window.partitionBy("user_id").orderBy(F.desc("match_score"), "job_id")
    stored = matches.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    kept = stored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return j_match_job(kept, jobs).select("user_id", "rank", *_match_columns())


def sort_matches(rows: DataFrame, sort: str = "score") -> DataFrame:
    """By score, by date, by company; any other word leaves the order open."""
    orders = {
        "score": [F.desc("match_score"), F.col("job_id")],
        "date": [F.desc("scraped_at"), F.col("job_id")],
        "company": [F.col("company"), F.col("job_id")],
    }
    return rows.orderBy(*orders[sort]) if sort in orders else rows


def match_view(matches: DataFrame, jobs: DataFrame, user_id: int, min_score: float | None = None,
               board: str | None = None, sort: str = "score") -> DataFrame:
    """A user's matches among active postings, filtered and sorted."""
    rows = j_match_job(f_match_user(f_min_score(matches, min_score), user_id), f_board(f_active(jobs, "true"), board))
    return sort_matches(rows, sort)


def page_jobs(jobs: DataFrame, page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """One page, newest first."""
    if page < 1 or not MIN_PER_PAGE <= per_page <= MAX_PER_PAGE:
        raise ValueError(f"page must be positive, per_page {MIN_PER_PAGE} to {MAX_PER_PAGE}")
    return jobs.orderBy(F.desc("scraped_at"), "id").offset((page - 1) * per_page).limit(per_page)


def page_after(jobs: DataFrame, scraped_at, job_id: int, per_page: int = PER_PAGE) -> DataFrame:
    """The page behind a given row: deep pages without skipping over all before."""
    at = F.lit(scraped_at).cast(jobs.schema["scraped_at"].dataType)
    later = (F.col("scraped_at") < at) | ((F.col("scraped_at") == at) & (F.col("id") > job_id))
    return jobs.where(later).orderBy(F.desc("scraped_at"), "id").limit(per_page)


def page_info(jobs: DataFrame, page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """Totals of a paged listing and the range one page shows."""
    total = F.count(F.lit(1))
    return jobs.agg(
        F.lit(page).alias("page"), F.lit(per_page).alias("per_page"), total.alias("total"),
        F.floor((total + per_page - 1) / per_page).alias("total_pages"),
        F.lit((page - 1) * per_page + 1).alias("first_row"),
        F.least(F.lit(page * per_page).cast("bigint"), total).alias("last_row"),
    )


def distinct_boards(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_board").distinct()


def jobs_browse(jobs: DataFrame, page: int = 1, per_page: int = PER_PAGE, board: str | None = None,
                location: str | None = None, active: str | None = None,
                search: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, totals) of a filtered listing."""
    rows = f_search(f_active(f_location(f_board(jobs, board), location), active), search)
    return page_jobs(rows, page, per_page), page_info(rows, page, per_page)
