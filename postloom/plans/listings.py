"""Queries over filters, listings and statistics."""

from pyspark.sql import functions as F

from postloom.operators import browse, scoring, stats, users
from postloom.plans.registry import query

c = F.col
USER = 7
LIST = ("id", "title", "company", "location", "job_board", "scraped_at")
SQL_LIST = ", ".join(LIST)


def _filter(name, sql_where, build):
    query(name, f"SELECT {SQL_LIST} FROM v_jobs WHERE {sql_where}")(lambda v: build(v.v_jobs).select(*LIST))


_filter("f_board", "job_board = '1-URGENT'", lambda j: browse.f_board(j, "1-URGENT"))
_filter("f_location", "location ILIKE '%nation_1%'", lambda j: browse.f_location(j, "nation_1"))
_filter("f_search", "title ILIKE '%Gizmo%' OR company ILIKE '%Gizmo%'", lambda j: browse.f_search(j, "Gizmo"))
_filter("f_active", "NOT is_active", lambda j: browse.f_active(j, "false"))


@query("f_min_score", "SELECT id, user_id, match_score FROM v_matches WHERE match_score >= 60::double / 100")
def _(v):
    return browse.f_min_score(v.v_matches, 60).select("id", "user_id", "match_score")


@query("f_match_user", f"SELECT id, user_id, job_id, match_score FROM v_matches WHERE user_id = {USER}")
def _(v):
    return browse.f_match_user(v.v_matches, USER).select("id", "user_id", "job_id", "match_score")


@query("f_by_token", "SELECT id, name, email FROM v_users WHERE access_token = 'tok-7'")
def _(v):
    return users.f_by_token(v.v_users, "tok-7").select("id", "name", "email")


_MATCH = """job_id, title, company, location, salary_text, salary_annual_min, salary_annual_max, url, job_board,
    cast(trunc(match_score * 100::double) as int) AS match_score, strftime(matched_at, '%Y-%m-%dT%H:%M:%S') AS matched_at"""


@query("j_match_job", """
  SELECT m.user_id, m.job_id, m.match_score, j.title, j.job_board, j.is_active FROM v_matches m JOIN v_jobs j ON j.id = m.job_id""")
def _(v):
    return browse.j_match_job(v.v_matches, v.v_jobs).select(
        "user_id", "job_id", "match_score", "title", "job_board", "is_active")


@query("j_user_criteria", """
  SELECT u.id AS user_id, u.name, c.id AS criteria_id, c.min_salary, c.max_salary, array_to_string(c.keywords, '|') AS keywords
  FROM v_users u JOIN v_latest c ON c.user_id = u.id""")
def _(v):
    return users.j_user_criteria(v.v_users, v.v_criteria).select(
        "user_id", "name", "criteria_id", "min_salary", "max_salary", F.array_join("keywords", "|").alias("keywords"))


@query("win_latest_criteria", """
  SELECT id, user_id, array_to_string(keywords, '|') AS keywords, array_to_string(locations, '|') AS locations, min_salary, max_salary, updated_at FROM v_latest""")
def _(v):
    return scoring.latest_criteria(v.v_criteria).select(
        "id", "user_id", F.array_join("keywords", "|").alias("keywords"),
        F.array_join("locations", "|").alias("locations"), "min_salary", "max_salary", "updated_at")


@query("topk_matches", f"""
  SELECT {_MATCH} FROM (SELECT m.match_score, m.matched_at, j.*, j.id AS job_id FROM v_matches m JOIN v_jobs j ON j.id = m.job_id
    WHERE m.user_id = {USER} ORDER BY m.match_score DESC, j.id LIMIT 5)""")
def _(v):
    return browse.topk_matches(v.v_matches, v.v_jobs, USER, 5)


@query("topk_matches_all_users", f"""
  SELECT user_id, cast(rank as int) AS rank, {_MATCH} FROM (
    SELECT m.user_id, m.match_score, m.matched_at, j.*, j.id AS job_id,
      row_number() OVER (PARTITION BY m.user_id ORDER BY m.match_score DESC, j.id) AS rank
    FROM v_matches m JOIN v_jobs j ON j.id = m.job_id) WHERE rank <= 3""")
def _(v):
    return browse.topk_matches_all_users(v.v_matches, v.v_jobs, 3)


@query("sort_matches", """
  SELECT user_id, job_id, match_score, company, scraped_at FROM v_matches m JOIN (SELECT id AS jid, company, scraped_at FROM v_jobs) ON jid = job_id
  ORDER BY company, job_id""")
def _(v):
    rows = browse.j_match_job(v.v_matches, v.v_jobs)
    return browse.sort_matches(rows, "company").select("user_id", "job_id", "match_score", "company", "scraped_at")


@query("match_view", f"""
  SELECT job_id, title, company, match_score, scraped_at FROM v_matches m JOIN (SELECT * RENAME (id AS jid) FROM v_jobs) j ON jid = job_id
  WHERE user_id = {USER} AND is_active AND match_score >= 0.2::double ORDER BY scraped_at DESC, job_id""")
def _(v):
    return browse.match_view(v.v_matches, v.v_jobs, USER, min_score=20, sort="date").select(
        "job_id", "title", "company", "match_score", "scraped_at")


@query("page_jobs", f"SELECT {SQL_LIST} FROM v_jobs ORDER BY scraped_at DESC, id LIMIT 20 OFFSET 40")
def _(v):
    return browse.page_jobs(v.v_jobs, 3).select(*LIST)


@query("page_after", f"""
  SELECT {SQL_LIST} FROM v_jobs WHERE scraped_at < TIMESTAMP '1996-06-01' OR (scraped_at = TIMESTAMP '1996-06-01' AND id > 100)
  ORDER BY scraped_at DESC, id LIMIT 20""")
def _(v):
    return browse.page_after(v.v_jobs, "1996-06-01 00:00:00", 100).select(*LIST)


@query("page_info", """
  SELECT cast(3 as int) AS page, cast(20 as int) AS per_page, count(*) AS total, (count(*) + 19) // 20 AS total_pages,
    cast(41 as int) AS first_row, least(60, count(*)) AS last_row FROM v_jobs""")
def _(v):
    return browse.page_info(v.v_jobs, 3)


@query("jobs_browse", f"""
  SELECT {SQL_LIST} FROM v_jobs WHERE job_board = '5-LOW' AND location ILIKE '%nation_2%' AND is_active AND (title ILIKE '%ring%' OR company ILIKE '%ring%')
  ORDER BY scraped_at DESC, id LIMIT 20 OFFSET 20""")
def _(v):
    return browse.jobs_browse(v.v_jobs, 2, board="5-LOW", location="nation_2", active="true", search="ring")[0].select(*LIST)


@query("jobs_browse_totals", """
  WITH f AS (SELECT * FROM v_jobs WHERE job_board = '5-LOW' AND location ILIKE '%nation_2%' AND is_active AND (title ILIKE '%ring%' OR company ILIKE '%ring%'))
  SELECT cast(2 as int) AS page, cast(20 as int) AS per_page, count(*) AS total, (count(*) + 19) // 20 AS total_pages, cast(21 as int) AS first_row,
    least(40, count(*)) AS last_row FROM f""")
def _(v):
    return browse.jobs_browse(v.v_jobs, 2, board="5-LOW", location="nation_2", active="true", search="ring")[1]


@query("distinct_boards", "SELECT DISTINCT job_board FROM v_jobs")
def _(v):
    return browse.distinct_boards(v.v_jobs)


@query("agg_totals", "SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive FROM v_jobs")
def _(v):
    return stats.agg_totals(v.v_jobs)


@query("agg_board_status", """
  SELECT job_board, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive FROM v_jobs GROUP BY 1 ORDER BY 1""")
def _(v):
    return stats.agg_board_status(v.v_jobs)


@query("agg_by_board", "SELECT job_board, count(*) AS found FROM v_jobs GROUP BY 1")
def _(v):
    return stats.agg_by_board(v.v_jobs)


@query("agg_board_number", "SELECT count(DISTINCT job_board) AS boards FROM v_jobs")
def _(v):
    return stats.agg_board_number(v.v_jobs)


@query("agg_api_stats", """
  SELECT (SELECT count(*) FROM v_jobs) AS total_jobs, (SELECT count(*) FROM v_jobs WHERE is_active) AS active_jobs,
    (SELECT count(*) FROM v_users) AS total_users, (SELECT count(*) FROM v_matches) AS total_matches,
    (SELECT string_agg(job_board || '=' || n, '|' ORDER BY job_board) FROM (SELECT job_board, count(*) AS n FROM v_jobs GROUP BY 1)) AS by_board""")
def _(v):
    one = stats.agg_api_stats(v.v_jobs, v.v_users, v.v_matches)
    shown = F.transform(F.map_entries("by_board"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return one.withColumn("by_board", F.array_join(F.array_sort(shown), "|"))


@query("agg_run_totals", """
  SELECT sum(jobs_scraped)::bigint AS jobs_scraped, sum(jobs_added)::bigint AS jobs_added, sum(duplicates)::bigint AS duplicates,
    sum(errors)::bigint AS errors, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM v_runs""")
def _(v):
    return stats.agg_run_totals(v.v_runs)


@query("agg_run_rollup", """
  SELECT name, sum(jobs_scraped)::bigint AS jobs_scraped, sum(jobs_added)::bigint AS jobs_added, sum(duplicates)::bigint AS duplicates,
    sum(errors)::bigint AS errors FROM v_runs GROUP BY ROLLUP (name)""")
def _(v):
    return stats.agg_run_rollup(v.v_runs)


@query("agg_run_report", """
  SELECT name, CASE WHEN success THEN '✓' ELSE '✗' END AS status, jobs_scraped, jobs_added, duplicates,
    format('{:.1f}s', duration_seconds) AS time, left(error_message, 45) || '...' AS error FROM v_runs ORDER BY name, duration_seconds, jobs_scraped""")
def _(v):
    return stats.agg_run_report(v.v_runs)


@query("agg_user_child_counts", """
  SELECT u.id, coalesce(c.n, 0) AS criteria_count, coalesce(m.n, 0) AS match_count FROM v_users u
  LEFT JOIN (SELECT user_id, count(*) AS n FROM v_criteria GROUP BY 1) c ON c.user_id = u.id
  LEFT JOIN (SELECT user_id, count(*) AS n FROM v_matches GROUP BY 1) m ON m.user_id = u.id""")
def _(v):
    return stats.agg_user_child_counts(v.v_users, v.v_criteria, v.v_matches)


@query("criteria_upsert", """
  WITH f AS (SELECT user_id, CASE WHEN len(k) > 0 THEN k END AS keywords, CASE WHEN len(l) > 0 THEN l END AS locations,
      try_cast(trim(min_salary) as bigint) * 10000 AS min_salary, try_cast(trim(max_salary) as bigint) * 10000 AS max_salary,
      CASE WHEN nullif(remote_preference, '') IS NOT NULL THEN remote_preference = 'true' END AS remote_preference
    FROM (SELECT *, list_filter(list_transform(string_split(coalesce(keywords, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS k,
            list_filter(list_transform(string_split(coalesce(locations, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS l
          FROM v_forms)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id DESC) = 1)
  SELECT c.id, c.user_id,
    array_to_string(CASE WHEN f.user_id IS NOT NULL THEN f.keywords ELSE c.keywords END, '|') AS keywords,
    array_to_string(CASE WHEN f.user_id IS NOT NULL THEN f.locations ELSE c.locations END, '|') AS locations,
    CASE WHEN f.user_id IS NOT NULL THEN f.min_salary ELSE c.min_salary END AS min_salary,
    CASE WHEN f.user_id IS NOT NULL THEN f.max_salary ELSE c.max_salary END AS max_salary,
    CASE WHEN f.user_id IS NOT NULL THEN f.remote_preference ELSE c.remote_preference END AS remote_preference, c.updated_at AS created_at,
    CASE WHEN f.user_id IS NOT NULL THEN TIMESTAMP '2002-01-01' ELSE c.updated_at END AS updated_at
  FROM v_criteria c LEFT JOIN v_latest n ON n.id = c.id LEFT JOIN f ON f.user_id = n.user_id
  UNION ALL
  SELECT (SELECT max(id) FROM v_criteria) + row_number() OVER (ORDER BY user_id), user_id, array_to_string(keywords, '|'),
    array_to_string(locations, '|'), min_salary, max_salary, remote_preference, TIMESTAMP '2002-01-01', TIMESTAMP '2002-01-01'
  FROM f WHERE user_id NOT IN (SELECT user_id FROM v_criteria)""")
def _(v):
    after = users.criteria_upsert(v.v_criteria.withColumn("created_at", c("updated_at")), v.v_forms, "2002-01-01 00:00:00")
    return after.withColumns({n: F.array_join(n, "|") for n in ("keywords", "locations")})


@query("user_add", """
  WITH w AS (SELECT lower(s_name) || '@example.com' AS email, s_name AS name FROM supplier
             UNION ALL SELECT email, name FROM v_users),
  n AS (SELECT email, min(name) AS name FROM w WHERE email NOT IN (SELECT email FROM v_users) GROUP BY 1),
  i AS (SELECT (SELECT max(id) FROM v_users) + row_number() OVER (ORDER BY email) AS id, name, email FROM n)
  SELECT id, name, email, sha256('s-' || id) AS access_token, 'http://localhost:8000/u/' || sha256('s-' || id) AS url FROM i""")
def _(v):
    suppliers = v.table("supplier").select(
        F.concat(F.lower("s_name"), F.lit("@example.com")).alias("email"), c("s_name").alias("name"))
    wanted = suppliers.unionByName(v.v_users.select("email", "name"))
    return users.user_add(v.v_users, wanted, salt="s-")


@query("user_add_criteria", """
  WITH n AS (SELECT DISTINCT lower(s_name) || '@example.com' AS email FROM supplier WHERE lower(s_name) || '@example.com' NOT IN (SELECT email FROM v_users)),
  i AS (SELECT row_number() OVER (ORDER BY email) AS n FROM n)
  SELECT (SELECT max(id) FROM v_criteria) + n AS id, (SELECT max(id) FROM v_users) + n AS user_id, NULL::varchar AS keywords, NULL::varchar AS locations,
    NULL::bigint AS min_salary, NULL::bigint AS max_salary, NULL::boolean AS remote_preference, TIMESTAMP '2002-01-01' AS created_at,
    TIMESTAMP '2002-01-01' AS updated_at FROM i""")
def _(v):
    wanted = v.table("supplier").select(F.concat(F.lower("s_name"), F.lit("@example.com")).alias("email"), c("s_name").alias("name"))
    _, rows = users.users_with_criteria(v.v_users, v.v_criteria, wanted, "2002-01-01 00:00:00", salt="s-")
    return rows.withColumns({n: F.array_join(n, "|") for n in ("keywords", "locations")})
