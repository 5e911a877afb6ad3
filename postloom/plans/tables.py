"""Queries over storage, schema steps, checks and settings."""

from pyspark.sql import functions as F

from postloom.operators import ingest, lifecycle
from postloom.plans.registry import query
from postloom.plans.views import sql_fingerprint
from postloom.session import new_folder
from postloom.sources import frontier, tables

c = F.col
AS_OF = "1998-09-01"


@query("sink_html", "SELECT page_id, url, md5(html) AS digest FROM pages")
def _(v):
    folder = new_folder(v.spark, "landing")
    tables.sink_html(v.table("pages"), folder)
    return v.spark.read.parquet(folder).select("page_id", "url", F.md5("html").alias("digest"))


@query("src_html_files", "SELECT page_id, md5(html) AS digest FROM pages")
def _(v):
    """Pages saved one to a file; the file's folder names the page, and says where there is no html."""
    folder = new_folder(v.spark, "saved")
    name = F.concat(F.coalesce(c("page_id").cast("string"), F.lit("none")), F.when(c("html").isNull(), "-empty").otherwise(""))
    pages = tables.spread(v.table("pages")).select(name.alias("page"), c("html").alias("value"))
    pages.write.partitionBy("page").option("maxRecordsPerFile", 1).text(folder)
    saved = tables.src_html_files(v.spark, folder)
    page = F.nullif(F.regexp_extract("url", r"/page=(-?\d+)", 1), F.lit("")).cast("bigint")
    # the writer ends every file with a line break
    digest = F.md5(F.substring("html", F.lit(1), F.length("html") - 1))
    return saved.select(page.alias("page_id"), F.when(~F.rlike("url", F.lit("/page=[^/]*-empty/")), digest).alias("digest"))


@query("src_tables", """
  SELECT 'users' AS name, count(*) AS found FROM v_users UNION ALL SELECT 'criteria', count(*) FROM v_criteria
  UNION ALL SELECT 'jobs', count(*) FROM v_jobs UNION ALL SELECT 'matched_jobs', count(*) FROM v_matches""")
def _(v):
    folder = new_folder(v.spark, "tables")
    parts = {"users": v.v_users, "criteria": v.v_criteria, "jobs": v.v_jobs, "matched_jobs": v.v_matches}
    for name, frame in parts.items():
        frame.write.parquet(f"{folder}/{name}")
    out = None
    for name, frame in tables.src_tables(v.spark, folder).items():
        one = frame.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("name"), "found")
        out = one if out is None else out.unionByName(one)
    return out


@query("sink_append", "SELECT job_board, count(*) AS found, max(id) AS last_id FROM v_jobs GROUP BY 1")
def _(v):
    folder = new_folder(v.spark, "append")
    for active in (True, False):  # two batches into one table
        tables.sink_append(v.v_jobs.where(c("is_active") == active), folder)
    stored = v.spark.read.parquet(folder)
    return stored.groupBy("job_board").agg(F.count(F.lit(1)).alias("found"), F.max("id").alias("last_id"))


@query("src_settings", """
  SELECT source, enabled, array_to_string(keywords, '|') AS keywords, has_location, location, cast(max_pages as int) AS max_pages FROM v_settings
  UNION ALL SELECT unnest(['doda', 'green', 'indeed']), true, NULL, false, NULL, NULL""")
def _(v):
    """Settings files of many lines with up to some hundred sources each; where there is no file, the defaults."""
    folder = new_folder(v.spark, "settings")
    one = F.concat(F.lit('    "'), "source", F.lit('": '), "settings")
    whole = F.concat(F.lit('{\n  "global": {"max_pages": 2},\n  "scrapers": {\n'), F.array_join(F.collect_list(one), ",\n"), F.lit("\n  }\n}"))
    # one row and one file per group
    v.v_settings.groupBy(F.floor(c("key") / 200).alias("part")).agg(whole.alias("value")).repartition("part").write.partitionBy("part").text(folder)
    found = tables.src_settings(v.spark, f"{folder}/*")
    rows = found.unionByName(tables.src_settings(v.spark, f"{folder}/missing")).select(F.explode("scrapers").alias("source", "own"))

    def field(name, kind):
        return F.try_variant_get(c("own")[name], "$", kind)

    return rows.select(
        "source", field("enabled", "boolean").alias("enabled"),
        F.array_join(field("keywords", "array<string>"), "|").alias("keywords"),
        F.map_contains_key("own", F.lit("location")).alias("has_location"),
        field("location", "string").alias("location"), field("max_pages", "int").alias("max_pages"))


def _old_jobs(v):
    return v.v_jobs.select("id", "title", c("salary_text").alias("salary"), "scraped_at")


@query("migrate_jobs_v2", """
  SELECT id, title, scraped_at, NULL::varchar AS salary_text, NULL::bigint AS salary_annual_min, NULL::bigint AS salary_annual_max FROM v_jobs""")
def _(v):
    return lifecycle.migrate_jobs_v2(_old_jobs(v))


@query("migrate_last_seen", """
  SELECT id, scraped_at, coalesce(last_seen_at, scraped_at) AS last_seen_at, NULL::varchar AS fingerprint, true AS is_active FROM v_jobs""")
def _(v):
    return lifecycle.migrate_last_seen(v.v_jobs.select("id", "scraped_at", "last_seen_at"))


@query("migrate_updated_at", "SELECT id, scraped_at, scraped_at AS updated_at FROM v_jobs")
def _(v):
    return lifecycle.migrate_updated_at(v.v_jobs.select("id", "scraped_at"))


@query("migrate_tokens", "SELECT id, email, coalesce(access_token, sha256('s-' || id)) AS access_token FROM v_users")
def _(v):
    return lifecycle.migrate_tokens(v.v_users.select("id", "email", "access_token"), salt="s-")


@query("migrate_down", "SELECT id, title, NULL::varchar AS salary FROM v_jobs")
def _(v):
    jobs = v.v_jobs.drop("company", "description", "location", "url", "job_board", "scraped_at")
    for step in ("last_seen", "jobs_v2", "updated_at"):
        jobs = lifecycle.migrate_down(jobs, step)
    return jobs


@query("check_unique", """
  SELECT l_orderkey, l_linenumber, count(*) AS found FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(v):
    return lifecycle.check_unique(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("check_fk", "SELECT id, user_id, job_id FROM v_matches m WHERE NOT EXISTS (SELECT 1 FROM v_jobs j WHERE j.id = m.job_id)")
def _(v):
    return lifecycle.check_fk(v.v_matches.select("id", "user_id", "job_id"), "job_id", v.v_jobs)


@query("check_not_null", """
  SELECT 'title' AS name, count(*) FILTER (title IS NULL) AS nulls FROM v_posts UNION ALL
  SELECT 'company', count(*) FILTER (company IS NULL) FROM v_posts UNION ALL
  SELECT 'url', count(*) FILTER (url IS NULL) FROM v_posts UNION ALL SELECT 'job_board', count(*) FILTER (job_board IS NULL) FROM v_posts""")
def _(v):
    return lifecycle.check_not_null(v.v_posts, ["title", "company", "url", "job_board"])


@query("cascade_delete", """
  SELECT id, user_id, job_id FROM v_matches WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def _(v):
    gone = v.table("customer").where("c_acctbal < 0")
    return lifecycle.cascade_delete(v.v_matches.select("id", "user_id", "job_id"), "user_id", gone, "c_custkey")


@query("fp_backfill", f"""
  SELECT id, coalesce(fingerprint, {sql_fingerprint('title', 'company', 'job_board')}) AS fingerprint, fingerprint IS NULL AS backfilled FROM v_jobs""")
def _(v):
    return ingest.fp_backfill(v.v_jobs).select("id", "fingerprint", "backfilled")


@query("expire_stale", f"""
  SELECT id, is_active AND NOT e AS is_active, e AS expired FROM (
    SELECT id, is_active, coalesce(is_active AND last_seen_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY, false) AS e FROM v_jobs)""")
def _(v):
    return lifecycle.expire_stale(v.v_jobs, AS_OF).select("id", "is_active", "expired")


@query("expire_stale_board", f"""
  SELECT job_board, count(*) FILTER (is_active AND job_board = '5-LOW' AND last_seen_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS expired
  FROM v_jobs GROUP BY 1""")
def _(v):
    return lifecycle.expire_stale(v.v_jobs, AS_OF, 30, "5-LOW").groupBy("job_board").agg(
        F.count_if("expired").alias("expired"))


_ENC = "replace(url_encode({0}), '%20', '+')"
_WORDS = "array_to_string(keywords, ' ')"


@query("frontier_doda", f"""
  SELECT id, 'https://doda.jp/DodaFront/View/JobSearchList.action?k=' || {_ENC.format(f"concat_ws(' ', {_WORDS}, location)")} || '&kwc=1&ss=1&pic=1&ds=0&so=50&tp=1' AS url FROM v_searches""")
def _(v):
    return v.v_searches.select("id", frontier.frontier_doda(c("keywords"), c("location")).alias("url"))


@query("frontier_green", f"""
  SELECT id, 'https://www.green-japan.com/search_key?keyword=' || {_ENC.format(f"concat_ws(' ', {_WORDS}, location)")} AS url FROM v_searches""")
def _(v):
    return v.v_searches.select("id", frontier.frontier_green(c("keywords"), c("location")).alias("url"))


@query("frontier_indeed", f"""
  SELECT id, 'https://jp.indeed.com/jobs?q=' || {_ENC.format(_WORDS)} || coalesce('&l=' || {_ENC.format('location')}, '') AS url FROM v_searches""")
def _(v):
    return v.v_searches.select("id", frontier.frontier_indeed(c("keywords"), c("location")).alias("url"))


@query("frontier_wantedly_kw", f"""
  SELECT id, cast(page as int) AS page, 'https://www.wantedly.com/projects?page=' || page || '&keywords=' ||
    replace(url_encode(concat_ws(' ', {_WORDS}, location)), '%2F', '/') AS url
  FROM (SELECT *, unnest(range(1, max_pages + 1)) AS page FROM v_searches)""")
def _(v):
    return frontier.page_numbers(v.v_searches).select(
        "id", "page", frontier.frontier_wantedly_kw(c("keywords"), c("location"), c("page")).alias("url"))


_SLUG = """CASE k WHEN 'デザイナー' THEN 'designer' WHEN 'エンジニア' THEN 'engineer' WHEN 'マーケター' THEN 'marketer'
  WHEN 'セールス' THEN 'sales' WHEN 'PM' THEN 'pm_director' WHEN 'プロダクトマネージャー' THEN 'pm_director'
  WHEN 'ディレクター' THEN 'pm_director' WHEN '人事' THEN 'hr' WHEN 'バックオフィス' THEN 'corporate' END"""


@query("frontier_wantedly_occ", f"""
  SELECT id, cast(page as int) AS page, 'https://www.wantedly.com/projects' ||
    CASE WHEN s IS NOT NULL AND page > 1 THEN '?occupation_types%5B%5D=' || s || '&page=' || page
         WHEN s IS NOT NULL THEN '?occupation_types%5B%5D=' || s WHEN page > 1 THEN '?page=' || page ELSE '' END AS url
  FROM (SELECT id, list_filter(list_transform(keywords, lambda k: {_SLUG}), lambda s: s IS NOT NULL)[1] AS s,
               unnest(range(1, max_pages + 1)) AS page FROM v_searches)""")
def _(v):
    return frontier.page_numbers(v.v_searches).select(
        "id", "page", frontier.frontier_wantedly_occ(c("keywords"), c("page")).alias("url"))


@query("j_settings", """
  SELECT source, array_to_string(coalesce(keywords, ['デザイナー']), '|') AS keywords,
    CASE WHEN has_location THEN location ELSE '東京' END AS location, cast(coalesce(max_pages, 20) as int) AS max_pages FROM v_settings""")
def _(v):
    merged = frontier.j_settings(v.v_settings, {"max_pages": 20})
    return merged.select("source", F.array_join("keywords", "|").alias("keywords"), "location", "max_pages")


@query("f_enabled", "SELECT source, key FROM v_settings WHERE coalesce(enabled, true)")
def _(v):
    return frontier.f_enabled(v.v_settings).select("source", "key")


@query("f_only", "SELECT name, sum(jobs_scraped)::bigint AS scraped FROM v_runs WHERE name IN ('click', 'error') GROUP BY 1")
def _(v):
    return frontier.f_only(v.v_runs, ["click", "error"], "name").groupBy("name").agg(F.sum("jobs_scraped").alias("scraped"))


@query("f_only_unknown", "SELECT name, jobs_scraped FROM v_runs WHERE false")
def _(v):
    return frontier.f_only(v.v_runs, ["click", "no such source"], "name").select("name", "jobs_scraped")
