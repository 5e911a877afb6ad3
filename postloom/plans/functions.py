"""Queries over the scalar functions."""

from pyspark.sql import functions as F

from postloom.functions import criteria as cr
from postloom.functions import labels as lb
from postloom.functions import salary as pay
from postloom.functions import text as tx
from postloom.functions import urls
from postloom.operators import scoring
from postloom.plans.registry import query
from postloom.plans.views import sql_fingerprint, sql_norm_fingerprint, sql_norm_match
from postloom.sources.tables import spread

c = F.col
AMOUNT = r"(\d{1,3}(?:,\d{3})*|\d+)"


def sql_salary_doda(rows: str) -> str:
    """id, salary_text, lo, hi from rows with id, salary_text."""
    return f"""
      SELECT id, salary_text, list_min(a) AS lo, list_max(a) AS hi FROM (
        SELECT id, salary_text, list_transform(m, lambda x: CASE
            WHEN monthly AND NOT annual AND cast(replace(x, ',', '') as bigint) * 10000 < 2500000
            THEN cast(replace(x, ',', '') as bigint) * 120000 ELSE cast(replace(x, ',', '') as bigint) * 10000 END) AS a
        FROM (SELECT id, salary_text, monthly, annual,
                CASE WHEN annual AND (monthly OR len(marked) > 0) THEN marked ELSE every END AS m
              FROM (SELECT id, salary_text, contains(salary_text, '月給') OR contains(salary_text, '月収') AS monthly,
                      contains(salary_text, '年収') AS annual,
                      regexp_extract_all(salary_text, '{AMOUNT}万円', 1) AS every,
                      regexp_extract_all(salary_text, '(?:年収|予定年収)[＞>]?{AMOUNT}万円', 1) AS marked
                    FROM {rows})))"""


def sql_salary_indeed(rows: str) -> str:
    return f"""
      SELECT id, salary_text, list_min(a) AS lo, list_max(a) AS hi FROM (
        SELECT id, salary_text, list_transform(list_transform(
            regexp_extract_all(salary_text, '{AMOUNT}万?円', 1),
            lambda x: CASE WHEN cast(replace(x, ',', '') as bigint) < 1000 THEN cast(replace(x, ',', '') as bigint) * 10000
                           ELSE cast(replace(x, ',', '') as bigint) END),
            lambda y: CASE WHEN regexp_matches(salary_text, '月給|月収') AND NOT regexp_matches(salary_text, '年収|年俸')
                            AND y < 2500000 THEN y * 12 ELSE y END) AS a
        FROM {rows})"""


def sql_salary_green(rows: str) -> str:
    return f"""
      SELECT id, salary_text,
        CASE WHEN r THEN cast(regexp_extract(salary_text, p, 1) as bigint) * 10000 ELSE s END AS lo,
        CASE WHEN r THEN cast(regexp_extract(salary_text, p, 2) as bigint) * 10000 ELSE s END AS hi
      FROM (SELECT *, regexp_matches(salary_text, p) AS r,
              try_cast(nullif(regexp_extract(salary_text, '(\\d{{3,}})\\s*万円', 1), '') as bigint) * 10000 AS s
            FROM (SELECT id, salary_text, '(\\d{{3,}})\\s*万円?\\s*[〜~～ー－-]\\s*(\\d{{3,}})\\s*万円?' AS p FROM {rows}))"""


def _bounds(v, rule):
    b = rule(c("salary_text"))
    return v.v_salary.select("id", "salary_text", b["min"].alias("lo"), b["max"].alias("hi"))


query("salary_doda", sql_salary_doda("v_salary"))(lambda v: _bounds(v, pay.salary_doda))
query("salary_indeed", sql_salary_indeed("v_salary"))(lambda v: _bounds(v, pay.salary_indeed))
query("salary_range_green", sql_salary_green("v_salary"))(lambda v: _bounds(v, pay.salary_range_green))


@query("norm_fingerprint", f"""
  SELECT l_orderkey, l_linenumber, l_extendedprice, {sql_norm_fingerprint('title')} AS title_key, {sql_norm_fingerprint('company')} AS company_key
  FROM (SELECT seq.l_orderkey, seq.l_linenumber, seq.l_extendedprice, title, company FROM v_posts)""")
def _(v):
    return v.v_posts.select(
        "seq.l_orderkey", "seq.l_linenumber", "seq.l_extendedprice",
        tx.norm_fingerprint(c("title")).alias("title_key"), tx.norm_fingerprint(c("company")).alias("company_key"))


@query("fingerprint", f"""
  SELECT doc_id, {sql_fingerprint('text', 'source', 'lang')} AS fingerprint FROM documents""")
def _(v):
    return spread(v.table("documents")).select("doc_id", tx.fingerprint(c("text"), c("source"), c("lang")).alias("fingerprint"))


@query("norm_match", f"SELECT doc_id, md5({sql_norm_match('text')}) AS digest, length({sql_norm_match('text')}) AS size FROM documents")
def _(v):
    n = tx.norm_match(c("text"))
    return spread(v.table("documents")).select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("bigint").alias("size"))


@query("text_lines", r"""
  SELECT doc_id, len(l) AS lines, md5(array_to_string(l, '|')) AS digest FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\n\r　')), lambda x: x <> '') AS l
    FROM documents)""")
def _(v):
    lines = tx.text_lines(c("text"))
    return v.table("documents").select(
        "doc_id", F.size(lines).cast("bigint").alias("lines"), F.md5(F.array_join(lines, "|")).alias("digest"))


_LINES = "[CASE WHEN id % 2 = 0 THEN 'New' ELSE '120人' END, CASE WHEN id % 5 = 0 THEN '1998年設立' ELSE company END, title, location, coalesce(salary_text, '-'), description]"


def _card_lines(v):
    return v.v_card.select("id", F.array(
        F.when(c("id") % 2 == 0, "New").otherwise("120人"),
        F.when(c("id") % 5 == 0, "1998年設立").otherwise(c("company")),
        "title", "location", F.coalesce("salary_text", F.lit("-")), "description").alias("lines"))


@query("pick_company", f"""
  SELECT id, coalesce(list_filter(l[1:5], lambda x: length(x) >= 3 AND x NOT IN ('New','NEW','急募','PR')
    AND NOT regexp_matches(x, '^\\d+人?$') AND NOT regexp_matches(x, '^\\d{{4}}年')
    AND (contains(x, '会社') OR length(x) > 5))[1], l[1]) AS company FROM (SELECT id, {_LINES} AS l FROM v_card)""")
def _(v):
    return _card_lines(v).select("id", tx.pick_company(c("lines")).alias("company"))


_TITLE_RX = "デザイナー|エンジニア|マネージャー|ディレクター|募集|開発|担当|リーダー|スペシャリスト"


@query("pick_title", f"""
  SELECT id, coalesce(list_filter(l, lambda x: length(x) >= 15 AND regexp_matches(x, '{_TITLE_RX}'))[1],
    list_filter(l, lambda x: length(x) = list_max(list_transform(l, lambda y: length(y))))[1]) AS title
  FROM (SELECT id, {_LINES} AS l FROM v_card)""")
def _(v):
    return _card_lines(v).select("id", tx.pick_title(c("lines")).alias("title"))


@query("longest_line", f"""
  SELECT id, list_filter(l, lambda x: length(x) = list_max(list_transform(l, lambda y: length(y))))[1] AS line
  FROM (SELECT id, {_LINES} AS l FROM v_card)""")
def _(v):
    return _card_lines(v).select("id", tx.longest_line(c("lines")).alias("line"))


@query("pick_location", f"""
  SELECT id, list_filter(l, lambda x: length(x) < 50 AND regexp_matches(x, '都|道|府|県|市|区|リモート|在宅'))[1] AS location
  FROM (SELECT id, {_LINES} AS l FROM v_card)""")
def _(v):
    return _card_lines(v).select("id", tx.pick_location(c("lines")).alias("location"))


@query("pick_salary", f"""
  SELECT id, list_filter(l, lambda x: regexp_matches(x, '万円|万〜'))[1] AS salary FROM (SELECT id, {_LINES} AS l FROM v_card)""")
def _(v):
    return _card_lines(v).select("id", tx.pick_salary(c("lines")).alias("salary"))


@query("title_strip_company", """
  SELECT id, CASE WHEN starts_with(t, company) THEN trim(substr(t, length(company) + 1)) ELSE t END AS title FROM (
    SELECT id, company, CASE WHEN id % 3 = 0 THEN company || ' ' || title WHEN id % 3 = 1 THEN company || title ELSE title END AS t FROM v_card)""")
def _(v):
    t = F.when(c("id") % 3 == 0, F.concat_ws(" ", "company", "title")).when(
        c("id") % 3 == 1, F.concat("company", "title")).otherwise(c("title"))
    return v.v_card.select("id", tx.title_strip_company(t, c("company")).alias("title"))


_HREF = """CASE id % 5 WHEN 0 THEN url WHEN 1 THEN '/job/' || id WHEN 2 THEN '?page=' || id
  WHEN 3 THEN '//cdn.example.com/projects/' || id ELSE 'x/j_jid__' || id || '/?a=1' END"""


def _hrefs(v):
    key = c("id").cast("string")
    return v.v_jobs.select("id", F.when(c("id") % 5 == 0, c("url")).when(c("id") % 5 == 1, F.concat(F.lit("/job/"), key))
        .when(c("id") % 5 == 2, F.concat(F.lit("?page="), key))
        .when(c("id") % 5 == 3, F.concat(F.lit("//cdn.example.com/projects/"), key))
        .otherwise(F.concat(F.lit("x/j_jid__"), key, F.lit("/?a=1"))).alias("href"))


@query("job_id", f"""
  SELECT id, nullif(regexp_extract(h, '/j_jid__(\\d+)/', 1), '') AS doda, nullif(regexp_extract(h, '/job/(\\d+)', 1), '') AS green,
    nullif(regexp_extract(h, '/projects/(\\d+)', 1), '') AS wantedly FROM (SELECT id, {_HREF} AS h FROM v_jobs)""")
def _(v):
    return _hrefs(v).select("id", *[urls.job_id(c("href"), b).alias(b) for b in ("doda", "green", "wantedly")])


@query("url_absolute", f"""
  SELECT id, CASE id % 5 WHEN 0 THEN h WHEN 3 THEN 'https:' || h WHEN 4 THEN 'https://doda.jp/' || h ELSE 'https://doda.jp' || h END AS url
  FROM (SELECT id, {_HREF} AS h FROM v_jobs)""")
def _(v):
    return _hrefs(v).select("id", urls.url_absolute(c("href"), urls.BASE_URL["doda"]).alias("url"))


@query("strip_query", "SELECT page_id, string_split(url, '?')[1] AS url FROM pages")
def _(v):
    return v.table("pages").select("page_id", urls.strip_query(c("url")).alias("url"))


@query("criteria_list_parse", """
  SELECT id, array_to_string(CASE WHEN len(k) > 0 THEN k END, '|') AS keywords FROM (
    SELECT id, list_filter(list_transform(string_split(keywords, ','), lambda x: trim(x)), lambda x: x <> '') AS k FROM v_forms)""")
def _(v):
    return v.v_forms.select("id", F.array_join(cr.criteria_list_parse(c("keywords")), "|").alias("keywords"))


@query("criteria_salary_units", """
  SELECT id, try_cast(trim(min_salary) as bigint) * 10000 AS low, try_cast(trim(max_salary) as bigint) * 10000 AS high FROM v_forms""")
def _(v):
    return v.v_forms.select("id", cr.criteria_salary_units(c("min_salary")).alias("low"),
                            cr.criteria_salary_units(c("max_salary")).alias("high"))


@query("criteria_tri_bool", """
  SELECT id, CASE WHEN nullif(remote_preference, '') IS NOT NULL THEN remote_preference = 'true' END AS remote FROM v_forms""")
def _(v):
    return v.v_forms.select("id", cr.criteria_tri_bool(c("remote_preference")).alias("remote"))


@query("json_list_coerce", """
  SELECT id, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN coalesce(keywords[1], '') ELSE coalesce(array_to_string(keywords, '|'), '') END AS wrapped,
    CASE WHEN id % 4 < 2 THEN '' ELSE coalesce(array_to_string(keywords, '|'), '') END AS dropped FROM v_criteria""")
def _(v):
    stored = F.when(c("id") % 4 == 0, F.lit(None)).when(
        c("id") % 4 == 1, F.concat(F.lit('"'), F.get("keywords", 0), F.lit('"'))).otherwise(F.to_json("keywords"))
    return v.v_criteria.select(
        "id", F.array_join(cr.json_list_coerce(stored), "|").alias("wrapped"),
        F.array_join(cr.json_list_coerce(stored, "drop"), "|").alias("dropped"))


_HAS = "lambda k: contains(lower({0}), lower(k))"


@query("kw_hits", f"""
  SELECT user_id, job_id, array_to_string(list_filter(coalesce(keywords, []), {_HAS.format('title')}), '|') AS title_hits,
    array_to_string(list_filter(coalesce(keywords, []), {_HAS.format('description')}), '|') AS description_hits FROM v_pairs""")
def _(v):
    return v.v_pairs.select(
        "user_id", "job_id", F.array_join(scoring.kw_hits(c("title_n"), c("keywords")), "|").alias("title_hits"),
        F.array_join(scoring.kw_hits(c("description_n"), c("keywords")), "|").alias("description_hits"))


@query("loc_hit", f"""
  SELECT user_id, job_id, list_filter(coalesce(locations, []), {_HAS.format('location')})[1] AS place FROM v_pairs""")
def _(v):
    return v.v_pairs.select("user_id", "job_id", scoring.loc_hit(c("location_n"), c("locations")).alias("place"))


SQL_OVERLAP = """CASE WHEN salary_annual_min IS NULL AND salary_annual_max IS NULL THEN false
  WHEN min_salary IS NULL AND max_salary IS NULL THEN true
  ELSE coalesce(nullif(salary_annual_min, 0), salary_annual_max) <= coalesce(nullif(max_salary, 0), 9e18)
   AND coalesce(nullif(salary_annual_max, 0), salary_annual_min) >= coalesce(min_salary, 0) END"""


@query("salary_overlap", f"SELECT user_id, job_id, {SQL_OVERLAP} AS overlap FROM v_pairs")
def _(v):
    return v.v_pairs.select("user_id", "job_id", scoring.salary_overlap(
        c("salary_annual_min"), c("salary_annual_max"), c("min_salary"), c("max_salary")).alias("overlap"))


@query("iso_ts", """
  SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso
  FROM events""")
def _(v):
    return v.table("events").select("event_id", lb.iso_ts(c("ts")).alias("iso"))


@query("score_percent", "SELECT id, cast(trunc(match_score * 100::double) as int) AS percent FROM v_matches")
def _(v):
    return v.v_matches.select("id", lb.score_percent(c("match_score")).alias("percent"))


@query("score_label", """
  SELECT id, cast(round_even(match_score * 100::double, 0) as bigint) || '%' AS label,
    CASE WHEN match_score >= 0.7::double THEN 'high' WHEN match_score >= 0.5::double THEN 'medium' ELSE 'low' END AS band FROM v_matches""")
def _(v):
    return v.v_matches.select("id", lb.score_label(c("match_score")).alias("label"), lb.score_band(c("match_score")).alias("band"))


@query("salary_label", """
  SELECT id, CASE WHEN salary_annual_min IS NULL AND salary_annual_max IS NULL THEN '-'
    ELSE concat_ws('~', salary_annual_min // 10000, salary_annual_max // 10000) || '万' END AS label,
    CASE WHEN salary_annual_min IS NULL AND salary_annual_max IS NULL THEN '-'
    ELSE concat_ws('~', (salary_annual_min // 10000) || '万', (salary_annual_max // 10000) || '万') END AS badge FROM v_jobs""")
def _(v):
    lo, hi = c("salary_annual_min"), c("salary_annual_max")
    return v.v_jobs.select("id", lb.salary_label(lo, hi).alias("label"), lb.salary_label(lo, hi, unit_each=True).alias("badge"))


@query("truncate_label", """
  SELECT id, CASE WHEN length(t) > 60 THEN left(t, 60) || '...' ELSE t END AS title,
    CASE WHEN length(f) > 30 THEN left(f, 30) || '...' ELSE f END AS company,
    CASE WHEN id % 9 = 0 THEN '-' WHEN length(l) > 20 THEN left(l, 20) || '...' ELSE l END AS location
  FROM (SELECT id, title || ' ' || description AS t, company || ' ' || title AS f, location || ' ' || left(title, id % 20) AS l FROM v_jobs)""")
def _(v):
    """Long titles, companies and places at the widths of the listing."""
    place = F.concat_ws(" ", "location", F.left("title", (c("id") % 20).cast("int")))
    return v.v_jobs.select("id", lb.truncate_label(F.concat_ws(" ", "title", "description"), lb.TITLE_WIDTH).alias("title"),
                           lb.truncate_label(F.concat_ws(" ", "company", "title"), lb.COMPANY_WIDTH).alias("company"),
                           lb.truncate_label(F.when(c("id") % 9 != 0, place), lb.LOCATION_WIDTH, "-").alias("location"))


@query("list_join_label", """
  SELECT id, coalesce(array_to_string(keywords, ', '), '') AS keywords, coalesce(array_to_string(locations, ', '), '') AS locations FROM v_criteria""")
def _(v):
    return v.v_criteria.select("id", *[lb.list_join_label(c(n)).alias(n) for n in ("keywords", "locations")])
