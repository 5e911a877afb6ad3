"""Queries over page extraction, paging and page profiles.

Board pages are built by Spark from the derived postings, so the expected
records can be stated in SQL over the same tables.
"""

from pyspark.sql import functions as F

from postloom.functions import text as tx
from postloom.plans.functions import sql_salary_doda, sql_salary_green, sql_salary_indeed
from postloom.plans.registry import query
from postloom.plans.views import GREEN_FILL
from postloom.sources import boards, dom, paging, profile
from postloom.sources.state import state_json
from postloom.sources.tables import src_pages

c = F.col
RECORD = ("job_id", "title", "company", "location", "salary_text", "salary_annual_min", "salary_annual_max",
          "url", "job_board", "description")


def nodes(v, board, fields=None):
    return dom.with_nodes(v.board_pages(board), fields)


def raw_pages(v, fields=None):
    return dom.with_nodes(src_pages(v.spark, f"{v.folder}/pages.parquet"), fields)


MARKUP = ["tag", "attrs"]  # what the counts of the page report look at


def surveyed(v):
    """Raw pages, doda pages and pages on which every pattern of the page report occurs."""
    parts = [raw_pages(v, MARKUP), nodes(v, "doda", MARKUP), nodes(v, "survey", MARKUP)]
    return boards.union_sources([p.select("page_id", "nodes") for p in parts])


_DODA = f"""SELECT cast(k.id as varchar) AS job_id, title, company, location, k.salary_text, lo AS salary_annual_min, hi AS salary_annual_max,
    'https://doda.jp/DodaFront/View/JobSearchDetail/j_jid__' || k.id || '/' AS url, 'doda' AS job_board,
    concat_ws(' ', '勤務地', location, '給与' || ' ' || k.salary_text, description) AS description
  FROM v_card k JOIN ({sql_salary_doda('v_card')}) s ON s.id = k.id"""
_GREEN_LONG = f"description || ' {GREEN_FILL}'"
_GREEN = f"""SELECT cast(k.id as varchar) AS job_id,
    CASE WHEN length(title) >= 15 AND regexp_matches(title, 'デザイナー|エンジニア|募集') THEN title ELSE {_GREEN_LONG} END AS title,
    company, location, k.pay AS salary_text, lo AS salary_annual_min, hi AS salary_annual_max,
    'https://www.green-japan.com/job/' || k.id AS url, 'green' AS job_board,
    concat_ws(' ', 'New', company, title, location, k.salary_text, {_GREEN_LONG}) AS description
  FROM (SELECT *, CASE WHEN regexp_matches(salary_text, '万円|万〜') THEN salary_text END AS pay FROM v_card) k
  JOIN ({sql_salary_green("(SELECT id, CASE WHEN regexp_matches(salary_text, '万円|万〜') THEN salary_text END AS salary_text FROM v_card)")}) s ON s.id = k.id"""
_PAY_INDEED = r"CASE WHEN regexp_matches(salary_text, '^(月給|年収|年俸)|^[\d,]+万?円') THEN salary_text END"
_INDEED = f"""SELECT 'jk' || k.id AS job_id, title, company, location, pay AS salary_text, lo AS salary_annual_min, hi AS salary_annual_max,
    'https://jp.indeed.com/rc/clk?jk=' || k.id AS url, 'indeed' AS job_board,
    CASE WHEN k.id % 3 < 2 THEN description ELSE concat_ws(' ', title, company, location, k.salary_text) END AS description
  FROM (SELECT *, {_PAY_INDEED} AS pay FROM v_card) k
  JOIN ({sql_salary_indeed(f"(SELECT id, {_PAY_INDEED} AS salary_text FROM v_card)")}) s ON s.id = k.id WHERE k.id % 5 <> 0"""
_NO_PAY = "NULL::varchar AS salary_text, NULL::bigint AS salary_annual_min, NULL::bigint AS salary_annual_max"
# a project whose id is the number 0 counts as having none
_STATE = f"""SELECT cast(id as varchar) AS job_id, title, CASE WHEN id % 4 <> 3 THEN company ELSE '' END AS company, location, {_NO_PAY},
    'https://www.wantedly.com/projects/' || id AS url, 'wantedly' AS job_board,
    CASE WHEN id % 2 = 0 THEN description ELSE title END AS description FROM v_card WHERE id <> 0"""


def _links(title):
    return f"""SELECT cast(id as varchar) AS job_id, {title} AS title, company, '' AS location, {_NO_PAY},
    'https://www.wantedly.com/projects/' || id AS url, 'wantedly' AS job_board, '' AS description FROM v_card"""


_HTML = _links("title || ' ' || (id % 9) || ' エントリー'")
_DOM = _links("title")

query("cards_doda", _DODA)(lambda v: boards.cards_doda(nodes(v, "doda")).select(*RECORD))
query("cards_green", _GREEN)(lambda v: boards.cards_green(nodes(v, "green")).select(*RECORD))
query("cards_indeed", _INDEED)(lambda v: boards.cards_indeed(nodes(v, "indeed")).select(*RECORD))
query("state_projects", _STATE)(lambda v: boards.cards_wantedly_state(nodes(v, "wantedly_state")).select(*RECORD))
query("cards_wantedly_html", _HTML)(lambda v: boards.cards_wantedly_html(nodes(v, "wantedly")).select(*RECORD))
query("cards_wantedly_dom", _DOM)(lambda v: boards.cards_wantedly_dom(nodes(v, "wantedly")).select(*RECORD))


def _mixed(v):
    """State pages and link pages of one source."""
    return v.board_pages("wantedly_state").unionByName(v.board_pages("wantedly")).withColumn("source", F.lit("wantedly"))


@query("cards_wantedly", f"{_STATE} UNION ALL {_HTML}")
def _(v):
    return boards.cards_wantedly(dom.with_nodes(_mixed(v))).select(*RECORD)


@query("extractor_registry", f"""
  SELECT job_board, count(*) AS found, max(url) AS last_url FROM ({_DODA} UNION ALL {_GREEN} UNION ALL {_INDEED} UNION ALL {_STATE}
    UNION ALL {_HTML} UNION ALL {_DOM}) GROUP BY 1""")
def _(v):
    pages = _mixed(v).unionByName(v.board_pages("wantedly").withColumn("source", F.lit("wantedly_dom")))
    for name in ("doda", "green", "indeed"):
        pages = pages.unionByName(v.board_pages(name))
    return boards.extract_all(pages).groupBy("job_board").agg(
        F.count(F.lit(1)).alias("found"), F.max("url").alias("last_url"))


@query("union_sources", f"SELECT * FROM ({_DODA}) UNION ALL SELECT * FROM ({_INDEED})")
def _(v):
    return boards.union_sources([
        boards.cards_doda(nodes(v, "doda")), boards.cards_indeed(nodes(v, "indeed"))]).select(*RECORD)


@query("label_value", "SELECT cast(id as varchar) AS job_id, location AS place, salary_text AS pay FROM v_card")
def _(v):
    n = c("nodes")
    cards = F.transform(F.filter(n, lambda x: x["tag"] == "article"), lambda a: F.struct(
        F.regexp_extract(dom.attr(dom.first_node(dom.subtree(n, a), lambda x: x["tag"] == "a"), "href"), r"__(\d+)/", 1).alias("job_id"),
        boards.label_value(n, dom.subtree(n, a), boards.PLACE_LABEL).alias("place"),
        boards.label_value(n, dom.subtree(n, a), boards.PAY_LABEL).alias("pay")))
    return nodes(v, "doda").select(F.inline(cards))


@query("salary_text_indeed", f"SELECT 'jk' || id AS job_id, {_PAY_INDEED} AS pay FROM v_card WHERE id % 5 <> 0")
def _(v):
    return boards.cards_indeed(nodes(v, "indeed")).select("job_id", c("salary_text").alias("pay"))


@query("desc_fallback", """
  SELECT 'jk' || id AS job_id, CASE WHEN id % 3 < 2 THEN description ELSE concat_ws(' ', title, company, location, salary_text) END AS text
  FROM v_card WHERE id % 5 <> 0""")
def _(v):
    return boards.cards_indeed(nodes(v, "indeed")).select("job_id", c("description").alias("text"))


@query("state_json", """
  SELECT page_no AS page_id, count(*) + count(*) FILTER (id % 4 <> 3) AS entries FROM v_card GROUP BY 1""")
def _(v):
    return nodes(v, "wantedly_state").select(
        "page_id", F.size(state_json(c("nodes"))["entries"]).cast("bigint").alias("entries"))


@query("j_company_ref", "SELECT cast(id as varchar) AS job_id, CASE WHEN id % 4 <> 3 THEN company ELSE '' END AS company FROM v_card WHERE id <> 0")
def _(v):
    return boards.cards_wantedly_state(nodes(v, "wantedly_state")).select("job_id", "company")


_PAGES = "SELECT page_no AS page_id, page_no % 7 <> 0 AS more FROM v_card GROUP BY 1"


@query("next_link_text", f"SELECT page_id, CASE WHEN more THEN 'https://doda.jp/DodaFront/list?page=' || (page_id + 1) END AS next_url FROM ({_PAGES})")
def _(v):
    return nodes(v, "doda").select("page_id", paging.next_link_text(c("nodes")).alias("next_url"))


@query("next_link_page_no", f"SELECT page_id, CASE WHEN more THEN 'https://www.green-japan.com/search_key?page=' || (page_id + 1) END AS next_url FROM ({_PAGES})")
def _(v):
    return nodes(v, "green").select("page_id", paging.next_link_page_no(c("nodes"), c("page_no")).alias("next_url"))


@query("next_link_testid", f"SELECT page_id, CASE WHEN more THEN 'https://jp.indeed.com/jobs?start=' || (page_id + 1) END AS next_url FROM ({_PAGES})")
def _(v):
    return nodes(v, "indeed").select("page_id", paging.next_link_testid(c("nodes")).alias("next_url"))


@query("has_next", f"SELECT page_id, more AS by_number, more AS by_text FROM ({_PAGES})")
def _(v):
    by_text = nodes(v, "wantedly_state").select("page_id", paging.has_next(c("nodes"), c("page_no")).alias("by_text"))
    by_number = nodes(v, "wantedly").select("page_id", paging.has_next(c("nodes"), c("page_no")).alias("by_number"))
    return by_number.join(by_text, "page_id")


def _hosts(v):
    host = F.concat_ws(".", F.slice(F.split(F.regexp_extract("url", "^https?://([^/?#]+)", 1), r"\."), -2, 2))
    return v.table("pages").select(
        host.alias("source"), c("page_id").alias("page_no"), F.when(~F.contains(c("url"), F.lit("page=")), F.lit(None)).otherwise(c("url")).alias("next_url"))


_HOSTS = r"""SELECT array_to_string(string_split(regexp_extract(url, '^https?://([^/?#]+)', 1), '.')[-2:], '.') AS source, page_id AS page_no,
    CASE WHEN contains(url, 'page=') THEN url END AS next_url FROM pages"""


@query("page_cap", f"SELECT source, page_no FROM ({_HOSTS}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY page_no) <= 20")
def _(v):
    return paging.page_cap(_hosts(v), 20).select("source", "page_no")


@query("page_cap_next", f"""
  WITH h AS ({_HOSTS}), l AS (SELECT source, min(page_no) AS last FROM h WHERE next_url IS NULL GROUP BY 1)
  SELECT h.source, h.page_no FROM h LEFT JOIN l ON l.source = h.source
  QUALIFY row_number() OVER (PARTITION BY h.source ORDER BY h.page_no) <= 20 AND (last IS NULL OR page_no <= last)""")
def _(v):
    return paging.page_cap(_hosts(v), 20, next_url="next_url").select("source", "page_no")


def _sightings(v):
    return v.table("lineitem").select(
        c("l_returnflag").alias("source"), F.floor(c("l_orderkey") / 20).alias("page_no"), c("l_partkey").alias("job_id"))


_SIGHT = "SELECT l_returnflag AS source, l_orderkey // 20 AS page_no, l_partkey AS job_id FROM lineitem"


@query("page_stop_empty", f"""
  WITH s AS ({_SIGHT}), f AS (SELECT source, job_id, min(page_no) AS page_no FROM s GROUP BY 1, 2),
  n AS (SELECT source, page_no, count(*) AS n FROM f GROUP BY 1, 2),
  p AS (SELECT d.source, d.page_no, coalesce(n.n, 0) AS new_ids FROM (SELECT DISTINCT source, page_no FROM s) d
        LEFT JOIN n ON n.source = d.source AND n.page_no = d.page_no),
  z AS (SELECT source, min(page_no) AS stop FROM p WHERE new_ids = 0 GROUP BY 1)
  SELECT p.source, p.page_no, p.new_ids FROM p LEFT JOIN z ON z.source = p.source WHERE stop IS NULL OR p.page_no <= stop""")
def _(v):
    return paging.page_stop_empty(_sightings(v))


@query("dedup_page_ids", """
  SELECT job_board AS source, job_id, page_no, pos FROM (
    SELECT o_orderpriority AS job_board, l_partkey AS job_id, l_orderkey AS page_no, cast(l_linenumber as int) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  QUALIFY row_number() OVER (PARTITION BY job_board, job_id ORDER BY page_no, pos) = 1""")
def _(v):
    lines = v.table("lineitem").join(v.table("orders"), c("l_orderkey") == c("o_orderkey"))
    return paging.dedup_page_ids(lines.select(
        c("o_orderpriority").alias("source"), c("l_partkey").alias("job_id"), c("l_orderkey").alias("page_no"),
        c("l_linenumber").alias("pos")))


_LINKS = r"""SELECT page_id, href, text, pos FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS text,
    unnest(range(0, len(regexp_extract_all(html, '<a\s+href="([^"]*)"[^>]*>([^<]*)</a>', 1)))) AS pos FROM pages)"""


@query("dedup_page_urls", f"SELECT page_id, href, min(pos) AS pos FROM ({_LINKS}) GROUP BY 1, 2")
def _(v):
    return paging.dedup_page_urls(profile.page_links(raw_pages(v))).select("page_id", "href", c("pos").cast("bigint").alias("pos"))


@query("profile_tags", r"""
  SELECT tag, count(*) AS found FROM (SELECT lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY 1""")
def _(v):
    return profile.profile_tags(raw_pages(v, ["tag"]))


@query("profile_links", f"""
  WITH l AS ({_LINKS}), d AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS rank, count(*) OVER (PARTITION BY page_id) AS n
    FROM l WHERE contains(lower(href), 'detail'))
  SELECT page_id, cast(n as int) AS found, cast(rank as int) AS pos, left(trim(text), 50) AS text, left(href, 80) AS href FROM d WHERE rank < 5
  UNION ALL
  SELECT page_no, cast(n as int), cast(rank as int), left(company || title, 50), left('/DodaFront/View/JobSearchDetail/j_jid__' || id || '/', 80)
  FROM (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY id) - 1 AS rank, count(*) OVER (PARTITION BY page_no) AS n FROM v_card) WHERE rank < 5""")
def _(v):
    return profile.profile_links(raw_pages(v).select("page_id", "nodes")).unionByName(
        profile.profile_links(nodes(v, "doda").select("page_id", "nodes")))


_SEL = "SELECT '{0}' AS pattern, {1} AS found"


def _every(divisor, table="v_card", key="id"):
    return f"(SELECT count(*) FROM (SELECT DISTINCT {key} FROM {table}) WHERE {key} % {divisor} = 0)"


_CARDS = "(SELECT count(*) FROM v_card)"
_PAGE = lambda divisor: _every(divisor, key="page_no")


@query("profile_selectors", " UNION ALL ".join([
    _SEL.format("article", f"{_CARDS} + {_every(11)} + (SELECT sum(len(regexp_extract_all(html, '<article')))::bigint FROM pages)"),
    _SEL.format("div_job", f"{_CARDS} + {_every(5)}"), _SEL.format("div_card", f"{_CARDS} + {_every(5)}"),
    _SEL.format("div_list_item", _every(3)), _SEL.format("li_job", _every(2)),
    _SEL.format("div_jobcard", _every(5)), _SEL.format("div_searchlist", _every(7))]))
def _(v):
    return profile.profile_selectors(surveyed(v))


@query("profile_pagination", f"""
  SELECT 'nav_pag' AS pattern, {_PAGE(2)} AS found UNION ALL SELECT 'ul_pag', {_PAGE(3)} UNION ALL SELECT 'div_pag', {_PAGE(4)}
  UNION ALL SELECT 'a_next', {_PAGE(2)} UNION ALL SELECT 'a_rel_next', {_PAGE(5)}
  UNION ALL SELECT 'a_href_page', (SELECT count(*) FROM ({_PAGES}) WHERE more)
    + (SELECT count(*) FROM ({_LINKS}) WHERE contains(lower(href), 'page')) + {_PAGE(7)}""")
def _(v):
    return profile.profile_pagination(surveyed(v))


@query("profile_classes", """
  SELECT class, found FROM (SELECT 'jobCard' AS class, count(*) AS found FROM v_card UNION ALL SELECT 'jobCard-body', count(*) FROM v_card
    UNION ALL SELECT 'job_seen_beacon', count(*) FROM v_card UNION ALL SELECT 'job-snippet', count(*) FROM v_card WHERE id % 3 = 0
    UNION ALL SELECT 'jobCardShelfContainer', count(*) FROM v_card WHERE id % 3 = 1
    UNION ALL SELECT 'jcs-JobTitle css-1', count(*) FROM v_card) ORDER BY found DESC, class LIMIT 10""")
def _(v):
    return profile.profile_classes(nodes(v, "doda", MARKUP).unionByName(nodes(v, "indeed", MARKUP)))


@query("profile_headings", r"""
  SELECT page_id, cast(len(list_filter(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1), lambda x: length(trim(x)) > 10 AND length(trim(x)) < 200)) as int) AS headings,
    cast(len(regexp_extract_all(html, '<script type="application/ld.json"')) as int) AS json_ld,
    replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '~', '<') AS title
  FROM (SELECT page_id, replace(replace(html, '&amp;', '&'), '&lt;', '~') AS html FROM pages)
  UNION ALL
  SELECT page_no, cast(count(*) FILTER (id % 2 = 0 AND length(title) > 10 AND length(title) < 200) as int),
    cast(count(*) FILTER (id % 13 = 0) as int), 'Page ' || page_no FROM v_card GROUP BY page_no""")
def _(v):
    raw, survey = profile.profile_headings(raw_pages(v)), profile.profile_headings(nodes(v, "survey"))
    return raw.withColumn("title", F.coalesce("title", F.lit(""))).unionByName(survey)


_NONE_FOUND = "'見つかりませんでした|0件|該当する求人|検索結果なし'"


@query("flag_no_results", f"""
  SELECT page_no AS page_id, bool_or(regexp_matches(title || '</a>' || location || company, {_NONE_FOUND})) AS no_results FROM v_card GROUP BY 1
  UNION ALL SELECT page_id, regexp_matches(html, {_NONE_FOUND}) FROM pages
  UNION ALL SELECT page_no, page_no % 6 < 4 OR bool_or(regexp_matches(CASE WHEN id % 2 = 0 THEN title ELSE '' END || '#' || CASE WHEN id % 3 = 0 THEN company ELSE '' END
    || '#' || CASE WHEN id % 5 = 0 THEN location ELSE '' END, {_NONE_FOUND})) FROM v_card GROUP BY 1""")
def _(v):
    words = ["tag", "text"]
    parts = [nodes(v, "doda", words), raw_pages(v, words), nodes(v, "survey", words)]
    return boards.union_sources([profile.flag_no_results(p) for p in parts])


@query("dom_outline", """
  SELECT page_no AS page_id, cast(1 as int) AS depth, 'div' AS tag, 'list' AS class, 1::bigint AS found FROM v_card GROUP BY 1
  UNION ALL SELECT page_no, 2, 'article', 'jobCard', count(*) FROM v_card GROUP BY 1
  UNION ALL SELECT page_no, 3, 'div', 'jobCard-body', count(*) FROM v_card GROUP BY 1""")
def _(v):
    rows = profile.dom_outline(nodes(v, "doda", ["nid", "tag", "attrs", "parent"]))
    return rows.groupBy("page_id", "depth", "tag", "class").agg(F.count(F.lit(1)).alias("found"))


query("dom_outline_pages")(lambda v: profile.dom_outline(raw_pages(v)))


@query("page_text", r"""
  SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, md5(trim(regexp_extract(html, '<a href="([^"]*)">', 1))) AS first_link FROM pages""")
def _(v):
    n = c("nodes")
    first = dom.first_node(n, lambda x: x["tag"] == "a")
    return raw_pages(v).select(
        "page_id", F.size(F.filter(n, lambda x: x["tag"] == "p")).cast("bigint").alias("paragraphs"),
        F.md5(tx.strip(dom.attr(first, "href"))).alias("first_link"))
