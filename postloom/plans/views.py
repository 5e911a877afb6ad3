"""Posting tables derived from the driver's tables, in Spark and in SQL.

Each view is a method of ``Views`` and an entry of ``SQL`` with the same
name and columns.  Everything is computed from whole tables.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.text import fingerprint
from postloom.session import written
from postloom.sources.tables import spread

# Fixed values of the derivation.
VOCABULARY = "small hot widget gear plate red blue bolt large rod ring gizmo old cold anvil new".split()
SEARCH_WORDS = [
    "デザイナー", "設計", "エンジニア", "PM", "人事", "python", "ディレクター", "セールス", "営業",
    "バックオフィス", "UX デザイナー", "マーケター",
]
PLACES = ["東京", "大阪", "リモート", "New York/東"]
TITLES = ["デザイナー", "エンジニア", "募集", "staff"]
CITIES = ["東京都", "大阪府", "福岡市", "在宅勤務"]
GREEN_FILL = "文" * 101
# Postings on the pages that one task reads.
POSTINGS_PER_TASK = 20_000


def pick(words: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), index.cast("int"))


def when_not(key: Column, divisor: int, value: Column) -> Column:
    return F.when(key % divisor != 0, value)


def days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def salary_text(key: Column, price: Column) -> Column:
    lo, hi = (price / 1000).cast("bigint").cast("string"), (price / 800).cast("bigint").cast("string")
    kind = key % 8
    return (
        F.when(kind == 1, F.concat(F.lit("年収"), lo, F.lit("万円～"), hi, F.lit("万円")))
        .when(kind == 2, F.concat(F.lit("月給"), lo, F.lit("万円～"), hi, F.lit("万円")))
        .when(kind == 3, F.concat(lo, F.lit("万円〜"), hi, F.lit("万円")))
        .when(kind == 4, F.concat(F.lit("＜予定年収＞"), lo, F.lit("万円～1,200万円")))
        .when(kind == 5, F.concat(F.lit("月給"), lo, F.lit("万円 年収"), hi, F.lit("万円")))
        .when(kind == 6, "応相談").when(kind == 7, "380,000円")
    )


class Views:
    """Lazily built DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def v_jobs(self) -> DataFrame:
        key, price = F.col("o_orderkey"), F.col("o_totalprice")
        lines = (
            self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("l_orderkey").agg(
                F.min_by(F.concat_ws(" ", "p_name", "p_type"), F.col("l_partkey")).alias("title"),
                F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("description"),
            )
        )
        customer = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        rows = (
            self.table("orders").join(lines, key == F.col("l_orderkey"))
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        )
        board = F.col("o_orderpriority")
        return rows.select(
            key.alias("id"), "title", F.col("c_name").alias("company"), "description",
            salary_text(key, price).alias("salary_text"),
            F.when((key % 7 != 0) & (key % 11 != 0), (price * 0.8).cast("bigint")).alias("salary_annual_min"),
            when_not(key, 7, price.cast("bigint")).alias("salary_annual_max"),
            F.col("n_name").alias("location"),
            F.concat(F.lit("https://"), F.lower(F.left(board, F.lit(1))), F.lit(".example.com/job/"),
                     key.cast("string")).alias("url"),
            board.alias("job_board"),
            F.col("o_orderdate").alias("scraped_at"), F.col("o_orderdate").alias("updated_at"),
            when_not(key, 10, fingerprint(F.col("title"), F.col("c_name"), board)).alias("fingerprint"),
            when_not(key, 13, F.col("o_orderdate") + days(key % 30)).alias("last_seen_at"),
            (F.col("o_orderstatus") != "F").alias("is_active"),
        )

    @cached_property
    def v_criteria(self) -> DataFrame:
        key, price = F.col("o_orderkey"), F.col("o_totalprice")
        return self.table("orders").select(
            key.alias("id"), F.col("o_custkey").alias("user_id"),
            when_not(key, 17, F.array(*[pick(VOCABULARY, key * f % 16) for f in (1, 3, 7)])).alias("keywords"),
            when_not(key, 19, F.array(
                F.concat(F.lit("nation_"), (key % 25).cast("string")),
                F.concat(F.lit("NATION_"), (key * 7 % 25).cast("string")),
            )).alias("locations"),
            when_not(key, 5, (price * 0.5).cast("bigint")).alias("min_salary"),
            when_not(key, 3, (price * 1.1).cast("bigint")).alias("max_salary"),
            F.when(key % 4 == 1, True).when(key % 4 == 2, False).alias("remote_preference"),
            F.col("o_orderdate").alias("updated_at"),
        )

    @cached_property
    def v_users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("id"), F.col("c_name").alias("name"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            when_not(key, 4, F.concat(F.lit("tok-"), key.cast("string"))).alias("access_token"),
        )

    @cached_property
    def v_matches(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("id"), F.col("o_custkey").alias("user_id"), key.alias("job_id"),
            ((key * 7 % 101) / 100).alias("match_score"), F.col("o_orderdate").alias("matched_at"),
        )

    @cached_property
    def v_posts(self) -> DataFrame:
        """Incoming records, one per order line; ``seq`` is the arrival order."""
        line = F.col("l_linenumber")
        rows = (
            spread(self.table("lineitem"))
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        )
        return rows.select(
            F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                     "l_extendedprice").alias("seq"),
            F.when(F.col("l_quantity") != 13, F.concat_ws(" ", "p_name", "p_type")).alias("title"),
            F.when(line % 3 == 0, F.concat(F.lit("株式会社 "), F.col("s_name")))
            .when(line % 3 == 1, F.upper("s_name")).otherwise(F.col("s_name")).alias("company"),
            F.col("p_brand").alias("description"),
            salary_text(F.col("o_orderkey"), F.col("o_totalprice")).alias("salary_text"),
            F.lit(None).cast("bigint").alias("salary_annual_min"),
            F.lit(None).cast("bigint").alias("salary_annual_max"),
            F.col("l_returnflag").alias("location"),
            F.concat(
                F.lit("https://"), F.left("o_orderpriority", F.lit(1)), F.lit(".example.com/job/"),
                F.col("l_orderkey").cast("string"),
                F.when(line == 1, "").otherwise(F.concat(F.lit("/"), line.cast("string"))),
            ).alias("url"),
            F.col("o_orderpriority").alias("job_board"),
        )

    @cached_property
    def v_known(self) -> DataFrame:
        """Postings stored before ``v_posts`` arrive: finished orders, first part of each."""
        key = F.col("o_orderkey")
        first = (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("l_orderkey").agg(F.min(F.struct(
                "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
                F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("s_name").alias("company"),
            )).alias("f"))
            .select("l_orderkey", "f.title", "f.company")
        )
        rows = self.table("orders").where("o_orderstatus = 'F'").join(first, key == F.col("l_orderkey"))
        board = F.col("o_orderpriority")
        none = F.lit(None)
        return rows.select(
            key.alias("id"), "title", "company", none.cast("string").alias("description"),
            none.cast("string").alias("salary_text"), none.cast("bigint").alias("salary_annual_min"),
            none.cast("bigint").alias("salary_annual_max"), none.cast("string").alias("location"),
            F.concat(F.lit("https://"), F.left(board, F.lit(1)), F.lit(".example.com/job/"),
                     key.cast("string")).alias("url"),
            board.alias("job_board"), F.col("o_orderdate").alias("scraped_at"),
            F.col("o_orderdate").alias("updated_at"),
            when_not(key, 10, fingerprint(F.col("title"), F.col("company"), board)).alias("fingerprint"),
            when_not(key, 13, F.col("o_orderdate")).alias("last_seen_at"),
            (key % 3 != 0).alias("is_active"),
        )

    @cached_property
    def known(self) -> DataFrame:
        """``v_known`` written once: the lookups of a load share the joins below it."""
        return written(self.v_known, "known")

    @cached_property
    def v_salary(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            salary_text(F.col("o_orderkey"), F.col("o_totalprice")).alias("salary_text"),
        )

    @cached_property
    def v_runs(self) -> DataFrame:
        scraped = F.get_json_object("props", "$.k").cast("bigint")
        failed = F.col("event_type") == "error"
        return self.table("events").select(
            F.col("event_type").alias("name"), (~failed).alias("success"),
            scraped.alias("jobs_scraped"), (scraped - F.floor(scraped / 3)).alias("jobs_added"),
            F.floor(scraped / 3).alias("duplicates"), F.when(failed, 1).otherwise(0).cast("bigint").alias("errors"),
            F.col("value").alias("duration_seconds"),
            F.when(failed, F.concat(F.lit("fetch failed for user "), F.col("user_id").cast("string"),
                                    F.lit(" while reading the result page"))).alias("error_message"),
        )

    @cached_property
    def v_settings(self) -> DataFrame:
        """Per-source settings text, one source per customer."""
        key = F.col("c_custkey")
        text = F.concat_ws(",", *[F.when(key % d == r, part) for d, r, part in (
            (3, 0, F.lit('"enabled":true')), (3, 1, F.lit('"enabled":false')),
            (4, 1, F.concat(F.lit('"keywords":["'), pick(SEARCH_WORDS, key % 12), F.lit('","'),
                            pick(SEARCH_WORDS, key * 5 % 12), F.lit('"]'))),
            (5, 2, F.concat(F.lit('"location":"'), pick(PLACES, key % 4), F.lit('"'))),
            (5, 3, F.lit('"location":null')),
            (7, 4, F.concat(F.lit('"max_pages":'), (key % 9 + 1).cast("string"))),
        )])
        return self.table("customer").select(
            F.col("c_name").alias("source"), key.alias("key"),
            F.concat(F.lit("{"), text, F.lit("}")).alias("settings"),
        )

    @cached_property
    def v_searches(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("id"),
            F.array(*[pick(SEARCH_WORDS, key * f % 12) for f in (1, 5, 7)]).alias("keywords"),
            when_not(key, 3, pick(PLACES, key % 4)).alias("location"),
            (key % 3 + 1).cast("int").alias("max_pages"),
        )

    @cached_property
    def v_forms(self) -> DataFrame:
        """Settings forms as typed by users: blanks, stray spaces, text in number fields."""
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("updated_at"),
            F.when(key % 6 == 0, "").when(key % 6 == 1, " , ,").otherwise(F.concat(
                F.lit(" "), pick(VOCABULARY, key % 16), F.lit(" ,,"), pick(VOCABULARY, key * 3 % 16), F.lit(",  "),
            )).alias("keywords"),
            F.when(key % 4 == 0, None).otherwise(F.concat(F.lit("nation_"), (key % 25).cast("string"))).alias("locations"),
            F.when(key % 5 == 0, "").when(key % 5 == 1, "abc")
            .otherwise(F.concat(F.lit(" "), (key % 900).cast("string"))).alias("min_salary"),
            F.when(key % 3 == 0, None).otherwise((key % 1800).cast("string")).alias("max_salary"),
            F.when(key % 4 == 0, "").when(key % 4 == 1, "true").when(key % 4 == 2, "false").alias("remote_preference"),
        )

    @cached_property
    def v_pairs(self) -> DataFrame:
        """Stored matches with their posting and the user's latest criteria."""
        from postloom.operators.scoring import latest_criteria, prepare_jobs

        jobs = prepare_jobs(self.v_jobs).withColumnRenamed("id", "job_id")
        wanted = latest_criteria(self.v_criteria).select(
            "user_id", "keywords", "locations", "min_salary", "max_salary")
        return (
            self.v_matches.select("user_id", "job_id", "match_score").join(jobs, "job_id").join(wanted, "user_id")
        )

    @cached_property
    def v_card(self) -> DataFrame:
        """Postings as the boards would print them, with Japanese job and place words."""
        j, key = self.v_jobs, F.col("id")
        return j.select(
            key, F.floor(key / 50).cast("bigint").alias("page_no"),
            F.concat(F.col("title"), F.lit(" "), pick(TITLES, key % 4)).alias("title"),
            F.when(key % 3 == 0, F.concat(F.lit("株式会社"), F.col("company"))).otherwise(F.col("company")).alias("company"),
            F.concat(pick(CITIES, key * 3 % 4), F.lit(" "), F.col("location")).alias("location"),
            "salary_text", "description",
        )

    @cached_property
    def cards(self) -> DataFrame:
        """``v_card`` written once: the boards of a query share the joins below it."""
        return written(self.v_card, "cards")

    def board_pages(self, board: str) -> DataFrame:
        """Result pages of a board with the postings of ``v_card``, 50 ids to a page."""
        card, tail = CARDS[board]
        # a page costs far more to read than its bytes suggest, so rows count here: tasks follow the
        # postings, and the cards are dealt out by page before they are printed, not the pages after
        tasks = max(2 * self.spark.sparkContext.defaultParallelism, -(-self.cards.count() // POSTINGS_PER_TASK))
        pages = self.cards.repartition(tasks, "page_no").groupBy("page_no").agg(
            F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("id"), card().alias("html")))), lambda c: c["html"]
            ), "," if board == "wantedly_state" else "").alias("cards"))
        head, foot = PAGE_FRAMES.get(board, ("<html><body><div class=\"list\">", "</div>"))
        return pages.select(
            F.col("page_no").alias("page_id"), F.lit(board).alias("source"), "page_no",
            F.concat(F.lit(head), "cards", F.lit(foot), tail(), F.lit("</body></html>")).alias("html"),
        )


def _html(*parts) -> Column:
    """Concatenate literal text and columns; (name,) is a column, null as ''."""
    return F.concat(*[
        F.lit(p) if isinstance(p, str) else F.coalesce((F.col(p[0]) if isinstance(p, tuple) else p).cast("string"), F.lit(""))
        for p in parts
    ])


def _doda_card() -> Column:
    pay = F.when(F.col("salary_text").isNotNull(), _html(
        "<dl><dt><span>給与</span></dt><dd>", ("salary_text",), "</dd></dl>"))
    return _html(
        '<article class="jobCard"><h2>', ("company",), '</h2><a href="/DodaFront/View/JobSearchDetail/j_jid__', ("id",),
        '/">', ("company",), ("title",), '</a><div class="jobCard-body"><dl><dt><span>勤務地</span></dt><dd>',
        ("location",), "</dd></dl>", pay, "<p>", ("description",), "</p></div></article>")


def _green_card() -> Column:
    pay = F.when(F.col("salary_text").isNotNull(), _html("<p>", ("salary_text",), "</p>"))
    return _html(
        '<div class="card"><p>New</p><p>', ("company",), '</p><div class="inner"><a href="/job/', ("id",), '">',
        ("title",), "</a></div><p>", ("location",), "</p>", pay, "<p>", ("description",), " " + GREEN_FILL, "</p></div>")


def _indeed_card() -> Column:
    key = F.col("id")
    pay = F.when(F.col("salary_text").isNotNull(), _html("<div>", ("salary_text",), "</div>"))
    jk = F.when(key % 5 != 0, _html(' data-jk="jk', ("id",), '"'))
    text = F.when(key % 3 == 0, _html('<div class="job-snippet">', ("description",), "</div>")).when(
        key % 3 == 1, _html('<table class="jobCardShelfContainer"><tr><td>', ("description",), "</td></tr></table>"))
    return _html(
        '<div class="job_seen_beacon"><h2><a class="jcs-JobTitle css-1"', jk, ' href="/rc/clk?jk=', ("id",), '">', ("title",),
        '</a></h2><span data-testid="company-name">', ("company",), '</span><div data-testid="text-location">',
        ("location",), "</div>", pay, text, "</div>")


def _state_card() -> Column:
    key = F.col("id")
    firm = F.when(key % 4 != 3, _html(',"Company:c', ("id",), '":{"name":"', ("company",), '"}'))
    return _html(
        '"Project:', ("id",), '":{"id":', ("id",), ',"title":"', ("title",), '","company":{"id":"c', ("id",),
        '"},"locationName":"', ("location",), '","excerpt":"',
        F.when(key % 2 == 0, F.col("description")), '","description":"', ("title",), '"}', firm)


def _link_card() -> Column:
    return _html(
        '<div class="project-card"><a href="/projects/', ("id",), '?ref=x">', ("title",), " ", F.col("id") % 9,
        ' エントリー</a><p class="company-name">', ("company",), "</p></div>")


def _survey_card() -> Column:
    """One posting in each of the containers, for a part of the postings that differs by container."""
    key = F.col("id")

    def some(divisor: int, *parts) -> Column:
        return F.when(key % divisor == 0, _html(*parts))

    return _html(
        some(2, '<ul><li class="Job row"><h3>', ("title",), "</h3></li></ul>"),
        some(3, '<div class="result-LIST item">', ("company",), "</div>"),
        some(5, '<div class="jobCard wide">', ("location",), "</div>"), some(7, '<div class="x searchList">x</div>'),
        some(11, '<article class="box"><h2>short</h2></article>'),
        some(13, '<script type="application/ld+json">{"id":', ("id",), '}</script><script type="text/plain">x</script>'))


def _survey_tail() -> Column:
    page = F.col("page_no")

    def some(divisor: int, *parts) -> Column:
        return F.when(page % divisor == 0, _html(*parts))

    return _html(
        some(2, '<nav class="Pagination"><a class="btn nextLink" href="/p">x</a></nav>'),
        some(3, '<ul class="pager"><li>1</li></ul>'), some(4, '<div class="my-pag"></div>'),
        some(5, '<a rel="nofollow next" href="/x">y</a><a rel="nextish">z</a>'), some(7, '<a href="/list?PAGE=2">2</a>'),
        "<title> Page ", ("page_no",), " </title>",
        F.when(page % 6 == 0, "<p>お探しの求人は見つかりませんでした</p>").when(page % 6 == 1, "<p>検索結果 <b>0件</b></p>")
        .when(page % 6 == 2, "<p>該当する<b>求人</b></p>").when(page % 6 == 3, "<p>検索結果なし</p>")
        .when(page % 6 == 4, "<!-- 検索結果なし --><p>検索 結果なし</p>"))


def _tail(make):
    """Next link on all but every seventh page."""
    def tail() -> Column:
        page = F.col("page_no")
        return F.when(page % 7 != 0, make(page)).otherwise("")

    return tail


CARDS = {
    "doda": (_doda_card, _tail(lambda p: _html('<a href="/DodaFront/list?page=', p + 1, '">次へ</a>'))),
    "green": (_green_card, _tail(lambda p: _html('<a href="/search_key?page=', p + 1, '">', p + 1, "</a>"))),
    "indeed": (_indeed_card, _tail(lambda p: F.when(
        p % 2 == 0, _html('<a data-testid="pagination-page-next" href="/jobs?start=', p + 1, '">&gt;</a>')
    ).otherwise(_html('<nav aria-label="pagination"><a href="#">1</a><a aria-label="次のページ" href="/jobs?start=', p + 1, '">&gt;</a></nav>')))),
    "wantedly_state": (_state_card, _tail(lambda p: F.lit('<a href="/projects">Next</a>'))),
    "survey": (_survey_card, _survey_tail),
    "wantedly": (_link_card, _tail(lambda p: _html('<a href="/list?page=', p + 1, '">more</a>'))),
}
PAGE_FRAMES = {"wantedly_state": (
    "<html><head><script>var a = 1;</script><script>window.__APOLLO_STATE__ = {", "};</script></head><body>")}


def _vocab(index: str, words: list[str] = VOCABULARY) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + f"][1 + cast(({index}) % {len(words)} as int)]"


def sql_norm_match(c: str) -> str:
    return rf"regexp_replace(trim(lower(coalesce({c}, '')), E' \t\n\r　'), '[\s　]+', ' ', 'g')"


def sql_norm_fingerprint(c: str) -> str:
    out = rf"regexp_replace(regexp_replace({sql_norm_match(c)}, '^株式会社[\s　]*', ''), '[\s　]*株式会社$', '')"
    return f"trim(translate({out}, '【】[]（）()「」『』', ''))"


def sql_fingerprint(title: str, company: str, board: str) -> str:
    return (
        f"substr(sha256({sql_norm_fingerprint(title)} || '|' || {sql_norm_fingerprint(company)} "
        f"|| '|' || lower({board})), 1, 16)"
    )


def _sql_salary_text(key: str, price: str) -> str:
    lo, hi = f"cast(trunc({price}/1000) as bigint)", f"cast(trunc({price}/800) as bigint)"
    return f"""CASE {key} % 8
      WHEN 1 THEN '年収' || {lo} || '万円～' || {hi} || '万円'
      WHEN 2 THEN '月給' || {lo} || '万円～' || {hi} || '万円'
      WHEN 3 THEN {lo} || '万円〜' || {hi} || '万円'
      WHEN 4 THEN '＜予定年収＞' || {lo} || '万円～1,200万円'
      WHEN 5 THEN '月給' || {lo} || '万円 年収' || {hi} || '万円'
      WHEN 6 THEN '応相談' WHEN 7 THEN '380,000円' END"""


SQL = {
    "v_jobs": f"""
      SELECT o_orderkey AS id, title, c_name AS company, description,
        {_sql_salary_text('o_orderkey', 'o_totalprice')} AS salary_text,
        CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0
             THEN cast(trunc(o_totalprice*0.8::double) as bigint) END AS salary_annual_min,
        CASE WHEN o_orderkey % 7 <> 0 THEN cast(trunc(o_totalprice) as bigint) END AS salary_annual_max,
        n_name AS location,
        'https://' || lower(left(o_orderpriority,1)) || '.example.com/job/' || o_orderkey AS url,
        o_orderpriority AS job_board, o_orderdate AS scraped_at, o_orderdate AS updated_at,
        CASE WHEN o_orderkey % 10 <> 0 THEN {sql_fingerprint('title', 'c_name', 'o_orderpriority')} END AS fingerprint,
        CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate + to_days(cast(o_orderkey % 30 as int)) END AS last_seen_at,
        o_orderstatus <> 'F' AS is_active
      FROM orders
      JOIN (SELECT l_orderkey, arg_min(p_name || ' ' || p_type, l_partkey) AS title,
                   array_to_string(list_sort(list(DISTINCT p_name)), ' ') AS description
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON o_orderkey = l_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "v_criteria": f"""
      SELECT o_orderkey AS id, o_custkey AS user_id,
        CASE WHEN o_orderkey % 17 <> 0 THEN [{_vocab('o_orderkey')}, {_vocab('o_orderkey*3')}, {_vocab('o_orderkey*7')}] END AS keywords,
        CASE WHEN o_orderkey % 19 <> 0 THEN ['nation_' || (o_orderkey % 25), 'NATION_' || (o_orderkey*7 % 25)] END AS locations,
        CASE WHEN o_orderkey % 5 <> 0 THEN cast(trunc(o_totalprice*0.5::double) as bigint) END AS min_salary,
        CASE WHEN o_orderkey % 3 <> 0 THEN cast(trunc(o_totalprice*1.1::double) as bigint) END AS max_salary,
        CASE o_orderkey % 4 WHEN 1 THEN true WHEN 2 THEN false END AS remote_preference,
        o_orderdate AS updated_at FROM orders""",
    "v_latest": """
      SELECT * FROM v_criteria QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id DESC) = 1""",
    "v_users": """
      SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.com' AS email,
        CASE WHEN c_custkey % 4 <> 0 THEN 'tok-' || c_custkey END AS access_token FROM customer""",
    "v_matches": """
      SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey AS job_id,
        (o_orderkey * 7 % 101)::double / 100 AS match_score, o_orderdate AS matched_at FROM orders""",
    "v_posts": f"""
      SELECT {{'l_shipdate': l_shipdate, 'l_orderkey': l_orderkey, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey,
              'l_linenumber': l_linenumber, 'l_extendedprice': l_extendedprice}} AS seq,
        CASE WHEN l_quantity <> 13 THEN p_name || ' ' || p_type END AS title,
        CASE l_linenumber % 3 WHEN 0 THEN '株式会社 ' || s_name WHEN 1 THEN upper(s_name) ELSE s_name END AS company,
        p_brand AS description, {_sql_salary_text('o_orderkey', 'o_totalprice')} AS salary_text,
        l_returnflag AS location,
        'https://' || left(o_orderpriority,1) || '.example.com/job/' || l_orderkey ||
          CASE WHEN l_linenumber = 1 THEN '' ELSE '/' || l_linenumber END AS url,
        o_orderpriority AS job_board
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
      JOIN supplier ON l_suppkey = s_suppkey""",
    "v_known": f"""
      SELECT o_orderkey AS id, title, company, NULL::varchar AS description, NULL::varchar AS salary_text,
        NULL::bigint AS salary_annual_min, NULL::bigint AS salary_annual_max, NULL::varchar AS location,
        'https://' || left(o_orderpriority,1) || '.example.com/job/' || o_orderkey AS url,
        o_orderpriority AS job_board, o_orderdate AS scraped_at, o_orderdate AS updated_at,
        CASE WHEN o_orderkey % 10 <> 0 THEN {sql_fingerprint('title', 'company', 'o_orderpriority')} END AS fingerprint,
        CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS last_seen_at, o_orderkey % 3 <> 0 AS is_active
      FROM orders
      JOIN (SELECT l_orderkey, p_name || ' ' || p_type AS title, s_name AS company FROM lineitem
            JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
            QUALIFY row_number() OVER (PARTITION BY l_orderkey
              ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) = 1) ON o_orderkey = l_orderkey
      WHERE o_orderstatus = 'F'""",
    "v_salary": f"""
      SELECT o_orderkey AS id, {_sql_salary_text('o_orderkey', 'o_totalprice')} AS salary_text FROM orders""",
    "v_runs": """
      SELECT event_type AS name, event_type <> 'error' AS success, k AS jobs_scraped, k - k // 3 AS jobs_added,
        k // 3 AS duplicates, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors, value AS duration_seconds,
        CASE WHEN event_type = 'error' THEN 'fetch failed for user ' || user_id || ' while reading the result page' END AS error_message
      FROM (SELECT *, cast(json_extract_string(props, '$.k') as bigint) AS k FROM events)""",
    "v_settings": f"""
      SELECT c_name AS source, c_custkey AS key,
        CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS enabled,
        CASE WHEN c_custkey % 4 = 1 THEN [{_vocab('c_custkey', SEARCH_WORDS)}, {_vocab('c_custkey*5', SEARCH_WORDS)}] END AS keywords,
        c_custkey % 5 IN (2, 3) AS has_location,
        CASE WHEN c_custkey % 5 = 2 THEN {_vocab('c_custkey', PLACES)} END AS location,
        CASE WHEN c_custkey % 7 = 4 THEN c_custkey % 9 + 1 END AS max_pages FROM customer""",
    "v_searches": f"""
      SELECT c_custkey AS id,
        [{_vocab('c_custkey', SEARCH_WORDS)}, {_vocab('c_custkey*5', SEARCH_WORDS)}, {_vocab('c_custkey*7', SEARCH_WORDS)}] AS keywords,
        CASE WHEN c_custkey % 3 <> 0 THEN {_vocab('c_custkey', PLACES)} END AS location,
        c_custkey % 3 + 1 AS max_pages FROM customer""",
    "v_forms": f"""
      SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS updated_at,
        CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' , ,'
          ELSE ' ' || {_vocab('o_orderkey')} || ' ,,' || {_vocab('o_orderkey*3')} || ',  ' END AS keywords,
        CASE WHEN o_orderkey % 4 <> 0 THEN 'nation_' || (o_orderkey % 25) END AS locations,
        CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'abc' ELSE ' ' || (o_orderkey % 900) END AS min_salary,
        CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 1800)::varchar END AS max_salary,
        CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'true' WHEN 2 THEN 'false' END AS remote_preference FROM orders""",
    "v_pairs": """
      SELECT m.user_id, m.job_id, m.match_score, j.* EXCLUDE (id), c.keywords, c.locations, c.min_salary, c.max_salary
      FROM v_matches m JOIN v_jobs j ON j.id = m.job_id JOIN v_latest c ON c.user_id = m.user_id""",
    "v_card": f"""
      SELECT id, id // 50 AS page_no, title || ' ' || {_vocab('id', TITLES)} AS title,
        CASE WHEN id % 3 = 0 THEN '株式会社' || company ELSE company END AS company,
        {_vocab('id*3', CITIES)} || ' ' || location AS location, salary_text, description FROM v_jobs""",
}


def with_views(body: str) -> str:
    """Put the views a query names, and the views those name, in front of it."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                add(SQL[name])
                if name not in needed:
                    needed.append(name)

    add(body)
    if not needed:
        return body
    head = ",\n".join(f"{name} AS MATERIALIZED ({SQL[name]})" for name in needed)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {head},\n{body.lstrip()[5:]}"
    return f"WITH {head}\n{body}"
