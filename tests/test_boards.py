import time

import pytest
from pyspark.sql import functions as F

from postloom.sources import boards, dom, paging, profile
from postloom.sources.state import state_json


def pages(spark, *htmls):
    return dom.with_nodes(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string"))


def records(spark, extract, *htmls):
    return [r.asDict() for r in extract(pages(spark, *htmls)).orderBy("page_id", "pos").collect()]


DODA = """<html><body><article><h2>ACME</h2><a href="/DodaFront/View/JobSearchDetail/j_jid__12/">ACME Engineer</a>
<div class="x jobCard-body"><dl><dt><span>勤務地</span></dt><dd> 東京都 </dd></dl><dl><dt><span>給与</span></dt><dd>年収400万円</dd></dl></div></article>
<article><a href="/DodaFront/View/JobSearchDetail/other/">no id</a></article><article><h2>no link</h2></article>
<article><a href="https://doda.jp/DodaFront/View/JobSearchDetail/j_jid__13/">Bare</a></article></body></html>"""


def test_doda(spark):
    first, second = records(spark, boards.cards_doda, DODA)
    assert (first["job_id"], first["title"], first["company"], first["location"]) == ("12", "Engineer", "ACME", "東京都")
    assert (first["salary_text"], first["salary_annual_min"]) == ("年収400万円", 4_000_000)
    assert first["description"] == "勤務地 東京都 給与 年収400万円"
    assert first["url"] == "https://doda.jp/DodaFront/View/JobSearchDetail/j_jid__12/"
    assert (second["job_id"], second["company"], second["location"], second["description"]) == ("13", None, None, "")


def test_green_climbs_to_enough_text_and_shares_ancestors(spark):
    short = '<div class="c"><a href="/job/1">one</a></div><div class="c"><a href="/job/2">two</a></div>'
    page = f'<html><body><div class="list">{short}<p>{"x" * 101}</p></div><div><a href="/job/3">lone</a></div></body></html>'
    got = records(spark, boards.cards_green, page)
    # both short cards end at the list, whose first link is job 1; the lone link never finds enough text
    assert [r["job_id"] for r in got] == ["1", "1"]


def test_ancestors_by_climbing(spark):
    html = '<body class="a"><div class="a b"><div class="c">' + "<p>" * 1 + '<span class="a">' + '<a href="x">t</a></span></p></div></div></body>'
    n = F.col("nodes")
    link = dom.first_node(n, lambda x: x["tag"] == "a")
    css = lambda name: (lambda x: dom.has_class(x, name))
    rows = pages(spark, html, "<a>top</a>", "none").select(
        dom.nearest_above(n, link, css("a"))["tag"].alias("near"), dom.outermost_above(n, link, css("a"))["tag"].alias("far"),
        dom.nearest_above(n, link, css("zz"), css("b"))["depth"].alias("second"),
        *[dom.nearest_within(n, link, css("b"), k, lambda x: x["tag"] == "p")["tag"].alias(f"w{k}") for k in (2, 3)]).collect()
    assert [tuple(r) for r in rows] == [("span", "body", 1, None, "div"), (None,) * 5, (None,) * 5]


def test_links_cost_in_proportion(spark):
    """Twice the links on a page, at most 2.2 times the time."""
    def seconds(links):
        cards = "".join(f'<div class="c"><p>{"x" * 101}</p><div><a href="/job/{i}">t</a></div></div>' for i in range(links))
        rows = boards.cards_green(pages(spark, f"<html><body><div>{cards}</div></body></html>"))
        best = 1e9
        for _ in range(3):
            start = time.time()
            assert len(rows.select("job_id").collect()) == links
            best = min(best, time.time() - start)
        return best

    seconds(200)
    assert seconds(4000) < 2.2 * seconds(2000) + 0.3


def test_only_wanted_fields(spark):
    frame = spark.createDataFrame([(1, '<p class="x">t</p>')], "page_id long, html string")
    assert dom.with_nodes(frame, ["tag", "text"]).first()["nodes"][1].asDict() == {"tag": "#text", "text": "t"}
    assert set(dom.with_nodes(frame).first()["nodes"][0].asDict()) == set(dom.FIELDS)


def test_last_value_of_a_repeated_key_counts(spark):
    state = ('{"Project:1":{"id":1,"title":"old","title":"new"},"Project:2":{"id":2,"title":"gone"},"Company:9":{"name":"a"},'
             '"Project:2":{"id":2,"title":"kept","company":{"id":"8","id":"9"}},"Company:9":{"name":"b"}}')
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")  # as in a session of the caller's own
    rows = records(spark, boards.cards_wantedly, f"<script>window.__APOLLO_STATE__ = {state};</script>")
    assert [(r["job_id"], r["title"], r["company"]) for r in rows] == [("1", "new", ""), ("2", "kept", "b")]


def test_green_fields(spark):
    page = ('<html><body><div><p>New</p><p>株式会社テスト</p><a href="/job/77?x=1">シニアエンジニアを広く募集しています</a>'
            '<p>東京都 港区</p><p>400万円〜600万円</p><p>' + "あ" * 90 + '</p></div></body></html>')
    (row,) = records(spark, boards.cards_green, page)
    assert row["company"] == "株式会社テスト" and row["location"] == "東京都 港区"
    assert row["title"] == "シニアエンジニアを広く募集しています"
    assert (row["salary_annual_min"], row["salary_annual_max"]) == (4_000_000, 6_000_000)
    assert row["url"] == "https://www.green-japan.com/job/77?x=1"


def indeed(extra, jk='data-jk="k1"'):
    return (f'<html><body><div class="job_seen_beacon"><a class="jcs-JobTitle z" {jk} href="/rc?x">Title</a>'
            f'<span data-testid="company-name">C</span><div>月給 30万円</div>{extra}</div></body></html>')


@pytest.mark.parametrize("extra,text", [
    ('<div class="job-snippet">S</div><table class="jobCardShelfContainer"><tr><td>T</td></tr></table>', "S"),
    ('<table class="jobCardShelfContainer"><tr><td>T</td></tr></table>', "T"),
    ('<div class="job-snippet"></div><table class="jobCardShelfContainer"><tr><td>T</td></tr></table>', "Title C 月給 30万円 T"),
    ("", "Title C 月給 30万円"),
])
def test_indeed_description(spark, extra, text):
    (row,) = records(spark, boards.cards_indeed, indeed(extra))
    assert row["description"] == text and row["salary_text"] == "月給 30万円" and row["salary_annual_min"] == 3_600_000


def test_indeed_without_id(spark):
    assert records(spark, boards.cards_indeed, indeed("", "")) == []


def test_wantedly_state_and_choice(spark):
    state = ('<html><head><script>window.__APOLLO_STATE__ = {bad};</script><script>window.__APOLLO_STATE__ = '
             '{"Project:9":{"id":9,"title":"Nine","company":{"id":"c1"},"excerpt":"","description":"long"},"Company:c1":{"name":"N"},'
             '"Project:0":{"id":0,"title":"zero"},"Project:x":"text","Project:10":{"id":"10","company":{"id":"none"},"excerpt":"e"}};'
             '</script></head><body><a href="/projects/55">never read here</a></body></html>')
    links = '<html><body><div><a href="/projects/55?a=b">Long enough</a></div></body></html>'
    got = records(spark, boards.cards_wantedly, state, links)
    assert [(r["page_id"], r["job_id"], r["title"], r["company"], r["description"]) for r in got] == [
        (0, "9", "Nine", "N", "long"), (0, "10", "", "", "e"), (1, "55", "Long enough", "", "")]
    assert got[2]["url"] == "https://www.wantedly.com/projects/55"


def test_short_first_link_hides_later_ones(spark):
    page = ('<html><body><div class="project"><div class="card"><a href="/projects/1">abc</a><a href="/projects/1">A longer title</a>'
            '<a href="/projects/2">Second title 3 エントリー</a><p class="xCompanyName">Co</p></div></div></body></html>')
    (html,), (rendered,) = records(spark, boards.cards_wantedly_html, page), records(spark, boards.cards_wantedly_dom, page)
    assert html["title"] == "Second title 3 エントリー" and rendered["title"] == "Second title"
    assert html["company"] == rendered["company"] == "Co"


def test_state_json_absent(spark):
    got = pages(spark, "<body>x</body>").select(state_json(F.col("nodes")).alias("s")).first()["s"]
    assert got is None


def test_flattening(spark):
    html = "<div><p>a<p>b<br>c</div><ul><li>x<li>y</ul>t<script>1<2</script><!-- no -->"
    (nodes,) = [r["nodes"] for r in pages(spark, html).collect()]
    by_tag = [n["tag"] for n in nodes]
    assert by_tag == ["div", "p", "#text", "p", "#text", "br", "#text", "ul", "li", "#text", "li", "#text",
                      "#text", "script", "#raw", "#comment"]
    assert [n["size"] for n in nodes if n["tag"] in ("div", "ul", "li")] == [7, 5, 2, 2]
    assert nodes[0]["text_len"] == 3 and nodes[1]["only"] == "a" and nodes[13]["only"] == "1<2"


def test_broken_and_empty_pages(spark):
    got = pages(spark, None, "", "</p></x><b><i>t</b>u", "<a href>x</a>").select("page_id", F.size("nodes").alias("n")).collect()
    assert {r["page_id"]: r["n"] for r in got} == {0: 0, 1: 0, 2: 4, 3: 2}


def test_deep_pages_stay_small(spark):
    deep = "<div>" * 4000 + "x"
    row = pages(spark, deep).select(F.size("nodes").alias("n"), F.get("nodes", 4000)["parent"].alias("p"), F.get("nodes", 0)["size"].alias("s")).first()
    assert tuple(row) == (4001, 3999, 4001)


def test_paging(spark):
    htmls = ['<a href="?p=2"><b>次へ</b></a>', '<a href="/l?page=10">10</a>', "<a>次</a>", '<a href="/x">NEXT page</a>', "<p>次</p>"]
    p = pages(spark, *htmls)
    got = p.select(
        "page_id", paging.next_link_text(F.col("nodes")).alias("t"),
        paging.next_link_page_no(F.col("nodes"), F.lit(0)).alias("n"), paging.has_next(F.col("nodes"), F.lit(0)).alias("h"),
    ).orderBy("page_id").collect()
    assert [r["t"] for r in got] == ["https://doda.jp?p=2", None, None, None, None]
    assert [r["n"] for r in got] == [None, "https://www.green-japan.com/l?page=10", None, None, None]
    assert [r["h"] for r in got] == [True, True, True, True, False]


def test_next_testid(spark):
    bar = '<nav aria-label="pagination"><a aria-label="次" href="">x</a><a aria-label="次のページ" href="/j?s=2">y</a></nav>'
    p = pages(spark, '<a data-testid="pagination-page-next" href="/j?s=1">n</a>' + bar, bar, "<p>no</p>")
    got = [r[0] for r in p.orderBy("page_id").select(paging.next_link_testid(F.col("nodes"))).collect()]
    assert got == ["https://jp.indeed.com/j?s=1", "https://jp.indeed.com/j?s=2", None]


def test_page_cap_and_stop(spark):
    rows = spark.createDataFrame(
        [("a", i, None if i == 3 else "u") for i in range(1, 9)] + [("b", i, "u") for i in range(1, 9)],
        "source string, page_no int, next_url string")
    kept = paging.page_cap(rows, 5, next_url="next_url").groupBy("source").count().collect()
    assert {r[0]: r[1] for r in kept} == {"a": 3, "b": 5}
    seen = spark.createDataFrame([("s", 1, 1), ("s", 1, 2), ("s", 2, 2), ("s", 3, 3)], "source string, page_no int, job_id int")
    got = paging.page_stop_empty(seen).orderBy("page_no").collect()
    assert [(r["page_no"], r["new_ids"]) for r in got] == [(1, 2), (2, 0)]


def test_profiles(spark):
    p = pages(spark, '<html><head><title> T </title></head><body><div class="JobCard list-item"><h2>A heading long enough</h2>'
                     '<section id="s"><p><div class="hidden"></div></p></section></div><a class="next" rel="next" href="/Page/2">n</a>'
                     '検索結果なし</body></html>')
    assert {r[0]: r[1] for r in profile.profile_selectors(p).collect()} == {
        "article": 0, "div_job": 1, "div_card": 1, "div_list_item": 1, "li_job": 0, "div_jobcard": 0, "div_searchlist": 0}
    assert {r[0]: r[1] for r in profile.profile_pagination(p).collect() if r[1]} == {"a_next": 1, "a_rel_next": 1, "a_href_page": 1}
    head = profile.profile_headings(p).first()
    assert (head["headings"], head["title"]) == (1, "T")
    assert profile.flag_no_results(p).first()["no_results"]
    outline = [(r["depth"], r["tag"]) for r in profile.dom_outline(p).orderBy("nid").collect()]
    assert outline[:2] == [(1, "div"), (2, "section")]


def test_registry_takes_new_boards(spark):
    boards.register_extractor("twin", lambda p: boards.cards_doda(p))
    try:
        rows = spark.createDataFrame([(1, "twin", DODA), (2, "doda", DODA)], "page_id long, source string, html string")
        got = boards.extract_all(rows, ["doda", "twin"]).groupBy("page_id").count().collect()
        assert {r[0]: r[1] for r in got} == {1: 2, 2: 2}
    finally:
        del boards.EXTRACTORS["twin"]
