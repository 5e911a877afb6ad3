"""Posting records from board pages.

Every extractor takes pages with ``nodes`` (``dom.with_nodes``) and gives one
row per record: the page columns, ``pos`` (order on the page) and the record
columns of ``schemas.RECORD``.  Cards are cut out as array slices, so a page
never leaves its row before its records do and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import salary as pay
from postloom.functions import text as tx
from postloom.functions.urls import BASE_URL, JOB_ID_PATTERN, job_id, strip_query, url_absolute
from postloom.schemas import RECORD_COLUMNS
from postloom.sources import dom
from postloom.sources.state import last_key_wins, state_json, state_projects

# Labels, marks and limits of the card rules.
PLACE_LABEL, PAY_LABEL = "勤務地", "給与"
GREEN_CLIMB, GREEN_MIN_TEXT = 8, 100
INDEED_PAY_STARTS = ["月給", "年収", "年俸"]
INDEED_PAY_AMOUNT = r"^[\d,]+万?円"
INDEED_PAY_MAX_TEXT = 100
WANTEDLY_MIN_TITLE, WANTEDLY_MAX_TITLE = 5, 200
ENTRY_COUNT = rf"\d+{tx.SPACE_CLASS}*エントリー"


def _page_columns(pages: DataFrame) -> list[str]:
    return [c for c in pages.columns if c != "nodes"]


def _cards(pages: DataFrame, cards: Column) -> DataFrame:
    """One row per element of ``cards``, as columns ``pos`` and ``card``."""
    return pages.select(*_page_columns(pages), F.posexplode(cards).alias("pos", "card"))


def _records(rows: DataFrame, keys: list[str], board: str, parse: Callable | None = None, **columns) -> DataFrame:
    if parse is not None:
        bounds = parse(F.col("salary_text"))
        columns["salary_annual_min"], columns["salary_annual_max"] = bounds["min"], bounds["max"]
    columns["job_board"] = F.lit(board)
    texts = rows.withColumns({k: v for k, v in columns.items() if not k.startswith("salary_annual")})
    full = texts.withColumns({k: v for k, v in columns.items() if k.startswith("salary_annual")})
    return full.select(*keys, "pos", *RECORD_COLUMNS)


def _absolute(href: Column, board: str) -> Column:
    return F.when(F.startswith(href, F.lit("http")), href).otherwise(url_absolute(href, BASE_URL[board]))


def label_value(nodes: Column, inside: Column, label: str) -> Column:
    """Text two levels above the first labelled span of a subtree, without the label."""
    span = dom.first_node(inside, lambda n: (n["tag"] == "span") & F.contains(n["only"], F.lit(label)))

    def around(found: Column) -> Column:
        holder = F.get(nodes, F.get(nodes, found["parent"])["parent"])
        text = F.when(holder.isNotNull(), dom.inner_text(dom.subtree(nodes, holder))).otherwise(dom.inner_text(nodes))
        return F.nullif(tx.strip(F.replace(text, F.lit(label), F.lit(""))), F.lit(""))

    return tx.bind(span, lambda s: F.when(s.isNotNull(), around(s)))


def cards_doda(pages: DataFrame) -> DataFrame:
    nodes = F.col("nodes")

    def card(article):
        inside = dom.subtree(nodes, article)
        return F.struct(
            inside.alias("nodes"),
            label_value(nodes, inside, PLACE_LABEL).alias("place"),
            label_value(nodes, inside, PAY_LABEL).alias("pay"),
        )

    rows = _cards(pages, F.transform(F.filter(nodes, lambda n: n["tag"] == "article"), card))
    inside = F.col("card.nodes")
    rows = rows.withColumns({
        "company": dom.text_of(inside, dom.first_node(inside, lambda n: n["tag"] == "h2")),
        "link": dom.first_node(
            inside, lambda n: (n["tag"] == "a") & F.contains(dom.attr(n, "href"), F.lit("JobSearchDetail"))
        ),
        "body": dom.first_node(inside, lambda n: (n["tag"] == "div") & dom.has_class(n, "jobCard-body")),
    }).where(F.col("link").isNotNull()).withColumn("url", _absolute(dom.attr(F.col("link"), "href"), "doda"))
    records = _records(
        rows, _page_columns(pages), "doda", pay.salary_doda,
        job_id=job_id(F.col("url"), "doda"),
        title=tx.title_strip_company(dom.text_of(inside, F.col("link")), F.col("company")),
        location=F.col("card.place"), salary_text=F.col("card.pay"),
        description=F.coalesce(dom.text_of(inside, F.col("body"), " "), F.lit("")),
    )
    return records.where(F.col("job_id").isNotNull())


def _job_links(nodes: Column, board: str) -> Column:
    pattern = JOB_ID_PATTERN[board]
    return F.filter(nodes, lambda n: (n["tag"] == "a") & dom.attr(n, "href").rlike(pattern))


def first_per_key(nodes: Column, key: Callable) -> Column:
    """Nodes whose key did not occur earlier in the array.

    Sorting by key puts repeats side by side, so a page with very many links
    costs n log n steps.
    """
    ranked = F.array_sort(F.transform(nodes, lambda n, i: F.struct(key(n).alias("k"), i.alias("i"))))

    def heads(sorted_keys):
        first = F.filter(sorted_keys, lambda x, j: (j == 0) | (F.get(sorted_keys, j - 1)["k"] != x["k"]))
        return F.transform(F.array_sort(F.transform(first, lambda x: x["i"])), lambda i: F.get(nodes, i))

    return tx.bind(ranked, heads)


def green_holders(nodes: Column) -> Column:
    """Per distinct job link, the nearest ancestor below body with enough text."""
    def holder(link):
        return dom.nearest_within(
            nodes, link, lambda n: n["text_len"] > GREEN_MIN_TEXT, GREEN_CLIMB, lambda n: n["tag"].isin("body", "html"))

    links = tx.bind(_job_links(nodes, "green"), lambda x: first_per_key(x, lambda n: dom.attr(n, "href")))
    return F.filter(F.transform(links, holder), lambda n: n.isNotNull())


def cards_green(pages: DataFrame) -> DataFrame:
    nodes = F.col("nodes")
    rows = _cards(pages, F.transform(green_holders(nodes), lambda n: dom.subtree(nodes, n)))
    card = F.col("card")
    rows = rows.withColumns({
        "url": _absolute(dom.attr(F.get(_job_links(card, "green"), 0), "href"), "green"),
        "lines": tx.text_lines(F.array_join(dom.text_pieces(card), "\n")),
    })
    lines = F.col("lines")
    return _records(
        rows, _page_columns(pages), "green", pay.salary_range_green,
        job_id=job_id(F.col("url"), "green"), title=tx.pick_title(lines), company=tx.pick_company(lines),
        location=tx.pick_location(lines), salary_text=tx.pick_salary(lines),
        description=F.array_join(lines, " "),
    ).where(F.col("job_id").isNotNull())


def salary_text_indeed(card: Column) -> Column:
    """First div below the card that reads like pay."""
    below = F.filter(F.slice(card, 2, F.greatest(F.size(card) - 1, F.lit(0))), lambda n: n["tag"] == "div")
    texts = F.transform(below, lambda n: dom.inner_text(dom.subtree(card, n)))

    def pays(text):
        start = text.rlike(INDEED_PAY_AMOUNT)
        for word in INDEED_PAY_STARTS:
            start = start | F.startswith(text, F.lit(word))
        return (F.length(text) < INDEED_PAY_MAX_TEXT) & start

    return F.get(F.filter(texts, pays), 0)


def desc_fallback(card: Column) -> Column:
    """Snippet text; without a snippet the shelf table; when empty the whole card."""
    snippet = dom.first_node(card, lambda n: (n["tag"] == "div") & dom.has_class(n, "job-snippet"))
    shelf = dom.first_node(card, lambda n: (n["tag"] == "table") & dom.has_class(n, "jobCardShelfContainer"))
    chosen = dom.text_of(card, F.coalesce(snippet, shelf), " ")
    return F.coalesce(F.nullif(chosen, F.lit("")), dom.inner_text(card, " "))


def cards_indeed(pages: DataFrame) -> DataFrame:
    nodes = F.col("nodes")
    beacons = F.filter(nodes, lambda n: (n["tag"] == "div") & dom.has_class(n, "job_seen_beacon"))
    rows = _cards(pages, F.transform(beacons, lambda n: dom.subtree(nodes, n)))
    card = F.col("card")

    def marked(name: str) -> Column:
        return dom.text_of(card, dom.first_node(card, lambda n: dom.attr(n, "data-testid") == name))

    rows = rows.withColumn(
        "link", dom.first_node(card, lambda n: (n["tag"] == "a") & dom.has_class(n, "jcs-JobTitle"))
    )
    href = dom.attr(F.col("link"), "href")
    return _records(
        rows.where(dom.attr(F.col("link"), "data-jk") != ""), _page_columns(pages), "indeed", pay.salary_indeed,
        job_id=dom.attr(F.col("link"), "data-jk"), title=dom.text_of(card, F.col("link")),
        company=marked("company-name"), location=marked("text-location"),
        salary_text=salary_text_indeed(card),
        url=F.when(href == "", href).otherwise(_absolute(href, "indeed")),
        description=desc_fallback(card),
    )


def _company_below(nodes: Column, holder: Column) -> Column:
    """Text of the first element under ``holder`` with company in a class; '' without one."""
    def named(n):
        css = dom.attr(n, "class")
        return F.contains(css, F.lit("company")) | F.contains(css, F.lit("Company"))

    below = dom.subtree(nodes, holder)
    found = tx.bind(below, lambda b: dom.inner_text(dom.subtree(b, F.get(F.filter(
        F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))), named), 0))))
    return F.when(holder.isNotNull(), F.coalesce(found, F.lit(""))).otherwise(F.lit(""))


def _project_links(nodes: Column, holder: Callable, title: Callable) -> Column:
    """First link per project id with its title and the company near it.

    A project counts as seen by its first link, however short the title.
    """
    links = tx.bind(_job_links(nodes, "wantedly"), lambda x: first_per_key(
        x, lambda n: F.regexp_extract(dom.attr(n, "href"), JOB_ID_PATTERN["wantedly"], 1)))
    return F.transform(links, lambda n: F.struct(
        dom.attr(n, "href").alias("href"),
        title(dom.subtree(nodes, n)).alias("title"),
        tx.bind(holder(n), lambda h: _company_below(nodes, h)).alias("company"),
    ))


def _wantedly_records(rows: DataFrame, keys: list[str]) -> DataFrame:
    null_pay = F.lit(None).cast("bigint")
    return _records(
        rows, keys, "wantedly", salary_text=F.lit(None).cast("string"),
        salary_annual_min=null_pay, salary_annual_max=null_pay,
        **{f: F.col(f"card.{f}") for f in ("job_id", "title", "company", "location", "url", "description")},
    )


def _wantedly_card(job_id: Column, title: Column, company: Column, location: Column, url: Column, text: Column) -> Column:
    return F.struct(
        job_id.alias("job_id"), title.alias("title"), company.alias("company"), location.alias("location"),
        url.alias("url"), text.alias("description"),
    )


def _link_cards(links: Column, title: Callable, url: Callable) -> Column:
    """Cards of project links whose own title is long enough."""
    long_enough = F.filter(links, lambda k: F.length(k["title"]) >= WANTEDLY_MIN_TITLE)
    return F.transform(long_enough, lambda k: _wantedly_card(
        job_id(k["href"], "wantedly"), F.left(title(k["title"]), F.lit(WANTEDLY_MAX_TITLE)), k["company"],
        F.lit(""), url(k["href"]), F.lit("")))


def _state_cards(state: Column) -> Column:
    return F.transform(state_projects(state), lambda p: _wantedly_card(
        p["id"], p["title"], p["company"], p["location"],
        F.concat(F.lit(BASE_URL["wantedly"] + "/projects/"), p["id"]), p["description"]))


def _html_cards(nodes: Column) -> Column:
    def holder(link):
        return dom.nearest_above(nodes, link, lambda n: n["tag"] == "div", lambda n: n["tag"] == "article")

    links = _project_links(nodes, holder, dom.inner_text)
    return _link_cards(links, lambda t: t, lambda href: _absolute(strip_query(href), "wantedly"))


def cards_wantedly_html(pages: DataFrame) -> DataFrame:
    """Records from project links of a static page."""
    return _wantedly_records(_cards(pages, _html_cards(F.col("nodes"))), _page_columns(pages))


def cards_wantedly_dom(pages: DataFrame) -> DataFrame:
    """Records from project links of a rendered page; entry counts leave the title."""
    nodes = F.col("nodes")

    def holder(link):
        def boxed(n):
            css = dom.attr(n, "class")
            return (n["tag"] == "div") & (F.contains(css, F.lit("project")) | F.contains(css, F.lit("card")))

        return dom.outermost_above(nodes, link, boxed)

    links = _project_links(nodes, holder, lambda b: tx.strip(tx.squeeze(dom.raw_text(b))))
    cards = _link_cards(
        links, lambda t: tx.strip(F.regexp_replace(t, ENTRY_COUNT, "")),
        lambda href: F.concat(F.lit(BASE_URL["wantedly"] + "/projects/"), job_id(href, "wantedly")))
    return _wantedly_records(_cards(pages, cards), _page_columns(pages))


def cards_wantedly_state(pages: DataFrame) -> DataFrame:
    """Records from the state object embedded in a page."""
    last_key_wins(pages.sparkSession)
    cards = tx.bind(state_json(F.col("nodes")), _state_cards)
    return _wantedly_records(_cards(pages, cards), _page_columns(pages))


def cards_wantedly(pages: DataFrame) -> DataFrame:
    """State records where a page has a state, link records elsewhere; pages are parsed once."""
    last_key_wins(pages.sparkSession)
    nodes = F.col("nodes")
    cards = tx.bind(state_json(nodes), lambda s: F.when(
        F.coalesce(F.size(s["entries"]), F.lit(0)) > 0, _state_cards(s)).otherwise(_html_cards(nodes)))
    return _wantedly_records(_cards(pages, cards), _page_columns(pages))


# name -> (pages with nodes -> records); further boards register here
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "doda": cards_doda,
    "green": cards_green,
    "indeed": cards_indeed,
    "wantedly": cards_wantedly,
    "wantedly_dom": cards_wantedly_dom,
}


def register_extractor(name: str, extract: Callable[[DataFrame], DataFrame]) -> None:
    EXTRACTORS[name] = extract


def union_sources(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def extract_all(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Records of all named sources; ``pages`` has html and a ``source`` column.

    Pages are filtered by source before they are parsed, as no filter passes
    the parser: each source parses its own pages only.
    """
    return union_sources([
        EXTRACTORS[name](dom.with_nodes(pages.where(F.col("source") == name))) for name in names or EXTRACTORS
    ])
