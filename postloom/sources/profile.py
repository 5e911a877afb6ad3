"""What the structure of landed pages looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import bind, contains_any
from postloom.sources import dom

# Patterns, phrases and limits of the page report.
NO_RESULT_PHRASES = ["見つかりませんでした", "0件", "該当する求人", "検索結果なし"]
STRUCTURE_TAGS = ["div", "section", "article", "main", "nav", "ul", "ol", "header", "footer"]
LINK_PATTERNS = ["/DodaFront/View/JobSearch", "/job/", "detail"]
TOP_CLASSES, SAMPLE_LINKS, LINK_TEXT, LINK_HREF = 10, 5, 50, 80
OUTLINE_DEPTH, OUTLINE_CLASS, OUTLINE_ID = 4, 40, 20


def _class_has(n: Column, *words: str) -> Column:
    css = F.lower(dom.attr(n, "class"))
    out = F.lit(True)
    for word in words:
        out = out & F.contains(css, F.lit(word))
    return out


def _tag(n: Column, *names: str) -> Column:
    return n["tag"].isin(*names)


CONTAINERS = {
    "article": lambda n: _tag(n, "article"),
    "div_job": lambda n: _tag(n, "div") & _class_has(n, "job"),
    "div_card": lambda n: _tag(n, "div") & _class_has(n, "card"),
    "div_list_item": lambda n: _tag(n, "div") & _class_has(n, "list", "item"),
    "li_job": lambda n: _tag(n, "li") & _class_has(n, "job"),
    "div_jobcard": lambda n: _tag(n, "div") & dom.has_class(n, "jobCard"),
    "div_searchlist": lambda n: _tag(n, "div") & dom.has_class(n, "searchList"),
}
PAGINATION = {
    "nav_pag": lambda n: _tag(n, "nav") & _class_has(n, "pag"),
    "ul_pag": lambda n: _tag(n, "ul") & _class_has(n, "pag"),
    "div_pag": lambda n: _tag(n, "div") & _class_has(n, "pag"),
    "a_next": lambda n: _tag(n, "a") & _class_has(n, "next"),
    "a_rel_next": lambda n: _tag(n, "a") & F.array_contains(F.split(dom.attr(n, "rel"), r"\s+"), "next"),
    "a_href_page": lambda n: _tag(n, "a") & F.contains(F.lower(dom.attr(n, "href")), F.lit("page")),
}


def _pattern_counts(pages: DataFrame, patterns: dict) -> DataFrame:
    counts = pages.agg(*[
        F.coalesce(F.sum(F.size(F.filter("nodes", rule))), F.lit(0)).alias(name) for name, rule in patterns.items()
    ])
    return counts.unpivot([], list(patterns), "pattern", "found")


def profile_selectors(pages: DataFrame) -> DataFrame:
    return _pattern_counts(pages, CONTAINERS)


def profile_pagination(pages: DataFrame) -> DataFrame:
    return _pattern_counts(pages, PAGINATION)


def profile_classes(pages: DataFrame) -> DataFrame:
    """The ten most frequent class texts that mention a job."""
    texts = F.transform(F.filter("nodes", lambda n: _class_has(n, "job")), lambda n: dom.attr(n, "class"))
    return (
        pages.select(F.explode(texts).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("found"))
        .orderBy(F.desc("found"), "class").limit(TOP_CLASSES)
    )


def profile_tags(pages: DataFrame) -> DataFrame:
    tags = F.transform(F.filter("nodes", dom.is_element), lambda n: n["tag"])
    return pages.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("found"))


def page_links(pages: DataFrame) -> DataFrame:
    """Every link with an address: page_id, pos, href, text."""
    links = F.filter("nodes", lambda n: (n["tag"] == "a") & n["attrs"]["href"].isNotNull())
    cut = F.transform(links, lambda n: F.struct(
        dom.attr(n, "href").alias("href"), dom.inner_text(dom.subtree(F.col("nodes"), n)).alias("text")))
    return pages.select("page_id", F.posexplode(cut).alias("pos", "l")).select("page_id", "pos", "l.*")


def profile_links(pages: DataFrame) -> DataFrame:
    """Candidate posting links of a page: first pattern that finds any, five shown."""
    def found(pattern, fold):
        def rule(n):
            href = dom.attr(n, "href")
            return (n["tag"] == "a") & F.contains(F.lower(href) if fold else href, F.lit(pattern))

        return F.filter("nodes", rule)

    first, second, third = (found(p, i > 0) for i, p in enumerate(LINK_PATTERNS))
    rows = pages.withColumn("_links", F.when(F.size(first) > 0, first).when(F.size(second) > 0, second).otherwise(third))
    shown = F.transform(F.slice("_links", 1, SAMPLE_LINKS), lambda n: F.struct(
        F.left(dom.inner_text(dom.subtree(F.col("nodes"), n)), F.lit(LINK_TEXT)).alias("text"),
        F.left(dom.attr(n, "href"), F.lit(LINK_HREF)).alias("href"),
    ))
    return rows.select(
        "page_id", F.size("_links").alias("found"), F.posexplode(shown).alias("pos", "l")
    ).select("page_id", "found", "pos", "l.text", "l.href")


def profile_headings(pages: DataFrame) -> DataFrame:
    """Per page: headings of plausible length, JSON-LD scripts, page title."""
    nodes = F.col("nodes")
    texts = F.transform(
        F.filter(nodes, lambda n: n["tag"].isin("h1", "h2", "h3", "h4")),
        lambda n: dom.inner_text(dom.subtree(nodes, n)),
    )
    plausible = F.filter(texts, lambda t: (F.length(t) > 10) & (F.length(t) < 200))
    scripts = F.filter(nodes, lambda n: (n["tag"] == "script") & (dom.attr(n, "type") == "application/ld+json"))
    return pages.select(
        "page_id", F.size(plausible).alias("headings"), F.size(scripts).alias("json_ld"),
        dom.text_of(nodes, dom.first_node(nodes, lambda n: n["tag"] == "title")).alias("title"),
    )


def flag_no_results(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", contains_any(dom.raw_text(F.col("nodes")), NO_RESULT_PHRASES).alias("no_results")
    )


def dom_outline(pages: DataFrame, max_depth: int = OUTLINE_DEPTH) -> DataFrame:
    """Structural elements reachable from body through structural elements only."""
    nodes = F.col("nodes")
    structural = F.transform(nodes, lambda n: n["tag"].isin(STRUCTURE_TAGS))
    body = F.array_position(F.transform(nodes, lambda n: n["tag"]), "body").cast("int") - 1

    def below_body(page):
        """(node, number of elements between body and it) of structural elements near enough to body.

        Each climbs from parent to parent while it meets structural elements, max_depth - 1 steps at most.
        """
        def climb(node):
            start = F.struct(node["parent"].alias("at"), F.lit(0).alias("steps"))
            go = lambda s: (s["at"] != page["body"]) & F.coalesce(F.get(page["structural"], s["at"]), F.lit(False))
            return F.aggregate(F.sequence(F.lit(2), F.lit(max(max_depth, 2))), start, lambda s, _: F.when(go(s), F.struct(
                F.get(nodes, s["at"])["parent"].alias("at"), (s["steps"] + 1).alias("steps"))).otherwise(s))

        held = F.filter(nodes, lambda n: F.get(page["structural"], n["nid"]) & (n["nid"] > page["body"]))
        chained = F.transform(held, lambda n: F.struct(n.alias("n"), climb(n).alias("top")))
        return F.filter(chained, lambda x: (x["top"]["at"] == page["body"]) & (x["top"]["steps"] < max_depth))

    # both page-wide values are computed once per page, not once per node
    found = bind(F.struct(structural.alias("structural"), body.alias("body")), below_body)
    shown = F.transform(found, lambda x: F.struct(
        x["n"]["nid"].alias("nid"), (x["top"]["steps"] + 1).alias("depth"), x["n"]["tag"].alias("tag"),
        F.left(dom.attr(x["n"], "id"), F.lit(OUTLINE_ID)).alias("id"),
        F.left(dom.attr(x["n"], "class"), F.lit(OUTLINE_CLASS)).alias("class"),
    ))
    return pages.select("page_id", F.explode(shown).alias("o")).select("page_id", "o.*")
