"""Following result pages: next links, page caps, stop rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.urls import BASE_URL, url_absolute
from postloom.sources import dom

# What next links say.
NEXT_WORD = "次"
NEXT_TEXT = "(?i)次|Next"


def _resolved(href: Column, board: str) -> Column:
    href = F.nullif(href, F.lit(""))
    return F.when(F.startswith(href, F.lit("http")), href).otherwise(url_absolute(href, BASE_URL[board]))


def _first_link(nodes: Column, rule) -> Column:
    return dom.first_node(nodes, lambda n: (n["tag"] == "a") & rule(n))


def next_link_text(nodes: Column) -> Column:
    """Address of the first link whose text contains the word for next."""
    link = _first_link(nodes, lambda n: F.contains(n["only"], F.lit(NEXT_WORD)))
    return _resolved(dom.attr(link, "href"), "doda")


def _to_page(n: Column, page_no: Column) -> Column:
    return F.contains(dom.attr(n, "href"), F.concat(F.lit("page="), page_no.cast("string")))


def next_link_page_no(nodes: Column, page_no: Column) -> Column:
    """First link naming the following page number; pages count from 0.

    The number is matched as a prefix, so page 1 also finds page 10.
    """
    return _resolved(dom.attr(_first_link(nodes, lambda n: _to_page(n, page_no + 1)), "href"), "green")


def next_link_testid(nodes: Column) -> Column:
    """The marked next button, else a link labelled next in the pagination bar."""
    button = _first_link(nodes, lambda n: dom.attr(n, "data-testid") == "pagination-page-next")
    bar = dom.first_node(nodes, lambda n: (n["tag"] == "nav") & (dom.attr(n, "aria-label") == "pagination"))
    labelled = _first_link(
        dom.subtree(nodes, bar),
        lambda n: F.contains(dom.attr(n, "aria-label"), F.lit(NEXT_WORD)) & (dom.attr(n, "href") != ""),
    )
    return F.coalesce(
        _resolved(dom.attr(button, "href"), "indeed"), _resolved(dom.attr(labelled, "href"), "indeed")
    )


def has_next(nodes: Column, page_no: Column) -> Column:
    """Is there a link to the following page, by number or by text?"""
    return F.exists(nodes, lambda n: (n["tag"] == "a") & (
        _to_page(n, page_no + 1) | F.coalesce(n["only"].rlike(NEXT_TEXT), F.lit(False))
    ))


def page_cap(pages: DataFrame, max_pages: int, source: str = "source", order: str = "page_no",
             next_url: str | None = None) -> DataFrame:
    """At most ``max_pages`` pages per source, none behind one without a next link.

    Ranks are cut inside each task before the shuffle, so a large source sends
    only its first pages.
    """
    rank = F.row_number().over(Window.partitionBy(source).orderBy(order))
    kept = pages.withColumn("_rank", rank).where(F.col("_rank") <= max_pages).drop("_rank")
    if next_url is None:
        return kept
    last = pages.where(F.col(next_url).isNull()).groupBy(source).agg(F.min(order).alias("_last"))
    return (
        kept.join(last, source, "left")
        .where(F.col("_last").isNull() | (F.col(order) <= F.col("_last"))).drop("_last")
    )


def page_stop_empty(records: DataFrame, source: str = "source", order: str = "page_no",
                    key: str = "job_id") -> DataFrame:
    """New ids per page, up to and including the first page that brings none."""
    first_seen = records.groupBy(source, key).agg(F.min(order).alias(order))
    new = first_seen.groupBy(source, order).agg(F.count(F.lit(1)).alias("_n"))
    pages = (
        records.select(source, order).distinct().join(new, [source, order], "left")
        .select(source, order, F.coalesce("_n", F.lit(0)).alias("new_ids"))
    )
    stop = pages.where("new_ids = 0").groupBy(source).agg(F.min(order).alias("_stop"))
    return (
        pages.join(stop, source, "left")
        .where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")
    )


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key: a grouped minimum, combined before the shuffle."""
    record = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(record.alias("r")).select("r.*")


def dedup_page_ids(records: DataFrame) -> DataFrame:
    """First record per posting id over all pages of a source."""
    return first_by_key(records, ["source", "job_id"], ["page_no", "pos"])


def dedup_page_urls(links: DataFrame) -> DataFrame:
    """First link per address on a page."""
    return first_by_key(links, ["page_id", "href"], ["pos"])
