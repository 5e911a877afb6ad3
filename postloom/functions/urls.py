"""URL building, resolving and id extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Board addresses and the patterns that hold a posting id.
BASE_URL = {
    "doda": "https://doda.jp",
    "green": "https://www.green-japan.com",
    "indeed": "https://jp.indeed.com",
    "wantedly": "https://www.wantedly.com",
}
SEARCH_URL = {
    "doda": "https://doda.jp/DodaFront/View/JobSearchList.action",
    "green": "https://www.green-japan.com/search_key",
    "indeed": "https://jp.indeed.com/jobs",
    "wantedly": "https://www.wantedly.com/projects",
}
JOB_ID_PATTERN = {
    "doda": r"/j_jid__(\d+)/",
    "green": r"/job/(\d+)",
    "wantedly": r"/projects/(\d+)",
}


def form_encode(c: Column) -> Column:
    """Query-string encoding with '+' for a space and '~' left alone."""
    out = F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def path_encode(c: Column) -> Column:
    """Like form_encode, but a space is %20 and '/' stays."""
    out = F.replace(form_encode(c), F.lit("+"), F.lit("%20"))
    return F.replace(out, F.lit("%2F"), F.lit("/"))


def job_id(url: Column, board: str) -> Column:
    return F.nullif(F.regexp_extract(url, JOB_ID_PATTERN[board], 1), F.lit(""))


# a "." or ".." segment anywhere in the path
DOT_SEGMENT = r"^([^?#]*/)?\.\.?([/?#]|\z)"


def _without_dots(path: Column) -> Column:
    """Path after its first slash, "." and ".." segments resolved; ".." ends at the root."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    to_folder = F.element_at(segments, -1).isin(".", "..")
    return F.array_join(F.when(to_folder, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def url_absolute(href: Column, base: str) -> Column:
    """``href`` resolved against a board's root address.

    Covers absolute, scheme-relative, rooted, query-only and plain relative
    links.  Dot segments are resolved and repeated slashes of relative paths
    become one; absolute and scheme-relative links stay as they are.
    """
    root = F.lit(base)
    path = F.regexp_extract(href, "^/?([^?#]*)", 1)
    path = F.when(F.startswith(href, F.lit("/")), path).otherwise(F.regexp_replace(path, "/+", "/"))
    uneven = href.rlike(DOT_SEGMENT) | href.rlike("^[^/?#][^?#]*//")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.lit(base.split("//")[0]), href))
        .when(uneven, F.concat(root, F.lit("/"), _without_dots(path), F.regexp_extract(href, "(?s)^[^?#]*(.*)", 1)))
        .when(href.rlike(r"^[/?#]") | (href == ""), F.concat(root, href))
        .otherwise(F.concat(root, F.lit("/"), href))
    )


def strip_query(c: Column) -> Column:
    return F.substring_index(c, "?", 1)
