"""Search addresses and per-source settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.urls import SEARCH_URL, form_encode, path_encode

# Request parameters, occupation slugs and default settings.
DODA_PARAMS = "&kwc=1&ss=1&pic=1&ds=0&so=50&tp=1"
OCCUPATIONS = {
    "デザイナー": "designer",
    "エンジニア": "engineer",
    "マーケター": "marketer",
    "セールス": "sales",
    "PM": "pm_director",
    "プロダクトマネージャー": "pm_director",
    "ディレクター": "pm_director",
    "人事": "hr",
    "バックオフィス": "corporate",
}
DEFAULT_SETTINGS = {
    "keywords": ["デザイナー"], "location": "東京", "max_pages": 2, "delay_range": [2.0, 3.0],
}
SETTING_TYPES = {
    "keywords": "array<string>", "location": "string", "max_pages": "int", "delay_range": "array<double>",
}


def _terms(keywords: Column, location: Column | None = None) -> Column:
    words = F.array_join(keywords, " ")
    if location is None:
        return words
    return F.concat_ws(" ", F.nullif(words, F.lit("")), F.nullif(location, F.lit("")))


def frontier_doda(keywords: Column, location: Column) -> Column:
    return F.concat(F.lit(SEARCH_URL["doda"] + "?k="), form_encode(_terms(keywords, location)), F.lit(DODA_PARAMS))


def frontier_green(keywords: Column, location: Column) -> Column:
    """The place follows the words behind a space, also where there are no words."""
    place = F.concat(F.lit(" "), F.nullif(location, F.lit("")))
    return F.concat(
        F.lit(SEARCH_URL["green"] + "?keyword="), form_encode(F.concat(_terms(keywords), F.coalesce(place, F.lit("")))))


def frontier_indeed(keywords: Column, location: Column) -> Column:
    place = F.concat(F.lit("&l="), form_encode(F.nullif(location, F.lit(""))))
    return F.concat(
        F.lit(SEARCH_URL["indeed"] + "?q="), form_encode(_terms(keywords)), F.coalesce(place, F.lit(""))
    )


def frontier_wantedly_kw(keywords: Column, location: Column, page: Column) -> Column:
    return F.concat(
        F.lit(SEARCH_URL["wantedly"] + "?page="), page.cast("string"),
        F.lit("&keywords="), path_encode(_terms(keywords, location)),
    )


def frontier_wantedly_occ(keywords: Column, page: Column) -> Column:
    """Occupation page of the first keyword that names one, else the bare listing."""
    slugs = F.create_map(*[F.lit(x) for pair in OCCUPATIONS.items() for x in pair])
    slug = F.get(F.filter(F.transform(keywords, lambda k: slugs[k]), lambda s: s.isNotNull()), 0)
    query = F.concat_ws(
        "&",
        F.concat(F.lit("occupation_types%5B%5D="), slug),
        F.when(page > 1, F.concat(F.lit("page="), page.cast("string"))),
    )
    return F.concat(F.lit(SEARCH_URL["wantedly"]), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def page_numbers(searches: DataFrame, max_pages: str = "max_pages") -> DataFrame:
    """One row per search and page to fetch."""
    return searches.withColumn("page", F.explode(F.sequence(F.lit(1), F.col(max_pages))))


def settings_map(c: Column) -> Column:
    """Settings text of one source -> map; unreadable text counts as empty."""
    empty = F.try_parse_json(F.lit("{}")).cast("map<string,variant>")
    value = F.try_parse_json(c)
    is_object = F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
    return F.coalesce(F.when(is_object, value.cast("map<string,variant>")), empty)


def j_settings(sources: DataFrame, shared: dict | None = None, column: str = "settings") -> DataFrame:
    """Settings per source: its own where the key is present, even as null, else the shared ones."""
    shared = {**DEFAULT_SETTINGS, **(shared or {})}
    own = F.col("_own")
    merged = sources.withColumn("_own", settings_map(F.col(column)))
    for name, kind in SETTING_TYPES.items():
        value = shared[name]
        default = F.array(*[F.lit(x) for x in value]) if isinstance(value, list) else F.lit(value)
        mine = F.try_variant_get(own[name], "$", kind)
        merged = merged.withColumn(
            name, F.when(F.map_contains_key(own, F.lit(name)), mine).otherwise(default.cast(kind))
        )
    return merged.drop("_own")


def f_enabled(sources: DataFrame, column: str = "settings") -> DataFrame:
    """Sources not switched off; without the key a source is on."""
    flag = F.try_variant_get(settings_map(F.col(column))["enabled"], "$", "boolean")
    return sources.where(F.coalesce(flag, F.lit(True)))


def f_only(sources: DataFrame, names: list[str], column: str = "source") -> DataFrame:
    """The named sources; ``all`` keeps every one, an unknown name leaves none.

    The names are a short list written by a caller, so they are looked up as
    literals.
    """
    if "all" in names:
        return sources
    wanted = sorted(set(names))
    known = sources.where(F.col(column).isin(wanted)).select(F.count_distinct(column).alias("n"))
    return sources.where(F.col(column).isin(wanted)).where(known.scalar() == len(wanted))
