"""Form text and stored JSON -> typed criteria columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import strip


def criteria_list_parse(c: Column) -> Column:
    """Comma-separated text -> trimmed non-blank items; nothing left -> null."""
    items = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")
    return F.when(F.size(items) > 0, items)


def criteria_salary_units(c: Column) -> Column:
    """Number in 万円 -> yen; blank, not a whole number or beyond a long -> null."""
    return F.try_multiply(strip(c).try_cast("bigint"), F.lit(10000).cast("bigint"))


def criteria_tri_bool(c: Column) -> Column:
    return F.when(F.nullif(c, F.lit("")).isNotNull(), c == "true")


def json_list_coerce(c: Column, bare: str = "wrap") -> Column:
    """Stored JSON -> list of strings; null or anything else -> empty list.

    A bare JSON string becomes a one-item list for scoring (``wrap``) and an
    empty one on the settings view (``drop``).
    """
    empty = F.array().cast("array<string>")
    value = F.try_parse_json(c)
    kind = F.schema_of_variant(value)
    out = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(value, "$", "array<string>"))
    if bare == "wrap":
        text = F.try_variant_get(value, "$", "string")
        out = out.when((kind == "STRING") & (text != ""), F.array(text))
    return F.coalesce(out.otherwise(empty), empty)
