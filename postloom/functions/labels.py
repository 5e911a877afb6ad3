"""Display forms of scores, salaries, texts and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Widths of the listing's columns.
TITLE_WIDTH, COMPANY_WIDTH, LOCATION_WIDTH = 60, 30, 20


def iso_ts(c: Column) -> Column:
    """ISO text; the fraction shows only when there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def score_percent(c: Column) -> Column:
    """Whole percent, cut off rather than rounded."""
    return (c * 100).cast("int")


def score_label(c: Column) -> Column:
    return F.concat(F.rint(c * 100).cast("bigint").cast("string"), F.lit("%"))


def score_band(c: Column) -> Column:
    return F.when(c >= 0.70, "high").when(c >= 0.50, "medium").otherwise("low")


def salary_label(low: Column, high: Column, missing: str = "-", unit_each: bool = False) -> Column:
    """``460~580万``; a bound that is null or 0 is left out.

    ``unit_each`` writes the unit behind both bounds, as criteria badges do.
    """
    def part(c: Column) -> Column:
        shown = F.floor(c / 10000).cast("string")
        return F.when(F.coalesce(c, F.lit(0)) != 0, F.concat(shown, F.lit("万")) if unit_each else shown)

    lo, hi = part(low), part(high)
    joined = F.concat_ws("~", lo, hi)
    if not unit_each:
        joined = F.concat(joined, F.lit("万"))
    return F.when(lo.isNull() & hi.isNull(), F.lit(missing)).otherwise(joined)


def truncate_label(c: Column, width: int, missing: str | None = None) -> Column:
    cut = F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("..."))).otherwise(c)
    if missing is None:
        return cut
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(missing)).otherwise(cut)


def list_join_label(c: Column) -> Column:
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
