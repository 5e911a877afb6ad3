"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
HEAVY_SHARE = 1024


def or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tagged(value: Column) -> Column:
    """A string that is never null and differs for different values, null included."""
    return F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), value.cast("string")))


def attach(rows: DataFrame, small: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Left join of ``rows`` with one row of ``small`` per key, however hot a key is.

    ``small[n]`` says how many of ``rows`` have the key.  Fewer than HEAVY_SHARE
    keys can hold more than 1/HEAVY_SHARE of all rows, so these are broadcast
    whatever the size of the data; the others are too small to skew a task.
    Keys must not be null.  Both frames should be cheap to read twice.
    """
    limit = rows.count() / HEAVY_SHARE
    heavy = F.broadcast(small.where(F.col(n) > limit))
    light = small.where(F.col(n) <= limit)
    hot = rows.join(heavy, keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, "left")
    return hot.unionByName(rest)


def short(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts at a time become Python strings."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
