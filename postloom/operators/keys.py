"""Keys of a batch against a much larger stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS_PER_WORD, PROBES = 4, 4
MAX_WORDS = 2 << 20  # words of 64 bits that are broadcast, 16 bytes a row


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words).cast("long"))


def _bits(key: Column) -> Column:
    """PROBES of the 64 bits of a word, by a second hash."""
    h = F.xxhash64(F.lit(1), key)
    out = None
    for i in range(PROBES):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at)
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def _marked(stored: DataFrame, batch: DataFrame, key: str, max_words: int) -> DataFrame | None:
    """``stored`` with ``_near``: may the key be among the batch's?  None when the batch is too large for a filter."""
    keys = batch.where(F.col(key).isNotNull())
    words = max(1, keys.count() // KEYS_PER_WORD)
    if words > max_words:
        return None
    bloom = (
        keys.select(_word(F.col(key), words).alias("_word"), _bits(F.col(key)).alias("_bits"))
        .groupBy("_word").agg(F.bit_or("_bits").alias("_set"))
    )
    rows = stored.withColumns({"_word": _word(F.col(key), words), "_bits": _bits(F.col(key))})
    near = F.coalesce(F.col("_set").bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False))
    return rows.join(F.broadcast(bloom), "_word", "left").withColumn("_near", near).drop("_word", "_bits", "_set")


def maybe_among(stored: DataFrame, batch: DataFrame, key: str, max_words: int = MAX_WORDS) -> DataFrame:
    """Rows of ``stored`` whose key may be among the batch's; null keys never are.

    A Bloom filter of the batch's keys, put together by the tasks that hold
    them as 64-bit words, is broadcast and cuts the stored side within its scan,
    before any exchange.  About one row in a hundred passes by mistake.  A batch
    too large for a filter of ``max_words`` cuts nothing.
    """
    stored = stored.where(F.col(key).isNotNull())
    marked = _marked(stored, batch, key, max_words)
    return stored if marked is None else marked.where("_near").drop("_near")


def split_among(
    rows: DataFrame, batch: DataFrame, key: str, max_words: int = MAX_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the batch's, rows whose key is not), by the same filter; ``key`` is not null."""
    marked = _marked(rows, batch, key, max_words)
    if marked is None:
        return rows, rows.where(F.lit(False))
    return marked.where("_near").drop("_near"), marked.where("NOT _near").drop("_near")
