"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q, at least ``exponent`` * q
and ``least`` words long, that cannot be extended with that period.

Periods below FIRST are found directly: words q apart are compared along the
whole text.  Larger ones are found at the scale t, a power of two, with
t <= q < 2t:

* every window of t words has a hash, built from those of half its length;
* position i is a synchroniser if the least hash among the windows at i .. i+t
  is that at i or at i+t.  Windows of a period up to t/4 do not count: they lie
  in runs found at smaller scales, which supply them.  So whether i is chosen
  depends on the words i .. i+2t-1 alone, and in a stretch of 3t-1 words without
  such a period one of the first t positions is chosen;
* a run of period q holds 4q >= 3t + q words, so one of its first t positions is
  chosen, and the position q further on with it, as both begin the same 2t
  words.  No equal context lies between, since two periods of at most 2t over
  that many words would have a common divisor as period.  So neighbouring
  synchronisers of equal context propose every period, and each proposal is
  verified and extended word by word.

A stretch found with two periods has the smaller one.  Hashes only choose and
propose; what is returned was compared by words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST = 8  # periods below are compared directly
BATCH_WORDS = 1 << 18
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[2]
    h = (h ^ (h >> np.uint64(29))) * ODD[0]
    return h ^ (h >> np.uint64(32))


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def _window_least(h: np.ndarray, t: int) -> np.ndarray:
    """Least of h[i .. i+t] for every i; t a power of two."""
    low, width = h, 1
    while width < t:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[:-1], low[1:])  # t and one more


def _extended(words: np.ndarray, i: int, d: int) -> tuple[int, int]:
    """The longest stretch around i in which words d apart are the same."""
    n, step, end = len(words) - d, 2 * d, i
    while end < n:
        stop = min(n, end + step)
        bad = words[end:stop] != words[end + d : stop + d]
        first = int(bad.argmax()) if bad.any() else -1
        if first >= 0:
            end += first
            break
        end, step = stop, 2 * step
    step, start = 2 * d, i
    while start > 0:
        stop = max(0, start - step)
        bad = words[stop:start] != words[stop + d : start + d]
        if bad.any():
            start -= int(bad[::-1].argmax())
            break
        start, step = stop, 2 * step
    return start, end + d


def _proposals(words: np.ndarray, h: np.ndarray, t: int, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances t .. 2t-1 of neighbouring synchronisers of equal context.

    ``h`` hashes the windows of t words; ``covered[i]`` says how far the runs of
    period up to t/4 reach that hold word i.
    """
    windows = len(h)
    hashes = np.where(covered[:windows] >= np.arange(t, t + windows), NONE, np.minimum(h, NONE - np.uint64(1)))
    least = _window_least(hashes, t)
    m = len(least)
    chosen = np.flatnonzero((least != NONE) & ((hashes[:m] == least) | (hashes[t : t + m] == least)))
    context = _mixed(h[chosen] * ODD[0] + h[chosen + t] * ODD[1])
    order = np.argsort(context, kind="stable")
    a, b = chosen[order[:-1]], chosen[order[1:]]
    near = (context[order[:-1]] == context[order[1:]]) & (b - a >= t) & (b - a < 2 * t)
    return a[near], (b - a)[near]


def runs(words: np.ndarray, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs among word numbers, by start and period."""
    n = len(words)
    found: dict[tuple[int, int], int] = {}

    def add(start: int, end: int, d: int) -> None:
        if end - start >= max(least, exponent * d):
            found[start, end] = min(d, found.get((start, end), d))

    for d in range(1, min(FIRST, n // exponent + 1)):
        starts, ends = _stretches(words[:-d] == words[d:])
        keep = ends + d - starts >= max(least, exponent * d)
        for s, e in zip(starts[keep].tolist(), ends[keep].tolist()):
            add(s, e + d, d)
    h = _mixed(words.astype(np.uint64) * ODD[0] + ODD[1])
    t = 1
    while t < FIRST and len(h) > t:
        h = _mixed(h[:-t] * ODD[0] + h[t:] * ODD[1])
        t *= 2
    while t * exponent <= n:
        covered = np.zeros(n + 1, np.int64)
        for (s, e), d in found.items():
            if d <= t // 4 and e - s >= t:
                covered[s:e] = np.maximum(covered[s:e], e)
        reach: dict[int, int] = {}  # how far the last stretch of each period goes
        at, distance = _proposals(words, h, t, covered)
        for i in np.argsort(at, kind="stable").tolist():
            i, d = int(at[i]), int(distance[i])
            if i < reach.get(d, 0):
                continue
            if (words[i : i + 2 * t] == words[i + d : i + d + 2 * t]).all():
                start, end = _extended(words, i, d)
                reach[d] = end - d
                add(start, end, d)
        h = _mixed(h[:-t] * ODD[0] + h[t:] * ODD[1])
        t *= 2
    return sorted((s, e - s, d) for (s, e), d in found.items())


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_WORDS words, one row at least."""
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b.column("words")).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + BATCH_WORDS, "right")))
            yield b.slice(at, to - at)
            at = to


def _finder(exponent: int, least: int):
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _split(batches):
            lists = b.column("words")
            values = lists.flatten()
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            numbers = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            # one array of all texts; a number of its own after each keeps runs within a text
            docs = np.repeat(np.arange(len(counts)), counts)
            line = np.empty(len(numbers) + len(counts), np.int64)
            starts = np.concatenate(([0], np.cumsum(counts + 1)))[:-1]
            line[np.arange(len(numbers)) + docs] = numbers
            line[starts + counts] = -1 - np.arange(len(counts))
            drop = np.zeros(len(line) + 1, np.int64)
            out: list[list[dict]] = [[] for _ in counts]
            for s, length, q in runs(line, exponent, least):
                drop[s + q] += 1
                drop[s + length] -= 1
                doc = int(np.searchsorted(starts, s, "right")) - 1
                out[doc].append({"start": s - int(starts[doc]), "length": length, "period": q})
            keep = (np.cumsum(drop[:-1]) == 0)[np.arange(len(numbers)) + docs]
            kept = np.bincount(docs[keep], minlength=len(counts))
            offsets = pa.array(np.concatenate(([0], np.cumsum(kept))), pa.int64())
            left = pa.LargeListArray.from_arrays(offsets, values.filter(pa.array(keep)))
            text = pc.binary_join(left.cast(pa.list_(values.type)), pa.scalar(" ", values.type))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(counts), pa.array(out, run_type), text.cast(pa.string())],
                ["id", "n_words", "runs", "collapsed"])

    return run


def words_of(text: Column) -> Column:
    """The words of a text: what spaces, tabs and line breaks of ASCII separate."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def periodic_runs(
    docs: DataFrame, words: Column | None = None, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4,
    least: int = 6,
) -> DataFrame:
    """id, n_words, runs (start, length, period; by start and period), collapsed.

    ``words`` may give another array of words than the text's own.  ``collapsed``
    is the words joined by one space, without those that some run holds after
    its first period.  Whole texts are searched, however long.  A null or empty
    text has no words and no runs; every row, repeated or without an id, stands
    for itself; an empty table gives an empty result.  Other columns are not read.
    """
    if exponent < 4:
        raise ValueError("smaller exponents than 4 leave no room for two equal contexts")
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    given = words_of(F.col(text_col)) if words is None else words
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(given, F.array().cast("array<string>")).alias("words"))
    return rows.mapInArrow(
        _finder(exponent, least),
        f"id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
