"""Exact top-k search by inner product with a vector-approximation file.

The file holds blocks of vectors: per vector its cell in each dimension (64
cells by default, cut at the block's quantiles), per cell the smallest and
largest value in it, and the exact vectors in a column of their own.

1. Blocks of queries meet all blocks of cells.  The cells bound every score
   from both sides; the k-th largest lower bound over all blocks is a score
   each query is sure to reach.
2. The blocks of cells are met again.  Vectors whose upper bound reaches that
   score are candidates, noted by position and bound.  Neither pass touches the
   column of exact vectors.
3. Blocks with candidates are read, once each, and what their candidates need
   of them is scored best bound first, until the k-th exact score is above
   every bound left.
4. What the blocks found is ranked per query.

The meeting of blocks is an equi join: query blocks are dealt to slices, and
vector blocks belong to one slice each.  It is a merge join on purpose: blocks
are far larger in memory than in files, queries dealt out as often as there are
slices, so no side may be broadcast for the size of its file.  Reading is a
sorted stream in which a block comes before the candidates that ask for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import short
from postloom.session import written

FAN = 16
ASKS = 256  # query blocks that share one read of a vector block
BROADCAST_BLOCKS = 100_000  # up to that many vector blocks, what is known per block is broadcast


def whole_vector(vector: Column, scale: int) -> Column:
    """floor(scale * x) per component; null for a vector that is null or holds null, NaN or infinity."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _blocks(rows: int, build):
    """Per partition and dimension, ``build`` a row of every ``rows`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list[int], list[list[int]]]] = {}
        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist()):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == rows:
                    yield build(f"{part}-{made}", *held.pop(len(v)))
                    made += 1
        for ids, vectors in held.values():
            yield build(f"{part}-{made}", ids, vectors)
            made += 1

    return run


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([columns])


def approximate(x: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of every component, and the least and largest value of each cell by dimension."""
    n, dim = x.shape
    cell = np.zeros((n, dim), np.uint8)
    low, high = np.zeros((dim, cells), np.int64), np.zeros((dim, cells), np.int64)
    for d in range(dim):
        own = np.sort(x[:, d])
        cuts = np.unique(own[(np.arange(1, cells) * n) // cells])
        cell[:, d] = np.searchsorted(cuts, x[:, d], side="right")
        first = np.searchsorted(own, cuts, side="left")
        starts = np.concatenate([[0], first])
        ends = np.concatenate([first, [n]])
        some = ends > starts
        low[d, : len(starts)][some] = own[starts[some]]
        high[d, : len(starts)][some] = own[ends[some] - 1]
    return cell, low, high


def standing(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Positions that some query may have among its k best; the others lose to equal vectors of the block.

    A query passes over one id, its own.  So a vector that equals k + 1 others
    with ids smaller and all different, or k others of its own id before it, is
    behind k rows in every ranking.
    """
    packed = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    group = np.unique(packed, return_inverse=True)[1]
    order = np.lexsort((ids, group))
    g, i, at = group[order], ids[order], np.arange(len(ids))
    new_group = np.concatenate([[True], g[1:] != g[:-1]])
    new_id = new_group | np.concatenate([[True], i[1:] != i[:-1]])
    distinct = np.cumsum(new_id)
    smaller = distinct - np.maximum.accumulate(np.where(new_group, distinct, 0))
    before = at - np.maximum.accumulate(np.where(new_id, at, 0))
    return np.sort(order[(smaller <= k) & (before < k)]).astype(np.int32)


def _vector_block(cells: int, k: int):
    def build(name: str, ids: list[int], vectors: list[list[int]]) -> pa.RecordBatch:
        x, own = np.array(vectors, np.int64).reshape(len(ids), -1), np.array(ids, np.int64)
        cell, low, high = approximate(x, cells)
        kind = next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or (np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max))
        return _batch({
            "vb": name, "dim": x.shape[1], "ids": own.tobytes(), "cell": cell.tobytes(), "low": low.tobytes(),
            "high": high.tobytes(), "live": standing(own, x, k).tobytes(), "kind": kind, "exact": x.astype(kind).tobytes(),
        })

    return build


def _query_block(name: str, ids: list[int], vectors: list[list[int]]) -> pa.RecordBatch:
    x = np.array(vectors, np.int64).reshape(len(ids), -1)
    return _batch({"qb": name, "dim": x.shape[1], "qids": np.array(ids, np.int64).tobytes(), "q": x.tobytes()})


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, upper: bool) -> np.ndarray:
    """Bound from above or below on q times every vector between lo and hi.

    Integers are summed without rounding in the narrowest float that holds every
    sum; where none does, the bound makes room for rounding.
    """
    size = np.abs(q.astype(np.float64)).max(initial=0) * max(1, q.shape[1])
    size *= max(np.abs(lo.astype(np.float64)).max(initial=0), np.abs(hi.astype(np.float64)).max(initial=0))
    real = np.float32 if size < 2.0**24 else np.float64
    plus, minus = np.maximum(q, 0).astype(real), np.minimum(q, 0).astype(real)
    lo, hi = lo.astype(real), hi.astype(real)
    out = plus @ (hi if upper else lo).T + minus @ (lo if upper else hi).T
    room = 0 if size < 2.0**52 else 2.0**-40 * size
    return out + room if upper else out - room


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of one query with vectors, held within the range of a long."""
    size = np.abs(q.astype(np.float64)).max(initial=0) * np.abs(x.astype(np.float64)).max(initial=0) * max(1, len(q))
    if size < 2.0**52:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    sums = x.astype(object) @ q.astype(object)
    return np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in sums], np.int64)


def _opened(r: dict) -> tuple[np.ndarray, ...]:
    """Of a meeting of blocks: queries, their ids, and of the standing vectors position, id, least and greatest values."""
    dim, qids, live = r["dim"], np.frombuffer(r["qids"], np.int64), np.frombuffer(r["live"], np.int32)
    ids = np.frombuffer(r["ids"], np.int64)
    low, high = (np.frombuffer(r[c], np.int64).reshape(dim, -1) for c in ("low", "high"))
    cell, at = np.frombuffer(r["cell"], np.uint8).reshape(len(ids), dim)[live], np.arange(dim)
    return np.frombuffer(r["q"], np.int64).reshape(len(qids), dim), qids, live, ids[live], low[at, cell], high[at, cell]


def _lower_bounds(k: int):
    """Each query's k largest lower bounds over the vector blocks that its block meets one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = part = best = None
        told = lambda: _batch({"qb": last, "part": part, "best": best.tobytes()})
        for b in short(batches, 1):
            for r in b.to_pylist():
                q, qids, _, ids, lo, hi = _opened(r)
                found = bounds(q, lo, hi, upper=False).astype(np.float64)
                found[qids[:, None] == ids[None, :]] = -np.inf
                found = _top(found, k)
                if r["qb"] == last:
                    best = _top(np.concatenate([best, found], axis=1), k)
                    continue
                if last is not None:
                    yield told()
                last, part, best = r["qb"], zlib.crc32(r["vb"].encode()), found
        if last is not None:
            yield told()

    return run


def _top(found: np.ndarray, k: int) -> np.ndarray:
    if found.shape[1] < k:
        found = np.concatenate([found, np.full((len(found), k - found.shape[1]), -np.inf)], axis=1)
    return np.ascontiguousarray(np.partition(found, -k, axis=1)[:, -k:])


def _merge_bounds(k: int):
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        every = [np.frombuffer(b, np.float64).reshape(-1, k) for b in rows.column("best").to_pylist()]
        return pa.table({
            "qb": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int64()),
            "best": pa.array([_top(np.concatenate(every, axis=1), k).tobytes()], pa.binary()),
        })

    return merge


def _floors(k: int):
    """Per query block, the score each query is sure to reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield _batch({"qb": r["qb"], "floor": np.frombuffer(r["best"], np.float64).reshape(-1, k).min(axis=1).tobytes()})

    return run


ASKED = "vb string, qb string, dim long, rows binary, many binary, at binary, bound binary, qids binary, q binary, floor binary"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of blocks, the vectors that may reach a query's floor, best bound first, and the queries that have any."""
    for b in short(batches, 1):
        for r in b.to_pylist():
            q, qids, live, ids, lo, hi = _opened(r)
            floor, upper = np.frombuffer(r["floor"], np.float64), bounds(q, lo, hi, upper=True).astype(np.float64)
            row, v = np.nonzero((upper >= floor[:, None]) & (qids[:, None] != ids[None, :]))
            if not len(row):
                continue
            bound = upper[row, v]
            order = np.lexsort((-bound, row))
            rows, many = np.unique(row, return_counts=True)
            yield _batch({
                "vb": r["vb"], "qb": r["qb"], "dim": r["dim"], "rows": rows.astype(np.int32).tobytes(),
                "many": many.astype(np.int32).tobytes(), "at": live[v[order]].tobytes(), "bound": bound[order].tobytes(),
                "qids": qids[rows].tobytes(), "q": q[rows].tobytes(), "floor": floor[rows].tobytes(),
            })


FOUND = pa.schema([(c, pa.string() if c == "qb" else pa.int64()) for c in ("query", "qb", "row", "id", "score")])


def _read(k: int):
    """Per block and query, at most k exact scores that may be among the best; a block comes before those who ask for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = ids = x = None
        for b in batches:
            for r in b.to_pylist():
                if r["exact"] is not None:
                    block, ids = r["vb"], np.frombuffer(r["ids"], np.int64)
                    x = np.frombuffer(r["exact"], r["kind"]).reshape(len(ids), -1)
                    continue
                if block != r["vb"]:
                    raise RuntimeError("a block of vectors is missing")
                rows, many, at = (np.frombuffer(r[c], np.int32) for c in ("rows", "many", "at"))
                bound, floor = (np.frombuffer(r[c], np.float64) for c in ("bound", "floor"))
                qids, q = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["q"], np.int64).reshape(len(rows), -1)
                out: dict[str, list[np.ndarray]] = {c: [] for c in ("query", "row", "id", "score")}
                for i, end in enumerate(np.cumsum(many)):
                    own = slice(end - many[i], end)
                    got_ids, got = best_of(q[i], x, ids, at[own], bound[own], k)
                    sure = got >= floor[i]
                    got_ids, got = got_ids[sure], got[sure]
                    for c, v in (("query", np.full(len(got), qids[i])), ("row", np.full(len(got), rows[i])), ("id", got_ids), ("score", got)):
                        out[c].append(v)
                merged = {c: np.concatenate(v) for c, v in out.items()} | {"qb": [r["qb"]] * sum(map(len, out["id"]))}
                yield pa.RecordBatch.from_arrays([pa.array(merged[f.name], f.type) for f in FOUND], schema=FOUND)

    return run


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, at: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of x[at], read in order of falling bound until the k-th is certain."""
    got_ids, got = np.zeros(0, np.int64), np.zeros(0, np.int64)
    done, step = 0, k
    while done < len(at) and (len(got) < k or bound[done] >= got[-1]):
        some = at[done : done + step]
        done, step = done + step, 2 * step
        got_ids, got = np.concatenate([got_ids, ids[some]]), np.concatenate([got, exact_scores(q, x[some])])
        first = _ranked(got_ids, got)[:k]
        got_ids, got = got_ids[first], got[first]
    return got_ids, got


def _ranked(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Order by falling score, then rising id; ~ turns longs around without overflow."""
    return np.lexsort((ids, ~scores))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
    bits: int = 6, block_rows: int = 2048, query_rows: int = 512,
) -> DataFrame:
    """query_id, rank (from 1), id, score: the k best of all other rows for each query row.

    Score is the inner product of the vectors turned to integers, floor(scale *
    x); ties go to the smaller id.  Rows without id, and vectors that are null, empty
    or hold null or non-finite components, take no part.  Vectors only meet
    those of their own length.  A row is not its own result, nor are rows that
    share its id.  A repeated candidate counts each time, a repeated query is
    answered each time.  Scores beyond a long are held at its ends.  An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    whole = vectors.select(
        F.col(id_col).cast("long").alias("id"), whole_vector(F.col(vector_col), scale).alias("v"), is_query.alias("asks")
    ).where("id IS NOT NULL AND size(v) > 0")
    file = written(
        whole.select("id", "v").mapInArrow(
            _blocks(block_rows, _vector_block(1 << bits, k)),
            "vb string, dim long, ids binary, cell binary, low binary, high binary, live binary, kind string, exact binary",
        ),
        "va-file",
    )
    asked = written(
        whole.where("asks").select("id", "v").mapInArrow(_blocks(query_rows, _query_block), "qb string, dim long, qids binary, q binary"),
        "va-queries",
    )
    blocks = file.count()
    slices = max(1, min(blocks, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cells = file.drop("kind", "exact").withColumn("slice", F.pmod(F.xxhash64("vb"), F.lit(slices)).cast("int"))
    dealt = lambda asking: asking.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    # a block of queries meets the blocks of a slice one after the other
    meet = lambda asking: dealt(asking).join(cells.hint("merge"), ["dim", "slice"])

    best = meet(asked).mapInArrow(_lower_bounds(k), "qb string, part long, best binary")
    parts = slices
    while True:
        parts = -(-parts // FAN)
        best = best.withColumn("part", F.col("part") % max(1, parts)).groupBy("qb", "part").applyInArrow(
            _merge_bounds(k), "qb string, part long, best binary"
        )
        if parts <= 1:
            break
    floors = best.mapInArrow(_floors(k), "qb string, floor binary")
    sure = written(asked.join(floors.hint("merge"), "qb"), "va-floors")

    asks = written(meet(sure).mapInArrow(_candidates, ASKED), "va-candidates")
    shares = asks.groupBy("vb").agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("shares"))
    shares = shares.hint("broadcast" if blocks <= BROADCAST_BLOCKS else "merge")
    blocks_read = file.select("vb", "ids", "kind", "exact").join(shares, "vb").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    asking = asks.join(shares, "vb").withColumn("share", F.pmod(F.xxhash64("qb"), F.col("shares")).cast("int"))
    stream = blocks_read.unionByName(asking, allowMissingColumns=True).drop("shares").repartition("vb", "share")
    found = stream.sortWithinPartitions("vb", "share", F.col("exact").isNull()).mapInArrow(
        _read(k), "query long, qb string, row long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("qb", "row").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "id", "score")
