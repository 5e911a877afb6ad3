"""SimHash near-duplicates by vantage-point trees.

Fingerprints of 64 bits link when at most ``max_bits`` differ.  Distances
between unrelated fingerprints crowd around 32, where a ball cannot tell them
apart, so each of ``parts`` slices of the bits has a tree of its own: of a pair
within ``max_bits``, some slice differs in at most ``max_bits // parts`` bits.

A node of a tree holds a vantage point and a median distance.  Fingerprints
nearer than that go to the inner branch, the others to the outer one, and by
the triangle inequality only inner ones within the slice's radius of the border
can have a partner outside, so these go to both.  Leaves are shards that
overlap at their borders; every linked pair meets in at least one.  Within a
shard all pairs are compared on all bits.

The trees are fitted on a bounded sample of fingerprints; shards that come out
large are split further by vantage points drawn from a seed, and what stays
large, a cloud of texts alike in a slice, is compared block by block, two blocks
to a task.  Every distinct fingerprint is indexed.  A shard returns its links as stars, one row per
fingerprint at most, and the components are found from those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import SPACES, attach, lower_ascii, or_empty, short, tagged
from postloom.llm.components import components
from postloom.session import written

BLOCK = 1 << 16  # shingles hashed at a time
_TO_SPACE = str.maketrans({c: " " for c in SPACES})


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text whose A-Z are lower-cased; 0 without a word.

    Shingles of ``words`` words count as often as they occur; a shorter text is
    one shingle.  A bit is set if it is set in over half of the hashes.
    """
    found = [w for w in text.translate(_TO_SPACE).split(" ") if w]
    if not found:
        return 0
    data = " ".join(found).encode()
    ends = np.cumsum([len(w) for w in found] if data.isascii() else [len(w.encode()) for w in found]) + np.arange(len(found))
    n = max(1, len(found) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[len(found) - n :].tolist()
    view, digest = memoryview(data), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(view[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42,
    marks: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, fp (the 64 bits as a long) and ``marks``, longs made of the row."""
    marks = marks or {}
    names = list(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches):
            fps = np.array([fingerprint(t, words, seed) for t in b.column("text").to_pylist()], np.uint64)
            columns = [b.column("id"), pa.array(fps.view(np.int64)), *[b.column(m) for m in names]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "fp", *names])

    base = docs.select(
        F.col(id_col).alias("id"), lower_ascii(or_empty(F.col(text_col))).alias("text"), *[c.alias(m) for m, c in marks.items()]
    )
    return base.mapInArrow(run, ", ".join([f"id {base.schema['id'].dataType.simpleString()}", "fp long", *[f"{m} long" for m in names]]))


@dataclass
class Tree:
    """A vantage-point tree over one slice of the bits, as arrays; node i has children 2i+1 and 2i+2."""

    mask: int
    radius: int
    depth: int
    point: np.ndarray
    border: np.ndarray

    def shards(self, fps: np.ndarray, extra: dict[int, int] | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) for every shard a fingerprint belongs to; ``extra``: further levels of large shards."""
        row, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        part = fps & np.uint64(self.mask)
        for _ in range(self.depth):
            pick, node = self._branch(part[row], node, self.point[node], self.border[node])
            row = row[pick]
        if extra:
            more = np.array([extra.get(s, 0) for s in node.tolist()], np.int64)
            for level in range(max(extra.values())):
                go, stay = np.flatnonzero(more > level), np.flatnonzero(more <= level)
                point = np.random.default_rng([seed, level]).integers(0, 1 << 64, dtype=np.uint64, endpoint=False) & np.uint64(self.mask)
                pick, child = self._branch(part[row[go]], node[go], point, self.mask.bit_count() // 2)
                node = np.concatenate([node[stay], child])
                keep = np.concatenate([stay, go[pick]])
                row, more = row[keep], more[keep]
        return row, node

    def _branch(self, part, node, point, border) -> tuple[np.ndarray, np.ndarray]:
        """(which of the rows, child) for the branches each row goes to."""
        d = np.bitwise_count(part ^ point).astype(np.int64)
        inner, outer = np.flatnonzero(d <= border), np.flatnonzero(d > border - self.radius)
        return np.concatenate([inner, outer]), np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])


def plant(sample: np.ndarray, mask: int, radius: int, depth: int, seed: int) -> Tree:
    """Fit a tree on sampled fingerprints: a member of each node is its vantage point."""
    rng = np.random.default_rng([seed, mask & 0xFFFFFFFF])
    point, border = np.zeros((1 << depth) - 1, np.uint64), np.zeros((1 << depth) - 1, np.int64)
    members, middle = {0: sample & np.uint64(mask)}, mask.bit_count() // 2
    for node in range((1 << depth) - 1):
        own = members.pop(node, np.zeros(0, np.uint64))
        if len(own):
            point[node] = own[rng.integers(len(own))]
            d = np.bitwise_count(own ^ point[node])
            border[node] = int(np.median(d))
            members[2 * node + 1], members[2 * node + 2] = own[d <= border[node]], own[d > border[node]]
        else:
            point[node], border[node] = np.uint64(rng.integers(0, 1 << 63)) & np.uint64(mask), middle
    return Tree(mask, radius, depth, point, border)


def close_pairs_as_stars(
    fps: np.ndarray, max_bits: int, block: int = 512, other: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) linking every member of a linked group to its least member.

    Links are those among the distinct ``fps``, or with ``other``, which shares
    none of them, those between the two.  Groups merge a row of the distance
    matrix at a time, so no step is taken per pair.
    """
    fps = np.sort(fps)
    every = fps if other is None else np.sort(np.concatenate([fps, other]))
    columns = every if other is None else np.sort(other)
    rows_at, columns_at = np.searchsorted(every, fps), np.searchsorted(every, columns)
    root = np.arange(len(every))
    for at in range(0, len(fps), block):
        first = at if other is None else 0  # the matrix is symmetric
        near = np.bitwise_count(fps[at : at + block, None] ^ columns[None, first:]) <= max_bits
        for a in np.flatnonzero(near.any(axis=1)).tolist():
            labels = root[np.append(columns_at[first:][near[a]], rows_at[at + a])]
            least = labels.min()
            if (labels != least).any():
                root[np.isin(root, labels)] = least
    linked = root != np.arange(len(every))
    return every[linked], every[root[linked]]


def near_links(
    fps: DataFrame, max_bits: int = 3, parts: int = 2, shard_size: int = 2048, sample_size: int = 1 << 15, seed: int = 42
) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``fps`` (fp), enough to connect all that are linked."""
    n = fps.count()
    depth = max(0, min(math.ceil(math.log2(max(n, 1) / shard_size)), int(math.log2(sample_size)) - 3))
    # Hashes are uniform: the cut lets about sample_size of the n fingerprints through.
    drawn = F.xxhash64(F.lit(seed), "fp").cast("double") < (min(1.0, sample_size / max(n, 1)) - 0.5) * 2.0**64
    sample = np.array(sorted(r["fp"] for r in fps.where(drawn).collect()), np.int64).view(np.uint64)
    width = 64 // parts
    masks = [((1 << width) - 1) << (width * i) for i in range(parts)]
    trees = [plant(sample, mask, max_bits // parts, depth, seed) for mask in masks]

    def assign(extra: list[dict[int, int]], only_count: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = b.column("fp").to_numpy().view(np.uint64)
                for t, tree in enumerate(trees):
                    row, shard = tree.shards(own, extra[t], seed)
                    if only_count:
                        shard, size = np.unique(shard, return_counts=True)
                        columns = [pa.array(np.full(len(shard), t)), pa.array(shard), pa.array(size)]
                    else:
                        columns = [pa.array(np.full(len(shard), t)), pa.array(shard), pa.array(own[row].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "shard", "size" if only_count else "fp"])

        return run

    none = [{} for _ in trees]
    sizes = fps.mapInArrow(assign(none, True), "tree long, shard long, size long").groupBy("tree", "shard").agg(F.sum("size").alias("size"))
    extra = [{} for _ in trees]
    # At most one entry per leaf, and leaves are bounded by the sample.
    for r in sizes.where(F.col("size") > 4 * shard_size).collect():
        extra[r["tree"]][r["shard"]] = math.ceil(math.log2(r["size"] / (2 * shard_size)))

    def stars(u: np.ndarray, v: np.ndarray) -> pa.Table:
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    def pairs(key: tuple, rows: pa.Table) -> pa.Table:
        own = np.unique(rows.column("fp").to_numpy()).view(np.uint64)
        return stars(*close_pairs_as_stars(own, max_bits))

    placed = fps.mapInArrow(assign(extra, False), "tree long, shard long, fp long")
    if not any(extra):
        return placed.groupBy("tree", "shard").applyInArrow(pairs, "u long, v long").distinct()

    # A cloud of fingerprints that share a slice cannot be split by it: shards still large are cut into
    # blocks, and every two blocks of a shard meet in a task of their own.
    placed = written(placed, "fp-shards")
    large = placed.groupBy("tree", "shard").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 4 * shard_size)
    blocks = F.coalesce(F.ceil(F.col("size") / (2 * shard_size)), F.lit(1)).cast("int")
    cut = attach(placed, written(large, "fp-large"), ["tree", "shard"], "size").select(
        "tree", "shard", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    met = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "tree", "shard", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "fp")

    def block_pairs(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        own, fp = rows.column("own").to_numpy(), rows.column("fp").to_numpy()
        one, two = (np.unique(fp[own == b]).view(np.uint64) for b in (i, j))
        return stars(*close_pairs_as_stars(one, max_bits, other=None if i == j else two))

    return met.groupBy("tree", "shard", "i", "j").applyInArrow(block_pairs, "u long, v long").distinct()


def _grouped(
    docs: DataFrame, words: int, max_bits: int, id_col: str, text_col: str, seed: int, marks: dict[str, Column] | None = None, **how
) -> DataFrame:
    """One row per row of ``docs``: id, fp, root (the least fingerprint of its component), component_id and ``marks``."""
    rows = written(fingerprints(docs, id_col, text_col, words, seed, marks), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "fp-nodes")
    links = written(near_links(nodes.select("fp"), max_bits, seed=seed, **how), "fp-links")
    found = written(components(links), "fp-components")
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "n", "least", F.coalesce("root", "fp").alias("root")
    )
    # Summed up per root before the shuffle; a root's nodes then look it up.
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    labels = attach(written(rooted.select("fp", "n", "root"), "fp-roots"), written(smallest, "fp-smallest"), ["root"], "nodes")
    labels = written(labels.select("fp", "n", "root", "component_id"), "fp-labels")
    return attach(rows, labels, ["fp"], "n").select("id", "fp", "root", "component_id", *(marks or {}))


def near_duplicates(
    docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, **how
) -> DataFrame:
    """One row per row of ``docs``: id, fp, component_id.

    ``component_id`` is the smallest id that links lead to, the row's own
    included.  Null and empty texts have fingerprint 0, linked like any other.
    Rows without id take part; a component without any id has null.  Repeated
    rows and equal fingerprints are one node.  An empty table gives no rows.
    """
    return _grouped(docs, words, max_bits, id_col, text_col, seed, **how).select("id", "fp", "component_id")


def one_of_each(
    docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, **how
) -> DataFrame:
    """One row of ``docs``, all columns, for every group: the one with the smallest id.

    Groups are told apart by their links, not by ids: unrelated texts without id
    or with the same id all stay.  A row without id stays only where its whole
    group has none; then, and among rows of a group that share the smallest id,
    the one with the smallest hash over all columns stays.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marks = {"h1": F.xxhash64(row), "h2": F.xxhash64(F.lit("second"), row)}
    found = _grouped(docs, words, max_bits, id_col, text_col, seed, marks, **how)
    least = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min("component_id").alias("id"), F.min(F.struct(*marks)).alias("h"), F.count(F.lit(1)).alias("n")
    )
    # n counts all rows of a root with that id, so at least the equal ones.
    stay = written(least.select(tagged(F.col("id")).alias("key"), "h.*", "n"), "fp-stay")
    rows = docs.select(row.alias("row"), tagged(F.col(id_col)).alias("key"), *[c.alias(m) for m, c in marks.items()])
    kept = attach(rows, stay, ["key", *marks], "n").where("n IS NOT NULL")
    return kept.groupBy("key", *marks).agg(F.first("row").alias("row")).select("row.*")
