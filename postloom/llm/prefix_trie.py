"""Prefix trie of conversations by burst tries.

A conversation is a sequence of turns; a node is a distinct sequence of first
turns, the root the empty one.  The trie is never built in one place:

* a *container* holds the suffixes of all sequences below one node, equal
  suffixes folded into one row with a count;
* a container with more than ``capacity`` turns *bursts*: the turns that all its
  suffixes share become nodes at its head (their count is the container's), and
  the rest is divided by the next turn id into containers below the last of
  these nodes.  Sharing is read off the least and the greatest suffix, so a
  round of bursting always divides, however long the shared part is;
* containers that remain are bounded.  Their suffixes are sorted and swept: a
  stack holds the open path, and a node is finished when the next suffix leaves
  it, which is when its subtree is known.

A sequence is cut into segments of ``segment`` turns, so no row grows with its
conversation.  A later segment is a suffix of its own in the container of the
prefix before it, known by a chained digest; the nodes at the cut look up what
lies below them.  For that, sums per container are found for the later segments
first: each container's sum is booked to its smallest conversation, a running
sum along each conversation adds up what it was booked from there on, and a
grouped sum over the conversations through a cut gives the subtree.  So there is
no round per segment either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import attach, or_empty
from postloom.session import written

NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = ""  # the id of the root, first entry of every sequence


def ordered_turns(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    rows_per_task: int = 1 << 20,
) -> DataFrame:
    """conv_id, at (from 0), id, size: the turns of each conversation in order.

    Order is by turn, null first, then role, then text.  ``id`` is a digest of
    role and text (null: empty), ``size`` the text's code points.  Rows alike in
    all columns are turns of their own; rows without a conversation id belong to
    none and take no part.  Rows are range-partitioned and numbered on from the
    partitions before, so a conversation may hold any share of them.
    """
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), or_empty(F.col(role)).alias("role"),
        or_empty(F.col(text)).alias("text"),
    )
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_task))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    said = F.concat(F.length("role"), F.lit(":"), "role", "text")
    placed = written(
        rows.repartitionByRange(tasks, *order, F.left("text", F.lit(32))).sortWithinPartitions(*order, "text").select(
            "conv_id", F.left(F.sha2(said, 256), F.lit(32)).alias("id"), F.length("text").cast("long").alias("size"),
            F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place"),
        ),
        "turns",
    )
    starts = placed.groupBy("conv_id", "task").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return placed.join(starts, ["conv_id", "task"]).select(
        "conv_id", (F.col("place") - F.col("first") + F.col("before")).alias("at"), "id", "size")


def share_openings(turns: DataFrame, openers: Column, opening: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(conversations with conv_id; turns) after each conversation took another's first turns.

    A conversation gives up its first ``opening`` turns, at most ``most``, for as
    many first turns of conversation ``openers`` (fewer, if that has fewer; none,
    if it does not exist).  Both are Columns of conv_id.
    """
    turns = written(turns, "own-turns")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumns({"opener": openers, "h": opening.cast("int")})
    firsts = (
        turns.where(F.col("at") < most).groupBy(F.col("conv_id").alias("opener"))
        .agg(F.array_sort(F.collect_list(F.struct("at", "id", "size"))).alias("firsts"))
    )
    taken = F.coalesce(F.slice("firsts", F.lit(1), F.col("h")), F.array().cast("array<struct<at:bigint,id:string,size:bigint>>"))
    convs = written(convs.join(firsts, "opener", "left").withColumn("taken", taken).drop("firsts", "opener"), "openings")
    own = attach(turns, convs.select("conv_id", "n", "h", F.size("taken").alias("moved")), ["conv_id"], "n")
    kept = own.where(F.col("at") >= F.col("h")).select(
        "conv_id", (F.col("at") - F.col("h") + F.col("moved")).alias("at"), "id", "size")
    heads = convs.select("conv_id", F.inline("taken"))
    return convs.select("conv_id"), kept.unionByName(heads)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of all segments before each one, and whether it is its conversation's last; rows sorted."""
    held, prefix = None, ""

    def out(rows):
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(
            [("conv_id", pa.int64()), ("segment", pa.int64()), ("p", pa.string()), ("last", pa.bool_())]))

    for b in batches:
        rows = []
        for r in b.to_pylist():
            same = held is not None and held["conv_id"] == r["conv_id"]
            if held is not None:
                rows.append({"conv_id": held["conv_id"], "segment": held["segment"], "p": prefix, "last": not same})
            prefix = _below(prefix, held["digest"]) if same else ""
            held = r
        yield out(rows)
    if held is not None:
        yield out([{"conv_id": held["conv_id"], "segment": held["segment"], "p": prefix, "last": True}])


def _below(prefix: str, digest: str) -> str:
    return hashlib.sha256(f"{prefix}/{digest}".encode()).hexdigest()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids per key; rows sorted by key and id, nothing held but the running hash."""
    key, running = None, None

    def out(rows):
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("ends", pa.string())]))

    for b in batches:
        rows = []
        for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
            if k == key:
                running.update(b",%d" % c)
                continue
            if key is not None:
                rows.append({"key": key, "ends": running.hexdigest()})
            key, running = k, hashlib.sha256(b"%d" % c)
        yield out(rows)
    if key is not None:
        yield out([{"key": key, "ends": running.hexdigest()}])


def _segments(convs: DataFrame, turns: DataFrame, segment: int) -> DataFrame:
    """conv_id, segment, p (digest of what comes before), key (of p and ids), ids, sizes, last."""
    at = (F.col("at") + 1).alias("at")
    rows = turns.select("conv_id", at, "id", "size").unionByName(
        convs.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(ROOT).alias("id"), F.lit(0).cast("long").alias("size")))
    cut = (
        rows.groupBy("conv_id", F.floor(F.col("at") / segment).alias("segment"))
        .agg(F.array_sort(F.collect_list(F.struct("at", "id", "size"))).alias("t"))
        .select("conv_id", "segment", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"),
                F.sha2(F.array_join("t.id", ","), 256).alias("digest"))
    )
    cut = written(cut, "segments")
    alone = (F.col("segment") == 0) & (F.size("ids") < segment)
    linked = (
        cut.where(~alone).select("conv_id", "segment", "digest").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
        .mapInArrow(_chain, "conv_id long, segment long, p string, last boolean")
    )
    return cut.where(alone).withColumns({"p": F.lit(""), "last": F.lit(True)}).unionByName(
        cut.where(~alone).join(linked, ["conv_id", "segment"])
    ).withColumn("key", F.sha2(F.concat("p", F.lit("/"), "digest"), 256)).drop("digest")


BOX = ["box", "up", "head", "depth", "ids", "sizes", "n", "least", "ends", "more", "leaves", "saved"]
NODE = (
    "box string, up array<string>, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, ends_sha256 string"
)


def _sweep(rows: list[dict]) -> Iterator[dict]:
    """Nodes of one container from its suffixes in order.

    A node is a list: members, smallest member, children, leaves, saved, size of
    its last text, ends, and finished children that wait for their parent's id.
    """
    box, up, head, first = rows[0]["box"], rows[0]["up"], rows[0]["head"], rows[0]["depth"]
    path: list[list] = []
    ids: list[str] = []

    def close() -> Iterator[dict]:
        n, least, children, leaves, saved, size, ends, kids = path.pop()
        leaves, saved = leaves if children else 1, saved + (n - 1) * size
        for kid in kids:
            yield kid | {"parent_conv_id": least}
        node = {
            "box": None, "up": None, "conv_id": least, "depth": first + len(path), "parent_conv_id": head, "n_convs": n,
            "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends or NO_ENDS,
        }
        if not path:
            yield node | {"box": box, "up": up}
            return
        p = path[-1]
        p[0], p[1] = p[0] + n, least if p[1] is None else min(p[1], least)
        p[2], p[3], p[4] = p[2] + 1, p[3] + leaves, p[4] + saved
        p[7].append(node)

    for r in rows:
        common = 0
        for a, b in zip(ids, r["ids"]):
            if a != b:
                break
            common += 1
        while len(path) > common:
            yield from close()
        ids = r["ids"]
        path += [[0, None, 0, 0, 0, size, None, []] for size in r["sizes"][common:]]
        end = path[-1]
        end[0], end[1] = end[0] + r["n"], r["least"] if end[1] is None else min(end[1], r["least"])
        end[2], end[3], end[4], end[6] = end[2] + r["more"], end[3] + r["leaves"], end[4] + r["saved"], r["ends"]
    while path:
        yield from close()


def _sweep_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"box": pa.string(), "up": pa.list_(pa.string()), "ends_sha256": pa.string()}
    names = [c.split()[0] for c in NODE.split(", ")]
    schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in names])

    def nodes():
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["box"] != r["box"]:
                    yield from _sweep(held)
                    held = []
                held.append(r)
        if held:
            yield from _sweep(held)

    out = []
    for node in nodes():
        out.append(node)
        if len(out) == 4096:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _shared(lo: Column, hi: Column) -> Column:
    """How many first ids two sequences share."""
    same = F.zip_with(lo, hi, lambda a, b: F.coalesce(a == b, F.lit(False)))
    found = F.array_position(same, F.lit(False))
    return F.when(found == 0, F.size(lo)).otherwise(found - 1).cast("int")


def _nodes(boxes: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(nodes; per container of ``boxes`` its leaves and saved) by bursting and sweeping.

    Nodes with ``box`` are a container's first ones, ``up`` the containers that burst above it.
    """
    boxes = written(boxes.select(*BOX), "containers")
    closed, heads = [], []
    while True:
        sizes = boxes.groupBy("box").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.size("ids")).alias("turns"), F.sum("n").alias("box_n"),
            F.min("least").alias("box_least"), F.min("ids").alias("lo"), F.max("ids").alias("hi"),
        )
        large = written(
            sizes.where((F.col("rows") > 1) & (F.col("turns") > capacity))
            .select("box", "rows", "box_n", "box_least", _shared(F.col("lo"), F.col("hi")).alias("shared")),
            "burst",
        )
        if large.isEmpty():
            closed.append(boxes)
            break
        marked = attach(boxes, large, ["box"], "rows")
        closed.append(marked.where("rows IS NULL").select(*BOX))
        burst = written(
            marked.where("rows IS NOT NULL").withColumn("next", F.get("ids", F.col("shared"))), "bursting")
        by_next = burst.groupBy("box", "next").agg(
            F.first("up").alias("up"), F.first("head").alias("head"), F.first("depth").alias("depth"),
            F.first("box_n").alias("n"), F.first("box_least").alias("least"), F.max("ends").alias("ends"),
            F.first(F.slice("sizes", F.lit(1), F.col("shared"))).alias("sizes"),
        )
        heads.append(written(
            by_next.groupBy("box").agg(
                *[F.first(c).alias(c) for c in ("up", "head", "depth", "n", "least", "sizes")], F.count("next").alias("more"),
                F.max(F.when(F.col("next").isNull(), F.col("ends"))).alias("ends"),
            ), "heads"))
        rest = lambda c: F.slice(c, F.col("shared") + 1, F.size("ids")).alias(c)
        boxes = written(
            burst.where("next IS NOT NULL").select(
                F.sha2(F.concat("box", F.lit(">"), "next"), 256).alias("box"),
                F.concat("up", F.array("box")).alias("up"), F.col("box_least").alias("head"),
                (F.col("depth") + F.col("shared")).alias("depth"), rest("ids"), rest("sizes"),
                "n", "least", "ends", "more", "leaves", "saved",
            ), "containers")
    rows = closed[0]
    for part in closed[1:]:
        rows = rows.unionByName(part)
    swept = written(rows.repartition("box").sortWithinPartitions("box", "ids").mapInArrow(_sweep_all, NODE), "nodes")
    sums = [swept.where("box IS NOT NULL").select("box", "up", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))]
    if heads:
        head = heads[0]
        for part in heads[1:]:
            head = head.unionByName(part)
        # each of the shared turns saves n - 1 times its size
        saving = lambda sizes: F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x) * (F.col("n") - 1)
        sums.append(head.select("box", "up", F.lit(0).cast("long").alias("leaves"), saving(F.col("sizes")).alias("saved")))
        both = sums[0].unionByName(sums[1])
        below = (
            both.select(F.explode("up").alias("box"), "leaves", "saved")
            .groupBy("box").agg(F.sum("leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"))
        )
        last = F.size("sizes") - 1
        path = head.join(below, "box").select("*", F.posexplode("sizes").alias("i", "size")).select(
            F.lit(None).cast("string").alias("box"), F.lit(None).cast("array<string>").alias("up"),
            F.col("least").alias("conv_id"), (F.col("depth") + F.col("i")).alias("depth"),
            F.when(F.col("i") == 0, F.col("head")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(F.col("i") == last, F.col("more")).otherwise(1).alias("n_children"), F.col("below_leaves").alias("n_leaves"),
            (F.col("below_saved") + saving(F.slice("sizes", F.col("i") + 1, F.size("sizes")))).alias("saved_tokens"),
            F.when((F.col("i") == last) & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        swept = swept.unionByName(path)
    else:
        both = sums[0]
    totals = both.groupBy(F.coalesce(F.get("up", F.lit(0)), F.col("box")).alias("box")).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return swept.drop("box", "up"), totals


def prefix_trie(convs: DataFrame, turns: DataFrame, capacity: int = 1 << 16, segment: int = 512) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` holds every conv_id once, ``turns`` (conv_id, at, id, size) their
    turns, numbered from 0 without gaps; a conversation without turns is a member
    of the root alone.  conv_id and depth together name a node.  saved_tokens
    sums (members - 1) times the last turn's size over the subtree, ends_sha256
    covers the ids of the members that end at the node, ascending.  Equal
    conversations, however many, share their nodes; a turn's text is in neither
    table, so its length does not matter.  No conversations, no nodes.

    The ids that end at one node are hashed by one task, as the hash asks for it,
    in a sorted stream that holds none of them.
    """
    rows = written(_segments(convs, turns, segment), "trie-rows")
    folded = written(
        rows.groupBy("p", "key").agg(
            F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.first("segment").alias("segment"),
            F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"),
        ), "folded")
    ends = rows.where("last").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    folded = folded.join(ends.mapInArrow(_ends, "key string, ends string"), "key", "left")
    zero = F.lit(0).cast("long")
    folded = written(folded.withColumns({
        "box": F.col("p"), "up": F.array().cast("array<string>"), "head": F.lit(None).cast("long"),
        "depth": (F.col("segment") * segment).cast("long"),
    }), "suffixes")
    later = folded.where("segment > 0")
    if later.isEmpty():
        return _nodes(folded.withColumns({"more": zero, "leaves": zero, "saved": zero}), capacity)[0]
    # what lies below the cuts: first how many children, and whose nodes they hang from
    cuts = (
        later.groupBy("p", F.get("ids", F.lit(0)).alias("next")).agg(F.count(F.lit(1)).alias("r"), F.min("least").alias("owner"))
        .groupBy("p").agg(F.count(F.lit(1)).alias("more"), F.sum("r").alias("r"), F.min("owner").alias("owner"))
    )
    above = folded.select(F.col("key").alias("p"), F.col("least").alias("above"))
    cuts = written(cuts.join(above, "p"), "cuts")
    hung = attach(later.drop("head"), cuts.select("p", "r", F.col("above").alias("head")), ["p"], "r").drop("r")
    more = cuts.select(F.col("p").alias("key"), "more")
    known = lambda c: F.coalesce(c, zero).alias(c)
    hung = written(hung.join(more, "key", "left").withColumn("more", F.coalesce("more", zero)), "later-suffixes")
    _, totals = _nodes(hung.withColumns({"leaves": zero, "saved": zero}), capacity)
    booked = totals.withColumnRenamed("box", "p").join(cuts.select("p", "owner"), "p").withColumnRenamed("owner", "conv_id")
    onwards = Window.partitionBy("conv_id").orderBy(F.desc("segment"))
    below = written(
        rows.where("segment > 0").select("p", "conv_id", "segment").join(booked, ["p", "conv_id"], "left")
        .select("p", *[F.sum(known(c)).over(onwards).alias(c) for c in ("leaves", "saved")])
        .groupBy("p").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")),
        "below-cuts")
    whole = folded.where("segment = 0").join(more, "key", "left").unionByName(hung)
    whole = whole.join(below.withColumnRenamed("p", "key"), "key", "left")
    return _nodes(whole.withColumns({c: F.coalesce(F.col(c), zero) for c in ("more", "leaves", "saved")}), capacity)[0]
