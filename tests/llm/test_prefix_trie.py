"""Prefix tries against a brute-force trie: bursts, cuts, copies, awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from postloom.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, box string, ids string, n string, id string, at string"


def opening(conv_id):
    base = abs(conv_id) // 100 * 100
    return base if conv_id >= 0 else -base, zlib.crc32(str(conv_id).encode()) % 6


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        base, h = opening(c)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = Counter()
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        out[min(m), len(k), parent, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def trie(table, **sizes):
    conv = F.col("conv_id")
    convs, turns = prefix_trie.share_openings(
        prefix_trie.ordered_turns(table, rows_per_task=50), conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5)
    nodes = prefix_trie.prefix_trie(convs, turns, **sizes)
    assert nodes.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in nodes.collect())


def conversations(seed, n, words, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 600), n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"][: 1 + seed % 2]), rng.choice(words)))
    return rows


AWKWARD = [
    (7, None, "user", "null turn"), (7, None, None, None), (7, None, None, None), (7, 3, "é", "日本語 𝒳"), (7, 3, "user", "tie b"),
    (7, 3, "user", "tie a"), (7, 1, None, ""), (None, 1, "user", "nobody's"), (None, None, None, None),
    (100, 0, "user", "x" * 100_000), (100, 0, "user", "x" * 100_000), (100, 1, "assistant", ""), (101, 0, "user", "x" * 100_000),
    *[(200 + i, t, "user", f"line {t % 3}") for i in range(40) for t in range(12)],  # copies
    *[(500, t, "user", str(t % 2)) for t in range(300)], *[(501, t, "user", str(t % 2)) for t in range(290)],  # most of the rows
]


@pytest.mark.parametrize("rows, sizes", [
    (conversations(1, 60, ["a", "bb", "ccc"], 9), {}),
    (conversations(2, 80, ["a", "bb"], 12), {"capacity": 20, "segment": 4}),
    (conversations(3, 80, ["a"], 12), {"capacity": 5, "segment": 3}),
    (AWKWARD, {"capacity": 30, "segment": 7}),
    (AWKWARD, {"capacity": 16}),
])
def test_same_nodes_as_brute_force(spark, rows, sizes):
    table = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA).repartition(5)
    assert trie(table, **sizes) == brute(rows)


def test_no_conversations(spark):
    assert not trie(spark.createDataFrame([], SCHEMA))
    assert not trie(spark.createDataFrame([(None, 1, "user", "x", *["clash"] * 5)], SCHEMA))


def test_sql_on_awkward_rows(tmp_path):
    """The SQL by which the query is compared agrees with the brute force too."""
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", AWKWARD)
    assert Counter(con.execute(queries.ORACLES["op11_prefix_trie"]).fetchall()) == brute(AWKWARD)
