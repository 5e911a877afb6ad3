"""Vectors, archives, the registered queries against SQL, and the pipeline."""

import gzip
import hashlib
import math
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postloom.llm import queries, topk, warc
from postloom.session import shared_folder, written

FOLDER = "/root/testdata/sf0.001"


def brute_top(rows, k, scale):
    whole = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(scale * x) for x in v]))
    out = Counter()
    for i, q in whole:
        if i % 20 == 0:
            scored = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q)]
            out.update((i, r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1))
    return out


@pytest.mark.parametrize("bits, block", [(4, 64), (1, 16), (6, 1024)])
def test_top_k(spark, bits, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(100)]  # a hot vector: ties
    rows += [(2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(3000, [1.0, 2.0]), (3001, [3.0, -1.0]), (3020, []), (3001, [3.0, -1.0]), (4000, [1e6] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = topk.top_k(table, F.col("vec_id") % 20 == 0, k=5, scale=64, bits=bits, block_rows=block, query_rows=8).collect()
    assert Counter((r.query_id, r["rank"], r.id, r.score) for r in got) == brute_top(rows, 5, 64)
    assert topk.top_k(table.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def block_of(x, ids, k, name="b"):
    (row,) = topk._vector_block(64, k)(name, list(ids), x.tolist()).to_pylist()
    return row


def test_exact_vectors_are_read_for_candidates_only(spark, monkeypatch):
    """The passes over the cells know no exact vectors; few of them are scored afterwards, in order of their bounds."""
    rng = np.random.default_rng(3)
    x, k = rng.integers(-64, 64, (2000, 16)), 5
    ids = np.arange(2000)
    block = block_of(x, ids, k)
    exact, kind = block.pop("exact"), block.pop("kind")
    q = topk._query_block("q", ids[:40].tolist(), x[:40].tolist()).to_pylist()[0] | block
    best = next(topk._lower_bounds(k)([pa.RecordBatch.from_pylist([q])])).to_pylist()[0]
    floor = next(topk._floors(k)([pa.RecordBatch.from_pylist([best])])).to_pylist()[0]["floor"]
    (asks,) = [b.to_pylist()[0] for b in topk._candidates([pa.RecordBatch.from_pylist([q | {"floor": floor}])])]
    scored, scores = [], topk.exact_scores
    monkeypatch.setattr(topk, "exact_scores", lambda a, b: scored.append(len(b)) or scores(a, b))
    names = {c.split()[0] for c in topk.ASKED.split(", ")}
    none = dict.fromkeys(names | {"ids", "kind", "exact"})
    rows = [none | {"vb": "b", "ids": block["ids"], "kind": kind, "exact": exact}, none | asks]
    schema = pa.schema([(c, pa.string() if c in ("vb", "qb", "kind") else pa.int64() if c == "dim" else pa.binary()) for c in none])
    got = [r for b in topk._read(k)([pa.RecordBatch.from_pylist(rows, schema=schema)]) for r in b.to_pylist()]
    assert Counter((r["query"], r["id"], r["score"]) for r in got) == Counter(
        (i, j, s) for i in range(40) for s, j in sorted(((int(x[i] @ x[j]), j) for j in range(2000) if j != i), key=lambda t: (-t[0], t[1]))[:k])
    assert 40 * k <= sum(scored) < 40 * 2000 / 50
    with pytest.raises(RuntimeError):
        list(topk._read(k)([pa.RecordBatch.from_pylist(rows[1:], schema=schema)]))


def test_equal_vectors_that_cannot_be_among_the_best():
    x = np.array([[1, 2]] * 90 + [[3, 4]] * 3 + [[1, 2]] * 20)
    ids = np.concatenate([np.arange(90), [7, 8, 9], np.full(20, -5)])
    live = topk.standing(ids, x, 4)
    assert Counter(ids[live].tolist()) == Counter([-5] * 4 + [0, 1, 2, 3] + [7, 8, 9])
    for i in (0, 2, 50, -5, 7):  # whatever the query's own id, its best rows stand
        ranked = lambda at: sorted((-int(x[j] @ [1, 1]), int(ids[j])) for j in at if ids[j] != i)[:4]
        assert ranked(live) == ranked(range(len(ids)))


@pytest.mark.parametrize("size", [60, 2**20, 2**40])
def test_bounds_hold(size):
    rng = np.random.default_rng(size % 1000)
    q, x = rng.integers(-size, size, (20, 8)), rng.integers(-size, size, (300, 8))
    cell, low, high = topk.approximate(x, 16)
    lo, hi = low[np.arange(8), cell], high[np.arange(8), cell]
    exact = q.astype(object) @ x.astype(object).T
    assert (topk.bounds(q, lo, hi, upper=False) <= exact).all() and (exact <= topk.bounds(q, lo, hi, upper=True)).all()


def test_passes_read_no_exact_vectors(spark, monkeypatch):
    plans, kept = [], topk.written
    def watched(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, label)
    monkeypatch.setattr(topk, "written", watched)
    table = spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(400)], "vec_id long, embedding array<double>")
    assert topk.top_k(table, F.col("vec_id") % 20 == 0, k=5, block_rows=64).count() == 100
    for label, plan in plans:
        if label in ("va-floors", "va-candidates"):
            assert "exact#" not in plan and "cell#" in plan


def test_blocks_are_not_broadcast(spark, monkeypatch):
    """Dealt out to all slices, small files of queries once filled the driver's memory."""
    plans, kept = {}, topk.written
    def watched(df, label):
        out = kept(df, label)
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return out
    monkeypatch.setattr(topk, "written", watched)
    table = spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(400)], "vec_id long, embedding array<double>")
    assert topk.top_k(table, F.col("vec_id") % 20 == 0, k=5, block_rows=64).count() == 100
    for label in ("va-floors", "va-candidates"):
        assert "SortMergeJoin" in plans[label] and "Broadcast" not in plans[label]


def test_lower_bounds_of_a_slice_are_one_row_per_query_block():
    rng = np.random.default_rng(5)
    x, k = rng.integers(-64, 64, (300, 8)), 4
    q = topk._query_block("q", list(range(5)), x[:5].tolist()).to_pylist()[0]
    rows = [q | block_of(x[i : i + 100], range(i, i + 100), k, f"b{i}") for i in range(0, 300, 100)]
    (one,) = [r for b in topk._lower_bounds(k)([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    each = [np.frombuffer(next(topk._lower_bounds(k)([pa.RecordBatch.from_pylist([r])])).column("best")[0].as_py()).reshape(5, k) for r in rows]
    best = np.sort(np.concatenate(each, axis=1), axis=1)[:, -k:]
    assert (np.sort(np.frombuffer(one["best"]).reshape(5, k), axis=1) == best).all()


def test_archives(spark):
    big, odd = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 3000, "x\x00\x1f" * 500
    rows = [(1, "u", big), (2, None, big), (3, "http://a/\r\nb c", big), (4, "u", odd), (5, "u", odd), (6, "u", "small"), (7, "u", "small"),
            (8, "u", None), (9, "u", ""), (9, "u", ""), (1, "u", big), (None, "u", big), (None, None, None)]
    rows += [(100 + i, "hot", "copy " * 300) for i in range(50)]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, payload string, key string")
    folder = warc.write_archives(table.repartition(3), segment_bytes=5000, chunk_bytes=700, records_per_file=7)
    got = warc.read_payloads(spark, folder).collect()
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    want = Counter((hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode())) for _, _, h in rows)
    assert Counter((r.payload_digest, r.payload_bytes) for r in got) == want
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.type == "response")
    of = defaultdict(list)
    for r in got:
        of[r.payload_digest].append(r)
    for own in of.values():
        answers = [r for r in own if r.type == "response"]
        if own[0].payload_bytes >= 1000:
            assert len(answers) == 1 and all(r.refers_to == answers[0].record_id for r in own if r.type == "revisit")
        else:
            assert len(answers) == len(own)
    assert [r.record_id for r in of[hashlib.sha1(big.encode()).hexdigest()] if r.type == "response"] == ["<urn:page:v3:1>"]
    assert warc.read_records(spark, folder).where("type = 'continuation'").count() > 10


def test_rows_that_share_an_id(spark):
    """An id on several payloads, and null ids on a third of all rows: every row comes back, under an id of its own."""
    rows = [(5, "a", "x" * 30_000), (5, "a", "y" * 40_000), (6, "b", "x" * 30_000), (5, "c", "z"), (5, "c", "z")]
    rows += [(None, f"u{i}", None if i % 2 else "same page " * 500) for i in range(20)] + [(100 + i, "d", f"{i}" * 1500) for i in range(20)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.read_payloads(spark, warc.write_archives(table, segment_bytes=4000)).collect()
    assert len(got) == len(rows) == len({r.record_id for r in got}) and all(r.problem is None for r in got)
    assert Counter((r.payload_digest, r.payload_bytes) for r in got) == Counter(
        (hashlib.sha1((h or "").encode()).hexdigest(), len(h or "")) for *_, h in rows)
    of = {r.record_id: r for r in got}
    for r in got:
        if r.type == "revisit":
            assert of[r.refers_to].type == "response" and of[r.refers_to].payload_digest == r.payload_digest
    assert Counter(r.type for r in got)["revisit"] == 1 + 9
    assert of["<urn:page:v6:1>"].type == "response"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_payloads(spark, warc.write_archives(empty)).count() == 0


def test_archives_in_pieces():
    page = {"key": "v1", "copy": 1, "url": "u", "payload": "p" * 9000, "refers": None}
    data = b"".join(r + warc.BREAK for r in warc.page_records(page, "d", 700, 100))
    whole = list(warc.parse(data))
    for size in (1, 7, 100, 5000):
        pieces = (data[i : i + size] for i in range(0, len(data), size))
        assert list(warc._records(pieces)) == whole
    assert [r["problem"] for r in warc._records(iter((data, b"WARC/1.1\r\nContent-Length: 9\r\n", b"\r\nabc")))][-1] == "record cut short"


def test_damaged_archives():
    page = {"key": "v1", "copy": 1, "url": "u", "payload": "p" * 900, "refers": None}
    records = list(warc.page_records(page, "d", 300, 100))
    data = b"".join(r + warc.BREAK for r in records)
    assert [r["segment"] for r in warc.parse(data)] == list(range(1, len(records) + 1))
    assert list(warc.parse(data[:-40]))[-1]["problem"] == "record cut short"
    assert list(warc.parse(b"junk"))[0]["problem"] == "no record header"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.unchunked(warc.chunked(b"abc" * 99, 7)) == b"abc" * 99


def test_archives_of_many_members(spark, tmp_path):
    page = {"key": "v1", "copy": 1, "url": "u", "payload": "p" * 900, "refers": None}
    records = [r + warc.BREAK for r in warc.page_records(page, "d", 300, 100)]
    packed = [gzip.compress(r) for r in records]
    (tmp_path / "CC-0.warc.gz").write_bytes(b"".join(packed))
    (tmp_path / "CC-1.other").write_bytes(b"".join(packed))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    assert warc.read_records(spark, str(tmp_path)).count() == 2 * len(records) > 4
    got = warc.read_payloads(spark, str(tmp_path), "*.warc.gz").collect()
    assert [(r.problem, bytes(r.payload)) for r in got] == [(None, b"p" * 900)]
    for data, problem in ((b"junk", "no gzip member"), (packed[0][:-9], "gzip member cut short"), (packed[0][:10] + b"\xff" * 40, "gzip member damaged")):
        text, left = warc.gunzipped(b"".join(packed) + data)
        assert text.startswith(b"".join(records)) and left["problem"] == problem and left["block"] == data
    many = [gzip.compress(f"{i} ".encode() * 9) for i in range(5000)]  # members that span what is fed at a time
    assert warc.gunzipped(b"".join(many)) == (b"".join(f"{i} ".encode() * 9 for i in range(5000)), None)
    (tmp_path / "CC-2.warc.gz").write_bytes(b"".join(packed) + b"junk")
    assert [r.problem for r in warc.read_payloads(spark, str(tmp_path), "CC-2*").collect() if r.problem] == ["no gzip member"]


def test_missing_segments_are_reported(spark, tmp_path):
    page = {"key": "v1", "copy": 1, "url": "u", "payload": "p" * 900, "refers": None}
    records = list(warc.page_records(page, "d", 300, 100))
    for name, kept in (("gap", [records[0], *records[2:]]), ("end", records[:-1]), ("twice", [*records, records[1]])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0").write_bytes(b"".join(r + warc.BREAK for r in kept[::-1]))
        problem = [r.problem for r in warc.read_payloads(spark, str(tmp_path / name)).collect()]
        assert len(problem) == 1 and problem[0] in ("segment missing or repeated", "total length differs")


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    got = sorted(tuple(cell(r[c]) for c in columns) for r in frame.collect())
    assert got == sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_every_query_is_there():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_on_awkward_and_empty_tables(spark, docs, nothing):
    more = docs.unionByName(docs.where("doc_id < 8").withColumn("lang", F.lit("en"))).unionByName(
        spark.range(40).select(*[(F.lit(None).cast(f.dataType) if f.name != "text" else F.concat(
            F.lit("some words that make a text number "), "id")).alias(f.name) for f in docs.schema]))
    for table in (written(more, "awkward"), nothing):
        at, sizes = table, [table.count()]
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = written(stage(spark, at, FOLDER), name)
            assert at.columns == table.columns
            sizes.append(at.count())
        assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] and sizes[4] <= 2 * sizes[3]
        out = corpus_pipeline.STAGES[-1][1](spark, at, FOLDER)
        assert out.count() == sizes[-1] and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        # each stage takes the awkward rows as they are, too
        for name, stage in corpus_pipeline.STAGES[1:]:
            rows = stage(spark, table, FOLDER)
            assert rows.count() <= 2 * sizes[0]
            if name == "bpe":
                assert rows.count() == sizes[0]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = written(stage(spark, table, FOLDER), name)
        assert table.columns == docs.columns
        kept[name] = [r.doc_id for r in table.select("doc_id").collect()]
    best = {}
    for r in docs.where(F.col("doc_id").isin(kept["language_id"])).collect():
        key = queries.LOWER and r.text.translate(str.maketrans(queries.UPPER, queries.LOWER))
        best[key] = max(best.get(key, -1), r.doc_id)
    assert sorted(kept["exact_dedup"]) == sorted(best.values())
    assert set(kept["mixing"]) <= set(kept["simhash_near_dedup"]) and max(Counter(kept["mixing"]).values()) == 2
    before = set(os.listdir(shared_folder(spark)))
    assert corpus_pipeline.run(spark, FOLDER).count() == len(kept["mixing"])
    # what stages return is there, what they wrote on their way is not
    left = sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(shared_folder(spark))) - before)
    assert left == sorted(name for name, _ in corpus_pipeline.STAGES[:-1])
