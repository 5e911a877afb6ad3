import os
import random
import re

import pytest
from pyspark.sql import functions as F

from postloom.operators import ingest, keys
from postloom.operators.components import components
from postloom.sources import store
from postloom.streaming import ingest as streams

AS_OF = "2024-05-01 00:00:00"
JOBS = ("id long, title string, company string, url string, job_board string, scraped_at timestamp_ntz, "
        "updated_at timestamp_ntz, fingerprint string, last_seen_at timestamp_ntz, is_active boolean")


def sequential(rows):
    """Keep rows in order, remembering the keys of kept ones."""
    urls, fps, kept = set(), set(), set()
    for seq, url, fp in sorted(rows):
        if url in urls or (fp is not None and fp in fps):
            continue
        kept.add(seq)
        urls.add(url)
        fps.add(fp)
    return kept


def random_rows(rng, n, urls, fps, hot=0.0):
    rows = []
    for seq in rng.sample(range(10 * n), n):
        fp = "hot" if rng.random() < hot else rng.choice([None] + [f"f{i}" for i in range(fps)])
        rows.append((seq, f"u{rng.randrange(urls)}", fp))
    return rows


@pytest.mark.parametrize("seed,urls,fps,hot", [(1, 30, 30, 0), (2, 200, 5, 0), (3, 5, 200, 0), (4, 150, 150, 0.34)])
def test_ordered_dedup_equals_sequential(spark, seed, urls, fps, hot):
    rows = random_rows(random.Random(seed), 400, urls, fps, hot)
    frame = spark.createDataFrame(rows, "seq long, url string, fingerprint string")
    got = {r["seq"] for r in ingest.ordered_dedup(frame).collect()}
    assert got == sequential(rows)


def test_ordered_dedup_is_not_transitive(spark):
    # b shares a's url; c shares only b's fingerprint, and b is dropped, so c stays
    rows = [(1, "u1", "f1"), (2, "u1", "f2"), (3, "u2", "f2")]
    frame = spark.createDataFrame(rows, "seq long, url string, fingerprint string")
    assert {r["seq"] for r in ingest.ordered_dedup(frame).collect()} == {1, 3}


def test_ordered_dedup_long_chain(spark):
    rows = [(i, f"u{i // 2}", f"f{(i + 1) // 2}") for i in range(12)]
    frame = spark.createDataFrame(rows, "seq long, url string, fingerprint string")
    assert {r["seq"] for r in ingest.ordered_dedup(frame).collect()} == sequential(rows)


def test_ordered_dedup_empty(spark):
    frame = spark.createDataFrame([], "seq long, url string, fingerprint string")
    assert ingest.ordered_dedup(frame).count() == 0


def chains(n, length):
    """Chains in which every row hangs on the one before, in a shuffled order of arrival."""
    rows = []
    for c in range(n):
        keys_of = [(f"u{c}-{(i + 1) // 2}", f"f{c}-{i // 2}") for i in range(length)]
        rows += [(i * n + c, *k) for i, k in enumerate(keys_of)]
    return rows


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rows = chains(30, 1000)
    frame = spark.createDataFrame(rows, "seq long, url string, fingerprint string").repartition(8)
    steps = []
    monkeypatch.setattr(ingest, "written", lambda df, label, real=ingest.written: (steps.append(label), real(df, label))[1])
    got = {r["seq"] for r in ingest.ordered_dedup(frame).collect()}
    assert got == sequential(rows) and 30 * 400 < len(got) < 30 * 600
    assert steps.count("kept") == ingest.ROUNDS + 1  # and then every chain by itself


def test_rows_without_chains_are_decided_in_two_exchanges(spark, monkeypatch):
    # copies of urls and fingerprints, but no row that is dropped stands before another
    rows = [(i, f"u{i % 700}", None if i % 5 == 0 else f"f{i % 350}") for i in range(2000)]
    steps, plans = [], []

    def counted(df, label, real=ingest.written):
        steps.append(label)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(ingest, "written", counted)
    frame = spark.createDataFrame(rows, "seq long, url string, fingerprint string")
    assert {r["seq"] for r in ingest.ordered_dedup(frame).collect()} == sequential(rows)
    assert steps == ["first-round"] and plans[0].count("Exchange hashpartitioning") == 2


def test_ordered_dedup_keeps_copies_of_a_kept_row(spark):
    rows = [(1, "u1", "f1"), (1, "u1", "f1"), (2, "u1", "f2"), (3, None, "f3"), (4, "u4", None), (5, "u4", "f2"), (6, "u6", "f2")]
    frame = spark.createDataFrame(rows, "seq long, url string, fingerprint string")
    assert sorted(r["seq"] for r in ingest.ordered_dedup(frame).collect()) == [1, 1, 4, 6]


@pytest.mark.parametrize("limit", [0, 3, 40])
def test_large_components_go_on_in_rounds(spark, limit):
    rng = random.Random(limit)
    rows = chains(3, 10) + [(1000 + s, u, f) for s, u, f in random_rows(rng, 150, 60, 60, 0.1)]
    frame = spark.createDataFrame(rows, "seq long, url string, fingerprint string")
    got = {r["seq"] for r in ingest.ordered_dedup(frame, component_rows=limit).collect()}
    assert got == sequential(rows)


def test_components_of_a_long_path_and_a_star(spark):
    order = list(range(500))
    random.Random(1).shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(500), 0), **dict.fromkeys(range(1000, 1300), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stored_side_is_cut_before_it_is_shuffled(spark):
    stored = spark.range(100_000).select("id", F.concat(F.lit("u"), "id").alias("url")).unionByName(
        spark.range(5).select((-F.col("id")).alias("id"), F.lit(None).cast("string").alias("url")))
    batch = spark.range(0, 200_000, 200).select(F.concat(F.lit("u"), "id").alias("url")).union(spark.createDataFrame([(None,)], "url string"))
    near = {r["id"] for r in keys.maybe_among(stored, batch, "url").collect()}
    assert set(range(0, 100_000, 200)) <= near and len(near) < 500 + 0.03 * 100_000
    assert keys.maybe_among(stored, batch, "url", max_words=10).count() == 100_000  # too many keys for the filter
    found = ingest.j_exists_url(batch, stored).where("url_id IS NOT NULL")
    assert found.count() == 500
    plan = ingest._lookup(batch, stored, "url", "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("BroadcastHashJoin")  # cut below the first exchange of the stored side
    assert keys.maybe_among(stored, batch.limit(0), "url").count() == 0


def load_by_row(stored, incoming):
    """Outcome per incoming row when rows are loaded one after another."""
    table = [dict(id=i, url=u, fp=f, new=False) for i, u, f in stored]
    out = {}
    for seq, url, fp in sorted(incoming):
        hit = min((t for t in table if t["url"] == url), key=lambda t: t["id"], default=None)
        hit = hit or min((t for t in table if fp is not None and t["fp"] == fp), key=lambda t: t["id"], default=None)
        if hit is None:
            table.append(dict(id=10_000 + seq, url=url, fp=fp, new=True))
            out[seq] = ("new", None)
        else:
            out[seq] = ("repeat", None) if hit["new"] else ("touch", hit["id"])
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_classify_equals_row_by_row(spark, seed):
    rng = random.Random(seed)
    stored = [(i, f"u{1000 + i}" if rng.random() < 0.5 else f"u{i}", rng.choice([None, f"f{rng.randrange(40)}"])) for i in range(40)]
    incoming = random_rows(rng, 300, 80, 80)
    jobs = spark.createDataFrame(stored, "id long, url string, fingerprint string")
    frame = spark.createDataFrame(incoming, "seq long, url string, fingerprint string")
    got = {r["seq"]: (r["outcome"], r["job_id"]) for r in ingest.classify(frame, jobs).collect()}
    assert got == load_by_row(stored, incoming)


def exchanged(plan):
    """Columns of each exchange by key in a plan."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\), ", plan)


def test_outcomes_take_two_exchanges_of_the_records(spark, monkeypatch):
    # urls and fingerprints that others have, stored ones, records without fingerprint
    rows = [(i, f"u{i % 900}", None if i % 7 == 0 else f"f{i % 600}", f"title {i}") for i in range(2000)]
    stored = [(i, f"u{i}", f"f{i + 300}") for i in range(50)]
    plans = {}

    def watched(df, label, real=ingest.written):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(ingest, "written", watched)
    frame = spark.createDataFrame(rows, "seq long, url string, fingerprint string, title string")
    jobs = spark.createDataFrame(stored, "id long, url string, fingerprint string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records, outcomes = ingest.classify_rows(frame, jobs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {r["seq"]: (r["outcome"], r["job_id"]) for r in outcomes.collect()}
    assert got == load_by_row(stored, [r[:3] for r in rows])
    by_key = [c for c in exchanged(plans["classified"][0]) if "_word" not in c]
    # the records by url and by fingerprint, and the stored keys by each
    assert len(by_key) == 4 and sum(c.startswith("_key") for c in by_key) == 2
    # whole records stay out of the exchanges by key
    assert "title" not in plans["classified"][0] and "title" in records.columns
    whole = {r["seq"]: (r["title"], r["outcome"]) for r in ingest.whole_outcomes(records, outcomes).collect()}
    assert whole == {s: (t, got[s][0]) for s, _, _, t in rows}


@pytest.mark.parametrize("seed", [7, 8])
def test_outcomes_of_urls_that_return(spark, seed):
    # few urls and fingerprints: first records of a url that are stored by fingerprint, chains, rows without fingerprint
    rng = random.Random(seed)
    stored = [(i, f"s{i}", f"f{i}") for i in range(8)]
    rows = random_rows(rng, 400, 120, 150, 0.05)
    jobs = spark.createDataFrame(stored, "id long, url string, fingerprint string")
    frame = spark.createDataFrame(rows, "seq long, url string, fingerprint string")
    got = {r["seq"]: (r["outcome"], r["job_id"]) for r in ingest.classify(frame, jobs, []).collect()}
    want = load_by_row(stored, rows)
    assert got == want and {"touch", "new", "repeat"} == {o for o, _ in want.values()}


def test_numbered_is_dense(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("seq"))
    got = [r["id"] for r in ingest.numbered(rows, "seq", 11).orderBy("seq").collect()]
    assert got == list(range(11, 1011))
    assert ingest.numbered(rows, "seq", 0, "_at").agg(F.max("_at")).first()[0] == 999  # the name match_upsert asks for
    many = ingest.numbered(rows, "seq", 11, rows_per_task=90)
    assert [(r["seq"], r["id"]) for r in many.orderBy("seq").collect()] == [(i, i + 11) for i in range(1000)]
    # numbered where they lie: only the sizes of the partitions are exchanged again
    assert "Exchange hashpartitioning(seq" not in many._jdf.queryExecution().executedPlan().toString()
    assert many._jdf.queryExecution().executedPlan().toString().count("Window") == 1


def test_outcomes_carry_what_is_asked_for(spark):
    jobs = spark.createDataFrame([(1, "u1", "f1")], "id long, url string, fingerprint string")
    rows = spark.createDataFrame([(1, "u1", "f9", "a", "x"), (2, "u2", "f2", "b", "y")],
                                 "seq long, url string, fingerprint string, job_board string, title string")
    found = ingest.classify(rows, jobs, ["job_board"])
    assert found.columns == ["fingerprint", "url", "seq", "job_board", "job_id", "outcome"]
    assert sorted((r["seq"], r["job_board"], r["outcome"]) for r in found.collect()) == [(1, "a", "touch"), (2, "b", "new")]
    assert set(ingest.classify(rows, jobs).columns) == {*rows.columns, "job_id", "outcome"}


def incoming(spark, rows):
    return spark.createDataFrame(rows, "seq long, title string, company string, url string, job_board string")


def test_ingest_whole_load(spark):
    stored = spark.createDataFrame([(5, "T", "C", "u5", "b", None, None, None, None, False)], JOBS)
    stored = stored.withColumn("scraped_at", F.lit("2020-01-01").cast("timestamp_ntz"))
    rows = [(1, "T", "C", "u5", "b"), (2, "A", "C", "u6", "b"), (3, "a", " c ", "u7", "B"), (4, None, "C", "u8", "b"), (5, "Z", "C", "u9", "b")]
    after, outcomes, rejects = ingest.ingest(stored, incoming(spark, rows), AS_OF)
    got = {r["id"]: r for r in after.collect()}
    assert {k: (r["url"], r["is_active"]) for k, r in got.items()} == {5: ("u5", True), 6: ("u6", True), 7: ("u9", True)}
    assert str(got[5]["last_seen_at"]) == AS_OF and str(got[5]["scraped_at"]) == "2020-01-01 00:00:00"
    counts = ingest.run_counts(outcomes, rejects).first().asDict()
    assert counts == dict(name="b", jobs_scraped=4, jobs_added=2, duplicates=1, errors=1) or counts["name"] == "B"
    total = ingest.run_counts(outcomes, rejects).agg(F.sum("jobs_scraped"), F.sum("duplicates"), F.sum("errors")).first()
    assert tuple(total) == (5, 2, 1)
    failed = ingest.commit_failed(ingest.run_counts(outcomes, rejects)).agg(F.sum("jobs_added"), F.sum("errors")).first()
    assert tuple(failed) == (0, 3)


def test_backfill(spark):
    rows = spark.createDataFrame([("T", "C", "b", None), ("T", "C", "b", "kept")], "title string, company string, job_board string, fingerprint string")
    got = {r["fingerprint"]: r["backfilled"] for r in ingest.fp_backfill(rows).collect()}
    assert got.pop("kept") is False and list(got.values()) == [True]


def test_stream_loads_batch_after_batch(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "T", "C", "u1", "b", None, None, None, None, False)], JOBS)
    folder, landing = str(tmp_path / "jobs"), str(tmp_path / "landing")
    store.create_store(jobs, folder, bucket_rows=2)
    batches = [[(1, "A", "C", "u2", "b")], [(2, "T", "C", "u1", "b"), (3, "A", "X", "u2", "b")], [(4, "N", "C", "u4", "b")]]

    def run():
        query = streams.stream_ingest(streams.landed(spark, landing, incoming(spark, batches[0]).schema), folder, jobs.schema,
                                      str(tmp_path / "offsets"), AS_OF, fold_every=2)
        query.awaitTermination()

    for rows in batches[:2]:
        incoming(spark, rows).coalesce(1).write.mode("append").parquet(landing)
    run()
    incoming(spark, batches[2]).coalesce(1).write.mode("append").parquet(landing)
    run()  # goes on where the first run stopped
    got = {r["id"]: (r["url"], r["is_active"]) for r in store.read_store(spark, folder, jobs.schema).collect()}
    assert got == {1: ("u1", True), 2: ("u2", True), 3: ("u4", True)}
    assert store.folded(spark, folder) == (1, 2, 2)  # two batches in the buckets, the third in the log


def files(folder):
    return {str(f): f.stat().st_size for f in folder.rglob("*.parquet")}


def posting(i):
    return (i, f"T{i}", f"C{i}", f"u{i}", "b", None, None, f"f{i}", None, False)


def test_loads_write_what_the_batch_touches(spark, tmp_path):
    rows = [(1, "T7", "C7", "u7", "b"), (2, "T950", "C", "u950", "b"), (3, "new", "C", "v1", "b")]
    written = {}
    for size in (1000, 8000):
        folder = tmp_path / str(size)
        jobs = spark.createDataFrame([posting(i) for i in range(1, size + 1)], JOBS)
        store.create_store(jobs, str(folder), bucket_rows=100)
        before = files(folder)
        ingest.load_into(spark, str(folder), jobs.schema, incoming(spark, rows), AS_OF, 0)
        after = files(folder)
        written[size] = sum(n for f, n in after.items() if f not in before)
        changed = {f.split("bucket=")[1].split("/")[0] for f in after if f not in before and "bucket=" in f}
        assert changed == {"0", "9", str((size + 1) // 100)}
        got = {r["id"]: (r["url"], r["is_active"], str(r["last_seen_at"])) for r in store.read_store(spark, str(folder), jobs.schema).collect()}
        assert len(got) == size + 1 and got[size + 1] == ("v1", True, AS_OF) and got[8] == ("u8", False, "None")
        assert got[7] == ("u7", True, AS_OF) and got[950] == ("u950", True, AS_OF)
    assert written[8000] < 1.2 * written[1000]


def test_a_fold_takes_one_exchange_of_the_postings(spark):
    rows = spark.createDataFrame([posting(i) for i in range(1, 40)], JOBS)
    seen = spark.createDataFrame([(3, "2024-01-01"), (3, "2024-01-03"), (25, "2024-01-02")], "id long, at string").select(
        "id", F.col("at").cast("timestamp_ntz").alias("last_seen_at"))
    found = store._sighted_in_buckets(rows, seen, 10)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = {r["id"]: (r["bucket"], r["is_active"], str(r["last_seen_at"]), str(r["updated_at"])) for r in found.collect()}
    assert len(got) == 39 and got[4] == (0, False, "None", "None")
    assert got[3] == (0, True, *["2024-01-03 00:00:00"] * 2) and got[25] == (2, True, *["2024-01-02 00:00:00"] * 2)
    want = store.sighted(rows, seen).select(*rows.columns).collect()
    assert sorted(map(str, found.select(*rows.columns).collect())) == sorted(map(str, want))


def test_repeated_steps_give_the_same_table(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "jobs")
    jobs = spark.createDataFrame([posting(i) for i in range(1, 31)], JOBS)
    store.create_store(jobs, folder, bucket_rows=10)

    def state():
        return sorted(map(str, store.read_store(spark, folder, jobs.schema).collect()))

    first = [(1, "T3", "C3", "u3", "b"), (2, "n", "C", "v1", "b")]
    ingest.load_into(spark, folder, jobs.schema, incoming(spark, first), AS_OF, 0, fold_now=False)
    once = state()
    ingest.load_into(spark, folder, jobs.schema, incoming(spark, first), AS_OF, 0, fold_now=False)
    assert state() == once
    second = [(1, "n", "C", "v1", "b"), (2, "m", "C", "v2", "b"), (3, "T25", "C25", "u25", "b")]
    ingest.load_into(spark, folder, jobs.schema, incoming(spark, second), AS_OF, 1, fold_now=False)
    twice = state()
    assert len(twice) == 32
    # a fold that stops after the buckets are replaced, before it is noted
    note = store._note
    monkeypatch.setattr(store, "_note", lambda *a: note(*a) if a[3] == "staged" else (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.fold(spark, folder, jobs.schema, 1)
    monkeypatch.undo()
    assert state() == twice and store.folded(spark, folder).load == -1
    outcomes, _ = ingest.load_into(spark, folder, jobs.schema, incoming(spark, second), AS_OF, 1, fold_now=True)
    assert sorted((r["seq"], r["outcome"]) for r in outcomes.collect()) == [(1, "touch"), (2, "new"), (3, "touch")]
    assert state() == twice and store.folded(spark, folder) == (1, 32, 10)
    store.fold(spark, folder, jobs.schema, 1)
    assert state() == twice


def test_state_of_last_sightings_follows_the_keys_that_come_in(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "seen")
    schema = "seq long, title string, company string, url string, job_board string, seen_at timestamp_ntz"
    day, want, sizes = 86_400, {}, []
    for step in range(6):  # a file every ten days, each with 50 postings of its own and one of all
        rows = [(i, f"T{step}-{i}", "C", "u", "b", f"2024-01-0{step + 1} 00:00:00") for i in range(50)]
        rows.append((99, "always", "C", "u", "b", f"2024-02-0{6 - step} 00:00:00"))
        frame = spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string"))
        frame = frame.withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))
        before = set(landing.rglob("*.parquet")) if landing.exists() else set()
        frame.coalesce(1).write.mode("append").parquet(str(landing))
        for f in set(landing.rglob("*.parquet")) - before:
            os.utime(f, (1_700_000_000 + step * 10 * day,) * 2)
        for r in ingest.with_fingerprint(frame).collect():
            want[r["fingerprint"]] = max(want.get(r["fingerprint"], r["seen_at"]), r["seen_at"])
        records = streams.landed(spark, str(landing), schema, arrived="arrived")
        run = streams.write_last_seen(streams.stream_last_seen(records), out, str(tmp_path / "offsets"))
        run.awaitTermination()
        sizes.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(sizes) <= 3 * 51 < len(want) == 301  # what came in within three periods, not all there ever were
    assert {r["fingerprint"]: r["last_seen_at"] for r in streams.read_last_seen(spark, out).collect()} == want
