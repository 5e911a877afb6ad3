"""Operators on documents: awkward rows, empty tables, and brute-force counterparts."""

import hashlib
import json
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from postloom.llm import bpe, exact_dedup, language, line_dedup, mixing, queries, sharding, simhash, token_counts
from postloom.llm.components import components
from tests.llm.conftest import rows

PATH = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile("[^\x20\x09-\x0d]+")


def library():
    t = token_counts.tokenizer(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_shards(spark, docs):
    folder = sharding.write_shards(docs, shards=5, seed=1, bucket_bytes=2000)
    got = sharding.read_shards(docs, folder).select("row.*", F.col("shard").alias("at"), "slot").collect()
    assert Counter((r.doc_id, r.text, r.lang, r.shard) for r in got) == Counter((r[0], r[1], r[2], r[7]) for r in rows())
    for shard in {r["at"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["at"] == shard)
        assert slots == list(range(len(slots)))
    by_id = {r.doc_id: r["at"] for r in got}
    more = spark.range(2000).select(
        sharding.shard_of(F.col("id"), 5, 1).alias("a"), sharding.shard_of(F.col("id"), 6, 1).alias("b"), "id"
    ).collect()
    assert all(r.a == r.b or r.b == 5 for r in more) and any(r.b == 5 for r in more)
    assert all(by_id[r.id] == r.a for r in more if r.id in by_id)
    assert len({r["at"] for r in got if r.doc_id is None}) == 1


def test_buckets_are_bounded_and_shuffled(spark):
    table = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    folder = sharding.write_shards(table, shards=3, bucket_bytes=4000)
    got = spark.read.parquet(folder)
    assert got.select("shard").distinct().count() == 1  # one id, one shard
    sizes = [r["count"] for r in got.groupBy("bucket").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 2.5 * np.mean(sizes)
    numbers = [int(r.row.text[1:]) for r in got.orderBy("bucket", "pos").limit(300).collect()]
    assert numbers != sorted(numbers)
    again = spark.read.parquet(sharding.write_shards(table, shards=3, bucket_bytes=4000))
    order = ["bucket", "pos", "row.text"]
    assert [tuple(r) for r in again.select(*order).orderBy(*order).collect()] == [tuple(r) for r in got.select(*order).orderBy(*order).collect()]


def test_query_of_shards(spark):
    """All columns of the query, by their definition; the shard by highest draw, so one more takes rows only into itself."""
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op1_sharding"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        data = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key") and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
    assert any(r.grown_shard == 24 for r in got)
    for shard in range(24):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    by_id = {r.doc_id: r.shard for r in got}
    fewer = spark.createDataFrame([(i,) for i in docs], "i long").select("i", sharding.shard_of(F.col("i"), 24, 42).alias("s")).collect()
    assert by_id == {r.i: r.s for r in fewer}


def brute_lines(rows_):
    owner = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    last = 1 << 63
    for i, text, *_ in rows_:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                k = key(line)
                owner[k] = min(owner.get(k, last), last - 1 if i is None else i)
    out = []
    for i, text, *_ in rows_:
        lines = (text or "").split("\n")
        stay = [x for x in lines if owner.get(key(x), last) in (last, last - 1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


@pytest.mark.parametrize("batches, fan", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup(docs, batches, fan):
    got = line_dedup.dedup_lines(docs, batches=batches, fan=fan, buckets=3).collect()
    assert Counter((r.id, r.n_lines, r.n_dropped, r.text) for r in got) == brute_lines(rows())


def test_largest_id_and_rows_that_share_an_id(spark):
    most, line = (1 << 63) - 1, "a line that many share"
    rows_ = [(most, line), (None, line), (None, f"{line}\nown"), (None, "x" * 20), (5, "seen first\nx"), (5, f"SEEN FIRST \n{line}")]
    rows_ += [(None, f"{i} is a line of its own\n{line}\nseen first") for i in range(60)]
    table = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    got = Counter((r.id, r.n_dropped, r.text) for r in line_dedup.dedup_lines(table, buckets=2).collect())
    want = [(most, 1, ""), (None, 1, ""), (None, 1, "own"), (None, 0, "x" * 20), (5, 0, "seen first\nx"), (5, 0, f"SEEN FIRST \n{line}")]
    assert got == Counter(want + [(None, 2, f"{i} is a line of its own") for i in range(60)])
    assert Counter(r.id for r in line_dedup.dedup_lines(table.where("doc_id IS NULL")).collect()) == {None: 63}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, buckets=2, fan=2)
    for b in range(5):
        keys = spark.range(20).select((F.col("id") % (b + 3)).alias("h1"), F.col("id").alias("h2"), F.lit(b).cast("long").alias("id"))
        runs.add(keys)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    stored = [(r.h1, r.h2) for t in runs.tables() for r in t.collect()]
    assert len(stored) == len(set(stored)) == len({(i % (b + 3), i) for b in range(5) for i in range(20)})
    plan = runs.tables()[0].join(runs.tables()[-1], line_dedup.HASH, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    runs.close()


@pytest.mark.parametrize("chunk, overlap", [(32768, 256), (700, 16), (300, 2)])
def test_token_counts(docs, chunk, overlap):
    few = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 10_000) if chunk < 1000 else docs
    encode = library()
    want = Counter((r[0], len((r[1] or "").encode()), len(encode(r[1]))) for r in rows() if chunk > 1000 or len(r[1] or "") < 10_000)
    got = token_counts.token_counts(few, PATH, chunk_chars=chunk, overlap_chars=overlap).collect()
    assert Counter((r.id, r.n_bytes, r.n_tokens) for r in got) == want


def test_seam_needs_agreement():
    side = lambda at, before, sums: {"at": at, "before": before, "sums": sums}
    assert token_counts.seam(side([5, 9], [2, 4], [1, 7]), side([5, 9], [0, 2], [3, 7]), 99) == (9, 4, 2)
    assert token_counts.seam(side([5, 9], [2, 4], [1, 7]), side([5, 9], [0, 2], [3, 8]), 99) is None
    assert token_counts.seam(side([5], [2], [1]), side([6], [2], [1]), 99) is None
    assert token_counts.seam(side([9], [4], [1]), side([9], [2], [5]), 9) == (9, 4, 2)


def test_bpe(docs):
    encode, t = library(), token_counts.tokenizer(PATH)
    got = bpe.encode_decode(docs, PATH).collect()
    want = Counter((r[0], " ".join(map(str, encode(r[1]))), t.decode(encode(r[1]), skip_special_tokens=False)) for r in rows())
    assert Counter((r.id, r.ids, r.decoded) for r in got) == want


SF = "/root/testdata/sf0.001"


def whole_table(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def hexdigest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_of_token_counts(spark):
    encode, n = library(), {}
    for i, text in whole_table(spark).items():
        n[i] = (len(text.encode()), len(encode(text)))
    got = queries.QUERIES["op3_token_counts"](spark, SF).collect()
    assert len(got) == len(n)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (b, t, t > 2048) for i, (b, t) in n.items()}


def test_query_of_bpe(spark):
    encode, t = library(), token_counts.tokenizer(PATH)
    want = {}
    for i, text in whole_table(spark).items():
        ids = encode(text)
        want[i] = (len(ids), hexdigest(" ".join(map(str, ids))), hexdigest(t.decode(ids, skip_special_tokens=False)))
    got = queries.QUERIES["op4_bpe"](spark, SF).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_query_of_simhash(spark):
    """Fingerprints one by one, components by comparing each fingerprint with all others."""
    prints = {i: brute_fingerprint(text) for i, text in whole_table(spark).items()}
    ids = sorted(prints)
    fps = np.array([prints[i] for i in ids], np.uint64)
    component = np.arange(len(ids))
    while True:  # the smallest reachable position, handed on until nothing changes
        least = np.array([component[np.bitwise_count(fps ^ x) <= 3].min() for x in fps])
        if (least == component).all():
            break
        component = least
    got = queries.QUERIES["op10_simhash"](spark, SF).collect()
    assert len(got) == len(ids)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{prints[i]:016x}", ids[component[at]]) for at, i in enumerate(ids)}


def test_trie_on_random_texts():
    encode, e, rng = library(), bpe.Encoder(PATH), np.random.default_rng(5)
    letters = list("abcdeinorstABÀÉéßſİΣ中あ½²'’.,!?<|># \n\t\x1c\x85\xa0 ́​👍ﬁ\u0000")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    texts += [w + s for w in texts[:50] for s in ("<|endoftext|>", " <|STARTOFTEXT|>x", "'ll")]
    for text, (n, ids, _) in zip(texts, e.encode_texts(texts)):
        assert ids == " ".join(map(str, encode(text))) and n == len(encode(text)), repr(text)


@pytest.mark.parametrize("name, said", [("byte_bpe_50k.json", "splitting rule"), (None, "normaliser"), ("decoder", "decoder")])
def test_files_with_other_rules_are_refused(nothing, tmp_path, name, said):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    path = str(tmp_path / "other.json")
    if name == "decoder":
        spec["decoder"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    elif name is None:
        spec["normalizer"]["normalizers"].pop()
    else:
        path = public_tokenizers.path(name)
    if name in ("decoder", None):
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec, f)
    with pytest.raises(ValueError, match=said):
        bpe.encode_decode(nothing, path)
    if name == "decoder":
        assert token_counts.token_counts(nothing, path).count() == 0
    else:
        with pytest.raises(ValueError, match=said):
            token_counts.token_counts(nothing, path)


def test_every_token_is_its_own_encoding():
    table = bpe.MergeTable(PATH)
    words = sorted(t[:-4] for t in table.vocab if t.endswith(bpe.END))
    assert all(ids == [table.vocab[w + bpe.END]] for w, ids in zip(words, bpe.traverse(words, table)))


def test_mixing(docs):
    got = mixing.mix(docs, seed=3).collect()
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert Counter((r.id, r.size) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows())
    weights = dict(zip(sorted((s for s in sizes if s is not None)) + [None], [5, 2, 1, 5]))
    left, budget, target = dict(weights), 1.5 * sum(sizes.values()), {}
    while left:  # share by weight, cut off, share again
        level = (budget - sum(target.values())) / sum(left.values())
        full = [s for s in left if 2 * sizes[s] < level * left[s]]
        if not full:
            target |= {s: level * w for s, w in left.items()}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left = {s: w for s, w in left.items() if s not in full}
    by_size = {v: target[s] for s, v in sizes.items()}
    assert all(abs(r.target - by_size[r.source_size]) < 1e-6 * (1 + r.target) for r in got)
    assert all(0 <= r.copies <= 2 for r in got)
    again = mixing.mix(docs.repartition(2), seed=3).collect()
    assert Counter((r.id, r.hash, r.copies) for r in got) == Counter((r.id, r.hash, r.copies) for r in again)


def test_mix_comes_near_its_targets(spark):
    table = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"),
    )
    taken = mixing.mix(table).groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("t")).collect()
    assert all(abs(r.t - r.target) <= 25 for r in taken)
    assert mixing.mixed(table).count() == mixing.mix(table).agg(F.sum("copies")).first()[0]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(docs, keep):
    groups = defaultdict(list)
    for r in rows():
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    got = exact_dedup.exact_duplicates(docs, keep=keep, fan=2).collect()
    assert len(got) == len(rows())
    by_digest = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    pick = min if keep == "smallest" else max
    for r in got:
        ids = by_digest[bytes(r.digest)]
        assert r.group_size == len(ids)
        assert r.keep_id == pick([i for i in ids if i is not None], default=None)
    kept = Counter(bytes(r.digest) for r in got if r.kept)
    assert set(kept) == set(by_digest) and set(kept.values()) == {1}
    stay = exact_dedup.drop_copies(docs, keep=keep)
    assert stay.columns == docs.columns and stay.count() == len(by_digest)


def test_runs_merge_without_exchange(spark):
    docs = spark.range(400).repartition(7).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 90).alias("text"))
    runs = docs.select(F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("size"), F.xxhash64("text").alias("proof"),
                       F.spark_partition_id().alias("run"), F.struct("doc_id").alias("best"), F.lit(1).cast("long").alias("n"))
    name = exact_dedup._laid(runs.repartition(4, *exact_dedup.KEY), 4)
    merged = exact_dedup._merged(spark.table(name), 2, "smallest")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert {r.run for r in merged.collect()} == {0, 1, 2, 3} and merged.agg(F.sum("n")).first()[0] == 400
    spark.sql(f"DROP TABLE {name}")
    before = spark.sql("SHOW TABLES").count()
    got = exact_dedup.exact_duplicates(docs, fan=2)
    assert spark.sql("SHOW TABLES").count() == before  # no table stays behind, and the result does not need one
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == [
        (i, i % 90, 5 if i % 90 < 40 else 4, i < 90) for i in range(400)]


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_rows(docs):
    got = simhash.near_duplicates(docs).collect()
    prints = {(r[0], r[1]): brute_fingerprint(r[1]) for r in rows()}
    assert Counter((r.id, r.fp % (1 << 64)) for r in got) == Counter((r[0], prints[r[0], r[1]]) for r in rows())
    assert {r.component_id for r in got if 100 <= (r.id or 0)} == {100}
    assert {r.component_id for r in got if r.fp == 0} == {0}
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len({r.component_id for r in got})


def test_simhash_keeps_one_row_of_every_group(spark):
    """As many rows as groups by brute force, though ids are missing or repeated."""
    import corpus_pipeline

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(24)]
    ids = [None] * 10 + [7, 7] + [None, 20, 30, None, 40, 40] + [None] * 4 + [50, 51]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts)]
    # Near copies (a longer text with one word changed) with and without ids, and repeated rows.
    long = [[f"u{x}" for x in rng.integers(0, 10**6, 3000)] for _ in range(3)]
    for k, own in enumerate([(None, None, None), (None, 60, 61), (7, 7, 62)]):
        for v, i in enumerate(own):
            rows.append((i, " ".join(long[k][:-1] + [f"other{v}"]), "en", "s", v))
    rows += [rows[0], rows[0], rows[10]]
    fps = [simhash.fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root = [root[j] if x == root[i] else x for x in root]
    groups = [[r for r, g in zip(rows, root) if g == x] for x in set(root)]
    assert len(groups) < len(set(rows)) and sum(len({r[0] for r in g}) > 1 for g in groups) >= 2
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema), "").collect()]
    assert len(got) == len(groups)
    for g in groups:
        ids = [r[0] for r in g if r[0] is not None]
        mine = [r for r in got if r in g]
        assert len(mine) == 1 and mine[0][0] == min(ids, default=None)


def test_simhash_links_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 1500, dtype=np.uint64, endpoint=False)
    fps = list(base)
    for x in base[:300]:  # chains and clouds of near copies, some just beyond reach
        for _ in range(rng.integers(1, 9)):
            fps.append(np.uint64(int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))))
    fps = np.unique(np.array(fps, np.uint64))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.near_links(table, shard_size=32, sample_size=512)
    found = {r.node: r.root for r in components(links).collect()}
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, x in enumerate(fps.view(np.int64)):
        groups[find(i)].append(int(x))
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert found == want


def test_large_shards_are_split_without_loss():
    rng = np.random.default_rng(9)
    fps = np.unique(rng.integers(0, 1 << 64, 400, dtype=np.uint64, endpoint=False))
    near = np.unique(np.concatenate([fps, fps ^ np.uint64(1 << 40), fps ^ np.uint64(1)]))
    tree = simhash.plant(fps[:50], (1 << 32) - 1, 1, 2, 7)
    row, shard = tree.shards(near, {3: 2, 5: 3}, 7)
    of = defaultdict(set)
    for r, s in zip(row.tolist(), shard.tolist()):
        of[int(near[r])].add(s)
    assert len(set(shard.tolist())) > 8
    assert all(of[int(x)] & of[int(x ^ np.uint64(1))] for x in fps)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(3000)] + [(-5, 9000), (9000, 9000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(3001)} == {1000}
    assert got[9000] == got[-5] == -5


def test_language(spark, docs, nothing):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_outside_fold(table)
    got = language.predict(table, model).join(table.select(F.col("doc_id").alias("id"), F.col("lang").alias("want")), "id")
    held = got.where(language.is_held_out(F.col("id")))
    assert held.where("lang = want").count() > 0.95 * held.count()
    assert held.where("rejected").count() < 0.01 * held.count()
    assert all(zlib.crc32(str(r.id).encode()) % 5 == 0 for r in held.select("id").collect())
    again = language.fit_outside_fold(table.repartition(3))
    assert np.allclose(model.centroids, again.centroids, atol=1e-5) and model.languages == again.languages
    odd = {r.id: r for r in language.predict(docs, model).where("id < 14").collect()}
    assert all(odd[i].lang == "und" and odd[i].rejected and odd[i].score == 0 for i in (0, 1, 2, 10))
    assert odd[12].rejected and 0 <= odd[5].score <= 1
    assert language.keep_known(docs, model).columns == docs.columns
    empty = language.fit(nothing)
    assert {r.lang for r in language.predict(docs, empty).collect()} == {"und"}


def test_empty_tables(spark, nothing):
    model = language.fit(nothing)
    assert sharding.read_shards(nothing, sharding.write_shards(nothing, shards=2)).count() == 0
    for frame in (
        line_dedup.dedup_lines(nothing), token_counts.token_counts(nothing, PATH), bpe.encode_decode(nothing, PATH),
        mixing.mix(nothing), mixing.mixed(nothing), exact_dedup.exact_duplicates(nothing), exact_dedup.drop_copies(nothing),
        simhash.near_duplicates(nothing), simhash.one_of_each(nothing), language.predict(nothing, model),
    ):
        assert frame.count() == 0


def plain_counts(text):
    data = f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} ".encode()
    n = [0] * language.CELLS
    for i in range(len(data) - 1):
        n[((data[i] << 8 | data[i + 1]) * 0x9E3779B1 % 2**32) >> 19] += 1
    for i in range(len(data) - 2):
        n[((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 0x85EBCA77 % 2**32) >> 19] += 1
    return n


def test_language_query_against_a_plain_rewrite(spark):
    """Frequencies over all labelled texts, cosine with every centroid, rejection by distance and length."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows_ = docs.select("doc_id", "text", "lang").collect()
    model = language.fit_outside_fold(docs)
    held = {r.doc_id for r in rows_ if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    taught = [plain_counts(r.text) for r in rows_ if r.lang and r.doc_id not in held and r.text and any(map(str.isalpha, r.text))]
    df = [sum(c > 0 for c in column) for column in zip(*taught)]
    assert np.allclose(model.idf, [np.log((1 + len(taught)) / (1 + d)) + 1 for d in df], atol=1e-5)
    assert set(model.languages) == {r.lang for r in rows_ if r.lang}
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4) and len(set(model.languages)) < len(model.languages)
    got = {r.doc_id: r for r in queries.QUERIES["op9_language_id"](spark, folder).collect()}
    assert len(got) == len(rows_)
    for r in rows_:
        g = got[r.doc_id]
        assert g.held_out == (r.doc_id in held)
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (g.lang_pred, g.score) == ("und", 0)
            continue
        v = [np.log1p(c) * w for c, w in zip(plain_counts(r.text), model.idf)]
        cosines = [float(np.dot(c, v) / np.linalg.norm(v)) for c in model.centroids]
        best = max(cosines)
        assert abs(g.score - best) < 1e-4
        assert best - max(c for c, name in zip(cosines, model.languages) if name == g.lang_pred) < 1e-4
        limit = model.radius[model.languages.index(g.lang_pred), sum(len(r.text) >= n for n in (16, 64, 256))]
        assert g.rejected == (1 - best > limit) or abs(1 - best - limit) < 1e-4


def test_junk_is_rejected_and_clean_texts_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_outside_fold(docs)
    rng = np.random.default_rng(1)
    letters = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), n)) for n in (100, 300, 1000, 5000) for _ in range(10)]
    base64 = ["".join(rng.choice(list(string.ascii_letters + string.digits + "+/"), n)) for n in (100, 300, 1000, 5000) for _ in range(10)]
    assert all(model.predict(letters + base64)[2])
    assert all(model.predict(["Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita"])[2])
    clean = [r.text for r in docs.where(language.is_held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect() if any(map(str.isalpha, r.text or ""))]
    assert sum(model.predict(clean)[2]) <= 0.01 * len(clean)


def test_many_languages_are_bounded(spark):
    table = spark.createDataFrame([(i, f"wort nummer {i} hier", f"l{i % 40:02d}" if i < 400 else "de") for i in range(500)], "doc_id long, text string, lang string")
    model = language.fit(table, max_languages=5)
    assert len(set(model.languages)) == 5 and "de" in model.languages


def cloud(n, seed):
    """Distinct fingerprints that share one half and differ in few bits of the other, and some of their own."""
    rng = np.random.default_rng(seed)
    center = rng.integers(0, 1 << 63, dtype=np.uint64)
    flips = np.zeros(n, np.uint64)
    for _ in range(5):
        flips ^= np.uint64(1) << rng.integers(0, 32, n).astype(np.uint64)
    return np.unique(np.concatenate([center ^ flips, rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)]))


def groups_of(fps, links):
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in links:
        a, b = find(int(u)), find(int(v))
        root[max(a, b)] = min(a, b)
    return {f: find(f) for f in root}


def test_dense_clouds_are_cut_into_blocks(spark):
    fps = cloud(6000, 3)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    want = groups_of(fps, zip(*(fps[x] for x in np.nonzero(np.triu(near, 1)))))
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").repartition(4)
    links = simhash.near_links(table, 3, shard_size=64, sample_size=256)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "with#" in plan or "Generate explode" in plan  # blocks meet
    got = groups_of(fps, [(np.int64(r.u).view(np.uint64), np.int64(r.v).view(np.uint64)) for r in links.collect()])
    assert got == want and 100 < len(set(want.values())) < len(fps) / 2


def test_stars_within_and_between():
    fps = cloud(800, 5)
    one, two = fps[::2], fps[1::2]
    inside = groups_of(fps, zip(*simhash.close_pairs_as_stars(fps, 3)))
    links = [p for a in ((one, None), (two, None), (one, two)) for p in zip(*simhash.close_pairs_as_stars(a[0], 3, other=a[1]))]
    assert groups_of(fps, links) == inside
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    assert inside == groups_of(fps, zip(*(fps[x] for x in np.nonzero(np.triu(near, 1)))))
