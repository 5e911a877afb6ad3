"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_sharding")
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from postloom.llm import sharding

    docs = table(spark, folder, "documents")
    rows = sharding.read_shards(docs, sharding.write_shards(docs, shards=24, seed=42))
    text = F.col("row.text")
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), sharding.record_bytes(text).alias("size"),
        F.crc32(or_empty(text).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot",
        sharding.shard_of(F.col("row.doc_id"), 25, 42).alias("grown_shard"),
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op2_line_dedup", f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {SPACE_CHARS}), '{UPPER}', '{LOWER}') AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT k.doc_id, line, pos, coalesce(owner < k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN owners o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from postloom.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


@query("op5_mixing", r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         cast('0x' || substr(md5('42:' || coalesce('v' || doc_id, 'n') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS hash
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS full_at FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM capped),
targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * max(level) FILTER (full_at > level) OVER ()), cap) AS target
  FROM levels),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest
  FROM targets),
groups AS (SELECT source, hash, sum(size)::DOUBLE AS sum FROM sized GROUP BY source, hash),
cums AS (
  SELECT *, coalesce(sum(sum) OVER (PARTITION BY source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM groups),
edges AS (
  SELECT r.source, max({'hash': hash, 'before': before, 'sum': sum, 'rest': rest}) AS e
  FROM cums c JOIN rests r ON c.source IS NOT DISTINCT FROM r.source WHERE before <= rest GROUP BY r.source),
cuts AS (SELECT source, e.hash + CASE WHEN e.rest - e.before > e.sum / 2 THEN 1 ELSE 0 END AS threshold FROM edges)
SELECT doc_id, size, source_size, target,
       (size * least(2, whole + CASE WHEN hash < threshold THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source""")
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from postloom.llm.mixing import mix

    return mix(table(spark, folder, "documents"), weights=(5, 2, 1), budget=1.5, max_passes=2.0, seed=42).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query("op7_exact_dedup", f"""
WITH keyed AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM keyed WINDOW g AS (PARTITION BY text_sha256)""")
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from postloom.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, folder, "documents"), keep="largest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from postloom.llm.token_counts import token_counts

    return token_counts(table(spark, folder, "documents"), word_bpe()).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit")
    )


@query("op4_bpe")
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from postloom.llm.bpe import encode_decode

    return encode_decode(table(spark, folder, "documents"), word_bpe(), digests=True).withColumnRenamed("id", "doc_id")


@query("op9_language_id")
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from postloom.llm import language

    docs = table(spark, folder, "documents")
    return language.predict(docs, language.fit_outside_fold(docs)).select(
        F.col("id").alias("doc_id"), language.is_held_out(F.col("id")).alias("held_out"), F.col("lang").alias("lang_pred"),
        "score", "rejected",
    )


@query("op10_simhash")
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from postloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), words=3, max_bits=3).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op6_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""")
def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    from postloom.llm.topk import top_k

    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64).withColumnRenamed("id", "vec_id")


@query("op8_warc", """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
best AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM best""")
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    from postloom.llm import warc

    found = warc.read_payloads(spark, warc.write_archives(table(spark, folder, "pages"), min_bytes=1000))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:v(-?\d+):\d+>$", 1).try_cast("long")
    return found.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


def crc32_sql(ascii_text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, as SQL."""
    return (
        f"xor(list_reduce(list_transform(string_split({ascii_text}, ''), lambda ch: ascii(ch)::BIGINT),"
        " lambda acc, b: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(acc, b)),"
        " 4294967295::BIGINT), 4294967295)"
    )


OPENERS, MOST_OPENING = 100, 5  # the contract's conv_id - conv_id % 100 and crc32 % 6


@query("op11_prefix_trie", f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM t GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND pos < h
  UNION ALL
  SELECT c.conv_id, pos - c.h + least(c.h, coalesce(b.n, 0)), role, text
  FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= c.h LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
path AS (
  SELECT conv_id, 0 AS depth, '' AS key, 0 AS size FROM c
  UNION ALL
  SELECT conv_id, pos + 1, string_agg(sha256(length(role) || ':' || role || text), ',') OVER
           (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING), length(text) FROM rebuilt),
linked AS (
  SELECT *, lag(key) OVER w AS parent, lead(depth) OVER w IS NULL AS ends, min(conv_id) OVER (PARTITION BY depth, key) AS owner
  FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
kids AS (SELECT depth - 1 AS depth, parent AS key, count(DISTINCT key) AS kids FROM linked WHERE depth > 0 GROUP BY ALL),
booked AS (
  SELECT l.*, sum(CASE WHEN owner < conv_id THEN size ELSE 0 END) OVER w AS saved,
         sum(CASE WHEN owner = conv_id AND kids IS NULL THEN 1 ELSE 0 END) OVER w AS leaves, coalesce(kids, 0) AS kids
  FROM linked l LEFT JOIN kids k ON k.depth = l.depth AND k.key = l.key
  WINDOW w AS (PARTITION BY conv_id ORDER BY l.depth DESC)),
nodes AS (
  SELECT depth, key, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(kids) AS n_children,
         sum(leaves)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM booked GROUP BY depth, key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n.n_leaves, n.saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.parent""")
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from postloom.llm import prefix_trie

    conv = F.col("conv_id")
    convs, turns = prefix_trie.share_openings(
        prefix_trie.ordered_turns(table(spark, folder, "conversations")), openers=conv - conv % OPENERS,
        opening=F.crc32(conv.cast("string").cast("binary")) % (MOST_OPENING + 1), most=MOST_OPENING,
    )
    return prefix_trie.prefix_trie(convs, turns)


ASSIGN_RE = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
SECRET_SQL = [  # kind, expression, group, condition on the group v
    ("assign", ASSIGN_RE, 2, "length(v) >= 8"), ("access", "AKIA[A-Z0-9]+", 0, "length(v) >= 16"),
    ("hex", "[0-9a-f]+", 0, "length(v) >= 32"), ("forge", "gh[pousr]_([A-Za-z0-9]+)", 1, "checked"),
    ("package", "npm_([A-Za-z0-9]+)", 1, "checked"),
]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS62 = " || ".join(f"substr('{BASE62}', (crc // {62 ** k}) % 62 + 1, 1)" for k in range(5, -1, -1))
FOUND = " UNION ALL ".join(
    f"SELECT id, {i} AS ord, '{kind}' AS kind, '{ok}' = 'checked' AS signed, regexp_extract_all(text, '{rx}') AS m,"
    f" regexp_extract_all(text, '{rx}', {group}) AS g, string_split_regex(text, '{rx}') AS p FROM d"
    for i, (kind, rx, group, ok) in enumerate(SECRET_SQL)
)
LONG_ENOUGH = " WHEN ".join(f"'{kind}' THEN {ok}" for kind, _, _, ok in SECRET_SQL if ok != "checked")


@query("op12_secrets", f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({FOUND}),
one AS (
  SELECT id, ord, kind, signed, m[i] AS m, g[i] AS v,
         list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
summed AS (
  SELECT *, CASE WHEN signed AND length(v) = 36 THEN {crc32_sql("left(v, 30)")} END AS crc FROM one),
spans AS (
  SELECT id, ord, kind, start, kind || ':' || start::BIGINT || ':' || (start + length(m))::BIGINT AS span FROM summed
  WHERE CASE WHEN signed THEN coalesce({DIGITS62} = right(v, 6), false) ELSE CASE kind WHEN {LONG_ENOUGH} END END),
per AS (
  SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, ord) FILTER (ord < 3) AS base,
         string_agg(span, ',' ORDER BY start, ord) AS spans
  FROM spans GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per ON d.id = per.id""")
def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from postloom.llm import secrets

    spans = F.col("spans")
    return secrets.find_secrets(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), *[secrets.count(spans, k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(secrets.joined(spans, secrets.BASE_KINDS), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"),
    )


def with_periods(words, doc_id):
    """The contract's words: of a tenth of the documents, all from some word on repeat with some period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    changed = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(words)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    from postloom.llm import periodic_runs

    docs = table(spark, folder, "documents").withColumn("words", periodic_runs.words_of(F.col("text")))
    found = periodic_runs.periodic_runs(docs, with_periods(F.col("words"), F.col("doc_id")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    # greatest length first, then smallest start and period
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q")))
    best = F.array_min(order)
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best["s"].alias("start"),
        (-best["l"]).alias("length"), best["q"].alias("period"),
        F.floor(-1000 * best["l"] / best["q"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
