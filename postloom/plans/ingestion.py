"""Queries over loading records into the postings table."""

from pyspark.sql import functions as F

from postloom.operators import ingest
from postloom.plans.registry import query
from postloom.plans.views import sql_fingerprint
from postloom.session import new_folder, written
from postloom.sources.paging import first_by_key
from postloom.sources.store import append_load, create_store, fold, read_store
from postloom.streaming import ingest as streams

c = F.col
AS_OF = "2002-01-01 00:00:00"
SQL_ROUNDS = 10
_SEQ = ", ".join(f"seq.{n}" for n in ("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"))


def sql_rounds(rows: str, rounds: int = SQL_ROUNDS) -> str:
    """CTEs u0, k0, u1, ... deciding rows (url, fp, seq) in arrival order; ``kept`` has the seq of kept rows.

    The undecided rows left after the last round are in ``u{rounds}``; the
    tests check that there are none.
    """
    parts = [f"u0 AS MATERIALIZED (SELECT url AS u, fp AS f, min(seq) AS s FROM {rows} GROUP BY 1, 2)"]
    for i in range(rounds):
        parts.append(f"""k{i} AS MATERIALIZED (SELECT * FROM u{i} QUALIFY row_number() OVER (PARTITION BY u ORDER BY s) = 1
          AND row_number() OVER (PARTITION BY f ORDER BY s) = 1)""")
        parts.append(f"""u{i + 1} AS MATERIALIZED (SELECT * FROM u{i} WHERE u NOT IN (SELECT u FROM k{i}) AND f NOT IN (SELECT f FROM k{i}))""")
    union = " UNION ALL ".join(f"SELECT u, s FROM k{i}" for i in range(rounds))
    return ",\n".join([*parts, f"kept AS MATERIALIZED ({union})"])


SQL_USABLE = f"""usable AS MATERIALIZED (SELECT *, {sql_fingerprint('title', 'company', 'job_board')} AS fp FROM v_posts
  WHERE title IS NOT NULL AND company IS NOT NULL AND url IS NOT NULL AND job_board IS NOT NULL)"""
SQL_OUTCOMES = f"""{SQL_USABLE},
  found AS MATERIALIZED (SELECT p.*, a.id AS url_id, b.id AS fp_id FROM usable p
    LEFT JOIN (SELECT url, min(id) AS id FROM v_known GROUP BY 1) a ON a.url = p.url
    LEFT JOIN (SELECT fingerprint, min(id) AS id FROM v_known WHERE fingerprint IS NOT NULL GROUP BY 1) b ON b.fingerprint = p.fp),
  unknown AS (SELECT url, fp, seq FROM found WHERE url_id IS NULL AND fp_id IS NULL),
  {sql_rounds('unknown')},
  outcomes AS MATERIALIZED (SELECT f.*, coalesce(url_id, CASE WHEN url_id IS NULL AND k.s < f.seq THEN NULL ELSE fp_id END) AS job_id,
      CASE WHEN url_id IS NOT NULL OR (fp_id IS NOT NULL AND NOT coalesce(k.s < f.seq, false)) THEN 'touch'
           WHEN k.s = f.seq THEN 'new' ELSE 'repeat' END AS outcome
    FROM found f LEFT JOIN kept k ON k.u = f.url)"""


def _usable(v):
    return ingest.with_fingerprint(ingest.split_rejects(v.v_posts)[0])


def _outcomes(v, carry=()):
    """Outcome per usable record with its keys and the columns asked for; read once."""
    return ingest.classify(_usable(v), v.known, list(carry))


SEQ = ["seq.l_shipdate", "seq.l_orderkey", "seq.l_partkey", "seq.l_suppkey", "seq.l_linenumber", "seq.l_extendedprice"]


@query("ingest_dedup", f"""
  WITH {SQL_USABLE}, {sql_rounds('usable')}
  SELECT {_SEQ}, url, fp AS fingerprint FROM usable WHERE seq IN (SELECT s FROM kept)""")
def _(v):
    return ingest.ordered_dedup(_usable(v).select("seq", "url", "fingerprint")).select(*SEQ, "url", "fingerprint")


@query("ingest_dedup_parts", f"""
  WITH p AS (SELECT cast(seq.l_orderkey as varchar) AS url, cast(seq.l_partkey as varchar) AS fp, seq FROM v_posts), {sql_rounds('p')}
  SELECT url, fp AS fingerprint FROM p WHERE seq IN (SELECT s FROM kept)""")
def _(v):
    rows = v.v_posts.select(
        c("seq.l_orderkey").cast("string").alias("url"), c("seq.l_partkey").cast("string").alias("fingerprint"), "seq")
    return ingest.ordered_dedup(rows).select("url", "fingerprint")


@query("ingest_dedup_documents", """
  SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1""")
def _(v):
    rows = v.table("documents").select("doc_id", F.md5("text").alias("url"), F.sha2("text", 256).alias("fingerprint"))
    return ingest.ordered_dedup(rows, seq="doc_id").select("doc_id")


@query("j_exists_url", "SELECT p.url, k.id AS url_id FROM v_posts p JOIN v_known k ON k.url = p.url")
def _(v):
    posts = written(v.v_posts.select("url"), "posts")
    return ingest.j_exists_url(posts, v.v_known).where("url_id IS NOT NULL").select("url", "url_id")


@query("j_exists_fp", f"""
  WITH {SQL_USABLE} SELECT u.url, u.fp AS fingerprint, k.id AS fp_id FROM usable u
  JOIN (SELECT fingerprint, min(id) AS id FROM v_known WHERE fingerprint IS NOT NULL GROUP BY 1) k ON k.fingerprint = u.fp""")
def _(v):
    posts = written(_usable(v).select("url", "fingerprint"), "posts")
    return ingest.j_exists_fp(posts, v.v_known).where("fp_id IS NOT NULL").select("url", "fingerprint", "fp_id")


@query("win_first_by_key", """
  SELECT id, url, fingerprint FROM v_known WHERE fingerprint IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id) = 1""")
def _(v):
    known = v.v_known.where("fingerprint IS NOT NULL").select("id", "url", "fingerprint")
    return first_by_key(known, ["fingerprint"], ["id"])


@query("ingest_outcomes", f"WITH {SQL_OUTCOMES} SELECT {_SEQ}, url, outcome, job_id FROM outcomes")
def _(v):
    return _outcomes(v).select(*SEQ, "url", "outcome", "job_id")


STORED = [
    "id", "title", "company", "description", "salary_text", "salary_annual_min", "salary_annual_max", "location", "url", "job_board",
    "scraped_at", "updated_at", "fingerprint", "last_seen_at", "is_active",
]
_STORED = ", ".join(STORED)
_NEW = f"""SELECT (SELECT max(id) FROM v_known) + row_number() OVER (ORDER BY seq) AS id, title, company, description, salary_text,
    NULL::bigint AS salary_annual_min, NULL::bigint AS salary_annual_max, location, url, job_board, TIMESTAMP '{AS_OF}' AS scraped_at,
    TIMESTAMP '{AS_OF}' AS updated_at, fp AS fingerprint, TIMESTAMP '{AS_OF}' AS last_seen_at, true AS is_active FROM outcomes WHERE outcome = 'new'"""
_TOUCHED = f"""SELECT * EXCLUDE (job_id, last_seen_at, updated_at, is_active),
    CASE WHEN job_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE last_seen_at END AS last_seen_at,
    CASE WHEN job_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at, job_id IS NOT NULL OR is_active AS is_active
  FROM v_known LEFT JOIN (SELECT DISTINCT job_id FROM outcomes WHERE outcome = 'touch') ON job_id = id"""


@query("ingest_touch", f"WITH {SQL_OUTCOMES} {_TOUCHED}")
def _(v):
    """Sightings of a load folded into the buckets they touch; the load adds no postings here."""
    folder = _stored(v)
    seen = _outcomes(v).where("outcome = 'touch'").select(c("job_id").alias("id")).distinct()
    at = F.lit(AS_OF).cast("timestamp_ntz").alias("last_seen_at")
    append_load(folder, 0, v.v_known.limit(0), seen.select("id", at))
    fold(v.spark, folder, v.v_known.schema, 0)
    return read_store(v.spark, folder, v.v_known.schema)


@query("ingest_touch_rows", f"WITH {SQL_OUTCOMES} {_TOUCHED}")
def _(v):
    return ingest.ingest_touch(v.known, _outcomes(v), AS_OF)


@query("ingest_new_row", f"WITH {SQL_OUTCOMES} {_NEW}")
def _(v):
    records, outcomes = ingest.classify_rows(_usable(v), v.known)
    return ingest.ingest_new_row(v.known, outcomes, AS_OF, records=records).select(*STORED)


SQL_AFTER = f"SELECT {_STORED} FROM ({_TOUCHED}) UNION ALL {_NEW}"


@query("ingest", f"WITH {SQL_OUTCOMES} {SQL_AFTER}")
def _(v):
    """A load into the stored table."""
    folder = _stored(v)
    ingest.load_into(v.spark, folder, v.v_known.schema, v.v_posts, AS_OF, 0)
    return read_store(v.spark, folder, v.v_known.schema)


@query("ingest_frames", f"WITH {SQL_OUTCOMES} {SQL_AFTER}")
def _(v):
    return ingest.ingest(v.known, v.v_posts, AS_OF)[0].select(*STORED)


@query("ingest_errors", """
  SELECT seq.l_orderkey, seq.l_linenumber, seq.l_extendedprice, url, title IS NULL AS no_title, company IS NULL AS no_company FROM v_posts
  WHERE title IS NULL OR company IS NULL OR url IS NULL OR job_board IS NULL""")
def _(v):
    return ingest.split_rejects(v.v_posts)[1].select(
        "seq.l_orderkey", "seq.l_linenumber", "seq.l_extendedprice", "url",
        c("title").isNull().alias("no_title"), c("company").isNull().alias("no_company"))


_COUNTS = f"""WITH {SQL_OUTCOMES},
  all_rows AS (SELECT job_board, outcome FROM outcomes UNION ALL SELECT job_board, 'error' FROM v_posts WHERE title IS NULL OR company IS NULL OR url IS NULL)
  SELECT job_board AS name, count(*) AS jobs_scraped, count(*) FILTER (outcome = 'new') AS jobs_added,
    count(*) FILTER (outcome IN ('touch', 'repeat')) AS duplicates, count(*) FILTER (outcome = 'error') AS errors FROM all_rows GROUP BY 1"""


def _counts(v):
    # written once for both: the joins below a record cost more than a narrow copy of it
    posts = written(ingest.with_fingerprint(v.v_posts).select(
        "url", "fingerprint", "seq", "job_board", ingest.lacking().alias("lacking")), "posts")
    outcomes = ingest.classify(posts.where("NOT lacking"), v.known, ["job_board"], at_rest=True)
    return ingest.run_counts(outcomes, posts.where("lacking"))


query("agg_run_stats", _COUNTS)(_counts)


@query("ingest_commit_failed", f"SELECT name, jobs_scraped, 0::bigint AS jobs_added, duplicates, errors + jobs_added AS errors FROM ({_COUNTS})")
def _(v):
    return ingest.commit_failed(_counts(v))


def _stored(v):
    """A store holding the known postings."""
    folder = new_folder(v.spark, "store")
    create_store(v.v_known, folder)
    return folder


@query("stream_ingest", f"WITH {SQL_OUTCOMES} {SQL_AFTER}")
def _(v):
    """One run of the stream per arrival, as the files come in; the second fold takes all batches before it."""
    store, offsets = _stored(v), new_folder(v.spark, "offsets")
    landing = new_folder(v.spark, "landed")
    for low, high in (("0001", "1995"), ("1995", "1998"), ("1998", "9999")):
        part = v.v_posts.where((F.year("seq.l_shipdate") >= int(low)) & (F.year("seq.l_shipdate") < int(high)))
        part.write.mode("append").parquet(landing)
        records = streams.landed(v.spark, landing, v.v_posts.schema, files_per_batch=None)
        streams.stream_ingest(records, store, v.v_known.schema, offsets, AS_OF, fold_every=2).awaitTermination()
    return read_store(v.spark, store, v.v_known.schema).select(*STORED)


@query("stream_last_seen", f"""
  WITH {SQL_USABLE} SELECT fp AS fingerprint, max(seq.l_shipdate) AS last_seen_at FROM usable GROUP BY 1""")
def _(v):
    folder, out = new_folder(v.spark, "landed"), new_folder(v.spark, "last-seen")
    v.v_posts.write.parquet(folder)
    records = streams.landed(v.spark, folder, v.v_posts.schema, 4, arrived="arrived")
    usable = ingest.split_rejects(records)[0].withColumn("seen_at", c("seq.l_shipdate"))
    streams.write_last_seen(streams.stream_last_seen(usable), out, new_folder(v.spark, "offsets")).awaitTermination()
    return streams.read_last_seen(v.spark, out)
