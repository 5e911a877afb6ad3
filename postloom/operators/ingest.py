"""Loading new records into the postings table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions.text import fingerprint
from postloom.operators.components import components
from postloom.operators.keys import maybe_among
from postloom.operators.lifecycle import touched
from postloom.session import written
from postloom.sources.store import append_load, fold, stored_keys

ROUNDS = 2  # of ordered de-duplication, before what is left is cut into components
COMPONENT_ROWS = 100_000  # keys of that many rows are held by a task at a time
ROWS_PER_TASK = 500_000  # rows numbered by one task


def with_fingerprint(records: DataFrame) -> DataFrame:
    return records.withColumn("fingerprint", fingerprint(F.col("title"), F.col("company"), F.col("job_board")))


def lacking() -> Column:
    """Has the record no title, company, url or board?"""
    bad = F.lit(False)
    for name in ("title", "company", "url", "job_board"):
        bad = bad | F.col(name).isNull()
    return bad


def split_rejects(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rows lacking a title, company, url or board)."""
    return records.where(~lacking()), records.where(lacking())


def ordered_dedup(
    records: DataFrame, url: str = "url", fp: str = "fingerprint", seq: str = "seq", rounds: int = ROUNDS,
    component_rows: int = COMPONENT_ROWS,
) -> DataFrame:
    """Keep a row unless an earlier *kept* row has its url or its fingerprint.

    A dropped row blocks nothing, so this is not a grouping.  It goes in
    rounds: a row that is the earliest undecided one of both its url and its
    fingerprint is kept, undecided rows sharing a key with it are dropped.  The
    first round decides most (``_first_round``) and takes the rows themselves
    through one exchange per key, so ``records`` is read once and should be
    narrow.  What it leaves is folded to distinct (url, fingerprint) pairs and
    goes through ``rounds`` more.  What these leave open, chains of rows that
    hang on each other, is cut into connected components.  Rows of different
    components share no key, so each component of up to ``component_rows`` rows
    is decided by itself, row by row in order; larger ones go through further
    rounds, in which they fall apart.  The earliest undecided row is always
    kept, so this ends.

    ``seq`` is unique and gives the order; null fingerprints match nothing.
    Each round is written to the shared folder.
    """
    kept_rows, open_rows = _first_round(records.where(F.col(url).isNotNull()), url, fp, seq)
    later = _later_rounds(kept_rows, open_rows, url, fp, seq, rounds, component_rows)
    return kept_rows if later is None else kept_rows.unionByName(later)


def _later_rounds(
    kept_rows: DataFrame, open_rows: DataFrame, url: str = "url", fp: str = "fingerprint", seq: str = "seq",
    rounds: int = ROUNDS, component_rows: int = COMPONENT_ROWS,
) -> DataFrame | None:
    """Rows kept of those the first round left open; None if it left none.

    Of its kept rows only those matter here whose url an open row may have.
    """
    if open_rows.isEmpty():
        return None
    blocked = maybe_among(kept_rows.select(url), open_rows, url)
    open_rows = written(open_rows.join(blocked, url, "left_anti").select(*open_rows.columns), "open")
    undecided = written(
        open_rows.groupBy(F.col(url).alias("u"), F.col(fp).alias("f")).agg(F.min(seq).alias("s")), "undecided")
    kept_parts = []
    while not undecided.isEmpty():
        for _ in range(rounds):
            kept, undecided = _round(undecided)
            kept_parts.append(kept)
            if undecided.isEmpty():
                break
        else:
            kept, undecided = _by_component(undecided, component_rows)
            kept_parts.append(kept)
    if not kept_parts:
        return None
    kept_seq = kept_parts[0]
    for part in kept_parts[1:]:
        kept_seq = kept_seq.unionByName(part)
    return open_rows.join(kept_seq, open_rows[seq] == kept_seq["s"], "left_semi")


def _first_round(records: DataFrame, url: str, fp: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows that no kept row of their fingerprint drops; one of their url still may).

    The first of each url is marked in an exchange by url.  In one by
    fingerprint the first of each fingerprint then tells whether it is kept:
    kept it drops the others there and then.  Null fingerprints are spread by
    url.  A key's rows lie in one task, sorted on disk where they are many.
    """
    other = F.col(seq) != F.min(seq).over(Window.partitionBy(url))
    same_fp = Window.partitionBy(fp, F.when(F.col(fp).isNull(), F.col(url)))
    rows = records.withColumn("_other", other)
    rows = rows.withColumn("_least", F.min(F.struct(F.col(seq).alias("s"), F.col("_other").alias("other"))).over(same_fp))
    rows = rows.withColumn("_kept", ~F.col("_other") & (F.col(seq) == F.col("_least.s")))
    state = written(rows.where(F.col("_kept") | F.col("_least.other")).drop("_other", "_least"), "first-round")
    return state.where("_kept").drop("_kept"), state.where("NOT _kept").drop("_kept")


def _round(undecided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``s`` of rows kept, rows still undecided)."""
    first_of_url = undecided.groupBy("u").agg(F.min(F.struct("s", "f")).alias("m")).select("u", "m.*")
    first_of_fp = undecided.where("f IS NOT NULL").groupBy("f").agg(F.min("s").alias("s")).select("s")
    kept = written(
        first_of_url.where("f IS NOT NULL").join(first_of_fp, "s", "left_semi")
        .unionByName(first_of_url.where("f IS NULL")),
        "kept",
    )
    left = written(
        undecided.join(kept.select("u"), "u", "left_anti")
        .join(kept.where("f IS NOT NULL").select("f"), "f", "left_anti")
        .select("u", "f", "s"),
        "undecided",
    )
    return kept.select("s"), left


def _by_component(undecided: DataFrame, component_rows: int) -> tuple[DataFrame, DataFrame]:
    """(``s`` of rows kept, rows of components that are too large to decide at once)."""
    nodes = written(undecided.withColumn("v", F.monotonically_increasing_id()), "nodes")
    edges = None
    for key in ("u", "f"):
        least = nodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("v").alias("b"), F.count(F.lit(1)).alias("n"))
        linked = nodes.join(least.where("n > 1"), key).select(F.col("v").alias("a"), "b")
        edges = linked if edges is None else edges.unionByName(linked)
    roots = components(edges).withColumnRenamed("node", "v")
    rows = written(nodes.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")), "rooted")
    large = written(
        rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > component_rows), "large-components")
    small = rows.join(large.select("root"), "root", "left_anti")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, urls, fps = None, set(), set()
        for b in batches:
            kept = []
            for r, u, f, v in zip(*(b.column(n).to_pylist() for n in ("root", "u", "f", "v"))):
                if r != root:
                    root, urls, fps = r, set(), set()
                if u in urls or f in fps:
                    continue
                urls.add(u)
                if f is not None:
                    fps.add(f)
                kept.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], ["v"])

    in_order = small.repartition("root").sortWithinPartitions("root", "s").select("root", "u", "f", "v")
    kept = written(nodes.join(in_order.mapInArrow(decide, "v long"), "v", "left_semi").select("s"), "kept")
    left = written(rows.join(large.select("root"), "root", "left_semi").select("u", "f", "s"), "undecided")
    return kept, left


def _lookup(batch: DataFrame, jobs: DataFrame, key: str, out: str) -> DataFrame:
    """Lowest posting id per key of the batch.

    The stored side is cut by the batch's keys before it is grouped, so what is
    shuffled follows the batch and not the table.
    """
    near = maybe_among(jobs.select(key, "id"), batch.select(key), key)
    return near.groupBy(key).agg(F.min("id").alias(out))


def j_exists_url(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """``url_id``: the lowest posting id with the record's url.  ``records`` is read three times."""
    return records.join(_lookup(records, jobs, "url", "url_id"), "url", "left")


def j_exists_fp(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """``fp_id``: the lowest posting id with the record's fingerprint.  ``records`` is read three times."""
    return records.join(_lookup(records, jobs, "fingerprint", "fp_id"), "fingerprint", "left")


def classify(
    records: DataFrame, jobs: DataFrame, carry: list[str] | None = None, at_rest: bool = False,
) -> DataFrame:
    """Give every usable record its outcome against the stored postings.

    ``outcome`` is ``new``, ``touch`` (``job_id`` is the stored posting seen
    again, by url before fingerprint) or ``repeat`` (of a record kept earlier
    in this batch).  ``carry`` names the columns the result needs besides url,
    fingerprint and seq; by default it has all of the records, which then meet
    their outcomes in one exchange and take no part in those by key.  Records
    that lie in files already (``at_rest``) are read from there.
    """
    if carry is None and set(records.columns) == {"url", "fingerprint", "seq"}:
        carry = []
    if carry is not None:
        narrow = records.select("url", "fingerprint", "seq", *carry)
        return _outcomes(narrow if at_rest else written(narrow, "records"), jobs)
    return whole_outcomes(*classify_rows(records, jobs))


def classify_rows(records: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the records, written with a number ``_record``; url, fingerprint, seq, job_id and outcome per ``_record``)."""
    records = written(records.withColumn("_record", F.monotonically_increasing_id()), "records")
    return records, written(_outcomes(records.select("url", "fingerprint", "seq", "_record"), jobs), "outcomes")


def whole_outcomes(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    return records.join(outcomes.select("_record", "job_id", "outcome"), "_record").drop("_record")


def _outcomes(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """``records`` with ``job_id`` and ``outcome``; they are written and should be narrow.

    One exchange by url and one by fingerprint look keys up and at once make the
    first round of ``ordered_dedup``: a record is kept when it is the first of
    its url of those not stored by url, and the first unknown one of its
    fingerprint.  Records of a url that others have too meet the one kept
    where the rounds or equal places in the order leave that open.
    """
    others = [n for n in records.columns if n not in ("url", "fingerprint", "seq")]
    # a record without fingerprint has a key of its own, so that these are spread
    fp_key = F.concat(F.lit("f"), "fingerprint").alias("_key")
    url_ids = _lookup(records, jobs, "url", "url_id")
    fp_ids = _lookup(records.select(fp_key), jobs.select(fp_key, "id"), "_key", "fp_id")
    of_url = Window.partitionBy("url")
    rows = records.join(url_ids, "url", "left").withColumns({
        "_other": F.col("seq") != F.min("seq").over(of_url),
        "_shared": F.count(F.lit(1)).over(of_url) > 1,
        "_copies": F.count(F.lit(1)).over(Window.partitionBy("url", "seq")),
    })
    rows = rows.select(
        "url", "seq", *others, "url_id", "_other", "_shared", (F.max("_copies").over(of_url) > 1).alias("_twins"),
        F.coalesce(fp_key, F.concat(F.lit("u"), "url")).alias("_key"))
    unknown = F.col("url_id").isNull() & F.col("fp_id").isNull() & F.col("url").isNotNull()
    least = F.min(F.when(unknown, F.struct(F.col("seq").alias("s"), F.col("_other").alias("other")))).over(Window.partitionBy("_key"))
    rows = rows.join(fp_ids, "_key", "left").withColumn("_least", least)
    kept = ~F.col("_other") & (F.col("seq") == F.col("_least.s"))
    found = written(rows.select(
        F.when(F.startswith("_key", F.lit("f")), F.substring("_key", 2, 2**31 - 1)).alias("fingerprint"), "url", "seq", *others,
        "url_id", "fp_id", "_other", "_shared", "_twins",
        F.when(unknown & kept, "kept").when(unknown & F.col("_least.other"), "open").alias("_state")), "classified")
    keys = ["url", "fingerprint", "seq"]
    # a url that no other record has settles nothing beyond its record
    kept_rows = found.where("_state = 'kept' AND _shared").select(*keys)
    later = _later_rounds(kept_rows, found.where("_state = 'open'").select(*keys))
    if later is not None:
        kept_rows = kept_rows.unionByName(later)
    meets = F.coalesce((F.col("_state") == "open") | F.col("_twins") | (F.col("_other") & F.col("fp_id").isNotNull()), F.lit(False))
    meets = meets & F.col("url_id").isNull()
    meeting = found.where(meets)
    kept_rows = maybe_among(kept_rows, meeting, "url").select(F.col("url").alias("kept_url"), F.col("seq").alias("kept_seq"))
    marked = meeting.join(kept_rows, F.col("url") == F.col("kept_url"), "left").drop("kept_url").unionByName(
        found.where(~meets).withColumn("kept_seq", F.when(F.col("_state") == "kept", F.col("seq"))))
    # a record that repeats the url of a kept one touches that, not a stored fingerprint
    repeats_kept = F.col("url_id").isNull() & (F.col("kept_seq") < F.col("seq"))
    stored = F.coalesce("url_id", F.when(repeats_kept, None).otherwise(F.col("fp_id")))
    outcome = (
        F.when(stored.isNotNull(), "touch")
        .when(F.col("kept_seq") == F.col("seq"), "new").otherwise("repeat")
    )
    return marked.select(
        "fingerprint", "url", "seq", *others, stored.alias("job_id"), F.coalesce(outcome, F.lit("repeat")).alias("outcome"))


def numbered(
    rows: DataFrame, order: str | list[str], start: Column | int, out: str = "id", rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Consecutive numbers from ``start`` in ``order``, without one task seeing all rows.

    Rows are counted, range-partitioned by sampled quantiles into as many
    partitions as ``rows_per_task`` asks for, sorted there and written with
    partition and place, so both stay fixed; each partition counts on from the
    sizes of those before it.
    """
    order = [order] if isinstance(order, str) else order
    parts = max(1, -(-rows.count() // rows_per_task))
    ranged = written(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id()), "ranged")
    # the upper bits of the id are the partition, the lower 33 the place in it
    ranged = ranged.withColumns({"_part": F.shiftright("_row", 33), "_place": F.col("_row").bitwiseAND((1 << 33) - 1)})
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    first = F.lit(start) if isinstance(start, int) else start
    return (
        ranged.join(F.broadcast(before), "_part")
        .withColumn(out, (first + F.col("_before") + F.col("_place")).cast("bigint"))
        .drop("_row", "_part", "_place", "_before")
    )


def ingest_touch(jobs: DataFrame, outcomes: DataFrame, as_of) -> DataFrame:
    """Postings seen again become active and take ``as_of`` as last sighting."""
    seen = outcomes.where("outcome = 'touch'").select(F.col("job_id").alias("_seen")).distinct()
    at = F.lit(as_of).cast(jobs.schema["last_seen_at"].dataType)
    hit = F.col("_seen").isNotNull()
    return jobs.join(seen, jobs["id"] == seen["_seen"], "left").withColumns({
        "last_seen_at": F.when(hit, at).otherwise(F.col("last_seen_at")),
        "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
        "is_active": hit | F.col("is_active"),
    }).drop("_seen")


def ingest_new_row(
    jobs: DataFrame, outcomes: DataFrame, as_of, top: int | None = None, records: DataFrame | None = None,
) -> DataFrame:
    """Posting rows of the new records, numbered on from the stored ones in arrival order.

    ``top`` is the highest stored id, looked up where it is not known.
    ``records`` are the whole records where outcomes hold keys only
    (``classify_rows``); the keys are numbered then, and the records meet their numbers.
    """
    if top is None:
        top = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    new = outcomes.where("outcome = 'new'")
    at = {n: F.lit(as_of).cast(jobs.schema[n].dataType) for n in ("scraped_at", "updated_at", "last_seen_at")}
    if records is None:
        rows = numbered(new, "seq", int(top) + 1)
    else:
        rows = records.join(numbered(new.select("seq", "_record"), "seq", int(top) + 1).drop("seq"), "_record")
    rows = rows.withColumns({**at, "is_active": F.lit(True)})
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in jobs.schema
    ])


def ingest(jobs: DataFrame, records: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings after the load, outcome per usable record, rejected records)."""
    usable, rejects = split_rejects(records)
    rows, outcomes = classify_rows(with_fingerprint(usable), jobs)
    after = ingest_touch(jobs, outcomes, as_of).unionByName(ingest_new_row(jobs, outcomes, as_of, records=rows))
    return after, whole_outcomes(rows, outcomes), rejects


def load_into(
    spark: SparkSession, folder: str, schema, records: DataFrame, as_of, load: int, fold_now: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Load records into a store (``sources/store.py``) as load number ``load``.

    Returns (outcome per usable record, rejected records).  What is written is
    the new postings and the sightings; ``fold_now`` also brings them into the
    buckets they touch.  Repeating a load gives the same table again.
    """
    usable, rejects = split_rejects(records)
    keys, top = stored_keys(spark, folder, schema, load)
    rows, outcomes = classify_rows(with_fingerprint(usable), keys)
    empty = spark.createDataFrame([], schema)
    seen = outcomes.where("outcome = 'touch'").select(F.col("job_id").alias("id")).distinct()
    at = F.lit(as_of).cast("timestamp_ntz").alias("last_seen_at")
    append_load(folder, load, ingest_new_row(empty, outcomes, as_of, top, rows), seen.select("id", at))
    if fold_now:
        fold(spark, folder, schema, load)
    return whole_outcomes(rows, outcomes), rejects


def run_counts(outcomes: DataFrame, rejects: DataFrame, source: str = "job_board") -> DataFrame:
    """Per source: scraped, added, duplicates, errors.  A failed commit is ``commit_failed``."""
    rows = outcomes.select(source, "outcome").unionByName(
        rejects.select(source, F.lit("error").alias("outcome")))
    is_ = lambda x: F.col("outcome") == x
    return rows.groupBy(F.col(source).alias("name")).agg(
        F.count(F.lit(1)).alias("jobs_scraped"),
        F.count_if(is_("new")).alias("jobs_added"),
        F.count_if(is_("touch") | is_("repeat")).alias("duplicates"),
        F.count_if(is_("error")).alias("errors"),
    )


def commit_failed(counts: DataFrame) -> DataFrame:
    """Counts of a batch whose write failed: what was added becomes errors."""
    return counts.withColumn("errors", F.col("errors") + F.col("jobs_added")).withColumn(
        "jobs_added", F.lit(0).cast("bigint"))


def fp_backfill(jobs: DataFrame, as_of=None) -> DataFrame:
    """Fill missing fingerprints; ``backfilled`` marks the rows that got one, ``as_of`` stamps them."""
    missing = F.col("fingerprint").isNull()
    filled = F.when(missing, fingerprint(F.col("title"), F.col("company"), F.col("job_board")))
    after = jobs.withColumns({
        "backfilled": missing, "fingerprint": filled.otherwise(F.col("fingerprint")),
    })
    return touched(after, "backfilled", as_of)
