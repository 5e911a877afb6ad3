"""WARC archives: writing pages as records, and segment reassembly on reading.

A page becomes a response record with a chunked HTTP message.  Of equal
payloads of some size one is archived, the others become revisits of it.  A
block longer than ``segment_bytes`` is cut: the first record keeps its type with
segment number 1, continuation records name their origin, the last one states
the total length.

Archives are written with Spark's text writer, whose line separator is the
blank lines that end a record, and read as binary files; so they can lie in any
store Spark reaches.  No record is longer than a segment, so no file is longer
than ``records_per_file`` segments.

Reading groups the continuation records by origin identifier, orders them by
segment number, verifies numbers and total length, and decodes the chunked
framing.  What does not verify is returned with its problem, not dropped.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import attach, or_empty, tagged
from postloom.session import new_folder, written

VERSION, MARK, BREAK = b"WARC/1.1\r\n", b"WARC/1.", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def record_id(key: str, copy: int) -> str:
    return f"<urn:page:{quote(key, safe='')}:{copy}>"


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """The payload in chunked transfer framing."""
    out = []
    for at in range(0, len(payload), chunk_bytes):
        piece = payload[at : at + chunk_bytes]
        out += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Decode chunked transfer framing; raises ValueError where it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return VERSION + f"{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(row: dict, date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the blank lines that end them."""
    payload = row["payload"].encode()
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = record_id(row["key"], row["copy"])
    headers = {
        "WARC-Type": "revisit" if row["refers"] else "response", "WARC-Record-ID": own, "WARC-Date": date,
        "WARC-Target-URI": quote(row["url"], safe="/:?#[]@!$&'()*+,;=%-._~") if row["url"] else None,
        "WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response",
    }
    if row["refers"]:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(row["refers"], row.get("refers_copy") or 1)}
        yield record(headers, f"{HTTP}Content-Length: {len(payload)}\r\n\r\n".encode())
        return
    block = f"{HTTP}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield record(headers, block)
        return
    pieces = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    yield record(headers | {"WARC-Segment-Number": "1"}, pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        yield record({
            "WARC-Type": "continuation", "WARC-Record-ID": f"{own[:-1]}:{n}>", "WARC-Date": date,
            "WARC-Target-URI": headers["WARC-Target-URI"], "WARC-Segment-Number": str(n), "WARC-Segment-Origin-ID": own,
            "WARC-Segment-Total-Length": str(len(block)) if n == len(pieces) else None,
        }, piece)


def _writer(date: str, segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for row in b.to_pylist():
                for r in page_records(row, date, segment_bytes, chunk_bytes):
                    held.append(r)
                    size += len(r)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    return run


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """key, copy, url, payload, refers, refers_copy: the rows to archive.

    ``refers`` is the key of the page with the largest id among those with an
    equal payload of at least ``min_bytes``, null for that page itself.  The only
    row of an id is copy 1 of it; where an id has several rows, whatever their
    payloads, each one's copy is a number of its own, drawn from its place in
    the table.  The pages are written with that place first, so places stay the
    same, and everything about a row is found by it: no key, however hot, meets
    in one task.
    """
    rows = written(pages.select(
        tagged(F.col(id_col)).alias("key"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
        or_empty(F.col(html_col)).alias("payload"), F.monotonically_increasing_id().alias("place"),
    ).withColumn("sha1", F.sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload")), "warc-pages")
    keys = rows.select("place", "key", "id", "sha1", "size")
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copy = F.when(F.col("n").isNull(), 1).otherwise(F.col("place") + 2).cast("long").alias("copy")
    numbered = written(attach(keys, written(many, "warc-ids"), ["key"], "n").select(*keys.columns, copy), "warc-copies")
    large = numbered.where(F.col("size") >= min_bytes)
    best = F.max(F.struct(F.col("id").isNotNull().alias("some"), "id", "copy", "key")).alias("best")
    groups = large.groupBy("sha1", "size").agg(best, F.count(F.lit(1)).alias("n")).where("n > 1")
    known = attach(large, written(groups, "warc-groups"), ["sha1", "size"], "n").where("best IS NOT NULL")
    known = known.where((F.col("best.key") != F.col("key")) | (F.col("best.copy") != F.col("copy")))
    known = known.select("place", F.col("best.key").alias("refers"), F.col("best.copy").alias("refers_copy"))
    odd = written(
        numbered.select("place", "copy").join(known, "place", "left").where("copy != 1 OR refers IS NOT NULL"), "warc-revisits")
    return rows.join(odd, "place", "left").select(
        "key", F.coalesce("copy", F.lit(1)).alias("copy"), "url", "payload", "refers", "refers_copy")


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000,
    segment_bytes: int = 16384, chunk_bytes: int = 4096, records_per_file: int = 1024, date: str = "2024-01-01T00:00:00Z",
    folder: str | None = None,
) -> str:
    """Archive every page; returns the folder.

    Null html is an empty payload, a null url leaves the target out, a null id
    is an id of its own.  Every row gets a record with an id of its own, also
    where rows repeat or share an id with other payloads.  Long pages are cut
    into segments; other columns are not read.  An empty table gives an empty
    folder.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = with_revisits(pages, id_col, url_col, html_col, min_bytes)
    records = rows.mapInArrow(_writer(date, segment_bytes, chunk_bytes), "record binary")
    (
        records.select(F.col("record").cast("string").alias("value")).write
        .option("lineSep", BREAK.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
        .text(folder)
    )
    return folder


FIELDS = {
    "record_id": "WARC-Record-ID", "type": "WARC-Type", "uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
    "digest": "WARC-Payload-Digest", "segment": "WARC-Segment-Number", "origin": "WARC-Segment-Origin-ID",
    "total": "WARC-Segment-Total-Length",
}
RECORD = "record_id string, type string, uri string, refers_to string, digest string, segment long, origin string, total long, block binary, problem string"


def _record_at(data: bytes, at: int, ended: bool) -> tuple[dict | None, int]:
    """(the record at ``at``, where the next begins); no record where more data is needed."""
    empty = dict.fromkeys([*FIELDS, "block", "problem"])
    begun = data[at : at + len(MARK)]
    end = data.find(BREAK, at)
    if end < 0 and not ended and MARK.startswith(begun):
        return None, at
    if begun != MARK or end < 0:
        return empty | {"block": data[at:], "problem": "no record header"}, -1
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    row = empty | {k: headers.get(f.lower()) for k, f in FIELDS.items()}
    for k in ("segment", "total"):
        row[k] = int(row[k]) if row[k] and row[k].isdigit() else None
    length = headers.get("content-length", "")
    start = end + len(BREAK)
    if length.isdigit() and start + int(length) > len(data) and not ended:
        return None, at
    if not length.isdigit() or start + int(length) > len(data):
        return row | {"block": data[start:], "problem": "record cut short"}, -1
    stop = start + int(length)
    return row | {"block": data[start:stop]}, stop


def _records(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records of an archive that comes in pieces; one that is broken ends it, with its problem.

    No more is held than the record being read and a piece.
    """
    held, new, size, needed, ended = b"", [], 0, 1, False
    while not ended:
        piece = next(pieces, None)
        ended = piece is None
        new.append(piece or b"")
        size += len(new[-1])
        if size < needed and not ended:
            continue
        held, new, at = b"".join([held, *new]), [], 0
        while True:
            while held.startswith(b"\r\n", at):
                at += 2
            if at == len(held) or (held[at:] == b"\r" and not ended):
                break
            row, after = _record_at(held, at, ended)
            if row is None:
                break
            yield row
            if after < 0:
                return
            at = after
        held = held[at:]
        # pieces are joined again when as much has come as is held, so a long record costs no repeated copies
        size, needed = 0, max(1, len(held))


def parse(data: bytes) -> Iterator[dict]:
    """Records of an archive in order; one that is broken ends the file, with its problem."""
    return _records(iter((data,)))


GZIP = b"\x1f\x8b"
FED = 1 << 16  # compressed bytes handed over at a time, so that many members cost no long copies


def _unpacked(data: bytes, problems: list[dict]) -> Iterator[bytes]:
    """The text of all gzip members in pieces; what is left, if anything, becomes a problem row."""
    view, at = memoryview(data), 0
    while at < len(data):
        start, member, problem = at, zlib.decompressobj(31), None
        if data[at : at + 2] != GZIP:
            problem = "no gzip member"
        try:
            while not problem and not member.eof:
                if at == len(data):
                    problem = "gzip member cut short"
                    break
                yield member.decompress(view[at : at + FED])
                at = min(at + FED, len(data)) - len(member.unused_data)
        except zlib.error:
            problem = "gzip member damaged"
        if problem:
            problems.append(dict.fromkeys([*FIELDS, "block", "problem"]) | {"block": data[start:], "problem": problem})
            return


def gunzipped(data: bytes) -> tuple[bytes, dict | None]:
    """The text of all gzip members one after the other, and a problem row for what is left, if anything."""
    problems: list[dict] = []
    return b"".join(_unpacked(data, problems)), problems[0] if problems else None


def archive_records(data: bytes) -> Iterator[dict]:
    """Records of an archive, plain or of gzip members, unpacked only as far as they are read."""
    problems: list[dict] = []
    yield from _records(_unpacked(data, problems) if data[:2] == GZIP else iter((data,)))
    yield from problems


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"segment": pa.int64(), "total": pa.int64(), "block": pa.binary()}
    schema = pa.schema([(k, kinds.get(k, pa.string())) for k in [*FIELDS, "block", "problem"]])
    for b in batches:
        for content in b.column("content"):
            held, size = [], 0
            for row in archive_records(content.as_py()):
                held.append(row)
                size += len(row["block"] or b"")
                if len(held) == 256 or size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_records(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """All records of the archives in ``folder`` whose names match ``pattern``, continuations included.

    Archives may be plain or have any number of gzip members; they are unpacked
    while their records are read.  Names that begin with "_" or "." are no
    archives.  A file is one binary value, so none may exceed 2 GB.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("content")
    return files.mapInArrow(_parse_files, RECORD)


def payload_of(block: bytes) -> tuple[bytes, int]:
    """Payload and its length from an HTTP message; the length stated, where there is no body."""
    head, _, body = block.partition(BREAK)
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])}
    if headers.get("transfer-encoding", "").lower() == "chunked":
        body = unchunked(body)
    elif not body and headers.get("content-length", "").isdigit():
        return body, int(headers["content-length"])
    return body, len(body)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "type", "uri", "refers_to", "payload", "payload_bytes", "payload_digest", "problem"]
    kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
    for b in batches:
        out = []
        for r in b.to_pylist():
            parts, problem = r["parts"], r["problem"]
            block = b"".join(p["block"] for p in parts)
            if r["segmented"]:
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                    problem = problem or "segment missing or repeated"
                elif r["total"] != len(block):
                    problem = problem or "total length differs"
            row = {k: r[k] for k in ("record_id", "type", "uri", "refers_to")} | {"payload": b"", "payload_bytes": 0}
            declared = r["digest"] or ""
            row["payload_digest"] = base64.b32decode(declared[5:]).hex() if len(declared) == 37 else None
            if not problem:
                try:
                    row["payload"], row["payload_bytes"] = payload_of(block)
                except ValueError as e:
                    problem = str(e)
                if r["type"] == "response" and not problem and hashlib.sha1(row["payload"]).hexdigest() != row["payload_digest"]:
                    problem = "payload digest differs"
            out.append(row | {"problem": problem})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(n, kinds.get(n, pa.string())) for n in names]))


def read_payloads(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """One row per response and revisit: record_id, type, uri, refers_to, payload,
    payload_bytes, payload_digest (hex; of the full payload), problem (null if verified).

    A revisit's payload is empty; its length and digest are those it states.
    Continuations without a first segment give a row with a problem.
    """
    records = read_records(spark, folder, pattern)
    part = F.struct("segment", "block")
    keep = ["record_id", "type", "uri", "refers_to", "digest", "problem"]
    whole = records.where("segment IS NULL").select(
        *keep, "total", F.lit(False).alias("segmented"), F.array(part).alias("parts")
    )
    first = lambda c: F.max(F.when(F.col("origin").isNull(), F.col(c))).alias(c)
    joined = (
        records.where("segment IS NOT NULL").groupBy(F.coalesce("origin", "record_id").alias("record_id"))
        .agg(*[first(c) for c in keep[1:]], F.max("total").alias("total"), F.sort_array(F.collect_list(part)).alias("parts"))
        .select(*keep, "total", F.lit(True).alias("segmented"), "parts")
    )
    return whole.unionByName(joined).mapInArrow(
        _decode,
        "record_id string, type string, uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, problem string",
    )
