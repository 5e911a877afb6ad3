"""Token counts, with overlap resynchronisation for huge documents.

Documents of up to ``chunk_chars`` characters are encoded as they are, each
distinct piece (a word, a number, a run of marks) once per Python worker.  Longer ones are cut into overlapping chunks, which
tasks encode independently, with offsets.  Two neighbouring chunks are spliced
at a position both encodings have as a boundary, that is white space (which no
token, normalisation or special string crosses), and before which both agree on
the tokens of at least one stretch of the overlap; or at the end of the
document.  Where there is none, the cut is moved out: the next round takes both
chunks as one and doubles the overlap, until all cuts of a document hold.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import attach, or_empty, short
from postloom.llm.words import check_file, is_space, pieces
from postloom.session import written

CACHED_PIECES = 600_000
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer, loaded once per Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].no_truncation()
        _loaded[path].no_padding()
    return _loaded[path]


class PieceCounts:
    """Tokens of each text, from the tokens of its pieces; every distinct piece is encoded once."""

    STEP = 2000  # pieces encoded at a time, as one text

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.known: dict[str, int] = dict.fromkeys(self.special, 1)

    def learn(self, found: list[str]) -> None:
        for at in range(0, len(found), self.STEP):
            some = found[at : at + self.STEP]
            e = self.library.encode(" ".join(some), add_special_tokens=False)
            self.known.update(zip(some, np.bincount(e.word_ids, minlength=len(some)).tolist()))

    def count(self, texts: list[str]) -> list[int]:
        out, known = [], self.known
        for at in range(0, len(texts), 256):
            split = [pieces(t, self.library, self.special) for t in texts[at : at + 256]]
            self.learn(list({p for found in split for p in found if p not in known}))
            out += [sum(map(known.__getitem__, found)) for found in split]
            if len(known) > CACHED_PIECES:
                known.clear()
                known.update(dict.fromkeys(self.special, 1))
        return out


_counters: dict[str, PieceCounts] = {}


def _count_small(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:  # one per Python worker
            _counters[path] = PieceCounts(path)
        counter = _counters[path]
        for b in short(batches):
            n = counter.count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk; the cuts of a document and its overlap come with it."""
    for b in batches:
        for row in b.to_pylist():
            text, ends = row["text"], [*row["cuts"], len(row["text"])]
            for no, (start, end) in enumerate(zip([0, *row["cuts"]], ends)):
                piece = text[start : end + row["overlap"]]
                values = [row["digest"], no, start, end, len(text), row["overlap"], piece]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v]) for v in values], ["digest", "no", "start", "end", "length", "overlap", "piece"]
                )


def boundaries(piece: str, ends: list[int], ids: list[int], low: int, high: int, length: int) -> dict:
    """Boundaries of an encoding between piece positions low and high.

    Each is a white-space position (or ``length``, the end of the document if
    the piece reaches it) with the number of tokens before it and a checksum of
    the tokens since the boundary before.
    """
    at, before, sums, n, last = [], [], [], 0, 0
    for p in range(max(low, 0), min(high, len(piece))):
        if not is_space(piece[p]):
            continue
        while n < len(ends) and ends[n] <= p:
            n += 1
        at.append(p)
        before.append(n)
        sums.append(zlib.crc32(" ".join(map(str, ids[last:n])).encode()))
        last = n
    if length <= high:
        at.append(length)
        before.append(len(ids))
        sums.append(zlib.crc32(" ".join(map(str, ids[last:])).encode()))
    return {"at": at, "before": before, "sums": sums}


SEAMS = "struct<at: array<long>, before: array<long>, sums: array<long>>"
CHUNK = f"digest string, no long, start long, end long, length long, overlap long, n_tokens long, head {SEAMS}, tail {SEAMS}"


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seams = pa.struct([(k, pa.list_(pa.int64())) for k in ("at", "before", "sums")])
        for b in batches:
            for r in b.to_pylist():
                e = tokenizer(path).encode(r["piece"], add_special_tokens=False)
                ends, ids, start, width = [o[1] for o in e.offsets], e.ids, r["start"], r["overlap"]
                core, to_end = r["end"] - start, r["length"] - start
                found = []
                for low, high in ((0, width if r["no"] else 0), (core, core + width)):
                    f = boundaries(r["piece"], ends, ids, low, high, to_end)
                    found.append(f | {"at": [p + start for p in f["at"]]})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k]]) for k in ("digest", "no", "start", "end", "length", "overlap")]
                    + [pa.array([len(ids)], pa.int64())] + [pa.array([f], seams) for f in found],
                    ["digest", "no", "start", "end", "length", "overlap", "n_tokens", "head", "tail"],
                )

    return run


def seam(tail: dict, head: dict, length: int) -> tuple[int, int, int] | None:
    """First proven boundary of two chunks: position, tokens before it in either; None if there is none."""
    right = {p: (n, s) for p, n, s in zip(head["at"], head["before"], head["sums"])}
    previous = None
    for p, n, s in zip(tail["at"], tail["before"], tail["sums"]):
        if p in right:
            m, t = right[p]
            if p == length:
                return p, n, m
            # The stretch since the last common boundary has the same, nonempty tokens in both.
            if previous and n > previous[0] and n - previous[0] == m - previous[1] and s == t:
                return p, n, m
            previous = (n, m)
        else:
            previous = None
    return None


def splice(chunks: list[dict]) -> tuple[int, list[int]]:
    """(tokens, cuts that did not hold) of one document's chunks in order."""
    total, failed, begin, reached = 0, [], 0, -1
    for a, b in zip(chunks, [*chunks[1:], None]):
        if b is None:
            total += a["n_tokens"] - begin
            break
        found = seam(a["tail"], b["head"], a["length"])
        if found is None:
            failed.append(b["start"])
            continue
        total += found[1] - begin
        begin, reached = found[2], found[0]
        if reached == a["length"]:
            break
    return total, failed


def _splice_documents(key: tuple, rows: pa.Table) -> pa.Table:
    chunks = sorted(rows.to_pylist(), key=lambda r: r["no"])
    total, failed = splice(chunks)
    cuts = [c["start"] for c in chunks[1:]]
    # Of neighbouring cuts that failed every second one goes, so chunks double.
    moved = [c for i, c in enumerate(cuts) if c not in failed or (i and cuts[i - 1] in failed and i % 2)]
    return pa.table({
        "digest": [key[0].as_py()], "n_tokens": pa.array([None if failed else total], pa.int64()),
        "cuts": pa.array([moved], pa.list_(pa.int64())), "overlap": pa.array([2 * chunks[0]["overlap"]], pa.int64()),
    })


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32768,
    overlap_chars: int = 256,
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens.

    Counts are those of the tokenizers library for the file at ``path``,
    without added special tokens; it must be one whose tokens never hold or
    reach across white space.  Null texts are empty, with 0 tokens.  Repeated
    rows are counted each; huge texts that occur repeatedly are encoded once.
    An empty table gives no rows.  A file with other rules is an error.
    """
    check_file(path)
    base = docs.select(F.col(id_col).alias("id"), or_empty(F.col(text_col)).alias("text"))
    base = base.withColumn("n_bytes", F.octet_length("text").cast("long"))
    is_huge = F.length("text") > chunk_chars
    id_type = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    small = base.where(~is_huge).mapInArrow(_count_small(path), f"id {id_type}, n_bytes long, n_tokens long")

    huge = base.where(is_huge).withColumn("digest", F.sha2("text", 256))
    cuts = F.sequence(F.lit(chunk_chars).cast("long"), (F.length("text") - 1).cast("long"), F.lit(chunk_chars).cast("long"))
    texts = written(huge.groupBy("digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")), "huge-texts")
    todo = texts.select("digest", "text", cuts.alias("cuts"), F.lit(overlap_chars).cast("long").alias("overlap"))
    done = None
    while True:
        pieces = todo.mapInArrow(
            _cut, "digest string, no long, start long, end long, length long, overlap long, piece string"
        ).repartition("digest", "no")
        chunks = pieces.mapInArrow(_encode(path), CHUNK)
        state = written(
            chunks.groupBy("digest").applyInArrow(
                _splice_documents, "digest string, n_tokens long, cuts array<long>, overlap long"
            ),
            "huge-counts",
        )
        good = state.where("n_tokens IS NOT NULL").select("digest", "n_tokens")
        done = good if done is None else done.union(good)
        if not state.where("n_tokens IS NULL").limit(1).count():
            break
        todo = state.where("n_tokens IS NULL").drop("n_tokens").join(texts.select("digest", "text"), "digest")
        todo = todo.select("digest", "text", "cuts", "overlap")
    counted = attach(
        written(huge.select("id", "n_bytes", "digest"), "huge-ids"), done.join(texts.select("digest", "n"), "digest"),
        ["digest"], "n",
    )
    return small.unionByName(counted.select("id", "n_bytes", "n_tokens"))
