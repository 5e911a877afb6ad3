"""Secret scans: keyword prefilter, anchored expressions near hits, embedded checksums.

An Aho-Corasick automaton over all keywords, whatever their case, runs once over
a text.  Only where a keyword ends does its kind's expression run, anchored at
the keyword's first character.  Kinds:

* ``assign``: a value of 8 or more characters given to a name such as password;
* ``access``: an access key id of 16 or more characters;
* ``hex``: 32 or more hexadecimal digits.  It has no keyword; every such run
  covers two neighbouring probes 16 characters apart, so a run is only measured
  where two probes in a row hit a digit;
* ``forge``, ``package``: access tokens that embed a checksum, the CRC-32 of
  their first 30 characters in six base-62 digits.  Those that do not add up
  are no tokens.

Matches of a kind do not overlap and the leftmost counts, as if the expression
were searched from left to right; those too short are dropped afterwards.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import or_empty, short

# Names, prefixes, expressions and lengths of the kinds.
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGNED = re.compile("""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX, HEX_LENGTH = re.compile("[0-9a-f]+"), 32
CHECKED = {"ghp_": "forge", "gho_": "forge", "ghu_": "forge", "ghs_": "forge", "ghr_": "forge", "npm_": "package"}
BODY, SIGNED = re.compile("[A-Za-z0-9]+"), 30
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "forge", "package")
BASE_KINDS = KINDS[:3]
PROBE = HEX_LENGTH // 2
DIGITS = frozenset("0123456789abcdef")


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for name in NAMES:
        for cased in {"".join(c) for c in product(*((x, x.upper()) for x in name))}:
            found.add_word(cased, ("assign", len(name)))
    found.add_word("AKIA", ("access", 4))
    for prefix, kind in CHECKED.items():
        found.add_word(prefix, (kind, len(prefix)))
    found.make_automaton()
    return found


def checksum(body: str) -> str:
    """CRC-32 of an ASCII string as six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


def _match(kind: str, text: str, start: int, after: int) -> tuple[int, bool]:
    """(end of the kind's match at ``start``, is it long and true enough); end 0 without a match."""
    if kind == "assign":
        m = ASSIGNED.match(text, after)
        return (m.end(), len(m[1]) >= 8) if m else (0, False)
    if kind == "access":
        m = ACCESS.match(text, start)
        return (m.end(), len(m[0]) >= 16) if m else (0, False)
    m = BODY.match(text, after)
    if not m:
        return 0, False
    return m.end(), len(m[0]) == SIGNED + 6 and checksum(m[0][:SIGNED]) == m[0][SIGNED:]


def _hex_runs(text: str) -> Iterator[tuple[int, int]]:
    done, n = 0, len(text)
    probes = text[::PROBE]
    for i in range(len(probes) - 1):
        at = i * PROBE
        if probes[i] in DIGITS and probes[i + 1] in DIGITS and at >= done:
            end = HEX.match(text, at).end()
            done = end
            if end <= at + PROBE:
                continue
            start = at
            while start and text[start - 1] in DIGITS:
                start -= 1
            if end - start >= HEX_LENGTH:
                yield start, end


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    hits = sorted((end - size + 1, end + 1, kind) for end, (kind, size) in _automaton().iter(text))
    done = dict.fromkeys(KINDS, 0)
    out = []
    for start, after, kind in hits:
        if start < done[kind]:
            continue
        end, good = _match(kind, text, start, after)
        if end:
            done[kind] = end
            if good:
                out.append((kind, start, end))
    out += [("hex", a, b) for a, b in _hex_runs(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for b in short(batches):
        spans = [[dict(zip(("kind", "start", "end"), s)) for s in find(t)] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, span)], ["id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans (kind, start, end; code points, end exclusive) of every row.

    Texts are scanned whole, however long; null or empty texts have no spans.
    Every row stands for itself: repeated rows and null ids come back as often
    as they occur, and an empty table gives an empty result.  Other columns are
    not read.
    """
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), or_empty(F.col(text_col)).alias("text"))
    return rows.mapInArrow(_scan, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined in order."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
