"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a prefix is fixed by its last token: it is the one token ending
there that the pair test allows after the encoding of what precedes it.  So the
distinct words of a task go into a trie of symbols; going down, each new node
gets its last token and the node where that token begins, found from the nodes
above it.  A prefix shared by many words is therefore encoded once, and a
word's ids are read off by following the begins upwards.  The last symbol of a
word is its word-end form, so it is settled per word, from the node before it.

The trie is the sorted list of the distinct words; walking the list is its
depth-first traversal, and only the nodes of the current branch are held.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import or_empty, short
from postloom.llm.token_counts import tokenizer
from postloom.llm.words import check_file, pieces

MAX_PAIRS, MAX_PIECES, SLAB = 500_000, 250_000, 1_000_000
END = "</w>"


class MergeTable:
    """Vocabulary and merges of a word-end BPE whose token ids rise with merge rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for pair in spec["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole, a, b = self.vocab[left + right], self.vocab[left], self.vocab[right]
            self.halves[whole] = (a, b)
            self.joined[a, b] = whole
        if list(self.halves) != sorted(self.halves):
            raise ValueError("token ids must rise with merge rank")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Endings of tokens, inside and at the end of words; those that are no token themselves have -1.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for token, i in self.vocab.items():
            text, endings = (token[: -len(END)], self.final) if token.endswith(END) else (token, self.inner)
            for j in range(1, len(text)):
                endings.setdefault(text[j:], -1)
            endings[text] = i
        self.pairs: dict[int, bool] = {}

    def follows(self, left: int, right: int) -> bool:
        """True if BPE leaves the two tokens apart when their symbols stand side by side."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Undo the merges of both, latest first, and look for an earlier merge across the border.

        ``bound`` is the rank before which a merge across must come to be taken:
        the merge on either side that used the border's token up.
        """
        bound = 1 << 30
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < bound:
                return False
            undo_left, undo_right = self.halves.get(left), self.halves.get(right)
            if undo_left is None and undo_right is None:
                return True
            # On equal rank the merge further left is made first.
            if undo_right is None or (undo_left is not None and left > right):
                bound, left = left, undo_left[1]
            else:
                bound, right = right + 1, undo_right[0]


def traverse(words: list[str], table: MergeTable) -> Iterator[list[int]]:
    """Ids of each of the sorted distinct ``words``, given as byte-level symbols.

    ``last`` and ``begin`` hold, for the node at each depth of the branch, the
    last token of that prefix and the depth at which it begins.
    """
    inner, final, pairs, follows = table.inner, table.final, table.pairs, table.follows
    last, begin, before = [-1], [0], ""
    for word in words:
        n = len(word)
        shared, most = 0, min(len(before), n) - 1
        while shared < most and before[shared] == word[shared]:
            shared += 1
        del last[shared + 1 :], begin[shared + 1 :]
        for i in range(shared + 1, n):
            for j in range(i - 1, -1, -1):
                token = inner[word[j:i]]
                if token >= 0:
                    if j == 0 or (ok := pairs.get(last[j] << 20 | token)) or ok is None and follows(last[j], token):
                        break
            last.append(token)
            begin.append(j)
        for j in range(n - 1, -1, -1):
            token = final[word[j:]]
            if token >= 0 and (j == 0 or follows(last[j], token)):
                break
        ids = [token]
        while j:
            ids.append(last[j])
            j = begin[j]
        ids.reverse()
        before = word
        yield ids


def _byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return out


class Encoder:
    """Texts to ids and tokens: the pieces of a text, then the trie of those not met before."""

    def __init__(self, path: str):
        self.library, self.table = tokenizer(path), MergeTable(path)
        self.symbols = str.maketrans(_byte_symbols())
        self.numbers = [str(i) for i in range(max(self.table.names) + 1)]
        self.known: dict[str, tuple[str, str, int]] = {}

    def in_symbols(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece
        return piece.encode().decode("latin-1").translate(self.symbols)

    def learn(self, found: set[str]) -> None:
        if len(self.table.pairs) > MAX_PAIRS:
            self.table.pairs.clear()
        self.known.update({s: (str(i), s, 1) for s, i in self.table.special.items()})
        words = {self.in_symbols(p): p for p in found if p not in self.table.special}
        branch, names, numbers = sorted(words), self.table.names, self.numbers
        for word, ids in zip(branch, traverse(branch, self.table)):
            self.known[words[word]] = (
                " ".join([numbers[i] for i in ids]), " ".join([names[i] for i in ids]), len(ids)
            )

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of ids, ids and decoded text, both joined by one space."""
        at = 0
        while at < len(texts):
            slab, chars = [], 0
            while at < len(texts) and chars < SLAB:
                slab.append(pieces(texts[at], self.library, self.table.special))
                chars += len(texts[at])
                at += 1
            distinct = {p for found in slab for p in found}
            fresh = {p for p in distinct if p not in self.known}
            if len(self.known) + len(fresh) > MAX_PIECES:
                fresh = distinct  # the cache starts anew
                self.known.clear()
            self.learn(fresh)
            for found in slab:
                if found:
                    ids, tokens, n = zip(*[self.known[p] for p in found])
                    yield sum(n), " ".join(ids), " ".join(tokens)
                else:
                    yield 0, "", ""


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens and, as ``digests`` says, either

    ids (decimal, joined by one space) and decoded, or their sha256 in
    ids_sha256 and decoded_sha256, taken where they are made.

    Ids are those of the tokenizers library without added special tokens; the
    decoded text is that of its ``decode`` with special tokens kept, which for
    a file without decoder joins the tokens by one space.  Null texts are
    empty: no ids, empty decoded text.  An empty table gives no rows.  A file
    with other rules or a decoder is an error.
    """
    check_file(path, decodes=True)
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches, 512):
            rows = list(encoder(path).encode_texts(b.column("text").to_pylist()))
            out = [[n for n, _, _ in rows], *([r[k] for r in rows] for k in (1, 2))]
            if digests:
                out[1:] = [[hashlib.sha256(s.encode()).hexdigest() for s in strings] for strings in out[1:]]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(out[0], pa.int64()), *(pa.array(s, pa.string()) for s in out[1:])],
                ["id", "n_tokens", *names],
            )

    base = docs.select(F.col(id_col).alias("id"), or_empty(F.col(text_col)).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, n_tokens long, {names[0]} string, {names[1]} string")
