"""Pieces of a text that the tokenizer file encodes one by one.

Its normaliser composes (NFC), turns white space (Unicode White_Space) into
blanks and lower-cases; its splitting rule then cuts out pieces, drops white
space and merges tokens within a piece only.  Neither the normaliser nor the
special strings reach across white space.  So a text's encoding is that of its
pieces, and each distinct piece need be encoded only once.
"""

from __future__ import annotations

import json
import re

# What a tokenizer file must say for the rules below to be its own.
NORMALISER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLITTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# The splitting rule, letters and numbers spelled out for U+0000 to U+024F.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_SPACES = "\t-\r \x85\xa0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_LATIN = re.compile("[\x00-ɏ]*")  # composed already; lower() works letter by letter
_SPACE = re.compile(f"[{_SPACES}  -     　]+")


def check_file(path: str, decodes: bool = False) -> None:
    """ValueError unless the tokenizer file normalises, splits and marks special strings as assumed here.

    With ``decodes`` it must have no decoder either, so that tokens are joined by one space.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = [(s["pattern"].get("Regex"), s["behavior"], s["invert"]) for s in steps if s["type"] == "Split"]
    bytewise = [(s["add_prefix_space"], s["use_regex"]) for s in steps if s["type"] == "ByteLevel"]
    fits = {
        "normaliser": (spec["normalizer"] or {}).get("normalizers") == NORMALISER,
        "splitting rule": split == [(SPLITTING, "Removed", True)] and bytewise == [(False, False)] and len(steps) == 2,
        "word end": spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>",
        "special strings": all(
            re.fullmatch(r"<\|\S+", t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])
            for t in spec["added_tokens"]),
        "decoder": not decodes or spec["decoder"] is None,
    }
    wrong = [name for name, good in fits.items() if not good]
    if wrong:
        raise ValueError(f"{path}: other {', '.join(wrong)} than these rules are for")


def is_space(char: str) -> bool:
    return bool(_SPACE.match(char))


def pieces(text: str, library, special: dict[str, int]) -> list[str]:
    """The text's pieces, normalised; special strings are pieces of their own.

    Words with letters beyond Latin go through the library's own normaliser and
    splitting rule, as its Unicode tables decide there.
    """
    if "<|" not in text and _LATIN.fullmatch(text):
        return _PIECES.findall(text.lower())
    out = []
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")")
    for word in _SPACE.split(text):
        for part in cut.split(word):
            if part in special:
                out.append(part)
            elif _LATIN.fullmatch(part):
                out += _PIECES.findall(part.lower())
            else:
                normal = library.normalizer.normalize_str(part)
                out += [normal[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(normal)]
    return out
