"""Text normalisation, fingerprints and the line rules of free-form cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Unicode-aware whitespace rules cover.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Company form dropped at either end, and brackets dropped anywhere.
COMPANY_FORM = "株式会社"
BRACKETS = "【】[]（）()「」『』"

# Fixed values of the line rules.
BADGES = ["New", "NEW", "急募", "PR"]
COMPANY_WORD = "会社"
TITLE_WORDS = [
    "デザイナー", "エンジニア", "マネージャー", "ディレクター", "募集",
    "開発", "担当", "リーダー", "スペシャリスト",
]
LOCATION_MARKS = ["都", "道", "府", "県", "市", "区", "リモート", "在宅"]
SALARY_MARKS = ["万円", "万〜"]


def bind(c: Column, use) -> Column:
    """``use(c)`` with ``c`` computed once per row.

    Inside a lambda, a plain column expression would be computed again for
    every element.
    """
    return F.get(F.transform(F.array(c), use), 0)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def contains_any(c: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(c, F.lit(word))
    return hit


def squeeze(c: Column) -> Column:
    """Every run of space characters as one blank.

    The engine's own Unicode space class is several times faster than a
    spelled-out one; the few controls it lacks are swapped beforehand.
    """
    for control in "\x1c\x1d\x1e\x1f":
        c = F.replace(c, F.lit(control), F.lit(" "))
    return F.regexp_replace(c, r"(?U)\s+", " ")


def norm_match(c: Column) -> Column:
    """Form used when keywords and places are looked up; null becomes ''."""
    return F.trim(F.lower(squeeze(F.coalesce(c, F.lit("")))))


def norm_fingerprint(c: Column) -> Column:
    """Form hashed into fingerprints.

    The company form goes before the brackets do, so a bracketed prefix keeps
    the form that follows it.
    """
    bare = F.regexp_replace(norm_match(c), f"^{COMPANY_FORM} ?| ?{COMPANY_FORM}$", "")
    return F.trim(F.translate(bare, BRACKETS, ""))


def fingerprint(title: Column, company: Column, board: Column) -> Column:
    """Hash of what identifies a posting; null without a board."""
    bar = F.lit("|")
    key = F.concat(norm_fingerprint(title), bar, norm_fingerprint(company), bar, strip(F.lower(board)))
    return F.left(F.sha2(key, 256), F.lit(16))


def text_lines(c: Column) -> Column:
    """Newline-separated text as an array of trimmed, non-empty lines."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip)
    return F.filter(lines, lambda x: x != "")


def _first(lines: Column, rule) -> Column:
    return F.get(F.filter(lines, rule), 0)


def pick_company(lines: Column) -> Column:
    def usable(x):
        noise = (
            (F.length(x) < 3) | x.isin(BADGES)
            | x.rlike(r"^\p{Nd}+人?$") | x.rlike(r"^\p{Nd}{4}年")
        )
        return ~noise & (F.contains(x, F.lit(COMPANY_WORD)) | (F.length(x) > 5))

    return F.coalesce(_first(F.slice(lines, 1, 5), usable), F.get(lines, 0))


def longest_line(lines: Column) -> Column:
    """Longest line, the first one on a tie."""
    ranked = F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.array_max(ranked)["x"]


def pick_title(lines: Column) -> Column:
    wanted = _first(lines, lambda x: (F.length(x) >= 15) & contains_any(x, TITLE_WORDS))
    return F.coalesce(wanted, longest_line(lines))


def pick_location(lines: Column) -> Column:
    return _first(lines, lambda x: (F.length(x) < 50) & contains_any(x, LOCATION_MARKS))


def pick_salary(lines: Column) -> Column:
    return _first(lines, lambda x: contains_any(x, SALARY_MARKS))


def title_strip_company(title: Column, company: Column) -> Column:
    """Link text without the company name it starts with."""
    cut = strip(F.substring(title, F.length(company) + 1, F.length(title)))
    return F.when((F.length(company) > 0) & F.startswith(title, company), cut).otherwise(title)
