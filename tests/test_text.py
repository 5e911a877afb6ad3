import hashlib
import random

from pyspark.sql import functions as F

from postloom.functions import text as tx


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("o")).first()["o"]


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_norm_fingerprint_order_of_steps(spark):
    got = column(spark, [
        "株式会社 Foo", "Foo　株式会社", "【株式会社 A】B", "  A\t\n B ", None, "", "（株）テスト", "株式会社",
    ], tx.norm_fingerprint)
    # a bracketed prefix is not at the start when the company form is dropped
    assert got == ["foo", "foo", "株式会社 ab", "a b", "", "", "株テスト", ""]


def test_fingerprint_is_hash_of_joined_forms(spark):
    rows = spark.createDataFrame([("T", "株式会社 C", " Doda ")], "t string, c string, b string")
    got = rows.select(tx.fingerprint(F.col("t"), F.col("c"), F.col("b"))).first()[0]
    assert got == hashlib.sha256("t|c|doda".encode()).hexdigest()[:16]


def test_fingerprint_ignores_case_space_and_brackets(spark):
    variants = ["Senior Dev", " senior  dev ", "【Senior】 Dev", "SENIOR　DEV"]
    got = column(spark, variants, lambda c: tx.fingerprint(c, F.lit("x"), F.lit("b")))
    assert len(set(got)) == 1


def test_whitespace_agrees_with_python(spark):
    rng = random.Random(3)
    alphabet = "ab " + tx.SPACES
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(300)]
    assert column(spark, values, tx.norm_match) == [" ".join(v.lower().split()) for v in values]


def test_every_python_space_is_covered():
    assert set(tx.SPACES) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_text_lines(spark):
    assert one(spark, " a \n\n　b　\n", tx.text_lines) == ["a", "b"]
    assert one(spark, None, tx.text_lines) == []


def lines(spark, value, build):
    return one(spark, value, build, "array<string>")


def test_pick_company(spark):
    assert lines(spark, ["New", "PR", "120人", "株式会社X"], tx.pick_company) == "株式会社X"
    assert lines(spark, ["1998年設立です", "ab", "abcdef"], tx.pick_company) == "abcdef"
    assert lines(spark, ["New", "ab", "abc", "12人", "急募", "株式会社late"], tx.pick_company) == "New"
    assert lines(spark, [], tx.pick_company) is None


def test_pick_title_and_longest_line(spark):
    assert lines(spark, ["x" * 30, "シニアエンジニアを広く募集しています"], tx.pick_title) == "シニアエンジニアを広く募集しています"
    assert lines(spark, ["short募集", "aaaa", "bbbbbbbb", "cccccccc"], tx.pick_title) == "bbbbbbbb"
    assert lines(spark, ["bb", "aa", "c"], tx.longest_line) == "bb"


def test_pick_location_and_salary(spark):
    assert lines(spark, ["x" * 50 + "都", "東京都"], tx.pick_location) == "東京都"
    assert lines(spark, ["abc", "年400万〜"], tx.pick_salary) == "年400万〜"
    assert lines(spark, ["abc"], tx.pick_salary) is None
