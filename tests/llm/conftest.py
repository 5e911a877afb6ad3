import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names the operators use inside
    T.StructField("id", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("shard", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("run", T.StringType()), T.StructField("hash", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("size", T.StringType()), T.StructField("fp", T.StringType()),
    T.StructField("n", T.StringType()), T.StructField("copies", T.StringType()), T.StructField("pos", T.StringType()),
    T.StructField("rejected", T.StringType()), T.StructField("bucket", T.StringType()),
])

LONG = " ".join(f"Word{i % 977} alpha{i % 13}" for i in range(60_000)) + "\nA shared closing line\n"


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, hot copies."""
    texts = [
        None, "", " \n\t ", "Hello World, hello lines.\nA shared closing line\nshort", "hello world, HELLO lines.\nA shared closing line\nshort",
        LONG, LONG.upper(), "É été naïve ÀÉ", "x" * 5000, "A shared closing line\n a SHARED closing line\t\n\nend", "12 34 *** !!", "<|endoftext|> it's",
        "日本語 текст Ω ﬁ", "A shared closing line",
    ]
    out = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "é"][i % 4]) for i, t in enumerate(texts)]
    out += [(100 + i, "One text that very many documents hold, word for word.", "en", "b") for i in range(60)]
    out += [(3, texts[3], "en", "b"), (3, texts[3], "en", "b"), (None, texts[3], None, None), (None, None, None, None)]
    return [(*r, None, *["x", 7, *["clash"] * 12][: len(DOCS) - 5]) for r in out]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """The awkward rows as a table."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), DOCS).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nothing") / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)
