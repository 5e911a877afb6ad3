"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector over its byte n-grams, hashed to a fixed
number of cells.  Every language has several centroids, found by spherical
k-means; a text gets the language of the centroid with the largest cosine.  It
is rejected when it has no letter, or lies farther from that centroid than
``slack`` times the distance within which the share ``quantile`` of the
language's labelled texts of its length class lies (between ``min_radius`` and
``max_radius``).  Short texts lie far from every centroid, so classes by length
keep long junk out without losing short clean texts.

Centroids and distances are fitted on a bounded sample: of each language at most
``per_language`` labelled texts, and as many again of each length class, those
with the smallest hashes.  Document frequencies cover all labelled texts.
Everything else covers every document and its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import short
from postloom.session import written

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
CELLS = 1 << 13
LENGTHS = (16, 64, 256)  # characters at which the length classes of texts begin
BLOCK = 1 << 20  # bytes hashed at a time, so that one long text needs little memory


def counts(text: str) -> np.ndarray:
    """Byte 2-grams and 3-grams of the text's lower-cased words (letters only) in CELLS hashed cells."""
    data = np.frombuffer(f" {' '.join(_WORD.findall(text.lower()))} ".encode(), np.uint8)
    out = np.zeros(CELLS, np.int64)
    for at in range(0, len(data), BLOCK):
        b = data[at : at + BLOCK + 2].astype(np.uint32)
        two = (b[:-1] << 8 | b[1:])[:BLOCK]
        three = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[:BLOCK]
        for grams, salt in ((two, 0x9E3779B1), (three, 0x85EBCA77)):
            cells = (grams * np.uint32(salt)) >> np.uint32(32 - 13)
            out += np.bincount(cells, minlength=CELLS)
    return out


def weighted(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of count rows."""
    v = np.log1p(n.astype(np.float32)) * idf
    return (v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)).astype(np.float32)


def length_class(n_chars) -> int | np.ndarray:
    return np.searchsorted(LENGTHS, n_chars, side="right")


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means: unit centroids that have members."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        mine = (x @ c.T).argmax(1)
        sums = np.stack([x[mine == i].sum(0) if (mine == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c[np.unique((x @ c.T).argmax(1))].astype(np.float32)


@dataclass
class Model:
    """idf per cell; per centroid its language, unit vector and, by length class, largest accepted distance (1 - cosine)."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    radius: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [], [], []
        for text in texts:
            if not text or not self.languages or not any(map(str.isalpha, text)):
                langs.append(UNKNOWN)
                scores.append(0.0)
                rejected.append(True)
                continue
            cosines = self.centroids @ weighted(counts(text), self.idf)
            i = int(cosines.argmax())
            langs.append(self.languages[i])
            scores.append(min(1.0, max(0.0, float(cosines[i]))))
            rejected.append(bool(1 - cosines[i] > self.radius[i, length_class(len(text))]))
        return langs, scores, rejected


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, text, first in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "first"))):
            n = np.minimum(counts(text), 2**31 - 1).astype(np.int32)
            row = [pa.array([lang]), pa.array([n.tobytes()], pa.binary()), pa.array([len(text)]), pa.array([first])]
            yield pa.RecordBatch.from_arrays(row, ["lang", "counts", "n_chars", "first"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: its number of texts, and in how many of them each cell occurs."""
    df, n = np.zeros(CELLS, np.int64), 0
    for b in batches:
        for text in b.column("text"):
            df += counts(text.as_py()) > 0
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()], pa.binary())], ["n", "df"])


def _sum_frequencies(key: tuple, rows: pa.Table) -> pa.Table:
    df = np.zeros(CELLS, np.int64)
    for b in rows.column("df").to_pylist():
        df += np.frombuffer(b, np.int64)
    return pa.table({"n": [sum(rows.column("n").to_pylist())], "df": pa.array([df.tobytes()], pa.binary())})


def document_frequencies(texts: DataFrame, groups: int = 64) -> tuple[int, np.ndarray]:
    """(number of texts, texts per cell); summed in ``groups`` tasks, so the driver gets that many rows."""
    per_task = texts.select("text").mapInArrow(_frequencies, "n long, df binary")
    summed = (
        per_task.withColumn("g", F.spark_partition_id() % groups).groupBy("g")
        .applyInArrow(_sum_frequencies, "n long, df binary")
    )
    total, df = 0, np.zeros(CELLS, np.int64)
    for r in summed.toLocalIterator():
        total, df = total + r["n"], df + np.frombuffer(r["df"], np.int64)
    return total, df


def fit(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", centroids: int = 4, per_language: int = 400,
    quantile: float = 0.995, slack: float = 1.25, min_radius: float = 0.8, max_radius: float = 0.93, rounds: int = 8,
    max_languages: int = 256, seed: int = 42,
) -> Model:
    """Fit on labelled rows; rows without language, or whose text has no letter, teach nothing.

    At most ``per_language`` texts of a language, and of each of its length
    classes, are used, chosen by the hash of the text, so the sample does not
    depend on the order or layout of the rows; copies count once in it.  Of more
    than ``max_languages`` languages those with the most texts are learned, as
    the driver and the model hold one row per language, of ``centroids`` vectors
    at most.  Without usable rows every text is rejected.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = F.length("text")
    rows = rows.withColumns({
        "draw": F.xxhash64(F.lit(seed), "text"), "class": sum([(size >= n).cast("int") for n in LENGTHS], F.lit(0))})
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    learned = [r["lang"] for r in most.collect()]
    if not learned:
        return Model(np.ones(CELLS, np.float32), [], np.zeros((0, CELLS), np.float32), np.zeros((0, len(LENGTHS) + 1), np.float32))
    rows = rows.where(F.col("lang").isin(learned))
    sizes = rows.groupBy("lang", "class").agg(F.approx_count_distinct("draw").alias("n")).collect()
    # Hashes are uniform: cut a little above the wanted number first, exactly after.
    upto = [[F.lit(f"{r['class']}/{r['lang']}"), F.lit((min(1.0, 1.3 * per_language / max(r["n"], 1)) - 0.5) * 2.0**64)] for r in sizes]
    cut = F.element_at(F.create_map(*[x for pair in upto for x in pair]), F.concat_ws("/", F.col("class").cast("string"), "lang"))
    few = rows.where(F.col("draw").cast("double") <= cut).groupBy("lang", "class", "draw").agg(F.min("text").alias("text"))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("draw"))
    few = few.withColumns({"first": rank("lang") <= per_language, "ranked": rank("lang", "class")})
    sample = written(
        few.where(F.col("first") | (F.col("ranked") <= per_language)).select("lang", "text", "first")
        .mapInArrow(_cell_counts, "lang string, counts binary, n_chars long, first boolean"),
        "lang-sample",
    )
    total, df = document_frequencies(rows)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    def cluster(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["counts", "n_chars"])
        x = weighted(np.stack([np.frombuffer(c, np.int32) for c in rows["counts"]]), idf)
        c = kmeans(x[rows["first"].to_numpy()], centroids, rounds, seed)
        distance, classes = 1 - (x @ c.T).max(1), length_class(rows["n_chars"].to_numpy())
        far = [distance[classes == k] for k in range(len(LENGTHS) + 1)]
        reach = [float(np.quantile(d, quantile)) if len(d) else 1.0 for d in far]
        return pd.DataFrame({"lang": [key[0]], "centroids": [c.tobytes()], "reach": [reach]})

    per_lang = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroids binary, reach array<double>").collect()
    languages, vectors, radius = [], [np.zeros((0, CELLS), np.float32)], [np.zeros((0, len(LENGTHS) + 1), np.float32)]
    for r in sorted(per_lang, key=lambda r: r["lang"]):
        c = np.frombuffer(r["centroids"], np.float32).reshape(-1, CELLS)
        languages += [r["lang"]] * len(c)
        vectors.append(c)
        reach = np.clip(np.array(r["reach"]) * slack, min_radius, max_radius).astype(np.float32)
        radius.append(np.tile(reach, (len(c), 1)))
    return Model(idf, languages, np.concatenate(vectors), np.concatenate(radius))


def is_held_out(id_col: Column, folds: int = 5) -> Column:
    """True for one in ``folds`` documents, by crc32 of the id as text; false without id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang, score (cosine, 0 to 1), rejected.

    Null texts and texts without a letter get "und", score 0, rejected; long
    texts are counted whole, a piece at a time.  Repeated rows are answered alike; an empty table gives no rows.  The model
    travels with the plan: a few vectors per language.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches):
            langs, scores, rejected = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["id", "lang", "score", "rejected"],
            )

    return base.mapInArrow(run, f"id {kind}, lang string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model does not reject.

    Null and empty texts go, as texts without a letter do; repeated rows stay or
    go alike; an empty table stays empty.
    """

    @F.pandas_udf("boolean")
    def rejected(text: pd.Series) -> pd.Series:
        return pd.Series([r for at in range(0, len(text), 256) for r in model.predict(text.iloc[at : at + 256].tolist())[2]])

    return docs.where(~rejected(F.col(text_col)))


def fit_outside_fold(docs: DataFrame, id_col: str = "doc_id", **how) -> Model:
    """Fit on the rows with an id that are not held out."""
    return fit(docs.where(F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col))), **how)
