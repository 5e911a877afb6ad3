"""A training-data pipeline: every stage works on all that the stage before kept.

run(spark, sf_dir) applies STAGES to ``documents``; what a stage returns is
written as Parquet to the shared folder and read again for the next one.  The
steps a stage wrote on its way go once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postloom.llm import bpe, exact_dedup, language, mixing, simhash
from postloom.llm.queries import table, word_bpe
from postloom.session import new_folder, steps_cleared


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter or far from every centroid go.

    The classifier is fitted on the stage's own labelled documents.  Null and
    empty texts have no letter; texts are counted whole; rows that repeat are
    judged alike; null ids are left out of the fitting only.  Without a labelled
    document every document goes, so an empty table stays empty.
    """
    return language.keep_known(docs, language.fit_outside_fold(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id.

    Null counts as empty; a row without id stays only where its group has no id;
    of repeated rows one stays.  Whole texts are compared by digest, length and a
    second hash.  An empty table stays empty.
    """
    return exact_dedup.drop_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash (three words, at most 3 bits) the one with the smallest doc_id.

    Texts without a word have fingerprint zero and link like any other; a row
    without id stays only where its group has no id, and ties go by a hash of the
    whole row.  Whole texts count.  An empty table stays empty.
    """
    return simhash.one_of_each(docs, words=3, max_bits=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, none more than twice.

    A null source is a source; texts without a word have size zero; rows alike in
    id and text are taken alike, as their hash decides.  An empty table stays empty.
    """
    return mixing.mixed(docs, weights=(5, 2, 1), budget=1.5, max_passes=2.0, seed=42)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix.

    Null counts as empty and has no tokens; whole texts are encoded; a repeated
    row, or one without id, has a row of its own.  An empty table gives no rows.
    """
    return bpe.encode_decode(docs, word_bpe(), digests=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# Neither the classifier nor XXH64 fingerprints can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        with steps_cleared(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
