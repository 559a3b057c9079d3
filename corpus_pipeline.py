"""A corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of documents, and extra ones of any name. Between stages rows are written as
Parquet and read again. An empty table stays empty in every stage, long texts are taken
whole, and results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchlake.llm import bpe, decontam, minhash, pii, quality
from pitchlake.llm.common import stored, table, tuned


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go.

    Null and empty texts are judged by a feature of their own, null metadata by slots and
    rates of its own; repeated rows are judged alike, equal scores at the threshold stay.
    Without labels of both classes nothing is rejected, unless all labels are bad.
    """
    tuned(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8) stays: that of the smallest id.

    Null and empty texts are near nothing and stay, as rows without an id do. Rows that
    repeat an id and its text count once; unlike texts of one id are documents of their own.
    """
    tuned(spark)
    return minhash.keep_one(docs, percent=80)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts, null items and an empty benchmark match nothing; rows without
    an id and repeated rows are judged by their text alone.
    """
    tuned(spark)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars is counted anew.

    Null texts stay null, empty ones empty; of spans that overlap the first by start, then
    kind, names what stands for all of them. All rows stay.
    """
    tuned(spark)
    return pii.mask(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text.

    One row per row: null and empty texts have no tokens; repeated rows and ids stay.
    """
    tuned(spark)
    return bpe.encode(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("minhash_near_dedup", one_of_each),
    ("benchmark_decontamination", without_benchmarks),
    ("pii", masked),
    ("bpe", encoded),
]

#: Trained classifiers and similarity searches aren't SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
