"""Operator 6: token counts through a cache keyed by content and tokenizer digests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, frugal, shared_dir, slices, texts, tuned
from .tokenizing import WordTable, load, tokenizer_file, version_digest

#: Folder of the cache within the shared folder.
DEFAULT_CACHE = "token-counts"
CACHE = "content string, tokenizer string, n_tokens long"


@lru_cache(1)
def _table(path: str) -> WordTable:
    return WordTable(path, "byte", len)


def counted(texts_df: DataFrame, path: str) -> DataFrame:
    """content, n_tokens of rows (content, text)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, library = _table(path), load(path)
        for batch in slices(batches, "text"):
            every = texts(batch.column(1))
            lists = [table.words(t) for t in every]
            table.learn(lists)
            n = [len(library.encode(t, add_special_tokens=False).ids) if w is None else sum(map(table.__getitem__, w)) for t, w in zip(every, lists, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["content", "n_tokens"])
        table.clear()

    return texts_df.select("content", "text").mapInArrow(run, "content string, n_tokens long")


def read_cache(spark: SparkSession, cache: str, digest: str) -> DataFrame:
    """Stored counts of one tokenizer version; a cache that doesn't exist yet is empty."""
    path, fs = file_system(spark, cache)
    rows = spark.read.schema(CACHE).parquet(cache) if fs.exists(path) else spark.createDataFrame([], CACHE)
    # An append that a failed job repeated leaves equal rows.
    return rows.where(F.col("tokenizer") == digest).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per input row: id, n_bytes long (UTF-8), n_tokens long.

    The content digest is the SHA-256 of the text's UTF-8 bytes, null taken as empty:
    this tokenizer normalises nothing, so any other normal form would change counts.
    Digests are joined to the cache at path cache (default: token-counts in the shared
    folder, which later runs find again); one text of each missing digest is encoded and
    its count appended; then all rows are joined to the counts. Null and empty texts
    have 0 tokens; long texts are encoded whole. Repeated rows, ties of ids and null ids
    are kept, an empty table gives no rows; columns other than these two are left out, so
    names can't clash. A digest shared by many rows is a small row on either side of an
    equi join, which adaptive execution splits; texts are shuffled once, as what they are.
    """
    spark = tuned(docs.sparkSession)
    path = tokenizer_file(tokenizer)
    digest = version_digest(path)
    cache = cache or f"{shared_dir(spark)}/{DEFAULT_CACHE}"
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = src.withColumn("content", F.sha2(F.col("text").cast("binary"), 256))
    known = read_cache(spark, cache, digest)
    # one text of each digest: the aggregate keeps it once per task before the shuffle
    misses = keyed.join(known, "content", "left_anti").groupBy("content").agg(F.first("text").alias("text"))
    counted(misses, path).withColumn("tokenizer", F.lit(digest)).select("content", "tokenizer", "n_tokens").write.mode("append").parquet(cache)
    rows = keyed.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(read_cache(spark, cache, digest), "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
