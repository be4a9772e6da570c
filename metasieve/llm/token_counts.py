"""Token counts through a digest cache.

A text is named by the SHA-256 of its normalised content, a tokenizer by a
version digest. Counts are looked up by both; only distinct texts that the cache
lacks are encoded, and their counts are appended to it.

Normalisation here is what cannot change a count: a null text is the empty one.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, discard, fresh_path, stored, texts_to_python, trimmed
from .text_codec import ChunkCoder

CACHE_SCHEMA = "digest binary, tokenizer binary, n_tokens long"


def tokenizer_version(path: str) -> bytes:
    """SHA-256 of the vocabulary file and of the library's version."""
    import sentencepiece
    import tokenizers

    library = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    h = hashlib.sha256(f"{os.path.basename(path)}\0{library}\0".encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.digest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``; an absent one is empty."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _encoder(path: str, version: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = ChunkCoder(path, ids=False)
        for b in batches:
            counts = pa.array(list(c.encode(b.column(1).to_pylist())), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * b.num_rows, pa.binary()), counts], names=["digest", "tokenizer", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, as the tokenizer's library gives them.

    Returns ``id_col, n_bytes long, digest binary, n_tokens long``: one row per
    input row, also for null and repeated ids. A null text counts as the empty
    one: 0 bytes, 0 tokens. Other columns of ``docs`` are not read. An empty
    table gives an empty one. ``tokenizer_path`` must be readable on all
    machines; without ``cache_path`` a new cache is made in the shared folder.

    Misses are picked by (digest, id), so a text that fills a third of the table
    is encoded once and its rows are never gathered in one task. Where the misses
    number ``MOST_BROADCAST`` at most, as with a warm cache, they are sent to the
    texts and no text is shuffled.
    """
    spark = docs.sparkSession
    texts_to_python(spark)
    cache_path = cache_path or fresh_path(spark, "token-counts")
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    digest = F.unhex(F.sha2(F.col("text"), 256)).alias("digest")

    keyed = stored(source.select("id", digest, F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    have = read_cache(spark, cache_path).filter(F.col("tokenizer") == F.lit(version)).select("digest")
    chosen = stored(keyed.groupBy("digest").agg(F.min("id").alias("id")).join(have, "digest", "left_anti"), "misses")
    texts = source.select("id", "text", digest).alias("t")
    misses = texts.join(
        broadcast_if_small(chosen).alias("c"),
        (F.col("t.digest") == F.col("c.digest")) & F.col("t.id").eqNullSafe(F.col("c.id")),
        "left_semi",
    ).select("digest", "text")
    misses.mapInArrow(trimmed(_encoder(tokenizer_path, version)), CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    # written first, so that the join below is one that adaptive execution can split at a hot digest
    counts = read_cache(spark, cache_path).filter(F.col("tokenizer") == F.lit(version)).join(keyed.select("digest").distinct(), "digest", "left_semi")
    counts = stored(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    discard(chosen)
    return keyed.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "digest", "n_tokens")
