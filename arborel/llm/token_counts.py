"""Token counts through a digest cache.

A count is stored under the digest of the content and the digest of the
tokenizer file, its version.  Documents are joined to the stored counts, only
distinct contents that miss are encoded, and their counts are appended to the
cache, so a copy or a second run costs a join instead of an encoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, unused
from .encoding import encoder, tokenizer_path, version_digest

CACHE = "digest binary, version string, n_tokens long"


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; a cache that doesn't exist yet is empty."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE)
    # Two runs may have appended the same digest; their counts are equal.
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


#: Parts that the rows of one digest are dealt into when counts are joined back.
SALTS = 4


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` of ``text``; new counts are appended to ``cache``.

    Null text counts as empty text: zero bytes and zero tokens.  Repeated rows
    are each returned.  ``doc_id`` may be null or repeated.  Columns named
    ``n_bytes`` or ``n_tokens`` are replaced, all others pass through.

    Contents are folded by digest on the map side first, so a content that a
    third of all rows hold costs each task one row, whatever their ids.
    """
    spark = docs.sparkSession
    version = version_digest(tokenizer)
    base = docs.drop("n_bytes", "n_tokens")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # 256 bits of the exact content; normalising further would change counts.
    digest = F.unhex(F.sha2(text.cast("binary"), 256))

    known = read_cache(spark, cache, version)
    distinct = base.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                n = enc.counts(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["digest"], pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    misses.select("digest", "text").mapInArrow(encode, CACHE).write.mode("append").parquet(cache)

    key, salt, found = unused([*base.columns, "n_bytes", "n_tokens"], "key", "salt", "found")
    counts = read_cache(spark, cache, version).select(F.col("digest").alias(key), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt), F.col("n_tokens").alias(found))
    rows = base.withColumns({"n_bytes": F.octet_length(text).cast("long"), key: digest, salt: F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})
    out = rows.join(counts, [key, salt], "left")
    return out.select(*[F.col(f"`{c}`") for c in base.columns], "n_bytes", F.col(found).alias("n_tokens"))


def op6_token_counts(docs: DataFrame, limit: int = 1024) -> DataFrame:
    spark = docs.sparkSession
    path = tokenizer_path("byte_bpe_50k.json")
    narrow = docs.select("doc_id", "text")
    out = count_tokens(narrow, path, new_path(spark, "token-counts"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
