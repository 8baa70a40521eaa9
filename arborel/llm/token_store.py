"""Token ids as Parquet list columns.

The files hold, in ascending ``doc_id`` order, each document's ids with the
metadata that finds them again.  Row groups and pages have controlled sizes, ids
are dictionary-encoded where that pays and delta-encoded otherwise (Parquet
version 2 pages), and page indexes let a reader that wants a few documents or
only the metadata skip the rest.  Texts are shuffled once, by range of
``doc_id``; offsets come from sums by part, so no task sees the whole order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path
from .encoding import encoder, tokenizer_path

#: Written in this order; ``part`` numbers the ranges of doc_id, ``seq`` the rows within one.
SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("doc_id", T.LongType(), True),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
    ]
)


def _lists(values: list[bytes]) -> pa.Array:
    offsets, n = [0], 0
    for v in values:
        n += len(v) // 4
        offsets.append(n)
    flat = pa.Array.from_buffers(pa.int32(), n, [None, pa.py_buffer(b"".join(values))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = 2,
    parts: int | None = None,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    text_bytes: int = 4 << 20,
    cache_words: int = 700_000,
) -> None:
    """Encode ``text`` of every row of ``docs`` and write the files to ``path``.

    Rows are written in ascending ``doc_id`` order (null first; rows that share
    an id in the order of their texts).  Null text is encoded as empty text, so
    a document has at least ``end_id``.  An empty table gives files without
    rows.  Other columns are not written.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seq = encoder(tokenizer, cache_words), 0
        for batch in batches:
            texts, start = batch["text"], 0
            while start < len(texts):  # whole texts, a bounded number of bytes at a time
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < text_bytes):
                    size += len(texts[stop].as_buffer())
                    stop += 1
                ids = [b + end for b in enc.encode(texts[start:stop].to_pylist())]
                n = stop - start
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["part"][start:stop],
                        pa.array(range(seq, seq + n), pa.int64()),
                        batch["doc_id"][start:stop],
                        pa.array([len(b) // 4 for b in ids], pa.int64()),
                        _lists(ids),
                    ],
                    ["part", "seq", "doc_id", "n_tokens", "ids"],
                )
                seq += n
                start = stop

    (
        rows.mapInArrow(encode, SCHEMA)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`write_tokens` with ``start``, the number of ids of all documents before each.

    Only the columns that a query uses are read; a filter on ``doc_id`` skips
    row groups and pages.  One range of ids meets in a task, never all rows.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    place = rows.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_before"))
    return rows.join(place, ["part", "seq"]).join(_bases(rows), "part").withColumn("start", F.col("_before") + F.col("_base")).drop("_before", "_base")


def _bases(rows: DataFrame) -> DataFrame:
    """For each part the ids of all parts before; one row a part, of which there are as many as were asked for."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_base"))


def checksums(rows: DataFrame) -> DataFrame:
    """CRC-32 of each row's ids as little-endian unsigned 32-bit integers, keyed by part and seq."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"]
            flat, offsets = memoryview(ids.values.buffers()[1] or b"").cast("B"), ids.offsets.to_pylist()
            base = ids.values.offset
            sums = [zlib.crc32(flat[4 * (base + a) : 4 * (base + b)]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch["part"], batch["seq"], batch["doc_id"], batch["n_tokens"], pa.array(sums, pa.int64())], ["part", "seq", "doc_id", "n_tokens", "ids_crc32"])

    return rows.select("part", "seq", "doc_id", "n_tokens", "ids").mapInArrow(crc, "part int, seq long, doc_id long, n_tokens long, ids_crc32 long")


def op5_token_store(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"))
    rows = spark.read.schema(SCHEMA).parquet(path)
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = checksums(rows).withColumn("_before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    out = out.join(_bases(rows), "part")
    return out.select("doc_id", (F.col("_before") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32")
