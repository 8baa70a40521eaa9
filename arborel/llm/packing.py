"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces no longer than the largest length, and pieces are
packed in descending order of size, each into the open bin that it fills best.
Where none fits, a bin is opened.  Which sizes to open is optimised jointly:
for each permitted length as the size to open, and for the mix that opens the
least-cost length that holds the piece, a packing is made, every bin is downsized
to the shortest length that holds its contents, and the packing of the least
total cost is taken.  Pieces are dealt into groups of bounded size by a hash, so
packing needs one shuffle of (id, length) rows and no order over all rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .encoding import encoder, tokenizer_path

CAPACITIES = (512, 1024, 2048, 4096)
#: A sequence costs its length and, for its own overhead, this many tokens more.
OVERHEAD = 64


def token_lengths(docs: DataFrame, tokenizer: str, end_tokens: int = 1, cache_words: int = 600_000) -> DataFrame:
    """(doc_id, n_tokens) of every row's whole text, with ``end_tokens`` for the end of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, cache_words)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                n = [x + end_tokens for x in enc.counts(part["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def best_fit(sizes: Sequence[int], open_size: int, capacities: Sequence[int]) -> list[list[int]]:
    """Indices of ``sizes`` by bin: descending best fit, opening bins of ``open_size`` or the least that holds the piece."""
    bins: list[list[int]] = []
    free: list[int] = []  # free space of open bins, distinct and ascending
    by_free: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        at = bisect.bisect_left(free, size)
        if at < len(free):
            space = free[at]
            b = by_free[space].pop()
            if not by_free[space]:
                del by_free[space], free[at]
            bins[b].append(i)
        else:
            space = open_size if size <= open_size else next(c for c in capacities if c >= size)
            b = len(bins)
            bins.append([i])
        rest = space - size
        if rest:
            if rest not in by_free:
                bisect.insort(free, rest)
                by_free[rest] = []
            by_free[rest].append(b)
    return bins


def pack_group(sizes: Sequence[int], capacities: Sequence[int], overhead: int) -> list[tuple[int, list[int]]]:
    """(length, indices) of each bin of the cheapest packing found, every bin downsized to its contents."""
    best: tuple[int, list[tuple[int, list[int]]]] | None = None
    for open_size in [*sorted(capacities, key=lambda c: (c + overhead) / c), 0]:
        bins = []
        for b in best_fit(sizes, open_size, capacities):
            used = sum(sizes[i] for i in b)
            bins.append((next(c for c in capacities if c >= used), b))
        cost = sum(c + overhead for c, _ in bins)
        if best is None or cost < best[0]:
            best = (cost, bins)
    return best[1] if best else []


def pack(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, group: int = 20_000) -> DataFrame:
    """One row for each piece of each row of ``lengths`` (doc_id, n_tokens).

    ``bin_id`` names the sequence, ``capacity`` its length, ``bin_start`` where
    the piece stands in it, ``doc_start`` the piece's first token in its
    document, ``n_tokens`` its length.  Every token of every row is in one
    piece; no bin holds more than its capacity.  Rows of no tokens (or null)
    have one piece of length 0, in a bin of its own kind: capacity 0.  Rows that
    share a ``doc_id`` or have none are packed each for itself; an empty table
    gives no rows.  Other columns of ``lengths`` are not returned.
    """
    sizes = sorted(int(c) for c in capacities)
    most = sizes[-1]
    n = F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0))
    rows = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("_n"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest((F.col("_n") - 1), F.lit(0)), F.lit(most).cast("long"))
    rows = rows.select("doc_id", "_n", F.explode(starts).alias("doc_start"))
    rows = rows.select("doc_id", "doc_start", F.least(F.col("_n") - F.col("doc_start"), F.lit(most)).alias("n_tokens"), F.monotonically_increasing_id().alias("_row"))
    pieces = written(rows, "pieces")
    groups = max(1, -(-pieces.count() // group))
    # Pieces are dealt by the number they were written with, so equal ones spread like others and groups are of bounded size.
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int")).drop("_row")
    dealt = dealt.repartition(groups, "_g").sortWithinPartitions("_g", F.col("n_tokens").desc(), "doc_id", "doc_start")

    def one(g: int, columns: tuple[list, ...]) -> pa.RecordBatch:
        ids, at, size = columns
        out: list[tuple] = [(ids[i], g << 32 | (1 << 31), 0, 0, at[i], 0) for i in range(len(size)) if not size[i]]
        live = [i for i in range(len(size)) if size[i]]
        for b, (capacity, members) in enumerate(pack_group([size[i] for i in live], sizes, overhead)):
            start = 0
            for m in members:
                i = live[m]
                out.append((ids[i], g << 32 | b, capacity, start, at[i], size[i]))
                start += size[i]
        names = ["doc_id", "bin_id", "capacity", "bin_start", "doc_start", "n_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for batch in batches:
            rows = zip(batch["_g"].to_pylist(), *(batch[c].to_pylist() for c in ("doc_id", "doc_start", "n_tokens")))
            for g, *values in rows:
                if g != now and held[0]:
                    yield one(now, held)
                    held = ([], [], [])
                now = g
                for column, v in zip(held, values):
                    column.append(v)
        if held[0]:
            yield one(now, held)

    return dealt.mapInArrow(run, "doc_id long, bin_id long, capacity int, bin_start int, doc_start long, n_tokens long")


def op10_best_fit_packing(docs: DataFrame) -> DataFrame:
    return pack(token_lengths(docs, tokenizer_path("byte_bpe_50k.json")))
