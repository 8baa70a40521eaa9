"""Benchmark decontamination.

The windows of the benchmark items are normalised and hashed into a set that is
broadcast; every training text is scanned window by window against it, hash
hits are verified word by word, and spans or whole documents can be removed.
The broadcast is bounded by ``max_words``: a larger benchmark is cut into
slices of at most that many words, and the documents are scanned once a slice,
one after another, so that neither the driver nor a worker ever holds two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, unused, written

#: Words are runs of these bytes after A-Z are lower-cased; others separate.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULTIPLIER = 0x9E3779B97F4A7C15


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 ``text``: lower-case runs of ASCII letters, digits and everything beyond ASCII."""
    return text.translate(TABLE).split()


class Windows:
    """The windows of some items, with a hash filter in front of the exact table."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], tuple[int, ...]] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            n = min(width, len(ids))
            for k in range(len(ids) - n + 1) if n else ():
                found.setdefault(tuple(ids[k : k + n]), set()).add(item)
        self.owners = {k: tuple(sorted(v)) for k, v in found.items()}
        self.filters: dict[int, np.ndarray] = {}
        for n in sorted({len(k) for k in self.owners}):
            keys = np.array([k for k in self.owners if len(k) == n], dtype=np.uint64)
            # At least sixteen places a window, so that few of those that occur nowhere pass.
            size = max(20, (16 * len(keys)).bit_length())
            bits = np.zeros(1 << size, dtype=bool)
            bits[self._hash(keys.T, n) >> np.uint64(64 - size)] = True
            self.filters[n] = bits

    @staticmethod
    def _hash(parts, n: int) -> np.ndarray:
        total = np.zeros(len(parts[0]), dtype=np.uint64)
        for k in range(n):
            total = (total ^ parts[k]) * np.uint64(_MULTIPLIER)
            total ^= total >> np.uint64(29)
        return total * np.uint64(_MULTIPLIER)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, tuple[int, ...]]]]:
        """Number of words, and each verified occurrence as (start, width, item ids)."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        hits = []
        for n, bits in self.filters.items():
            m = len(ids) - n + 1
            if m <= 0:
                continue
            # A window that holds a word of no item can't occur; look at whole runs of known words only.
            known = np.concatenate(([0], np.cumsum(ids != 0)))
            at = np.nonzero(known[n:] - known[:-n] == n)[0]
            if not len(at):
                continue
            at = at[bits[self._hash([ids[at + k] for k in range(n)], n) >> np.uint64(65 - len(bits).bit_length())]]
            for p in at.tolist():
                owners = self.owners.get(tuple(ids[p : p + n].tolist()))
                if owners:
                    hits.append((p, n, owners))
        return len(words), hits


def _slices(benchmark: DataFrame, max_words: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in slices of ``max_words`` words (a longer item is a slice of its own)."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    part, size = [], 0
    for row in items.orderBy("item_id").toLocalIterator():
        n = len(words_of(bytes(row.text)))
        if part and size + n > max_words:
            yield part
            part, size = [], 0
        part.append((row.item_id, bytes(row.text)))
        size += n
    yield part


_FOUND = "array<struct<start:int,end:int>>"


def _scanned(rows: DataFrame, part: list[tuple[int, bytes]], width: int, kept: list[str]) -> DataFrame:
    """Columns ``kept`` of ``rows`` with n_words, spans and items of one slice's windows; ``text`` may be among them."""
    shared = rows.sparkSession.sparkContext.broadcast((part, width))
    content = unused([*kept, "n_words", "spans", "items"], "content")[0]
    narrow = rows.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("binary").alias(content))
    schema = narrow.drop(content).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(_FOUND), "items": F.array().cast("array<bigint>")}).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(*shared.value)
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in byte_rows(batch.column(len(kept))):
                n, hits = windows.scan(text)
                n_words.append(n)
                spans.append(merged([(p, p + w) for p, w, _ in hits]))
                items.append(sorted({i for h in hits for i in h[2]}))
            new = [
                pa.array(n_words, pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array(items, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], [*kept, "n_words", "spans", "items"])

    return narrow.mapInArrow(scan, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 8, max_words: int = 500_000) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` and ``items`` of benchmark windows.

    ``spans`` holds [start, end) word positions that some occurrence covers,
    merged and sorted; ``items`` the sorted ids of items with an occurring
    window.  An item of fewer than ``width`` words, but not none, is one window.
    Null or empty text has no words, spans or items; repeated rows and rows
    whose ``doc_id`` is null are each scanned; an empty benchmark finds nothing;
    an item whose id is null is ignored.  Columns named ``n_words``, ``spans``
    or ``items`` are replaced.
    """
    base = docs.drop("n_words", "spans", "items")
    slices = _slices(benchmark, max_words)
    part, following = next(slices), next(slices, None)
    if following is None:
        return _scanned(base, part, width, base.columns)

    # Rows are numbered in a written table; of each slice only rows with hits are kept, then put together by row.
    row = unused([*base.columns, "n_words", "spans", "items"], "row")[0]
    numbered = written(base.withColumn(row, F.monotonically_increasing_id()), "numbered")
    first = found = None
    while part is not None:
        scanned = _scanned(numbered, part, width, base.columns + [row] if first is None else [row])
        scanned = written(scanned if first is None else scanned.where(F.size("items") > 0), "contamination")
        first = scanned if first is None else first
        hits = scanned.where(F.size("items") > 0).select(row, "spans", "items")
        found = hits if found is None else found.unionByName(hits)
        part, following = following, next(slices, None)
    lists = found.groupBy(F.col(row)).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))

    def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in one])] for one in batch["spans"].to_pylist()]
            items = [sorted(set(one)) for one in batch["items"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, batch["spans"].type), pa.array(items, pa.list_(pa.int64()))], batch.schema.names)

    lists = lists.mapInArrow(join_spans, lists.schema)
    out = first.drop("spans", "items").join(lists, row, "left")
    empty = F.array()
    return out.select(*[F.col(f"`{c}`") for c in base.columns], "n_words", F.coalesce("spans", empty.cast(_FOUND)).alias("spans"), F.coalesce("items", empty.cast("array<bigint>")).alias("items"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_documents(docs: DataFrame, benchmark: DataFrame, min_items: int = 1, **options) -> DataFrame:
    """The rows of ``docs`` in which fewer than ``min_items`` items occur; ``docs``' own columns."""
    found = find_contamination(docs, benchmark, **options)
    return found.where(F.size("items") < min_items).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], width: int = 8) -> list[tuple]:
    """The same digest columns by plain loops, for tests."""
    import re

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for doc_id, text in docs:
        w, hit, got = split(text), set(), set()
        for item, t in items:
            q = split(t)
            n = min(width, len(q))
            windows = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
            for p in range(len(w)):
                if n and tuple(w[p : p + n]) in windows:
                    got.add(item)
                    hit.update(range(p, p + n))
        joined = ",".join(sorted(map(str, got)))
        out.append((doc_id, len(w), len(hit), len(got), hashlib.sha256(joined.encode()).hexdigest(), len(got) >= 2))
    return out


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(list_slice(w, k, k + least(8, len(w)) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, widths WHERE len(w) >= n)),
hits AS (SELECT dw.rid, dw.k, dw.n, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hits) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(its.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
