"""Exact top-k search by inner product over an impact-ordered index.

Vectors are quantised to integers and dealt into shards.  A shard's index holds
for each dimension its postings, rows with their impacts (the components), in
descending order of impact and cut into segments of one impact level.  A query
takes segments score at a time over all dimensions: those that can add most
first, which are a dimension's highest impacts for a positive component of the
query and its lowest for a negative one.  Sums are exact integers.  A search
stops only on proof: what a vector's untaken postings can still add is at most
the bound of the next segment for each of them, and when few vectors can reach
the k-th best score, those are rescored exactly.  Nothing is approximate; the
bound decides only how many postings are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector or a component is null or not finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.when(finite, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


#: Impact levels that the range of a shard's components is cut into, at most.
LEVELS = 64
#: Shares of its shard's postings after which a search looks for proof.
STEPS = (0.4, 0.5, 0.58, 0.66, 0.74, 0.82, 0.9)


def build_index(vectors: DataFrame, scale: int = 256, shard_rows: int = 8192) -> DataFrame:
    """Index rows (shard, n, dims, width, ids, impacts, postings) of ``vectors`` (vec_id, embedding).

    ``impacts`` holds the shard's integer vectors by row in ``width`` bytes each,
    ``postings`` the rows of each dimension by descending impact.  Shards hold
    about ``shard_rows`` vectors whatever the number of rows, repeated ones
    included.  Vectors that are null or hold null or non-finite components, and
    rows without a vec_id, are left out.  Shorter vectors count as zero in the
    dimensions they lack.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()), "quantised")
    shards = max(1, -(-rows.count() // shard_rows))
    # Rows are dealt by the number they were written with, so copies spread like others.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    packed = dealt.groupBy("shard").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                part = batch["rows"][k].values
                ids, impacts = part.field("vec_id").to_numpy(), _matrix(part.field("v"))
                width = next(w for w in (2, 4, 8) if w == 8 or np.abs(impacts).max(initial=0) < 1 << (8 * w - 1))
                postings = np.argsort(-impacts, axis=0, kind="stable").T.astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["shard"][k : k + 1], pa.array([len(ids)], pa.int32()), pa.array([impacts.shape[1]], pa.int32()), pa.array([width], pa.int32()),
                        pa.array([ids.astype("<i8").tobytes()]), pa.array([impacts.astype(f"<i{width}").tobytes()]), pa.array([postings.tobytes()]),
                    ],
                    ["shard", "n", "dims", "width", "ids", "impacts", "postings"],
                )

    return packed.mapInArrow(build, "shard int, n int, dims int, width int, ids binary, impacts binary, postings binary")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list array, the shorter ones filled with zeros."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), max(1, int(size.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy()
    return out


class Shard:
    """One shard's index, ready for queries; ``read`` counts the postings that they took."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray, postings: np.ndarray | None = None):
        self.ids, self.impacts = ids, impacts
        # By dimension, one after another in memory.
        self.postings = np.ascontiguousarray(np.argsort(-impacts, axis=0, kind="stable").T if postings is None else postings, dtype=np.intp)
        n, dims = impacts.shape
        sorted_ = np.ascontiguousarray(np.take_along_axis(impacts.T, self.postings, axis=1))
        low, high = int(impacts.min(initial=0)), int(impacts.max(initial=0))
        shift = max(0, (high - low).bit_length() - (LEVELS - 1).bit_length())
        # Levels from the highest impacts down; a segment is (dimension, level), its postings lie between two cuts.
        level = (high >> shift) - (sorted_ >> shift)
        self.levels = (high >> shift) - (low >> shift) + 1
        self.cuts = np.array([np.searchsorted(level[d], np.arange(self.levels + 1)) for d in range(dims)])
        self.sizes = np.diff(self.cuts, axis=1)
        self.highest = np.array([((high >> shift) - k + 1 << shift) - 1 for k in range(self.levels)], dtype=np.int64)
        self.lowest = np.array([(high >> shift) - k << shift for k in range(self.levels)], dtype=np.int64)
        self.largest = max(abs(low), abs(high))
        # A posting adds its product to the upper digits of a sum and one to the lower, which count postings.
        self.unit = 1 << dims.bit_length()
        self.products = sorted_.astype(np.float64) * self.unit
        self.exact = impacts.astype(np.float64)
        # What one step of a search takes.
        self.rows, self.gains = np.empty(n * dims, dtype=np.intp), np.empty(n * dims)
        self.read = 0

    def top(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k best (ids, scores) other than its ``own`` id: larger score first, then smaller id."""
        n, dims = self.impacts.shape
        q = np.zeros((len(queries), dims), dtype=np.int64)
        shared = min(dims, queries.shape[1])
        q[:, :shared] = queries[:, :shared]
        return [self._best(self._possible(x, o, k), x, o, k) for x, o in zip(q, own)]

    def _best(self, rows: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.ids[rows] != own]
        exact = self._scores(rows, query)
        best = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows][best], exact[best]

    def _fits(self, query: np.ndarray) -> bool:
        """Whether sums of products with their counts are exact as floats."""
        return self.largest * int(np.abs(query).max(initial=0)) * len(query) * self.unit < 2**52

    def _scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self._fits(query):
            return (self.exact[rows] @ query.astype(np.float64)).astype(np.int64)
        return self.impacts[rows].astype(np.int64) @ query

    def _possible(self, query: np.ndarray, own: int, k: int) -> np.ndarray:
        """Rows that may be among the k best, which are few, or all rows where no proof is found."""
        n, dims = self.impacts.shape
        few = max(4 * k + 1, n // 8)
        if n <= few or not self._fits(query):
            return np.arange(n)
        asked = np.nonzero(query)[0]  # in other dimensions a posting adds nothing
        q = query[asked, None]
        bound = np.where(q > 0, q * self.highest, q * self.lowest)
        cuts, up = self.cuts[asked], query[asked] > 0
        order = np.argsort(-bound, axis=None, kind="stable")
        share = np.cumsum(self.sizes[asked].ravel()[order]) / (n * max(1, len(asked)))
        rows, gains = self.rows, self.gains
        total = np.zeros(n)
        # Within a dimension a query takes levels from the side on which they add most: from the front, or from the back.
        at = np.where(up, 0, n)
        for step in STEPS:
            end = int(np.searchsorted(share, step))
            if end >= len(order):
                break
            least = bound.ravel()[order[end]]
            levels = (bound >= least).sum(axis=1)
            upto = np.where(up, np.take_along_axis(cuts, levels[:, None], 1)[:, 0], np.take_along_axis(cuts, self.levels - levels[:, None], 1)[:, 0])
            size = 0
            for d, a, b, weight in zip(asked.tolist(), np.minimum(at, upto).tolist(), np.maximum(at, upto).tolist(), q[:, 0].tolist()):
                if a < b:
                    to = slice(size, size + b - a)
                    rows[to] = self.postings[d, a:b]
                    np.multiply(self.products[d, a:b], weight, out=gains[to])
                    size += b - a
            at = upto
            gains[:size] += 1
            total += np.bincount(rows[:size], weights=gains[:size], minlength=n)
            self.read += size
            untaken = bound[bound < least]
            if not len(untaken):
                break
            taken = np.mod(total, self.unit)
            score = (total - taken) / self.unit
            # Proof: a vector gains at most the bound of the next segment from each posting that it has not been met in.
            reach = score + (len(asked) - taken) * float(untaken.max())
            lead = np.argpartition(score, n - 4 * k - 1)[n - 4 * k - 1 :]
            lead = lead[self.ids[lead] != own]
            if len(lead) < k:
                continue
            exact = self._scores(lead, query)
            found = np.nonzero(reach >= np.partition(exact, len(exact) - k)[len(exact) - k])[0]
            if len(found) <= few:
                return found
        return np.arange(n)


def search(index: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block: int = 256, together: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``index`` for each query (vec_id, embedding).

    Rows with the query's own vec_id don't compete.  Ties go to the smaller
    vec_id; a vec_id on several rows takes a rank for each.  A vec_id given by
    several queries asks once, by its smallest vector.  Queries that are null or
    hold null or non-finite components ask nothing; an empty table gives no rows.

    Queries, the smaller side, are dealt into blocks and brought to the shards:
    ``together`` blocks meet a shard in one group, so that a shard moves once
    for each of these groups and is prepared once.  Memory is bounded by a block
    and a shard.
    """
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), quantised(F.col("embedding"), scale).alias("q"))
    asked = asked.where(F.col("query_id").isNotNull() & F.col("q").isNotNull()).groupBy("query_id").agg(F.min("q").alias("q"))
    asked = written(asked, "queries")
    blocks = max(1, -(-asked.count() // block))
    index = written(index, "impact-index")
    packed = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list(F.struct("query_id", "q")).alias("queries"))
    # A group of blocks at a shard: its index comes first, the blocks follow.
    none = F.lit(None).cast("binary")
    groups = -(-blocks // together)
    unasked = F.lit(None).cast(packed.schema["queries"].dataType)
    shards = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(-1).alias("block"), "n", "width", "ids", "impacts", "postings", unasked.alias("queries"))
    last = index.agg(F.max("shard")).first()[0] or 0
    at = packed.select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"), F.floor(F.col("block") / together).cast("int").alias("part"), "block", F.lit(0).alias("n"), F.lit(0).alias("width"), none.alias("ids"), none.alias("impacts"), none.alias("postings"), "queries")
    rows = shards.unionByName(at).repartition("shard", "part").sortWithinPartitions("shard", "part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, -1
        for batch in batches:
            for r in range(len(batch)):
                number = batch["shard"][r].as_py()
                if batch["block"][r].as_py() < 0:
                    held = number
                    n, width = batch["n"][r].as_py(), batch["width"][r].as_py()
                    load = lambda c, t, r=r, batch=batch: np.frombuffer(batch[c][r].as_buffer(), dtype=t)
                    shard = Shard(load("ids", "<i8"), load("impacts", f"<i{width}").reshape(n, -1).astype(np.int64), load("postings", "<i4").reshape(-1, n))
                    continue
                if number != held:  # a shard that no row was dealt to
                    continue
                part = batch["queries"][r].values
                own = part.field("query_id").to_numpy()
                out = shard.top(own, _matrix(part.field("q")), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(own, [len(o[0]) for o in out])),
                        pa.array(np.concatenate([o[0] for o in out]).astype(np.int64)),
                        pa.array(np.concatenate([o[1] for o in out]).astype(np.int64)),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    found = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(embeddings: DataFrame) -> DataFrame:
    index = build_index(embeddings.select("vec_id", "embedding"))
    return search(index, embeddings.where(F.col("vec_id") % 50 == 0).select("vec_id", "embedding"))


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum([q.e[i] * c.e[i] FOR i IN range(1, least(len(q.e), len(c.e)) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
