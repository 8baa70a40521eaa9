"""Near-duplicate detection with SimHash fingerprints and BK-trees.

A document's fingerprint has a bit set where over half of its shingles' hashes
have it set.  Fingerprints that may lie within the radius meet in shards: they
agree on one whole block of bits (with more blocks than the radius some block
must agree, so the search is exact).  Each shard is a BK-tree whose children
are keyed by their Hamming distance to the parent, and a search follows only
the edges within the radius of a node's own distance.  Trees are built where
their shard lies; nothing about all documents passes through the driver, so
there is no broadcast that grows with the data.

Copies share a fingerprint and are one node.  A shard of more than ``chunk``
nodes is dealt out as pairs of chunks.  A task returns a spanning forest of the
links it finds, so a group of k near copies costs about k rows, not k squared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, unused, written

BLOCK_BITS = 16
#: Deviations beyond the expected number of differing bits at which exact comparison still proposes a pair.
SLACK = 3.0
#: Sets of so few elements differ in a larger share of bits than the limit for large sets says: 4 against 5 in 3 of 16.
SHORT, SHORT_BITS = 6, 3 / 16
#: So many pairs of fingerprints are compared at a time.
STEP = 1 << 15
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_COLUMNS = (np.arange(8) * 256).astype(np.intp)
#: The lowest bit of each octet of a word.
_OCTETS = np.uint64(0x0101010101010101)
#: Odd multipliers of the finaliser that derives further hashes from the first.
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words of the lower-cased text, or of all of them if fewer."""
    found = text.lower().split()  # for bytes: A-Z only, and ASCII white space only
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
    n = max(1, len(found) - words + 1)
    starts = np.concatenate(([0], ends[: n - 1]))
    stops = ends[min(words, len(found)) - 1 :] - 1
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist())]), dtype=">u8")


def fingerprint(hashes: np.ndarray, seeds: int = 1) -> list[int]:
    """``seeds`` fingerprints of 64 bits, as signed integers; no shingles give zero."""
    n = len(hashes)
    if not n:
        return [0] * seeds
    if seeds == 1:
        counts = np.bincount((hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + _COLUMNS).ravel(), minlength=2048).reshape(8, 256) @ _BITS
        return [int.from_bytes(np.packbits(counts.ravel() * 2 > n).tobytes(), "big", signed=True)]
    h = np.repeat(hashes.astype(np.uint64)[None], seeds, axis=0)
    rest = h[1:]
    rest += (np.arange(1, seeds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for m in _MIX:
        rest ^= rest >> np.uint64(33)
        rest *= np.uint64(m)
    rest ^= rest >> np.uint64(33)
    # Ones are counted in the eight octets of a word at once, for up to 255 words before an octet could overflow.
    width = min(n, 255)
    groups = -(-n // width)
    if groups * width > n:
        h = np.concatenate((h, np.zeros((seeds, groups * width - n), dtype=np.uint64)), axis=1)
    h = h.reshape(seeds, groups, width)
    ones, part = np.empty((seeds, 8, 8), dtype=np.int64), np.empty_like(h)
    for bit in range(8):
        np.right_shift(h, np.uint64(bit), out=part)
        part &= _OCTETS
        ones[:, :, bit] = part.sum(axis=2, dtype="<u8").view(np.uint8).reshape(seeds, groups, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(ones.reshape(seeds, 64) * 2 > n, axis=1, bitorder="little").view("<i8").ravel().tolist()


def with_fingerprints(docs: DataFrame, words: int = 3, seeds: int = 1) -> DataFrame:
    """(doc_id, fps) of every row; ``fps`` holds ``seeds`` signed 64-bit fingerprints of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t, words), seeds) for t in byte_rows(batch["_bytes"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "fps"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_bytes"))
    return rows.mapInArrow(run, "doc_id long, fps array<long>")


class Forest:
    """BK-trees of several shards at once, built and searched level by level on arrays."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray):
        n = len(shard)
        self.fps, self.base = fps, 64 * fps.shape[1] + 1
        _, first, inverse = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first[inverse]
        parent, edge = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        left = np.nonzero(self.root != np.arange(n))[0]
        at = self.root[left]
        while len(left):
            d = self.distance(left, at)
            _, first, inverse = np.unique(at * self.base + d, return_index=True, return_inverse=True)
            child = left[first]  # the first to arrive on an edge becomes its node, the others go below it
            parent[child], edge[child] = at[first], d[first]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, at = left[rest], child[inverse][rest]
        nodes = np.nonzero(parent >= 0)[0]
        keys = parent[nodes] * self.base + edge[nodes]
        order = np.argsort(keys, kind="stable")
        self.keys, self.children = keys[order], nodes[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), dtype=np.int64)
        for k in range(0, len(a), STEP):  # whole fingerprints of all pairs at once would be most of a task's memory
            part = slice(k, k + STEP)
            out[part] = np.bitwise_count(self.fps[a[part]] ^ self.fps[b[part]]).sum(axis=1, dtype=np.int64)
        return out

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) at most ``radius`` apart, by levels of the trees."""
        q, node = queries, self.root[queries]
        while len(q):
            d = self.distance(q, node)
            near = (d <= radius) & (q != node)
            yield q[near], node[near]
            lo = np.searchsorted(self.keys, node * self.base + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.keys, node * self.base + np.minimum(d + radius, self.base - 1), "right")
            n = hi - lo
            total = int(n.sum())
            pick = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
            q, node = np.repeat(q, n), self.children[pick]


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each entry's root) after joining a[i] with b[i] for all i."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label = shorter
    return label


def spanning_links(shard: np.ndarray, fps: np.ndarray, radius: int, pairs: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as all links within ``radius`` inside each shard; ``pairs`` bounds memory."""
    forest, n = Forest(shard, fps), len(shard)
    _, inverse, size = np.unique(shard, return_inverse=True, return_counts=True)
    todo = np.nonzero(size[inverse] > 1)[0]
    share = np.cumsum(size[inverse][todo]) // pairs
    label = np.arange(n)
    for k in np.split(todo, np.nonzero(np.diff(share))[0] + 1):
        for a, b in forest.within(k, radius):
            label = _union(label, a, b)
    linked = np.nonzero(label != np.arange(n))[0]
    return linked, label[linked]


def find_links(nodes: DataFrame, seeds: int, radius: int, chunk: int = 4096, measured: int | None = None) -> DataFrame:
    """Links (a, b) between ids of ``nodes`` (id, fps) that connect what lies within ``radius`` bits.

    Blocks come from all ``seeds`` fingerprints; the radius counts the bits of the first ``measured``.
    """
    measured = measured or seeds
    rows = _dealt(nodes.select("id", "fps"), seeds, measured, chunk)

    def links(ids: np.ndarray, shards: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = spanning_links(shards, fps, radius)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, shards, fps in _whole_shards(batches, ("id",), measured):
            yield links(ids, shards, fps)

    return rows.mapInArrow(run, "a long, b long")


def _dealt(nodes: DataFrame, seeds: int, measured: int, chunk: int) -> DataFrame:
    """``nodes`` with the first ``measured`` of their ``fps``, once for each ``_shard`` (block and pair of chunks), sorted by it."""
    per, columns = 64 // BLOCK_BITS, [c for c in nodes.columns if c != "fps"]
    blocks = [F.shiftrightunsigned(F.get("fps", F.lit(s)), BLOCK_BITS * k).bitwiseAND((1 << BLOCK_BITS) - 1) + F.lit((s * per + k) << BLOCK_BITS) for s in range(seeds) for k in range(per)]
    rows = nodes.select(*columns, F.slice("fps", 1, measured).alias("fps"), F.explode(F.array(*blocks)).alias("_block"))
    # Shards of more than a chunk; each has that many of the nodes, so there are few, and their table's size is known.
    large = rows.groupBy("_block").agg(F.count("*").alias("_n")).where(F.col("_n") > chunk)
    large = written(large.select("_block", F.ceil(F.col("_n") / chunk).cast("int").alias("_chunks")), "large-shards")
    rows = rows.join(large, "_block", "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int")
    other = F.filter(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda j: j != own)
    pairs = F.when(F.col("_chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(other, lambda j: F.least(own, j).cast("long") * (1 << 16) + F.greatest(own, j))
    )
    rows = rows.select(*columns, "fps", "_block", F.explode(pairs).alias("_pair"))
    shard = F.shiftleft(F.col("_block").cast("long"), 32) + F.col("_pair")
    return rows.select(*columns, "fps", shard.alias("_shard")).repartition("_shard").sortWithinPartitions("_shard")


def _whole_shards(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], measured: int, enough: int = 20_000) -> Iterator[tuple[np.ndarray, ...]]:
    """``columns``, ``_shard`` and ``fps`` of sorted rows as arrays, some whole shards at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        flat = batch["fps"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        held.append((*(batch[c].to_numpy(zero_copy_only=False) for c in (*columns, "_shard")), flat.reshape(-1, measured)))
        if sum(len(h[0]) for h in held) < enough:
            continue
        rows = tuple(np.concatenate(x) for x in zip(*held))
        shards = rows[-2]
        whole = int(np.searchsorted(shards, shards[-1], "left"))  # rows are sorted; the last shard may go on
        if whole:
            yield tuple(x[:whole] for x in rows)
        held = [tuple(x[whole:] for x in rows)]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links``; component is the smallest id reachable.

    Each round maps every id to the neighbour (or itself) of the least hash and
    contracts the links, which shrinks them by a constant factor expected; the
    round's map is written.  The driver sees only whether links remain.
    """
    edges = written(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("id"), F.least("m", rank("a"))["id"].alias("to"))
        best = written(best, "contraction")
        maps.append(best)
        end = lambda c: best.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}"))
        moved = edges.join(end("a"), "a").join(end("b"), "b").where(F.col("to_a") != F.col("to_b"))
        edges = written(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = maps[0]
    for m in maps[1:]:
        step = m.select(F.col("id").alias("to"), F.col("to").alias("_next"))
        found = found.join(step, "to", "left").select("id", F.coalesce("_next", "to").alias("to"))
    found = written(found, "representatives")
    least = found.groupBy("to").agg(F.min(F.least("id", "to")).alias("component"))
    return found.join(written(least, "smallest"), "to").select("id", "component")


def near_duplicates(docs: DataFrame, words: int = 3, seeds: int = 1, radius: int = 3, measured: int | None = None) -> DataFrame:
    """(doc_id, fps, component_id) of every row of ``docs``.

    Fingerprints of ``seeds`` times 64 bits over shingles of ``words`` words
    link at ``radius`` or fewer differing bits (of the first ``measured`` times
    64) if they also agree on one block of 16 bits.  With one seed and a radius up to 3 some block must agree and no
    link is lost; with more, the loss is what :func:`recall` says.

    ``component_id`` is the smallest ``doc_id`` reachable over links.  Null text
    and texts without words have fingerprint zero, which links like any other.
    Repeated rows are each returned; rows that share a ``doc_id`` are one
    document.  A row whose ``doc_id`` is null gets the component of its
    fingerprint, null if only such rows have it.  An empty table gives none.
    """
    fps = written(with_fingerprints(docs, words, seeds), "fingerprints")
    nodes = written(fps.groupBy("fps").agg(F.min("doc_id").alias("id")).where(F.col("id").isNotNull()), "nodes")
    # An id on several fingerprints joins them: they are one document's.
    found = components(find_links(nodes, seeds, radius, measured=measured))
    placed = nodes.join(found, "id", "left").select("fps", F.coalesce("component", "id").alias("component_id"))
    return fps.join(placed, "fps", "left").select("doc_id", "fps", "component_id")


def recall(similarity: float, seeds: int) -> float:
    """Expected share of pairs of this Jaccard similarity that agree on a block, before links over others."""
    cosine = 2 * similarity / (1 + similarity)
    bit = 1 - np.arccos(cosine) / np.pi
    return float(1 - (1 - bit**BLOCK_BITS) ** (seeds * 64 // BLOCK_BITS))


def bits_at(similarity: float, seeds: int, slack: float = 1.5) -> int:
    """Differing bits up to which texts count as of this Jaccard similarity: the expected number and ``slack`` deviations."""
    bit = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(64 * seeds * bit + slack * np.sqrt(64 * seeds * bit * (1 - bit))))


def met(similarity: float, seeds: int, measured: int, slack: float = SLACK) -> float:
    """Expected share of pairs of this similarity that agree on a block and also lie within the radius."""
    bit, bits = np.arccos(2 * similarity / (1 + similarity)) / np.pi, 64 * measured
    deviations = (bits_at(similarity, measured, slack) + 0.5 - bits * bit) / math.sqrt(bits * bit * (1 - bit))
    return recall(similarity, seeds) * 0.5 * (1 + math.erf(deviations / math.sqrt(2)))


def shared_needed(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """How many elements sets of ``n`` and ``m`` must share for this Jaccard similarity."""
    return np.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9).astype(np.int64)


def with_shingle_sets(docs: DataFrame, words: int, seeds: int) -> DataFrame:
    """(doc_id, digest, n, fps) of every row: 128 bits of its set of shingles, the set's size and its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, fps = [], [], []
            for text in byte_rows(batch["_bytes"]):
                found = np.unique(shingle_hashes(text, words))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                fps.append(fingerprint(found, seeds))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "digest", "n", "fps"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_bytes"))
    return rows.mapInArrow(run, "doc_id long, digest binary, n int, fps array<long>")


def _proposed(shard: np.ndarray, n: np.ndarray, fps: np.ndarray, radius: int, similarity: float, pairs: int = 2_000_000) -> np.ndarray:
    """Places of the nodes with a partner in their shard within ``radius`` bits whose set's size allows the similarity.

    Of pairs with a set of at most SHORT elements the radius is wider.

    A pair that agrees on a block of the fingerprints at hand counts in the first such block's shards only.
    """
    forest = Forest(shard, fps)
    bits = 64 * fps.shape[1]
    wide = max(radius, math.ceil(bits * SHORT_BITS + SLACK * math.sqrt(bits * SHORT_BITS * (1 - SHORT_BITS))))
    block, near = shard >> 32, np.zeros(len(shard), dtype=bool)
    _, inverse, size = np.unique(shard, return_inverse=True, return_counts=True)
    todo = np.nonzero(size[inverse] > 1)[0]
    share = np.cumsum(size[inverse][todo]) // pairs
    for k in np.split(todo, np.nonzero(np.diff(share))[0] + 1):
        for a, b in forest.within(k, wide):
            least = np.minimum(n[a], n[b])
            fits = (shared_needed(n[a], n[b], similarity) <= least) & ((least <= SHORT) | (forest.distance(a, b) <= radius))
            a, b = a[fits], b[fits]
            # Blocks in the order of _dealt: by fingerprint, the lowest bits first.
            same = np.ascontiguousarray(fps[a] ^ fps[b]).astype("<u8").view("<u2") == 0
            at = block[a] >> BLOCK_BITS
            first = np.where(same.any(axis=1), same.argmax(axis=1), at)
            near[a[first == at]] = near[b[first == at]] = True
    return np.nonzero(near)[0]


def similar_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same sets as all pairs whose exact Jaccard similarity is at least ``similarity``."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order], dtype=np.int64)
    ends = np.cumsum(sizes)
    _, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    label, mark = np.arange(len(sets)), np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
    for k in range(len(sets)):
        # Only sets of up to n / similarity elements can be similar to one of n.
        last = int(np.searchsorted(sizes, sizes[k] / similarity + 1e-9, "right"))
        if not sizes[k] or last <= k + 1 or (label[k + 1 : last] == label[k]).all():
            continue
        own = flat[ends[k] - sizes[k] : ends[k]]
        mark[own] = True
        shared = np.add.reduceat(mark[flat[ends[k] : ends[last - 1]]], ends[k : last - 1] - ends[k], dtype=np.int64)
        mark[own] = False
        hit = k + 1 + np.nonzero(shared >= shared_needed(sizes[k], sizes[k + 1 : last], similarity))[0]
        label = _union(label, np.full(len(hit), k), hit)
    linked = np.nonzero(label != np.arange(len(sets)))[0]
    return order[linked], order[label[linked]]


def find_similar(docs: DataFrame, nodes: DataFrame, words: int, similarity: float, seeds: int, radius: int, measured: int, chunk: int = 4096) -> DataFrame:
    """Links (a, b) between ids of ``nodes`` (id, n, fps) whose texts' exact Jaccard similarity is at least ``similarity``.

    Fingerprints only say which nodes meet in which shard, a row for each; their
    texts are joined in and compared as sets of shingles where the shard lies,
    so a group of k near copies costs rows in proportion to k.
    """
    rows = _dealt(nodes.where(F.col("n") > 0).select("id", "n", "fps"), seeds, measured, chunk)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, shards, fps in _whole_shards(batches, ("id", "n"), measured):
            found = _proposed(shards, n, fps, radius, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(shards[found])], ["id", "_shard"])

    met = written(rows.mapInArrow(propose, "id long, _shard long"), "proposals")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("_bytes"))
    rows = met.join(texts, "id").repartition("_shard").sortWithinPartitions("_shard")

    def links(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        a, b = similar_links(sets, similarity)
        at = np.array(ids, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at[a]), pa.array(at[b])], ["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        for batch in batches:
            for i, shard, text in zip(batch["id"].to_pylist(), batch["_shard"].to_pylist(), batch["_bytes"]):
                if shard != now and ids:
                    yield links(ids, sets)
                    ids, sets = [], []
                now = shard
                ids.append(i)
                sets.append(np.unique(shingle_hashes(text.as_py() or b"", words)))
        if ids:
            yield links(ids, sets)

    return rows.mapInArrow(verify, "a long, b long")


def similar_groups(docs: DataFrame, words: int, similarity: float, seeds: int, measured: int) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs``, by exact Jaccard similarity of the pairs that :func:`find_similar` meets.

    Texts with the same set of shingles are one node, those without words too.
    """
    sets = written(with_shingle_sets(docs, words, seeds), "fingerprints")
    nodes = sets.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("fps").alias("fps"))
    nodes = written(nodes.where(F.col("id").isNotNull()), "nodes")
    found = components(find_similar(docs, nodes, words, similarity, seeds, bits_at(similarity, measured, SLACK), measured))
    placed = nodes.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    return sets.join(placed, "digest", "left").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, seeds: int = 24, measured: int = 8) -> DataFrame:
    """The rows of ``docs`` less all but the smallest ``doc_id`` of each group of near-duplicates.

    Near means an exact Jaccard similarity of at least ``similarity`` on sets of
    shingles of ``words`` words; fingerprints propose the pairs, see
    :func:`find_similar`.  Of rows that share a kept ``doc_id`` the one with the
    smallest text stays; rows whose ``doc_id`` is null can't be referred to and
    stay.  Columns are those of ``docs``.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    groups = similar_groups(docs, words, similarity, seeds, measured)
    kept, first = unused(docs.columns, "kept", "first")
    keep = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(kept)).distinct()
    rows = docs.where(F.col("doc_id").isNotNull())
    rows = rows.join(keep, F.col("doc_id").cast("long") == F.col(kept)).drop(kept)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    rows = rows.withColumn(first, place).where(F.col(first) == 1).select(*columns)
    return rows.unionByName(docs.where(F.col("doc_id").isNull()))


def op2_simhash(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs.select("doc_id", "text"), words=3, seeds=1, radius=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.get("fps", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    """fingerprint and component by comparing all pairs, for tests."""
    import re

    prints = {}
    for doc_id, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints[doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    component = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and component[b] < component[a]:
                    component[a], changed = component[b], True
    return {d: (f"{prints[d]:016x}", component[d]) for d in prints}
