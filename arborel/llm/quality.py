"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The model scores a text by a bias, a weight for each feature and low-rank
pairwise interactions, which the identity of the squared sum and the sum of
squares gives in time linear in the features.  It is fitted on a bounded sample
of labelled rows on the driver (``max_rows``, by hash, so the same rows each
time); every text is scored where it lies against a model of fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, unused

WORD_BITS, FACTORS, BINS = 16, 8, 16
STATISTICS = ("repeats", "distinct", "symbols", "bars", "upper", "digits", "word_length", "words", "line_words", "unended", "longest", "shouts", "marked")
#: Columns beside the text that are features; never an id, a language or a source.
METADATA = ("n_chars",)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
#: Bytes that ordinary prose holds: white space, letters, digits, full stop, comma and all beyond ASCII.
_PROSE = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum() or c in b" \t\n\x0b\x0c\r.,")
_BLANK = b" \t\n\r\x0b\x0c"
_MARKS = b"!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~"

#: Marks become one mark, white space one blank, all else a letter: a word that ends in a mark is a mark before a blank.
_ENDINGS = bytes(33 if c in _MARKS else 32 if c in _BLANK else 120 for c in range(256))


def statistics(text: bytes, words: list[bytes]) -> list[float]:
    """Structure of a text, each in a scale of its own; zeros for a text without words."""
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(STATISTICS)
    full = [x.rstrip() for x in text.split(b"\n") if x.strip()]
    marked = text.translate(_ENDINGS)
    return [
        sum(map(eq, words, islice(words, 1, None))) / n,
        len(set(words)) / n,
        len(text.translate(None, _PROSE)) / size,
        text.count(b"|") / n,
        (size - len(text.translate(None, _UPPER))) / size,
        (size - len(text.translate(None, _DIGIT))) / size,
        len(text.translate(None, _BLANK)) / n,
        float(np.log1p(n)),
        float(np.log1p(n / max(1, len(full)))),
        sum(x[-1:] not in b".!?" for x in full) / max(1, len(full)),
        float(np.log1p(max(map(len, words)))),
        sum(map(bytes.isupper, words)) / n,
        (marked.count(b"! ") + marked.endswith(b"!")) / n,
    ]


def word_buckets(text: bytes) -> list[int]:
    """The hash buckets of a text's distinct words, A-Z lower-cased."""
    mask, crc = (1 << WORD_BITS) - 1, zlib.crc32
    return list({crc(w) & mask for w in set(text.lower().split())})


@dataclass
class Machine:
    """Feature indices: word buckets, then ``BINS`` for each statistic and column of ``metadata``; ``edges`` cut these into bins."""

    edges: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    metadata: tuple[str, ...] = ()

    def features(self, buckets: Sequence[int], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.arange(len(stats)) * BINS + (self.edges < stats[:, None]).sum(axis=1) + (1 << WORD_BITS)
        index = np.concatenate((np.array(buckets, dtype=np.int64), own))
        value = np.concatenate((np.full(len(buckets), 1 / np.sqrt(max(1, len(buckets))), dtype=np.float32), np.ones(len(own), dtype=np.float32)))
        return index, value

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index] * value[:, None]
        total = self.bias + float(self.weights[index] @ value) + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fit(rows: list[tuple[Sequence[int], Sequence[float], int]], metadata: Sequence[str] = (), epochs: int = 12, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    """A machine for (buckets, statistics and metadata, label) rows by stochastic gradient steps; the same rows give the same machine."""
    scales = len(STATISTICS) + len(metadata)
    size = (1 << WORD_BITS) + scales * BINS
    random = np.random.default_rng(7)
    stats = np.array([r[1] for r in rows], dtype=np.float64).reshape(-1, scales)
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(stats, cuts, axis=0).T if len(rows) else np.zeros((scales, BINS - 1))
    machine = Machine(edges, 0.0, np.zeros(size, dtype=np.float32), random.normal(0, 0.05, (size, FACTORS)).astype(np.float32), tuple(metadata))
    label = np.array([r[2] for r in rows], dtype=np.float64)
    if not len(rows) or label.min() == label.max():
        machine.factors[:] = 0
        machine.bias = 0.0 if not len(rows) else 4.0 if label[0] else -4.0
        return machine
    share = label.mean()
    machine.bias = float(np.log(share / (1 - share)))
    parts = [machine.features(r[0], s) for r, s in zip(rows, stats)]
    w_sum, v_sum, b_sum = np.full(size, 1e-6, dtype=np.float32), np.full((size, FACTORS), 1e-6, dtype=np.float32), 1e-6
    for _ in range(epochs):
        for r in random.permutation(len(rows)):
            index, value = parts[r]
            v = machine.factors[index] * value[:, None]
            total = v.sum(axis=0)
            raw = machine.bias + float(machine.weights[index] @ value) + 0.5 * float((total**2 - (v**2).sum(axis=0)).sum())
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[r]
            g = error * value + decay * machine.weights[index]
            w_sum[index] += g * g
            machine.weights[index] -= rate * g / np.sqrt(w_sum[index])
            gv = error * value[:, None] * (total - v) + decay * machine.factors[index]
            v_sum[index] += gv * gv
            machine.factors[index] -= 0.5 * rate * gv / np.sqrt(v_sum[index])
            b_sum += error * error
            machine.bias -= rate * error / np.sqrt(b_sum)
    return machine


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows where it is 1 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _metadata(docs: DataFrame, names: Sequence[str]) -> Column:
    """The logarithms of numeric columns as an array; what is missing, no number or negative counts as zero."""
    known = {c.lower() for c in docs.columns}
    number = lambda c: F.col(f"`{c}`").cast("string").try_cast("double") if c.lower() in known else F.lit(None).cast("double")
    tame = lambda x: F.when((x > 0) & (x < F.lit(float("inf"))), F.log1p(x)).otherwise(F.lit(0.0))
    return F.array(*[tame(F.coalesce(number(c), F.lit(0.0))) for c in names]).cast("array<double>")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets, stats = [], []
        for text, more in zip(byte_rows(batch["_bytes"]), batch["_meta"].to_pylist()):
            words = text.split()
            buckets.append(np.array(sorted(word_buckets(text)), dtype="<i4").tobytes())
            stats.append(statistics(text, words) + more)
        yield pa.RecordBatch.from_arrays(
            [batch["_order"], batch["quality"], pa.array(buckets, pa.binary()), pa.array(stats, pa.list_(pa.float64()))],
            ["_order", "quality", "buckets", "stats"],
        )


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, metadata: Sequence[str] = METADATA) -> Machine:
    """Fit a machine on at most ``max_rows`` labelled rows that aren't held out.

    ``metadata`` names numeric columns that are features besides the text; one
    that the table lacks counts as zero in each row.

    The rows are those of the smallest hashes of their ids.  Labels that are
    null, or whose id is null, are left out; an id with several labels has the
    least.  Without labels every text scores 0.5 and is kept.
    """
    open_ = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
    chosen = open_.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).withColumn("_order", F.xxhash64("doc_id"))
    chosen = chosen.orderBy("_order", "doc_id").limit(max_rows)
    # At most max_rows pairs of numbers.
    rows = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("_bytes"), _metadata(docs, metadata).alias("_meta")).join(F.broadcast(chosen), "doc_id")
    found = rows.select("_order", "quality", "_bytes", "_meta").mapInArrow(_described, "_order long, quality int, buckets binary, stats array<double>")
    got = found.orderBy("_order", "stats").limit(max_rows).collect()
    return fit([(np.frombuffer(r["buckets"], dtype="<i4"), r["stats"], int(r["quality"] >= 1)) for r in got], metadata)


def classify(docs: DataFrame, machine: Machine, into: str = "score") -> DataFrame:
    """``docs`` with the column ``into``, the share of quality from 0 to 1 of the whole text.

    Null text scores as empty text.  Repeated rows score alike; an empty table
    gives none.  A column of that name is replaced.
    """
    base = docs.drop(into)
    meta = unused([*base.columns, into], "meta")[0]
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    schema = base.withColumn(into, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = []
            for value, more in zip(batch["text"], batch[meta].to_pylist()):  # one text at a time, out of the batch's own memory
                text = (value.as_py() or "").encode()
                words = text.split()
                scores.append(m.score(*m.features(word_buckets(text), np.array(statistics(text, words) + more))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], into])

    return base.withColumn(meta, _metadata(base, machine.metadata)).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, max_rows: int = 6000) -> DataFrame:
    """The rows of ``docs`` whose text scores 0.5 or more; ``docs``' own columns.

    The model is fitted on ``labelled``, the table that ``labels`` are about, by default ``docs`` itself.
    """
    machine = train(docs if labelled is None else labelled, labels, max_rows)
    score = unused(docs.columns, "score")[0]
    scored = classify(docs, machine, score)
    return scored.where(F.col(score) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    narrow = docs.select("doc_id", "text", *[c for c in METADATA if c in docs.columns])
    scored = classify(narrow, train(narrow, labels))
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
