"""Streams of markup: documents as they arrive, and documents that arrive in chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import evaluate
from ..sources import read


def stream_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A folder of tables as a stream; markup columns of it go to the same parsers as a batch's."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, in the one that ``spark.checkpoint.dir`` names.

    Only where all runs on this machine, as in tests, that setting may be unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='arborel-')}"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def windowed(events: DataFrame, time: str, lateness: str, width: str, slide: str | None, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates over event-time windows; rows later than ``lateness`` behind the latest are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, lateness).groupBy(w, *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])


def push_parse(chunks: DataFrame, expression: str, kind: str = "xml", timeout: str = "1 hour") -> DataFrame:
    """Query documents that arrive as rows (doc_id, seq, chunk, last) in any order.

    State holds a document's chunks until all up to its last have come; then
    the document is parsed, queried and forgotten.  A document whose chunks
    stop coming is parsed from what there is when ``timeout`` has passed, as a
    push parser's ``finish`` does.
    """
    milliseconds = int(pd.Timedelta(timeout).total_seconds() * 1000)
    find = evaluate.query if expression.startswith(("/", "(", ".")) else evaluate.select
    parse = read.parser(kind)

    def results(doc_id: int, parts: dict[int, str]) -> pd.DataFrame:
        found = find(parse("".join(parts[k] for k in sorted(parts))), expression)
        values = [n.text() for n in found] if isinstance(found, list) else [evaluate.string(found)]
        return pd.DataFrame({"doc_id": [doc_id] * len(values), "seq": range(1, len(values) + 1), "value": values})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seqs, texts, _ = state.get
            state.remove()
            yield results(key[0], dict(zip(seqs, texts)))
            return
        seqs, texts, last = state.get if state.exists else ([], [], -1)
        parts = dict(zip(seqs, texts))
        for frame in frames:
            # Most frames have a few rows, for which itertuples would make a class each time.
            for seq, chunk, ends in zip(frame["seq"].tolist(), frame["chunk"].tolist(), frame["last"].tolist()):
                parts[seq] = chunk
                if ends:
                    last = seq
        if last >= 0 and len(parts) == last + 1:
            if state.exists:
                state.remove()
            yield results(key[0], parts)
        else:
            state.update((list(parts), list(parts.values()), last))
            state.setTimeoutDuration(milliseconds)

    return chunks.groupBy("doc_id").applyInPandasWithState(
        step, "doc_id long, seq long, value string", "seqs array<long>, texts array<string>, last long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
