"""Line deduplication across documents, with DataFrame functions only.

Lines are exploded, normalised and hashed; a hash held by ``min_docs``
documents or more loses its lines everywhere but in the smallest ``doc_id``.
The 128-bit hash, never the text, is shuffled, and the aggregate that finds
repeated lines is combined on the map side, so a line that a third of all
documents hold costs each task one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, unused, written

#: White space that is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Return ``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    A line's key is the line stripped of ASCII white space and with A-Z
    lower-cased; keys shorter than ``min_chars`` code points are left alone.
    Keys found in ``min_docs`` distinct ids lose their lines except in the
    smallest id, which keeps all of its own.

    Null or empty text is one empty line.  Rows that share a ``doc_id`` are one
    document: each is returned with its own text.  A row whose ``doc_id`` is
    null keeps all its lines and counts for no key.  An empty table gives an
    empty table.  Other columns pass through, save that columns named
    ``kept_text``, ``n_lines`` or ``n_dropped`` are replaced.  Lines are known by
    128 bits of hash: among 10 to the 12th different lines, the chance that any
    two are taken for one is below 10 to the minus 14th.
    """
    base = docs.drop("kept_text", "n_lines", "n_dropped")
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.xxhash64(text)

    lines = base.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_d"), digest.alias("_t"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line")
    )
    lines = lines.select("_d", "_t", "_pos", line_key(F.col("_line")).alias("_key"))
    lines = lines.where(F.length("_key") >= min_chars).select(
        "_d", "_t", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")
    )

    held = lines.groupBy("_h1", "_h2")
    if min_docs <= 2:
        repeated = held.agg(F.min("_d").alias("_first"), F.max("_d").alias("_last"))
        repeated = repeated.where(F.col("_first") != F.col("_last")) if min_docs == 2 else repeated
    else:
        repeated = held.agg(F.min("_d").alias("_first"), F.countDistinct("_d").alias("_n")).where(F.col("_n") >= min_docs)
    repeated = written(repeated.select("_h1", "_h2", "_first"), "repeated-lines")

    # Both sides come straight from files, so a hot hash can be split at run time.
    dropped = lines.join(repeated, ["_h1", "_h2"]).where(F.col("_d") != F.col("_first"))
    dropped = dropped.groupBy("_d", "_t").agg(F.collect_set("_pos").alias("_gone"))

    t, d, dt, gone = unused([*base.columns, "kept_text", "n_lines", "n_dropped"], "t", "d", "dt", "gone")
    dropped = dropped.select(F.col("_d").alias(d), F.col("_t").alias(dt), F.col("_gone").alias(gone))
    out = base.withColumn(t, digest)
    out = out.join(dropped, (F.col("doc_id") == F.col(d)) & (F.col(t) == F.col(dt)), "left")
    every = F.split(text, "\n", -1)
    n_lines = F.size(every)
    kept = F.when(F.col(gone).isNull(), text).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col(gone)), lambda i: F.get(every, i)), "\n")
    )
    return out.select(
        *[F.col(f"`{c}`") for c in base.columns],
        kept.alias("kept_text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT rid, doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS pos) u
),
r AS (SELECT k, min(doc_id) AS first_id FROM l WHERE length(k) >= 10 AND doc_id IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, (r.first_id IS NOT NULL AND l.doc_id <> r.first_id) AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
