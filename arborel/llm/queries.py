"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_text, licenses, line_dedup, packing, quality, simhash, token_counts, token_store, topk
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def on(fn, *names: str) -> Query:
    """A query that applies ``fn`` to whole tables."""
    return lambda spark, sf_dir: fn(*(table(spark, sf_dir, n) for n in names))


def queries() -> dict[str, Query]:
    return {
        "op1_topk": on(topk.op1_topk, "embeddings"),
        "op2_simhash": on(simhash.op2_simhash, "documents"),
        "op3_license_scan": on(licenses.op3_license_scan, "documents"),
        "op4_decontamination": on(decontam.op4_decontamination, "documents", "benchmark"),
        "op5_token_store": on(token_store.op5_token_store, "documents"),
        "op6_token_counts": on(token_counts.op6_token_counts, "documents"),
        "op7_quality": on(quality.op7_quality, "documents", "labels"),
        "op8_html_text": on(html_text.op8_html_text, "pages"),
        "op9_line_dedup": on(line_dedup.op9_line_dedup, "documents"),
        "op10_best_fit_packing": on(packing.op10_best_fit_packing, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the result; the others are tested against brute force or held-out labels."""
    return {
        "op1_topk": topk.ORACLE,
        "op3_license_scan": licenses.ORACLE,
        "op4_decontamination": decontam.ORACLE,
        "op9_line_dedup": line_dedup.ORACLE,
    }
