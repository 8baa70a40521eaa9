"""SQL names for the engine: scalar and table functions of a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans import evaluate
from ..sources import read


def _values(kind: str, source: str | None, expression: str) -> list[str] | None:
    from . import exslt  # noqa: F401

    if source is None or expression is None:
        return None
    doc = read.parser(kind)(source)
    find = evaluate.query if expression.startswith(("/", "./", "(", "count(", "string(", "sum(", "normalize-space(", "concat(", "number(", "boolean(")) else evaluate.select
    found = find(doc, expression)
    return [n.text() for n in found] if isinstance(found, list) else [evaluate.string(found)]


def _query(kind: str) -> Callable:
    def run(source: pd.Series, expression: pd.Series) -> pd.Series:
        return pd.Series([_values(kind, s, e) for s, e in zip(source, expression)])

    return F.pandas_udf(run, "array<string>")


def _resolve(base: pd.Series, relative: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else urljoin(b or "", r) for b, r in zip(base, relative)])


class MarkupEvents:
    """Table function: the event rows of one document."""

    def eval(self, source: str, kind: str) -> Iterator[tuple]:
        if source is None:
            return
        doc = read.parser(kind or "xml")(source)
        for k, n in enumerate(doc.node.walk()):
            yield k, n.kind, n.name, None if n.kind == 1 else n.value, n.pre, n.size


def register(spark: SparkSession) -> None:
    """html_query(source, expression), xml_query(source, expression), resolve_uri(base, relative) and the table function markup_nodes(source, kind)."""
    spark.udf.register("html_query", _query("html5"))
    spark.udf.register("xml_query", _query("xml"))
    spark.udf.register("resolve_uri", F.pandas_udf(_resolve, "string"))
    spark.udtf.register("markup_nodes", F.udtf(MarkupEvents, returnType="seq int, kind int, name string, value string, pre int, size int"))
