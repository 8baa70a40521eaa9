"""From columns and files of markup to rows of nodes, events and query results.

Parsing is the only step that needs Python: batches of whole documents cross
over Arrow, and a document is parsed where its row lies.  No document is ever
split.  None is shuffled, unless its table is small and lies in fewer files than
the cluster has cores (see :func:`dealt`).
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import model
from ..tree import DOCUMENT, Document, Node
from . import html4, html5, xml

#: How many source characters are parsed before their rows are handed on; a document and a row count as so many besides.
CHUNK, DOCUMENT_COST, ROW_COST = 1 << 20, 1024, 256
#: How many documents of a batch are Python objects at a time.
SLICE = 64
#: Of how many sources, and of sources of how many characters, a task keeps the rows in case they come again.
KEPT, KEPT_LENGTH = 4096, 1024


def parser(kind: str, **options) -> Callable[[str | bytes], Document]:
    """A function from one document's source to its tree; kinds: xml, html, html5, html4, auto and fragments."""

    def text(source: str | bytes) -> str:
        return html5_decode(source) if isinstance(source, bytes) else source

    if kind == "xml":
        return lambda s: xml.parse(s, **options)
    if kind in ("html", "html5"):
        return lambda s: html5.parse(text(s), **options)
    if kind == "html4":
        return lambda s: html4.parse(text(s), **options)
    if kind == "html_fragment":
        return lambda s: html5.parse(text(s), **{"context": "body", **options})
    if kind == "xml_fragment":
        return lambda s: xml.parse_fragment(text(s), **options)
    if kind == "auto":
        return lambda s: html4.parse(text(s)) if xml.looks_like_html(text(s)) else xml.parse(s, **options)
    raise ValueError(f"unknown kind {kind!r}")


def html5_decode(data: bytes, encoding: str | None = None) -> str:
    """Bytes of HTML as text: by the given encoding, byte-order mark, or a meta element of the first 1024 bytes."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    if not encoding:
        m = re.search(rb"<meta[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", data[:1024], re.I)
        encoding = m[1].decode() if m else "utf-8"
    if encoding.lower() in ("iso-8859-1", "latin1", "ascii", "us-ascii"):
        encoding = "cp1252"
    try:
        return data.decode(encoding, "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def map_documents(
    df: DataFrame,
    source: str,
    kind: str,
    schema: str | T.StructType,
    rows_of: Callable[[int | None, Document], Iterable[tuple]],
    id_column: str = "doc_id",
    repeatable: bool = False,
    **options,
) -> DataFrame:
    """Apply ``rows_of`` to every parsed document; its rows have ``schema``.

    ``repeatable`` says that the rows begin with the id and that all else in them
    follows from the source, so that short sources that come again in a task
    needn't be parsed again.

    Null source is an empty document.  A document that strict XML options refuse
    raises; recovering options and HTML never do.
    """
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(target)
    rows = dealt(df).select(F.col(id_column).cast("long").alias("_id"), F.col(source).alias("_source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = parser(kind, **options)
        out, size, doc = [], 0, None
        kept: dict[str | bytes, list[tuple]] = {}
        with _collected_by_chunk():
            for doc_id, text in _each(batches):
                made = kept.get(text)
                if made is not None:
                    out.extend([(doc_id, *r) for r in made])
                else:
                    doc = read(text) if text is not None else Document(Node(DOCUMENT), kind).number()
                    made = list(rows_of(doc_id, doc))
                    out.extend(made)
                    if repeatable and text is not None and len(text) <= KEPT_LENGTH:
                        if len(kept) == KEPT:
                            kept.clear()
                        kept[text] = [r[1:] for r in made]
                size += len(text or "") + DOCUMENT_COST + ROW_COST * len(made)
                if size >= CHUNK:
                    made = _batch(out, arrow)
                    out, size, doc = [], 0, None
                    gc.collect()
                    yield made
                    del made
            yield _batch(out, arrow)

    out = rows.mapInArrow(run, target)
    # What comes of a document may be many times its size in the files, which is all that
    # Spark goes by: joins of it must not be planned as broadcasts through the driver.
    return out if df.isStreaming else out.hint("merge")


@contextmanager
def _collected_by_chunk() -> Iterator[None]:
    """Trees are cycles that only the collector frees.  Left to itself it goes through them while they are in
    use, and takes those that it has seen for long-lived; here the caller collects after each chunk."""
    was = gc.isenabled()
    gc.freeze()
    gc.disable()
    try:
        yield
    finally:
        gc.unfreeze()
        if was:
            gc.enable()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | bytes | None]]:
    """The documents of batches; a batch may hold thousands, of which few are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield from zip(part["_id"].to_pylist(), part["_source"].to_pylist())


def dealt(df: DataFrame) -> DataFrame:
    """Documents in tasks enough for all cores; starts no job.

    A table of short rows may have any number of them in a few files, or in one
    row group of one file, which would be one task.  Such a table is dealt out
    row by row.  What is larger than the cores' share of splits, lies in as many
    files as there are cores, or was dealt into a number of partitions before
    (as :func:`arborel.corpus.build` does), stays where it is.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    size = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    if size >= cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return df
    at = plan
    while at.children().size() == 1:
        if at.nodeName() in ("RepartitionByExpression", "Repartition"):
            return df
        at = at.children().apply(0)
    if at.children().size() == 0 and len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(2 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def parse_nodes(df: DataFrame, source: str, kind: str = "html5", id_column: str = "doc_id", text_cap: int = 4096, **options) -> DataFrame:
    """The node table of a column of markup; see :mod:`arborel.model`."""
    return map_documents(df, source, kind, model.NODES, lambda i, d: model.node_rows(i, d, text_cap), id_column, **options)


def parse_documents(df: DataFrame, source: str, kind: str = "html5", id_column: str = "doc_id", **options) -> DataFrame:
    """One row for each document: version, encoding, quirks mode, document type and errors."""
    return map_documents(df, source, kind, model.DOCS, lambda i, d: [model.doc_row(i, d)], id_column, **options)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files of markup as (doc_id, url, source); ``source`` holds the bytes for the parsers to decode."""
    reader = spark.read.format("binaryFile")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return rows.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("url"), F.col("content").alias("source"))


def is_xpath(expression: str, namespaces: Mapping[str, str] | None = None) -> bool:
    """Whether an expression is XPath: a path from / or a dot, a variable, a parenthesis or a call; else it is a CSS selector."""
    if expression.startswith(("/", "./", "..", "(", "$")) or expression == "." or re.match(r"[a-z-]+\(", expression):
        return True
    call = re.match(r"([A-Za-z_][\w.-]*):[A-Za-z_][\w.-]*\(", expression)
    return call is not None and call[1] in (namespaces or {})


def query(
    df: DataFrame,
    source: str,
    expression: str,
    kind: str = "html5",
    id_column: str = "doc_id",
    namespaces: Mapping[str, str] | None = None,
    variables: Mapping[str, object] | None = None,
    functions: Mapping[str, Callable] | None = None,
    **options,
) -> DataFrame:
    """Parse and query in one pass: (doc_id, seq, pre, kind, name, value) of each node, or the scalar result.

    Only results leave the task.  ``expression`` is XPath if it starts with /,
    ./, .. or is a dot or a call (of a name whose prefix, if any, ``namespaces``
    binds), else a CSS selector.  ``functions`` maps names,
    with "{namespace}" in front if they have one, to callables that take the
    context, the node and the arguments' values.
    """
    from ..functions import exslt  # noqa: F401  registers the extension functions
    from ..plans import evaluate, xpath

    as_xpath = is_xpath(expression, namespaces)
    if as_xpath:
        xpath.parse(expression)  # errors belong to the driver

    def rows(doc_id, doc):
        from ..functions import exslt  # noqa: F401

        find = evaluate.query if as_xpath else evaluate.select
        found = find(doc, expression, namespaces=namespaces, variables=variables, functions=functions)
        if not isinstance(found, list):
            return [(doc_id, 1, None, 0, "", evaluate.string(found))]
        return [(doc_id, k, n.pre, n.kind, n.name, n.text()) for k, n in enumerate(found, 1)]

    return map_documents(df, source, kind, "doc_id long, seq int, pre int, kind int, name string, value string", rows, id_column, **options)


def sax_events(df: DataFrame, source: str, kind: str = "xml", id_column: str = "doc_id", **options) -> DataFrame:
    """Event rows (doc_id, seq, event, name, value, attrs) of each document, in document order."""
    from ..tree import CDATA, COMMENT, DOCTYPE, ELEMENT, PI, TEXT

    names = {TEXT: "characters", CDATA: "cdata_block", COMMENT: "comment", PI: "processing_instruction", DOCTYPE: "doctype"}

    def rows(doc_id, doc):
        out = [("start_document", "", None, {})]
        stack: list[tuple[Node, bool]] = [(c, False) for c in reversed(doc.node.children)]
        while stack:
            n, done = stack.pop()
            if n.kind != ELEMENT:
                out.append((names.get(n.kind, "other"), n.local, n.value, {}))
            elif done:
                out.append(("end_element", n.name, None, {}))
            else:
                out.append(("start_element", n.name, None, {a.name: a.value for a in n.attrs}))
                stack.append((n, True))
                stack.extend((c, False) for c in reversed(n.children))
        out += [("error", "", m, {}) for _, m in doc.errors]
        out.append(("end_document", "", None, {}))
        return [(doc_id, k, e, name, v, list(a.items())) for k, (e, name, v, a) in enumerate(out)]

    return map_documents(df, source, kind, "doc_id long, seq int, event string, name string, value string, attrs map<string,string>", rows, id_column, **options)


def reader_rows(df: DataFrame, source: str, id_column: str = "doc_id", outer_depth: int | None = 1, **options) -> DataFrame:
    """Rows of a pull reader's cursor, in the order in which it meets them.

    ``node_type`` is the node's kind, 15 at the end of an element; ``lang`` and
    ``base_uri`` are those in scope; ``outer_xml`` and ``inner_xml`` stand at the
    start of each element that is ``outer_depth`` levels below the document
    element or fewer, but not of that itself; without a depth, of every element.
    """
    from urllib.parse import urljoin

    from ..operators.serialize import to_xml
    from ..tree import ELEMENT, XML_NS

    names = {3: "#text", 4: "#cdata-section", 8: "#comment"}

    def rows(doc_id, doc):
        out = []
        stack: list[tuple] = [(c, 0, False, None, doc.url) for c in reversed(doc.node.children)]
        while stack:
            n, depth, done, lang, base = stack.pop()
            if n.kind == ELEMENT:
                lang = n.get("lang", XML_NS) or lang
                own = n.get("base", XML_NS)
                base = urljoin(base or "", own) if own else base
            empty = n.kind == ELEMENT and not n.children
            wanted = n.kind == ELEMENT and not done and (outer_depth is None or 1 <= depth <= outer_depth)
            outer, inner = (to_xml(n), "".join(to_xml(c) for c in n.children)) if wanted else (None, None)
            value = None if n.kind == ELEMENT else n.value
            attrs = [(a.name, a.value) for a in n.attrs]
            out.append((15 if done else n.kind, depth, n.name or names.get(n.kind, ""), n.local, n.prefix, n.ns, value, empty, len(attrs), attrs, lang, base, outer, inner))
            if n.kind == ELEMENT and n.children and not done:
                stack.append((n, depth, True, lang, base))
                stack.extend((c, depth + 1, False, lang, base) for c in reversed(n.children))
        return [(doc_id, k, *r) for k, r in enumerate(out)]

    schema = (
        "doc_id long, seq int, node_type int, depth int, name string, local_name string, prefix string, namespace_uri string, value string, is_empty boolean, "
        "attribute_count int, attributes map<string,string>, lang string, base_uri string, outer_xml string, inner_xml string"
    )
    return map_documents(df, source, "xml", schema, rows, id_column, **options)
