"""A corpus of markup documents: the entry point for parsing, querying, transforming, validating and writing."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .operators import head
from .operators import serialize as S
from .operators import validate as V
from .operators import xinclude
from .plans import evaluate, xpath, xslt
from .plans.relational import NotRelational, Paths, stored
from .sources import read, xml
from .tree import Document, Node


class Corpus:
    """Documents in a column of ``df``; every method but :meth:`paths` returns a DataFrame and starts no job.

    ``kind`` is xml, html5, html4, auto, html_fragment or xml_fragment;
    ``options`` go to the parser.  Documents are parsed where their rows lie.
    """

    def __init__(self, df: DataFrame, source: str, kind: str = "html5", id_column: str = "doc_id", **options):
        self.df, self.source, self.kind, self.id_column, self.options = df, source, kind, id_column, options

    @classmethod
    def files(cls, spark: SparkSession, path: str, kind: str = "xml", glob: str | None = None, **options) -> Corpus:
        return cls(read.read_files(spark, path, glob), "source", kind, "doc_id", **options)

    def _map(self, schema: str, rows: Callable, repeatable: bool = False) -> DataFrame:
        return read.map_documents(self.df, self.source, self.kind, schema, rows, self.id_column, repeatable, **self.options)

    # -- tables ----------------------------------------------------------
    def nodes(self, text_cap: int = 4096) -> DataFrame:
        return read.parse_nodes(self.df, self.source, self.kind, self.id_column, text_cap, **self.options)

    def documents(self) -> DataFrame:
        return read.parse_documents(self.df, self.source, self.kind, self.id_column, **self.options)

    def attributes(self, nodes: DataFrame | None = None) -> DataFrame:
        """A row for each attribute, of the node table ``nodes`` if that is there already."""
        n = self.nodes() if nodes is None else nodes
        return n.select("doc_id", F.col("pre").alias("owner"), F.posexplode("attrs").alias("ord", "a")).select("doc_id", "owner", "ord", "a.*")

    def namespaces(self, nodes: DataFrame | None = None) -> DataFrame:
        n = self.nodes() if nodes is None else nodes
        return n.select("doc_id", F.col("pre").alias("owner"), F.posexplode("decls").alias("ord", "d")).select("doc_id", "owner", "ord", "d.*")

    def events(self) -> DataFrame:
        return read.sax_events(self.df, self.source, self.kind, self.id_column, **self.options)

    def reader(self, outer_depth: int | None = 1) -> DataFrame:
        return read.reader_rows(self.df, self.source, self.id_column, outer_depth, **self.options)

    def declarations(self) -> DataFrame:
        """A row for each declaration of the document types.

        (doc_id, kind, name, owner, type, value, required, public_id, system_id):
        elements with their content model as ``type``, attributes with the
        element that they belong to as ``owner`` and their default as ``value``,
        entities with their replacement as ``value``, and notations.
        """

        def rows(doc_id, doc):
            d = doc.dtd
            if d is None:
                return []
            out = [(doc_id, "element", n, None, V.content_text(m), None, None, None, None) for n, m in d.elements.items()]
            out += [(doc_id, "attribute", a, e, kind, default, required, None, None) for (e, a), (kind, default, required) in d.attributes.items()]
            out += [(doc_id, "entity", n, None, notation, value, None, public, system) for n, (value, system, public, notation) in d.entities.items()]
            return out + [(doc_id, "notation", n, None, None, None, None, public, system) for n, (system, public) in d.notations.items()]

        return self._map("doc_id long, kind string, name string, owner string, type string, value string, required boolean, public_id string, system_id string", rows)

    def heads(self) -> DataFrame:
        """(doc_id, title, meta_encoding) of HTML documents; null where a page says nothing."""
        return self._map("doc_id long, title string, meta_encoding string", lambda i, d: [(i, head.title(d), head.meta_encoding(d))])

    def errors(self) -> DataFrame:
        return self.documents().select("doc_id", F.posexplode("errors").alias("seq", "e")).select("doc_id", "seq", "e.line", "e.message")

    # -- queries ---------------------------------------------------------
    def search(self, expression: str, namespaces: Mapping[str, str] | None = None, variables: Mapping[str, object] | None = None, functions: Mapping[str, Callable] | None = None) -> DataFrame:
        """Results of an XPath expression or CSS selector: (doc_id, seq, pre, kind, name, value)."""
        return read.query(self.df, self.source, expression, self.kind, self.id_column, namespaces, variables, functions, **self.options)

    def fold(self, schema: str, start: Callable[[], object], step: Callable[[object, Node], object], finish: Callable[[object], tuple]) -> DataFrame:
        """A user's fold over each document's nodes in order: (doc_id, columns of ``schema``)."""

        def rows(doc_id, doc):
            state = start()
            for n in doc.node.walk():
                state = step(state, n)
            return [(doc_id, *finish(state))]

        return self._map(f"doc_id long, {schema}", rows)

    def paths(self, namespaces: Mapping[str, str] | None = None, buckets: int | None = None) -> Paths:
        """The relational lane over the node table, for many queries on one parsed corpus.

        Parses the corpus and writes its node table in ``buckets`` (by default
        the session's number of shuffle partitions); the queries only read it.
        """
        return Paths(stored(self.nodes(), buckets), namespaces, self.kind.startswith("html"))

    def extract(self, _namespaces: Mapping[str, str] | None = None, _variables: Mapping[str, object] | None = None, /, **expressions: str) -> DataFrame:
        """One row for each document with the string of each expression; nodes give their first's text, none null."""
        names = list(expressions)
        paths = [(read.is_xpath(e, _namespaces), e) for e in expressions.values()]

        def rows(doc_id, doc):
            from .functions import exslt  # noqa: F401

            context = evaluate.Context(doc, _namespaces, _variables)
            out = [doc_id]
            for is_xpath, e in paths:
                v = evaluate.evaluate(xpath.parse(e), doc.node, context) if is_xpath else evaluate.select(doc, e, context=context)
                out.append((evaluate.first(v).text() if v else None) if isinstance(v, list) else evaluate.string(v))
            return [tuple(out)]

        return self._map("doc_id long, " + ", ".join(f"`{n}` string" for n in names), rows, all(not is_xpath or evaluate.repeatable(xpath.parse(e), _namespaces) for is_xpath, e in paths))

    def count(self, _namespaces: Mapping[str, str] | None = None, /, **expressions: str) -> DataFrame:
        """One row for each document with the number of nodes that each path or selector finds."""

        paths = [(evaluate.query if read.is_xpath(e, _namespaces) else evaluate.select, e) for e in expressions.values()]

        def rows(doc_id, doc):
            context = evaluate.Context(doc, _namespaces)
            return [(doc_id, *[len(find(doc, e, context=context)) for find, e in paths])]

        return self._map("doc_id long, " + ", ".join(f"`{n}` long" for n in expressions), rows)

    # -- transformations -------------------------------------------------
    def edit(self, change: Callable[[Document], None], write: str = "auto") -> DataFrame:
        """(doc_id, source) after ``change`` has edited each document's tree in place."""

        def rows(doc_id, doc):
            change(doc)
            return [(doc_id, _written(doc.number(), write))]

        return self._map("doc_id long, source string", rows)

    def serialize(self, write: str = "auto", **options) -> DataFrame:
        """(doc_id, source): xml, html, xhtml, html5 or auto, by the document's kind."""
        return self._map("doc_id long, source string", lambda i, d: [(i, _written(d, write, **options))])

    def canonical(self, exclusive: bool = False, comments: bool = False, inclusive_prefixes: tuple[str, ...] = ()) -> DataFrame:
        return self._map("doc_id long, source string", lambda i, d: [(i, S.canonical(d, exclusive, comments, inclusive_prefixes))])

    def transform(self, stylesheet: str | bytes | xslt.Stylesheet, params: Mapping[str, object] | None = None, resources: Mapping[str, bytes | str] | None = None) -> DataFrame:
        """(doc_id, source, messages, error): each document's XSLT result, written as the stylesheet says."""
        sheet = stylesheet if isinstance(stylesheet, xslt.Stylesheet) else xslt.compile_stylesheet(stylesheet, resources=resources)

        def rows(doc_id, doc):
            try:
                result, messages, _ = xslt.run(sheet, doc, params, resources)
                return [(doc_id, xslt.serialize(sheet, result), messages, None)]
            except (xslt.XsltError, evaluate.XPathError) as e:
                return [(doc_id, None, [], str(e))]

        return self._map("doc_id long, source string, messages array<string>, error string", rows)

    def include(self, resources: Mapping[str, bytes | str]) -> DataFrame:
        """(doc_id, source, error) after XInclude, with documents from a table of bounded size."""

        def rows(doc_id, doc):
            try:
                xinclude.process(doc, resources)
                return [(doc_id, _written(doc, "auto"), None)]
            except xinclude.IncludeError as e:
                return [(doc_id, None, str(e))]

        return self._map("doc_id long, source string, error string", rows)

    # -- validation ------------------------------------------------------
    def validate(self, schema: V.Schema | V.RelaxNG | None = None) -> DataFrame:
        """(doc_id, seq, message) for each error; documents without rows are valid.  Without a schema: the own DTD."""

        def rows(doc_id, doc):
            found = schema.validate(doc) if schema is not None else V.validate_dtd(doc)
            return [(doc_id, k, m) for k, m in enumerate(found, 1)]

        return self._map("doc_id long, seq int, message string", rows)


def _written(doc: Document, write: str, **options) -> str:
    if write == "auto":
        write = {"html5": "html5", "html4": "html", "fragment": "html5" if any(n.ns == "http://www.w3.org/1999/xhtml" for n in doc.node.children) else "xml"}.get(doc.kind, "xml")
    if write == "xml":
        return S.to_xml(doc, **options)
    if write == "html5":
        return S.to_html5(doc, **options)
    return S.to_html(doc, xhtml=write == "xhtml")


def build(df: DataFrame, record: Column, name: str, root: str, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Tables to markup: one document of element ``root`` for each group, with ``record`` as XML in order.

    ``record`` is a struct whose fields become elements, and fields that begin
    with ``_`` attributes.  Groups are gathered as one value each, so a group
    must fit a row.
    """
    keys = [F.col(c) for c in by or []]
    rows = df.select(*keys, F.struct(*[c.alias(f"_o{k}") for k, c in enumerate(order)], element(record, name, df).alias("_x")).alias("_r"))
    if keys:  # a number of its own keeps documents apart for the parsing that follows, however few bytes they have
        rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    parts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_r")).alias("_l"))
    return parts.select(*(by or []), F.concat(F.lit(f"<{root}>"), F.array_join(F.transform("_l", lambda r: r["_x"]), ""), F.lit(f"</{root}>")).alias("source"))


def element(record: Column, name: str, df: DataFrame) -> Column:
    """One struct as an element: ``_x`` fields as attributes, the others as child elements; nulls are left out."""
    fields = df.select(record.alias("r")).schema["r"].dataType.names
    attrs = [F.coalesce(F.concat(F.lit(f' {f[1:]}="'), escape_attribute(record[f].cast("string")), F.lit('"')), F.lit("")) for f in fields if f.startswith("_")]
    kids = [F.coalesce(F.concat(F.lit(f"<{f}>"), escape_text(record[f].cast("string")), F.lit(f"</{f}>")), F.lit("")) for f in fields if not f.startswith("_")]
    body = F.concat(*kids) if kids else F.lit("")
    return F.concat(F.lit(f"<{name}"), *attrs, F.when(body == "", F.lit("/>")).otherwise(F.concat(F.lit(">"), body, F.lit(f"</{name}>"))))


def escape_text(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_attribute(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


__all__ = ["Corpus", "NotRelational", "Node", "build", "element", "model", "xml"]
