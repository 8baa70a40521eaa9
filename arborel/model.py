"""The relational form of parsed documents.

``nodes`` has a row for each node with preorder rank ``pre``, subtree ``size``,
``level`` and ``parent``, so that every XPath axis is an equality on ``doc_id``
with a range or equality on these columns.  Attributes stay with their element,
in order; ``attrs`` and ``decls`` are exploded where a query asks for them.
"""

from __future__ import annotations

from pyspark.sql import types as T

from .tree import CDATA, ELEMENT, TEXT, Document

_ATTR = T.StructType([T.StructField("ns_uri", T.StringType()), T.StructField("prefix", T.StringType()), T.StructField("local", T.StringType(), False), T.StructField("value", T.StringType(), False), T.StructField("is_id", T.BooleanType(), False)])
_DECL = T.StructType([T.StructField("prefix", T.StringType(), False), T.StructField("uri", T.StringType(), False)])

NODES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("pre", T.IntegerType(), False),
        T.StructField("size", T.IntegerType(), False),
        T.StructField("level", T.IntegerType(), False),
        T.StructField("parent", T.IntegerType()),
        T.StructField("kind", T.IntegerType(), False),
        T.StructField("ns_uri", T.StringType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("local", T.StringType(), False),
        T.StructField("value", T.StringType()),  # of text, cdata, comment and processing instruction
        T.StructField("sib", T.IntegerType(), False),  # place among siblings, from 1
        T.StructField("esib", T.IntegerType()),  # place among element siblings, from 1
        T.StructField("line", T.IntegerType(), False),
        T.StructField("text", T.StringType()),  # string-value of an element, if no longer than the cap
        T.StructField("attrs", T.ArrayType(_ATTR, False), False),
        T.StructField("decls", T.ArrayType(_DECL, False), False),
    ]
)
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("kind", T.StringType(), False),
        T.StructField("quirks", T.IntegerType(), False),
        T.StructField("version", T.StringType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("standalone", T.IntegerType(), False),
        T.StructField("url", T.StringType()),
        T.StructField("doctype", T.StructType([T.StructField("name", T.StringType()), T.StructField("public_id", T.StringType()), T.StructField("system_id", T.StringType())])),
        T.StructField("n_nodes", T.IntegerType(), False),
        T.StructField("errors", T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("message", T.StringType())]), False), False),
    ]
)


def node_rows(doc_id: int | None, doc: Document, text_cap: int = 4096) -> list[tuple]:
    """Rows of NODES in document order."""
    out: list[tuple] = []
    place: dict[int, tuple[int, int | None]] = {}
    level: dict[int, int] = {}
    lengths: dict[int, int] = {}
    order = doc.node.preorder()
    for n in reversed(order):  # length of each string-value, children before parents
        own = len(n.value) if n.kind in (TEXT, CDATA) else lengths.get(id(n), 0)
        if n.parent is not None:
            lengths[id(n.parent)] = lengths.get(id(n.parent), 0) + own
    for n in order:
        elements = 0
        for k, c in enumerate(n.children, 1):
            elements += c.kind == ELEMENT
            place[id(c)] = (k, elements if c.kind == ELEMENT else None)
        level[id(n)] = 0 if n.parent is None else level[id(n.parent)] + 1
        sib, esib = place.get(id(n), (1, None))
        text = n.text() if n.kind == ELEMENT and lengths.get(id(n), 0) <= text_cap else None
        attrs = [{"ns_uri": a.ns, "prefix": a.prefix, "local": a.local, "value": a.value, "is_id": a.is_id} for a in n.attrs]
        decls = [{"prefix": p, "uri": u} for p, u in n.decls]
        value = None if n.kind == ELEMENT else n.value
        out.append((doc_id, n.pre, n.size, level[id(n)], None if n.parent is None else n.parent.pre, n.kind, n.ns, n.prefix, n.local, value, sib, esib, n.line, text, attrs, decls))
    return out


def doc_row(doc_id: int | None, doc: Document) -> tuple:
    kind = {"name": doc.doctype[0], "public_id": doc.doctype[1], "system_id": doc.doctype[2]} if doc.doctype else None
    errors = [{"line": line, "message": message} for line, message in doc.errors]
    return (doc_id, doc.kind, doc.quirks, doc.version, doc.encoding, doc.standalone, doc.url, kind, doc.node.size, errors)
