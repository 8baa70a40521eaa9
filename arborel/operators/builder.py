"""Building documents in Python: nested calls make nested elements.

    b = Builder()
    with b.tag("catalog", id="1"):
        b.tag("book", "text", lang="en")
    b.to_xml()
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from ..sources import xml
from ..tree import CDATA, COMMENT, DOCTYPE, DOCUMENT, ELEMENT, PI, TEXT, Document, Node
from . import serialize


class Builder:
    """Appends to the innermost open element; ``at`` continues an existing node."""

    def __init__(self, at: Node | None = None, encoding: str | None = None):
        self.document = Document(at.root() if at is not None else Node(DOCUMENT), encoding=encoding)
        self.parent = at if at is not None else self.document.node

    def tag(self, name: str, text: str | None = None, **attributes):
        """An element; names may carry a prefix, ``cls``/``id_`` and the like lose the underscore."""
        prefix, _, local = name.rpartition(":")
        node = self.parent.append(Node(ELEMENT, local, ns=None, prefix=prefix or None))
        for k, v in attributes.items():
            k = {"cls": "class"}.get(k, k.rstrip("_")).replace("__", ":")
            if k == "xmlns" or k.startswith("xmlns:"):
                node.decls.append((k[6:], v))
            else:
                node.set(k, str(v))
        node.ns = node.lookup(prefix)
        if prefix and node.ns is None:
            raise ValueError(f"Namespace {prefix} has not been defined")
        if text is not None:
            node.append(Node(TEXT, "", str(text)))
        return self._inside(node)

    @contextmanager
    def _inside(self, node: Node) -> Iterator[Node]:
        outer, self.parent = self.parent, node
        try:
            yield node
        finally:
            self.parent = outer

    def text(self, value: str) -> Builder:
        self.parent.append(Node(TEXT, "", value))
        return self

    def cdata(self, value: str) -> Builder:
        self.parent.append(Node(CDATA, "", value))
        return self

    def comment(self, value: str) -> Builder:
        self.parent.append(Node(COMMENT, "", value))
        return self

    def instruction(self, target: str, value: str = "") -> Builder:
        self.parent.append(Node(PI, target, value))
        return self

    def doctype(self, name: str, public: str | None = None, system: str | None = None) -> Builder:
        self.document.doctype = (name, public, system)
        self.document.node.insert(0, Node(DOCTYPE, name))
        return self

    def markup(self, source: str) -> Builder:
        """Parsed markup, with the namespaces in scope here."""
        scope = self.parent.in_scope() if self.parent.kind == ELEMENT else {}
        for n in list(xml.parse_fragment(source, scope).node.children):
            self.parent.append(n)
        return self

    def to_xml(self, indent: int = 0) -> str:
        return serialize.to_xml(self.document.number(), indent)

    def to_html(self) -> str:
        return serialize.to_html(self.document.number())
