"""The head of an HTML document: its title and the encoding that it declares."""

from __future__ import annotations

import re

from ..tree import ELEMENT, HTML_NS, TEXT, Document, Node


def _named(document: Document, name: str) -> list[Node]:
    return [n for n in document.node.walk() if n.kind == ELEMENT and n.local == name and n.ns in (None, HTML_NS)]


def _make(document: Document, name: str) -> Node:
    return Node(ELEMENT, name, ns=document.root.ns if document.root is not None else None)


def title(document: Document) -> str | None:
    """The text of the first title element, or None."""
    found = _named(document, "title")
    return found[0].text() if found else None


def set_title(document: Document, text: str) -> None:
    """Change the title; where there is none, one is made after the declared encoding, in the head, or in a new head."""
    found = _named(document, "title")
    if found:
        node = found[0]
        node.children = []
    else:
        node = _make(document, "title")
        meta = _content_type(document) or next((m for m in _named(document, "meta") if m.get("charset") is not None), None)
        if meta is not None:
            meta.parent.insert(meta.index() + 1, node)
        else:
            _head(document).append(node)
    node.append(Node(TEXT, "", text))
    document.number()


def _head(document: Document) -> Node:
    found = _named(document, "head")
    if found:
        return found[0]
    if document.root is None:
        document.node.append(Node(ELEMENT, "html", ns=HTML_NS if document.kind == "html5" else None))
    head = _make(document, "head")
    document.root.insert(0, head)
    return head


def _content_type(document: Document) -> Node | None:
    return next((m for m in _named(document, "meta") if (m.get("http-equiv") or "").lower() == "content-type" and m.get("content")), None)


def meta_encoding(document: Document) -> str | None:
    """The encoding that a meta element declares, or None."""
    charset = next((m.get("charset") for m in _named(document, "meta") if m.get("charset") is not None), None)
    if charset is not None:
        return charset
    meta = _content_type(document)
    m = re.search(r"charset\s*=\s*([\w-]+)", meta.get("content"), re.I) if meta is not None else None
    return m[1] if m else None


def set_meta_encoding(document: Document, encoding: str) -> None:
    """Declare an encoding: where one is declared, else first in the head."""
    charset = next((m for m in _named(document, "meta") if m.get("charset") is not None), None)
    content = _content_type(document)
    if charset is not None:
        charset.set("charset", encoding)
    elif content is not None:
        content.set("content", f"text/html; charset={encoding}")
    else:
        meta = _make(document, "meta")
        if document.kind == "html5" or document.doctype is not None and document.doctype[0] == "html" and document.doctype[1] is None:
            meta.set("charset", encoding)
        else:
            meta.set("http-equiv", "Content-Type")
            meta.set("content", f"text/html; charset={encoding}")
        _head(document).insert(0, meta)
    document.number()
