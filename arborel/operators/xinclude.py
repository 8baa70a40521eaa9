"""XInclude: replaces include elements by other documents of a corpus."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import urljoin

from ..sources import xml
from ..tree import ELEMENT, TEXT, XML_NS, Document, Node
from .edit import pointer

XI = "http://www.w3.org/2001/XInclude"
XI_OLD = "http://www.w3.org/2003/XInclude"
MAX_DEPTH = 40


class IncludeError(ValueError):
    """A resource that is missing without a fallback, or includes itself."""


def process(document: Document, resources: Mapping[str, bytes | str], fix_base: bool = True, trail: tuple[str, ...] = ()) -> int:
    """Process all includes; returns how many were replaced.

    ``resources`` maps URIs (resolved against the document's) to contents.  A
    loop, or nesting beyond 40 documents, raises :class:`IncludeError`.
    """
    if len(trail) > MAX_DEPTH:
        raise IncludeError("includes nest too deeply")
    done = 0
    for node in [n for n in document.node.walk() if n.kind == ELEMENT and n.ns in (XI, XI_OLD) and n.local == "include"]:
        if any(a.kind == ELEMENT and a.ns in (XI, XI_OLD) and a.local == "include" for a in node.ancestors()) or node.root() is not document.node:
            continue
        new = _included(document, node, resources, fix_base, trail)
        parent, at = node.parent, node.index()
        node.unlink()
        for k, n in enumerate(new):
            parent.insert(at + k, n)
        done += 1
    document.number()
    return done


def _included(document: Document, node: Node, resources: Mapping[str, bytes | str], fix_base: bool, trail: tuple[str, ...]) -> list[Node]:
    href, parse, at = node.get("href") or "", node.get("parse") or "xml", node.get("xpointer")
    uri = urljoin(document.url or "", href) if href else ""
    source = resources.get(uri, resources.get(href)) if uri else None
    try:
        if not href and at:
            return [n.copy() for n in pointer(document, at)]
        if source is None:
            raise IncludeError(f"could not load {uri}")
        if parse == "text":
            text = source.decode(node.get("encoding") or "utf-8", "replace") if isinstance(source, bytes) else source
            return [Node(TEXT, "", text)]
        if uri in (*trail, document.url):
            raise RecursionError(f"{uri} includes itself")
        other = xml.parse(source, url=uri, options=xml.STRICT)
        process(other, resources, fix_base, (*trail, document.url or ""))
        found = pointer(other, at) if at else [n for n in other.node.children if n.kind != 10]
        out = [n.copy() for n in found]
        for n in out:
            if fix_base and n.kind == ELEMENT and n.get("base", XML_NS) is None:
                n.set("xml:base", href, XML_NS)
        return out
    except (IncludeError, xml.XmlSyntaxError) as e:
        fallback = next((c for c in node.children if c.kind == ELEMENT and c.ns == node.ns and c.local == "fallback"), None)
        if fallback is None:
            raise IncludeError(str(e)) from None
        inner = Document(fallback, url=document.url)
        fallback.parent = None
        process(inner, resources, fix_base, trail)
        return list(fallback.children)
    except RecursionError as e:
        raise IncludeError(str(e)) from None
