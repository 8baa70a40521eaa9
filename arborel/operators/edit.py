"""Transformations of trees: insertion, replacement, removal, wrapping, attributes, classes and namespaces.

On a corpus an edit is a function from one document's tree to another's; the
node table that comes out is numbered anew.  See ``corpus.Corpus.edit``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from ..plans import evaluate
from ..sources import html5, xml
from ..tree import ATTRIBUTE, COMMENT, ELEMENT, PI, TEXT, Document, Node


def coerce(document: Document, what) -> list[Node]:
    """Nodes from markup in the document's dialect, a node, a document or several of them."""
    if isinstance(what, str):
        if document.kind.startswith("html"):
            return list(html5.parse(what, context="body").node.children)
        return list(xml.parse_fragment(what, document.root.in_scope() if document.root else None).node.children)
    if isinstance(what, Node):
        return [what]
    if isinstance(what, Document):
        return list(what.node.children)
    return [n for x in what for n in coerce(document, x)]


def _merge(parent: Node) -> None:
    """Adjacent text nodes become one."""
    out: list[Node] = []
    for c in parent.children:
        if c.kind == TEXT and out and out[-1].kind == TEXT:
            out[-1].value += c.value
        else:
            out.append(c)
    parent.children = out


def add(document: Document, at: Node, what, where: str = "last") -> list[Node]:
    """Insert before, after, first or last; adjacent texts merge and prefixes stay bound."""
    nodes = coerce(document, what)
    parent = at.parent if where in ("before", "after") else at
    for n in nodes:
        n.unlink()
    k = {"before": lambda: at.index(), "after": lambda: at.index() + 1, "first": lambda: 0, "last": lambda: len(parent.children)}[where]()
    for i, n in enumerate(nodes):
        parent.insert(k + i, n)
        relink(n)
    _merge(parent)
    return nodes


def relink(node: Node) -> None:
    """Declare a namespace that a moved element or attribute needs and its new place doesn't bind."""
    for n in node.walk():
        if n.kind != ELEMENT:
            continue
        for x in (n, *n.attrs):
            if x.ns and (x.prefix or x is n) and n.lookup(x.prefix or "") != x.ns and x.prefix != "xml":
                n.decls = [(p, u) for p, u in n.decls if p != (x.prefix or "")] + [(x.prefix or "", x.ns)]


def replace(document: Document, at: Node, what) -> list[Node]:
    nodes = add(document, at, what, "before")
    remove(at)
    return nodes


def remove(node: Node) -> None:
    parent = node.parent
    node.unlink()
    if parent is not None and node.kind != ATTRIBUTE:
        _merge(parent)


def set_children(document: Document, node: Node, what) -> None:
    node.children = []
    add(document, node, what)


def set_content(node: Node, text: str) -> None:
    if node.kind == ELEMENT:
        node.children = []
        if text:
            node.append(Node(TEXT, "", text))
    else:
        node.value = text


def wrap(document: Document, node: Node, markup: str) -> Node:
    """Put the element of ``markup`` in the node's place and the node inside its innermost first element."""
    outer = coerce(document, markup)[0]
    node.parent.insert(node.index(), outer)
    inner = outer
    while any(c.kind == ELEMENT for c in inner.children):
        inner = next(c for c in inner.children if c.kind == ELEMENT)
    inner.append(node.unlink())
    return outer


def swap(a: Node, b: Node) -> None:
    pa, ia, pb, ib = a.parent, a.index(), b.parent, b.index()
    pa.children[ia], pb.children[ib] = b, a
    a.parent, b.parent = pb, pa


def rename(node: Node, name: str) -> None:
    prefix, _, local = name.rpartition(":")
    node.prefix, node.local = prefix or None, local


def remove_attribute(node: Node, name: str) -> None:
    node.attrs = [a for a in node.attrs if a.name != name]


def tokens(node: Node, name: str = "class") -> list[str]:
    return (node.get(name) or "").split()


def add_tokens(node: Node, new: str | Iterable[str], name: str = "class", repeat: bool = False) -> None:
    """Add tokens to a list attribute; those it has are skipped unless ``repeat``."""
    have, more = tokens(node, name), new.split() if isinstance(new, str) else list(new)
    node.set(name, " ".join(have + [t for t in more if repeat or t not in have]))


def remove_tokens(node: Node, old: str | Iterable[str] | None = None, name: str = "class") -> None:
    gone = set(tokens(node, name) if old is None else old.split() if isinstance(old, str) else old)
    left = [t for t in tokens(node, name) if t not in gone]
    if left:
        node.set(name, " ".join(left))
    else:
        remove_attribute(node, name)


def remove_namespaces(document: Document) -> None:
    for n in document.node.walk():
        n.ns = n.prefix = None
        n.decls = []
        for a in n.attrs:
            a.ns = a.prefix = None


def collect_namespaces(document: Document) -> dict[str, str]:
    """All declared prefixes of the document, written as their attributes are."""
    return {f"xmlns:{p}" if p else "xmlns": u for n in document.node.walk() for p, u in n.decls}


def node_path(node: Node) -> str:
    """The canonical location path of a node."""
    parts: list[str] = []
    n: Node | None = node
    while n is not None and n.parent is not None:
        if n.kind == ATTRIBUTE:
            parts.append(f"@{n.name}")
        else:
            test = {TEXT: "text()", COMMENT: "comment()", PI: f"processing-instruction('{n.local}')"}.get(n.kind, n.name if n.ns is None or n.prefix else "*")
            same = [c for c in n.parent.children if c.kind == n.kind and (n.kind not in (ELEMENT, PI) or (test == "*" and c.kind == ELEMENT) or c.name == n.name)]
            parts.append(test if len(same) == 1 else f"{test}[{next(i for i, c in enumerate(same, 1) if c is n)}]")
        n = n.parent
    return "/" + "/".join(reversed(parts))


def css_path(node: Node) -> str:
    """The same as a chain of child selectors."""
    return " > ".join(part.replace("[", ":nth-of-type(").replace("]", ")") for part in node_path(node)[1:].split("/"))


def pointer(document: Document, expression: str, namespaces: Mapping[str, str] | None = None) -> list[Node]:
    """XPointer: a shorthand id, or element(), xpointer() and xmlns() parts, the first that finds something."""
    import re

    bound = dict(namespaces or {})
    if not re.search(r"\(", expression):
        hit = document.by_id().get(expression)
        return [hit] if hit else []
    for scheme, body in re.findall(r"([\w:]+)\(((?:[^()^]|\^.|\([^()]*\))*)\)", expression):
        body = re.sub(r"\^(.)", r"\1", body)
        if scheme == "xmlns":
            p, _, u = body.partition("=")
            bound[p.strip()] = u.strip()
        elif scheme in ("xpointer", "xpath1"):
            found = evaluate.query(document, body, namespaces=bound)
            if isinstance(found, list) and found:
                return found
        elif scheme == "element":
            first, *steps = body.split("/")
            node: Node | None = document.by_id().get(first) if first else document.node
            for s in steps:
                elements = [c for c in node.children if c.kind == ELEMENT] if node is not None else []
                node = elements[int(s) - 1] if s.isdigit() and 0 < int(s) <= len(elements) else None
            if node is not None and node is not document.node:
                return [node]
    return []
