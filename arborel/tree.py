"""Ordered labelled trees: what parsers build in a task and what per-document operators work on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

# Node kinds.
ELEMENT, ATTRIBUTE, TEXT, CDATA, ENTITY_REF, PI, COMMENT, DOCUMENT, DOCTYPE, FRAGMENT, NAMESPACE = 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 18
XML_NS = "http://www.w3.org/XML/1998/namespace"
XMLNS_NS = "http://www.w3.org/2000/xmlns/"
HTML_NS = "http://www.w3.org/1999/xhtml"
SVG_NS = "http://www.w3.org/2000/svg"
MATH_NS = "http://www.w3.org/1998/Math/MathML"
XLINK_NS = "http://www.w3.org/1999/xlink"


class Node:
    """A node; an attribute or namespace node has an owner as its parent but is no child of it."""

    __slots__ = ("kind", "local", "prefix", "ns", "value", "attrs", "decls", "children", "parent", "pre", "size", "line", "is_id", "at")

    def __init__(self, kind: int, local: str = "", value: str = "", ns: str | None = None, prefix: str | None = None):
        self.kind, self.local, self.value, self.ns, self.prefix = kind, local, value, ns, prefix
        self.attrs: list[Node] = []
        self.decls: list[tuple[str, str]] = []  # (prefix or "", uri)
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.pre = self.size = self.line = self.at = 0
        self.is_id = False

    @property
    def name(self) -> str:
        return f"{self.prefix}:{self.local}" if self.prefix else self.local

    def __repr__(self) -> str:
        return f"<{self.kind}:{self.name}:{self.value[:20]!r}>"

    # -- reading ---------------------------------------------------------
    def get(self, local: str, ns: str | None = None) -> str | None:
        for a in self.attrs:
            if a.local == local and a.ns == ns:
                return a.value
        return None

    def walk(self) -> Iterator[Node]:
        """Self and descendants in document order, without recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def preorder(self) -> list[Node]:
        """What :meth:`walk` gives, as a list."""
        out: list[Node] = []
        stack = [self]
        take, put, more = stack.pop, out.append, stack.extend
        while stack:
            n = take()
            put(n)
            if n.children:
                more(n.children[::-1])
        return out

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def text(self) -> str:
        """The string-value."""
        if self.kind in (ELEMENT, DOCUMENT, FRAGMENT, ENTITY_REF):
            if len(self.children) < 2:
                if not self.children:
                    return ""
                only = self.children[0]
                if only.kind == TEXT or only.kind == CDATA:
                    return only.value
            return "".join([n.value for n in self.preorder() if n.kind == TEXT or n.kind == CDATA])
        return self.value

    def root(self) -> Node:
        n = self
        while n.parent is not None:
            n = n.parent
        return n

    def lookup(self, prefix: str) -> str | None:
        """Namespace that ``prefix`` ("" for the default) is bound to here."""
        if prefix == "xml":
            return XML_NS
        n: Node | None = self
        while n is not None:
            for p, uri in n.decls:
                if p == prefix:
                    return uri or None
            n = n.parent
        return None

    def in_scope(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for n in (self, *self.ancestors()):
            for p, uri in n.decls:
                found.setdefault(p, uri)
        return {"xml": XML_NS} | {p: u for p, u in sorted(found.items()) if u}

    # -- writing ---------------------------------------------------------
    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def insert(self, at: int, child: Node) -> Node:
        child.parent = self
        self.children.insert(at, child)
        return child

    def index(self) -> int:
        """The node's place among its parent's children; all places are noted at once, so asking each child takes linear time."""
        among = self.parent.children
        if not (self.at < len(among) and among[self.at] is self):
            for i, c in enumerate(among):
                c.at = i
            if not (self.at < len(among) and among[self.at] is self):
                raise ValueError("the node is no child of its parent")
        return self.at

    def unlink(self) -> Node:
        if self.parent is not None:
            if self.kind == ATTRIBUTE:
                self.parent.attrs = [a for a in self.parent.attrs if a is not self]
            else:
                del self.parent.children[self.index()]
            self.parent = None
        return self

    def set(self, name: str, value: str, ns: str | None = None) -> Node:
        prefix, _, local = name.rpartition(":")
        for a in self.attrs:
            if a.local == local and a.ns == ns:
                a.value = value
                return a
        a = Node(ATTRIBUTE, local, value, ns, prefix or None)
        a.parent = self
        self.attrs.append(a)
        return a

    def copy(self, deep: bool = True) -> Node:
        n = Node(self.kind, self.local, self.value, self.ns, self.prefix)
        n.decls, n.line, n.is_id = list(self.decls), self.line, self.is_id
        for a in self.attrs:
            b = Node(ATTRIBUTE, a.local, a.value, a.ns, a.prefix)
            b.parent, b.is_id = n, a.is_id
            n.attrs.append(b)
        if deep:
            for c in self.children:
                n.append(c.copy())
        return n


@dataclass
class Document:
    """A parsed document; ``node`` is its root node of kind DOCUMENT or FRAGMENT."""

    node: Node
    kind: str = "xml"  # xml, html4, html5, fragment
    quirks: int = 0  # 0 none, 1 quirks, 2 limited
    version: str | None = None
    encoding: str | None = None
    standalone: int = -1
    url: str | None = None
    doctype: tuple[str, str | None, str | None] | None = None
    dtd: "Dtd | None" = None
    errors: list[tuple[int, str]] = field(default_factory=list)  # (line, message)

    def number(self) -> Document:
        """Assign preorder ranks and subtree sizes; attributes have their owner's rank."""
        order = self.node.preorder()
        for k, n in enumerate(order):
            n.pre, n.size = k, 0
            for a in n.attrs:
                a.pre = k
        for n in reversed(order):
            up = n.parent
            if up is not None:
                up.size += n.size + 1
        return self

    @property
    def root(self) -> Node | None:
        return next((c for c in self.node.children if c.kind == ELEMENT), None)

    def by_id(self) -> dict[str, Node]:
        found: dict[str, Node] = {}
        html = self.kind.startswith("html")
        for n in self.node.walk():
            for a in n.attrs:
                if a.is_id or (a.local == "id" and (a.ns == XML_NS or (html and a.ns is None))):
                    found.setdefault(a.value, n)
        return found


@dataclass
class Dtd:
    """Declarations of a document type."""

    name: str = ""
    public_id: str | None = None
    system_id: str | None = None
    elements: dict[str, tuple] = field(default_factory=dict)  # name -> content model
    attributes: dict[tuple[str, str], tuple[str, str | None, bool]] = field(default_factory=dict)  # (element, name) -> type, default, required
    entities: dict[str, tuple[str | None, str | None, str | None, str | None]] = field(default_factory=dict)  # value, system, public, notation
    notations: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
