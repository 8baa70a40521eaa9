"""HTML 4 parsing: the same tokens as HTML 5, a simpler repair.

Missing html, head, body and p elements are added, elements end where the next
one cannot stand inside them, and an end tag closes what it outranks.
"""

from __future__ import annotations

import re

from ..tree import COMMENT, DOCTYPE, DOCUMENT, ELEMENT, FRAGMENT, TEXT, Document, Node
from .html5 import _ATTR, _LOWER, unescape

# Elements of HTML 4 by their role.
VOID = frozenset("area base basefont br col embed frame hr img input isindex link meta param".split())
HEAD = frozenset("base basefont isindex link meta script style title noscript object".split())
RAW = frozenset("script style".split())
BLOCK = frozenset(
    "address blockquote center dd dir div dl dt fieldset form h1 h2 h3 h4 h5 h6 hr li menu noframes ol p pre table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends open elements of the values.
CLOSES = {
    "head": ("p",), "body": ("head",), "li": ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li"), "dd": ("p", "dt", "dd"), "dt": ("p", "dt", "dd"),
    "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("td", "th", "tr", "caption", "col", "colgroup", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "tbody": ("td", "th", "tr", "caption", "col", "colgroup", "thead", "tfoot", "tbody", "p"), "thead": ("caption", "col", "colgroup"),
    "tfoot": ("td", "th", "tr", "caption", "col", "colgroup", "thead", "tbody", "p"), "colgroup": ("caption", "colgroup", "col", "p"), "a": ("a",),
}
#: An end tag does not reach past an open element of higher rank.
RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}

_TOKEN = re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<!(?P<doctype>doctype[^>]*)(?:>|\Z)|<[!?](?P<other>[^>]*)(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<start>[a-zA-Z][^\s/>]*)", re.S | re.I)


def rank(name: str) -> int:
    return RANK.get(name, 10 if name == "p" else 100)


class _Builder:
    def __init__(self) -> None:
        self.doc = Document(Node(DOCUMENT), "html4")
        self.open: list[Node] = [self.doc.node]

    def names(self) -> list[str]:
        return [n.local for n in self.open[1:]]

    def push(self, name: str, attrs: dict[str, str] | None = None) -> None:
        node = self.open[-1].append(Node(ELEMENT, name))
        for k, v in (attrs or {}).items():
            node.set(k, v)
        if name not in VOID:
            self.open.append(node)

    def imply(self, name: str) -> None:
        """Open html, head, body and p where ``name`` ("" for text) needs them."""
        if name == "html" or (not name and self.open[-1].local in ("title", "script", "style", "object")):
            return
        if not self.names():
            self.push("html")
        names = self.names()
        if name in ("head", "body", "frameset"):
            return
        if "body" in names or "frameset" in names:
            if not name and names[-1] == "body":
                self.push("p")
            return
        if "head" in names:
            if name in HEAD:
                return
            while self.open[-1].local != "head":
                self.open.pop()
            self.open.pop()
        elif name in HEAD and not any(c.local in ("body", "head") for c in self.open[1].children):
            self.push("head")
            return
        self.push("body")
        if not name:
            self.push("p")

    def start(self, name: str, attrs: dict[str, str]) -> None:
        closes = CLOSES.get(name, ("p", "head") if name in BLOCK else ())
        while len(self.open) > 1 and self.open[-1].local in closes:
            self.open.pop()
        names = self.names()
        if name in ("html", "body") and name in names:
            node = self.open[1 + names.index(name)]
            for k, v in attrs.items():
                if node.get(k) is None:
                    node.set(k, v)
            return
        if name == "head" and "head" in names:
            return
        if name in BLOCK and name != "p" and self.open[-1].local == "p":
            self.open.pop()
        self.imply(name)
        self.push(name, attrs)

    def end(self, name: str) -> None:
        names = self.names()
        if name == "p" and "p" not in names:
            self.start("p", {})
            names = self.names()
        if name not in names or name in ("html", "body"):
            return
        for k in range(len(names) - 1, -1, -1):
            if names[k] == name:
                del self.open[k + 1 :]
                return
            if rank(names[k]) > rank(name):
                return

    def text(self, data: str) -> None:
        if not data.strip(" \t\r\n"):
            if len(self.open) < 3 or self.open[-1].local == "head" or not self.open[-1].children and self.open[-1].local in ("html", "body"):
                return
        else:
            self.imply("")
        last = self.open[-1].children[-1] if self.open[-1].children else None
        if last is not None and last.kind == TEXT:
            last.value += data
        else:
            self.open[-1].append(Node(TEXT, "", data))


def parse(source: str, url: str | None = None) -> Document:
    """Parse a document; every input gives a tree."""
    b, at, s = _Builder(), 0, source.removeprefix("﻿")
    doc = b.doc
    doc.url = url
    while at < len(s):
        m = _TOKEN.search(s, at)
        data = s[at : m.start() if m else len(s)]
        if data:
            b.text(unescape(data))
        if not m:
            break
        at = m.end()
        if m["comment"] is not None:
            b.open[-1].append(Node(COMMENT, "", m["comment"]))
        elif m["doctype"] is not None:
            parts = re.findall(r"\"([^\"]*)\"|'([^']*)'|([^\s\"']+)", m["doctype"][7:])
            words = [a or x or c for a, x, c in parts]
            ids = [a or x for a, x, c in parts if not c]
            public = ids[0] if len(words) > 1 and words[1].lower() == "public" and ids else None
            system = (ids[1] if len(ids) > 1 else None) if public is not None else ids[0] if ids else None
            doc.doctype = (words[0] if words else "", public, system)
            doc.node.append(Node(DOCTYPE, doc.doctype[0]))
        elif m["end"] is not None:
            b.end(m["end"].translate(_LOWER))
        elif m["start"] is not None:
            name, attrs = m["start"].translate(_LOWER), {}
            while at < len(s):
                a = _ATTR.match(s, at)
                at = a.end() if a.end() > at else at + 1
                if a["end"]:
                    break
                if a["name"]:
                    attrs.setdefault(a["name"].translate(_LOWER), unescape(next((a[g] for g in ("dq", "sq", "uq") if a[g] is not None), ""), True))
            b.start(name, attrs)
            if name in RAW:
                end = re.compile(rf"</{name}", re.I).search(s, at)
                stop = end.start() if end else len(s)
                if stop > at:
                    b.open[-1].append(Node(TEXT, "", s[at:stop]))
                at = stop
    return doc.number()


def parse_fragment(source: str) -> Document:
    """What stands in the body that ``source`` would make; the body itself if it is given."""
    doc = parse(source if re.match(r"\s*<body", source, re.I) else f"<html><body>{source}")
    body = next((n for n in doc.node.walk() if n.local == "body"), None)
    doc.node = Node(FRAGMENT)
    if body is not None:
        for c in [body] if re.match(r"\s*<body", source, re.I) else body.children:
            doc.node.append(c)
    doc.kind = "fragment"
    return doc.number()
