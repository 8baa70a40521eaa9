"""Trees to markup: XML, XHTML, HTML and canonical XML."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

from ..sources.html5 import VOID
from ..tree import CDATA, COMMENT, DOCTYPE, DOCUMENT, ELEMENT, ENTITY_REF, FRAGMENT, HTML_NS, PI, TEXT, XML_NS, Document, Node

# Save options, as bits.
FORMAT, NO_DECLARATION, NO_EMPTY_TAGS, NO_XHTML, AS_XHTML, AS_XML, AS_HTML = 1, 2, 4, 8, 16, 32, 64

_RAW_TEXT = frozenset("style script xmp iframe noembed noframes plaintext noscript".split())
_BOOLEAN = frozenset("checked compact declare defer disabled ismap multiple nohref noresize noshade nowrap readonly selected".split())
_URI = frozenset("href action src".split())
_INLINE = frozenset("a abbr acronym b bdo big br cite code em font i img input kbd label q s samp select small span strike strong sub sup textarea tt u var".split())


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")


def escape_attribute(s: str) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    return s.replace("\t", "&#9;").replace("\n", "&#10;").replace("\r", "&#13;")


def limited(s: str, encoding: str | None) -> str:
    """Characters that an encoding lacks become numeric references."""
    if not encoding or encoding.lower().replace("-", "") in ("utf8", "utf16"):
        return s
    return s.encode(encoding, "xmlcharrefreplace").decode(encoding)


def _decls(n: Node) -> str:
    return "".join(f' xmlns{":" if p else ""}{p}="{escape_attribute(u)}"' for p, u in n.decls)


def to_xml(node: Node | Document, indent: int = 0, declaration: bool = True, no_empty_tags: bool = False, encoding: str | None = None) -> str:
    """XML; with ``indent`` elements that hold no text are laid out on lines."""
    out: list[str] = []
    if isinstance(node, Document):
        doc, node = node, node.node
        if declaration and node.kind == DOCUMENT:
            enc = encoding or doc.encoding
            alone = {1: ' standalone="yes"', 0: ' standalone="no"'}.get(doc.standalone, "")
            out.append(f'<?xml version="{doc.version or "1.0"}"' + (f' encoding="{enc}"' if enc else "") + f"{alone}?>\n")
        for c in node.children:
            if c.kind == DOCTYPE:
                out.append(_doctype(doc))
            else:
                _write(c, out, indent, 0, no_empty_tags)
            if node.kind == DOCUMENT:
                out.append("\n")
        return limited("".join(out), encoding)
    _write(node, out, indent, 0, no_empty_tags)
    return limited("".join(out), encoding)


def _doctype(doc: Document) -> str:
    name, public, system = doc.doctype or ("", None, None)
    ids = f' PUBLIC "{public}" "{system or ""}"' if public is not None else f' SYSTEM "{system}"' if system is not None else ""
    return f"<!DOCTYPE {name}{ids}>"


def _write(node: Node, out: list[str], indent: int, level: int, no_empty: bool) -> None:
    # An explicit stack: (node, level, whether it is laid out) or text to write.
    stack: list = [(node, level, indent > 0)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        n, depth, lay = item
        if n.kind == TEXT:
            out.append(escape_text(n.value))
        elif n.kind == CDATA:
            out.append("<![CDATA[" + n.value.replace("]]>", "]]]]><![CDATA[>") + "]]>")
        elif n.kind == COMMENT:
            out.append(f"<!--{n.value}-->")
        elif n.kind == PI:
            out.append(f"<?{n.local} {n.value}?>" if n.value else f"<?{n.local}?>")
        elif n.kind == ENTITY_REF:
            out.append(f"&{n.local};")
        elif n.kind in (DOCUMENT, FRAGMENT):
            stack.extend((c, depth, lay) for c in reversed(n.children))
        elif n.kind == ELEMENT:
            out.append(f"<{n.name}{_decls(n)}" + "".join(f' {a.name}="{escape_attribute(a.value)}"' for a in n.attrs))
            if not n.children and not no_empty:
                out.append("/>")
                continue
            out.append(">")
            inner = lay and not any(c.kind in (TEXT, CDATA, ENTITY_REF) for c in n.children)
            parts: list = []
            for c in n.children:
                if inner:
                    parts.append("\n" + " " * indent * (depth + 1))
                parts.append((c, depth + 1, inner))
            if inner and n.children:
                parts.append("\n" + " " * indent * depth)
            parts.append(f"</{n.name}>")
            stack.extend(reversed(parts))


def to_html(node: Node | Document, xhtml: bool = False) -> str:
    """HTML 4 rules: void elements, minimised boolean attributes, escaped URIs, raw script and style."""
    out: list[str] = []

    def visit(n: Node, raw: bool) -> None:
        if n.kind in (TEXT, CDATA):
            out.append(n.value if raw else escape_text(n.value))
        elif n.kind == COMMENT:
            out.append(f"<!--{n.value}-->")
        elif n.kind == PI:
            out.append(f"<?{n.local} {n.value}>")
        elif n.kind in (DOCUMENT, FRAGMENT):
            for c in n.children:
                visit(c, False)
        elif n.kind == ELEMENT:
            out.append(f"<{n.name}{_decls(n)}")
            for a in n.attrs:
                if a.local in _BOOLEAN and not xhtml and a.ns is None:
                    out.append(f" {a.name}")
                    continue
                v = a.value
                if a.local in _URI or (a.local == "name" and n.local == "a"):
                    v = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), v.strip())
                out.append(f' {a.name}="{escape_attribute(v) if xhtml else _html_attribute(v)}"')
            if n.local in VOID and not n.children:
                out.append(" />" if xhtml else ">")
                return
            out.append(">")
            for c in n.children:
                visit(c, n.local in ("script", "style") and not xhtml)
            out.append(f"</{n.name}>")

    if isinstance(node, Document):
        if node.doctype:
            out.append(_doctype(node) + "\n")
        node = node.node
    visit(node, False)
    return "".join(out)


def _html_attribute(v: str) -> str:
    return v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def to_html5(node: Node | Document, preserve_newline: bool = False) -> str:
    """The WHATWG fragment serialisation of a node and what it holds."""
    out: list[str] = []
    root = node.node if isinstance(node, Document) else node
    stack: list = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind in (TEXT, CDATA):
            parent = n.parent
            raw = parent is not None and parent.kind == ELEMENT and parent.ns in (HTML_NS, None) and parent.local in _RAW_TEXT - {"noscript"}
            out.append(n.value if raw else n.value.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif n.kind == COMMENT:
            out.append(f"<!--{n.value}-->")
        elif n.kind == PI:
            out.append(f"<?{n.local} {n.value}>")
        elif n.kind == DOCTYPE:
            out.append(f"<!DOCTYPE {n.local}>")
        elif n.kind == ELEMENT:
            out.append(f"<{n.local}" + "".join(f' {a.name}="{_html5_attribute(a.value)}"' for a in n.attrs) + ">")
            if n.ns in (HTML_NS, None) and n.local in VOID:
                continue
            first = n.children[0] if n.children else None
            if preserve_newline and n.local in ("pre", "textarea", "listing") and first is not None and first.kind == TEXT and first.value.startswith("\n"):
                out.append("\n")
            stack.append(f"</{n.local}>")
            stack.extend(reversed(n.children))
        else:
            stack.extend(reversed(n.children))
    return "".join(out)


def _html5_attribute(v: str) -> str:
    return v.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


def canonical(
    node: Node | Document,
    exclusive: bool = False,
    comments: bool = False,
    inclusive_prefixes: Collection[str] = (),
    keep: Callable[[Node], bool] | None = None,
    version_1_1: bool = False,
) -> str:
    """Canonical XML 1.0 or 1.1, or exclusive canonical XML; ``keep`` leaves out nodes for which it is false."""
    root = node.node if isinstance(node, Document) else node
    out: list[str] = []
    text = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#xD;")
    attr = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;").replace("\t", "&#x9;").replace("\n", "&#xA;").replace("\r", "&#xD;")

    def visit(n: Node, shown: dict[str, str], above: dict[str, str] | None = None) -> None:
        # above: the namespaces in scope of the parent, from which an element's own follow without its ancestors.
        visible = keep is None or keep(n)
        if n.kind in (DOCUMENT, FRAGMENT):
            before = True
            for c in n.children:
                if c.kind == ELEMENT:
                    before = False
                    visit(c, shown)
                elif c.kind in (PI, COMMENT) and (c.kind == PI or comments):
                    mark: list[str] = []
                    size = len(out)
                    visit(c, shown)
                    if len(out) > size:
                        mark = out[size:]
                        del out[size:]
                        out.append("".join(mark) + "\n" if before else "\n" + "".join(mark))
                elif n.kind == FRAGMENT:
                    visit(c, shown)
        elif n.kind in (TEXT, CDATA):
            if visible:
                out.append(text(n.value))
        elif n.kind == COMMENT:
            if comments and visible:
                out.append(f"<!--{n.value.replace(chr(13), '&#xD;')}-->")
        elif n.kind == PI:
            if visible:
                out.append(f"<?{n.local}{' ' + n.value if n.value else ''}?>")
        elif n.kind == ELEMENT:
            scope = n.in_scope() if above is None else above if not n.decls else {p: u for p, u in (above | dict(n.decls) | {"xml": XML_NS}).items() if u}
            if not visible:
                for c in n.children:
                    visit(c, shown, scope)
                return
            if exclusive:
                used = {n.prefix or ""} | {a.prefix for a in n.attrs if a.prefix} | set(inclusive_prefixes)
            else:
                used = set(scope) | ({""} if shown.get("") else set())
            used.discard("xml")
            new = {p: scope.get(p, "") for p in used if shown.get(p, "") != scope.get(p, "") and (p == "" or p in scope)}
            inner = {**shown, **new}
            attrs = [(a.ns or "", a.local, a.name, a.value) for a in n.attrs]
            if not exclusive and n is root:
                # xml: attributes of ancestors that aren't there come down, save xml:id in version 1.1.
                have = {(a.ns, a.local) for a in n.attrs}
                for up in n.ancestors():
                    for a in up.attrs:
                        if a.ns == XML_NS and (a.ns, a.local) not in have and not (version_1_1 and a.local == "id"):
                            have.add((a.ns, a.local))
                            attrs.append((a.ns, a.local, a.name, a.value))
            out.append(f"<{n.name}")
            for p, u in sorted(new.items()):
                out.append(f' xmlns{":" if p else ""}{p}="{attr(u)}"')
            for _, _, name, value in sorted(attrs):
                out.append(f' {name}="{attr(value)}"')
            out.append(">")
            for c in n.children:
                visit(c, inner, scope)
            out.append(f"</{n.name}>")

    visit(root, {})
    return "".join(out)
