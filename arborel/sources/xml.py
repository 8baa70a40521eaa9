"""XML parsing: a strict lane on expat and a recovering lane for what isn't well-formed."""

from __future__ import annotations

import re
from collections.abc import Mapping
from xml.parsers import expat

from ..tree import ATTRIBUTE, CDATA, COMMENT, DOCTYPE, DOCUMENT, ELEMENT, ENTITY_REF, FRAGMENT, PI, TEXT, XML_NS, Document, Dtd, Node

# Parse options, as bits.
RECOVER, NOENT, DTDLOAD, DTDATTR, DTDVALID, NOERROR, NOWARNING, PEDANTIC = 1, 2, 4, 8, 16, 32, 64, 128
NOBLANKS, SAX1, XINCLUDE, NONET, NODICT, NSCLEAN, NOCDATA = 256, 512, 1024, 2048, 4096, 8192, 16384
NOXINCNODE, COMPACT, OLD10, NOBASEFIX, HUGE, BIG_LINES = 32768, 65536, 131072, 262144, 524288, 4194304
DEFAULT_XML = RECOVER | NONET | BIG_LINES
DEFAULT_XSLT = RECOVER | NONET | NOENT | DTDLOAD | DTDATTR | NOCDATA | BIG_LINES
STRICT = 0

_BLANK = " \t\r\n"


class XmlSyntaxError(ValueError):
    """Input that isn't well-formed, in strict mode."""

    def __init__(self, message: str, line: int):
        super().__init__(f"{line}: {message}")
        self.line, self.message = line, message


def sniff(data: bytes) -> str:
    """Encoding of XML bytes by byte-order mark, first bytes or declaration."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return name
    for start, name in ((b"<\0?\0", "utf-16-le"), (b"\0<\0?", "utf-16-be"), (b"<\0\0\0", "utf-32-le"), (b"\0\0\0<", "utf-32-be")):
        if data.startswith(start):
            return name
    if data.startswith(b"\x4c\x6f\xa7\x94"):
        return "cp037"
    m = re.match(rb"<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z][A-Za-z0-9._-]*)", data[:1024])
    return m[1].decode() if m else "utf-8"


def decode(data: bytes, encoding: str | None = None) -> str:
    try:
        return data.decode(encoding or sniff(data), "replace").removeprefix("﻿")
    except LookupError:
        return data.decode("utf-8", "replace")


class _Builder:
    """Builds a document from parser events and resolves names against declared namespaces."""

    def __init__(self, options: int):
        self.doc = Document(Node(DOCUMENT))
        self.at = self.doc.node
        self.options = options
        self.in_cdata = False
        self._open_cdata: Node | None = None
        self.scopes: list[dict[str, str]] = [{"xml": XML_NS}]

    def error(self, line: int, what: str) -> None:
        self.doc.errors.append((line, what))

    def start(self, name: str, attrs: list[tuple[str, str, bool]], line: int) -> Node:
        """attrs: name, value, whether it is a default of the document type."""
        scope = self.scopes[-1]
        decls = [(a[6:], v) for a, v, _ in attrs if a == "xmlns" or a.startswith("xmlns:")]
        if self.options & NSCLEAN:  # what an ancestor declares alike is redundant
            decls = [(p, u) for p, u in decls if scope.get(p, "") != u]
        if decls:
            scope = {**scope, **dict(decls)}
        self.scopes.append(scope)
        prefix, local, ns = self._name(name, scope, line, True)
        node = Node(ELEMENT, local, ns=ns, prefix=prefix)
        node.decls, node.line = decls, line
        seen = set()
        for a, v, _ in attrs:
            if ":" not in a:
                if a == "xmlns":
                    continue
                prefix, local, ns = None, a, None
            elif a.startswith("xmlns:"):
                continue
            else:
                prefix, local, ns = self._name(a, scope, line, False)
            if (ns, local) in seen:
                self.error(line, f"Attribute {a} redefined")
                continue
            seen.add((ns, local))
            x = Node(ATTRIBUTE, local, v, ns, prefix)
            x.parent = node
            x.is_id = ns == XML_NS and local == "id"
            node.attrs.append(x)
        self.at.append(node)
        self.at = node
        return node

    def _name(self, name: str, scope: Mapping[str, str], line: int, default: bool) -> tuple[str | None, str, str | None]:
        prefix, colon, local = name.partition(":")
        if not colon:
            return None, name, (scope.get("") or None) if default else None
        if prefix in scope:
            return prefix, local, scope[prefix] or None
        self.error(line, f"Namespace prefix {prefix} on {local} is not defined")
        return None, name, None

    def end(self) -> None:
        self.at = self.at.parent
        self.scopes.pop()

    def text(self, data: str) -> None:
        if not data or self.at.kind == DOCUMENT:
            return
        kind = CDATA if self.in_cdata and not self.options & NOCDATA else TEXT
        among = self.at.children
        last = among[-1] if among else None
        if last is not None and last.kind == kind and (kind == TEXT or self._open_cdata is last):
            last.value += data
        else:
            node = Node(kind, "", data)
            node.parent = self.at
            among.append(node)
            self._open_cdata = node if kind == CDATA else None

    def finish(self) -> Document:
        doc = self.doc
        if doc.dtd is not None:
            ids = {k for k, (kind, _, _) in doc.dtd.attributes.items() if kind == "ID"}
            for n in doc.node.walk() if ids else ():
                for a in n.attrs:
                    a.is_id |= (n.name, a.name) in ids
        if self.options & NOBLANKS:
            drop_blanks(doc.node)
        return doc.number()


def drop_blanks(node: Node) -> None:
    """Remove blank text between elements; text in mixed content stays."""
    for n in list(node.walk()):
        if any(c.kind == ELEMENT for c in n.children) and all(c.kind != TEXT or not c.value.strip(_BLANK) for c in n.children):
            n.children = [c for c in n.children if c.kind != TEXT]


def parse(source: str | bytes, options: int = DEFAULT_XML, url: str | None = None, encoding: str | None = None, resources: Mapping[str, bytes] | None = None) -> Document:
    """Parse a document.

    Strictly well-formed input takes the fast lane.  Other input raises
    :class:`XmlSyntaxError` unless ``RECOVER`` is set; then it is repaired and
    the errors are kept.  Empty input gives an empty document when recovering.
    ``resources`` maps system identifiers to bytes; nothing else is ever loaded,
    so NONET always holds.  XINCLUDE includes from ``resources`` (NOBASEFIX
    leaves xml:base alone; nodes that mark an inclusion are never made, as
    NOXINCNODE asks), DTDVALID adds what the document type finds wrong to the
    errors, and NOERROR with NOWARNING keeps none.  NOENT holds always: entities
    are substituted.
    """
    doc = _parsed(source, options, url, encoding, resources)
    if options & XINCLUDE:
        from ..operators import xinclude

        try:
            xinclude.process(doc, resources or {}, not options & NOBASEFIX)
        except xinclude.IncludeError as e:
            if not options & RECOVER:
                raise XmlSyntaxError(str(e), 1) from None
            doc.errors.append((1, str(e)))
    if options & DTDVALID:
        from ..operators import validate

        doc.errors += [(1, m) for m in validate.validate_dtd(doc)]
    if options & NOERROR and options & NOWARNING:
        doc.errors.clear()
    return doc


def _parsed(source: str | bytes, options: int, url: str | None, encoding: str | None, resources: Mapping[str, bytes] | None) -> Document:
    text = decode(source, encoding) if isinstance(source, bytes) else source.removeprefix("﻿")
    if text[:1] != "<" and not text.strip(_BLANK):
        if not options & RECOVER:
            raise XmlSyntaxError("Document is empty", 1)
        return Document(Node(DOCUMENT), url=url, errors=[(1, "Document is empty")])
    try:
        doc = _strict(text, options, resources or {})
    except expat.ExpatError as e:
        if not options & RECOVER:
            raise XmlSyntaxError(expat.errors.messages.get(e.code, str(e)), e.lineno) from None
        doc = _recovered(text, options)
        doc.errors.insert(0, (e.lineno, expat.errors.messages.get(e.code, str(e))))
    doc.url = url
    if encoding:
        doc.encoding = encoding
    return doc


_ENCODED = re.compile(r"^(<\?xml[^>]*?)\s+encoding\s*=\s*(?:\"[^\"]*\"|'[^']*')")
_ENCODING = re.compile(r"<\?xml[^>]*?\sencoding\s*=\s*[\"']([^\"']*)")


def _strict(text: str, options: int, resources: Mapping[str, bytes]) -> Document:
    b = _Builder(options)
    p = expat.ParserCreate("utf-8")
    p.ordered_attributes = p.buffer_text = True
    p.specified_attributes = False
    doc = b.doc
    if options & (DTDLOAD | DTDATTR | DTDVALID):
        p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_UNLESS_STANDALONE)

    scopes = b.scopes

    def start(name, attrs):
        if ":" in name or (attrs and any([":" in a or a == "xmlns" for a in attrs[::2]])):
            b.start(name, [(k, v, False) for k, v in zip(attrs[::2], attrs[1::2])], p.CurrentLineNumber)
            return
        # Without prefixes and declarations names need no looking up, and the parser has seen to it that attributes differ.
        scope, at = scopes[-1], b.at
        scopes.append(scope)
        node = Node(ELEMENT, name, "", scope.get("") or None)
        node.line = p.CurrentLineNumber
        if attrs:
            own = node.attrs
            for k in range(0, len(attrs), 2):
                x = Node(ATTRIBUTE, attrs[k], attrs[k + 1])
                x.parent = node
                own.append(x)
        node.parent = at
        at.children.append(node)
        b.at = node

    def end(name):
        b.at = b.at.parent
        scopes.pop()

    def declaration(version, encoding, standalone):
        doc.version, doc.encoding, doc.standalone = version, encoding, standalone

    def doctype(name, system, public, internal):
        doc.dtd = Dtd(name, public, system)
        doc.doctype = (name, public, system)
        doc.node.append(Node(DOCTYPE, name))

    def entity(name, is_parameter, value, base, system, public, notation):
        if not is_parameter:
            doc.dtd.entities.setdefault(name, (value, system, public, notation))

    def attlist(element, name, kind, default, required):
        doc.dtd.attributes.setdefault((element, name), (kind, default, bool(required)))

    def external(context, base, system, public):
        data = resources.get(system)
        if data is None:
            return 1
        child = p.ExternalEntityParserCreate(context)
        return child.Parse(data, True) or 1

    def cdata(inside):
        b.in_cdata = inside

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, b.text
    p.CommentHandler = lambda data: b.at.append(Node(COMMENT, "", data)) if not in_dtd[0] else None
    p.ProcessingInstructionHandler = lambda target, data: b.at.append(Node(PI, target, data)) if not in_dtd[0] else None
    in_dtd = [False]

    def begin(*a):
        in_dtd[0] = True
        doctype(*a)

    def end_doctype():
        in_dtd[0] = False

    p.XmlDeclHandler, p.StartDoctypeDeclHandler, p.EndDoctypeDeclHandler = declaration, begin, end_doctype
    p.ElementDeclHandler = lambda name, model: doc.dtd.elements.setdefault(name, model)
    p.AttlistDeclHandler, p.EntityDeclHandler = attlist, entity
    p.NotationDeclHandler = lambda name, base, system, public: doc.dtd.notations.setdefault(name, (system, public))
    p.StartCdataSectionHandler, p.EndCdataSectionHandler = lambda: cdata(True), lambda: cdata(False)
    p.ExternalEntityRefHandler = external
    p.SkippedEntityHandler = lambda name, is_parameter: None if is_parameter else b.at.append(Node(ENTITY_REF, name))
    # An encoding declaration no longer holds once the input is text.
    declared = text.startswith("<?xml") and _ENCODING.match(text)
    p.Parse(_ENCODED.sub(r"\1", text, count=1) if declared else text, True)
    if declared:
        doc.encoding = declared[1]
    return b.finish()


_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<\?(?P<target>[^\s?>]+)\s*(?P<pi>.*?)(?:\?>|\Z)"
    r"|<!DOCTYPE(?P<doctype>[^\[>]*(?:\[.*?\]\s*)?)(?:>|\Z)|</(?P<end>[^\s>]*)\s*[^>]*(?:>|\Z)|<(?P<start>[A-Za-z_:À-￿][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<close>/?)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ENTITY = re.compile(r"&(?:#x([0-9a-fA-F]+)|#([0-9]+)|([A-Za-z_:][\w:.-]*));?")
# The predefined entities.
PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def _recovered(text: str, options: int) -> Document:
    """Repair: unmatched end tags are ignored, open elements end with what encloses them, bad references vanish."""
    b = _Builder(options | RECOVER)
    doc = b.doc
    entities = dict(PREDEFINED)

    def resolve(s: str) -> str:
        def one(m):
            try:
                if m[1] or m[2]:
                    return chr(int(m[1], 16) if m[1] else int(m[2]))
            except (ValueError, OverflowError):
                return ""
            return entities.get(m[3], "")

        return _ENTITY.sub(one, s) if "&" in s else s

    at, line, seen_root = 0, 1, False
    while at < len(text):
        m = _TOKEN.search(text, at)
        data = text[at : m.start() if m else len(text)]
        if data:
            b.text(resolve(data))
            line += data.count("\n")
        if not m:
            break
        if m["comment"] is not None:
            b.at.append(Node(COMMENT, "", m["comment"]))
        elif m["cdata"] is not None:
            b.in_cdata = True
            b.text(m["cdata"])
            b.in_cdata = False
        elif m["target"] is not None:
            if m["target"].lower() == "xml":
                d = dict((k, v1 or v2) for k, v1, v2, _ in _ATTR.findall(m["pi"]))
                doc.version, doc.encoding = d.get("version"), d.get("encoding")
            else:
                b.at.append(Node(PI, m["target"], m["pi"]))
        elif m["doctype"] is not None:
            name = (m["doctype"].split() or [""])[0]
            doc.dtd, doc.doctype = Dtd(name), (name, None, None)
            for k, q1, q2 in re.findall(r"<!ENTITY\s+([^\s%]+)\s+(?:\"([^\"]*)\"|'([^']*)')", m["doctype"]):
                entities.setdefault(k, resolve(q1 or q2))
            doc.node.append(Node(DOCTYPE, name))
        elif m["end"] is not None:
            chain = [n for n in (b.at, *b.at.ancestors()) if n.kind == ELEMENT]
            if any(n.name == m["end"] for n in chain):
                while b.at.name != m["end"]:
                    b.error(line, f"Opening and ending tag mismatch: {b.at.name} and {m['end']}")
                    b.end()
                b.end()
            else:
                b.error(line, f"Unexpected end tag : {m['end']}")
        elif b.at.kind == DOCUMENT and seen_root:
            b.error(line, "Extra content at the end of the document")
            break
        else:
            seen_root = True
            attrs = [(k, resolve(next((v for v in vs if v), "")), False) for k, *vs in _ATTR.findall(m["attrs"])]
            b.start(m["start"], attrs, line)
            if m["close"]:
                b.end()
        line += m[0].count("\n")
        at = m.end()
    for n in (b.at, *b.at.ancestors()):
        if n.kind == ELEMENT:
            b.error(line, f"Premature end of data in tag {n.name}")
    return b.finish()


def parse_fragment(source: str, scope: Mapping[str, str] | None = None, options: int = DEFAULT_XML) -> Document:
    """Parse content that may have several roots, with namespaces in scope."""
    decls = "".join(f' xmlns{":" if p else ""}{p}="{u}"' for p, u in (scope or {}).items() if p != "xml")
    doc = parse(f"<fragment{decls}>{source}</fragment>", options)
    outer, doc.node = doc.root, Node(FRAGMENT)
    for c in outer.children if outer is not None else ():
        doc.node.append(c)
    doc.kind = "fragment"
    return doc.number()


def looks_like_html(text: str) -> bool:
    """Whether auto-detection takes the input for HTML: an html tag or doctype starts a line of its first 512 characters."""
    return re.search(r"^\s*<(!DOCTYPE\s+)?html[\s>]", text[:512], re.I | re.M) is not None
