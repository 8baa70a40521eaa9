"""HTML parsing as the WHATWG standard prescribes: tokenizer and tree construction.

The tokenizer takes whole runs by regular expressions; the tree builder follows
the standard's insertion modes, adoption agency, active formatting elements and
foster parenting.  ``parse`` never fails: every input gives a tree.
"""

from __future__ import annotations

import re
from html.entities import html5 as ENTITIES

from ..tree import COMMENT, DOCTYPE, DOCUMENT, ELEMENT, FRAGMENT, HTML_NS, MATH_NS, SVG_NS, TEXT, XLINK_NS, XML_NS, XMLNS_NS, Document, Node

WS = "\t\n\f\r "

# Fixed values of the standard: element classes, scopes, quirks identifiers and case fix-ups.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset "
    "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav "
    "noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead "
    "title tr track ul wbr xmp".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
THOROUGH = IMPLIED | frozenset("caption colgroup tbody td tfoot th thead tr".split())
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split()
)
SCOPE = frozenset((HTML_NS, n) for n in "applet caption html table td th marquee object template".split()) | frozenset(
    [(MATH_NS, n) for n in ("mi", "mo", "mn", "ms", "mtext", "annotation-xml")] + [(SVG_NS, n) for n in ("foreignObject", "desc", "title")]
)
LIST_SCOPE = SCOPE | {(HTML_NS, "ol"), (HTML_NS, "ul")}
BUTTON_SCOPE = SCOPE | {(HTML_NS, "button")}
TABLE_SCOPE = frozenset((HTML_NS, n) for n in ("html", "table", "template"))
QUIRKS_PUBLIC = (
    "+//silmaril//dtd html pro v0r11 19970101//", "-//as//dtd html 3.0 aswedit + extensions//", "-//advasoft ltd//dtd html 3.0 aswedit + extensions//",
    "-//ietf//dtd html", "-//metrius//dtd metrius presentational//", "-//microsoft//dtd internet explorer 2.0", "-//microsoft//dtd internet explorer 3.0",
    "-//netscape comm. corp.//dtd", "-//o'reilly and associates//dtd html", "-//sq//dtd html 2.0 hotmetal + extensions//", "-//softquad",
    "-//spyglass//dtd html 2.0 extended//", "-//sun microsystems corp.//dtd hotjava", "-//w3c//dtd html 3", "-//w3c//dtd html 4.0 frameset//",
    "-//w3c//dtd html 4.0 transitional//", "-//w3c//dtd html experimental", "-//w3c//dtd w3 html 3.0//", "-//w3o//dtd w3 html", "-//webtechs//dtd mozilla html",
)
SVG_TAGS = {n.lower(): n for n in (
    "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix "
    "feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology "
    "feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath"
).split()}
SVG_ATTRS = {n.lower(): n for n in (
    "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef gradientTransform gradientUnits "
    "kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits "
    "numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY "
    "repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles surfaceScale "
    "systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan"
).split()}
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub "
    "sup table tt u ul var".split()
)
#: Numeric references to the C1 range mean Windows-1252.
C1 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

_REF = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|([a-zA-Z][a-zA-Z0-9]*;?))")
_TAG_NAME = re.compile(r"[^\t\n\f />]+")
_ATTR = re.compile(r"[\t\n\f /]*(?:(?P<end>>)|(?P<name>=?[^\t\n\f />=]*)(?:[\t\n\f ]*=[\t\n\f ]*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<open>[\"'])|(?P<uq>[^\t\n\f >]*)))?)")
_LONGEST = max(map(len, ENTITIES))


def _reference(m: re.Match, attribute: bool) -> str:
    if m[3] is None:
        try:
            code = int(m[1], 16) if m[1] else int(m[2])
        except ValueError:
            return m[0]
        if code in C1:
            return C1[code]
        return "�" if not code or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)
    name = m[3]
    for k in range(min(len(name), _LONGEST), 1, -1):
        value = ENTITIES.get(name[:k])
        if value is not None:
            if attribute and name[k - 1] != ";":
                after = name[k : k + 1] or m.string[m.end() : m.end() + 1]
                if after == "=" or (after.isascii() and after.isalnum()):
                    return m[0]
            return value + name[k:]
    return m[0]


def _closed(m: re.Match) -> str:
    return _reference(m, False) if m[0].endswith(";") and (m[3] is None or m[3] in ENTITIES) else m[0]


def unescape(text: str, attribute: bool = False, opened: bool = True) -> str:
    """References as characters; without ``opened`` those only that end with a semicolon."""
    if not opened:
        return _REF.sub(_closed, text) if "&" in text else text
    return _REF.sub(lambda m: _reference(m, attribute), text) if "&" in text else text


class _Parser:
    def __init__(self, text: str, context: str | None = None, scripting: bool = False, max_depth: int | None = 400, max_attributes: int | None = 400, max_errors: int | None = None, open_references: bool = True):
        self.s = text.replace("\r\n", "\n").replace("\r", "\n")
        if self.s.startswith("﻿"):
            self.s = self.s[1:]
        self.pos = 0
        self.scripting = scripting
        self.max_depth, self.max_attributes, self.max_errors = max_depth, max_attributes, max_errors
        self.open_references = open_references
        self.too_deep, self.counted = False, (0, 1)
        self.errors: list[tuple[int, str]] = []
        self.doc = Document(Node(DOCUMENT), "html5")
        self.stack: list[Node] = []
        self.active: list[Node | None] = []  # None is a marker
        self.head: Node | None = None
        self.form: Node | None = None
        self.frameset_ok = True
        self.foster = False
        self.templates: list = []
        self.table_text: list[str] = []
        self.skip_newline = False
        self.mode = self.original = self.initial
        self.raw: str | None = None  # content model: None is data
        self.raw_name = ""
        self.context: Node | None = None
        if context is not None:
            ns, _, local = context.rpartition(":")
            self.context = Node(ELEMENT, local, ns={"svg": SVG_NS, "math": MATH_NS}.get(ns, HTML_NS))
            self._fragment()

    # -- tokenizer -------------------------------------------------------
    def error(self, what: str) -> None:
        if self.max_errors is None or len(self.errors) < self.max_errors:
            at, line = self.counted
            if self.pos >= at:  # lines are counted on from the last error
                line += self.s.count("\n", at, self.pos)
            else:
                line = self.s.count("\n", 0, self.pos) + 1
            self.counted = (self.pos, line)
            self.errors.append((line, what))

    def run(self) -> None:
        s, n = self.s, len(self.s)
        while self.pos < n:
            if self.raw == "plaintext":
                self.characters(s[self.pos :].replace("\0", "�"))
                self.pos = n
            elif self.raw:
                self._raw_text()
            else:
                lt = s.find("<", self.pos)
                if lt < 0:
                    lt = n
                if lt > self.pos:
                    self.characters(unescape(s[self.pos : lt], False, self.open_references))
                    self.pos = lt
                if lt < n:
                    self._markup()
        self.dispatch(("eof",))

    def _raw_text(self) -> None:
        s = self.s
        m = re.compile(rf"</{re.escape(self.raw_name)}(?=[\t\n\f />])", re.I).search(s, self.pos)
        if m and self.raw == "script" and "<!--" in s[self.pos : m.start()]:
            m = self._script_end(m)
        end = m.start() if m else len(s)
        text = s[self.pos : end].replace("\0", "�")
        self.pos = end
        if text:
            self.characters(unescape(text, False, self.open_references) if self.raw == "rcdata" else text)
        self.raw = None
        if m:
            self._markup()

    def _script_end(self, m: re.Match) -> re.Match | None:
        """The end tag that counts, given that "<!--" followed by "<script" hides one."""
        at, hidden, pattern = self.pos, 0, re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f />])", re.I)
        while x := pattern.search(self.s, at):
            at = x.end() if x[0] != "<!--" else x.end() - 2
            if x[0] == "<!--":
                hidden = max(hidden, 1)
            elif x[0] == "-->":
                hidden = 0
            elif x[1]:
                if hidden < 2:
                    return x
                hidden = 1
            elif hidden == 1:
                hidden = 2
        return None

    def _markup(self) -> None:
        s, at = self.s, self.pos + 1
        c = s[at : at + 1]
        if c.isascii() and c.isalpha():
            self._tag(at, "start")
        elif c == "/":
            d = s[at + 1 : at + 2]
            if d.isascii() and d.isalpha():
                self._tag(at + 1, "end")
            elif d == ">":
                self.error("missing end tag name")
                self.pos = at + 2
            elif not d:
                self.characters("</")
                self.pos = at + 1
            else:
                self._bogus(at + 1)
        elif c == "!":
            if s.startswith("--", at + 1):
                self._comment(at + 3)
            elif s[at + 1 : at + 8].lower() == "doctype":
                self._doctype(at + 8)
            elif s.startswith("[CDATA[", at + 1) and self.stack and self.adjusted().ns != HTML_NS:
                end = s.find("]]>", at + 8)
                end = len(s) if end < 0 else end
                self.pos = min(len(s), end + 3)
                if end > at + 8:
                    self.characters(s[at + 8 : end])
            else:
                self._bogus(at + 1)
        elif c == "?":
            self._bogus(at)
        else:
            self.error("invalid first character of tag name")
            self.pos = at
            self.characters("<")

    def _bogus(self, at: int) -> None:
        self.error("incorrectly opened comment")
        end = self.s.find(">", at)
        end = len(self.s) if end < 0 else end
        self.pos = min(len(self.s), end + 1)
        self.dispatch(("comment", self.s[at:end].replace("\0", "�")))

    def _comment(self, at: int) -> None:
        s = self.s
        if s.startswith(">", at) or s.startswith("->", at):
            self.pos = s.index(">", at) + 1
            self.error("abrupt closing of empty comment")
            self.dispatch(("comment", ""))
            return
        m = re.compile(r"--!?>").search(s, at)
        if m:
            data, self.pos = s[at : m.start()], m.end()
        else:
            self.error("eof in comment")
            data, self.pos = re.sub(r"--?!?\Z", "", s[at:]), len(s)
        self.dispatch(("comment", data.replace("\0", "�")))

    def _doctype(self, at: int) -> None:
        end = self.s.find(">", at)
        # A quoted identifier ends at ">" too.
        body, closed = (self.s[at:end], True) if end >= 0 else (self.s[at:], False)
        self.pos = end + 1 if closed else len(self.s)
        m = re.match(r"[\t\n\f ]*([^\t\n\f >]*)[\t\n\f ]*(?:(public|system)[\t\n\f ]*(?:(\"[^\"]*\"?|'[^']*'?)[\t\n\f ]*(\"[^\"]*\"?|'[^']*'?)?)?)?(.*)", body, re.I | re.S)
        name, word, first, second, rest = m.groups()
        quoted = lambda q: (q[1:-1] if len(q) > 1 and q[-1] == q[0] else q[1:]) if q is not None else None
        broken = lambda q: q is not None and not (len(q) > 1 and q[-1] == q[0])
        public, system = (quoted(first), quoted(second)) if (word or "").lower() == "public" else (None, quoted(first))
        force = not closed or not name or (bool(word) and first is None) or broken(first) or broken(second) or (bool(rest.strip(WS)) and not word)
        self.dispatch(("doctype", name.lower().replace("\0", "�"), public, system, force))

    def _tag(self, at: int, kind: str) -> None:
        s = self.s
        m = _TAG_NAME.match(s, at)
        name, at = m[0].translate(_LOWER), m.end()
        attrs: dict[str, str] = {}
        closing = crowded = False
        while True:
            m = _ATTR.match(s, at)
            if m["end"]:
                closing = s[m.start() : m.end() - 1].endswith("/")
                self.pos = m.end()
                break
            if m.end() >= len(s) or m["open"]:
                # The tag is never closed: it is dropped with all that follows.
                if m["open"] or not s[m.end() :]:
                    self.error("eof in tag")
                    self.pos = len(s)
                    return
            if m["name"] and self.max_attributes is not None and len(attrs) >= self.max_attributes:
                if not crowded:
                    self.error("attributes per element limit exceeded")
                crowded = True
            elif m["name"]:
                value = next((m[g] for g in ("dq", "sq", "uq") if m[g] is not None), "")
                attrs.setdefault(m["name"].translate(_LOWER), unescape(value.replace("\0", "�"), True, self.open_references))
            at = m.end() if m.end() > at else at + 1
        self.dispatch((kind, name.replace("\0", "�"), attrs, closing))

    # -- tree helpers ----------------------------------------------------
    def adjusted(self) -> Node:
        return self.context if self.context is not None and len(self.stack) == 1 else self.stack[-1]

    def characters(self, text: str) -> None:
        if self.skip_newline:
            self.skip_newline = False
            if text.startswith("\n"):
                text = text[1:]
        if text:
            self.dispatch(("chars", text))

    def dispatch(self, token: tuple) -> None:
        self.skip_newline = False
        if not self.stack or self._html_rules(token):
            self.mode(token)
        else:
            self.foreign(token)

    def _html_rules(self, t: tuple) -> bool:
        node = self.adjusted()
        if node.ns == HTML_NS or t[0] == "eof":
            return True
        if _math_text_point(node) and (t[0] == "chars" or (t[0] == "start" and t[1] not in ("mglyph", "malignmark"))):
            return True
        if node.ns == MATH_NS and node.local == "annotation-xml" and t[0] == "start" and t[1] == "svg":
            return True
        return _html_point(node) and t[0] in ("start", "chars")

    def place(self, target: Node | None = None) -> tuple[Node, int]:
        """Where to insert: parent and position."""
        target = target or self.stack[-1]
        if self.foster and target.ns == HTML_NS and target.local in ("table", "tbody", "tfoot", "thead", "tr"):
            table = next((k for k in range(len(self.stack) - 1, -1, -1) if _is(self.stack[k], "table")), None)
            template = next((k for k in range(len(self.stack) - 1, -1, -1) if _is(self.stack[k], "template")), None)
            if template is not None and (table is None or template > table):
                return self.stack[template], len(self.stack[template].children)
            if table is None:
                return self.stack[0], len(self.stack[0].children)
            node = self.stack[table]
            if node.parent is not None:
                return node.parent, node.index()
            return self.stack[table - 1], len(self.stack[table - 1].children)
        return target, len(target.children)

    def text(self, data: str) -> None:
        if not data:
            return
        parent, at = self.place()
        if parent.kind == DOCUMENT:
            return
        if at and parent.children[at - 1].kind == TEXT:
            parent.children[at - 1].value += data
        else:
            parent.insert(at, Node(TEXT, "", data))

    def comment(self, data: str, parent: Node | None = None) -> None:
        if parent is not None:
            parent.append(Node(COMMENT, "", data))
        else:
            where, at = self.place()
            where.insert(at, Node(COMMENT, "", data))

    def make(self, name: str, attrs: dict[str, str], ns: str = HTML_NS) -> Node:
        node = Node(ELEMENT, name, ns=ns)
        for k, v in attrs.items():
            if ns != HTML_NS and (k.startswith(("xlink:", "xml:", "xmlns:")) or k == "xmlns"):
                prefix, _, local = k.rpartition(":")
                a = node.set(local, v, {"xlink": XLINK_NS, "xml": XML_NS, "xmlns": XMLNS_NS, "": XMLNS_NS}[prefix])
                a.prefix = prefix or None
            else:
                a = Node(2, k, v)
                a.parent = node
                node.attrs.append(a)
        node.line = self.pos
        return node

    def push(self, name: str, attrs: dict[str, str] | None = None, ns: str = HTML_NS) -> Node:
        node = self.make(name, attrs or {}, ns)
        if self.max_depth and len(self.stack) >= self.max_depth:
            self._at_depth_limit()
        parent, at = self.place()
        if self.max_depth and len(self.stack) >= self.max_depth and parent is self.stack[-1]:
            parent = self.stack[self.max_depth - 1]
            at = len(parent.children)
        parent.insert(at, node)
        self.stack.append(node)
        return node

    def _at_depth_limit(self) -> None:
        """Elements beyond the limit become siblings; of too many open ones, those beyond it end, so that no page takes quadratic time."""
        if not self.too_deep:
            self.too_deep = True
            self.error("document tree depth limit exceeded")
        self.active.clear()  # nothing is opened again beyond the limit
        if len(self.stack) >= 2 * self.max_depth:
            del self.stack[self.max_depth :]
            self.reset()

    def void(self, name: str, attrs: dict[str, str]) -> None:
        self.push(name, attrs)
        self.stack.pop()

    def in_scope(self, names, scope=SCOPE) -> bool:
        for node in reversed(self.stack):
            if node.ns == HTML_NS and node.local in names:
                return True
            if (node.ns, node.local) in scope:
                return False
        return False

    def implied(self, but: str | None = None, names=IMPLIED) -> None:
        while self.stack[-1].ns == HTML_NS and self.stack[-1].local in names and self.stack[-1].local != but:
            self.stack.pop()

    def pop_to(self, names) -> None:
        while True:
            node = self.stack.pop()
            if (node.ns == HTML_NS and node.local in names) or len(self.stack) <= 1 and not self.stack:
                return

    def clear_to(self, names) -> None:
        while not (self.stack[-1].ns == HTML_NS and self.stack[-1].local in names) and not _is(self.stack[-1], "html", "template"):
            self.stack.pop()

    def has(self, *names: str) -> bool:
        return any(_is(n, *names) for n in self.stack)

    def close_p(self) -> None:
        if self.in_scope(("p",), BUTTON_SCOPE):
            self.implied("p")
            self.pop_to(("p",))

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def add_active(self, node: Node) -> None:
        """At most three equal entries since the last marker (the Noah's Ark clause)."""
        same = []
        for k in range(len(self.active) - 1, -1, -1):
            other = self.active[k]
            if other is None:
                break
            if other.local == node.local and other.ns == node.ns and _attrs(other) == _attrs(node):
                same.append(k)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(node)

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        k = len(self.active) - 1
        while k and self.active[k - 1] is not None and self.active[k - 1] not in self.stack:
            k -= 1
        for i in range(k, len(self.active)):
            old = self.active[i]
            self.active[i] = self.push(old.local, {a.local: a.value for a in old.attrs})

    def adoption(self, name: str) -> None:
        if _is(self.stack[-1], name) and self.stack[-1] not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            node = None
            for x in reversed(self.active):
                if x is None:
                    break
                if x.local == name:
                    node = x
                    break
            if node is None:
                self.other_end(name)
                return
            if node not in self.stack:
                self.active.remove(node)
                return
            if not self.in_scope_node(node):
                return
            at = self.stack.index(node)
            block = next((x for x in self.stack[at + 1 :] if _special(x)), None)
            if block is None:
                del self.stack[at:]
                self.active.remove(node)
                return
            ancestor = self.stack[at - 1]
            bookmark = self.active.index(node)
            last = x = block
            k = self.stack.index(x)
            inner = 0
            while True:
                inner += 1
                k -= 1
                x = self.stack[k]
                if x is node:
                    break
                if inner > 3 and x in self.active:
                    if self.active.index(x) < bookmark:
                        bookmark -= 1
                    self.active.remove(x)
                if x not in self.active:
                    del self.stack[k]
                    continue
                new = self.make(x.local, {a.local: a.value for a in x.attrs})
                self.active[self.active.index(x)] = new
                self.stack[k] = new
                if last is block:
                    bookmark = self.active.index(new) + 1
                last.unlink()
                new.append(last)
                last = x = new
            last.unlink()
            foster, self.foster = self.foster, True
            parent, where = self.place(ancestor)
            self.foster = foster
            parent.insert(where, last)
            new = self.make(node.local, {a.local: a.value for a in node.attrs})
            for c in block.children:
                new.append(c)
            block.children = []
            block.append(new)
            if self.active.index(node) < bookmark:
                bookmark -= 1
            self.active.remove(node)
            self.active.insert(bookmark, new)
            self.stack.remove(node)
            self.stack.insert(self.stack.index(block) + 1, new)

    def in_scope_node(self, wanted: Node) -> bool:
        for node in reversed(self.stack):
            if node is wanted:
                return True
            if (node.ns, node.local) in SCOPE:
                return False
        return False

    def other_end(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            node = self.stack[k]
            if _is(node, name):
                self.implied(name)
                del self.stack[self.stack.index(node) :]
                return
            if _special(node):
                return

    def raw_element(self, t: tuple, model: str) -> None:
        self.push(t[1], t[2])
        self.raw, self.raw_name = model, t[1]
        self.original, self.mode = self.mode, self.in_text

    def reset(self) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            last = k == 0
            node = self.context if last and self.context is not None else self.stack[k]
            name = node.local if node.ns == HTML_NS else ""
            if name == "select":
                inside = next((a.local for a in reversed(self.stack[1:k]) if _is(a, "template", "table")), "")
                self.mode = self.in_select_in_table if inside == "table" else self.in_select
            elif name in ("td", "th") and not last:
                self.mode = self.in_cell
            elif name in _RESET:
                self.mode = getattr(self, _RESET[name])
            elif name == "template":
                self.mode = self.templates[-1]
            elif name == "head" and not last:
                self.mode = self.in_head
            elif name == "html":
                self.mode = self.before_head if self.head is None else self.after_head
            elif last:
                self.mode = self.in_body
            else:
                continue
            return

    def _fragment(self) -> None:
        root = Node(ELEMENT, "html", ns=HTML_NS)
        self.doc.node.append(root)
        self.stack.append(root)
        c = self.context
        if c.ns == HTML_NS:
            if c.local in ("title", "textarea"):
                self.raw, self.raw_name = "rcdata", c.local
            elif c.local in ("style", "xmp", "iframe", "noembed", "noframes") or (c.local == "noscript" and self.scripting):
                self.raw, self.raw_name = "rawtext", c.local
            elif c.local == "script":
                self.raw, self.raw_name = "script", c.local
            elif c.local == "plaintext":
                self.raw = "plaintext"
            if c.local == "template":
                self.templates.append(self.in_template)
            if c.local == "form":
                self.form = c
        self.reset()

    # -- insertion modes -------------------------------------------------
    def initial(self, t: tuple) -> None:
        if t[0] == "chars":
            t = ("chars", t[1].lstrip(WS))
            if not t[1]:
                return
        if t[0] == "comment":
            self.comment(t[1], self.doc.node)
        elif t[0] == "doctype":
            _, name, public, system, force = t
            node = Node(DOCTYPE, name)
            self.doc.node.append(node)
            self.doc.doctype = (name, public, system)
            self.doc.quirks = quirks(name, public, system, force)
            self.mode = self.before_html
        else:
            self.doc.quirks = 1
            self.mode = self.before_html
            self.dispatch(t)

    def before_html(self, t: tuple) -> None:
        if t[0] == "chars":
            t = ("chars", t[1].lstrip(WS))
            if not t[1]:
                return
        if t[0] == "doctype" or (t[0] == "end" and t[1] not in ("head", "body", "html", "br")):
            return
        if t[0] == "comment":
            self.comment(t[1], self.doc.node)
            return
        root = self.make("html", t[2] if t[:2] == ("start", "html") else {})
        self.doc.node.append(root)
        self.stack.append(root)
        self.mode = self.before_head
        if t[:2] != ("start", "html"):
            self.dispatch(t)

    def before_head(self, t: tuple) -> None:
        if t[0] == "chars":
            t = ("chars", t[1].lstrip(WS))
            if not t[1]:
                return
        if t[0] == "comment":
            self.comment(t[1])
        elif t[0] == "doctype" or (t[0] == "end" and t[1] not in ("head", "body", "html", "br")):
            return
        elif t[:2] == ("start", "html"):
            self.in_body(t)
        else:
            self.head = self.push("head", t[2] if t[:2] == ("start", "head") else {})
            self.mode = self.in_head
            if t[:2] != ("start", "head"):
                self.dispatch(t)

    def in_head(self, t: tuple) -> None:
        kind = t[0]
        if kind == "chars":
            rest = t[1].lstrip(WS)
            self.text(t[1][: len(t[1]) - len(rest)])
            if not rest:
                return
            t = ("chars", rest)
        elif kind == "comment":
            self.comment(t[1])
            return
        elif kind == "doctype":
            return
        elif kind == "start":
            name = t[1]
            if name == "html":
                self.in_body(t)
                return
            if name in ("base", "basefont", "bgsound", "link", "meta"):
                self.void(name, t[2])
                return
            if name == "title":
                self.raw_element(t, "rcdata")
                return
            if name in ("noframes", "style") or (name == "noscript" and self.scripting):
                self.raw_element(t, "rawtext")
                return
            if name == "noscript":
                self.push(name, t[2])
                self.mode = self.in_head_noscript
                return
            if name == "script":
                self.raw_element(t, "script")
                return
            if name == "template":
                self.push(name, t[2])
                self.active.append(None)
                self.frameset_ok = False
                self.mode = self.in_template
                self.templates.append(self.in_template)
                return
            if name == "head":
                return
        elif kind == "end":
            if t[1] == "head":
                self.stack.pop()
                self.mode = self.after_head
                return
            if t[1] == "template":
                if self.has("template"):
                    self.implied(names=THOROUGH)
                    self.pop_to(("template",))
                    self.clear_active()
                    self.templates.pop()
                    self.reset()
                return
            if t[1] not in ("body", "html", "br"):
                return
        self.stack.pop()
        self.mode = self.after_head
        self.dispatch(t)

    def in_head_noscript(self, t: tuple) -> None:
        if t[0] == "doctype" or (t[0] == "end" and t[1] not in ("noscript", "br")) or (t[0] == "start" and t[1] in ("head", "noscript")):
            return
        if t[:2] == ("start", "html"):
            self.in_body(t)
        elif t[:2] == ("end", "noscript"):
            self.stack.pop()
            self.mode = self.in_head
        elif t[0] == "comment" or (t[0] == "chars" and not t[1].strip(WS)) or (t[0] == "start" and t[1] in ("basefont", "bgsound", "link", "meta", "noframes", "style")):
            self.in_head(t)
        else:
            self.stack.pop()
            self.mode = self.in_head
            self.dispatch(t)

    def after_head(self, t: tuple) -> None:
        kind = t[0]
        if kind == "chars":
            rest = t[1].lstrip(WS)
            self.text(t[1][: len(t[1]) - len(rest)])
            if not rest:
                return
            t = ("chars", rest)
        elif kind == "comment":
            self.comment(t[1])
            return
        elif kind == "doctype":
            return
        elif kind == "start":
            if t[1] == "html":
                self.in_body(t)
                return
            if t[1] == "body":
                self.push("body", t[2])
                self.frameset_ok = False
                self.mode = self.in_body
                return
            if t[1] == "frameset":
                self.push("frameset", t[2])
                self.mode = self.in_frameset
                return
            if t[1] in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
                self.stack.append(self.head)
                self.in_head(t)
                if self.head in self.stack:
                    self.stack.remove(self.head)
                return
            if t[1] == "head":
                return
        elif kind == "end":
            if t[1] == "template":
                self.in_head(t)
                return
            if t[1] not in ("body", "html", "br"):
                return
        self.push("body")
        self.mode = self.in_body
        self.dispatch(t)

    def in_body(self, t: tuple) -> None:
        kind = t[0]
        if kind == "chars":
            text = t[1].replace("\0", "")
            if text:
                self.reconstruct()
                self.text(text)
                if self.frameset_ok and text.strip(WS):
                    self.frameset_ok = False
        elif kind == "start":
            self.body_start(t)
        elif kind == "end":
            self.body_end(t)
        elif kind == "comment":
            self.comment(t[1])
        elif kind == "eof" and self.templates:
            self.in_template(t)

    def body_start(self, t: tuple) -> None:
        _, name, attrs, closing = t
        if name in BLOCKS:
            self.close_p()
            self.push(name, attrs)
        elif name in HEADINGS:
            self.close_p()
            if _is(self.stack[-1], *HEADINGS):
                self.stack.pop()
            self.push(name, attrs)
        elif name == "a":
            for x in reversed(self.active):
                if x is None:
                    break
                if x.local == "a":
                    self.adoption("a")
                    if x in self.active:
                        self.active.remove(x)
                    if x in self.stack:
                        self.stack.remove(x)
                    break
            self.reconstruct()
            self.add_active(self.push(name, attrs))
        elif name in FORMATTING:
            self.reconstruct()
            if name == "nobr" and self.in_scope(("nobr",)):
                self.adoption("nobr")
                self.reconstruct()
            self.add_active(self.push(name, attrs))
        elif name in ("li", "dd", "dt"):
            self.frameset_ok = False
            names = ("li",) if name == "li" else ("dd", "dt")
            for node in reversed(self.stack):
                if _is(node, *names):
                    self.implied(node.local)
                    self.pop_to((node.local,))
                    break
                if _special(node) and not _is(node, "address", "div", "p"):
                    break
            self.close_p()
            self.push(name, attrs)
        elif name == "html":
            if not self.has("template"):
                self._more(self.stack[0], attrs)
        elif name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            self.in_head(t)
        elif name == "body":
            if len(self.stack) > 1 and _is(self.stack[1], "body") and not self.has("template"):
                self.frameset_ok = False
                self._more(self.stack[1], attrs)
        elif name == "frameset":
            if len(self.stack) > 1 and _is(self.stack[1], "body") and self.frameset_ok:
                self.stack[1].unlink()
                del self.stack[1:]
                self.push(name, attrs)
                self.mode = self.in_frameset
        elif name in ("pre", "listing"):
            self.close_p()
            self.push(name, attrs)
            self.skip_newline = True
            self.frameset_ok = False
        elif name == "form":
            if self.form is None or self.has("template"):
                self.close_p()
                node = self.push(name, attrs)
                if not self.has("template"):
                    self.form = node
        elif name == "plaintext":
            self.close_p()
            self.push(name, attrs)
            self.raw = "plaintext"
        elif name == "button":
            if self.in_scope(("button",)):
                self.implied()
                self.pop_to(("button",))
            self.reconstruct()
            self.push(name, attrs)
            self.frameset_ok = False
        elif name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.push(name, attrs)
            self.active.append(None)
            self.frameset_ok = False
        elif name == "table":
            if self.doc.quirks != 1:
                self.close_p()
            self.push(name, attrs)
            self.frameset_ok = False
            self.mode = self.in_table
        elif name in ("area", "br", "embed", "img", "keygen", "wbr"):
            self.reconstruct()
            self.void(name, attrs)
            self.frameset_ok = False
        elif name == "input":
            self.reconstruct()
            self.void(name, attrs)
            if attrs.get("type", "").lower() != "hidden":
                self.frameset_ok = False
        elif name in ("param", "source", "track"):
            self.void(name, attrs)
        elif name == "hr":
            self.close_p()
            self.void(name, attrs)
            self.frameset_ok = False
        elif name == "image":
            self.body_start((t[0], "img", attrs, closing))
        elif name == "textarea":
            self.raw_element(t, "rcdata")
            self.skip_newline = True
            self.frameset_ok = False
        elif name == "xmp":
            self.close_p()
            self.reconstruct()
            self.frameset_ok = False
            self.raw_element(t, "rawtext")
        elif name == "iframe":
            self.frameset_ok = False
            self.raw_element(t, "rawtext")
        elif name == "noembed" or (name == "noscript" and self.scripting):
            self.raw_element(t, "rawtext")
        elif name == "select":
            self.reconstruct()
            self.push(name, attrs)
            self.frameset_ok = False
            table = self.mode in (self.in_table, self.in_caption, self.in_table_body, self.in_row, self.in_cell)
            self.mode = self.in_select_in_table if table else self.in_select
        elif name in ("optgroup", "option"):
            if _is(self.stack[-1], "option"):
                self.stack.pop()
            self.reconstruct()
            self.push(name, attrs)
        elif name in ("rb", "rtc"):
            if self.in_scope(("ruby",)):
                self.implied()
            self.push(name, attrs)
        elif name in ("rp", "rt"):
            if self.in_scope(("ruby",)):
                self.implied("rtc")
            self.push(name, attrs)
        elif name in ("math", "svg"):
            self.reconstruct()
            self.push_foreign(name, attrs, MATH_NS if name == "math" else SVG_NS, closing)
        elif name in ("caption", "col", "colgroup", "frame", "head", "tbody", "td", "tfoot", "th", "thead", "tr"):
            self.error("unexpected start tag")
        else:
            self.reconstruct()
            self.push(name, attrs)

    @staticmethod
    def _more(node: Node, attrs: dict[str, str]) -> None:
        for k, v in attrs.items():
            if node.get(k) is None:
                node.set(k, v)

    def body_end(self, t: tuple) -> None:
        name = t[1]
        if name in FORMATTING:
            self.adoption(name)
        elif name == "p":
            if not self.in_scope(("p",), BUTTON_SCOPE):
                self.push("p")
            self.implied("p")
            self.pop_to(("p",))
        elif name in BLOCKS or name in ("button", "listing", "pre"):
            if self.in_scope((name,)):
                self.implied()
                self.pop_to((name,))
        elif name == "li":
            if self.in_scope(("li",), LIST_SCOPE):
                self.implied("li")
                self.pop_to(("li",))
        elif name in ("dd", "dt"):
            if self.in_scope((name,)):
                self.implied(name)
                self.pop_to((name,))
        elif name in HEADINGS:
            if self.in_scope(HEADINGS):
                self.implied()
                self.pop_to(HEADINGS)
        elif name == "body":
            if self.in_scope(("body",)):
                self.mode = self.after_body
        elif name == "html":
            if self.in_scope(("body",)):
                self.mode = self.after_body
                self.dispatch(t)
        elif name == "form":
            if self.has("template"):
                if self.in_scope(("form",)):
                    self.implied()
                    self.pop_to(("form",))
            else:
                node, self.form = self.form, None
                if node is not None and node in self.stack and self.in_scope_node(node):
                    self.implied()
                    self.stack.remove(node)
        elif name in ("applet", "marquee", "object"):
            if self.in_scope((name,)):
                self.implied()
                self.pop_to((name,))
                self.clear_active()
        elif name == "template":
            self.in_head(t)
        elif name == "br":
            self.body_start(("start", "br", {}, False))
        else:
            self.other_end(name)

    def in_text(self, t: tuple) -> None:
        if t[0] == "chars":
            self.text(t[1])
        else:
            self.stack.pop()
            self.mode = self.original
            if t[0] != "end":
                self.dispatch(t)

    def in_table(self, t: tuple) -> None:
        kind, name = t[0], t[1] if len(t) > 1 else None
        if kind == "chars" and _is(self.stack[-1], "table", "tbody", "tfoot", "thead", "tr", "template"):
            self.table_text = []
            self.original, self.mode = self.mode, self.in_table_text
            self.mode(t)
            return
        if kind == "comment":
            self.comment(name)
            return
        if kind == "doctype":
            return
        if kind == "start":
            if name == "caption":
                self.clear_to(("table",))
                self.active.append(None)
                self.push(name, t[2])
                self.mode = self.in_caption
                return
            if name in ("colgroup", "col"):
                self.clear_to(("table",))
                self.push("colgroup", t[2] if name == "colgroup" else {})
                self.mode = self.in_column_group
                if name == "col":
                    self.dispatch(t)
                return
            if name in ("tbody", "tfoot", "thead", "td", "th", "tr"):
                self.clear_to(("table",))
                body = name in ("tbody", "tfoot", "thead")
                self.push(name if body else "tbody", t[2] if body else {})
                self.mode = self.in_table_body
                if not body:
                    self.dispatch(t)
                return
            if name == "table":
                if self.in_scope(("table",), TABLE_SCOPE):
                    self.pop_to(("table",))
                    self.reset()
                    self.dispatch(t)
                return
            if name in ("style", "script", "template"):
                self.in_head(t)
                return
            if name == "input" and t[2].get("type", "").lower() == "hidden":
                self.void(name, t[2])
                return
            if name == "form":
                if self.form is None and not self.has("template"):
                    self.form = self.push(name, t[2])
                    self.stack.pop()
                return
        elif kind == "end":
            if name == "table":
                if self.in_scope(("table",), TABLE_SCOPE):
                    self.pop_to(("table",))
                    self.reset()
                return
            if name in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
                return
            if name == "template":
                self.in_head(t)
                return
        elif kind == "eof":
            self.in_body(t)
            return
        self.foster = True
        self.in_body(t)
        self.foster = False

    def in_table_text(self, t: tuple) -> None:
        if t[0] == "chars":
            self.table_text.append(t[1].replace("\0", ""))
            return
        text = "".join(self.table_text)
        self.mode = self.original
        if text.strip(WS):
            self.foster = True
            self.in_body(("chars", text))
            self.foster = False
        else:
            self.text(text)
        self.dispatch(t)

    def in_caption(self, t: tuple) -> None:
        kind, name = t[0], t[1] if len(t) > 1 else None
        ends = kind == "end" and name in ("caption", "table") or kind == "start" and name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")
        if ends:
            if self.in_scope(("caption",), TABLE_SCOPE):
                self.implied()
                self.pop_to(("caption",))
                self.clear_active()
                self.mode = self.in_table
                if t[:2] != ("end", "caption"):
                    self.dispatch(t)
        elif kind == "end" and name in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return
        else:
            self.in_body(t)

    def in_column_group(self, t: tuple) -> None:
        kind = t[0]
        if kind == "chars":
            rest = t[1].lstrip(WS)
            self.text(t[1][: len(t[1]) - len(rest)])
            if not rest:
                return
            t = ("chars", rest)
        elif kind == "comment":
            self.comment(t[1])
            return
        elif kind == "doctype":
            return
        elif t[:2] == ("start", "html"):
            self.in_body(t)
            return
        elif t[:2] == ("start", "col"):
            self.void("col", t[2])
            return
        elif t[:2] == ("end", "col"):
            return
        elif kind in ("start", "end") and t[1] == "template":
            self.in_head(t)
            return
        elif kind == "eof":
            self.in_body(t)
            return
        if _is(self.stack[-1], "colgroup"):
            self.stack.pop()
            self.mode = self.in_table
            if t[:2] != ("end", "colgroup"):
                self.dispatch(t)

    def in_table_body(self, t: tuple) -> None:
        kind, name = t[0], t[1] if len(t) > 1 else None
        bodies = ("tbody", "tfoot", "thead")
        if kind == "start" and name in ("tr", "th", "td"):
            self.clear_to(bodies)
            self.push("tr", t[2] if name == "tr" else {})
            self.mode = self.in_row
            if name != "tr":
                self.dispatch(t)
        elif kind == "end" and name in bodies:
            if self.in_scope((name,), TABLE_SCOPE):
                self.clear_to(bodies)
                self.stack.pop()
                self.mode = self.in_table
        elif (kind == "start" and name in ("caption", "col", "colgroup", *bodies)) or t[:2] == ("end", "table"):
            if self.in_scope(bodies, TABLE_SCOPE):
                self.clear_to(bodies)
                self.stack.pop()
                self.mode = self.in_table
                self.dispatch(t)
        elif kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            return
        else:
            self.in_table(t)

    def in_row(self, t: tuple) -> None:
        kind, name = t[0], t[1] if len(t) > 1 else None
        bodies = ("tbody", "tfoot", "thead")
        if kind == "start" and name in ("th", "td"):
            self.clear_to(("tr",))
            self.push(name, t[2])
            self.mode = self.in_cell
            self.active.append(None)
        elif t[:2] == ("end", "tr") or (kind == "start" and name in ("caption", "col", "colgroup", *bodies, "tr")) or (kind == "end" and name in ("table", *bodies)):
            if kind == "end" and name in bodies and not self.in_scope((name,), TABLE_SCOPE):
                return
            if self.in_scope(("tr",), TABLE_SCOPE):
                self.clear_to(("tr",))
                self.stack.pop()
                self.mode = self.in_table_body
                if t[:2] != ("end", "tr"):
                    self.dispatch(t)
        elif kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            return
        else:
            self.in_table(t)

    def in_cell(self, t: tuple) -> None:
        kind, name = t[0], t[1] if len(t) > 1 else None
        if kind == "end" and name in ("td", "th"):
            if self.in_scope((name,), TABLE_SCOPE):
                self.implied()
                self.pop_to((name,))
                self.clear_active()
                self.mode = self.in_row
        elif kind == "start" and name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            if self.in_scope(("td", "th"), TABLE_SCOPE):
                self.close_cell()
                self.dispatch(t)
        elif kind == "end" and name in ("body", "caption", "col", "colgroup", "html"):
            return
        elif kind == "end" and name in ("table", "tbody", "tfoot", "thead", "tr"):
            if self.in_scope((name,), TABLE_SCOPE):
                self.close_cell()
                self.dispatch(t)
        else:
            self.in_body(t)

    def close_cell(self) -> None:
        self.implied()
        self.pop_to(("td", "th"))
        self.clear_active()
        self.mode = self.in_row

    def in_select(self, t: tuple) -> None:
        kind, name = t[0], t[1] if len(t) > 1 else None
        if kind == "chars":
            self.text(name.replace("\0", ""))
        elif kind == "comment":
            self.comment(name)
        elif kind == "start":
            if name == "html":
                self.in_body(t)
            elif name in ("option", "optgroup", "hr"):
                if _is(self.stack[-1], "option"):
                    self.stack.pop()
                if name != "option" and _is(self.stack[-1], "optgroup"):
                    self.stack.pop()
                if name == "hr":
                    self.void(name, t[2])
                else:
                    self.push(name, t[2])
            elif name in ("select", "input", "keygen", "textarea"):
                if self.in_select_scope():
                    self.pop_to(("select",))
                    self.reset()
                    if name != "select":
                        self.dispatch(t)
            elif name in ("script", "template"):
                self.in_head(t)
        elif kind == "end":
            if name == "optgroup":
                if _is(self.stack[-1], "option") and len(self.stack) > 1 and _is(self.stack[-2], "optgroup"):
                    self.stack.pop()
                if _is(self.stack[-1], "optgroup"):
                    self.stack.pop()
            elif name == "option":
                if _is(self.stack[-1], "option"):
                    self.stack.pop()
            elif name == "select":
                if self.in_select_scope():
                    self.pop_to(("select",))
                    self.reset()
            elif name == "template":
                self.in_head(t)
        elif kind == "eof":
            self.in_body(t)

    def in_select_scope(self) -> bool:
        for node in reversed(self.stack):
            if _is(node, "select"):
                return True
            if not _is(node, "optgroup", "option"):
                return False
        return False

    def in_select_in_table(self, t: tuple) -> None:
        names = ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th")
        if t[0] in ("start", "end") and t[1] in names:
            if t[0] == "start" or self.in_scope((t[1],), TABLE_SCOPE):
                self.pop_to(("select",))
                self.reset()
                self.dispatch(t)
        else:
            self.in_select(t)

    def in_template(self, t: tuple) -> None:
        kind, name = t[0], t[1] if len(t) > 1 else None
        if kind in ("chars", "comment", "doctype"):
            self.in_body(t)
        elif kind == "start":
            if name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
                self.in_head(t)
                return
            if name in ("caption", "colgroup", "tbody", "tfoot", "thead"):
                mode = self.in_table
            elif name == "col":
                mode = self.in_column_group
            elif name == "tr":
                mode = self.in_table_body
            elif name in ("td", "th"):
                mode = self.in_row
            else:
                mode = self.in_body
            self.templates[-1] = self.mode = mode
            self.dispatch(t)
        elif kind == "end":
            if name == "template":
                self.in_head(t)
        elif self.has("template"):
            self.pop_to(("template",))
            self.clear_active()
            self.templates.pop()
            self.reset()
            self.dispatch(t)

    def after_body(self, t: tuple) -> None:
        if t[0] == "chars" and not t[1].strip(WS):
            self.in_body(t)
        elif t[0] == "comment":
            self.comment(t[1], self.stack[0])
        elif t[:2] == ("end", "html"):
            if self.context is None:
                self.mode = self.after_after_body
        elif t[:2] == ("start", "html"):
            self.in_body(t)
        elif t[0] not in ("doctype", "eof"):
            self.mode = self.in_body
            self.dispatch(t)

    def in_frameset(self, t: tuple) -> None:
        if t[0] == "chars":
            self.text("".join(c for c in t[1] if c in WS))
        elif t[0] == "comment":
            self.comment(t[1])
        elif t[0] == "start":
            if t[1] == "html":
                self.in_body(t)
            elif t[1] == "frameset":
                self.push(t[1], t[2])
            elif t[1] == "frame":
                self.void(t[1], t[2])
            elif t[1] == "noframes":
                self.in_head(t)
        elif t[:2] == ("end", "frameset") and len(self.stack) > 1:
            self.stack.pop()
            if self.context is None and not _is(self.stack[-1], "frameset"):
                self.mode = self.after_frameset

    def after_frameset(self, t: tuple) -> None:
        if t[0] == "chars":
            self.text("".join(c for c in t[1] if c in WS))
        elif t[0] == "comment":
            self.comment(t[1])
        elif t[:2] == ("start", "html"):
            self.in_body(t)
        elif t[:2] == ("end", "html"):
            self.mode = self.after_after_frameset
        elif t[:2] == ("start", "noframes"):
            self.in_head(t)

    def after_after_body(self, t: tuple) -> None:
        if t[0] == "comment":
            self.comment(t[1], self.doc.node)
        elif t[0] == "doctype" or (t[0] == "chars" and not t[1].strip(WS)) or t[:2] == ("start", "html"):
            self.in_body(t)
        elif t[0] != "eof":
            self.mode = self.in_body
            self.dispatch(t)

    def after_after_frameset(self, t: tuple) -> None:
        if t[0] == "comment":
            self.comment(t[1], self.doc.node)
        elif t[0] == "chars":
            space = "".join(c for c in t[1] if c in WS)
            if space:
                self.in_body(("chars", space))
        elif t[:2] == ("start", "html"):
            self.in_body(t)
        elif t[:2] == ("start", "noframes"):
            self.in_head(t)

    def push_foreign(self, name: str, attrs: dict[str, str], ns: str, closing: bool) -> None:
        if ns == SVG_NS:
            name = SVG_TAGS.get(name, name)
            attrs = {SVG_ATTRS.get(k, k): v for k, v in attrs.items()}
        elif "definitionurl" in attrs:
            attrs = {"definitionURL" if k == "definitionurl" else k: v for k, v in attrs.items()}
        self.push(name, attrs, ns)
        if closing:
            self.stack.pop()

    def foreign(self, t: tuple) -> None:
        kind = t[0]
        if kind == "chars":
            self.text(t[1].replace("\0", "�"))
            if self.frameset_ok and t[1].strip(WS + "\0"):
                self.frameset_ok = False
        elif kind == "comment":
            self.comment(t[1])
        elif kind == "start":
            name, attrs = t[1], t[2]
            if name in BREAKOUT or (name == "font" and attrs.keys() & {"color", "face", "size"}):
                while len(self.stack) > 1 and not (self.stack[-1].ns == HTML_NS or _html_point(self.stack[-1]) or _math_text_point(self.stack[-1])):
                    self.stack.pop()
                self.mode(t)
                return
            self.push_foreign(name, attrs, self.adjusted().ns, t[3])
        elif kind == "end":
            if t[1] in ("br", "p"):
                while len(self.stack) > 1 and not (self.stack[-1].ns == HTML_NS or _html_point(self.stack[-1]) or _math_text_point(self.stack[-1])):
                    self.stack.pop()
                self.mode(t)
                return
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].local.lower() == t[1]:
                    del self.stack[k:]
                    return
                if self.stack[k - 1].ns == HTML_NS:
                    self.mode(t)
                    return


_LOWER = {c: c + 32 for c in range(65, 91)}
_RESET = {
    "tr": "in_row", "tbody": "in_table_body", "thead": "in_table_body", "tfoot": "in_table_body", "caption": "in_caption",
    "colgroup": "in_column_group", "table": "in_table", "body": "in_body", "frameset": "in_frameset",
}


def _is(node: Node, *names: str) -> bool:
    return node.ns == HTML_NS and node.local in names


def _special(node: Node) -> bool:
    if node.ns == HTML_NS:
        return node.local in SPECIAL
    return (node.ns, node.local) in SCOPE


def _attrs(node: Node) -> set:
    return {(a.ns, a.local, a.value) for a in node.attrs}


def _math_text_point(node: Node) -> bool:
    return node.ns == MATH_NS and node.local in ("mi", "mo", "mn", "ms", "mtext")


def _html_point(node: Node) -> bool:
    if node.ns == SVG_NS:
        return node.local in ("foreignObject", "desc", "title")
    return node.ns == MATH_NS and node.local == "annotation-xml" and (node.get("encoding") or "").lower() in ("text/html", "application/xhtml+xml")


def quirks(name: str, public: str | None, system: str | None, force: bool = False) -> int:
    """0 no quirks, 1 quirks, 2 limited quirks."""
    p, s = (public or "").lower(), (system or "").lower()
    if force or name != "html" or p in ("-//w3o//dtd w3 html strict 3.0//en//", "-/w3c/dtd html 4.0 transitional/en", "html"):
        return 1
    if s == "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd" or p.startswith(QUIRKS_PUBLIC):
        return 1
    late = ("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")
    if system is None and p.startswith(late):
        return 1
    return 2 if p.startswith(("-//w3c//dtd xhtml 1.0 frameset//", "-//w3c//dtd xhtml 1.0 transitional//", *late)) else 0


def parse(
    text: str,
    context: str | None = None,
    scripting: bool = False,
    max_depth: int | None = 400,
    url: str | None = None,
    max_attributes: int | None = 400,
    max_errors: int | None = None,
    open_references: bool = True,
) -> Document:
    """Parse a document, or with ``context`` ("body", "svg:path", ...) a fragment in that element.

    No input fails.  Elements nested deeper than ``max_depth`` are siblings at
    that depth, attributes of an element beyond ``max_attributes`` are left out;
    either is an error of the document.  At most ``max_errors`` errors are kept.
    HTML reads some references without a semicolon, as in "R&amp"; without
    ``open_references`` such text stays as it is written.
    """
    p = _Parser(text, context, scripting, max_depth, max_attributes, max_errors, open_references)
    p.run()
    doc = p.doc
    doc.errors, doc.url = p.errors, url
    if context is not None:
        root = doc.node.children[0]
        doc.node = Node(FRAGMENT)
        for c in root.children:
            doc.node.append(c)
        doc.kind = "fragment"
    return doc.number()
