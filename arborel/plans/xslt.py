"""XSLT 1.0: stylesheets compiled on the driver, run on each document where it lies."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from urllib.parse import urljoin

from ..functions import exslt, numbers
from ..sources import xml
from ..tree import ATTRIBUTE, CDATA, COMMENT, DOCUMENT, ELEMENT, FRAGMENT, PI, TEXT, XML_NS, Document, Node
from . import evaluate as E
from . import xpath

XSL = "http://www.w3.org/1999/XSL/Transform"
FUNC = "http://exslt.org/functions"
MAX_TEMPLATES = 3000


class XsltError(ValueError):
    """A stylesheet that isn't valid or a transformation that fails."""


@dataclass
class Template:
    node: Node
    match: tuple | None
    name: str | None
    mode: str | None
    priority: float
    precedence: int
    order: int


@dataclass
class Stylesheet:
    """A compiled stylesheet; it can be sent to executors."""

    templates: list[Template] = field(default_factory=list)
    named: dict[str, Template] = field(default_factory=dict)
    keys: dict[str, list[tuple[tuple, tuple, Node]]] = field(default_factory=dict)
    globals: dict[str, Node] = field(default_factory=dict)
    functions: dict[str, Node] = field(default_factory=dict)
    attribute_sets: dict[str, list[Node]] = field(default_factory=dict)
    output: dict[str, str] = field(default_factory=dict)
    formats: dict[str, dict[str, str]] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    strip: list[tuple[str, bool, Node]] = field(default_factory=list)
    excluded: set[str] = field(default_factory=set)


def compile_stylesheet(source: str | bytes | Document, url: str | None = None, resources: Mapping[str, bytes | str] | None = None) -> Stylesheet:
    """Compile a stylesheet; imports and includes come from ``resources``."""
    sheet = Stylesheet()
    _Compiler(sheet, resources or {}).load(source if isinstance(source, Document) else xml.parse(source, xml.STRICT, url))
    return sheet


class _Compiler:
    def __init__(self, sheet: Stylesheet, resources: Mapping[str, bytes | str]):
        self.sheet, self.resources, self.precedence, self.order = sheet, resources, 0, 0

    def load(self, doc: Document, seen: tuple[str, ...] = ()) -> None:
        root = doc.root
        if root is None or root.ns != XSL or root.local not in ("stylesheet", "transform"):
            if root is None or root.get("version", XSL) is None:
                raise XsltError("not a stylesheet")
            wrapper, template = Node(ELEMENT, "stylesheet", ns=XSL), Node(ELEMENT, "template", ns=XSL)
            template.set("match", "/")
            wrapper.append(template).append(root.unlink())
            root = wrapper
        _strip_stylesheet(root)
        for c in list(root.children):
            if c.kind == ELEMENT and c.ns == XSL and c.local == "import":
                self._load(doc, c, seen)
        self._top(doc, root, seen)
        self.precedence += 1

    def _load(self, doc: Document, c: Node, seen: tuple[str, ...]) -> Document:
        uri = urljoin(doc.url or "", c.get("href") or "")
        if uri in seen:
            raise XsltError(f"{uri} imports itself")
        if uri not in self.resources:
            raise XsltError(f"unable to load {uri}")
        other = xml.parse(self.resources[uri], xml.STRICT, uri)
        if c.local == "import":
            self.load(other, (*seen, uri))
        else:
            _strip_stylesheet(other.root)
            for i in other.root.children:
                if i.kind == ELEMENT and i.ns == XSL and i.local == "import":
                    self._load(other, i, (*seen, uri))
            self._top(other, other.root, (*seen, uri))
        return other

    def _top(self, doc: Document, root: Node, seen: tuple[str, ...]) -> None:
        s = self.sheet
        for p in ((root.get("extension-element-prefixes") or "") + " " + (root.get("exclude-result-prefixes") or "")).split():
            s.excluded.add((root.lookup("" if p == "#default" else p)) or "")
        for c in root.children:
            if c.kind != ELEMENT:
                continue
            if c.ns == FUNC and c.local == "function":
                s.functions[expanded(c, c.get("name"))] = c
                continue
            if c.ns != XSL:
                continue
            name = c.get("name")
            if c.local == "include":
                self._load(doc, c, seen)
            elif c.local == "template":
                self._template(c)
            elif c.local == "key":
                s.keys.setdefault(name, []).append((xpath.parse(c.get("match")), xpath.parse(c.get("use")), c))
            elif c.local in ("variable", "param"):
                s.globals[expanded(c, name)] = c
            elif c.local == "attribute-set":
                s.attribute_sets.setdefault(name, []).append(c)
            elif c.local == "output":
                s.output |= {a.local: a.value for a in c.attrs if a.local != "cdata-section-elements"}
                if c.get("cdata-section-elements"):
                    s.output["cdata-section-elements"] = (s.output.get("cdata-section-elements", "") + " " + c.get("cdata-section-elements")).strip()
            elif c.local == "decimal-format":
                s.formats[name or ""] = {a.local: a.value for a in c.attrs}
            elif c.local == "namespace-alias":
                get = lambda p: (c.lookup("") if p == "#default" else c.lookup(p)) or ""  # noqa: B023, E731
                s.aliases[get(c.get("stylesheet-prefix"))] = get(c.get("result-prefix"))
            elif c.local in ("strip-space", "preserve-space"):
                s.strip += [(t, c.local == "strip-space", c) for t in (c.get("elements") or "").split()]

    def _template(self, c: Node) -> None:
        self.order += 1
        given = c.get("priority")
        mode = c.get("mode")
        if c.get("match"):
            tree = xpath.parse(c.get("match"))
            for part in alternatives(tree):
                p = float(given) if given else default_priority(part)
                self.sheet.templates.append(Template(c, part, c.get("name"), mode, p, self.precedence, self.order))
        if c.get("name"):
            self.sheet.named[expanded(c, c.get("name"))] = Template(c, None, c.get("name"), mode, 0, self.precedence, self.order)


def _strip_stylesheet(root: Node) -> None:
    for n in list(root.walk()):
        if n.kind == ELEMENT and not (n.ns == XSL and n.local == "text") and not _preserved(n):
            n.children = [c for c in n.children if not (c.kind in (TEXT, CDATA) and not c.value.strip(E.BLANKS)) and c.kind not in (COMMENT, PI)]


def _preserved(n: Node) -> bool:
    for a in (n, *n.ancestors()):
        v = a.get("space", XML_NS)
        if v is not None:
            return v == "preserve"
    return False


def expanded(at: Node, name: str | None) -> str:
    prefix, _, local = (name or "").rpartition(":")
    return f"{{{at.lookup(prefix)}}}{local}" if prefix else local


def alternatives(tree: tuple) -> list[tuple]:
    return alternatives(tree[2]) + alternatives(tree[3]) if tree[:2] == ("binary", "|") else [tree]


def default_priority(tree: tuple) -> float:
    if tree[0] != "path" or tree[1] or tree[2] is not None or len(tree[3]) != 1 or tree[3][0][2]:
        return 0.5
    _, test, _ = tree[3][0]
    if test[0] == "type":
        return 0.0 if test[1] == "processing-instruction" and test[2] is not None else -0.5
    return 0.0 if test[2] is not None else -0.25 if test[1] else -0.5


class _Run:
    def __init__(self, sheet: Stylesheet, doc: Document, params: Mapping[str, object], resources: Mapping[str, bytes | str]):
        self.sheet, self.doc, self.resources = sheet, doc, resources
        self.params = params
        self.messages: list[str] = []
        self.documents: dict[str, Node] = {}
        self.extra: dict[str, Document] = {}
        self.key_tables: dict[tuple[int, str], dict[str, list[Node]]] = {}
        self.global_values: dict[str, object] = {}
        self.computing: set[str] = set()
        self.depth = 0
        self.rule: Template | None = None
        self.serial: dict[int, tuple[int, Node]] = {}
        self.functions: dict[str, Callable] = {
            "current": lambda c, n: [c.current], "key": self._key, "document": self._document, "format-number": self._format_number, "generate-id": self._generate_id,
            "system-property": self._system_property, "element-available": lambda c, n, v: E.string(v).rpartition(":")[2] in INSTRUCTIONS,
            "function-available": self._function_available, "unparsed-entity-uri": self._entity_uri,
        }
        for name, node in sheet.functions.items():
            self.functions[name] = self._user_function(node)
        self._strip(doc.node)
        doc.number()

    # -- contexts --------------------------------------------------------
    def context(self, at: Node, variables: dict, current: Node) -> E.Context:
        c = E.Context(self.doc, at.in_scope(), _Scope(self, variables, at), self.functions)
        c.variables = _Scope(self, variables, at)
        c.current = current
        return c

    def eval(self, text: str, at: Node, node: Node, variables: dict, place=(1, 1)):
        return E.evaluate(xpath.parse(text), node, self.context(at, variables, node), *place)

    def variable(self, name: str):
        if name in self.global_values:
            return self.global_values[name]
        node = self.sheet.globals.get(name)
        if node is None:
            raise E.XPathError(f"undefined variable {name}")
        if name in self.computing:
            raise XsltError(f"variable {name} depends on itself")
        self.computing.add(name)
        if node.local == "param" and name in self.params:
            v = self.params[name]
        else:
            v = self.value_of(node, self.doc.node, {}, (1, 1))
        self.computing.discard(name)
        self.global_values[name] = v
        return v

    def value_of(self, node: Node, at: Node, variables: dict, place):
        """The value of a variable or parameter element."""
        if node.get("select") is not None:
            return self.eval(node.get("select"), node, at, variables, place)
        if not node.children:
            return ""
        holder = Node(FRAGMENT)
        self.body(node, at, dict(variables), holder, place)
        Document(holder).number()
        return [holder]

    def _strip(self, root: Node) -> None:
        if not self.sheet.strip:
            return

        def stripped(n: Node) -> bool:
            best = (-2.0, 0, False)
            for k, (t, s, at) in enumerate(self.sheet.strip):
                prefix, _, local = t.rpartition(":")
                uri = at.lookup(prefix) if prefix else None
                if t == "*":
                    rank = -0.5
                elif local == "*" and n.ns == uri:
                    rank = -0.25
                elif local == n.local and n.ns == uri:
                    rank = 0.0
                else:
                    continue
                best = max(best, (rank, k, s))
            return best[2]

        for n in list(root.walk()):
            if n.kind == ELEMENT and any(c.kind == TEXT and not c.value.strip(E.BLANKS) for c in n.children) and stripped(n) and not _preserved(n):
                n.children = [c for c in n.children if c.kind != TEXT or c.value.strip(E.BLANKS)]

    # -- matching --------------------------------------------------------
    def matches(self, pattern: tuple, node: Node, at: Node) -> bool:
        if pattern[0] == "call":  # id() and key()
            found = E.evaluate(pattern, node, self.context(at, {}, node))
            return any(n is node for n in found)
        if pattern[0] == "filter":
            return self.matches(pattern[1], node, at)
        _, absolute, start, steps = pattern
        return self._steps(steps, len(steps) - 1, node, absolute, start, at)

    def _steps(self, steps: tuple, k: int, node: Node | None, absolute: bool, start: tuple | None, at: Node) -> bool:
        if k < 0:
            if absolute:
                return node is not None and node.parent is None and node.kind in (DOCUMENT, FRAGMENT)
            if start is not None:
                return node is not None and self.matches(start, node, at)
            return True
        axis, test, predicates = steps[k]
        if node is None:
            return False
        if axis in ("descendant-or-self", "descendant") and test == ("type", "node", None) and not predicates:
            n: Node | None = node
            while n is not None:
                if self._steps(steps, k - 1, n, absolute, start, at):
                    return True
                n = n.parent
            return False
        principal = ATTRIBUTE if axis == "attribute" else ELEMENT
        if (axis == "attribute") != (node.kind == ATTRIBUTE) or (test[0] == "type" and node.kind in (DOCUMENT, FRAGMENT)):
            return False
        context = self.context(at, {}, node)
        if not E.matches(test, node, principal, context):
            return False
        if predicates:
            if node.parent is None:
                return False
            pool = [m for m in (node.parent.attrs if axis == "attribute" else node.parent.children) if E.matches(test, m, principal, context)]
            if axis == "descendant":
                pool = [m for a in list(node.ancestors())[-1:] for m in a.walk() if E.matches(test, m, principal, context)]
            for p in predicates:
                pool = E.filtered(pool, p, context)
            if not any(m is node for m in pool):
                return False
        if axis == "descendant":
            return any(self._steps(steps, k - 1, a, absolute, start, at) for a in node.ancestors())
        rest_is_path = k > 0 or absolute or start is not None
        return not rest_is_path or self._steps(steps, k - 1, node.parent, absolute, start, at)

    def find(self, node: Node, mode: str | None, below: int | None = None) -> Template | None:
        best: Template | None = None
        for t in self.sheet.templates:
            if t.mode != mode or (below is not None and t.precedence >= below):
                continue
            if best is not None and (t.precedence, t.priority, t.order) <= (best.precedence, best.priority, best.order):
                continue
            if self.matches(t.match, node, t.node):
                best = t
        return best

    # -- instructions ----------------------------------------------------
    def apply(self, nodes: list[Node], mode: str | None, out: Node, params: dict) -> None:
        for k, n in enumerate(nodes, 1):
            self.one(n, mode, out, params, (k, len(nodes)), self.find(n, mode))

    def one(self, node: Node, mode: str | None, out: Node, params: dict, place, template: Template | None) -> None:
        if template is None:
            if node.kind in (ELEMENT, DOCUMENT, FRAGMENT):
                self.apply([c for c in node.children if c.kind != 10], mode, out, {})
            elif node.kind in (TEXT, CDATA, ATTRIBUTE):
                write_text(out, node.value)
            return
        self.call(template, node, out, params, place)

    def call(self, t: Template, node: Node, out: Node, params: dict, place) -> None:
        self.depth += 1
        if self.depth > MAX_TEMPLATES:
            raise XsltError("templates nest too deeply")
        rule, self.rule = self.rule, t if t.match is not None else self.rule
        try:
            self.body(t.node, node, {"": params}, out, place)
        finally:
            self.rule = rule
            self.depth -= 1

    def body(self, parent: Node, node: Node, variables: dict, out: Node, place) -> None:
        for c in parent.children:
            if c.kind in (TEXT, CDATA):
                write_text(out, c.value)
            elif c.kind == ELEMENT:
                if c.ns == XSL:
                    self.instruction(c, node, variables, out, place)
                elif c.ns == FUNC and c.local == "result":
                    variables["\0result"] = self.value_of(c, node, variables, place)
                elif c.local == "document" and c.ns == exslt.COMMON:
                    holder = Node(DOCUMENT)
                    self.body(c, node, dict(variables), holder, place)
                    self.extra[self.avt(c.get("href") or "", c, node, variables)] = Document(holder).number()
                else:
                    self.literal(c, node, variables, out, place)

    def literal(self, c: Node, node: Node, variables: dict, out: Node, place) -> None:
        ns = self.sheet.aliases.get(c.ns or "", c.ns)
        new = out.append(Node(ELEMENT, c.local, ns=ns, prefix=c.prefix))
        skip = {XSL, FUNC, *self.sheet.excluded, *(c.lookup(p) or "" for p in (c.get("exclude-result-prefixes", XSL) or "").split())}
        for p, u in c.in_scope().items():
            if p != "xml" and u not in skip and out_scope(out, p) != u:
                new.decls.append((p, self.sheet.aliases.get(u, u)))
        if (ns or "") != (new.lookup(c.prefix or "") or ""):
            new.decls.append((c.prefix or "", ns or ""))
        for name in (c.get("use-attribute-sets", XSL) or "").split():
            self.attribute_set(name, node, variables, new, place)
        for a in c.attrs:
            if a.ns != XSL:
                x = new.set(a.local, self.avt(a.value, c, node, variables, place), a.ns)
                x.prefix = a.prefix
        self.body(c, node, dict(variables), new, place)

    def attribute_set(self, name: str, node: Node, variables: dict, out: Node, place) -> None:
        for s in self.sheet.attribute_sets.get(name, []):
            for inner in (s.get("use-attribute-sets") or "").split():
                self.attribute_set(inner, node, variables, out, place)
            self.body(s, node, {}, out, place)

    def avt(self, text: str, at: Node, node: Node, variables: dict, place=(1, 1)) -> str:
        if "{" not in text and "}" not in text:
            return text
        parts = re.split(r"(\{\{|\}\}|\{(?:[^{}\"']|\"[^\"]*\"|'[^']*')*\})", text)
        out = []
        for p in parts:
            if p in ("{{", "}}"):
                out.append(p[0])
            elif p.startswith("{") and p.endswith("}"):
                out.append(E.string(self.eval(p[1:-1], at, node, variables, place)))
            else:
                out.append(p)
        return "".join(out)

    def instruction(self, c: Node, node: Node, variables: dict, out: Node, place) -> None:
        handler = getattr(self, "i_" + c.local.replace("-", "_"), None)
        if handler is None:
            fallback = [f for f in c.children if f.ns == XSL and f.local == "fallback"]
            for f in fallback:
                self.body(f, node, dict(variables), out, place)
            if not fallback and c.local not in ("fallback",):
                raise XsltError(f"xsl:{c.local} is not known")
            return
        handler(c, node, variables, out, place)

    def i_apply_templates(self, c, node, variables, out, place):
        nodes = self.eval(c.get("select"), c, node, variables, place) if c.get("select") else [x for x in node.children if x.kind != 10]
        if not isinstance(nodes, list):
            raise XsltError("apply-templates needs nodes")
        self.apply(self.sorted(c, E.ordered(nodes), variables), c.get("mode"), out, self.with_params(c, node, variables, place))

    def i_apply_imports(self, c, node, variables, out, place):
        rule = self.rule
        self.one(node, rule.mode if rule else None, out, {}, place, self.find(node, rule.mode if rule else None, rule.precedence if rule else 0))

    def i_call_template(self, c, node, variables, out, place):
        t = self.sheet.named.get(expanded(c, c.get("name")))
        if t is None:
            raise XsltError(f"no template {c.get('name')}")
        self.call(t, node, out, self.with_params(c, node, variables, place), place)

    def with_params(self, c, node, variables, place) -> dict:
        return {expanded(p, p.get("name")): self.value_of(p, node, variables, place) for p in c.children if p.ns == XSL and p.local == "with-param"}

    def i_for_each(self, c, node, variables, out, place):
        nodes = self.eval(c.get("select"), c, node, variables, place)
        nodes = self.sorted(c, E.ordered(nodes), variables)
        for k, n in enumerate(nodes, 1):
            self.body(c, n, dict(variables), out, (k, len(nodes)))

    def sorted(self, c: Node, nodes: list[Node], variables: dict) -> list[Node]:
        sorts = [s for s in c.children if s.ns == XSL and s.local == "sort"]
        for s in reversed(sorts):
            node = nodes[0] if nodes else self.doc.node
            kind = self.avt(s.get("data-type") or "text", s, node, variables)
            down = self.avt(s.get("order") or "ascending", s, node, variables) == "descending"
            upper = self.avt(s.get("case-order") or "", s, node, variables) == "upper-first"
            values = [E.string(self.eval(s.get("select") or ".", s, n, variables, (k, len(nodes)))) for k, n in enumerate(nodes, 1)]
            if kind == "number":
                key = [(not math.isnan(x), 0.0 if math.isnan(x) else x) for x in map(numbers.to_number, values)]
            elif s.get("lang") or s.get("case-order"):
                key = [(v.casefold(), v if upper else v.swapcase()) for v in values]
            else:
                key = [v.encode() for v in values]
            order = sorted(range(len(nodes)), key=key.__getitem__, reverse=down)
            if down:  # equal keys stay in document order
                order = [i for _, run in _runs(order, key) for i in sorted(run)]
            nodes = [nodes[i] for i in order]
        return nodes

    def i_sort(self, c, node, variables, out, place):
        return None

    i_with_param = i_fallback = i_sort

    def i_if(self, c, node, variables, out, place):
        if E.boolean(self.eval(c.get("test"), c, node, variables, place)):
            self.body(c, node, dict(variables), out, place)

    def i_choose(self, c, node, variables, out, place):
        for w in c.children:
            if w.ns == XSL and (w.local == "otherwise" or E.boolean(self.eval(w.get("test"), w, node, variables, place))):
                self.body(w, node, dict(variables), out, place)
                return

    def i_value_of(self, c, node, variables, out, place):
        write_text(out, E.string(self.eval(c.get("select"), c, node, variables, place)), c.get("disable-output-escaping") == "yes")

    def i_text(self, c, node, variables, out, place):
        write_text(out, "".join(x.value for x in c.children if x.kind in (TEXT, CDATA)), c.get("disable-output-escaping") == "yes")

    def i_copy(self, c, node, variables, out, place):
        if node.kind == ELEMENT:
            new = Node(ELEMENT, node.local, ns=node.ns, prefix=node.prefix)
            out.append(new)
            new.decls = [(p, u) for p, u in node.in_scope().items() if p != "xml" and out_scope(out, p) != u]
            for name in (c.get("use-attribute-sets") or "").split():
                self.attribute_set(name, node, variables, new, place)
            self.body(c, node, dict(variables), new, place)
        elif node.kind in (DOCUMENT, FRAGMENT):
            self.body(c, node, dict(variables), out, place)
        else:
            copy_to(out, node)

    def i_copy_of(self, c, node, variables, out, place):
        v = self.eval(c.get("select"), c, node, variables, place)
        if isinstance(v, list):
            for n in E.ordered(v):
                copy_to(out, n)
        else:
            write_text(out, E.string(v))

    def i_element(self, c, node, variables, out, place):
        name = self.avt(c.get("name"), c, node, variables, place)
        prefix, _, local = name.rpartition(":")
        ns = self.avt(c.get("namespace"), c, node, variables, place) if c.get("namespace") is not None else c.lookup(prefix)
        new = out.append(Node(ELEMENT, local, ns=ns or None, prefix=prefix or None))
        if (out_scope(out, prefix) or "") != (ns or ""):
            new.decls.append((prefix, ns or ""))
        for s in (c.get("use-attribute-sets") or "").split():
            self.attribute_set(s, node, variables, new, place)
        self.body(c, node, dict(variables), new, place)

    def i_attribute(self, c, node, variables, out, place):
        name = self.avt(c.get("name"), c, node, variables, place)
        prefix, _, local = name.rpartition(":")
        ns = self.avt(c.get("namespace"), c, node, variables, place) if c.get("namespace") is not None else c.lookup(prefix) if prefix else None
        holder = Node(FRAGMENT)
        self.body(c, node, dict(variables), holder, place)
        if out.kind == ELEMENT and not out.children:
            x = out.set(local, holder.text(), ns or None)
            x.prefix = (prefix or "ns0") if ns else None
            if ns and out.lookup(x.prefix) != ns:
                out.decls.append((x.prefix, ns))

    def i_comment(self, c, node, variables, out, place):
        holder = Node(FRAGMENT)
        self.body(c, node, dict(variables), holder, place)
        out.append(Node(COMMENT, "", holder.text()))

    def i_processing_instruction(self, c, node, variables, out, place):
        holder = Node(FRAGMENT)
        self.body(c, node, dict(variables), holder, place)
        out.append(Node(PI, self.avt(c.get("name"), c, node, variables, place), holder.text()))

    def i_variable(self, c, node, variables, out, place):
        variables[expanded(c, c.get("name"))] = self.value_of(c, node, variables, place)

    def i_param(self, c, node, variables, out, place):
        name, given = expanded(c, c.get("name")), variables.get("", {})
        variables[name] = given[name] if name in given else self.value_of(c, node, variables, place)

    def i_message(self, c, node, variables, out, place):
        holder = Node(FRAGMENT)
        self.body(c, node, dict(variables), holder, place)
        self.messages.append(holder.text())
        if c.get("terminate") == "yes":
            raise XsltError(holder.text())

    def i_number(self, c, node, variables, out, place):
        if c.get("value") is not None:
            values = [E.number(self.eval(c.get("value"), c, node, variables, place))]
            if math.isnan(values[0]) or math.isinf(values[0]):
                write_text(out, numbers.to_string(values[0]))
                return
            values = [int(numbers.round_half_up(values[0]))]
        else:
            values = self._counted(c, node)
        get = lambda k, d: self.avt(c.get(k), c, node, variables, place) if c.get(k) is not None else d
        write_text(out, format_numbers(values, get("format", "1"), get("grouping-separator", ""), int(get("grouping-size", "0") or 0)))

    def _counted(self, c: Node, node: Node) -> list[int]:
        pattern = xpath.parse(c.get("count")) if c.get("count") else None
        start = xpath.parse(c.get("from")) if c.get("from") else None
        any_of = lambda p, n: any(self.matches(x, n, c) for x in alternatives(p))
        hit = (lambda n: any_of(pattern, n)) if pattern else lambda n: n.kind == node.kind and n.local == node.local and n.ns == node.ns
        level = c.get("level") or "single"
        if level == "any":
            count = 0
            for n in self.doc.node.walk():
                if start and any_of(start, n):
                    count = 0
                count += hit(n)
                if n is node:
                    break
            return [count] if count else []
        chain = []
        for n in (node, *node.ancestors()):
            if start and n is not node and any_of(start, n):
                break
            if n.kind != DOCUMENT and hit(n):
                chain.append(1 + sum(hit(s) for s in E.axis("preceding-sibling", n)))
                if level == "single":
                    break
        return chain[::-1]

    # -- functions -------------------------------------------------------
    def _key(self, context, node, name, value):
        name = E.string(name)
        root = node.root()
        table = self.key_tables.get((id(root), name))
        if table is None:
            table = {}
            for match, use, at in self.sheet.keys.get(name, []):
                for n in root.walk():
                    for m in (n, *n.attrs):
                        if any(self.matches(p, m, at) for p in alternatives(match)):
                            v = E.evaluate(use, m, self.context(at, {}, m))
                            for s in {x.text() for x in v} if isinstance(v, list) else {E.string(v)}:
                                table.setdefault(s, []).append(m)
            self.key_tables[(id(root), name)] = table
        wanted = [n.text() for n in value] if isinstance(value, list) else [E.string(value)]
        return E.ordered([n for w in wanted for n in table.get(w, [])])

    def _document(self, context, node, what, base=None):
        out = []
        for uri in [n.text() for n in what] if isinstance(what, list) else [E.string(what)]:
            uri = urljoin(self.doc.url or "", uri)
            if uri not in self.documents:
                source = self.resources.get(uri)
                if source is None:
                    continue
                self.documents[uri] = xml.parse(source, url=uri).node
            out.append(self.documents[uri])
        return out

    def _format_number(self, context, node, value, picture, name=""):
        return format_number(E.number(value), E.string(picture), self.sheet.formats.get(E.string(name), {}))

    def _generate_id(self, context, node, nodes=None):
        if nodes is not None and not nodes:
            return ""
        n = E.first(nodes) if nodes is not None else node
        return f"id{self.serial.setdefault(id(n), (len(self.serial) + 1, n))[0]}"

    def _system_property(self, context, node, name):
        return {"version": 1.0, "vendor": "arborel", "vendor-url": ""}.get(E.string(name).rpartition(":")[2], "")

    def _function_available(self, context, node, name):
        name = E.string(name)
        prefix, _, local = name.rpartition(":")
        return name in E.CORE or name in self.functions or f"{{{context.namespaces.get(prefix)}}}{local}" in {**E.EXTENSIONS, **self.functions}

    def _entity_uri(self, context, node, name):
        found = (self.doc.dtd.entities if self.doc.dtd else {}).get(E.string(name))
        return found[1] or "" if found and found[3] else ""

    def _user_function(self, node: Node) -> Callable:
        def fn(context, at, *args):
            variables: dict = {"": {}}
            names = [expanded(p, p.get("name")) for p in node.children if p.ns == XSL and p.local == "param"]
            variables[""] = dict(zip(names, args))
            self.body(node, at, variables, Node(FRAGMENT), (1, 1))
            return variables.get("\0result", "")

        return fn


class _Scope(dict):
    """Local variables over global ones; names may carry a prefix of the stylesheet."""

    def __init__(self, run: _Run, local: dict, at: Node):
        super().__init__()
        self.run, self.local, self.at = run, local, at

    def __contains__(self, name) -> bool:
        key = expanded(self.at, name)
        return key in self.local or key in self.run.sheet.globals

    def __getitem__(self, name):
        key = expanded(self.at, name)
        return self.local[key] if key in self.local else self.run.variable(key)


INSTRUCTIONS = {m[2:].replace("_", "-") for m in dir(_Run) if m.startswith("i_")}


def _runs(order: list[int], key: list) -> list[tuple]:
    out: list[tuple] = []
    for i in order:
        if out and out[-1][0] == key[i]:
            out[-1][1].append(i)
        else:
            out.append((key[i], [i]))
    return out


def out_scope(node: Node, prefix: str) -> str | None:
    return node.lookup(prefix)


def write_text(out: Node, text: str, raw: bool = False) -> None:
    if not text:
        return
    last = out.children[-1] if out.children else None
    if last is not None and last.kind == TEXT and last.is_id == raw:
        last.value += text
    else:
        out.append(Node(TEXT, "", text)).is_id = raw  # marks text that isn't to be escaped


def copy_to(out: Node, n: Node) -> None:
    if n.kind in (DOCUMENT, FRAGMENT):
        for c in n.children:
            if c.kind != 10:
                copy_to(out, c)
    elif n.kind == ATTRIBUTE:
        if out.kind == ELEMENT:
            out.set(n.local, n.value, n.ns).prefix = n.prefix
    elif n.kind == TEXT:
        write_text(out, n.value)
    else:
        new = n.copy()
        if n.kind == ELEMENT:
            new.decls = [(p, u) for p, u in n.in_scope().items() if p != "xml" and out_scope(out, p) != u]
        out.append(new)


def format_numbers(values: list[int], picture: str, separator: str = "", size: int = 0) -> str:
    """xsl:number formatting: tokens 1, 01, a, A, i and I with what stands between them."""
    parts = re.findall(r"[^\W_]+|[\W_]+", picture)
    tokens = [p for p in parts if p[0].isalnum()] or ["1"]
    prefix = parts[0] if parts and not parts[0][0].isalnum() else ""
    suffix = parts[-1] if len(parts) > 1 and not parts[-1][0].isalnum() else ""
    between = [p for p in parts[1:-1] if not p[0].isalnum()]
    out = prefix
    for k, v in enumerate(values):
        if k:
            out += between[min(k, len(between)) - 1] if between else "."
        t = tokens[min(k, len(tokens) - 1)]
        if t in ("a", "A") and v > 0:
            s, n = "", v
            while n:
                n, r = divmod(n - 1, 26)
                s = chr(97 + r) + s
            out += s.upper() if t == "A" else s
        elif t in ("i", "I") and 0 < v < 5000:
            s, n = "", v
            for base, letters in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
                s += letters * (n // base)
                n %= base
            out += s.upper() if t == "I" else s
        else:
            s = str(abs(v)).zfill(len(t) if t.isdigit() else 1)
            if separator and size > 0:
                s = separator.join([s[max(0, i - size) : i] for i in range(len(s), 0, -size)][::-1])
            out += "-" * (v < 0) + s
    return out + suffix if values else ""


def format_number(x: float, picture: str, symbols: Mapping[str, str] | None = None) -> str:
    """format-number() with a decimal format's symbols."""
    s = {"decimal-separator": ".", "grouping-separator": ",", "percent": "%", "per-mille": "‰", "zero-digit": "0", "digit": "#", "pattern-separator": ";", "minus-sign": "-", "infinity": "Infinity", "NaN": "NaN"} | dict(symbols or {})
    if math.isnan(x):
        return s["NaN"]
    positive, _, negative = picture.partition(s["pattern-separator"])
    mark = re.escape(s["digit"] + s["zero-digit"] + s["decimal-separator"] + s["grouping-separator"])
    m = re.search(f"[{mark}]+", positive)
    sign = s["minus-sign"] if x < 0 and not negative else ""
    if not m:
        return sign + positive
    prefix, body, suffix = positive[: m.start()], m[0], positive[m.end() :]
    if x < 0 and negative:  # its digits say nothing, only what stands around them
        n = re.search(f"[{mark}]+", negative)
        prefix, suffix = (negative[: n.start()], negative[n.end() :]) if n else (negative, "")
    x = abs(x)
    if s["percent"] in prefix + suffix:
        x *= 100
    elif s["per-mille"] in prefix + suffix:
        x *= 1000
    if math.isinf(x):
        return sign + prefix + s["infinity"] + suffix
    whole, _, fraction = body.partition(s["decimal-separator"])
    group = len(whole) - whole.rfind(s["grouping-separator"]) - 1 if s["grouping-separator"] in whole else 0
    least, low, high = whole.count(s["zero-digit"]), fraction.count(s["zero-digit"]), len(fraction)
    text = f"{x:.{high}f}"
    a, _, b = text.partition(".")
    b = b.rstrip("0").ljust(low, "0") if len(b.rstrip("0")) < low else b.rstrip("0")
    a = a.lstrip("0").rjust(least, "0") or ("" if b else "0")
    if group:
        a = s["grouping-separator"].join([a[max(0, i - group) : i] for i in range(len(a), 0, -group)][::-1])
    out = a + (s["decimal-separator"] + b if b else "")
    zero = ord(s["zero-digit"]) - 48
    if zero:
        out = "".join(chr(ord(c) + zero) if c.isascii() and c.isdigit() else c for c in out)
    return sign + prefix + out + suffix


def transform(sheet: Stylesheet, doc: Document, params: Mapping[str, object] | None = None, resources: Mapping[str, bytes | str] | None = None) -> Document:
    """The result tree; ``params`` are values (strings are strings, not expressions)."""
    return run(sheet, doc, params, resources)[0]


def run(sheet: Stylesheet, doc: Document, params: Mapping[str, object] | None = None, resources: Mapping[str, bytes | str] | None = None) -> tuple[Document, list[str], dict[str, Document]]:
    """(result, messages, further result documents by href)."""
    r = _Run(sheet, doc, params or {}, resources or {})
    out = Document(Node(DOCUMENT))
    r.apply([doc.node], None, out.node, {})
    return out.number(), r.messages, r.extra


def serialize(sheet: Stylesheet, result: Document) -> str:
    """The result as xsl:output says."""
    from ..operators import serialize as S

    o = sheet.output
    root = result.root
    method = o.get("method") or ("html" if root is not None and root.local.lower() == "html" and root.ns is None else "xml")
    if method == "text":
        return result.node.text()
    names = set((o.get("cdata-section-elements") or "").split())
    for n in result.node.walk():
        if n.kind == TEXT and n.parent is not None and n.parent.name in names:
            n.kind = CDATA
    raw = [n for n in result.node.walk() if n.kind == TEXT and n.is_id]
    marks = {}
    for k, n in enumerate(raw):  # unescaped text passes the writer as a mark in private characters
        mark = f"\ue000{k}\ue001"
        marks[mark], n.value = n.value, mark
    if o.get("doctype-system") or o.get("doctype-public"):
        result.doctype = (root.name if root is not None else "", o.get("doctype-public"), o.get("doctype-system"))
    indent = 2 if o.get("indent") == "yes" else 0
    if method == "html":
        text = S.to_html(result)
    else:
        result.standalone = {"yes": 1, "no": 0}.get(o.get("standalone", ""), -1)
        result.encoding, result.version = o.get("encoding"), o.get("version")
        omit = o.get("omit-xml-declaration") == "yes"
        text = S.to_xml(result, indent, not omit)
        if result.doctype:
            kind = S._doctype(result) + "\n"
            text = text.replace("?>\n", "?>\n" + kind, 1) if not omit else kind + text
    for mark, value in marks.items():
        text = text.replace(mark, value)
    return text
