"""Validation of documents against DTDs, XSD schemas and RELAX NG, and identity constraints as joins.

Schemas are compiled on the driver and sent with the task; each document is
validated where it lies.  Content models are matched by derivatives.  The
wording of errors is fixed: users match on these texts.  Identity
constraints over tables (:func:`unique_violations` and the like) are
aggregations and anti-joins on DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import evaluate as E
from ..plans import xpath
from ..sources import xml
from ..tree import CDATA, ELEMENT, TEXT, XMLNS_NS, Document, Dtd, Node
from .xsd_types import BUILT_IN, SimpleType

XS = "http://www.w3.org/2001/XMLSchema"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
RNG = "http://relaxng.org/ns/structure/1.0"
DATATYPES = "http://www.w3.org/2001/XMLSchema-datatypes"

# -- content models by derivatives ---------------------------------------
# ("empty",), ("none",), ("leaf", key), ("seq", a, b), ("choice", a, b), ("all", a, b), ("repeat", a, low, high)
EMPTY, NONE = ("empty",), ("none",)


def seq(a, b):
    if NONE in (a, b):
        return NONE
    return b if a == EMPTY else a if b == EMPTY else ("seq", a, b)


def choice(a, b):
    return b if a == NONE or a == b else a if b == NONE else ("choice", a, b)


def both(a, b):
    """Interleaving."""
    if NONE in (a, b):
        return NONE
    return b if a == EMPTY else a if b == EMPTY else ("all", a, b)


def repeat(a, low: int, high: int | None):
    if high == 0 or a == EMPTY:
        return EMPTY
    return EMPTY if a == NONE and low == 0 else a if (low, high) == (1, 1) else ("repeat", a, low, high)


@lru_cache(maxsize=65536)
def nullable(p) -> bool:
    if p[0] in ("seq", "all"):
        return nullable(p[1]) and nullable(p[2])
    if p[0] == "choice":
        return nullable(p[1]) or nullable(p[2])
    return p[0] == "empty" or (p[0] == "repeat" and (p[2] == 0 or nullable(p[1])))


@lru_cache(maxsize=65536)
def derive(p, key):
    """What may follow once a leaf ``key`` is read."""
    if p[0] == "leaf":
        return EMPTY if p[1] == key else NONE
    if p[0] == "choice":
        return choice(derive(p[1], key), derive(p[2], key))
    if p[0] == "seq":
        first = seq(derive(p[1], key), p[2])
        return choice(first, derive(p[2], key)) if nullable(p[1]) else first
    if p[0] == "all":
        return choice(both(derive(p[1], key), p[2]), both(p[1], derive(p[2], key)))
    if p[0] == "repeat":
        return seq(derive(p[1], key), repeat(p[1], max(0, p[2] - 1), None if p[3] is None else p[3] - 1))
    return NONE


@lru_cache(maxsize=65536)
def leaves(p) -> frozenset:
    """Leaves that may come next."""
    if p[0] == "leaf":
        return frozenset([p[1]])
    if p[0] == "seq":
        return leaves(p[1]) | (leaves(p[2]) if nullable(p[1]) else frozenset())
    if p[0] in ("choice", "all"):
        return leaves(p[1]) | leaves(p[2])
    return leaves(p[1]) if p[0] == "repeat" else frozenset()


# -- DTD -----------------------------------------------------------------
def _dtd_particle(model: tuple):
    """From expat's (type, quantifier, name, children)."""
    kind, quantifier, name, children = model
    if kind == 4:
        out = ("leaf", name)
    elif kind in (5, 3):  # choice, mixed
        out = NONE
        for c in children:
            out = choice(out, _dtd_particle(c))
    else:
        out = EMPTY
        for c in children:
            out = seq(out, _dtd_particle(c))
    return repeat(out, *{0: (1, 1), 1: (0, 1), 2: (0, None), 3: (1, None)}[quantifier])


def validate_dtd(document: Document, dtd: Dtd | None = None) -> list[str]:
    """Errors of a document against its own or another DTD."""
    d = dtd or document.dtd
    if d is None:
        return ["no DTD found!"]
    errors: list[str] = []
    root = document.root
    if root is not None and dtd is None and d.name and root.name != d.name:
        errors.append(f"root and DTD name do not match '{root.name}' and '{d.name}'")
    ids: dict[str, Node] = {}
    references: list[str] = []
    for n in document.node.walk():
        if n.kind != ELEMENT:
            continue
        model = d.elements.get(n.name)
        if model is None:
            errors.append(f"No declaration for element {n.name}")
        else:
            errors += _dtd_content(n, model)
        declared = {a: v for (e, a), v in d.attributes.items() if e == n.name}
        for a in n.attrs:
            rule = declared.get(a.name)
            if rule is None:
                errors.append(f"No declaration for attribute {a.name} of element {n.name}")
                continue
            kind, default, required = rule
            if kind == "ID":
                if a.value in ids:
                    errors.append(f"ID {a.value} already defined")
                ids[a.value] = n
            elif kind in ("IDREF", "IDREFS"):
                references += a.value.split()
            elif kind.startswith("(") and a.value not in kind[1:-1].split("|"):
                errors.append(f"Value \"{a.value}\" for attribute {a.name} of {n.name} is not among the enumerated set")
            elif kind.startswith("NOTATION(") and a.value not in kind[9:-1].split("|"):
                errors.append(f"Value \"{a.value}\" for attribute {a.name} of {n.name} is not among the enumerated notations")
            elif kind in ("ENTITY", "ENTITIES"):
                errors += [f"ENTITY attribute {a.name} references an unknown entity \"{e}\"" for e in a.value.split() if e not in d.entities]
            elif kind.startswith("NMTOKEN") and not a.value.split():
                errors.append(f"Syntax of value for attribute {a.name} of {n.name} is not valid")
            if required and default is not None and a.value != default:
                errors.append(f"Value for attribute {a.name} of {n.name} is different from default \"{default}\"")
        have = {a.name for a in n.attrs}
        errors += [f"Element {n.name} does not carry attribute {a}" for a, (_, default, required) in sorted(declared.items()) if required and default is None and a not in have]
    errors += [f"IDREF attribute references an unknown ID \"{r}\"" for r in references if r not in ids]
    return errors


def _dtd_content(n: Node, model: tuple) -> list[str]:
    kind = model[0]
    names = [c.name for c in n.children if c.kind == ELEMENT]
    text = any(c.kind == CDATA or (c.kind == TEXT and c.value.strip(E.BLANKS)) for c in n.children)
    if kind == 2:  # ANY
        return []
    if kind == 1:  # EMPTY
        return [f"Element {n.name} was declared EMPTY this one has content"] if n.children else []
    if kind == 3:
        allowed = {c[2] for c in model[3]}
        return [f"Element {x} is not declared in {n.name} list of possible children" for x in names if x not in allowed]
    if text:
        return [f"Element {n.name} content does not follow the DTD, text not allowed"]
    p = _dtd_particle(model)
    for x in names:
        p = derive(p, x)
    return [] if nullable(p) else [f"Element {n.name} content does not follow the DTD, got ({' '.join(names)})"]


def content_text(model: tuple) -> str:
    """A content model as a document type writes it."""
    kind, quantifier, name, parts = model
    if kind in (1, 2):
        return {1: "EMPTY", 2: "ANY"}[kind]
    if kind == 3:
        return f"({' | '.join(['#PCDATA', *(c[2] for c in parts)])}){'*' if parts else ''}"
    inside = name if kind == 4 else f"({(' | ' if kind == 5 else ' , ').join(content_text(c) for c in parts)})"
    return inside + ["", "?", "*", "+"][quantifier]


# -- XSD -----------------------------------------------------------------
@dataclass
class ElementDecl:
    name: tuple[str | None, str]
    type: "SimpleType | ComplexType | None" = None
    default: str | None = None
    fixed: str | None = None
    nillable: bool = False
    abstract: bool = False
    head: tuple[str | None, str] | None = None
    constraints: list[tuple] = field(default_factory=list)  # (kind, name, selector, fields, refer, bindings)


@dataclass
class ComplexType:
    name: str = ""
    particle: tuple = EMPTY
    mixed: bool = False
    simple: SimpleType | None = None
    attributes: dict[tuple[str | None, str], tuple] = field(default_factory=dict)  # (type, use, default, fixed)
    any_attribute: bool = False
    base: "ComplexType | SimpleType | None" = None
    abstract: bool = False
    derivation: str = ""
    any: bool = False


class SchemaError(ValueError):
    """A schema that can't be compiled."""


class Schema:
    """An XSD 1.0 schema; includes, imports and redefinitions come from ``resources``."""

    def __init__(self, source: str | bytes | Document, resources: Mapping[str, bytes | str] | None = None, url: str | None = None):
        self.resources = dict(resources or {})
        self.elements: dict[tuple, ElementDecl] = {}
        self.leaf: dict[object, ElementDecl] = {}
        self.nodes: dict[tuple, tuple[Node, str | None, bool, bool]] = {}  # (kind, ns, name) -> node, target, qualified elements, attributes
        self.types: dict[tuple, SimpleType | ComplexType] = {}
        self.loaded: set = set()
        self.members: dict[tuple, set[tuple]] = {}
        doc = source if isinstance(source, Document) else xml.parse(source, xml.STRICT, url)
        self._load(doc, None, False)
        for (kind, ns, name), _ in list(self.nodes.items()):
            if kind == "element":
                self._element((ns, name))
            elif kind in ("complexType", "simpleType"):
                self._type((ns, name))
        for name, e in self.elements.items():
            h = e.head
            while h is not None:
                self.members.setdefault(h, set()).add(name)
                h = self._element(h).head if ("element", *h) in self.nodes else None

    def _load(self, doc: Document, target: str | None, chameleon: bool) -> None:
        root = doc.root
        if root is None or root.ns != XS or root.local != "schema":
            raise SchemaError("The XML document has no schema document element")
        ns = root.get("targetNamespace")
        if chameleon and ns is None:
            ns = target
            if ns is not None and not any(p == "" for p, _ in root.decls):
                root.decls.append(("", ns))
        q = root.get("elementFormDefault") == "qualified", root.get("attributeFormDefault") == "qualified"
        for c in root.children:
            if c.kind != ELEMENT or c.ns != XS:
                continue
            if c.local in ("include", "import", "redefine"):
                place = c.get("schemaLocation")
                uri = urljoin(doc.url or "", place or "")
                if place and uri not in self.loaded and (uri in self.resources or place in self.resources):
                    self.loaded.add(uri)
                    self._load(xml.parse(self.resources.get(uri, self.resources.get(place)), xml.STRICT, uri), ns, c.local != "import")
                elif place and c.local != "import" and uri not in self.loaded:
                    raise SchemaError(f"Failed to load the document '{uri}'")
                for r in c.children if c.local == "redefine" else ():
                    if r.kind == ELEMENT and r.get("name"):
                        key = (r.local, ns, r.get("name"))
                        if key in self.nodes:  # the old definition under a name of its own, which the new one refers to
                            self.nodes[(r.local, ns, "\0" + r.get("name"))] = self.nodes[key]
                            for n in r.walk():
                                for a in n.attrs:
                                    if a.local in ("base", "ref") and a.value.rpartition(":")[2] == r.get("name"):
                                        a.value = a.value.rpartition(":")[0] + ":" * (":" in a.value) + "\0" + r.get("name")
                        self.nodes[key] = (r, ns, *q)
            elif c.get("name"):
                self.nodes[(c.local, ns, c.get("name"))] = (c, ns, *q)

    @staticmethod
    def _qname(at: Node, text: str) -> tuple[str | None, str]:
        prefix, _, local = text.rpartition(":")
        uri = at.lookup(prefix)
        if prefix and uri is None:
            raise SchemaError(f"The QName '{text}' has no namespace for its prefix")
        return uri, local

    def _type(self, name: tuple[str | None, str]) -> SimpleType | ComplexType:
        if name in self.types:
            return self.types[name]
        ns, local = name
        if ns == XS and local in BUILT_IN:
            self.types[name] = ComplexType("anyType", mixed=True, any=True, any_attribute=True) if local == "anyType" else SimpleType(local)
            return self.types[name]
        for kind in ("simpleType", "complexType"):
            if (kind, ns, local) in self.nodes:
                node, *where = self.nodes[(kind, ns, local)]
                if kind == "simpleType":
                    self.types[name] = t = SimpleType(local)
                    made = self._simple(node, where)
                    t.base, t.item, t.members, t.facets = made.base, made.item, made.members, made.facets
                else:
                    self.types[name] = t = ComplexType(local)
                    self._complex(node, where, t)
                return t
        raise SchemaError(f"References to the type '{local}' can't be resolved")

    def _simple(self, node: Node, where) -> SimpleType:
        body = next(c for c in node.children if c.kind == ELEMENT and c.local in ("restriction", "list", "union"))
        inner = [c for c in body.children if c.kind == ELEMENT and c.local == "simpleType"]
        if body.local == "list":
            item = self._type(self._qname(body, body.get("itemType"))) if body.get("itemType") else self._simple(inner[0], where)
            return SimpleType(node.get("name") or "", item=item)
        if body.local == "union":
            members = [self._type(self._qname(body, m)) for m in (body.get("memberTypes") or "").split()] + [self._simple(i, where) for i in inner]
            return SimpleType(node.get("name") or "", members=members)
        base = self._type(self._qname(body, body.get("base"))) if body.get("base") else self._simple(inner[0], where)
        return SimpleType(node.get("name") or "", base, facets=_facet_map(body))

    def _complex(self, node: Node, where, t: ComplexType) -> None:
        t.mixed, t.abstract = node.get("mixed") in ("true", "1"), node.get("abstract") in ("true", "1")
        body = next((c for c in node.children if c.kind == ELEMENT and c.local in ("simpleContent", "complexContent")), None)
        if body is None:
            t.particle = self._content(node, where)
            self._attributes(node, where, t)
            return
        if body.get("mixed") in ("true", "1"):
            t.mixed = True
        d = next(c for c in body.children if c.kind == ELEMENT and c.local in ("extension", "restriction"))
        base = self._type(self._qname(d, d.get("base")))
        t.base, t.derivation = base, d.local
        if isinstance(base, ComplexType):
            t.attributes = dict(base.attributes)
            t.any_attribute = base.any_attribute and d.local == "extension"
        if body.local == "simpleContent":
            simple = base if isinstance(base, SimpleType) else base.simple
            inner = next((c for c in d.children if c.kind == ELEMENT and c.local == "simpleType"), None)
            if inner is not None:
                simple = self._simple(inner, where)
            facets = _facet_map(d)
            t.simple = SimpleType("", simple, facets=facets) if facets else simple
        else:
            own = self._content(d, where)
            if d.local == "extension" and isinstance(base, ComplexType):
                t.particle, t.mixed = seq(base.particle, own), t.mixed or base.mixed
                t.any = base.any
            else:
                t.particle = own
        self._attributes(d, where, t)

    def _content(self, node: Node, where):
        out = EMPTY
        for c in node.children:
            if c.kind == ELEMENT and c.local in ("sequence", "choice", "all", "group"):
                out = seq(out, self._particle(c, where))
        return out

    def _particle(self, c: Node, where):
        low = int(c.get("minOccurs") or 1)
        high = None if c.get("maxOccurs") == "unbounded" else int(c.get("maxOccurs") or 1)
        target, qualified, _ = where
        if c.local == "element":
            if c.get("ref"):
                key = self._qname(c, c.get("ref"))
                self._element(key)
                out = ("leaf", ("element", key))
            else:
                form = c.get("form")
                key = (target if form == "qualified" or (form is None and qualified) else None, c.get("name"))
                e = ElementDecl(key)
                token = ("local", key, id(c))
                self.leaf[token] = e
                if ("made", id(c)) not in self.loaded:
                    self.loaded.add(("made", id(c)))
                    self._fill(e, c, where)
                out = ("leaf", token)
        elif c.local == "any":
            out = ("leaf", ("any", c.get("namespace") or "##any", c.get("processContents") or "strict", target))
        elif c.local == "group":
            uri, local = self._qname(c, c.get("ref"))
            if ("group", uri, local) not in self.nodes:
                raise SchemaError(f"References to the group '{local}' can't be resolved")
            node, *inside = self.nodes[("group", uri, local)]
            out = self._content(node, inside)
        else:
            parts = [self._particle(x, where) for x in c.children if x.kind == ELEMENT and x.local in ("element", "any", "group", "sequence", "choice", "all")]
            out = NONE if c.local == "choice" and parts else EMPTY
            join = {"sequence": seq, "choice": choice, "all": both}[c.local]
            for p in parts:
                out = join(out, p)
        return repeat(out, low, high)

    def _attributes(self, node: Node, where, t: ComplexType) -> None:
        target, _, qualified = where
        for c in node.children:
            if c.kind != ELEMENT:
                continue
            if c.local == "attribute":
                if c.get("ref"):
                    key = self._qname(c, c.get("ref"))
                    found = self.nodes.get(("attribute", *key))
                    decl = found[0] if found else c
                else:
                    form, decl = c.get("form"), c
                    key = (target if form == "qualified" or (form is None and qualified) else None, c.get("name"))
                use = c.get("use") or "optional"
                if use == "prohibited":
                    t.attributes.pop(key, None)
                    continue
                inner = next((x for x in decl.children if x.kind == ELEMENT and x.local == "simpleType"), None)
                kind = self._type(self._qname(decl, decl.get("type"))) if decl.get("type") else self._simple(inner, where) if inner is not None else SimpleType("anySimpleType")
                t.attributes[key] = (kind, use, c.get("default") or decl.get("default"), c.get("fixed") or decl.get("fixed"))
            elif c.local == "attributeGroup":
                key = self._qname(c, c.get("ref"))
                if ("attributeGroup", *key) in self.nodes:
                    n, *inside = self.nodes[("attributeGroup", *key)]
                    self._attributes(n, inside, t)
            elif c.local == "anyAttribute":
                t.any_attribute = True

    def _element(self, key: tuple) -> ElementDecl:
        if key in self.elements:
            return self.elements[key]
        if ("element", *key) not in self.nodes:
            raise SchemaError(f"References to the element '{key[1]}' can't be resolved")
        node, *where = self.nodes[("element", *key)]
        self.elements[key] = e = ElementDecl(key)
        self._fill(e, node, where)
        return e

    def _fill(self, e: ElementDecl, node: Node, where) -> None:
        true = lambda k: node.get(k) in ("true", "1")
        e.default, e.fixed, e.nillable, e.abstract = node.get("default"), node.get("fixed"), true("nillable"), true("abstract")
        if node.get("substitutionGroup"):
            e.head = self._qname(node, node.get("substitutionGroup"))
        inner = next((c for c in node.children if c.kind == ELEMENT and c.local in ("simpleType", "complexType")), None)
        if node.get("type"):
            e.type = self._type(self._qname(node, node.get("type")))
        elif inner is not None and inner.local == "simpleType":
            e.type = self._simple(inner, where)
        elif inner is not None:
            e.type = ComplexType()
            self._complex(inner, where, e.type)
        elif e.head is not None:
            e.type = self._element(e.head).type
        else:
            e.type = self._type((XS, "anyType"))
        for c in node.children:
            if c.kind == ELEMENT and c.local in ("key", "unique", "keyref"):
                selector = next(x for x in c.children if x.local == "selector").get("xpath")
                fields = tuple(x.get("xpath") for x in c.children if x.kind == ELEMENT and x.local == "field")
                refer = c.get("refer").rpartition(":")[2] if c.get("refer") else None
                e.constraints.append((c.local, c.get("name"), selector, fields, refer, c.in_scope()))

    # -- validation ------------------------------------------------------
    def validate(self, document: Document) -> list[str]:
        """Errors in document order; none for a valid document."""
        root = document.root
        if root is None:
            return ["The document has no document element."]
        errors: list[str] = []
        key = (root.ns, root.local)
        if key not in self.elements:
            return [f"Element '{_shown(root)}': No matching global declaration available for the validation root."]
        ids: dict[str, list] = {"ID": [], "IDREF": []}
        self._check(document, root, self.elements[key], errors, ids)
        errors += [f"IDREF '{r}' has no ID" for r in ids["IDREF"] if r not in ids["ID"]]
        return errors

    def _check(self, document: Document, n: Node, e: ElementDecl, errors: list[str], ids: dict) -> dict:
        label = f"Element '{_shown(n)}'"
        kind = e.type
        if e.abstract:
            errors.append(f"{label}: The element declaration is abstract.")
        stated = n.get("type", XSI)
        if stated is not None:
            try:
                other = self._type(self._qname(n, stated.strip()))
            except SchemaError:
                errors.append(f"{label}, attribute type: The QName value '{stated}' does not resolve to a type definition.")
                other = kind
            t = other
            while t is not None and t is not kind:
                t = t.base
            if t is None and not (isinstance(kind, ComplexType) and kind.any):
                errors.append(f"{label}: The type definition '{stated}' is not validly derived from the type definition of the declaration.")
            else:
                kind = other
        if isinstance(kind, ComplexType) and kind.abstract:
            errors.append(f"{label}: The type definition is abstract.")
        nil = n.get("nil", XSI) in ("true", "1")
        if nil and not e.nillable:
            errors.append(f"{label}: The element is not 'nillable'.")
        elements = [c for c in n.children if c.kind == ELEMENT]
        text = "".join(c.value for c in n.children if c.kind in (TEXT, CDATA))
        if isinstance(kind, SimpleType):
            for a in n.attrs:
                if a.ns not in (XSI, XMLNS_NS):
                    errors.append(f"{label}, attribute '{a.name}': The attribute '{a.name}' is not allowed.")
        else:
            self._check_attributes(n, kind, errors, ids)
        simple = kind if isinstance(kind, SimpleType) else kind.simple
        inner: list[dict] = []
        if nil:
            if n.children:
                errors.append(f"{label}: Character or element content is not allowed, because the element is 'nilled'.")
        elif simple is not None:
            if elements:
                errors.append(f"{label}: Element content is not allowed, because the type definition is simple.")
            value = text if text or (e.default is None and e.fixed is None) else e.default or e.fixed
            wrong = simple.check(value)
            if wrong:
                errors.append(f"{label}: {wrong}.")
            elif e.fixed is not None and simple.value(value) != simple.value(e.fixed):
                errors.append(f"{label}: The actual value '{value}' does not match the fixed value constraint '{e.fixed}'.")
            self._note(simple, value, ids)
        else:
            if not kind.mixed and text.strip(E.BLANKS):
                errors.append(f"{label}: Character content other than whitespace is not allowed because the content type is 'element-only'.")
            inner = self._check_children(document, elements, kind, label, errors, ids)
        return self._constraints(document, n, e, inner, errors)

    def _note(self, t: SimpleType, value: str, ids: dict) -> None:
        name = t.root().name
        if name in ("ID", "IDREF", "IDREFS"):
            ids["IDREF" if name != "ID" else "ID"] += value.split()

    def _check_attributes(self, n: Node, t: ComplexType, errors: list[str], ids: dict) -> None:
        have = set()
        for a in n.attrs:
            if a.ns == XSI:
                continue
            have.add((a.ns, a.local))
            rule = t.attributes.get((a.ns, a.local))
            label = f"Element '{_shown(n)}', attribute '{a.name}'"
            if rule is None:
                if not t.any_attribute:
                    errors.append(f"{label}: The attribute '{a.name}' is not allowed.")
                continue
            kind, _, _, fixed = rule
            if wrong := kind.check(a.value):
                errors.append(f"{label}: {wrong}.")
            elif fixed is not None and kind.value(a.value) != kind.value(fixed):
                errors.append(f"{label}: The value '{a.value}' does not match the fixed value constraint '{fixed}'.")
            self._note(kind, a.value, ids)
        for (ns, local), (_, use, _, _) in t.attributes.items():
            if use == "required" and (ns, local) not in have:
                errors.append(f"Element '{_shown(n)}': The attribute '{local}' is required but missing.")

    def _check_children(self, document, elements: list[Node], t: ComplexType, label: str, errors: list[str], ids: dict) -> list[dict]:
        p, out = t.particle, []
        if t.any:
            return [self._check(document, c, self.elements[(c.ns, c.local)], errors, ids) for c in elements if (c.ns, c.local) in self.elements]
        for c in elements:
            hit = next((k for k in sorted(leaves(p), key=lambda k: (k[0] == "any", repr(k))) if self._fits(k, c)), None)
            if hit is None:
                wanted = ", ".join(sorted({k[1][1] if k[0] != "any" else "*" for k in leaves(p)}))
                errors.append(f"Element '{_shown(c)}': This element is not expected." + (f" Expected is one of ( {wanted} )." if wanted else ""))
                return out
            p = derive(p, hit)
            if hit[0] == "any":
                d = self.elements.get((c.ns, c.local))
                if d is None and hit[2] == "strict":
                    errors.append(f"Element '{_shown(c)}': No matching global element declaration available, but demanded by the strict wildcard.")
                if d is None or hit[2] == "skip":
                    continue
            elif hit[0] == "local":
                d = self.leaf[hit]
            else:
                d = self.elements.get((c.ns, c.local)) or self._element(hit[1])
            out.append(self._check(document, c, d, errors, ids))
        if not nullable(p):
            wanted = ", ".join(sorted({k[1][1] if k[0] != "any" else "*" for k in leaves(p)}))
            errors.append(f"{label}: Missing child element(s). Expected is one of ( {wanted} ).")
        return out

    def _fits(self, k: tuple, c: Node) -> bool:
        name = (c.ns, c.local)
        if k[0] != "any":
            return k[1] == name or (k[0] == "element" and name in self.members.get(k[1], ()))
        allowed, target = k[1], k[3]
        if allowed == "##any":
            return True
        if allowed == "##other":
            return c.ns is not None and c.ns != target
        return any((w == "##local" and c.ns is None) or (w == "##targetNamespace" and c.ns == target) or w == c.ns for w in allowed.split())

    def _constraints(self, document: Document, n: Node, e: ElementDecl, inner: list[dict], errors: list[str]) -> dict:
        """Key tables of this element and those below it; keyrefs look into them."""
        tables: dict[str, dict] = {}
        for t in inner:
            for name, keys in t.items():
                tables.setdefault(name, {}).update(keys)
        rows: dict[str, list] = {}
        for kind, name, selector, fields, _, scope in e.constraints:
            found = []
            for m in E.query(document, selector, n, namespaces=scope):
                values = []
                for f in fields:
                    hit = E.query(document, f, m, namespaces=scope)
                    if len(hit) > 1:
                        errors.append(f"Element '{_shown(m)}': The XPath '{f}' of a field of '{name}' evaluates to a node-set with more than one member.")
                    values.append(self._typed(hit[0]) if hit else None)
                found.append((m, tuple(values)))
            rows[name] = found
            if kind == "keyref":
                continue
            seen: dict = {}
            for m, values in found:
                if None in values:
                    if kind == "key":
                        errors.append(f"Element '{_shown(m)}': Not all fields of key identity-constraint '{name}' evaluate to a node.")
                    continue
                if values in seen:
                    errors.append(f"Element '{_shown(m)}': Duplicate key-sequence {[str(v) for v in values]} in {kind} identity-constraint '{name}'.")
                seen[values] = m
            tables.setdefault(name, {}).update(seen)
        for kind, name, _, _, refer, _ in e.constraints:
            if kind == "keyref":
                for m, values in rows[name]:
                    if None not in values and values not in tables.get(refer, {}):
                        errors.append(f"Element '{_shown(m)}': No match found for key-sequence {[str(v) for v in values]} of keyref '{name}'.")
        return tables

    def _typed(self, node: Node):
        """A field's value in its type's value space, as far as the declarations tell it."""
        t = None
        if node.kind == 2 and node.parent is not None:
            for d in (*self.elements.values(), *self.leaf.values()):
                if d.name == (node.parent.ns, node.parent.local) and isinstance(d.type, ComplexType) and (node.ns, node.local) in d.type.attributes:
                    t = d.type.attributes[(node.ns, node.local)][0]
        else:
            d = next((d for d in (*self.elements.values(), *self.leaf.values()) if d.name == (node.ns, node.local)), None)
            t = d.type if d is not None and isinstance(d.type, SimpleType) else d.type.simple if d is not None and isinstance(d.type, ComplexType) else None
        text = node.text()
        return t.value(text) if t is not None and not t.check(text) else ("string", text)


def _facet_map(node: Node) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c in node.children:
        if c.kind == ELEMENT and c.get("value") is not None and c.local not in ("simpleType", "attribute"):
            out.setdefault(c.local, []).append(c.get("value"))
    return out


def _shown(n: Node) -> str:
    return f"{{{n.ns}}}{n.local}" if n.ns else n.local


# -- RELAX NG ------------------------------------------------------------
class RelaxNG:
    """A RELAX NG schema in XML syntax, validated by derivatives."""

    def __init__(self, source: str | bytes | Document, resources: Mapping[str, bytes | str] | None = None, url: str | None = None):
        self.resources = dict(resources or {})
        self.defines: dict[str, tuple] = {}
        self.count = 0
        doc = source if isinstance(source, Document) else xml.parse(source, xml.STRICT, url)
        if doc.root is None or doc.root.ns != RNG:
            raise SchemaError("not a RELAX NG schema")
        self.start = self._pattern(doc.root, doc, "", {"ns": "", "lib": ""})

    def _children(self, n: Node, doc, scope, ctx):
        return [self._pattern(c, doc, scope, ctx) for c in n.children if c.kind == ELEMENT and c.ns == RNG]

    def _group(self, parts: list, kind: str = "group"):
        if not parts:
            return ("empty",)
        out = parts[0]
        for p in parts[1:]:
            out = _pair(kind, out, p)
        return out

    def _pattern(self, n: Node, doc: Document, scope: str, ctx: dict):
        ctx = {"ns": n.get("ns") if n.get("ns") is not None else ctx["ns"], "lib": n.get("datatypeLibrary") if n.get("datatypeLibrary") is not None else ctx["lib"]}
        k = n.local
        if k in ("element", "attribute"):
            kids = [c for c in n.children if c.kind == ELEMENT and c.ns == RNG]
            if n.get("name") is not None:
                name = self._name(n, n.get("name").strip(), ctx["ns"] if k == "element" or n.get("ns") is not None else "")
            else:
                name = self._class(kids.pop(0), ctx)
            parts = [self._pattern(c, doc, scope, ctx) for c in kids]
            if k == "attribute":
                return ("attribute", name, self._group(parts) if parts else ("text",))
            self.count += 1
            return ("element", name, self._group(parts), self.count)
        if k in ("group", "div"):
            return self._group(self._children(n, doc, scope, ctx))
        if k in ("choice", "interleave"):
            return self._group(self._children(n, doc, scope, ctx), k)
        if k in ("optional", "zeroOrMore", "oneOrMore", "list", "mixed"):
            p = self._group(self._children(n, doc, scope, ctx))
            if k == "optional":
                return _pair("choice", p, ("empty",))
            if k == "zeroOrMore":
                return _pair("choice", _plus(p), ("empty",))
            if k == "oneOrMore":
                return _plus(p)
            return ("list", p) if k == "list" else _pair("interleave", p, ("text",))
        if k in ("text", "empty", "notAllowed"):
            return (k,)
        if k == "ref":
            return ("ref", scope + n.get("name").strip())
        if k == "parentRef":
            return ("ref", scope.rpartition("/")[0].rpartition("/")[0] + "/" * (scope.count("/") > 1) + n.get("name").strip())
        if k == "value":
            return ("value", ctx["lib"] if n.get("type") else "", (n.get("type") or "token").strip(), n.text())
        if k == "data":
            params = tuple((c.get("name"), c.text()) for c in n.children if c.kind == ELEMENT and c.local == "param")
            rest = next((c for c in n.children if c.kind == ELEMENT and c.local == "except"), None)
            return ("data", ctx["lib"], n.get("type").strip(), params, self._group(self._children(rest, doc, scope, ctx), "choice") if rest is not None else None)
        if k in ("externalRef", "include"):
            uri = urljoin(doc.url or "", n.get("href"))
            source = self.resources.get(uri, self.resources.get(n.get("href")))
            if source is None:
                raise SchemaError(f"Failed to load {uri}")
            other = xml.parse(source, xml.STRICT, uri)
            if k == "externalRef":
                return self._pattern(other.root, other, scope, ctx)
            names = {c.get("name") for c in n.walk() if c.kind == ELEMENT and c.local == "define"}
            starts = any(c.local == "start" for c in n.walk() if c.kind == ELEMENT)
            for c in list(other.root.walk()):
                if c.kind == ELEMENT and ((c.local == "define" and c.get("name") in names) or (c.local == "start" and starts)):
                    c.unlink()
            self._grammar(other.root, other, scope, ctx)
            self._grammar(n, doc, scope, ctx)
            return ("empty",)
        if k == "grammar":
            self.count += 1
            inner = f"{scope}{self.count}/"
            self._grammar(n, doc, inner, ctx)
            return ("ref", inner + "\0start")
        raise SchemaError(f"unknown pattern {k}")

    def _grammar(self, n: Node, doc: Document, scope: str, ctx: dict) -> None:
        for c in n.children:
            if c.kind != ELEMENT or c.ns != RNG:
                continue
            if c.local == "div":
                self._grammar(c, doc, scope, ctx)
            elif c.local == "include":
                self._pattern(c, doc, scope, ctx)
            elif c.local in ("define", "start"):
                name = scope + (c.get("name").strip() if c.local == "define" else "\0start")
                p = self._group(self._children(c, doc, scope, ctx))
                self.defines[name] = _pair(c.get("combine") or "choice", self.defines[name], p) if name in self.defines else p

    def _name(self, n: Node, text: str, ns: str) -> tuple:
        prefix, _, local = text.rpartition(":")
        return ("name", (n.lookup(prefix) or "") if prefix else ns, local)

    def _class(self, c: Node, ctx: dict) -> tuple:
        ns = c.get("ns") if c.get("ns") is not None else ctx["ns"]
        if c.local == "name":
            return self._name(c, c.text().strip(), ns)
        inner = [x for x in c.children if x.kind == ELEMENT]
        rest = None
        if inner and inner[0].local == "except":
            rest = ("or", tuple(self._class(x, ctx) for x in inner[0].children if x.kind == ELEMENT))
        if c.local == "anyName":
            return ("any", rest)
        return ("ns", ns, rest) if c.local == "nsName" else ("or", tuple(self._class(x, ctx) for x in inner))

    def validate(self, document: Document) -> list[str]:
        """Errors; none for a valid document."""
        root = document.root
        if root is None:
            return ["The document has no document element."]
        errors: list[str] = []
        p = self._node(self.start, root, errors)
        if not errors and not self._empty(p):
            errors.append(f"Element {root.local} is not complete")
        return errors

    def _expand(self, p):
        while p[0] == "ref":
            if p[1] not in self.defines:
                raise SchemaError(f"{p[1]} isn't defined")
            p = self.defines[p[1]]
        return p

    def _empty(self, p) -> bool:
        p = self._expand(p)
        k = p[0]
        if k in ("group", "interleave"):
            return self._empty(p[1]) and self._empty(p[2])
        if k == "choice":
            return self._empty(p[1]) or self._empty(p[2])
        return self._empty(p[1]) if k == "plus" else k in ("empty", "text")

    def _open(self, p, name: tuple[str, str]):
        """[(content of an element that may start here, what follows it)]."""
        p = self._expand(p)
        k = p[0]
        if k == "element":
            return [(p[2], ("empty",))] if _in_class(p[1], name) else []
        if k == "choice":
            return self._open(p[1], name) + self._open(p[2], name)
        if k == "plus":
            return [(c, _pair("group", r, _pair("choice", p, ("empty",)))) for c, r in self._open(p[1], name)]
        if k == "interleave":
            return [(c, _pair("interleave", r, p[2])) for c, r in self._open(p[1], name)] + [(c, _pair("interleave", p[1], r)) for c, r in self._open(p[2], name)]
        if k == "group":
            out = [(c, _pair("group", r, p[2])) for c, r in self._open(p[1], name)]
            return out + self._open(p[2], name) if self._empty(p[1]) else out
        return []

    def _node(self, p, n: Node, errors: list[str]):
        options = self._open(p, (n.ns or "", n.local))
        if not options:
            errors.append(f"Did not expect element {n.local} there")
            return ("notAllowed",)
        content, total = ("notAllowed",), ("notAllowed",)
        trial: list[str] = []
        for c, rest in options:
            trial = []
            end = self._content(c, n, trial)
            if not trial and self._empty(end):
                total = _pair("choice", total, rest)
            elif not trial:
                trial.append(f"Element {n.local} failed to validate content")
        del content
        if total == ("notAllowed",):
            errors.extend(trial)
        return total

    def _content(self, p, n: Node, errors: list[str]):
        for a in n.attrs:
            q = self._attribute(p, a)
            if q == ("notAllowed",):
                errors.append(f"Invalid attribute {a.name} for element {n.local}")
                return q
            p = q
        missing: list[str] = []
        p = self._no_attributes(p, missing)
        if p == ("notAllowed",):
            errors.append(f"Element {n.local} is missing attributes {', '.join(missing)}".strip())
            return p
        kids = [c for c in n.children if c.kind == ELEMENT or (c.kind in (TEXT, CDATA) and c.value)]
        joined: list = []
        for c in kids:
            if c.kind != ELEMENT and joined and isinstance(joined[-1], str):
                joined[-1] += c.value
            else:
                joined.append(c if c.kind == ELEMENT else c.value)
        if not any(isinstance(c, Node) for c in joined):
            text = joined[0] if joined else ""
            q = self._text(p, text)
            if not text.strip(E.BLANKS):
                q = _pair("choice", q, p)
            if q == ("notAllowed",):
                errors.append(f"Error validating value of element {n.local}")
            return q
        for c in joined:
            if isinstance(c, str):
                if not c.strip(E.BLANKS):
                    continue
                p = self._text(p, c)
                if p == ("notAllowed",):
                    errors.append(f"Did not expect text in element {n.local} content")
                    return p
            else:
                p = self._node(p, c, errors)
                if p == ("notAllowed",):
                    return p
        return p

    def _attribute(self, p, a: Node):
        p = self._expand(p)
        k = p[0]
        if k == "attribute":
            ok = _in_class(p[1], (a.ns or "", a.local)) and (self._empty(self._text(p[2], a.value)) or (not a.value.strip() and self._empty(p[2])))
            return ("empty",) if ok else ("notAllowed",)
        if k == "choice":
            return _pair("choice", self._attribute(p[1], a), self._attribute(p[2], a))
        if k in ("group", "interleave"):
            return _pair("choice", _pair(k, self._attribute(p[1], a), p[2]), _pair(k, p[1], self._attribute(p[2], a)))
        if k == "plus":
            return _pair("group", self._attribute(p[1], a), _pair("choice", p, ("empty",)))
        return ("notAllowed",)

    def _no_attributes(self, p, missing: list[str]):
        """The pattern once the start tag is read: what still needs an attribute can't match."""
        if p[0] == "ref" and not self._has_attribute(p, frozenset()):
            return p
        p = self._expand(p)
        k = p[0]
        if k == "attribute":
            missing.append(p[1][2] if p[1][0] == "name" else "*")
            return ("notAllowed",)
        if k in ("choice", "group", "interleave"):
            return _pair(k, self._no_attributes(p[1], missing), self._no_attributes(p[2], missing))
        return _plus(self._no_attributes(p[1], missing)) if k == "plus" else p

    def _has_attribute(self, p, seen: frozenset) -> bool:
        if p[0] == "ref":
            return p[1] not in seen and self._has_attribute(self.defines.get(p[1], ("empty",)), seen | {p[1]})
        if p[0] == "attribute":
            return True
        return p[0] in ("choice", "group", "interleave", "plus") and any(self._has_attribute(x, seen) for x in p[1:] if isinstance(x, tuple))

    def _text(self, p, s: str):
        p = self._expand(p)
        k = p[0]
        if k == "text":
            return p
        if k == "choice":
            return _pair("choice", self._text(p[1], s), self._text(p[2], s))
        if k == "interleave":
            return _pair("choice", _pair(k, self._text(p[1], s), p[2]), _pair(k, p[1], self._text(p[2], s)))
        if k == "group":
            out = _pair("group", self._text(p[1], s), p[2])
            return _pair("choice", out, self._text(p[2], s)) if self._empty(p[1]) else out
        if k == "plus":
            return _pair("group", self._text(p[1], s), _pair("choice", p, ("empty",)))
        if k == "value":
            return ("empty",) if _same(p[1], p[2], p[3], s) else ("notAllowed",)
        if k == "data":
            ok = _is_data(p[1], p[2], p[3], s) and not (p[4] is not None and self._empty(self._text(p[4], s)))
            return ("empty",) if ok else ("notAllowed",)
        if k == "list":
            q = p[1]
            for part in s.split():
                q = self._text(q, part)
            return ("empty",) if self._empty(q) else ("notAllowed",)
        return ("notAllowed",)


def _pair(kind: str, a, b):
    if kind == "choice":
        return b if a == ("notAllowed",) or a == b else a if b == ("notAllowed",) else ("choice", a, b)
    if ("notAllowed",) in (a, b):
        return ("notAllowed",)
    return b if a == ("empty",) else a if b == ("empty",) else (kind, a, b)


def _plus(p):
    return p if p in (("empty",), ("notAllowed",)) else ("plus", p)


def _in_class(c: tuple, name: tuple[str, str]) -> bool:
    if c[0] == "name":
        return c[1:] == name
    if c[0] == "or":
        return any(_in_class(x, name) for x in c[1])
    if c[0] == "ns":
        return c[1] == name[0] and not (c[2] and _in_class(c[2], name))
    return not (c[1] and _in_class(c[1], name))


def _same(library: str, kind: str, a: str, b: str) -> bool:
    if library == DATATYPES:
        t = SimpleType(kind)
        return not t.check(b) and t.value(a) == t.value(b)
    return a == b if kind == "string" else a.split() == b.split()


def _is_data(library: str, kind: str, params: tuple, s: str) -> bool:
    if library != DATATYPES:
        return kind in ("string", "token")
    facets: dict[str, list[str]] = {}
    for name, value in params:
        facets.setdefault(name, []).append(value)
    return kind in BUILT_IN and SimpleType("", SimpleType(kind), facets=facets).check(s) is None


# -- identity constraints on tables --------------------------------------
def unique_violations(rows: DataFrame, fields: list[str], scope: list[str] | None = None) -> DataFrame:
    """Key sequences without nulls that occur more than once within a scope, with their number as ``n``."""
    complete = rows.dropna("any", subset=fields)
    return complete.groupBy(*(scope or []), *fields).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def key_violations(rows: DataFrame, fields: list[str], scope: list[str] | None = None) -> DataFrame:
    """As for unique, and rows in which a field is absent, with ``n`` their number."""
    keys = [*(scope or []), *fields]
    absent = F.lit(False)
    for f in fields:
        absent = absent | F.col(f).isNull()
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | absent)


def keyref_violations(rows: DataFrame, fields: list[str], keys: DataFrame, key_fields: list[str], scope: list[str] | None = None) -> DataFrame:
    """Rows whose complete key sequence has no match among ``keys``."""
    on = [(F.col(f"r.{a}") == F.col(f"k.{b}")) for a, b in zip([*(scope or []), *fields], [*(scope or []), *key_fields])]
    return rows.dropna("any", subset=fields).alias("r").join(keys.alias("k"), on, "left_anti")
