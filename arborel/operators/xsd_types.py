"""XSD 1.0 built-in simple types: lexical checks, values for comparison, and facets."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from ..functions.exslt import parse_duration

_NAME = r"[A-Za-z_:À-￿][\w:.\-·]*"
_NCNAME = r"[A-Za-z_À-￿][\w.\-·]*"
_ZONE = r"(Z|[+-](?:0\d|1[0-3]):[0-5]\d|[+-]14:00)?"
_YEAR, _MONTH, _DAY, _TIME = r"-?(?!0000)(?:[1-9]\d{4,}|\d{4})", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?|24:00:00(?:\.0+)?)"
# The built-in types with their lexical patterns (None: any), and the bounds of derived integers.
PATTERNS: dict[str, str | None] = {
    "anySimpleType": None, "string": None, "normalizedString": None, "token": None, "language": r"[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*", "Name": _NAME, "NCName": _NCNAME, "ID": _NCNAME,
    "IDREF": _NCNAME, "ENTITY": _NCNAME, "NMTOKEN": r"[\w:.\-·]+", "QName": f"({_NCNAME}:)?{_NCNAME}", "NOTATION": f"({_NCNAME}:)?{_NCNAME}", "boolean": "true|false|1|0",
    "decimal": r"[+-]?(\d+(\.\d*)?|\.\d+)", "integer": r"[+-]?\d+", "float": r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|-?INF|NaN", "double": r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|-?INF|NaN",
    "dateTime": f"{_YEAR}-{_MONTH}-{_DAY}T{_TIME}{_ZONE}", "date": f"{_YEAR}-{_MONTH}-{_DAY}{_ZONE}", "time": f"{_TIME}{_ZONE}", "gYear": f"{_YEAR}{_ZONE}", "gYearMonth": f"{_YEAR}-{_MONTH}{_ZONE}",
    "gMonth": f"--{_MONTH}(--)?{_ZONE}", "gMonthDay": f"--{_MONTH}-{_DAY}{_ZONE}", "gDay": f"---{_DAY}{_ZONE}", "duration": r"-?P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?",
    "hexBinary": r"([0-9a-fA-F]{2})*", "base64Binary": r"(([A-Za-z0-9+/] ?){4})*(([A-Za-z0-9+/] ?){3}[A-Za-z0-9+/]|([A-Za-z0-9+/] ?){2}[AEIMQUYcgkosw048] ?=|[A-Za-z0-9+/] ?[AQgw] ?= ?=)?", "anyURI": r"[^<>\"{}|\\^`]*",
}
LISTS = {"IDREFS": "IDREF", "ENTITIES": "ENTITY", "NMTOKENS": "NMTOKEN"}
BOUNDS: dict[str, tuple[int | None, int | None]] = {
    "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1),
    "short": (-(2**15), 2**15 - 1), "byte": (-128, 127), "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}
BUILT_IN = frozenset(PATTERNS) | frozenset(LISTS) | frozenset(BOUNDS) | {"anyType"}


def primitive(name: str) -> str:
    if name in BOUNDS or name == "integer":
        return "decimal"
    if name in LISTS:
        return "list"
    if name in ("normalizedString", "token", "language", "Name", "NCName", "ID", "IDREF", "ENTITY", "NMTOKEN", "anySimpleType"):
        return "string"
    return name


def collapse(s: str, how: str) -> str:
    if how == "preserve":
        return s
    s = re.sub(r"[\t\n\r]", " ", s)
    return re.sub(" +", " ", s).strip(" ") if how == "collapse" else s


def _days(y: int, m: int) -> int:
    return [31, 29 if (y % 4 == 0 and y % 100 != 0) or y % 400 == 0 else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1]


def moment(s: str, kind: str) -> tuple[Decimal, bool]:
    """(seconds since year 0 in UTC, whether a zone is given) of a date or time value."""
    m = re.fullmatch(rf"(.*?){_ZONE}", s)
    body, zone = m[1], m[2]
    y, mo, d, t = 1972, 1, 1, "00:00:00"
    if kind == "dateTime":
        day, t = body.split("T")
    else:
        day = body
    if kind in ("dateTime", "date", "gYear", "gYearMonth"):
        negative = day.startswith("-")
        parts = day.lstrip("-").split("-")
        y = -int(parts[0]) if negative else int(parts[0])
        mo, d = int(parts[1]) if len(parts) > 1 else 1, int(parts[2]) if len(parts) > 2 else 1
    elif kind == "time":
        t = body
    elif kind in ("gMonth", "gMonthDay"):
        parts = body[2:].strip("-").split("-")
        mo, d = int(parts[0]), int(parts[1]) if len(parts) > 1 else 1
    elif kind == "gDay":
        d = int(body[3:])
    if d > _days(y, mo):
        raise ValueError(s)
    h, mi, sec = t.split(":")
    shift = 0
    if zone not in (None, "Z"):
        shift = (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 3600 + int(zone[4:6]) * 60)
    a = y - (mo <= 2)
    ordinal = 365 * a + a // 4 - a // 100 + a // 400 + (153 * (mo + (9 if mo <= 2 else -3)) + 2) // 5 + d
    return Decimal(ordinal) * 86400 + int(h) * 3600 + int(mi) * 60 + Decimal(sec) - shift, zone is not None


def value(name: str, s: str):
    """The value of a valid lexical form, for comparison by equality or order."""
    p = primitive(name)
    if p == "decimal":
        return Decimal(s)
    if p in ("float", "double"):
        return float(s.replace("INF", "inf"))
    if p == "boolean":
        return s in ("true", "1")
    if p in ("dateTime", "date", "time", "gYear", "gYearMonth", "gMonth", "gMonthDay", "gDay"):
        return moment(s, p)
    if p == "duration":
        return parse_duration(s)
    if p == "hexBinary":
        return s.upper()
    if p == "base64Binary":
        return s.replace(" ", "")
    if p == "list":
        return tuple(s.split())
    return s


#: Where durations of equal length in one place may differ in another: four months to add to.
_STARTS = ((1696, 9), (1697, 2), (1903, 3), (1903, 7))


def order(name: str, a, b) -> int | None:
    """-1, 0 or 1; None where the values have no order."""
    p = primitive(name)
    if p == "duration":
        out = set()
        for y, m in _STARTS:
            at = []
            for months, seconds in (a, b):
                y2, m2 = divmod(y * 12 + m - 1 + months, 12)
                at.append(moment(f"{y2:04}-{m2 + 1:02}-01", "date")[0] + seconds)
            out.add((at[0] > at[1]) - (at[0] < at[1]))
        return out.pop() if len(out) == 1 else None
    if isinstance(a, tuple) and p != "list":
        (x, zx), (y, zy) = a, b
        if zx != zy:  # one without a zone may lie 14 hours to either side
            low, high = (-14 * 3600, 14 * 3600)
            signs = {((x + (0 if zx else s)) > (y + (0 if zy else s))) - ((x + (0 if zx else s)) < (y + (0 if zy else s))) for s in (low, high)}
            return signs.pop() if len(signs) == 1 else None
        return (x > y) - (x < y)
    if isinstance(a, float) and (a != a or b != b):
        return 0 if a != a and b != b else None
    return (a > b) - (a < b)


@dataclass
class SimpleType:
    """An atomic, list or union type with facets; built-in types have neither base nor facets."""

    name: str
    base: "SimpleType | None" = None
    item: "SimpleType | None" = None
    members: list["SimpleType"] = field(default_factory=list)
    facets: dict[str, list[str]] = field(default_factory=dict)

    def root(self) -> "SimpleType":
        t = self
        while t.base is not None:
            t = t.base
        return t

    def white_space(self) -> str:
        t: SimpleType | None = self
        while t is not None:
            if "whiteSpace" in t.facets:
                return t.facets["whiteSpace"][-1]
            if t.base is None:
                return {"string": "preserve", "anySimpleType": "preserve", "normalizedString": "replace"}.get(t.name, "collapse") if not t.item and not t.members else "collapse"
            t = t.base
        return "collapse"

    def check(self, raw: str) -> str | None:
        """What is wrong with a lexical form, or None."""
        s = collapse(raw, self.white_space())
        t = self.root()
        if t.members:
            if all(m.check(raw) for m in t.members):
                return f"'{s}' is not a valid value of the union type"
        elif t.item:
            for part in s.split():
                if e := t.item.check(part):
                    return e
        elif e := _atomic(t.name, s):
            return e
        chain, u = [], self
        while u is not None:
            chain.append(u)
            u = u.base
        for u in chain:
            if e := _facets(u, t, s):
                return e
        return None

    def value(self, raw: str):
        s, t = collapse(raw, self.white_space()), self.root()
        if t.members:
            for m in t.members:
                if not m.check(raw):
                    return m.value(raw)
            return s
        if t.item:
            return tuple(t.item.value(x) for x in s.split())
        return (primitive(t.name), value(t.name, s)) if primitive(t.name) != "decimal" else ("decimal", Decimal(s).normalize())


def _atomic(name: str, s: str) -> str | None:
    wrong = f"'{s}' is not a valid value of the atomic type 'xs:{name}'"
    if name in LISTS:
        return wrong if not s or any(_atomic(LISTS[name], x) for x in s.split()) else None
    if name in BOUNDS:
        low, high = BOUNDS[name]
        if not re.fullmatch(PATTERNS["integer"], s) or (low is not None and int(s) < low) or (high is not None and int(s) > high):
            return wrong
        return None
    pattern = PATTERNS.get(name)
    if pattern is not None and not re.fullmatch(pattern, s):
        return wrong
    if primitive(name) in ("dateTime", "date", "gMonthDay"):
        try:
            moment(s, primitive(name))
        except ValueError:
            return wrong
    return None


def _facets(t: SimpleType, root: SimpleType, s: str) -> str | None:
    def length() -> int:
        if root.item or root.name in LISTS:
            return len(s.split())
        if root.name == "hexBinary":
            return len(s) // 2
        if root.name == "base64Binary":
            x = s.replace(" ", "")
            return len(x) * 3 // 4 - x.count("=")
        return len(s)

    get: Callable = lambda k: int(t.facets[k][-1])
    f = t.facets
    if "length" in f and length() != get("length"):
        return f"[facet 'length'] The value '{s}' has a length of '{length()}'"
    if "minLength" in f and length() < get("minLength"):
        return f"[facet 'minLength'] The value '{s}' has a length of '{length()}'"
    if "maxLength" in f and length() > get("maxLength"):
        return f"[facet 'maxLength'] The value '{s}' has a length of '{length()}'"
    if "pattern" in f and not any(re.fullmatch(xsd_regex(p), s) for p in f["pattern"]):
        return f"[facet 'pattern'] The value '{s}' is not accepted"
    if "enumeration" in f:
        own = t.base.value(s) if t.base else s
        if all((t.base.value(e) if t.base else e) != own for e in f["enumeration"]):
            return f"[facet 'enumeration'] The value '{s}' is not an element of the set"
    for name, bad in (("minInclusive", (-1, None)), ("minExclusive", (-1, 0, None)), ("maxInclusive", (1, None)), ("maxExclusive", (1, 0, None))):
        if name in f and order(root.name, value(root.name, s), value(root.name, f[name][-1])) in bad:
            return f"[facet '{name}'] The value '{s}' is out of range"
    if "totalDigits" in f or "fractionDigits" in f:
        digits = re.sub(r"^[+-]", "", s)
        whole, _, fraction = digits.partition(".")
        whole, fraction = whole.lstrip("0"), fraction.rstrip("0")
        if "totalDigits" in f and len(whole) + len(fraction) > get("totalDigits"):
            return f"[facet 'totalDigits'] The value '{s}' has too many digits"
        if "fractionDigits" in f and len(fraction) > get("fractionDigits"):
            return f"[facet 'fractionDigits'] The value '{s}' has too many fraction digits"
    return None


def xsd_regex(p: str) -> str:
    """An XSD pattern as a Python one: name classes, category escapes, class subtraction, literal ^ and $."""
    out, depth, k = [], 0, 0
    while k < len(p):
        c = p[k]
        two = p[k : k + 2]
        if two in (r"\i", r"\c", r"\I", r"\C"):
            body = "A-Za-z_:À-￿" if two[1] in "iI" else r"\w:.\-·"
            out.append((("" if depth else "[") + ("^" if two[1].isupper() else "") + body + ("" if depth else "]")))
            k += 2
            continue
        if c == "\\" and p[k + 1 : k + 2] in ("p", "P"):
            end = p.index("}", k)
            out.append(_category(p[k + 3 : end], p[k + 1] == "P", depth > 0))
            k = end + 1
            continue
        if c == "\\":
            out.append(two)
            k += 2
            continue
        if c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
        elif c in "^$" and not depth:
            out.append("\\")
        out.append(c)
        k += 1
    return "".join(out)


def _category(name: str, negated: bool, inside: bool) -> str:
    body = {"L": "A-Za-zÀ-ÖØ-öø-ʯͰ-ϿЀ-ӿ", "Lu": "A-ZÀ-ÖØ-Þ", "Ll": "a-zß-öø-ÿ", "N": "0-9", "Nd": "0-9", "P": "!-#%-*,-/:;?@\\[-\\]_{}", "IsBasicLatin": "\\x00-\\x7f"}.get(name, "\\w")
    return body if inside else f"[{'^' if negated else ''}{body}]"
