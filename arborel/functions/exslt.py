"""EXSLT functions for the per-document evaluator: common, math, sets, strings, dates, dynamic and regular expressions."""

from __future__ import annotations

import calendar
import math
import random as _random
import re
from copy import copy
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from functools import lru_cache
from urllib.parse import quote, unquote

from ..plans import evaluate as E
from ..plans import xpath
from ..tree import ELEMENT, FRAGMENT, TEXT, Document, Node
from . import numbers

# Namespaces of the extension functions.
COMMON, MATH, SETS, STRINGS, DATES, DYNAMIC, REGEXP = (f"http://exslt.org/{x}" for x in ("common", "math", "sets", "strings", "dates-and-times", "dynamic", "regular-expressions"))
SAXON, XT, XALAN, LIBXSLT = "http://icl.com/saxon", "http://www.jclark.com/xt", "http://xml.apache.org/xalan", "http://xmlsoft.org/XSLT/namespace"
XQUERY = "http://www.w3.org/2002/08/xquery-functions"
# Digits of the constants that math:constant names.
CONSTANTS = {
    "PI": "3.1415926535897932384626433832795028841971693993751", "E": "2.71828182845904523536028747135266249775724709369996", "SQRRT2": "1.41421356237309504880168872420969807856967187537694",
    "LN2": "0.69314718055994530941723212145817656807550013436025", "LN10": "2.302585092994045684017991454684364207601101488628772976033328", "LOG2E": "1.4426950408889634073599246810018921374266459541529859341354494",
    "SQRT1_2": "0.70710678118654752440084436210484903928483593768847",
}


def _f(ns: str, name: str):
    def add(fn):
        E.EXTENSIONS[f"{{{ns}}}{name}"] = fn
        return fn

    return add


def _numeric(ns: str, name: str, fn) -> None:
    E.EXTENSIONS[f"{{{ns}}}{name}"] = lambda c, n, *v: fn(*map(E.number, v))


def token_nodes(values: list[str]) -> list[Node]:
    """Elements named token, in a fragment of their own."""
    holder = Node(FRAGMENT)
    for v in values:
        t = holder.append(Node(ELEMENT, "token"))
        if v:
            t.append(Node(TEXT, "", v))
    Document(holder).number()
    return list(holder.children)


# -- common --------------------------------------------------------------
def _node_set(context, node, v):
    if isinstance(v, list):
        return v
    holder = Node(FRAGMENT)
    holder.append(Node(TEXT, "", E.string(v)))
    return [holder.children[0]]


for _ns in (COMMON, SAXON, XT, XALAN, LIBXSLT):
    E.EXTENSIONS[f"{{{_ns}}}node-set"] = _node_set


@_f(COMMON, "object-type")
def _object_type(context, node, v):
    if isinstance(v, list):
        return "RTF" if v and v[0].kind == FRAGMENT else "node-set"
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, float) else "string"


# -- math ----------------------------------------------------------------
def _best(pick, values: list[float]) -> float:
    return math.nan if not values or any(map(math.isnan, values)) else pick(values)


def _extreme(pick):
    return lambda context, node, nodes: _best(pick, [numbers.to_number(n.text()) for n in nodes])


def _holders(pick):
    def fn(context, node, nodes):
        values = [numbers.to_number(n.text()) for n in nodes]
        best = _best(pick, values)
        return [n for n, v in zip(nodes, values) if v == best]

    return fn


for _name, _pick in (("min", min), ("max", max)):
    E.EXTENSIONS[f"{{{MATH}}}{_name}"] = _extreme(_pick)
E.EXTENSIONS[f"{{{MATH}}}highest"] = _holders(max)
E.EXTENSIONS[f"{{{MATH}}}lowest"] = _holders(min)


def _safe(fn):
    def run(*a):
        try:
            return float(fn(*a))
        except ValueError:
            return math.nan
        except OverflowError:
            return math.inf

    return run


def _log(x: float) -> float:
    return -math.inf if x == 0 else math.log(x)


for _name, _fn in {"abs": abs, "sqrt": math.sqrt, "power": math.pow, "log": _log, "exp": math.exp, "sin": math.sin, "cos": math.cos, "tan": math.tan, "asin": math.asin, "acos": math.acos, "atan": math.atan, "atan2": math.atan2}.items():
    _numeric(MATH, _name, _safe(_fn))


@_f(MATH, "constant")
def _constant(context, node, name, precision):
    digits, n = CONSTANTS.get(E.string(name)), E.number(precision)
    if digits is None or math.isnan(n) or n < 1:
        return math.nan
    return float(digits[: int(n) + 2])


@_f(MATH, "random")
def _rand(context, node):
    return _random.random()


# -- sets ----------------------------------------------------------------
def _ids(nodes):
    return {id(n) for n in nodes}


def _where(inside: bool):
    def fn(context, node, a, b):
        ids = _ids(b)
        return [x for x in a if (id(x) in ids) == inside]

    return fn


E.EXTENSIONS[f"{{{SETS}}}difference"], E.EXTENSIONS[f"{{{SETS}}}intersection"] = _where(False), _where(True)
E.EXTENSIONS[f"{{{SETS}}}has-same-node"] = lambda c, n, a, b: bool(_ids(a) & _ids(b))
E.EXTENSIONS[f"{{{SETS}}}distinct"] = lambda c, n, a: list({x.text(): x for x in reversed(E.ordered(a))}.values())[::-1]


def _side(before: bool):
    def fn(context, node, a, b):
        if not b:
            return a
        first = E.first(b)
        if id(first) not in _ids(a):
            return []
        k = E.order_key(first)
        return [x for x in E.ordered(a) if (E.order_key(x) < k if before else E.order_key(x) > k)]

    return fn


E.EXTENSIONS[f"{{{SETS}}}leading"], E.EXTENSIONS[f"{{{SETS}}}trailing"] = _side(True), _side(False)


# -- strings -------------------------------------------------------------
@_f(STRINGS, "tokenize")
def _tokenize(context, node, s, delimiters="\t\r\n "):
    s, d = E.string(s), E.string(delimiters)
    return token_nodes([t for t in (re.split(f"[{re.escape(d)}]", s) if d else list(s)) if t])


@_f(STRINGS, "split")
def _split(context, node, s, pattern=" "):
    s, p = E.string(s), E.string(pattern)
    return token_nodes([t for t in (s.split(p) if p else list(s)) if t])


@_f(STRINGS, "replace")
def _replace(context, node, s, old, new):
    olds = [n.text() for n in old] if isinstance(old, list) else [E.string(old)]
    news = [n.text() for n in new] if isinstance(new, list) else [E.string(new)] * len(olds)
    pairs = {}
    for k, o in enumerate(olds):
        pairs.setdefault(o, news[k] if k < len(news) else "")
    pairs.pop("", None)
    if not pairs:
        return E.string(s)
    pattern = "|".join(re.escape(o) for o in sorted(pairs, key=len, reverse=True))
    return re.sub(pattern, lambda m: pairs[m[0]], E.string(s))


E.EXTENSIONS[f"{{{STRINGS}}}concat"] = lambda c, n, nodes: "".join(x.text() for x in nodes)


@_f(STRINGS, "padding")
def _padding(context, node, length, chars=" "):
    n, chars = int(numbers.round_half_up(E.number(length))), E.string(chars)
    return (chars * (n // len(chars) + 1))[:n] if chars and n > 0 else ""


@_f(STRINGS, "align")
def _align(context, node, s, pad, where="left"):
    s, pad, where = E.string(s), E.string(pad), E.string(where)
    s = s[: len(pad)]
    room = len(pad) - len(s)
    left = {"right": room, "center": room // 2}.get(where, 0)
    return pad[:left] + s + pad[left + len(s) :]


@_f(STRINGS, "encode-uri")
def _encode(context, node, s, reserved, encoding="UTF-8"):
    return quote(E.string(s), safe="-_.!~*'()" + ("" if E.boolean(reserved) else ";/?:@&=+$,[]"))


@_f(STRINGS, "decode-uri")
def _decode(context, node, s, encoding="UTF-8"):
    return unquote(E.string(s), errors="strict")


E.EXTENSIONS[f"{{{XQUERY}}}escape-uri"] = _encode

# -- dates ---------------------------------------------------------------
_DATE = re.compile(r"(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?\Z")
_DURATION = re.compile(r"(-)?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?\Z")


class Moment:
    """A date or date and time with an optional zone, on the proleptic calendar."""

    def __init__(self, text: str):
        m = _DATE.match(text.strip())
        if not m:
            raise ValueError(text)
        self.date = date(int(m[1]), int(m[2]), int(m[3]))
        self.has_time = m[4] is not None
        self.seconds = Decimal(int(m[4]) * 3600 + int(m[5]) * 60) + Decimal(m[6]) if self.has_time else Decimal(0)
        self.zone = m[7] or ""

    def epoch(self) -> Decimal:
        shift = 0
        if self.zone not in ("", "Z"):
            shift = (1 if self.zone[0] == "+" else -1) * (int(self.zone[1:3]) * 3600 + int(self.zone[4:]) * 60)
        return (self.date.toordinal() - 719163) * 86400 + self.seconds - shift

    def __str__(self) -> str:
        out = self.date.isoformat()
        if self.has_time:
            whole, fraction = int(self.seconds), self.seconds % 1
            out += f"T{whole // 3600:02}:{whole // 60 % 60:02}:{whole % 60:02}" + (str(fraction.normalize())[1:] if fraction else "")
        return out + self.zone


@lru_cache(maxsize=4096)
def parse_duration(text: str) -> tuple[int, Decimal]:
    """(months, seconds)."""
    m = _DURATION.match(text.strip())
    if not m or text.strip().endswith(("P", "T")):
        raise ValueError(text)
    sign = -1 if m[1] else 1
    v = [int(x or 0) for x in m.groups()[1:6]]
    return sign * (v[0] * 12 + v[1]), sign * (Decimal(v[2] * 86400 + v[3] * 3600 + v[4] * 60) + Decimal(m[7] or 0))


def format_duration(months: int, seconds: Decimal) -> str:
    if months * seconds < 0:
        raise ValueError("mixed signs")
    negative = months < 0 or seconds < 0
    months, seconds = abs(months), abs(seconds)
    y, mo = divmod(months, 12)
    d, rest = divmod(int(seconds), 86400)
    h, rest = divmod(rest, 3600)
    mi = rest // 60
    s = seconds - (d * 86400 + h * 3600 + mi * 60)
    day = "".join(f"{v}{u}" for v, u in ((y, "Y"), (mo, "M"), (d, "D")) if v)
    clock = "".join(f"{v}{u}" for v, u in ((h, "H"), (mi, "M")) if v) + (f"{format(s.normalize(), 'f')}S" if s else "")
    return ("-" if negative else "") + "P" + day + ("T" + clock if clock else "" if day else "T0S")


@lru_cache(maxsize=4096)
def moment(text: str) -> Moment:
    """The moment of a text, which isn't to be changed; dates are asked for many parts, and come again."""
    return Moment(text)


def shift(at: Moment, months: int, seconds: Decimal) -> Moment:
    at = copy(at)
    y, m = divmod(at.date.year * 12 + at.date.month - 1 + months, 12)
    day = date(y, m + 1, min(at.date.day, calendar.monthrange(y, m + 1)[1]))
    total = at.seconds + seconds
    days = int(total // 86400)
    at.date, at.seconds = day + timedelta(days=days), total - days * 86400
    at.has_time = at.has_time or at.seconds != 0
    return at


# Names are English whatever the locale, from January and Monday on.
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


def _date(name: str, of, number: bool = True):
    bad = math.nan if number else ""

    def fn(context, node, text=None):
        s = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") if text is None else E.string(text)
        try:
            v = of(moment(s))
        except (ValueError, OverflowError):
            return bad
        return float(v) if number and not isinstance(v, bool) else v

    E.EXTENSIONS[f"{{{DATES}}}{name}"] = fn


_date("year", lambda d: d.date.year)
_date("leap-year", lambda d: calendar.isleap(d.date.year))
_date("month-in-year", lambda d: d.date.month)
_date("month-name", lambda d: MONTHS[d.date.month - 1], False)
_date("month-abbreviation", lambda d: MONTHS[d.date.month - 1][:3], False)
_date("week-in-year", lambda d: d.date.isocalendar()[1])
_date("week-in-month", lambda d: (d.date.day + d.date.replace(day=1).weekday() - 1) // 7 + 1)
_date("day-in-year", lambda d: d.date.toordinal() - date(d.date.year, 1, 1).toordinal() + 1)
_date("day-in-month", lambda d: d.date.day)
_date("day-of-week-in-month", lambda d: (d.date.day - 1) // 7 + 1)
_date("day-in-week", lambda d: d.date.isoweekday() % 7 + 1)
_date("day-name", lambda d: DAYS[d.date.weekday()], False)
_date("day-abbreviation", lambda d: DAYS[d.date.weekday()][:3], False)
_date("hour-in-day", lambda d: int(d.seconds // 3600) if d.has_time else math.nan)
_date("minute-in-hour", lambda d: int(d.seconds // 60 % 60) if d.has_time else math.nan)
_date("second-in-minute", lambda d: float(d.seconds % 60) if d.has_time else math.nan)
_date("date-time", str, False)
_date("date", lambda d: d.date.isoformat() + d.zone, False)
_date("time", lambda d: str(d)[len(d.date.isoformat()) + 1 :] if d.has_time else "", False)


def _or_blank(fn):
    def run(context, node, *v):
        try:
            return fn(*v)
        except (ValueError, OverflowError):
            return ""

    return run


@_f(DATES, "seconds")
def _seconds(context, node, text=None):
    s = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") if text is None else E.string(text)
    try:
        if s.lstrip("-").startswith("P"):
            months, seconds = parse_duration(s)
            return math.nan if months else float(seconds)
        return float(moment(s).epoch())
    except ValueError:
        return math.nan


E.EXTENSIONS[f"{{{DATES}}}add"] = _or_blank(lambda d, x: str(shift(moment(E.string(d)), *parse_duration(E.string(x)))))


def _add_durations(a, b):
    (m1, s1), (m2, s2) = parse_duration(E.string(a)), parse_duration(E.string(b))
    return format_duration(m1 + m2, s1 + s2)


E.EXTENSIONS[f"{{{DATES}}}add-duration"] = _or_blank(_add_durations)
E.EXTENSIONS[f"{{{DATES}}}difference"] = _or_blank(lambda a, b: format_duration(0, moment(E.string(b)).epoch() - moment(E.string(a)).epoch()))
E.EXTENSIONS[f"{{{DATES}}}duration"] = _or_blank(lambda x: format_duration(0, Decimal(repr(E.number(x)))))


def _sum(nodes):
    if not nodes:
        return ""
    months, seconds = 0, Decimal(0)
    for n in nodes:
        m, s = parse_duration(n.text())
        months, seconds = months + m, seconds + s
    return format_duration(months, seconds)


E.EXTENSIONS[f"{{{DATES}}}sum"] = _or_blank(_sum)


# -- dynamic and regular expressions -------------------------------------
def _evaluate(context, node, text):
    return E.evaluate(xpath.parse(E.string(text)), node, context)


for _ns, _name in ((DYNAMIC, "evaluate"), (SAXON, "evaluate"), (SAXON, "expression"), (SAXON, "eval")):
    E.EXTENSIONS[f"{{{_ns}}}{_name}"] = _evaluate


@_f(DYNAMIC, "map")
def _map(context, node, nodes, text):
    tree, out = xpath.parse(E.string(text)), []
    for k, n in enumerate(nodes, 1):
        v = E.evaluate(tree, n, context, k, len(nodes))
        out += v if isinstance(v, list) else token_nodes([E.string(v)])
    return out


E.EXTENSIONS[f"{{{SAXON}}}line-number"] = lambda c, n, *v: float((E.first(v[0]) if v and v[0] else n).line)
E.EXTENSIONS[f"{{{SAXON}}}systemId"] = lambda c, n: c.document.url or ""


def _flags(flags) -> int:
    return re.I if "i" in E.string(flags) else 0


E.EXTENSIONS[f"{{{REGEXP}}}test"] = lambda c, n, s, p, f="": re.search(E.string(p), E.string(s), _flags(f)) is not None
E.EXTENSIONS[f"{{{REGEXP}}}replace"] = lambda c, n, s, p, f, r: re.sub(E.string(p), lambda m: E.string(r), E.string(s), count=0 if "g" in E.string(f) else 1, flags=_flags(f))
E.EXTENSIONS[f"{{{REGEXP}}}match"] = lambda c, n, s, p, f="": token_nodes([m[0] for m in re.finditer(E.string(p), E.string(s), _flags(f))] if "g" in E.string(f) else [x or "" for m in [re.search(E.string(p), E.string(s), _flags(f))] if m for x in (m[0], *m.groups())])
