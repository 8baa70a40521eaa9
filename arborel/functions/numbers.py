"""Numbers as XPath 1.0 reads, writes and rounds them."""

from __future__ import annotations

import math
import re

_NUMBER = re.compile(r"[ \t\r\n]*(-?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)[ \t\r\n]*\Z")


def to_number(s: str) -> float:
    if s.isascii() and s.isdigit():
        return float(s)
    m = _NUMBER.match(s)
    return float(m[1]) if m else math.nan


def to_string(x: float) -> str:
    """Integers without a fraction, others in 15 significant digits; scientific outside 1e-5 to 1e9."""
    if -1e9 < x < 1e9 and x == int(x):
        return str(int(x))
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if 1e-5 < abs(x) < 1e9:
        digits = max(0, 15 - (math.floor(math.log10(abs(x))) + 1)) if abs(x) >= 1 else 15 - math.floor(math.log10(abs(x))) - 1
        text = f"{x:.{digits}f}"
        return text.rstrip("0").rstrip(".") if "." in text else text
    mantissa, exponent = f"{x:.14e}".split("e")
    return f"{mantissa.rstrip('0').rstrip('.')}e{exponent[0]}{exponent[1:].zfill(2)}"


def round_half_up(x: float) -> float:
    if math.isnan(x) or math.isinf(x) or x == 0:
        return x
    if -0.5 <= x < 0:
        return -0.0
    return float(math.floor(x + 0.5)) if abs(x) < 2**52 else x


def modulo(a: float, b: float) -> float:
    """The remainder with the dividend's sign."""
    if math.isnan(a) or math.isnan(b) or math.isinf(a) or b == 0:
        return math.nan
    return math.fmod(a, b)


def divide(a: float, b: float) -> float:
    if b == 0:
        if a == 0 or math.isnan(a):
            return math.nan
        return math.copysign(math.inf, a) * math.copysign(1, b)
    return a / b


def substring(s: str, start: float, length: float | None = None) -> str:
    """Characters at places p >= round(start), and < round(start) + round(length) if given."""
    first = round_half_up(start)
    last = math.inf if length is None else first + round_half_up(length)
    if math.isnan(first) or math.isnan(last):
        return ""
    lo = max(0, 0 if first == -math.inf else math.inf if first == math.inf else int(first) - 1)
    if lo == math.inf or last == -math.inf:
        return ""
    hi = len(s) if last == math.inf else max(0, int(last) - 1)
    return s[int(lo) : hi]


def translate(s: str, old: str, new: str) -> str:
    table: dict[int, str | None] = {}
    for k, c in enumerate(old):
        table.setdefault(ord(c), new[k] if k < len(new) else None)
    return s.translate(table)
