"""XPath 1.0 functions and casts as column expressions, with the semantics of XPath rather than of SQL.

Numbers are IEEE doubles (division by zero gives infinity or NaN, NaN equals
nothing), rounding goes half up, and strings are counted in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[ \\t\\r\\n]"
NUMBER = f"^{BLANK}*-?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?{BLANK}*$"


def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != inf())


def number(s: Column) -> Column:
    """number(string): what isn't an XPath number is NaN."""
    return F.when(s.rlike(NUMBER), F.btrim(s, F.lit(" \t\r\n")).try_cast("double")).otherwise(nan())


def string(x: Column) -> Column:
    """string(number): integers without fraction, else 15 significant digits without trailing zeros."""
    plain = (F.abs(x) < 1e9) & ((F.abs(x) > 1e-5) | (x == 0))
    digits = F.when(F.abs(x) >= 1e8, F.format_string("%.6f", x))
    for k in range(8, -6, -1):
        low = 10.0 ** (k - 1)
        digits = digits.when(F.abs(x) >= low, F.format_string(f"%.{15 - k}f", x))
    trimmed = F.regexp_replace(F.regexp_replace(digits, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    exponent = F.format_string("%.14e", x)
    mantissa = F.regexp_replace(F.regexp_replace(F.substring_index(exponent, "e", 1), "0+$", ""), "\\.$", "")
    scientific = F.concat(mantissa, F.lit("e"), F.substring_index(exponent, "e", -1))
    return (
        F.when(F.isnan(x), "NaN")
        .when(x == inf(), "Infinity")
        .when(x == -inf(), "-Infinity")
        .when(x == 0, "0")
        .when(plain & (x == F.floor(x)), x.cast("long").cast("string"))
        .when(plain, trimmed)
        .otherwise(scientific)
    )


def boolean(x: Column) -> Column:
    """boolean(number)."""
    return (x != 0) & ~F.isnan(x)


def equal(a: Column, b: Column) -> Column:
    """a = b on numbers: NaN equals nothing."""
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def less(a: Column, b: Column) -> Column:
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


def divide(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b != 0, a / F.when(b != 0, b)).when(F.isnan(a) | F.isnan(b) | (a == 0), nan()).when(a > 0, inf()).otherwise(-inf())


def modulo(a: Column, b: Column) -> Column:
    """a mod b: the remainder with the sign of a."""
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == inf()), nan()).otherwise(a % F.when(b != 0, b))


def _whole(x: Column, n: Column) -> Column:
    """The integer ``n`` that ``x`` is rounded to, as a double; zero has the sign of ``x``, and what has no fraction stays."""
    return F.when(finite(x) & (F.abs(x) < 2.0**52), F.when(n == 0, x * 0.0).otherwise(n.cast("double"))).otherwise(x)


def floor(x: Column) -> Column:
    return _whole(x, F.floor(x))


def ceiling(x: Column) -> Column:
    return _whole(x, F.ceil(x))


def round_(x: Column) -> Column:
    """round(x): half goes up, so round(-2.5) is -2."""
    return floor(x + 0.5)


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    first = round_(start)
    last = inf() if length is None else first + round_(length)
    lo = F.greatest(first, F.lit(1.0))
    hi = F.least(last, F.length(s).cast("double") + 1)
    bad = F.isnan(first) | F.isnan(last) | (hi <= lo)
    return F.when(bad, "").otherwise(F.substring(s, F.when(bad, 1).otherwise(lo.cast("int")), F.when(bad, 0).otherwise((hi - lo).cast("int"))))


def substring_before(a: Column, b: Column) -> Column:
    at = F.instr(a, b)
    return F.when(at > 0, F.substring(a, F.lit(1), at - 1)).otherwise("")


def substring_after(a: Column, b: Column) -> Column:
    at = F.instr(a, b)
    return F.when(at > 0, F.substring(a, at + F.length(b), F.length(a))).otherwise("")


def normalize_space(s: Column) -> Column:
    return F.btrim(F.regexp_replace(s, f"{BLANK}+", " "), F.lit(" "))


def has_token(s: Column, token: str) -> Column:
    """Whether a list of tokens separated by blanks holds ``token``, as class attributes do."""
    return F.array_contains(F.split(normalize_space(s), " "), token)


def encode_uri(s: Column, reserved: bool = True) -> Column:
    """Percent-encode; with ``reserved`` also the characters that URIs reserve."""
    out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    keep = {"%7E": "~", "%21": "!", "%27": "'", "%28": "(", "%29": ")"}
    if not reserved:
        keep |= {"%3B": ";", "%2F": "/", "%3F": "?", "%3A": ":", "%40": "@", "%26": "&", "%3D": "=", "%2B": "+", "%24": "$", "%2C": ",", "%5B": "[", "%5D": "]"}
    for code, c in keep.items():
        out = F.replace(out, F.lit(code), F.lit(c))
    return out


def decode_uri(s: Column) -> Column:
    return F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


# -- EXSLT: strings, numbers and dates -----------------------------------
def tokenize(s: Column, delimiters: str = " \t\r\n") -> Column:
    """str:tokenize: the non-empty runs between any of the delimiters; each character if there are none."""
    if not delimiters:
        return F.filter(F.split(s, ""), lambda x: x != "")
    return F.filter(F.split(s, "[" + "".join("\\" + c if not c.isalnum() and c.isascii() and not c.isspace() else c for c in delimiters) + "]"), lambda x: x != "")


def split(s: Column, pattern: str = " ") -> Column:
    """str:split: the non-empty parts between occurrences of a string."""
    import re

    return F.filter(F.split(s, re.escape(pattern)), lambda x: x != "") if pattern else F.filter(F.split(s, ""), lambda x: x != "")


def replace_all(s: Column, pairs: dict[str, str]) -> Column:
    """str:replace with several strings: at each place the longest that matches is replaced."""
    import re

    if not pairs:
        return s
    longest = sorted(pairs, key=lambda k: (-len(k), k))
    found = F.regexp_extract_all(s, F.lit("(?s)" + "|".join(map(re.escape, longest)) + "|."), F.lit(0))
    table = F.create_map(*[F.lit(x) for k in longest for x in (k, pairs[k])])
    return F.array_join(F.transform(found, lambda x: F.coalesce(F.get(F.array(F.try_element_at(table, x)), F.lit(0)), x)), "")


def padding(length: int, chars: str = " ") -> str:
    return (chars * (length // len(chars) + 1))[:length] if chars and length > 0 else ""


def align(s: Column, pad: str, where: str = "left") -> Column:
    """str:align: ``s`` laid over ``pad``, cut to its length."""
    n = len(pad)
    cut = F.substring(s, 1, n)
    room = F.lit(n) - F.length(cut)
    left = F.lit(0) if where == "left" else room if where == "right" else F.floor(room / 2).cast("int")
    whole = F.lit(pad)
    return F.concat(F.substring(whole, F.lit(1), left), cut, F.substring(whole, left + F.length(cut) + 1, F.lit(n)))


def leap_year(d: Column) -> Column:
    y = F.year(d)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def week_in_month(d: Column) -> Column:
    """Weeks begin on Monday; the first is the one that the first of the month lies in."""
    first = F.weekday(F.trunc(d, "month"))
    return F.floor((F.dayofmonth(d) + first - 1) / 7).cast("int") + 1


def day_of_week_in_month(d: Column) -> Column:
    return F.floor((F.dayofmonth(d) - 1) / 7).cast("int") + 1


def duration(seconds: Column) -> Column:
    """date:duration: a number of seconds as days, hours, minutes and seconds of ISO 8601."""
    total = F.abs(seconds)
    whole = F.floor(total).cast("long")
    d, h, m = F.floor(whole / 86400).cast("long"), F.floor(whole % 86400 / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long")
    s = total - (whole - whole % 60).cast("double")
    part = lambda v, unit: F.when(v > 0, F.concat(v.cast("string"), F.lit(unit))).otherwise("")
    clock = F.concat(part(h, "H"), part(m, "M"), F.when(s > 0, F.concat(string(s), F.lit("S"))).otherwise(""))
    body = F.concat(part(d, "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.lit("P"), F.when(body == "", "T0S").otherwise(body))


def month_name(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def day_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def add_months_seconds(d: Column, months: Column, seconds: Column) -> Column:
    """date:add of a duration's two parts: months first, with the day cut to the month's last, then seconds."""
    moved = F.add_months(d.cast("date"), months).cast("timestamp").cast("long") + (d.cast("timestamp").cast("long") - d.cast("date").cast("timestamp").cast("long"))
    return F.timestamp_seconds(moved + seconds)


def nan_min(x: Column) -> Column:
    """math:min as an aggregate: NaN if any value is NaN or there is none."""
    return F.when(F.coalesce(F.max(F.isnan(x).cast("int")), F.lit(1)) == 1, nan()).otherwise(F.min(x))


def nan_max(x: Column) -> Column:
    return F.when(F.coalesce(F.max(F.isnan(x).cast("int")), F.lit(1)) == 1, nan()).otherwise(F.max(x))


def sort_key(x: Column, descending: bool = False) -> list[Column]:
    """Numeric sort: NaN first ascending, last descending."""
    return [F.isnan(x).asc(), x.desc()] if descending else [F.isnan(x).desc(), x.asc()]
