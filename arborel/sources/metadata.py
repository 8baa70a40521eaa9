"""Small dimension tables of HTML: elements by role, character references, encodings."""

from __future__ import annotations

import codecs
from html.entities import html5 as _HTML5
from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession

from . import html4

# Elements that HTML 4 calls inline, or deprecates.
INLINE = frozenset(
    "a abbr acronym applet b basefont bdo big br button cite code del dfn em font i iframe img input ins kbd label map object q s samp script select small span strike strong sub sup textarea tt u var".split()
)
DEPRECATED = frozenset("applet basefont center dir font isindex menu s strike u".split())
OTHER = frozenset("area base body caption col colgroup dd dt frame frameset head html legend link meta noscript optgroup option param style title".split())

#: Encodings under other names, beside those that Python knows.
ALIASES: dict[str, str] = {}


def elements(spark: SparkSession) -> DataFrame:
    """(name, is_empty, is_inline, is_block, is_deprecated) of HTML 4 elements: about a hundred rows."""
    names = sorted(INLINE | DEPRECATED | OTHER | html4.BLOCK | html4.VOID)
    rows = [(n, n in html4.VOID, n in INLINE, n in html4.BLOCK, n in DEPRECATED) for n in names]
    return spark.createDataFrame(rows, "name string, is_empty boolean, is_inline boolean, is_block boolean, is_deprecated boolean")


def references(spark: SparkSession) -> DataFrame:
    """(name, value) of named character references; a name without its semicolon is one too where HTML has it."""
    return spark.createDataFrame(sorted(_HTML5.items()), "name string, value string")


def entity(name: str) -> int | None:
    """Code point of an HTML 4 entity."""
    return name2codepoint.get(name)


def encoding(name: str) -> str | None:
    """Canonical name of an encoding or alias, or None."""
    try:
        return codecs.lookup(ALIASES.get(name.lower(), name)).name
    except LookupError:
        return None


def alias(name: str, of: str) -> None:
    if encoding(of) is None:
        raise LookupError(of)
    ALIASES[name.lower()] = of


def remove_alias(name: str) -> None:
    ALIASES.pop(name.lower(), None)
