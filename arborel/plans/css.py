"""CSS selectors, compiled to XPath expressions."""

from __future__ import annotations

import re
from functools import lru_cache


class SelectorSyntaxError(ValueError):
    """A selector that isn't CSS."""


_IDENT = r"-?(?:[_a-zA-Z]|[^\x00-\x7f]|\\[^\n])(?:[\w-]|[^\x00-\x7f]|\\[^\n])*"
_TOKEN = re.compile(
    rf"(?P<space>[ \t\r\n\f]+)|(?P<string>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<nth>[+-]?\d*n(?:\s*[+-]\s*\d+)?(?![\w-])|[+-]?\d+)|(?P<hash>#(?:[\w-]|[^\x00-\x7f]|\\[^\n])+)"
    rf"|(?P<match>[~|^$*!]?=)|(?P<function>{_IDENT}\()|(?P<ident>{_IDENT})|(?P<other>::|[>+~,.*:\[\]()|@/])",
    re.S,
)


def _plain(s: str) -> str:
    s = re.sub(r"\\([0-9a-fA-F]{1,6})\s?", lambda m: chr(int(m[1], 16)), s)
    return re.sub(r"\\(.)", r"\1", s)


def literal(s: str) -> str:
    if "'" not in s:
        return f"'{s}'"
    if '"' not in s:
        return f'"{s}"'
    return "concat('" + "', \"'\", '".join(s.split("'")) + "')"


class _Compiler:
    def __init__(self, selector: str, default_ns: str | None, any_ns: bool):
        self.selector, self.default_ns, self.any_ns = selector, default_ns, any_ns
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(selector):
            m = _TOKEN.match(selector, at)
            if not m:
                raise SelectorSyntaxError(f"unexpected {selector[at:at + 10]!r} in {selector!r}")
            self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def space(self) -> bool:
        found = self.peek()[0] == "space"
        while self.peek()[0] == "space":
            self.at += 1
        return found

    def accept(self, *values: str) -> str | None:
        if self.peek()[0] in ("other", "match") and self.peek()[1] in values:
            return self.take()[1]
        return None

    def fail(self):
        raise SelectorSyntaxError(f"unexpected {self.peek()[1] or 'end'!r} in {self.selector!r}")

    # -- grammar ---------------------------------------------------------
    def group(self, prefix: str, closing: bool = False) -> list[str]:
        out = [self.complex(prefix)]
        self.space()
        while self.accept(","):
            out.append(self.complex(prefix))
            self.space()
        if not closing and self.peek()[0] != "end":
            self.fail()
        return out

    def complex(self, prefix: str) -> str:
        self.space()
        lead = self.combinator()
        path = self._join("." if prefix in ("", ".//", "//") else prefix, lead, None) if lead else prefix
        path += self.compound("*", lead)
        while True:
            had_space = self.space()
            c = self.combinator() or ("" if not had_space else " ")
            if not c or (c == " " and (self.peek()[0] == "end" or self.peek()[1] in (",", ")"))):
                return path
            path = self._join(path, c, None) + self.compound("*", c)

    def combinator(self) -> str:
        if self.peek()[1] in (">", "+", "~", "/") and self.peek()[0] == "other":
            c = self.take()[1]
            if c == "/" and self.accept("/"):
                c = " "
            self.space()
            return ">" if c == "/" else c
        return ""

    @staticmethod
    def _join(path: str, combinator: str, _) -> str:
        return path + {" ": "//", ">": "/", "+": "/following-sibling::*[1]/self::", "~": "/following-sibling::"}[combinator]

    def compound(self, name: str, lead: str) -> str:
        """A type selector with its conditions, as an XPath step."""
        kind, value = self.peek()
        given = False
        if self.accept("@"):
            return "@" + _plain(self.take()[1])
        if kind == "function" and value[:-1] in ("text", "comment"):
            self.take()
            self._close()
            step = value + ")"
            given = True
        else:
            step = "*"
            if kind == "ident":
                self.take()
                step, given = self._element(None, _plain(value)), True
            elif value == "*":
                self.take()
                given = True
            if self.accept("|"):
                local = self.take()[1]
                prefix = _plain(value) if given else ""
                step = local if not prefix else f"*[local-name()={literal(_plain(local))}]" if prefix == "*" else f"{prefix}:{_plain(local)}"
                given = True
        conditions: list[str] = []
        out = step
        while True:
            kind, value = self.peek()
            if kind == "hash":
                self.take()
                conditions.append(f"@id={literal(_plain(value[1:]))}")
            elif value == "." and kind == "other":
                self.take()
                conditions.append(_class(_plain(self.take()[1])))
            elif value == "[":
                self.take()
                conditions.append(self.attribute())
            elif value in (":", "::"):
                self.take()
                condition, own = self.pseudo()
                if own and conditions:
                    out += f"[{' and '.join(conditions)}]"
                    conditions = []
                if own:
                    out += f"[{condition}]"
                else:
                    conditions.append(condition)
            else:
                break
            given = True
        if not given:
            self.fail()
        return out + (f"[{' and '.join(conditions)}]" if conditions else "")

    def _element(self, prefix: str | None, local: str) -> str:
        if self.any_ns:
            return f"*:{local}"
        return f"{self.default_ns}:{local}" if self.default_ns else local

    def attribute(self) -> str:
        self.space()
        at = self.accept("@")
        name = _plain(self.take()[1])
        if self.accept("|"):
            name += ":" + _plain(self.take()[1])
        self.space()
        a = "@" + name
        op = self.accept("=", "~=", "|=", "^=", "$=", "*=", "!=")
        if not op:
            if not self.accept("]"):
                self.fail()
            return a
        self.space()
        kind, value = self.take()
        v = literal(_plain(value[1:-1] if kind == "string" else value))
        self.space()
        if not self.accept("]"):
            self.fail()
        del at
        return {
            "=": f"{a}={v}", "!=": f"{a}!={v}", "*=": f"contains({a},{v})", "^=": f"starts-with({a},{v})",
            "|=": f"{a}={v} or starts-with({a},concat({v},'-'))", "~=": f"contains(concat(' ',normalize-space({a}),' '),concat(' ',{v},' '))",
            "$=": f"substring({a},string-length({a})-string-length({v})+1,string-length({v}))={v}",
        }[op].join(("(", ")") if op == "|=" else ("", ""))

    def _close(self) -> None:
        self.space()
        if not self.accept(")"):
            self.fail()

    def pseudo(self) -> tuple[str, bool]:
        """An XPath condition, and whether it counts places and so needs a predicate of its own."""
        kind, value = self.take()
        simple = {
            "first-child": "count(preceding-sibling::*)=0", "last-child": "count(following-sibling::*)=0", "only-child": "count(preceding-sibling::*)=0 and count(following-sibling::*)=0",
            "empty": "not(node())", "parent": "node()", "root": "not(parent::*)",
        }
        placed = {"first-of-type": "position()=1", "first": "position()=1", "last-of-type": "position()=last()", "last": "position()=last()", "only-of-type": "last()=1"}
        if kind == "ident":
            if value in simple:
                return f"({simple[value]})" if " and " in simple[value] else simple[value], False
            if value in placed:
                return placed[value], True
            return f"{value}(.)", False
        if kind != "function":
            self.fail()
        name = value[:-1]
        self.space()
        if name == "not":
            conditions = []
            for path in self.group("self::", True):
                conditions.append(path if path.startswith("self::") else path)
            self._close()
            return f"not({' or '.join(conditions)})", False
        if name == "has":
            paths = []
            while True:
                self.space()
                lead = self.combinator()
                paths.append((self._join(".", lead, None) if lead else ".//") + self._tail(lead))
                self.space()
                if not self.accept(","):
                    break
            self._close()
            return paths[0] if len(paths) == 1 else f"({' or '.join(paths)})", False
        if name in ("contains", "self"):
            k, v = self.take()
            self._close()
            v = _plain(v[1:-1] if k == "string" else v)
            return (f"contains(.,{literal(v)})" if name == "contains" else f"self::{v}"), False
        if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type", "nth", "eq", "gt"):
            text = ""
            while self.peek()[1] not in (")", ""):
                text += self.take()[1]
            self._close()
            if name == "eq":
                return f"position()={int(text)}", True
            if name == "gt":
                return f"position()>{int(text)}", True
            place = {
                "nth-child": "(count(preceding-sibling::*)+1)", "nth-last-child": "(count(following-sibling::*)+1)", "nth-of-type": "position()", "nth": "position()",
                "nth-last-of-type": "(last()-position()+1)",
            }[name]
            return nth(text, place), "child" not in name
        args = []
        while self.peek()[1] not in (")", ""):
            k, v = self.take()
            if k != "space" and v != ",":
                args.append(literal(_plain(v[1:-1])) if k == "string" else v)
        self._close()
        return f"{name}({','.join(['.', *args])})", False

    def _tail(self, lead: str) -> str:
        out = self.compound("*", lead)
        while True:
            had = self.space()
            c = self.combinator() or (" " if had else "")
            if not c or (c == " " and self.peek()[1] in (",", ")", "")):
                return out
            out = self._join(out, c, None) + self.compound("*", c)


def _class(name: str) -> str:
    return f"contains(concat(' ',normalize-space(@class),' '),{literal(f' {name} ')})"


def nth(text: str, place: str) -> str:
    """The condition that ``place`` is one of an+b, n = 0, 1, ..."""
    text = {"even": "2n", "odd": "2n+1"}.get(text.strip(), re.sub(r"\s+", "", text))
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if not m:
        raise SelectorSyntaxError(f"bad argument {text!r}")
    if m[3]:
        return f"{place}={int(m[3])}"
    a = {"": 1, "+": 1, "-": -1}.get(m[1]) or int(m[1] or 1)
    b = int(m[2] or 0)
    if a == 0:
        return f"{place}={b}"
    bound = f"{place}>={b}" if a > 0 else f"{place}<={b}"
    return f"({bound} and (({place}-{b}) mod {abs(a)})=0)"


@lru_cache(maxsize=4096)
def xpath_for(selector: str, prefix: str = "//", default_ns: str | None = None, any_ns: bool = False) -> tuple[str, ...]:
    """The XPath expressions of a selector list, one for each selector.

    ``default_ns`` is a prefix for element names without one; ``any_ns`` matches
    them in any namespace, as HTML documents need.
    """
    if not selector.strip():
        raise SelectorSyntaxError("empty selector")
    return tuple(_Compiler(selector, default_ns, any_ns).group(prefix))
