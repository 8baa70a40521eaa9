"""Main text of web pages from flat text blocks.

A page is cut into flat blocks of text at block-level tags.  Each block is
described by its own word count and link density, those of its neighbours, and
what its open elements and their names suggest; a decision tree, trained on the
small labelled table at the end of this module, keeps or drops it.  No name of
a class decides alone: what names suggest are features like the others.  A page
is one row and is treated where it lies, in time linear in its length.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<!\[CDATA\[.*?\]\]>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'/])hidden(?=[\s/=]|$)|display\s*:\s*none""", re.I)

# Element names of HTML by how they bear on text; all others are inline.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
DROPPED = {"head", "select", "option", "datalist", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BESIDE = {"nav", "footer", "aside", "menu", "dialog", "search"}
FORMS = {"form", "fieldset"}
MAIN = {"article", "main"}
# Words of a class, id or role: parts that are hardly ever the article, parts that may be, and the article.
SIGNS = set(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus footer "
    "gdpr masthead menu menubar modal nav navbar navigation newsletter outbrain overlay pager pagination paywall popup promo promoted promotion sidebar signup skip sponsor sponsored "
    "subscribe subscription taboola toolbar topbar".split()
)
WEAK_SIGNS = set("dialog disclaimer discussion form header login notice notification recommended related replies reply respond search share sharing social tags widget widgets".split())
MAIN_SIGNS = {"article", "content", "entry", "main", "post", "story", "text"}
#: Elements that the article or body ends if they are still open.
ENDED_BY_MAIN = {"nav", "header", "head", "menu"}
#: Words before a sign that say only how the page is laid out.
LAYOUT = {"has", "no", "with", "without", "is", "hide"}

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "anchors", "end_mark", "heading", "beside", "sign", "weak_sign", "form", "article", "has_article",
)


class Place(NamedTuple):
    """What the open elements say about the text below them."""

    beside: bool = False  # within navigation, a footer, a header that is none of the article, ...
    sign: bool = False  # a name suggests a part beside the article
    weak: bool = False  # a name that an article's own part may also have
    form: bool = False
    article: bool = False  # within an article or main element, or one of such a name
    tagged: bool = False  # by element, not name
    dropped: bool = False


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    anchors: int  # links that begin in it
    place: Place
    heading: bool


@lru_cache(maxsize=4096)
def _signs(attrs: str) -> tuple[bool, bool, bool, bool]:
    """What class, id and role suggest: beside, perhaps beside, the article; and whether the element is hidden."""
    sign = weak = main = False
    for _, value in _NAMED.findall(attrs):
        for name in value.strip("\"'").lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            if not words or LAYOUT & set(words[:-1]) or "free" in words:
                continue
            about_main = bool(MAIN_SIGNS & set(words))
            # Of content-sidebar-wrap, post-comments and entry-header the last word says what the element is.
            telling = words[-1:] if about_main else words
            sign |= not SIGNS.isdisjoint(telling)
            perhaps = not WEAK_SIGNS.isdisjoint(telling) and not (about_main and words[-1] == "header")
            weak |= perhaps
            main |= about_main and not perhaps and SIGNS.isdisjoint(telling)
    return sign, weak, main, bool(_HIDDEN.search(attrs))


def _inner(name: str, attrs: str, outer: Place) -> Place:
    sign, weak, main, hidden = _signs(attrs) if attrs else (False, False, False, False)
    dropped = outer.dropped or name in DROPPED or hidden
    if name in ("html", "body"):
        return outer._replace(dropped=dropped)
    if name == "main":  # whatever encloses it is layout
        return Place(article=True, tagged=True, dropped=dropped)
    beside = outer.beside or name in BESIDE or (name == "header" and not (outer.article or main))
    article = outer.article or ((name == "article" or main) and not (beside or outer.sign or sign))
    opens = article and not outer.article
    return Place(
        beside,
        outer.sign or sign,
        (outer.weak and not opens) or weak,
        (outer.form and not opens) or name in FORMS,
        article,
        outer.tagged or (article and name == "article"),
        dropped,
    )


def blocks(page: str) -> list[Block]:
    """The flat text blocks of ``page`` in order; malformed markup ends elements as best it can."""
    out: list[Block] = []
    stack: list[tuple[str, Place]] = [("", Place())]
    open_names: Counter[str] = Counter()  # so that an end tag without a start costs nothing
    parts: list[str] = []
    linked, anchors, links, heading, raw = 0, 0, 0, 0, ""

    def flush() -> None:
        nonlocal linked, anchors
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), anchors, stack[-1][1], heading > 0))
            parts.clear()
        linked = anchors = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not stack[-1][1].dropped:
            parts.append(text)
            if links:
                linked += len(text)

    def opened(name: str, attrs: str) -> None:
        nonlocal heading, links, anchors
        heading += name in HEADINGS
        links += name == "a"
        anchors += name == "a"
        open_names[name] += 1
        stack.append((name, _inner(name, attrs, stack[-1][1])))

    def close(depth: int) -> None:
        nonlocal heading, links
        flush()
        for name, _ in stack[depth:]:
            heading -= name in HEADINGS
            links -= name == "a"
            open_names[name] -= 1
        del stack[depth:]

    at = 0
    while at < len(page):
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at, raw = (end.start() if end else len(page)), ""
            continue
        m = _MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            if name in RAW:
                continue
            if name in BLOCK:
                flush()
            if open_names[name]:
                depth = len(stack) - 1
                if name in BLOCK:
                    while stack[depth][0] != name:
                        depth -= 1
                    close(depth)
                else:  # an inline element ends within its block; what is open inside it ends with it
                    while stack[depth][0] != name and stack[depth][0] not in BLOCK and depth:
                        depth -= 1
                    if stack[depth][0] == name:
                        for inner, _ in stack[depth:]:
                            links -= inner == "a"
                            open_names[inner] -= 1
                        del stack[depth:]
            continue
        if name in RAW:
            raw = name
            continue
        if name not in BLOCK:
            if name == "br":
                add(" ")
            elif name not in VOID and not attrs.endswith("/"):
                opened(name, attrs)
            continue
        flush()
        # What is still open inline doesn't reach into a new block; paragraphs and items end where the next begins.
        while len(stack) > 1 and (stack[-1][0] not in BLOCK or stack[-1][0] == "p" or (name in HEADINGS and stack[-1][0] in HEADINGS) or (name == "li" and stack[-1][0] == "li")):
            close(len(stack) - 1)
        before = sum(open_names[x] for x in ENDED_BY_MAIN) if name in MAIN or name == "body" else 0
        if before:
            depth = len(stack)
            while before:
                depth -= 1
                before -= stack[depth][0] in ENDED_BY_MAIN
            close(depth)
        if name not in VOID:
            opened(name, attrs)
    flush()
    return out


#: Word counts from here on are alike to the tree when it learns.
MANY = 40.0
_ENDS = tuple(".!?\"'”»)…:;")


def describe(found: list[Block]) -> list[tuple[float, ...]]:
    """A row of FEATURES for each block; before the first and after the last block there are no words."""
    words = [0, *(b.text.count(" ") + 1 for b in found), 0]
    links = [0.0, *(round(b.linked / len(b.text), 2) for b in found), 0.0]
    has_article = any(b.place.tagged for b in found)
    return [
        (
            words[k], links[k], words[k - 1], links[k - 1], words[k + 1], links[k + 1], b.anchors, b.text.endswith(_ENDS), b.heading,
            b.place.beside, b.place.sign, b.place.weak, b.place.form, b.place.article, has_article,
        )
        for k, b in enumerate(found, 1)
    ]


class Tree:
    """A binary decision tree grown by Gini impurity; ties go to the earlier feature and smaller cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 4):
        self.share = float(y.mean()) if len(y) else 0.0
        self.feature = -1
        if depth == 0 or len(y) < 2 * least or self.share in (0.0, 1.0):
            return
        best = (1e-12, -1, 0.0)
        whole = len(y) * self.share * (1 - self.share)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= cut
                a, b = y[low], y[~low]
                if min(len(a), len(b)) < least:
                    continue
                gain = whole - len(a) * a.mean() * (1 - a.mean()) - len(b) * b.mean() * (1 - b.mean())
                if gain > best[0] + 1e-9:
                    best = (gain, f, float(cut))
        if best[1] < 0:
            return
        _, self.feature, self.cut = best
        low = x[:, self.feature] <= self.cut
        self.low, self.high = Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least)

    def keeps(self, row: Sequence[float]) -> bool:
        """Whether the block of these features is main text."""
        at = self
        while at.feature >= 0:
            at = at.low if row[at.feature] <= at.cut else at.high
        return at.share >= 0.5

    def used(self) -> set[str]:
        """Names of the features that the tree asks for."""
        return set() if self.feature < 0 else {FEATURES[self.feature]} | self.low.used() | self.high.used()


@lru_cache(maxsize=1)
def trained() -> Tree:
    """The tree of the labelled table; the same in every process."""
    xs, ys = [], []
    for page, labels in labelled_pages():
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks and {len(labels)} labels: {[b.text for b in found]}")
        xs += describe(found)
        ys += [c == "m" for c in labels]
    return Tree(np.minimum(np.array(xs, dtype=np.float64), MANY), np.array(ys, dtype=np.float64))


def main_text(page: str, tree: Tree | None = None) -> str:
    found, tree = blocks(page), tree or trained()
    return "\n".join(b.text for b, row in zip(found, describe(found)) if tree.keeps(row))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, in place of ``html``.

    Null or empty html, and pages without text in their article, give the empty
    string.  Repeated rows are each returned; an empty table gives none.  A
    column named ``text`` is replaced; other columns pass through.
    """
    base = pages.drop("text")
    schema = base.drop("html").withColumn("text", F.lit("")).schema
    rows = base.select(*[F.col(f"`{c}`") for c in base.columns if c != "html"], F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    tree = trained()  # some dozens of nodes, sent along with the task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, tree) for page in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return rows.mapInArrow(run, schema)


def op8_html_text(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# -- the labelled table --------------------------------------------------
#: What stands for a long sentence, a short one, a label and a heading in the parts below.
_TEXTS = {"{l}": (12, 70), "{s}": (1, 9), "{k}": (1, 5), "{h}": (2, 10)}
_BAR = " ".join(f"<a href=/{k}>{{k}}</a>" for k in range(8))
#: Parts of articles: markup, and for each of its blocks m (main text) or o (other).
ARTICLE_PARTS = [
    ("<h1>{h}</h1><p>{l}</p><p>{s}</p><p>{l}</p>", "mmmm"),
    ("<header class=entry-header><h1>{h}</h1></header><p>{l} <a href=/x>{k}</a></p><p>{s}</p>", "mmm"),
    ("<h2>{h}</h2><ul><li>{k}</li><li>{k}</li></ul><blockquote>{l}</blockquote><p>{s}</p>", "mmmmm"),
    ("<h1><a href=/self>{h}</a></h1><p><a href=/q>{l}</a></p><p>{l}</p>", "mmm"),
    ("<p>{l}</p><table><tr><td>{k}</td><td>12</td></tr><tr><td>{k}</td><td>7</td></tr></table><p>{s}</p>", "mmmmmm"),
    ("<section id=discussion><h2>{h}</h2><p>{l}</p><p>{l}</p></section>", "mmm"),
    ("<section class=related><h2>{h}</h2><p>{l}</p><p>{l}</p></section><p>{s}</p>", "mmmm"),
    ("<p>{l}</p><div class=ad>{s}</div><p>{l}</p>", "mom"),
    ("<p>{l}</p><div class='share-box share'><a href=/t>{k}</a> <a href=/f>{k}</a></div><p>{l}</p>", "mom"),
    ("<h1>{h}</h1><p>{l}</p><section class=comments><h3>{h}</h3><p>{l}</p><p>{s}</p></section>", "mmooo"),
    ("<p>{l}</p><figure><img src=a><figcaption>{h}</figcaption></figure><p>{l}</p><h3>{h}</h3><ol><li><a href=/1>{h}</a></li><li><a href=/2>{k}</a></li></ol>", "mmmmmm"),
    ("<h2>{h}</h2><p>{s} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {s} <label>{k}</label> {s}</p><p>{l}</p>", "mmm"),
    ("<p>{l}</p><div class=newsletter><p>{l}</p><form><p>{s}</p></form></div><p>{s}</p>", "moom"),
    ("<p>{l} <a href=/x>{h}</a> {s}</p><p><a href=/y>{k}</a> {l}</p>", "mm"),
    ("<p><a href=/x>{h}</a> {s} <a href=/y>{k}</a> {s}</p><p>{l} <a href=/z>{l}</a></p>", "mm"),
    ("<ul><li>{l} <a href=/x>{k}</a></li><li><a href=/y>{k}</a> {s}</li></ul><p>{l}</p>", "mmm"),
    ("<p>{s}</p>", "m"),
    ("<h1>{h}</h1><p>{s}</p><p>{s}</p>", "mmm"),
    ("<div class=notice><p>{s}</p></div><h1>{h}</h1><p>{l}</p>", "omm"),
    ("<pre>{s}</pre><p>{l}</p><p>{l}</p><aside><p>{l}</p></aside>", "mmmo"),
    ("<p>{s}</p><p><a href=/r>{h}</a></p><p>{l}</p><div class=related><h3>{k}</h3><ul><li><a href=/r>{h}</a></li><li><a href=/s>{k}</a></li></ul></div>", "mmmooo"),
]
#: What encloses an article; the last ones have nothing that says so.
WRAPPERS = [
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='post-content'>{}</div>", "<div id=content>{}</div>", "<div class='main-content has-sidebar'>{}</div>",
    "<form id=aspnetForm><div id=content>{}</div></form>", "<div class='page no-sidebar'><main>{}</main></div>", "<div class='post tag-search'>{}</div>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "{}",
]
#: Parts before articles and after them that some element or name marks, and those that only their text and links tell.
BEFORE = [
    ("<nav><ul><li><a href=/>{k}</a></li><li><a href=/n>{k}</a></li><li><a href=/o>{k}</a></li></ul></nav>", "ooo"),
    ("<header><h1>{h}</h1><p>{l}</p></header>", "oo"),
    ("<header><a href=/>{k}</a><p>{s}</p></header><div class=ad>{l}</div>", "ooo"),
    ("<div class=ad>{s}</div>", "o"),
    ("<nav>" + _BAR + "</nav>", "o"),
    ("<div class=topbar>" + _BAR + "</div><div class=ad><a href=/buy>{l}</a></div>", "oo"),
    ("<nav><a href=/>{k}</a> <a href=/b>{k}</a></nav><div class='ad banner'>{l}</div>", "oo"),
    ("<div class=cookie-notice>{l}</div>", "o"),
    ("<header><h1><a href=/>{h}</a></h1></header><div class=sponsor><h3><a href=/buy>{h}</a></h3><a href=/buy>{l}</a></div>", "ooo"),
    ("<div id=sidebar><p>{l}</p><a href=/s>{k}</a></div>", "oo"),
    ("<form action=/login><p>{s}</p><p>{l}</p></form>", "oo"),
    ("<div class=search><form><label>{k}</label></form></div><div class=breadcrumbs><a href=/>{k}</a> &gt; <a href=/b>{k}</a></div>", "oo"),
    ("<div class=menu><ul><li><a href=/a>{k}</a></li><li>{k}</li><li><a href=/b>{k}</a></li></ul></div>", "ooo"),
    ("", ""),
]
PLAIN_BEFORE = [
    ("<div>" + _BAR + "</div>", "o"),
    ("<div><a href=/a>{k}</a> <a href=/b>{k}</a> <a href=/c>{k}</a></div>", "o"),
    ("<ul><li><a href=/1>{k}</a></li><li><a href=/2>{k}</a></li><li><a href=/3>{h}</a></li></ul>", "ooo"),
    ("<div><a href=/a>{k}</a></div><div><a href=/x>{k}</a></div><div>{k}</div><div><a href=/b>{k}</a></div><div><a href=/c>{k}</a></div>", "ooooo"),
    ("<table><tr><td><a href=1>{k}</a></td><td><a href=2>{k}</a></td><td><a href=3>{k}</a></td></tr></table>", "ooo"),
    ("", ""),
]
AFTER = [
    ("<footer>&copy; 2020 {s} {s}</footer>", "o"),
    ("<footer><p>{l}</p><p>{l}</p></footer>", "oo"),
    ("<div class=footer>{l}</div>", "o"),
    ("<footer><p>" + _BAR + "</p><p><a href=/terms>{l}</a></p></footer>", "oo"),
    ("<div id=comments><p><a href=/u>{k}</a> {l}</p><p>{l} <a href=/u>{l}</a></p></div>", "oo"),
    ("<aside><h3>{h}</h3><p>{l}</p></aside>", "oo"),
    ("<aside><h3><a href=/r>{h}</a></h3><p><a href=/s>{l}</a></p></aside>", "oo"),
    ("<div class=sidebar><h2><a href=/r>{h}</a></h2><p>{s}</p></div><div class=promo><a href=/buy>{l}</a></div>", "ooo"),
    ("<nav><h2>{h}</h2><p><a href=/r>{l}</a></p></nav>", "oo"),
    ("<div class=related><h3>{h}</h3><ul><li><a href=/r>{h}</a></li><li><a href=/s>{k}</a></li></ul></div>", "ooo"),
    ("<div id=comments><h3>3 {k}</h3><div class=comment><p>{l}</p></div><div class=comment><p>{s}</p></div></div>", "ooo"),
    ("<form><fieldset><legend>{k}</legend><p>{l}</p></fieldset></form>", "oo"),
    ("<div class='newsletter'><p>{s}</p></div><footer>&middot; {k}</footer>", "oo"),
    ("<div class=widget><h4>{k}</h4><a href=/1>{k}</a><br><a href=/2>{h}</a></div><footer>{s}</footer>", "ooo"),
    ("", ""),
]
PLAIN_AFTER = [
    ("<p><a href=4>{k}</a></p><p><a href=5>{k}</a></p>", "oo"),
    ("<div><a href=/t>{k}</a></div><div><a href=/z>{k}</a></div><div>{k}</div><div><a href=/m>{h}</a></div><div><a href=/p>{k}</a></div>", "ooooo"),
    ("<ul><li><a href=/1>{h}</a></li><li><a href=/2>{k}</a></li><li><a href=/3>{h}</a></li></ul>", "ooo"),
    ("", ""),
]


def _filled(markup: str, r: random.Random) -> str:
    def text(m: re.Match) -> str:
        low, high = _TEXTS[m[0]]
        words = " ".join("a" * r.randint(1, 9) for _ in range(r.randint(low, high)))
        return words + (r.choice(".?!") if m[0] in ("{l}", "{s}") or r.random() < 0.2 else "")

    return re.sub(r"\{[lskh]\}", text, markup)


def labelled_pages(rounds: int = 4, seed: int = 1) -> Iterator[tuple[str, str]]:
    """Pages and their blocks' labels: every article part in every wrapper, among the other parts; the same each time."""
    r = random.Random(seed)
    for wrapper in WRAPPERS * rounds:
        for part, labels in ARTICLE_PARTS:
            more, more_labels = r.choice(ARTICLE_PARTS) if r.random() < 0.5 else ("", "")
            first, last, plain = [r.choice(BEFORE)], [r.choice(AFTER)], r.random() < 0.4
            if plain:
                first, last = [*first, r.choice(PLAIN_BEFORE)], [r.choice(PLAIN_AFTER), *last]
            page = "".join(p for p, _ in first) + wrapper.replace("{}", part + more) + "".join(p for p, _ in last)
            yield f"<html><body>{_filled(page, r)}</body></html>", "".join(x for _, x in first) + labels + more_labels + "".join(x for _, x in last)
    for text in ("<p>{s}</p>", "<div>{k}</div>", "{h}", "<p>{l}</p>", "<h1>{h}</h1>") * rounds:
        yield _filled(text, r), "m"
    for text, labels in (*PLAIN_BEFORE[:-1], *BEFORE[:2]) * rounds:
        yield _filled(text, r), labels
