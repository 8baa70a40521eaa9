"""The relational lane gives what the per-document evaluator gives, on documents and paths drawn at random."""

import random

import pytest

from arborel.corpus import Corpus
from arborel.plans import evaluate
from arborel.plans.relational import Paths, partitioned
from arborel.sources import read, xml

NAMES = ["hold", "deck", "rope"]
AXES = "child descendant descendant-or-self self parent ancestor ancestor-or-self following-sibling preceding-sibling following preceding".split()
TESTS = [*NAMES, *NAMES, "*", "node()", "text()", "comment()", "w:sail"]
PREDICATES = [
    "1", "2", "last()", "position() < 3", "position() = last()", "@n", "@n > 3", "not(@n)", "rope", "not(deck)", "count(rope) > 1", "count(.//hold) = 1", "contains(., '4')", "starts-with(., '1')",
    "string-length() > 3", ". = '7'", "rope = deck", "rope != deck", "deck < rope", "hold >= deck", "@n < rope/@n", "deck/@n = hold/@n", "string(rope) = '5'", "normalize-space(deck) != ''", "number(rope) + 1 > 4",
    "rope[2]/@n", "deck and @n", "hold or rope", "count(preceding-sibling::*) = 1", "local-name() = 'hold' and @k", "concat(rope, '-', deck) = '-'", "@k = 'x y'", "rope > 2 and not(hold)", "self::deck", "../@n", "following-sibling::rope = '3'",
]


def document(r, depth=0):
    """A random element as source: few names, numbers as text, attributes, comments, instructions and a namespace."""
    name = r.choice([*NAMES, "w:sail"]) if depth else "hold"
    attrs = (' xmlns:w="urn:w"' if not depth else "") + (f' n="{r.randint(0, 6)}"' if r.random() < 0.5 else "") + (' k="x y"' if r.random() < 0.2 else "") + (' w:n="2"' if depth and r.random() < 0.1 else "")
    inside = []
    for _ in range(r.randint(0, 4) if depth < 4 else 0):
        inside.append(document(r, depth + 1))
        inside.append(r.choice(["", "", str(r.randint(0, 30)), " deep ", "<!--log-->", "<?chart 4?>"]))
    if not inside and r.random() < 0.8:
        inside.append(r.choice(["3", "5", "7", "4e1", "-0.5", "none", " 7 ", "14"]))
    return f"<{name}{attrs}>{''.join(inside)}</{name}>"


def path(r):
    """A random absolute path of one to three steps with predicates."""
    steps = []
    for k in range(r.randint(1, 3)):
        axis = "" if k == 0 or r.random() < 0.4 else r.choice(AXES) + "::"
        step = axis + r.choice(NAMES + ["*"] if k == 0 else TESTS)
        steps.append(step + "".join(f"[{r.choice(PREDICATES)}]" for _ in range(r.choice([0, 0, 1, 1, 2]))))
    if r.random() < 0.2:
        steps.append("@" + r.choice(["n", "k", "*"]))
    out = r.choice(["//", "//", "//", "/hold/"]) + r.choice(["/", "/", "//"]).join(steps)
    return f"({out})[{r.choice(['1', 'last()', '3'])}]" if r.random() < 0.15 else out


SEED = random.Random(20)
DOCS = {k: document(SEED) for k in range(12)}
EXPRESSIONS = sorted({path(SEED) for _ in range(40)} | {f"//{n}[{p}]" for n, p in zip(NAMES * len(PREDICATES), PREDICATES)} | {"//hold | //rope/@n", "//processing-instruction()", "/hold"})


@pytest.fixture(scope="module")
def nodes(spark):
    df = spark.createDataFrame([(k, v) for k, v in DOCS.items()], "doc_id long, source string")
    return partitioned(read.parse_nodes(df, "source", "xml")).cache()


@pytest.mark.parametrize("expression", EXPRESSIONS)
def test_relational_equals_evaluator(nodes, expression):
    ns = {"w": "urn:w"}
    wanted = []
    for k, source in DOCS.items():
        for n in evaluate.query(xml.parse(source), expression, namespaces=ns):
            wanted.append((k, n.parent.pre if n.kind == 2 else n.pre, n.kind, n.name, n.text()))
    rows = Paths(nodes, ns).xpath(expression).collect()
    got = [(r.doc_id, r.pre, r.kind, r.name, r.value if r.value is not None else "") for r in rows if r.kind != 9]
    assert sorted(got) == sorted(w for w in wanted if w[2] != 9)


def test_axes_partition_the_document(nodes):
    p = Paths(nodes)
    size = {r.doc_id: r["count"] for r in nodes.groupBy("doc_id").count().collect()}
    counts = dict.fromkeys(size, 0)
    for axis in ("ancestor", "descendant", "following", "preceding", "self"):
        for r in p.xpath(f"(//*)[5]/{axis}::node()").groupBy("doc_id").count().collect():
            counts[r.doc_id] += r["count"]
    long_enough = {r.doc_id for r in p.xpath("(//*)[5]").collect()}
    assert long_enough and all(counts[k] == size[k] for k in long_enough)


def test_parsed_once_and_read_in_place(spark):
    df = spark.createDataFrame([(k, v) for k, v in DOCS.items()], "doc_id long, source string")
    p = Corpus(df, "source", "xml").paths(buckets=3)
    rows = p.xpath("//hold[rope]/deck/@n")
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan.split("Initial Plan")[0]


@pytest.mark.parametrize("n", [1, 100, 4095, 4096, 4097, 100_000])
def test_long_string_values(spark, n):
    source = f"<root><article>{'a' * (n // 2)}<b>{'b' * (n - n // 2)}</b>needle</article><article>short</article></root>"
    p = Corpus(spark.createDataFrame([(1, source)], "doc_id long, source string"), "source", "xml").paths()
    for expression in ("//article[contains(., 'needle')]", f"//article[string-length() = {n + 6}]", "/root[article != 'short']", "//*[substring-after(., 'b') != '']"):
        wanted = [(x.pre, x.text()) for x in evaluate.query(xml.parse(source), expression)]
        assert wanted and sorted((r.pre, r.value) for r in p.xpath(expression).collect()) == sorted(wanted), expression


def test_unread_string_values_are_not_derived(spark):
    p = Corpus(spark.createDataFrame([(1, "<r><a id='1'/></r>")], "doc_id long, source string"), "source", "xml").paths()
    assert "collect_list" not in p.xpath("//a/@id")._jdf.queryExecution().optimizedPlan().toString()
