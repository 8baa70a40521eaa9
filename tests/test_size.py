"""What holds at any size: how documents are dealt to tasks, what plans send to the driver, and results on odd rows."""

import pytest

from arborel.corpus import Corpus
from arborel.operators import nodeset
from arborel.plans.relational import stored


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many(spark):
    return Corpus(spark.range(50).selectExpr("id AS doc_id", "concat('<a><b>', id, '</b><c/></a>') AS source"), "source", "xml")


def test_joins_of_node_tables_send_nothing_to_the_driver(spark, many):
    """A small file may hold any number of nodes, so its size is no reason for a broadcast."""
    made, kept = many.nodes(), stored(many.nodes())
    for nodes in (made, kept):
        inner = nodes.where("level = 2")
        for found, n in ((nodeset.next_element(inner, nodes), 50), (nodeset.children(nodes.where("level = 1"), nodes), 100), (nodeset.parent(inner, nodes), 50)):
            assert "Broadcast" not in plan(found) and found.count() == n
    p = many.paths()
    for path in ("//b[following-sibling::c]", "//a[b = 'x' or c]/c", "//b[../c]"):
        assert "Broadcast" not in plan(p.xpath(path)) and p.xpath(path).count() == 50
    assert many.attributes(kept).count() == 0 and many.namespaces(kept).count() == 0


def test_documents_of_one_file_are_dealt_to_all_cores(spark, many, tmp_path):
    """A file of short rows may be one task, however many documents it holds."""
    many.df.coalesce(1).write.parquet(f"{tmp_path}/one")
    one = Corpus(spark.read.parquet(f"{tmp_path}/one"), "source", "xml")
    assert one.df.rdd.getNumPartitions() == 1
    found = one.extract(b="//b")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.b for r in found.collect()) == sorted(map(str, range(50)))
    kept = one.df.repartition(3, "doc_id")
    assert Corpus(kept, "source", "xml").extract(b="//b").rdd.getNumPartitions() == 3  # dealt on purpose, as by build


def test_sources_that_come_again_are_parsed_once_in_a_task(spark, tmp_path):
    from arborel.plans import evaluate, xpath

    ns = {"date": "http://exslt.org/dates-and-times", "math": "http://exslt.org/math", "dyn": "http://exslt.org/dynamic"}
    for expression, holds in (("date:year(//d)", True), ("count(//d[last()])", True), ("date:year()", False), ("//d[math:random() > 2]", False), ("dyn:evaluate('1')", False), ("own:f(1)", False)):
        assert evaluate.repeatable(xpath.parse(expression), ns) is holds, expression
    seen = spark.sparkContext.accumulator(0)

    def rows(i, d):
        seen.add(1)
        return [(i, d.root.text())]

    df = spark.range(400).selectExpr("id AS doc_id", "concat('<d>', id % 4, '</d>') AS source").repartition(2)
    from arborel.sources import read

    found = read.map_documents(df, "source", "xml", "doc_id long, text string", rows, repeatable=True).collect()
    assert sorted((r.doc_id, r.text) for r in found) == [(i, str(i % 4)) for i in range(400)] and seen.value <= 8


def test_parts_of_dates_are_found_once(spark):
    """Twenty parts of one date, however often they are asked for, take one reading of its text."""
    from arborel.functions import exslt
    from arborel.plans import evaluate
    from arborel.sources import xml

    ns = {"date": exslt.DATES, "set": exslt.SETS}
    doc = xml.parse("<o><d>2024-02-29T10:11:12</d><e/><e k='2'/><e k='1'/></o>")
    exslt.moment.cache_clear()
    context = evaluate.Context(doc, ns)
    ask = lambda e: evaluate.query(doc, e, context=context)
    assert [ask(f"date:{f}(//d)") for f in ("year", "month-name", "day-name", "day-in-year", "time", "day-abbreviation")] == [2024.0, "February", "Thursday", 60.0, "10:11:12", "Thu"]
    assert ask("date:add(//d, 'P1Y')") == "2025-02-28T10:11:12" and ask("date:date(//d)") == "2024-02-29"  # adding leaves the date as it was
    assert exslt.moment.cache_info().misses == 1 and len(context.found) == 1
    assert [a.value for a in ask("set:distinct(//e)/../e/@k")] == ["2", "1"]


def test_titles_cut_within_a_reference(spark, tmp_path):
    from arborel import queries

    pages = [(1, '<html lang="en"><title>a&amp;&lt;b&amp</title>'), (2, "<html><title>x &eacute; &copy y&#65</title>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: (r.title, r.lang) for r in queries.html_title_lang(spark, str(tmp_path)).collect()}
    assert found == {1: ("a&<b&amp", "en"), 2: ("x é &copy y&#65", "")}
    assert queries._pages(spark, str(tmp_path)).extract(t="//title").where("doc_id = 1").first().t == "a&<b&"  # as HTML reads it


def test_arithmetic_of_odd_numbers_equals_sql(spark, tmp_path):
    """Nulls, signed zeros, negative prices, prices at a multiple of seven, infinity and NaN."""
    from arborel import queries

    duckdb = pytest.importorskip("duckdb")
    nan, inf = float("nan"), float("inf")
    prices = [None, 0.0, -0.0, 0.3, -0.3, 3.5, -3.5, -7.0, 7.0, 6.999999999999999, 69999.99999999999, 1e300, inf, nan]
    rows = [(k, 1, q, p, d) for k, (q, p, d) in enumerate((q, p, d) for q in (None, 0.0, -5.0, 5.0, nan) for p in prices for d in (None, 0.0, -0.0, 0.1, -0.1, nan))]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(queries.SQL["xpath_arithmetic"]).fetchall()
    assert sorted(map(repr, (tuple(r) for r in queries.xpath_arithmetic(spark, str(tmp_path)).collect()))) == sorted(map(repr, want))


def test_comparisons_with_siblings_take_no_pair_of_them(spark):
    """Values of n siblings are found n times, not n * n / 2, and compare as the evaluator has it."""
    from arborel.plans import evaluate
    from arborel.sources import xml

    odd = "<r><o><p>1</p><p>x</p></o>t<q><p>2</p></q><o k='3'><p>2</p></o><o/><o k='1'><p/></o><!--c--><o k='2'><p>1</p><q>9</q></o><r><o><p>2</p></o><o><p>2</p></o></r></r>"
    wide = "<r>" + "".join(f"<o k='{i}'><p>{i % 7}</p></o>" for i in range(300)) + "</r>"
    docs = [(1, odd), (2, wide)]
    p = Corpus(spark.createDataFrame(docs, "doc_id long, source string"), "source", "xml").paths()
    for path in (
        "//o[p = preceding-sibling::o/p]", "//o[p = following-sibling::*/p]", "//*[preceding-sibling::o/p = p]", "//o[p < following-sibling::o/p]", "//o[following-sibling::o/p <= p]", "//o[p > preceding-sibling::q/p]",
        "//o[p != preceding-sibling::o/p]", "//o[p >= preceding-sibling::o/p]", "//p[.. = ../preceding-sibling::o]", "//o[q = following-sibling::o/q]", "//o[p = preceding-sibling::o]", "//o/@k[. = following-sibling::o/p]", "//o[@k = preceding-sibling::o/p]",
    ):
        got = sorted((r.doc_id, r.pre, r.value) for r in p.xpath(path).collect())
        assert got == sorted((i, n.pre, n.text()) for i, s in docs for n in evaluate.query(xml.parse(s), path)), path
    tree = p.xpath("//o[p = preceding-sibling::o/p]")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in tree.splitlines() if "Join Inner" in line and "<" in line]  # a join on places is one on pairs of siblings
