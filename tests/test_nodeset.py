"""Node sets, edits of the node table and SQL functions."""

import pytest
from pyspark.sql import functions as F

from arborel.functions.register import register
from arborel.model import node_rows
from arborel.operators import edit, nodeset
from arborel.plans.relational import partitioned
from arborel.sources import read, xml

SOURCE = "<r><a k='1'>x<b>y</b></a> <a k='2'/><c><a>z</a><!--n--></c></r>"


@pytest.fixture(scope="module")
def nodes(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, "<r> <a/> </r>")], "doc_id long, source string")
    return partitioned(read.parse_nodes(df, "source", "xml")).cache()


def names(df):
    return sorted((r.doc_id, r.pre, r.local) for r in df.collect())


def test_navigation_and_sets(nodes):
    a = nodes.where("local = 'a'")
    assert [x[2] for x in names(nodeset.parent(a, nodes))] == ["r", "c", "r"]
    assert [x[2] for x in names(nodeset.element_children(a, nodes))] == ["b"]
    assert len(names(nodeset.ancestors(nodes.where("local = 'b'"), nodes))) == 3
    assert [x[2] for x in names(nodeset.next_element(a, nodes))] == ["a", "c"]
    assert [x[2] for x in names(nodeset.previous_element(nodes.where("local = 'c'"), nodes))] == ["a"]
    assert nodeset.union(a, a).count() == 4 and nodeset.intersection(a, nodeset.first(a)).count() == 2
    assert nodeset.difference(a, nodeset.first(a)).count() == 2 and nodeset.at(a, -1).count() == 2
    assert {r.content for r in nodeset.string_value(nodes.where("local = 'r' and doc_id = 1"), nodes).collect()} == {"xy z"}
    assert a.where(nodeset.attribute("k") == "2").count() == 1


def test_paths(nodes):
    doc = xml.parse(SOURCE)
    want = {n.pre: edit.node_path(n) for n in doc.node.walk() if n.kind == 1}
    assert {r.pre: r.path for r in nodeset.paths(nodes).where("doc_id = 1").collect()} == want


def test_remove_renumbers_like_a_parser(nodes, spark):
    doc = xml.parse(SOURCE)
    for n in [n for n in doc.node.walk() if n.local == "b" or n.kind == 8]:
        n.unlink()
    columns = ["pre", "size", "level", "parent", "kind", "local", "sib", "esib"]
    all_columns = nodes.columns
    want = [tuple(r[all_columns.index(c)] for c in columns) for r in node_rows(1, doc.number())]
    gone = nodes.where((F.col("local") == "b") | nodeset.is_comment())
    got = nodeset.remove(nodes, gone).where("doc_id = 1").orderBy("pre").select(*columns).collect()
    assert [tuple(r) for r in got] == want


def test_strip_blanks(nodes):
    assert nodeset.strip_blanks(nodes).where("doc_id = 2 and kind = 3").count() == 0
    assert nodeset.strip_blanks(nodes).where("doc_id = 1 and kind = 3").count() == 3


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT html_query('<p>a<p>b', 'p') AS v").first().v == ["a", "b"]
    assert spark.sql("SELECT xml_query('<r><a/></r>', 'count(//a)') AS v").first().v == ["1"]
    assert spark.sql("SELECT count(*) AS n FROM markup_nodes('<r><a/></r>', 'xml')").first().n == 3
    assert spark.sql("SELECT resolve_uri('http://a/b/c', '../d') AS v").first().v == "http://a/d"
