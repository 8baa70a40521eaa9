"""Heads of pages, declarations, push parsing, the reader's markup and axes over many context nodes."""

import random
import time

import pytest

from arborel.corpus import Corpus
from arborel.operators import edit, head, serialize
from arborel.plans import evaluate
from arborel.sources import html5, push, xml


def corpus(spark, source, kind="xml", **options):
    return Corpus(spark.createDataFrame([(7, source)], "doc_id long, source string"), "source", kind, **options)


def test_title_and_encoding():
    page = html5.parse("<title>Tide &amp; wind</title><meta charset=koi8-r><p>x")
    assert (head.title(page), head.meta_encoding(page)) == ("Tide & wind", "koi8-r")
    head.set_title(page, "Low <tide>")
    head.set_meta_encoding(page, "utf-8")
    assert "<title>Low &lt;tide&gt;</title><meta charset=\"utf-8\">" in serialize.to_html5(page)
    old = html5.parse('<meta http-equiv="content-type" content="text/html; charset=latin1"><p>x')
    assert head.title(old) is None and head.meta_encoding(old) == "latin1"
    head.set_title(old, "T")
    head.set_meta_encoding(old, "utf-8")
    assert [c.local for c in old.root.children[0].children] == ["meta", "title"] and head.meta_encoding(old) == "utf-8"
    bare = html5.parse("<!DOCTYPE html><p>x")
    head.set_title(bare, "T")
    head.set_meta_encoding(bare, "utf-8")
    assert serialize.to_html5(bare).startswith('<!DOCTYPE html><html><head><meta charset="utf-8"><title>T</title></head>')


def test_heads_and_hostile_pages_of_a_corpus(spark):
    deep = "<div>" * 600 + "core"
    df = spark.createDataFrame([(1, "<title>a</title><meta charset=utf-8>"), (2, None), (3, deep)], "doc_id long, html string")
    pages = Corpus(df, "html")
    assert {r.doc_id: (r.title, r.meta_encoding) for r in pages.heads().collect()} == {1: ("a", "utf-8"), 2: (None, None), 3: (None, None)}
    assert "document tree depth limit exceeded" in [r.message for r in pages.errors().where("doc_id = 3").collect()]
    assert pages.search("count(//div)").where("doc_id = 3").first().value == "600"
    assert Corpus(df, "html", max_errors=0).errors().count() == 0


def test_declarations(spark):
    dtd = """<!DOCTYPE log [<!ELEMENT log (ship+, (port | quay)?)><!ELEMENT ship (#PCDATA | b)*><!ELEMENT b EMPTY><!ATTLIST ship id ID #REQUIRED kind (brig | sloop) "brig">
    <!ENTITY sea "the sea"><!ENTITY chart SYSTEM "c.gif" NDATA gif><!NOTATION gif PUBLIC "-//gif">]><log/>"""
    rows = {(r.kind, r.owner, r.name): r for r in corpus(spark, dtd).declarations().collect()}
    assert rows["element", None, "log"].type == "(ship+ , (port | quay)?)" and rows["element", None, "ship"].type == "(#PCDATA | b)*" and rows["element", None, "b"].type == "EMPTY"
    assert rows["attribute", "ship", "id"].required and rows["attribute", "ship", "kind"].value == "brig"
    assert rows["entity", None, "sea"].value == "the sea" and rows["entity", None, "chart"].system_id == "c.gif" and rows["notation", None, "gif"].public_id == "-//gif"
    assert corpus(spark, "<a/>").declarations().count() == 0


def test_reader_markup(spark):
    rows = corpus(spark, "<a><b>x<c>y</c></b></a>").reader().where("node_type = 1").orderBy("seq").collect()
    assert [(r.name, r.outer_xml, r.inner_xml) for r in rows] == [("a", None, None), ("b", "<b>x<c>y</c></b>", "x<c>y</c>"), ("c", None, None)]
    every = corpus(spark, "<a><b>x<c>y</c></b></a>").reader(outer_depth=None).where("node_type = 1").orderBy("seq").collect()
    assert [r.inner_xml for r in every] == ["<b>x<c>y</c></b>", "x<c>y</c>", "y"]


def test_push_events_do_not_depend_on_the_cuts():
    source = '<?xml version="1.0" standalone="yes"?><!-- start --><log n="1"><ship>Aurora &amp; co</ship><![CDATA[a<b]]><?chart 4?></log>'.encode()

    def joined(events):
        out = []
        for event, name, value, attrs, *_ in events:
            if out and event in ("characters", "cdata_block") and out[-1][0] == event:
                out[-1] = (event, name, out[-1][2] + value, attrs)
            else:
                out.append((event, name, value, attrs))
        return out

    whole = joined(push.push([source]))
    assert [e[0] for e in whole] == "start_document xmldecl comment start_element start_element characters end_element cdata_block processing_instruction end_element end_document".split()
    r = random.Random(1)
    for _ in range(30):
        cuts = sorted(r.sample(range(1, len(source)), 6))
        assert joined(push.push([source[a:b] for a, b in zip([0, *cuts], [*cuts, len(source)])])) == whole
    parser = push.PushParser()
    assert [e[0] for e in parser.write(b"<a><b>")] == ["start_document", "start_element", "start_element"]
    broken = parser.write(b"</a>")
    assert [e[0] for e in broken] == ["error", "end_document"] and broken[0][4] == 1 and parser.finish() == []
    with pytest.raises(xml.XmlSyntaxError):
        list(push.push([b"<a>", b"</b>"], recover=False))


def test_axes_over_many_nodes_take_linear_time():
    doc = xml.parse("<r>" + "<a><b/>x</a>" * 4000 + "</r>")
    start = time.perf_counter()
    for expression, n in (("//a/following-sibling::a", 3999), ("//a/preceding-sibling::a", 3999), ("//b/following::b", 3999), ("//b/preceding::a", 3999), ("//*/descendant::b", 4000), ("//a[last()]/preceding::b[1]", 1)):
        assert len(evaluate.query(doc, expression)) == n, expression
    assert time.perf_counter() - start < 10


def test_places_after_edits():
    doc = xml.parse("<r><a/><b/><c/></r>")
    a, b, c = doc.root.children
    assert [x.index() for x in (c, a, b)] == [2, 0, 1]
    edit.remove(a)
    assert [x.index() for x in (b, c)] == [0, 1]
    edit.add(doc, c, "<d/>", "before")
    assert [x.index() for x in doc.root.children] == [0, 1, 2]
    with pytest.raises((ValueError, AttributeError)):
        a.index()
