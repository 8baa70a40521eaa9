"""Builder, metadata tables, reader accessors, handler functions and folds."""

import pytest

from arborel.corpus import Corpus
from arborel.operators.builder import Builder
from arborel.plans.evaluate import number
from arborel.sources import metadata


def test_builder():
    b = Builder()
    with b.tag("a:r", xmlns__a="u", id="1"):
        b.tag("x", "t", cls="c")
        b.comment("n").cdata("<").markup("<a:y/>")
    assert b.to_xml() == '<?xml version="1.0"?>\n<a:r xmlns:a="u" id="1"><x class="c">t</x><!--n--><![CDATA[<]]><a:y/></a:r>\n'
    with pytest.raises(ValueError):
        b.tag("q:z")


def test_metadata(spark):
    rows = {r.name: r for r in metadata.elements(spark).collect()}
    assert rows["br"].is_empty and rows["b"].is_inline and rows["p"].is_block and rows["font"].is_deprecated
    assert metadata.entity("copy") == 169 and metadata.references(spark).where("name = 'copy;'").first().value == "©"
    metadata.alias("mine", "latin-1")
    assert metadata.encoding("mine") == "iso8859-1" and metadata.encoding("no such") is None
    metadata.remove_alias("mine")
    assert metadata.encoding("mine") is None


def test_reader_functions_and_folds(spark):
    df = spark.createDataFrame([(1, '<r xml:lang="en" xmlns:p="u"><p:a k="1">x</p:a><b/></r>')], "doc_id long, source string")
    c = Corpus(df, "source", "xml")
    rows = c.reader().orderBy("seq").collect()
    assert [(r.node_type, r.depth, r.name) for r in rows] == [(1, 0, "r"), (1, 1, "p:a"), (3, 2, "#text"), (15, 1, "p:a"), (1, 1, "b"), (15, 0, "r")]
    assert rows[1].namespace_uri == "u" and rows[1].attributes == {"k": "1"} and rows[2].lang == "en" and rows[4].is_empty
    assert c.search("count(//*[big(@k)])", functions={"big": lambda context, node, v: number(v) > 0}).first().value == "1"
    assert c.fold("n int", lambda: 0, lambda s, n: s + (n.kind == 1), lambda s: (s,)).first().n == 3
