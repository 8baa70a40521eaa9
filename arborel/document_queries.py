"""Registered queries that try one document operator after another on documents made from tables, with equivalent SQL.

The documents are built by column functions, so that SQL can say from the same
tables what each expression must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import Corpus, escape_text
from .functions import exslt
from .operators import edit, nodeset, serialize
from .operators import validate as V
from .plans import evaluate
from .plans.relational import stored
from .queries import QUERIES, SQL, _orders, _pages, query, table
from .sources import read
from .streaming import push_parse, shared_path
from .tree import Document

# -- documents -----------------------------------------------------------
_NS = {"c": "urn:c", "d": "urn:d"}


def _customers(spark, sf_dir, kind: str = "xml") -> Corpus:
    """A document for each customer with a node of every kind."""
    c = table(spark, sf_dir, "customer")
    key, seg, name = F.col("c_custkey").cast("string"), F.col("c_mktsegment"), escape_text(F.col("c_name"))
    source = F.concat(
        F.lit('<?xml version="1.0"?><!--'), seg, F.lit('--><c:customer xmlns:c="urn:c" xmlns="urn:d" xml:lang="en-GB" key="'), key, F.lit('"><?seg '), seg, F.lit("?><name>"), name,
        F.lit('</name><c:bal unit="eur">'), F.floor("c_acctbal").cast("string"), F.lit("</c:bal><note xml:lang=\"de\"><![CDATA[<"), seg, F.lit(">]]> &amp; &#65;</note><empty/></c:customer>"),
    )
    return Corpus(c.select("c_custkey", source.alias("source")), "source", kind, "c_custkey")


def _expressions(name: str, corpus, key: str, from_: str, columns: dict[str, tuple[str, str]], namespaces=None, variables=None) -> None:
    """Register a query that takes the string of an expression for each column, and its SQL: column -> (expression, SQL)."""

    def run(spark, sf_dir):
        out = corpus(spark, sf_dir).extract(namespaces, variables, **{c: e for c, (e, _) in columns.items()})
        return out.withColumnRenamed("doc_id", key)

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"SELECT {key}, {', '.join(f'({sql})::VARCHAR AS {c}' for c, (_, sql) in columns.items())} {from_}"


_BY_CUSTOMER = "FROM (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice)::BIGINT ELSE 0 END) AS f_total, sum((o_orderstatus = 'F')::INT) AS f, sum((o_orderstatus = 'O')::INT) AS o, list(floor(o_totalprice)::BIGINT ORDER BY o_orderkey) AS t, list(o_orderstatus ORDER BY o_orderkey) AS s, list(o_orderpriority ORDER BY o_orderkey) AS p, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY o_custkey)"

_expressions(
    "xpath_axes", _orders, "o_custkey", _BY_CUSTOMER,
    {
        "child": ("count(/child::orders/child::order)", "n"), "descendant": ("count(/descendant::*)", "3 * n + 1"), "descendant_or_self": ("count(/orders/descendant-or-self::*)", "3 * n + 1"),
        "parent": ("count(//total/..)", "n"), "ancestor": ("count(//total/ancestor::*)", "n + 1"), "ancestor_or_self": ("count(//total/ancestor-or-self::*)", "2 * n + 1"),
        "following_sibling": ("count(//order[1]/following-sibling::order)", "n - 1"), "preceding_sibling": ("count(//order[last()]/preceding-sibling::*)", "n - 1"),
        "following": ("count(//order[1]/following::*)", "3 * (n - 1)"), "preceding": ("count(//order[last()]/preceding::*)", "3 * (n - 1)"), "self": ("count(//*/self::total)", "n"), "attribute": ("count(//@*)", "2 * n"),
        "namespace": ("count(/orders/namespace::*)", "1"), "every_node": ("count(//node())", "5 * n + 1"), "texts": ("count(//text())", "2 * n"), "reverse_place": ("string(//order[last()]/preceding-sibling::order[1]/@key)", "coalesce(k[-2]::VARCHAR, '')"),
    },
)

_expressions(
    "xpath_expressions", _orders, "o_custkey", _BY_CUSTOMER,
    {
        "either": ("count(//order[@status = 'F' or @status = 'O'])", "f + o"), "both_hold": ("count(//order[@status = 'F' and total > 0])", "f"), "negated": ("count(//order[not(@status = 'F')])", "n - f"),
        "set_equal": ("string(//total = 0)", "list_contains(t, 0)"), "set_unequal": ("string(//@status != //@status)", "len(list_distinct(s)) > 1"), "set_less": ("string(//total < 50000)", "list_min(t) < 50000"),
        "set_at_least": ("string(//total >= 300000)", "list_max(t) >= 300000"), "joined": ("count(//total | //priority | //total)", "2 * n"), "negative": ("string(-sum(//total))", "-list_sum(t)"),
        "arithmetic": ("string((count(//order) * 7 - 3) mod 5)", "(n * 7 - 3) % 5"), "half": ("string(count(//order) div 2)", "CASE WHEN n % 2 = 0 THEN (n // 2)::VARCHAR ELSE (n / 2.0)::DOUBLE::VARCHAR END"),
        "truth": ("string(boolean(//order[@status = 'P']))", "n - f - o > 0"), "number_of_text": ("string(number('x'))", "'NaN'"), "number_of_true": ("string(number(true()))", "1"), "empty_set": ("string(//nothing)", "''"),
        "wild": ("count(/*/*/*)", "2 * n"), "filtered": ("string((//order)[2]/@key)", "coalesce(k[2]::VARCHAR, '')"), "last_three": ("count(//order[position() > last() - 3])", "least(n, 3)"), "variable": ("count(//order[total > $least])", "len(list_filter(t, lambda x: x > 100000))"),
        "first_cast": ("string(//priority)", "p[1]"), "name_of_first": ("name(//@*)", "'key'"), "set_sum": ("string(sum(//order[@status = 'F']/total))", "f_total"),
    },
    variables={"least": 100000.0},
)

_SEG, _NAME, _BAL = "c_mktsegment", "c_name", "floor(c_acctbal)::BIGINT"
_expressions(
    "xpath_nodes_and_names", _customers, "c_custkey", "FROM customer",
    {
        "comment": ("string(/comment())", _SEG), "instruction": ("string(//processing-instruction('seg'))", _SEG), "no_instruction": ("count(//processing-instruction('other'))", "0"), "cdata": ("string(//d:note)", f"'<' || {_SEG} || '> & A'"),
        "whole": ("string(/)", f"{_NAME} || {_BAL} || '<' || {_SEG} || '> & A'"), "qualified": ("name(//c:bal)", "'c:bal'"), "local": ("local-name(/*)", "'customer'"), "uri": ("namespace-uri(//d:name)", "'urn:d'"), "no_uri": ("namespace-uri(//@key)", "''"),
        "of_prefix": ("count(//c:*)", "2"), "of_default": ("count(//d:*)", "3"), "any_prefix": ("count(//*:bal)", "1"), "english": ("count(//*[lang('en')])", "4"), "german": ("count(//*[lang('de')])", "1"), "unbound": ("count(//name)", "0"),
        "scopes": ("count(//d:empty/namespace::*)", "3"), "attribute_of_ns": ("count(//@xml:lang)", "2"), "balance": ("number(//c:bal) + 1", f"{_BAL} + 1"), "unit": ("string(//c:bal/@unit)", "'eur'"),
        "without_children": ("count(//*[not(node())])", "1"), "doc_order": ("local-name((//d:empty | //d:name | //c:bal)[2])", "'bal'"), "test": ("string(//d:name/text())", _NAME), "length": ("string-length(//d:name)", f"length({_NAME})"),
    },
    namespaces=_NS | {"xml": "http://www.w3.org/XML/1998/namespace"},
)

_expressions(
    "xpath_string_functions", _customers, "c_custkey", "FROM customer",
    {
        "concat": ("concat(//d:name, '/', //c:bal, '/', true())", f"{_NAME} || '/' || {_BAL} || '/true'"), "starts": ("string(starts-with(//d:name, 'Customer'))", f"starts_with({_NAME}, 'Customer')"), "has": ("string(contains(//d:name, '7'))", f"contains({_NAME}, '7')"),
        "before": ("substring-before(//d:name, '#')", f"split_part({_NAME}, '#', 1)"), "after": ("substring-after(//d:name, '#')", f"split_part({_NAME}, '#', 2)"), "part": ("substring(//d:name, 10.4, 3.2)", f"substr({_NAME}, 10, 3)"), "rest": ("substring(//d:name, 10)", f"substr({_NAME}, 10)"),
        "translated": ("translate(//comment(), 'ABCDEI', 'abcde')", f"translate({_SEG}, 'ABCDEI', 'abcde')"), "normal": ("normalize-space(concat('  ', //comment(), '   x  '))", f"{_SEG} || ' x'"),
        "rounded": ("string(round(//c:bal div 100))", "floor(floor(c_acctbal) / 100 + 0.5)::BIGINT"), "floored": ("string(floor(//c:bal div 100))", "floor(floor(c_acctbal) / 100)::BIGINT"), "ceiled": ("string(ceiling(//c:bal div 100))", "ceil(floor(c_acctbal) / 100)::BIGINT"),
    },
    namespaces=_NS,
)

_EXSLT = {"math": exslt.MATH, "set": exslt.SETS, "str": exslt.STRINGS, "date": exslt.DATES, "exsl": exslt.COMMON, "dyn": exslt.DYNAMIC}
_expressions(
    "exslt_sets_and_numbers", _orders, "o_custkey", _BY_CUSTOMER,
    {
        "lowest": ("count(math:lowest(//total))", "len(list_filter(t, lambda x: x = list_min(t)))"), "highest": ("count(math:highest(//total))", "len(list_filter(t, lambda x: x = list_max(t)))"), "most": ("string(math:max(//total))", "list_max(t)"), "least": ("string(math:min(//total))", "list_min(t)"),
        "magnitude": ("string(math:abs(-sum(//total)))", "list_sum(t)"), "root": ("string(round(math:sqrt(count(//order)) * 1000))", "floor(sqrt(n) * 1000 + 0.5)::BIGINT"), "power": ("string(math:power(count(//order), 3))", "n * n * n"), "log": ("string(round(math:log(count(//order)) * 1000))", "floor(ln(n) * 1000 + 0.5)::BIGINT"),
        "sine": ("string(round(math:sin(count(//order)) * 1000 + 5000))", "floor(sin(n) * 1000 + 5000.5)::BIGINT"), "angle": ("string(round(math:atan2(count(//order), 3) * 1000))", "floor(atan2(n, 3) * 1000 + 0.5)::BIGINT"), "pi": ("string(math:constant('PI', 5))", "'3.14159'"),
        "kinds": ("count(set:distinct(//@status))", "len(list_distinct(s))"), "leading": ("count(set:leading(//order, //order[3]))", "CASE WHEN n >= 3 THEN 2 ELSE n END"), "trailing": ("count(set:trailing(//order, //order[2]))", "CASE WHEN n >= 2 THEN n - 2 ELSE n END"),
        "shared": ("string(set:has-same-node(//order[@status = 'F'], //order[1]))", "s[1] = 'F'"), "outside": ("count(set:difference(//order, //order[@status = 'F']))", "n - f"), "inside": ("count(set:intersection(//order, //order[@status = 'F']))", "f"),
        "kind": ("exsl:object-type(//order)", "'node-set'"), "dynamic": ("string(dyn:evaluate('count(//order) + 1'))", "n + 1"), "mapped": ("count(dyn:map(//order, '@key'))", "n"), "glued": ("str:concat(//@status)", "array_to_string(s, '')"),
        "pieces": ("count(str:tokenize(string(//priority), '-'))", "2"), "split": ("string(str:split(string(//priority), '-')[1])", "split_part(p[1], '-', 1)"), "replaced": ("str:replace(string(//priority), '-', '+')", "replace(p[1], '-', '+')"),
        "padded": ("str:padding(count(//order) mod 7, 'ab')", "substr(repeat('ab', 7), 1, (n % 7)::INT)"), "aligned": ("str:align(string(//@key), '..........', 'right')", "lpad(k[1]::VARCHAR, 10, '.')"), "encoded": ("str:encode-uri(string(//priority), true())", "url_encode(p[1])"),
        "decoded": ("str:decode-uri('a%20b%2F')", "'a b/'"),
    },
    namespaces=_EXSLT,
)


def _dated(spark, sf_dir) -> Corpus:
    o = table(spark, sf_dir, "orders")
    source = F.concat(F.lit("<o><d>"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("</d></o>"))
    return Corpus(o.select("o_orderkey", source.alias("source")), "source", "xml", "o_orderkey")


_D = "o_orderdate"
_expressions(
    "exslt_dates", _dated, "o_orderkey", "FROM orders",
    {
        "y": ("string(date:year(//d))", f"year({_D})"), "leap": ("string(date:leap-year(//d))", f"(year({_D}) % 4 = 0 AND year({_D}) % 100 <> 0) OR year({_D}) % 400 = 0"), "month": ("string(date:month-in-year(//d))", f"month({_D})"),
        "month_name": ("date:month-name(//d)", f"monthname({_D})"), "month_short": ("date:month-abbreviation(//d)", f"substr(monthname({_D}), 1, 3)"), "week": ("string(date:week-in-year(//d))", f"weekofyear({_D})"), "doy": ("string(date:day-in-year(//d))", f"dayofyear({_D})"),
        "dom": ("string(date:day-in-month(//d))", f"day({_D})"), "dow_in_month": ("string(date:day-of-week-in-month(//d))", f"(day({_D}) - 1) // 7 + 1"), "dow": ("string(date:day-in-week(//d))", f"dayofweek({_D}) + 1"), "day_name": ("date:day-name(//d)", f"dayname({_D})"),
        "day_short": ("date:day-abbreviation(//d)", f"substr(dayname({_D}), 1, 3)"), "hour": ("string(date:hour-in-day(//d))", f"hour({_D})"), "minute": ("string(date:minute-in-hour(//d))", f"minute({_D})"), "second": ("string(date:second-in-minute(//d))", f"second({_D})"),
        "day": ("date:date(//d)", f"strftime({_D}, '%Y-%m-%d')"), "time": ("date:time(//d)", f"strftime({_D}, '%H:%M:%S')"), "later": ("date:date(date:add(//d, 'P40D'))", f"strftime({_D} + INTERVAL 40 DAY, '%Y-%m-%d')"), "next_month": ("date:date(date:add(//d, 'P1M'))", f"strftime({_D} + INTERVAL 1 MONTH, '%Y-%m-%d')"),
        "since": ("date:difference('1970-01-01', date:date(//d))", f"'P' || date_diff('day', DATE '1970-01-01', {_D}::DATE) || 'D'"), "seconds": ("string(date:seconds(date:date(//d)) div 86400)", f"date_diff('day', DATE '1970-01-01', {_D}::DATE)"), "both": ("date:add-duration('P1D', 'PT36H')", "'P2DT12H'"),
        "length": ("date:duration(90061)", "'P1DT1H1M1S'"), "sum": ("date:sum(//none)", "''"),
    },
    namespaces=_EXSLT,
)

# -- selectors -----------------------------------------------------------
_CSS = {
    "items": ("li", "m"), "child": ("nav > ul > li", "m"), "deep": ("nav li a", "m"), "adjacent": ("li + li", "greatest(m - 1, 0)"), "later": ("li ~ li", "greatest(m - 1, 0)"), "first": ("li:first-child", "least(m, 1)"), "last": ("li:last-child", "least(m, 1)"),
    "only": ("li:only-child", "(m = 1)::INT"), "odd": ("li:nth-child(odd)", "(m + 1) // 2"), "third": ("li:nth-child(3n)", "m // 3"), "from_end": ("li:nth-last-child(2)", "(m >= 2)::INT"), "first_of": ("ul > li:first-of-type", "least(m, 1)"), "last_of": ("ul > li:last-of-type", "least(m, 1)"),
    "nth_of": ("li:nth-of-type(2)", "(m >= 2)::INT"), "negated": ("li:not(:first-child)", "greatest(m - 1, 0)"), "holding": ("li:has(a)", "m"), "links_up": ("a[href^='/']", "m"), "any_href": ("a[href]", "m"), "charset": ("meta[charset=utf-8]", "1"), "not_lang": ("html:not([lang])", "0"),
    "ads": ("div.ad", "len(regexp_extract_all(html, '<div class=\"ad\">'))"), "class_word": ("[class~=ad]", "len(regexp_extract_all(html, '<div class=\"ad\">'))"), "either": ("h1, title", "len(regexp_extract_all(html, '<h1>')) + 1"), "beyond": ("li:gt(1)", "greatest(m - 1, 0)"), "at": ("li:eq(1)", "least(m, 1)"),
    "root": (":root", "1"), "empty_items": ("li:empty", "0"), "attribute": ("nav a > @href", "m"), "lang_prefix": ("html[lang|=en]", "(regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) = 'en')::INT"), "contains": ("title:contains('the')", "contains(regexp_extract(html, '<title>([^<]*)</title>', 1), 'the')::INT"),
    "comments": ("//comment()", "len(regexp_extract_all(html, '<!--.*?-->'))"),
}


@query("SELECT page_id, " + ", ".join(f"({sql})::BIGINT AS {n}" for n, (_, sql) in _CSS.items()) + " FROM (SELECT page_id, html, len(regexp_extract_all(html, '<li>'))::BIGINT AS m FROM pages)")
def css_selectors(spark, sf_dir):
    return _pages(spark, sf_dir).count(**{n: s for n, (s, _) in _CSS.items()}).withColumnRenamed("doc_id", "page_id")


@query("SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS items, len(regexp_extract_all(html, '<a '))::BIGINT AS links, len(regexp_extract_all(html, '<div class=\"ad\">'))::BIGINT AS ads, 1::BIGINT AS titles FROM pages")
def html4_counts(spark, sf_dir):
    """The pages by the older parser."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return Corpus(pages, "html", "html4", "page_id").count(items="//li", links="//a", ads="//div[@class='ad']", titles="//head/title").withColumnRenamed("doc_id", "page_id")


# -- transformations -----------------------------------------------------
_XSLT = """<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform" xmlns:x="urn:x" exclude-result-prefixes="x"><xsl:output omit-xml-declaration="yes"/><xsl:strip-space elements="*"/>
<xsl:include href="more.xsl"/><xsl:param name="limit" select="0"/><xsl:variable name="many" select="count(//order)"/><xsl:attribute-set name="a"><xsl:attribute name="n"><xsl:value-of select="$many"/></xsl:attribute></xsl:attribute-set>
<xsl:template match="/orders"><xsl:element name="out" use-attribute-sets="a"><xsl:comment>made</xsl:comment><xsl:apply-templates select="order[position() &lt; 3]"><xsl:with-param name="tag" select="'T'"/></xsl:apply-templates>
<xsl:apply-templates select="order[1]" mode="short"/><xsl:call-template name="end"><xsl:with-param name="by" select="$limit"/></xsl:call-template></xsl:element></xsl:template>
<xsl:template match="order"><xsl:param name="tag"/><o k="{@key}" t="{$tag}"><xsl:number/><xsl:choose><xsl:when test="@status = 'F'">f</xsl:when><xsl:when test="@status = 'O'">o</xsl:when><xsl:otherwise>p</xsl:otherwise></xsl:choose>
<xsl:if test="total &gt; 100000">!</xsl:if></o></xsl:template><xsl:template match="order" mode="short"><xsl:copy-of select="priority"/><xsl:copy><xsl:value-of select="format-number(total, '#,##0.00')"/></xsl:copy><xsl:processing-instruction name="pi">x</xsl:processing-instruction></xsl:template></xsl:stylesheet>"""
_MORE = """<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:template name="end"><xsl:param name="by"/><end by="{$by}"><xsl:for-each select="//@status"><xsl:sort select="." order="descending"/><xsl:if test="position() = 1"><xsl:value-of select="."/></xsl:if></xsl:for-each></end></xsl:template></xsl:stylesheet>"""
_SQL_ORDER = "'<o k=\"' || k[{0}] || '\" t=\"T\">{0}' || lower(s[{0}]) || CASE WHEN t[{0}] > 100000 THEN '!' ELSE '' END || '</o>'"


@query(f"""SELECT o_custkey, '<out n="' || n || '"><!--made-->' || {_SQL_ORDER.format(1)} || CASE WHEN n > 1 THEN {_SQL_ORDER.format(2)} ELSE '' END || '<priority>' || p[1] || '</priority><order>' || format('{{:,}}', t[1]) || '.00</order><?pi x?>'
|| '<end by="9">' || list_max(s) || '</end></out>' AS source {_BY_CUSTOMER}""")
def xslt_instructions(spark, sf_dir):
    out = _orders(spark, sf_dir).transform(_XSLT, {"limit": 9.0}, {"more.xsl": _MORE})
    return out.select(F.col("doc_id").alias("o_custkey"), F.regexp_replace("source", "\n$", "").alias("source"))


def _change(doc: Document) -> None:
    """Edits of every sort on the first orders of a document."""
    orders = [n for n in doc.root.children if n.local == "order"]
    doc.root.set("n", str(len(orders)))
    first = orders[0]
    for n in orders[1:]:
        edit.remove(n)
    total, priority = first.children
    edit.set_content(total, "a<b")
    edit.rename(priority, "rank")
    edit.add_tokens(first, "x y x")
    edit.remove_tokens(first, "y")
    edit.remove_attribute(first, "status")
    edit.add(doc, first, "<before/>", "before")
    edit.add(doc, first, "after<z/>", "after")
    edit.add(doc, first, "<head/>", "first")
    edit.add(doc, first, "tail", "last")
    edit.wrap(doc, total, "<w><v/></w>")
    edit.replace(doc, priority, "<new/>")


@query(f"""SELECT o_custkey, '<orders n="' || n || '"><before/><order key="' || k[1] || '" class="x x"><head/><w><v><total>a&lt;b</total></v></w><new/>tail</order>after<z/></orders>' AS source {_BY_CUSTOMER}""")
def edit_documents(spark, sf_dir):
    out = _orders(spark, sf_dir).edit(_change)
    return out.select(F.col("doc_id").alias("o_custkey"), F.regexp_extract("source", r"(?s)(<orders.*</orders>)", 1).alias("source"))


@query("SELECT n_nationkey, '<nation><name>' || n_name || '</name><region>' || r_name || '</region>#' || r_name || '#none</nation>' AS source FROM nation JOIN region ON n_regionkey = r_regionkey")
def xinclude_documents(spark, sf_dir):
    """Includes of XML and text by URI, and a fallback; the resources are a table of bounded size."""
    regions = {r.r_regionkey: r.r_name for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").limit(1000).collect()}
    resources = {f"{k}.xml": f"<region>{v}</region>" for k, v in regions.items()} | {f"{k}.txt": f"#{v}" for k, v in regions.items()}
    key = F.col("n_regionkey").cast("string")
    source = F.concat(
        F.lit('<nation xmlns:i="http://www.w3.org/2001/XInclude"><name>'), F.col("n_name"), F.lit('</name><i:include href="'), key, F.lit('.xml"/><i:include parse="text" href="'), key,
        F.lit('.txt"/><i:include href="no.xml"><i:fallback>#none</i:fallback></i:include></nation>'),
    )
    out = Corpus(table(spark, sf_dir, "nation").select("n_nationkey", source.alias("source")), "source", "xml", "n_nationkey").include(resources)
    plain = F.regexp_replace(F.regexp_extract("source", r"(?s)(<nation.*</nation>)", 1), r' xml:base="[^"]*"| xmlns:i="[^"]*"', "")
    return out.select(F.col("doc_id").cast("int").alias("n_nationkey"), plain.alias("source"))


# -- writing -------------------------------------------------------------
def _fragments(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    markup = F.concat(F.lit('<P class="x">'), escape_text(F.col("c_name")), F.lit(" &amp; &eacute;<BR><input value=1>"), F.col("c_mktsegment"))
    return c.select("c_custkey", markup.alias("html"))


_WRITTEN = {
    "html": lambda d: evaluate_html(d, "html"), "xhtml": lambda d: evaluate_html(d, "xhtml"), "html5": lambda d: evaluate_html(d, "html5"),
}


def evaluate_html(doc: Document, how: str) -> str:
    from .operators import serialize as S

    node = evaluate.query(doc, "//p")[0]
    return S.to_html5(node) if how == "html5" else S.to_html(node, xhtml=how == "xhtml")


@query("""SELECT c_custkey, '<p class="x">' || c_name || ' &amp; é<br><input value="1">' || c_mktsegment || '</p>' AS html, '<p class="x">' || c_name || ' &amp; é<br /><input value="1" />' || c_mktsegment || '</p>' AS xhtml,
'<p class="x">' || c_name || ' &amp; é<br><input value="1">' || c_mktsegment || '</p>' AS html5 FROM customer""")
def write_markup(spark, sf_dir):
    """An element as HTML, XHTML and HTML 5."""

    def rows(i, d):
        return [(i, *(f(d) for f in _WRITTEN.values()))]

    return read.map_documents(_fragments(spark, sf_dir), "html", "html5", "c_custkey long, html string, xhtml string, html5 string", rows, "c_custkey")


@query(f"""SELECT c_custkey, '<c:customer xmlns:c="urn:c" xmlns="urn:d" key="' || c_custkey || '" xml:lang="en-GB"><?seg ' || {_SEG} || '?><name>' || {_NAME} || '</name><c:bal unit="eur">' || {_BAL} || '</c:bal><note xml:lang="de">&lt;' || {_SEG} || '&gt; &amp; A</note><empty></empty></c:customer>' AS plain,
'<!--' || {_SEG} || '-->' AS comment FROM customer""")
def canonical_forms(spark, sf_dir):
    """Canonical XML without comments, and the comment that stands before the document element with them, of one parse."""

    def rows(i, d):
        return [(i, serialize.canonical(d), serialize.canonical(d, comments=True))]

    out = read.map_documents(_customers(spark, sf_dir).df, "source", "xml", "c_custkey long, plain string, full string", rows, "c_custkey")
    plain = F.regexp_replace("plain", ' xmlns="urn:d" xmlns:c="urn:c"', ' xmlns:c="urn:c" xmlns="urn:d"')
    return out.select("c_custkey", plain.alias("plain"), F.regexp_extract("full", "^(<!--.*?-->)", 1).alias("comment"))


# -- tables of a corpus --------------------------------------------------
@query("SELECT kind, count(*)::BIGINT AS n FROM (SELECT unnest(['start_document', 'comment', 'start_element', 'start_element', 'start_element', 'start_element', 'start_element', 'processing_instruction', 'characters', 'characters', 'cdata_block', 'characters', 'end_element', 'end_element', 'end_element', 'end_element', 'end_element', 'end_document']) AS kind FROM customer) GROUP BY kind")
def sax_events(spark, sf_dir):
    return _customers(spark, sf_dir).events().groupBy(F.col("event").alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey, 'c:bal' AS name, 'bal' AS local_name, 'c' AS prefix, 'urn:c' AS namespace_uri, 1 AS depth, 1 AS attribute_count, 'en-GB' AS lang, {_BAL}::VARCHAR AS inner_xml FROM customer")
def reader_rows(spark, sf_dir):
    r = _customers(spark, sf_dir).reader().where("node_type = 1 and local_name = 'bal'")
    return r.select(F.col("doc_id").alias("c_custkey"), "name", "local_name", "prefix", "namespace_uri", "depth", "attribute_count", "lang", "inner_xml")


@query("SELECT 'attribute' AS what, 4 * count(*) AS n FROM customer UNION ALL SELECT 'namespace', 2 * count(*) FROM customer UNION ALL SELECT 'document', count(*) FROM customer UNION ALL SELECT 'element', 5 * count(*) FROM customer UNION ALL SELECT 'child of the element', 5 * count(*) FROM customer UNION ALL SELECT 'next element', 3 * count(*) FROM customer UNION ALL SELECT 'parent', count(*) FROM customer UNION ALL SELECT 'first', count(*) FROM customer")
def node_tables(spark, sf_dir):
    """Rows of the relational form, which is written once, and of navigation by joins over it."""
    c = _customers(spark, sf_dir)
    nodes = stored(c.nodes())
    elements = nodes.where(nodeset.is_element())
    root, inner = elements.where("level = 1"), elements.where("level = 2")
    parts = {
        "attribute": c.attributes(nodes), "namespace": c.namespaces(nodes), "document": c.documents(), "element": elements, "child of the element": nodeset.children(root, nodes), "next element": nodeset.next_element(inner, nodes),
        "parent": nodeset.parent(inner, nodes).select("doc_id", "pre").distinct(), "first": nodeset.first(inner),
    }
    counted = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, d in parts.items()]
    out = counted[0]
    for d in counted[1:]:
        out = out.unionByName(d)
    return out


@query("SELECT o_custkey, '/orders/order' || CASE WHEN n > 1 THEN '[' || n || ']' ELSE '' END || '/total' AS path, 'orders > order' || CASE WHEN n > 1 THEN ':nth-of-type(' || n || ')' ELSE '' END || ' > total' AS css, k[-1] AS at " + _BY_CUSTOMER)
def node_paths(spark, sf_dir):
    """The paths of the last total, and the node that a pointer to its parent finds."""

    def rows(i, d):
        node = evaluate.query(d, "(//total)[last()]")[0]
        here = edit.pointer(d, f"element(/1/{len(d.root.children)})")[0]
        return [(i, edit.node_path(node), edit.css_path(node), int(here.get("key")))]

    c = _orders(spark, sf_dir)
    return read.map_documents(c.df, "source", "xml", "o_custkey long, path string, css string, at long", rows, "o_custkey")


# -- parsing -------------------------------------------------------------
@query("SELECT c_custkey, c_name || 'é' AS latin, c_name || 'é' AS wide, c_name || 'é' AS meta, c_name AS entity, 'v' AS given, true AS bad, c_name || 'text' AS mended, 2::BIGINT AS parts FROM customer")
def parse_sources(spark, sf_dir):
    """Encodings, entities and defaults of a document type, broken markup and fragments."""
    c = table(spark, sf_dir, "customer").select("c_custkey", escape_text(F.col("c_name")).alias("n"))

    def parsed(source: Column, kind: str, **what: str) -> DataFrame:
        return Corpus(c.select("c_custkey", source.alias("source")), "source", kind, "c_custkey").extract(**what).withColumnRenamed("doc_id", "c_custkey")

    latin = parsed(F.encode(F.concat(F.lit('<?xml version="1.0" encoding="ISO-8859-1"?><a>'), F.col("n"), F.lit("é</a>")), "ISO-8859-1"), "xml", latin="string(/)")
    wide = parsed(F.encode(F.concat(F.lit("<a>"), F.col("n"), F.lit("é</a>")), "UTF-16"), "xml", wide="string(/)")
    meta = parsed(F.encode(F.concat(F.lit('<meta charset="iso-8859-1"><p>'), F.col("n"), F.lit("é")), "ISO-8859-1"), "html5", meta="string(//p)")
    typed = parsed(F.concat(F.lit('<!DOCTYPE a [<!ENTITY e "'), F.col("n"), F.lit('"><!ATTLIST a k CDATA "v">]><a>&e;</a>')), "xml", entity="string(/)", given="string(/a/@k)")
    broken = Corpus(c.select("c_custkey", F.concat(F.lit("<a><b>"), F.col("n"), F.lit("</a>text")).alias("source")), "source", "auto", "c_custkey")
    bad = broken.documents().select(F.col("doc_id").alias("c_custkey"), (F.size("errors") > 0).alias("bad"))
    mended = parsed(F.concat(F.lit("<a><b>"), F.col("n"), F.lit("</b>text")), "xml", mended="string(/)")
    parts = Corpus(c.select("c_custkey", F.concat(F.lit("<td>"), F.col("n"), F.lit("<td>x")).alias("source")), "source", "html_fragment", "c_custkey", context="tr").count(parts="./*").withColumnRenamed("doc_id", "c_custkey")
    out = latin
    for d in (wide, meta, typed, bad, mended, parts):
        out = out.join(d, "c_custkey")
    return out


@query("SELECT c_custkey, floor(c_acctbal)::BIGINT::VARCHAR AS value FROM customer")
def push_parse_stream(spark, sf_dir):
    """Documents that arrive as a stream of chunks, in any order."""
    c = read.dealt(_customers(spark, sf_dir).df)
    place = shared_path(spark, "chunks")
    pieces = F.array(*[F.struct(F.lit(k).cast("long").alias("seq"), F.substring("source", 1 + 90 * k, 90 if k < 3 else 100_000).alias("chunk"), F.lit(k == 3).alias("last")) for k in (2, 0, 3, 1)])
    c.select(F.col("c_custkey").cast("long").alias("doc_id"), F.inline(pieces)).write.parquet(f"{place}/in")
    chunks = spark.readStream.schema("doc_id long, seq long, chunk string, last boolean").parquet(f"{place}/in")
    # Documents may time out at any time, so such a stream always has another batch to run: here it runs one.
    q = push_parse(chunks, "//*[local-name() = 'bal']").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(once=True).start()
    q.awaitTermination()
    return spark.read.schema("doc_id long, seq long, value string").parquet(f"{place}/out").select(F.col("doc_id").alias("c_custkey"), "value")


# -- validation ----------------------------------------------------------
_DTD = "<!DOCTYPE orders [<!ELEMENT orders (order+)><!ELEMENT order (total,priority)><!ATTLIST order key CDATA #REQUIRED status (F|O) #REQUIRED><!ELEMENT total (#PCDATA)><!ELEMENT priority (#PCDATA)>]>"


@query("SELECT o_custkey, count(*)::BIGINT AS errors FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY o_custkey")
def dtd_errors(spark, sf_dir):
    c = _orders(spark, sf_dir)
    typed = Corpus(c.df.select("o_custkey", F.concat(F.lit(_DTD), F.col("source")).alias("source")), "source", "xml", "o_custkey")
    return typed.validate().groupBy(F.col("doc_id").alias("o_custkey")).agg(F.count("*").alias("errors"))


_RNG = """<element name="orders" xmlns="http://relaxng.org/ns/structure/1.0" datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes"><oneOrMore><element name="order"><attribute name="key"><data type="positiveInteger"/></attribute>
<attribute name="status"><choice><value>F</value><value>O</value><value>P</value></choice></attribute><interleave><element name="priority"><data type="token"><param name="pattern">[1-5]-[A-Z ]+</param></data></element><element name="total"><data type="int"><param name="maxInclusive">300000</param></data></element></interleave></element></oneOrMore></element>"""


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(floor(o_totalprice)) <= 300000 AND bool_and(regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+'))")
def relaxng_valid(spark, sf_dir):
    """Documents that a RELAX NG schema accepts."""
    c = _orders(spark, sf_dir)
    bad = c.validate(V.RelaxNG(_RNG)).select(F.col("doc_id").alias("o_custkey")).distinct()
    return c.df.select(F.col("o_custkey").cast("long").alias("o_custkey")).join(bad, "o_custkey", "left_anti")


_TYPES = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="o"><xs:complexType><xs:sequence><xs:element name="d"><xs:simpleType><xs:restriction base="xs:dateTime"><xs:minInclusive value="{low}"/></xs:restriction></xs:simpleType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>"""


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'")
def xsd_dates(spark, sf_dir):
    """Orders whose date is below a facet's bound."""
    found = _dated(spark, sf_dir).validate(V.Schema(_TYPES.format(low="1996-01-01T00:00:00")))
    return found.select(F.col("doc_id").alias("o_orderkey")).distinct()

