"""Node sets as DataFrames keyed by (doc_id, pre): navigation, set operations, positions and edits of the node table.

Every operation is a filter, an equi-join on the document with a condition on
preorder columns, or a window by document.  A node table that is partitioned by
``doc_id`` stays so throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tree import CDATA, COMMENT, ELEMENT, PI, TEXT

KEY = ["doc_id", "pre"]


# -- kinds ---------------------------------------------------------------
def is_element() -> Column:
    return F.col("kind") == ELEMENT


def is_text() -> Column:
    return F.col("kind").isin(TEXT, CDATA)


def is_comment() -> Column:
    return F.col("kind") == COMMENT


def is_processing_instruction() -> Column:
    return F.col("kind") == PI


def is_blank() -> Column:
    """Text of nothing but spaces, tabs and line ends."""
    return is_text() & (F.btrim("value", F.lit(" \t\r\n")) == "")


def attribute(name: str, ns: str | None = None) -> Column:
    """Value of an attribute of each element row, null if it has none."""
    return F.get(F.filter("attrs", lambda a: (a["local"] == name) & a["ns_uri"].eqNullSafe(F.lit(ns))), F.lit(0))["value"]


def attributes_map() -> Column:
    """All attributes as a map from qualified name to value."""
    return F.map_from_entries(F.transform("attrs", lambda a: F.struct(F.concat_ws(":", a["prefix"], a["local"]), a["value"])))


def classes(name: str = "class") -> Column:
    """Tokens of a list attribute."""
    return F.filter(F.split(F.coalesce(attribute(name), F.lit("")), "[ \t\r\n]+"), lambda t: t != "")


# -- sets ----------------------------------------------------------------
def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates(KEY)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY).distinct(), KEY, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY).distinct(), KEY, "left_anti")


def distinct_values(a: DataFrame, value: Column) -> DataFrame:
    """The first node in document order for each value within a document."""
    w = Window.partitionBy("doc_id", "_v").orderBy("pre")
    return a.withColumn("_v", value).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_v", "_n")


def first(a: DataFrame, n: int = 1) -> DataFrame:
    """The first ``n`` nodes of each document."""
    w = Window.partitionBy("doc_id").orderBy("pre")
    return a.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def last(a: DataFrame, n: int = 1) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.col("pre").desc())
    return a.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def at(a: DataFrame, place: int) -> DataFrame:
    """The node at a place from 0, or from the end if negative."""
    w = Window.partitionBy("doc_id").orderBy(F.col("pre") if place >= 0 else F.col("pre").desc())
    return a.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == (place + 1 if place >= 0 else -place)).drop("_n")


# -- navigation ----------------------------------------------------------
def _related(a: DataFrame, nodes: DataFrame, on) -> DataFrame:
    c = a.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_c"), F.col("size").alias("_size"), F.col("parent").alias("_parent"), F.col("sib").alias("_sib"), F.col("esib").alias("_esib"))
    found = c.join(nodes, (F.col("_d") == F.col("doc_id")) & on)
    return found.drop("_d", "_c", "_size", "_parent", "_sib", "_esib").dropDuplicates(KEY)


def children(a: DataFrame, nodes: DataFrame) -> DataFrame:
    return _related(a, nodes, F.col("parent") == F.col("_c"))


def element_children(a: DataFrame, nodes: DataFrame) -> DataFrame:
    return children(a, nodes.where(is_element()))


def parent(a: DataFrame, nodes: DataFrame) -> DataFrame:
    return _related(a, nodes, F.col("pre") == F.col("_parent"))


def ancestors(a: DataFrame, nodes: DataFrame) -> DataFrame:
    return _related(a, nodes, (F.col("pre") < F.col("_c")) & (F.col("_c") <= F.col("pre") + F.col("size")))


def descendants(a: DataFrame, nodes: DataFrame) -> DataFrame:
    return _related(a, nodes, (F.col("pre") > F.col("_c")) & (F.col("pre") <= F.col("_c") + F.col("_size")))


def next_sibling(a: DataFrame, nodes: DataFrame) -> DataFrame:
    return _related(a, nodes, (F.col("parent") == F.col("_parent")) & (F.col("sib") == F.col("_sib") + 1))


def previous_sibling(a: DataFrame, nodes: DataFrame) -> DataFrame:
    return _related(a, nodes, (F.col("parent") == F.col("_parent")) & (F.col("sib") == F.col("_sib") - 1))


def next_element(a: DataFrame, nodes: DataFrame) -> DataFrame:
    return _related(a.where("esib IS NOT NULL"), nodes.where(is_element()), (F.col("parent") == F.col("_parent")) & (F.col("esib") == F.col("_esib") + 1))


def previous_element(a: DataFrame, nodes: DataFrame) -> DataFrame:
    return _related(a.where("esib IS NOT NULL"), nodes.where(is_element()), (F.col("parent") == F.col("_parent")) & (F.col("esib") == F.col("_esib") - 1))


def string_value(a: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, content): concatenated text below each node, also where the table's own is over the cap."""
    c = a.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_c"), F.col("size").alias("_size"))
    t = nodes.where(is_text()).select("doc_id", "pre", "value")
    inside = c.join(t, (F.col("_d") == F.col("doc_id")) & (F.col("pre") >= F.col("_c")) & (F.col("pre") <= F.col("_c") + F.col("_size")), "left")
    parts = inside.groupBy(F.col("_d").alias("doc_id"), F.col("_c").alias("pre")).agg(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct(F.col("pre").alias("p"), F.col("value").alias("v"))))).alias("_l"))
    return parts.select("doc_id", "pre", F.array_join(F.transform("_l", lambda x: x["v"]), "").alias("content"))


def postorder() -> list[Column]:
    """Sort keys of a traversal that visits children before their parent."""
    return [F.col("doc_id"), F.col("pre") + F.col("size"), F.col("level").desc()]


def paths(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, path): the canonical location path of each element, by an ancestor join."""
    same = Window.partitionBy("doc_id", "parent", "ns_uri", "prefix", "local")
    e = nodes.where(is_element()).select(
        "doc_id", "pre", "size", F.concat_ws(":", "prefix", "local").alias("_name"), F.row_number().over(same.orderBy("pre")).alias("_k"), F.count("*").over(same).alias("_n")
    )
    e = e.withColumn("_part", F.when(F.col("_n") == 1, F.col("_name")).otherwise(F.concat("_name", F.lit("["), F.col("_k"), F.lit("]"))))
    up = e.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_u"), F.col("size").alias("_s"), F.col("_part").alias("_up"))
    chain = e.select("doc_id", "pre").join(up, (F.col("doc_id") == F.col("_d")) & (F.col("_u") <= F.col("pre")) & (F.col("pre") <= F.col("_u") + F.col("_s")))
    parts = chain.groupBy("doc_id", "pre").agg(F.array_sort(F.collect_list(F.struct("_u", "_up"))).alias("_l"))
    return parts.select("doc_id", "pre", F.concat(F.lit("/"), F.array_join(F.transform("_l", lambda x: x["_up"]), "/")).alias("path"))


# -- edits of the table --------------------------------------------------
def remove(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """The node table without the subtrees of ``gone``, numbered anew."""
    g = gone.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_g"), F.col("size").alias("_gs"))
    left = nodes.join(g, (F.col("doc_id") == F.col("_d")) & (F.col("pre") >= F.col("_g")) & (F.col("pre") <= F.col("_g") + F.col("_gs")), "left_anti")
    return renumber(left)


def renumber(nodes: DataFrame) -> DataFrame:
    """New ``pre``, ``size``, ``parent`` and places from the order and levels of the rows that are left."""
    by_doc = Window.partitionBy("doc_id").orderBy("pre")
    ranked = nodes.withColumn("_new", F.row_number().over(by_doc) - 1)
    parent_of = ranked.select(F.col("doc_id").alias("_pd"), F.col("pre").alias("_pp"), F.col("_new").alias("_parent"))
    out = ranked.join(parent_of, (F.col("doc_id") == F.col("_pd")) & (F.col("parent") == F.col("_pp")), "left").drop("_pd", "_pp")
    # What is left of a subtree still lies in its old range.
    inside = out.select(F.col("doc_id").alias("_id"), F.col("pre").alias("_ip"))
    sizes = out.select("doc_id", "pre", "size").join(inside, (F.col("doc_id") == F.col("_id")) & (F.col("_ip") > F.col("pre")) & (F.col("_ip") <= F.col("pre") + F.col("size")))
    sizes = sizes.groupBy("doc_id", "pre").agg(F.count("*").cast("int").alias("_size"))
    out = out.join(sizes, ["doc_id", "pre"], "left")
    sibling = Window.partitionBy("doc_id", "_parent").orderBy("_new")
    element = F.when(is_element(), F.sum(F.when(is_element(), 1).otherwise(0)).over(sibling.rowsBetween(Window.unboundedPreceding, 0)))
    renewed = {"pre": F.col("_new").cast("int"), "size": F.coalesce("_size", F.lit(0)), "parent": F.col("_parent").cast("int"), "sib": F.row_number().over(sibling).cast("int"), "esib": element.cast("int")}
    return out.select(*[(renewed[c].alias(c) if c in renewed else F.col(c)) for c in nodes.columns])


def strip_blanks(nodes: DataFrame) -> DataFrame:
    """Without blank text whose siblings are elements only, numbered anew."""
    text = nodes.where(is_text()).groupBy("doc_id", "parent").agg(F.max((~is_blank()).cast("int")).alias("_mixed"))
    has = nodes.where(is_element()).select("doc_id", "parent").distinct()
    plain = text.where("_mixed = 0").join(has, ["doc_id", "parent"], "left_semi").select("doc_id", "parent")
    return renumber(nodes.join(nodes.where(is_blank()).join(plain, ["doc_id", "parent"], "left_semi").select(*KEY), KEY, "left_anti"))
