"""XPath location paths as joins over the node table.

A step is an equi-join on ``doc_id`` with the axis as a range or equality on
preorder columns; a step from the document node is a filter.  Conditions on a
node's own row (attributes, string-value, sibling places) become column
expressions, other paths in predicates become semi-joins or counts, positions
become windows over each context node.  What isn't covered raises
:class:`NotRelational`; the per-document lane evaluates everything.

The node table should be written once, bucketed by ``doc_id`` (see
:func:`stored`); then no step parses anything, a step reads only the columns it
needs, and joins, windows and duplicate removals find the rows in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import nodeset
from ..tree import CDATA, COMMENT, DOCTYPE, ELEMENT, PI, TEXT
from . import css, xpath


class NotRelational(NotImplementedError):
    """An expression outside the relational subset."""


NODE = ["pre", "size", "level", "parent", "kind", "ns_uri", "prefix", "local", "value", "sib", "esib", "text", "attrs"]


def partitioned(nodes: DataFrame, n: int | None = None) -> DataFrame:
    """The node table dealt by document, once for all queries on it.

    The session then need not demand every join key as a partitioning key, so
    that a join on (doc_id, parent) finds both sides in place.
    """
    nodes.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return nodes.repartition(n, "doc_id") if n else nodes.repartition("doc_id")


def stored(nodes: DataFrame, buckets: int | None = None) -> DataFrame:
    """The node table as a table of files, bucketed by document and sorted in document order.

    The documents are parsed once, here.  Files lie in the folder that
    ``spark.checkpoint.dir`` names, else in the warehouse; either is shared by
    all executors.  Whole documents are dealt, so there are no hot keys but
    single documents.  As in :func:`partitioned`, the session no longer demands
    every join key as a partitioning key.
    """
    spark = nodes.sparkSession
    n, name = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), f"arborel_nodes_{uuid.uuid4().hex}"
    writer = partitioned(nodes, n).write.format("parquet").bucketBy(n, "doc_id").sortBy("doc_id", "pre")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        writer = writer.option("path", f"{shared.rstrip('/')}/{name}")
    writer.saveAsTable(name)
    # Its files hold a node in a few bytes, so their size says little about what a broadcast would take.
    return spark.table(name).hint("merge")


def _with_whole_text(nodes: DataFrame) -> DataFrame:
    """The node table with the string-values that are over its cap derived from the text below.

    Where a query doesn't read ``text``, Catalyst removes the join.
    """
    long = nodes.where((F.col("kind") == ELEMENT) & F.col("text").isNull())
    whole = nodeset.string_value(long, nodes).select(F.col("doc_id").alias("_td"), F.col("pre").alias("_tp"), "content")
    rows = nodes.join(whole.hint("merge"), (F.col("doc_id") == F.col("_td")) & (F.col("pre") == F.col("_tp")), "left")
    return rows.withColumn("text", F.coalesce("text", "content")).select(*nodes.columns)


class Paths:
    """Compiles paths over one node table."""

    def __init__(self, nodes: DataFrame, namespaces: Mapping[str, str] | None = None, html: bool = False):
        self.nodes, self.namespaces, self.html = _with_whole_text(nodes), dict(namespaces or {}), html
        self._joined = 0

    # -- entry points ----------------------------------------------------
    def xpath(self, expression: str) -> DataFrame:
        """(doc_id, pre, kind, name, value) of the selected nodes: each once; attributes have their owner's ``pre``."""
        return self._result(xpath.parse(expression))

    def css(self, selector: str) -> DataFrame:
        paths = css.xpath_for(selector, "//", None, self.html)
        out = self._result(xpath.parse(paths[0]))
        for p in paths[1:]:
            out = out.unionByName(self._result(xpath.parse(p)))
        return out.dropDuplicates(["doc_id", "pre", "kind", "name"]) if len(paths) > 1 else out

    def _result(self, tree: tuple) -> DataFrame:
        if tree[0] == "binary" and tree[1] == "|":
            both = self._result(tree[2]).unionByName(self._result(tree[3]))
            return both.dropDuplicates(["doc_id", "pre", "kind", "name"])
        if tree[0] == "filter":
            found = self._result_rows(tree[1])
            for p in tree[2]:
                found = self._predicate(found, p, Window.partitionBy("doc_id"), False)
            return self._shape(found)
        if tree[0] != "path" or (tree[2] is not None and tree[2][0] != "filter"):
            raise NotRelational("only paths select nodes")
        return self._shape(self._path(tree))

    def _result_rows(self, tree: tuple) -> DataFrame:
        if tree[0] != "path":
            raise NotRelational("a filter over other than a path")
        return self._path(tree)

    @staticmethod
    def _shape(rows: DataFrame) -> DataFrame:
        name = F.concat_ws(":", "prefix", "local")
        value = F.when(F.col("kind") == ELEMENT, F.col("text")).otherwise(F.col("value"))
        return rows.select("doc_id", "pre", "kind", name.alias("name"), value.alias("value"))

    # -- paths -----------------------------------------------------------
    def _path(self, tree: tuple, start: DataFrame | None = None) -> DataFrame:
        """Node rows; with ``start`` they carry its column ``org``."""
        _, absolute, inner, steps = tree
        if inner is not None:
            rows = self._result_rows(inner[1])
            for p in inner[2]:
                rows = self._predicate(rows, p, Window.partitionBy("doc_id"), False)
            at, unique = rows, True
        elif absolute or start is None:
            if start is not None:
                raise NotRelational("an absolute path in a predicate")
            at, unique = None, True
        else:
            at, unique = start, True
        for axis, test, predicates in steps:
            at, unique = self._step(at, axis, test, predicates, start is not None, unique)
        if at is None:
            at = self.nodes.where(F.col("level") == 0).select("doc_id", *NODE)
        return at

    def _step(self, at: DataFrame | None, axis: str, test: tuple, predicates: tuple, keep: bool, unique: bool) -> tuple[DataFrame, bool]:
        """The next node rows, and whether each node can come up only once."""
        carried = ["org"] if keep else []
        if axis in ("attribute", "namespace"):
            if axis == "namespace":
                raise NotRelational("the namespace axis")
            if at is None:
                at = self.nodes.where(F.lit(False))
            exploded = at.where(F.size("attrs") > 0).select("doc_id", *carried, F.col("pre").alias("_owner"), F.posexplode("attrs").alias("_ord", "_a"))
            rows = exploded.select(
                "doc_id", *carried, F.col("_owner").alias("pre"), F.lit(0).alias("size"), F.lit(None).cast("int").alias("level"), F.col("_owner").alias("parent"), F.lit(2).alias("kind"),
                F.col("_a.ns_uri").alias("ns_uri"), F.col("_a.prefix").alias("prefix"), F.col("_a.local").alias("local"), F.col("_a.value").alias("value"),
                F.col("_ord").alias("sib"), F.lit(None).cast("int").alias("esib"), F.col("_a.value").alias("text"), F.array().cast(self.nodes.schema["attrs"].dataType).alias("attrs"),
                F.col("_owner").alias("_c"),
            ).where(self._test(test, 2))
            reverse = False
        else:
            n = self.nodes.where(self._test(test, ELEMENT)).select("doc_id", *NODE)
            reverse = axis in xpath.REVERSE
            if at is None:
                if axis in ("descendant", "descendant-or-self"):
                    rows = n.where(F.col("level") > 0) if axis == "descendant" else n
                elif axis == "child":
                    rows = n.where(F.col("level") == 1)
                elif axis in ("self",):
                    rows = n.where(F.col("level") == 0)
                else:
                    rows = n.where(F.lit(False))
                rows = rows.withColumn("_c", F.lit(0))
            elif axis == "self":
                rows = at.where(self._test(test, ELEMENT)).withColumn("_c", F.col("pre"))
            else:
                c = at.select(F.col("doc_id").alias("_d"), *carried, F.col("pre").alias("_c"), F.col("size").alias("_size"), F.col("parent").alias("_parent"), F.col("kind").alias("_kind"))
                pre, size, parent = F.col("pre"), F.col("size"), F.col("parent")
                is_attr = F.col("_kind") == 2
                on = {
                    "child": (parent == F.col("_c")) & ~is_attr,
                    "parent": pre == F.col("_parent"),
                    "descendant": (pre > F.col("_c")) & (pre <= F.col("_c") + F.col("_size")),
                    "descendant-or-self": (pre >= F.col("_c")) & (pre <= F.col("_c") + F.col("_size")) & ~is_attr,
                    "ancestor": (pre <= F.col("_parent")) & (F.col("_c") <= pre + size),
                    "ancestor-or-self": (pre <= F.col("_c")) & (F.col("_c") <= pre + size),
                    "following-sibling": (parent == F.col("_parent")) & (pre > F.col("_c")) & ~is_attr,
                    "preceding-sibling": (parent == F.col("_parent")) & (pre < F.col("_c")) & ~is_attr,
                    "following": pre > F.col("_c") + F.col("_size"),
                    "preceding": (pre + size < F.col("_c")) & ~((pre <= F.col("_parent")) & (F.col("_c") <= pre + size)),
                }[axis]
                rows = c.join(n.hint("merge"), (F.col("_d") == F.col("doc_id")) & on).select("doc_id", *carried, *NODE, "_c")
        window = Window.partitionBy("doc_id", *carried, "_c")
        for p in predicates:
            rows = self._predicate(rows, p, window, reverse)
        # Children, attributes and selves of distinct nodes are distinct; other axes can meet a node twice.
        once = axis in ("child", "attribute", "self") or at is None
        rows = rows.select("doc_id", *carried, *NODE)
        if not (once and unique):
            rows = rows.dropDuplicates(["doc_id", *carried, "pre"])
        return rows, True

    def _test(self, test: tuple, principal: int) -> Column:
        kind = F.col("kind")
        if test[0] == "type":
            if test[1] == "node":
                return kind != DOCTYPE
            if test[1] == "text":
                return kind.isin(TEXT, CDATA)
            if test[1] == "comment":
                return kind == COMMENT
            return (kind == PI) & (F.lit(True) if test[2] is None else F.col("local") == test[2])
        out = kind == principal
        if test[2] is not None:
            out &= F.col("local") == test[2]
        if test[1] is None:
            return out
        if test[1] == "":
            return out if self.html else out & F.col("ns_uri").isNull()
        if test[1] not in self.namespaces:
            raise NotRelational(f"undefined namespace prefix {test[1]}")
        return out & (F.col("ns_uri") == self.namespaces[test[1]])

    # -- predicates ------------------------------------------------------
    def _predicate(self, rows: DataFrame, tree: tuple, window, reverse: bool) -> DataFrame:
        if tree[0] == "number":
            tree = ("binary", "=", ("call", "position", ()), tree)
        elif tree[0] == "call" and tree[1] == "last":
            tree = ("binary", "=", ("call", "position", ()), tree)
        elif tree[0] in ("negate", "variable") or (tree[0] == "binary" and tree[1] in ("+", "-", "*", "div", "mod")):
            tree = ("binary", "=", ("call", "position", ()), tree)
        if tree[0] == "binary" and tree[1] == "and":
            if not (xpath.positional(tree[2]) or xpath.positional(tree[3])):
                return self._predicate(self._predicate(rows, tree[2], window, reverse), tree[3], window, reverse)
        if xpath._mentions_place(tree):
            order = F.col("pre").desc() if reverse else F.col("pre").asc()
            rows = rows.withColumn("_position", F.row_number().over(window.orderBy(order, "sib")).cast("double"))
            if _calls(tree, "last"):
                rows = rows.withColumn("_last", F.count("*").over(window).cast("double"))
        # Paths other than from the row itself are joined in first, each under a name of its own.
        rows, condition = self._boolean(rows, tree)
        return rows.where(condition)

    def _sub(self, rows: DataFrame, path: tuple) -> DataFrame:
        """Nodes of a relative path from each row, with the row's ``pre`` as ``org``."""
        start = rows.select("doc_id", F.col("pre").alias("org"), *NODE).dropDuplicates(["doc_id", "org"])
        return self._path(path, start)

    def _boolean(self, rows: DataFrame, tree: tuple) -> tuple[DataFrame, Column]:
        kind = tree[0]
        if kind == "binary" and tree[1] in ("and", "or"):
            rows, a = self._boolean(rows, tree[2])
            rows, b = self._boolean(rows, tree[3])
            return rows, (a & b if tree[1] == "and" else a | b)
        if kind == "call" and tree[1] in ("not", "boolean") and len(tree[2]) == 1:
            rows, a = self._boolean(rows, tree[2][0])
            return rows, ~a if tree[1] == "not" else a
        if kind == "call" and tree[1] in ("true", "false"):
            return rows, F.lit(tree[1] == "true")
        if kind == "path":
            own = self._own(tree)
            if own is not None:
                return rows, own.isNotNull()
            return self._exists(rows, self._sub(rows, tree))
        if kind == "binary" and tree[1] in ("=", "!=", "<", "<=", ">", ">="):
            a, op, b = tree[2], tree[1], tree[3]
            if b[0] == "path" and a[0] != "path":
                a, b, op = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
            if a[0] == "path" and b[0] == "path" and (self._own(a) is None or self._own(b) is None):
                return self._some_pair(rows, op, a, b)
            if a[0] == "path" and self._own(a) is None:
                if b[0] not in ("string", "number"):
                    raise NotRelational("a comparison of a path with a computed value")
                found = self._sub(rows, a)
                value = F.coalesce(F.col("text"), F.col("value"))
                numeric = b[0] == "number" or op not in ("=", "!=")
                bound = F.lit(float(b[1])) if b[0] == "number" else X.number(F.lit(b[1])) if numeric else F.lit(b[1])
                return self._exists(rows, found.where(_compare(op, X.number(value) if numeric else value, bound, numeric)))
            rows, x, xn = self._scalar(rows, a)
            rows, y, yn = self._scalar(rows, b)
            there = F.lit(True)
            for t, v in ((a, x), (b, y)):
                if t[0] == "path":
                    there &= v.isNotNull()
            numeric = xn or yn or op not in ("=", "!=")
            if numeric:
                x, y = x if xn else X.number(x), y if yn else X.number(y)
            return rows, there & F.coalesce(_compare(op, x, y, numeric), F.lit(False))
        if kind == "call" and tree[1] in ("starts-with", "contains"):
            rows, a, _ = self._scalar(rows, tree[2][0])
            rows, b, _ = self._scalar(rows, tree[2][1])
            a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
            return rows, F.startswith(a, b) if tree[1] == "starts-with" else F.contains(a, b)
        rows, v, is_number = self._scalar(rows, tree)
        return rows, X.boolean(v) if is_number else v != ""

    def _some_pair(self, rows: DataFrame, op: str, a: tuple, b: tuple) -> tuple[DataFrame, Column]:
        """Whether some node of ``a`` and some of ``b`` compare: an equi-join for =, else the extremes of both sides."""
        value = F.coalesce(F.col("text"), F.col("value"), F.lit(""))
        if _of_siblings(a) and not _of_siblings(b):
            a, b, op = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
        if _of_siblings(b):
            return self._exists(rows, self._sibling_pair(rows, op, a, b, value))
        left, right = (self._sub(rows, x).select("doc_id", "org", value.alias(v)) for x, v in ((a, "_x"), (b, "_y")))
        if op == "=":
            return self._exists(rows, left.join(right.withColumnRenamed("_y", "_x").hint("merge"), ["doc_id", "org", "_x"], "left_semi"))
        if op != "!=":  # as numbers; NaN compares with nothing
            left, right = (d.select("doc_id", "org", X.number(F.col(v)).alias(v)).where(~F.isnan(v)) for d, v in ((left, "_x"), (right, "_y")))
        sides = [d.groupBy("doc_id", "org").agg(F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")) for d, v in ((left, "_x"), (right, "_y"))]
        both = sides[0].join(sides[1].hint("merge"), ["doc_id", "org"])
        return self._exists(rows, both.where(_extremes_hold(op)))

    def _sibling_pair(self, rows: DataFrame, op: str, a: tuple, b: tuple, value: Column) -> DataFrame:
        """The rows for which some node of ``a`` and some of ``b``, a path from siblings before or after, compare.

        The siblings' values are found once for each sibling, not for each pair
        of siblings: with the place of the first and last sibling that has a value
        for =, else with the extremes of all before or after a place.
        """
        axis, test, _ = b[3][0]
        before, place = axis == "preceding-sibling", F.struct("parent", "pre").alias("org")
        at = rows.where(F.col("kind") != 2).select("doc_id", place, *NODE).dropDuplicates(["doc_id", "org"])
        siblings = self.nodes.where(self._test(test, ELEMENT)).select("doc_id", place, *NODE)
        left = self._path(a, at).select("doc_id", F.col("org.parent").alias("_up"), F.col("org.pre").alias("org"), value.alias("_x"))
        right = self._path((*b[:3], b[3][1:]), siblings) if b[3][1:] else siblings
        right = right.select("doc_id", F.col("org.parent").alias("_up"), F.col("org.pre").alias("org"), value.alias("_y"))
        if op == "=":
            ends = right.groupBy("doc_id", "_up", F.col("_y").alias("_x")).agg((F.min if before else F.max)("org").alias("_end"))
            ends = ends.select(*[F.col(c).alias(f"_r{c}") for c in ends.columns])
            same = (F.col("doc_id") == F.col("_rdoc_id")) & (F.col("_up") == F.col("_r_up")) & (F.col("_x") == F.col("_r_x"))
            return left.join(ends.hint("merge"), same & (F.col("_r_end") < F.col("org") if before else F.col("_r_end") > F.col("org")), "left_semi")
        if op != "!=":  # as numbers; NaN compares with nothing
            left, right = (d.withColumn(v, X.number(F.col(v))).where(~F.isnan(v)) for d, v in ((left, "_x"), (right, "_y")))
        sides = [d.groupBy("doc_id", "_up", "org").agg(F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")) for d, v in ((left, "_x"), (right, "_y"))]
        others = Window.partitionBy("doc_id", "_up").orderBy(F.col("org") if before else F.col("org").desc()).rangeBetween(Window.unboundedPreceding, -1)
        both = sides[0].unionByName(sides[1], allowMissingColumns=True).where(F.col("_up").isNotNull())
        both = both.withColumns({"_y_min": F.min("_y_min").over(others), "_y_max": F.max("_y_max").over(others)})
        return both.where(F.col("_x_min").isNotNull() & _extremes_hold(op))

    def _first(self, rows: DataFrame, path: tuple) -> tuple[DataFrame, Column]:
        """The string-value of the first node in document order of a relative path from each row; null if there is none."""
        value = F.coalesce(F.col("text"), F.col("value"), F.lit(""))
        first = self._sub(rows, path).groupBy("doc_id", "org").agg(F.min_by(value, F.struct("pre", F.when(F.col("kind") == 2, F.col("sib")).otherwise(-1))).alias("_v"))
        self._joined += 1
        name = f"_string{self._joined}"
        first = first.select(F.col("doc_id").alias("_hd"), F.col("org").alias("_hp"), F.col("_v").alias(name))
        rows = rows.join(first.hint("merge"), (F.col("doc_id") == F.col("_hd")) & (F.col("pre") == F.col("_hp")), "left").drop("_hd", "_hp")
        return rows, F.col(name)

    def _exists(self, rows: DataFrame, found: DataFrame) -> tuple[DataFrame, Column]:
        self._joined += 1
        flag = f"_has{self._joined}"
        hit = found.select(F.col("doc_id").alias("_hd"), F.col("org").alias("_hp")).distinct().withColumn(flag, F.lit(True))
        rows = rows.join(hit.hint("merge"), (F.col("doc_id") == F.col("_hd")) & (F.col("pre") == F.col("_hp")), "left").drop("_hd", "_hp")
        return rows, F.coalesce(F.col(flag), F.lit(False))

    def _own(self, tree: tuple) -> Column | None:
        """A path that is answered from the row itself: . and @name."""
        if tree[0] != "path" or tree[1] or tree[2] is not None or len(tree[3]) != 1 or tree[3][0][2]:
            return None
        axis, test, _ = tree[3][0]
        if axis == "attribute" and test[0] == "name" and test[2] is not None:
            uri = None if not test[1] else self.namespaces.get(test[1])
            hit = F.filter("attrs", lambda a: (a["local"] == test[2]) & (F.lit(True) if test[1] is None else a["ns_uri"].eqNullSafe(F.lit(uri))))
            return F.get(hit, F.lit(0))["value"]
        if axis == "self" and test == ("type", "node", None):
            return F.coalesce(F.col("text"), F.col("value"), F.lit(""))
        if axis == "parent" and test[0] == "name" and test[1] in (None, "") and test[2] is None:
            return F.when(F.col("level") > 1, F.lit(""))
        if axis == "child" and test == ("type", "node", None):
            return F.when(F.col("size") > 0, F.lit(""))
        return None

    def _scalar(self, rows: DataFrame, tree: tuple) -> tuple[DataFrame, Column, bool]:
        """A column and whether it is a number (otherwise a string)."""
        kind = tree[0]
        if kind == "number":
            return rows, F.lit(float(tree[1])), True
        if kind == "string":
            return rows, F.lit(tree[1]), False
        if kind == "path":
            own = self._own(tree)
            if own is None:
                rows, own = self._first(rows, tree)
            return rows, own, False
        if kind == "negate":
            rows, a, n = self._scalar(rows, tree[1])
            return rows, -(a if n else X.number(a)), True
        if kind == "filter" and not tree[2]:
            return self._scalar(rows, tree[1])
        if kind == "binary" and tree[1] in ("+", "-", "*", "div", "mod"):
            rows, a, an = self._scalar(rows, tree[2])
            rows, b, bn = self._scalar(rows, tree[3])
            a, b = (a if an else X.number(a)), (b if bn else X.number(b))
            return rows, {"+": a + b, "-": a - b, "*": a * b, "div": X.divide(a, b), "mod": X.modulo(a, b)}[tree[1]], True
        if kind != "call":
            raise NotRelational(kind)
        name, args = tree[1], tree[2]
        if name == "position":
            return rows, F.col("_position"), True
        if name == "last":
            return rows, F.col("_last"), True
        if name == "count" and args[0][0] == "path":
            place = _element_siblings(args[0])
            if place == "preceding":
                return rows, (F.col("esib") - 1).cast("double"), True
            found = self._sub(rows, args[0]).groupBy("doc_id", "org").agg(F.count("*").cast("double").alias("_n"))
            self._joined += 1
            n = f"_count{self._joined}"
            found = found.select(F.col("doc_id").alias("_hd"), F.col("org").alias("_hp"), F.col("_n").alias(n))
            rows = rows.join(found.hint("merge"), (F.col("doc_id") == F.col("_hd")) & (F.col("pre") == F.col("_hp")), "left").drop("_hd", "_hp")
            return rows, F.coalesce(F.col(n), F.lit(0.0)), True
        if name in ("local-name", "name") and not args:
            return rows, F.col("local") if name == "local-name" else F.concat_ws(":", "prefix", "local"), False
        values, numeric = [], []
        for a in args or ((("path", False, None, (("self", ("type", "node", None), ()),))),):
            rows, v, n = self._scalar(rows, a)
            values.append(F.coalesce(v, F.lit("")) if not n else v)
            numeric.append(n)
        text = [X.string(v) if n else v for v, n in zip(values, numeric)]
        num = [v if n else X.number(v) for v, n in zip(values, numeric)]
        strings = {
            "string": lambda: text[0], "concat": lambda: F.concat(*text), "normalize-space": lambda: X.normalize_space(text[0]), "substring-before": lambda: X.substring_before(*text),
            "substring-after": lambda: X.substring_after(*text), "substring": lambda: X.substring(text[0], *num[1:]),
        }
        if name == "translate" and args[1][0] == args[2][0] == "string":
            return rows, F.translate(text[0], args[1][1], args[2][1]), False
        if name in strings:
            return rows, strings[name](), False
        numbers = {
            "number": lambda: num[0], "string-length": lambda: F.length(text[0]).cast("double"), "floor": lambda: X.floor(num[0]), "ceiling": lambda: X.ceiling(num[0]),
            "round": lambda: X.round_(num[0]),
        }
        if name in numbers:
            return rows, numbers[name](), True
        raise NotRelational(f"{name}() here")


def _calls(tree, name: str) -> bool:
    return isinstance(tree, tuple) and ((len(tree) > 1 and tree[0] == "call" and tree[1] == name) or any(_calls(x, name) for x in tree))


def _of_siblings(tree: tuple) -> bool:
    """Whether a relative path begins with all siblings of a name or type before or after the row."""
    return not tree[1] and tree[2] is None and tree[3][0][0] in ("preceding-sibling", "following-sibling") and not tree[3][0][2]


def _extremes_hold(op: str) -> Column:
    x_min, x_max, y_min, y_max = (F.col(c) for c in ("_x_min", "_x_max", "_y_min", "_y_max"))
    return {"!=": (x_min != y_max) | (x_max != y_min), "<": x_min < y_max, "<=": x_min <= y_max, ">": x_max > y_min, ">=": x_max >= y_min}[op]


def _element_siblings(path: tuple) -> str | None:
    steps = path[3]
    if not path[1] and path[2] is None and len(steps) == 1 and steps[0] == ("preceding-sibling", ("name", None, None), ()):
        return "preceding"
    return None


def _compare(op: str, a: Column, b: Column, numeric: bool) -> Column:
    """A comparison of two strings or two numbers; NaN only differs."""
    if not numeric:
        return a == b if op == "=" else a != b
    known = ~F.isnan(a) & ~F.isnan(b)
    if op == "!=":
        return (a != b) | ~known
    return known & {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
