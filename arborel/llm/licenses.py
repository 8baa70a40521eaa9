"""License scan, with DataFrame functions only.

A text is read and cut into words once.  What it shares with the base phrases
and the license templates, pairs of neighbouring words with their places, is
written as a small table, and everything else is computed from that table.

Base labels come from phrases whose words stand consecutively.  The method's own
labels come from an exact set-similarity join of text blocks with license
templates, both as sets of word pairs.  A block is a window of 128 words that
begins at each 64th word, whatever the line breaks, so that every notice of up
to 65 words lies whole in some block however it is wrapped.  Pairs are ordered
by their frequency in the whole corpus, the rarest first; a template is
contained in a block to the threshold only if they share a pair of the
template's prefix, so only such combinations are joined, after a length filter,
cut by a positional filter and then verified.  Each template has one pair that
tells it from its relatives; without it nothing is labelled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

# What separates words, base phrases and their labels.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    """A notice by which a license is granted; ``must`` is the pair of words that sets it apart."""

    label: str
    text: str
    must: str

    @property
    def pairs(self) -> list[str]:
        return sorted(set(word_pairs(self.text.split())))


def word_pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


# The wording of common license notices; a label may have several.
TEMPLATES = [
    Template("agpl", "this program is licensed under the gnu affero general public license", "gnu affero"),
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org"),
    Template("boost", "distributed under the boost software license version 1 0", "boost software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "nc 4"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "noncommercial 4"),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "nc sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "by sa"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "has waived"),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3", "gnu general"),
    Template("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "without fee"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser"),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "any person"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public"),
    Template("public-domain", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    Template("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "commercial applications"),
]
#: Words from one block's start to the next; a block is twice as long.
STRIDE = 64
MAX_TEMPLATE_PAIRS = 20_000


def _checked(templates: list[Template]) -> list[str]:
    """All pairs of the templates, which must be a bounded constant that blocks can hold."""
    for t in templates:
        if t.must not in t.pairs:
            raise ValueError(f"{t.must!r} is no pair of the template {t.text!r}")
        if len(t.text.split()) > STRIDE + 1:
            raise ValueError(f"the template {t.text[:40]!r}... is longer than a block can hold for certain")
    vocabulary = sorted({p for t in templates for p in t.pairs})
    if len(vocabulary) > MAX_TEMPLATE_PAIRS:
        raise ValueError("the templates have too many pairs to be constants of a plan")
    return vocabulary


def _known_pairs(words: Column, known: list[str]) -> Column:
    """Where pairs of ``known`` stand in ``words``: an array of (pos, pair)."""
    pair = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))
    first = sorted({p.split()[0] for p in known})
    places = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    at = F.filter(places, lambda i: F.get(words, i).isin(first) & pair(i).isin(known))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), pair(i).alias("pair")))


def _starts(found: Column, phrase: str) -> Column:
    """Positions in ``found`` at which all pairs of ``phrase`` follow one another."""
    def of(pair: str, back: int) -> Column:
        return F.transform(F.filter(found, lambda x: x["pair"] == pair), lambda x: x["pos"] - back)

    pairs = word_pairs(phrase.split())
    at = of(pairs[0], 0)
    for k, pair in enumerate(pairs[1:], 1):
        at = F.array_intersect(at, of(pair, k))
    return at


def template_matches(rows: DataFrame, row: str, found: str, templates: list[Template], threshold: float) -> DataFrame:
    """(row, label, containment) for each template that a block of a row contains to ``threshold``.

    ``rows`` comes from files; its column ``found`` holds places of word pairs.
    Containment is the share of a template's distinct pairs that the block has.
    """
    spark = rows.sparkSession
    vocabulary = _checked(templates)
    # One row for each pair of the templates at most comes back.
    seen = rows.select(F.explode(F.col(f"{found}.pair")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    frequency = {r["pair"]: r["n"] for r in seen.collect()}
    ordered = sorted(vocabulary, key=lambda p: (frequency.get(p, 0), p))
    rank = {p: n for n, p in enumerate(ordered)}

    prefixes, shapes, prefix_pairs = [], [], set()
    for k, t in enumerate(templates):
        pairs = sorted(t.pairs, key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(pairs) - 1e-9))
        prefix = pairs[: len(pairs) - need + 1]
        prefix_pairs.update(prefix)
        prefixes += [(rank[p], k, at) for at, p in enumerate(prefix)]
        shapes.append((k, t.label, [rank[p] for p in pairs], len(pairs), need, rank[t.must]))
    # Constants of at most MAX_TEMPLATE_PAIRS entries, as is the table of ranks.
    index = spark.createDataFrame(prefixes, "token int, template int, at int")
    shape = spark.createDataFrame(shapes, "template int, label string, pairs array<int>, size int, need int, must int")
    index = F.broadcast(index.join(F.broadcast(shape), "template"))
    ranks = F.broadcast(spark.createDataFrame([(p, n) for p, n in rank.items()], "pair string, token int"))
    least = min((s[4] for s in shapes), default=1)

    near = rows.where(F.exists(found, lambda x: x["pair"].isin(sorted(prefix_pairs))))
    places = near.select(F.col(row).alias("row"), F.inline(found))
    halves = F.floor(F.col("pos") / STRIDE).cast("int")
    places = places.select("row", "pos", "pair", F.explode(F.array(halves, halves - 1)).alias("block"))
    places = places.where((F.col("block") >= 0) & (F.col("pos") + 1 < (F.col("block") + 2) * STRIDE))
    # The tokens of a block in the order of their ranks, the rarest first; a block has 127 pairs at most.
    blocks = places.join(ranks, "pair").groupBy("row", "block").agg(F.array_sort(F.collect_set("token")).alias("have")).where(F.size("have") >= least)
    probes = blocks.select("row", "have", F.posexplode("have").alias("pos", "token"))
    joined = probes.join(index, "token").where(F.size("have") >= F.col("need"))
    most = F.least("pos", "at") + 1 + F.least(F.size("have") - F.col("pos") - 1, F.col("size") - F.col("at") - 1)
    joined = joined.where(most >= F.col("need"))
    overlap = F.size(F.array_intersect("pairs", "have"))
    joined = joined.where((overlap >= F.col("need")) & F.array_contains("have", F.col("must")))
    return joined.select("row", "label", (overlap / F.col("size")).alias("containment"))


def scan_licenses(docs: DataFrame, templates: list[Template] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """``docs`` without ``text``, with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Null or empty text has no words, places or labels and the score 0.  The
    score is 1 where a base phrase stands, else the highest containment of a
    template that meets the threshold, else 0.  Repeated rows are each returned;
    rows whose ``doc_id`` is null or repeated are scanned like others.  An empty
    table gives an empty table.  Columns of these names are replaced, all others
    pass through whatever their names.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    base = docs.drop(*new)
    kept = [F.col(f"`{c}`") for c in base.columns if c != "text"]
    low, words, row, found, n, own = unused([*base.columns, *new], "low", "words", "row", "found", "n", "own")
    # The two letters beyond ASCII whose lower case would be ASCII become another letter; only words of ASCII can match.
    plain = F.replace(F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u00df")), F.lit("\u0130"), F.lit("\u00df"))
    known = sorted({p for phrase in PHRASES for p in word_pairs(phrase.split())} | set(_checked(templates)))
    rows = base.select(*kept, F.lower(plain).alias(low))
    rows = rows.select(*kept, F.array_remove(F.split(low, GAP, -1), "").alias(words))
    rows = rows.select(*kept, F.monotonically_increasing_id().alias(row), F.size(words).cast("long").alias(n), _known_pairs(F.col(words), known).alias(found))
    # The one pass over texts ends here; the row numbers are those of the written table.
    rows = written(rows, "license-pairs")

    starts = {label: _starts(F.col(found), phrase) for phrase, label in PHRASES.items()}
    places = F.concat(*starts.values())
    labels = F.array_sort(F.array_compact(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for label, s in starts.items()])))
    out = rows.select(
        *kept,
        row,
        F.col(n).alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        labels.alias("base_labels"),
    )
    matches = template_matches(rows, row, found, templates, threshold).groupBy(F.col("row").alias(row))
    matches = matches.agg(F.struct(F.collect_set("label").alias("labels"), F.max("containment").alias("best")).alias(own))
    out = out.join(matches, row, "left")
    return out.select(
        *kept,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce(F.col(f"{own}.labels"), F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.col(f"{own}.best"), F.lit(0.0))).alias("score"),
    )


def op3_license_scan(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs.select("doc_id", "text"))


def _oracle() -> str:
    shapes = ", ".join(f"({k}, '{t.label}', {len(t.pairs)}, '{t.must}')" for k, t in enumerate(TEMPLATES))
    pairs = ", ".join(f"({k}, '{p}')" for k, t in enumerate(TEMPLATES) for p in t.pairs)
    starts = " UNION ALL ".join(
        f"SELECT rid, k - 1 AS k, '{label}' AS label FROM places WHERE " + " AND ".join(f"w[k + {n}] = '{word}'" for n, word in enumerate(phrase.split())) for phrase, label in PHRASES.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM d),
places AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS k FROM w),
b AS ({starts}),
bg AS (SELECT rid, count(*) AS n, min(k) AS lo, max(k) AS hi, list(DISTINCT label) AS labels FROM b GROUP BY rid),
tpl(tid, label, size, must) AS (VALUES {shapes}),
tp(tid, pair) AS (VALUES {pairs}),
p AS (SELECT rid, k - 1 AS pos, w[k] || ' ' || w[k + 1] AS pair FROM places WHERE k < len(w)),
inside AS (SELECT rid, pair, pos, unnest([pos // {STRIDE}, pos // {STRIDE} - 1]) AS block FROM p WHERE pair IN (SELECT pair FROM tp)),
held AS (SELECT DISTINCT rid, block, pair FROM inside WHERE block >= 0 AND pos + 1 < {STRIDE} * (block + 2)),
m AS (SELECT rid, label, count(*) / size::DOUBLE AS c FROM held JOIN tp USING (pair) JOIN tpl USING (tid) GROUP BY rid, block, tid, label, size, must
      HAVING count(*) >= ceil(0.8 * size - 1e-9) AND bool_or(pair = must)),
mg AS (SELECT rid, list(DISTINCT label) AS labels, max(c) AS best FROM m GROUP BY rid)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(bg.n, 0)::BIGINT AS n_base, bg.lo::BIGINT AS first_word, bg.hi::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(bg.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bg.labels, []), coalesce(mg.labels, [])))), ','), '') AS labels,
       CASE WHEN bg.n > 0 THEN 1.0 ELSE coalesce(mg.best, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN bg USING (rid) LEFT JOIN mg USING (rid)
"""


ORACLE = _oracle()
