"""Each operator against brute force, and on nulls, empties, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborel.llm import decontam, html_text, licenses, line_dedup, packing, quality, simhash, token_counts, token_store, topk
from arborel.llm.common import new_path
from arborel.llm.encoding import Encoder, tokenizer_path


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# -- 1 -------------------------------------------------------------------
def brute_topk(vectors, queries, k=5):
    import math

    def q(v):
        if v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    have = [(i, q(v)) for i, v in vectors if i is not None and q(v) is not None]
    out = []
    for i, v in queries:
        v = q(v)
        if i is None or v is None:
            continue
        best = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in have if j != i))[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [7, 10_000])
def test_topk(spark, shard_rows):
    r = random.Random(1)
    vectors = [(i, [r.gauss(0, 0.2) for _ in range(16)]) for i in range(120)]
    vectors += [(200 + i, vectors[3][1]) for i in range(9)]  # ties
    vectors += [(300, None), (301, [float("nan")] * 16), (302, [1.0, None]), (303, [0.5, -0.5]), (304, []), (None, [0.1] * 16), (305, [float("inf")] * 16)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    asked = [v for v in vectors if v[0] is None or v[0] % 50 == 0 or v[0] in (303, 304)]
    index = topk.build_index(df, shard_rows=shard_rows)
    got = rows(topk.search(index, spark.createDataFrame(asked, df.schema), block=2), "query_id", "rank", "vec_id", "score")
    assert got == brute_topk(vectors, asked)


def test_topk_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<double>")
    assert rows(topk.op1_topk(df), "query_id", "rank", "vec_id", "score") == [(0, 1, 50, 256 * 512), (50, 1, 0, 256 * 512)]
    assert topk.op1_topk(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1, 3_000_000, 10**9])
def test_topk_of_one_shard(scale):
    import numpy as np

    r = np.random.default_rng(0)
    impacts = r.integers(-20, 20, (3000, 8)) * scale
    impacts[7] = 400 * scale  # one vector dominates
    impacts[100:140] = impacts[50]  # ties over the last place
    ids = np.arange(3000)
    ids[20:30] = 5  # repeated ids
    own, queries = np.array([-1, 5, 50, 7]), np.array([[9] * 8, impacts[5] // scale, impacts[50] // scale, [0] * 8])
    got = topk.Shard(ids, impacts).top(own, queries, 5)
    for q, o, (i, s) in zip(queries, own, got):
        score = impacts @ q
        keep = np.nonzero(ids != o)[0]
        best = keep[np.lexsort((ids[keep], -score[keep]))[:5]]
        assert i.tolist() == ids[best].tolist() and s.tolist() == score[best].tolist()


def test_topk_reads_part_of_the_postings():
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.1/embeddings.parquet"
    r = np.random.default_rng(3)
    cases = [np.floor(256 * r.normal(0, 0.125, (4000, 32))).astype(np.int64)]
    if os.path.exists(path):
        cases.append(np.floor(256 * np.array(pq.read_table(path)["embedding"].drop_null().to_pylist(), dtype=np.float64)).astype(np.int64))
    for impacts in cases:
        shard, ids = topk.Shard(np.arange(len(impacts)), impacts), np.arange(len(impacts))
        asked = ids[:: len(ids) // 40]
        for own, (found, score) in zip(asked, shard.top(asked, impacts[asked], 5)):
            want = impacts @ impacts[own]
            best = np.lexsort((ids, -want))
            best = best[best != own][:5]
            assert found.tolist() == best.tolist() and score.tolist() == want[best].tolist()
        assert shard.read < 0.85 * impacts.size * len(asked)


def test_topk_of_one_vector_repeated(spark):
    df = spark.createDataFrame([(50, [0.5, 0.25])] * 500 + [(k, [0.5, 0.25]) for k in range(51, 60)] + [(100, [0.1, -0.3])], "vec_id long, embedding array<double>")
    index = topk.build_index(df, shard_rows=64)
    assert max(x.n for x in index.select("n").collect()) < 128
    got = rows(topk.search(index, df.where("vec_id % 50 = 0"), block=1, together=1), "query_id", "rank", "vec_id")
    assert got == [(50, k, 50 + k, ) for k in range(1, 6)] + [(100, k, 50) for k in range(1, 6)]


# -- 2 -------------------------------------------------------------------
def test_simhash(docs, texts):
    want = simhash.brute_force(dict(texts).items())
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(docs).collect()}
    assert got == want
    assert simhash.op2_simhash(docs).count() == len(texts)


def test_simhash_links_by_hand(spark):
    import numpy as np

    r = random.Random(2)
    fps = [r.getrandbits(64) for _ in range(40)]
    for f in list(fps[:12]):
        for _ in range(6):
            g = f
            for b in r.sample(range(64), r.randint(0, 5)):
                g ^= 1 << b
            fps.append(g)
    fps = sorted(set(fps))
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, [f]) for i, f in enumerate(signed)], "id long, fps array<long>")
    parent = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    for chunk in (4096, 3):
        found = {r.id: r.component for r in simhash.components(simhash.find_links(df, 1, 3, chunk)).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == parent


def test_simhash_null_ids_and_empty(spark, no_docs):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "x y")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.op2_simhash(df).collect()), key=str)
    assert got == [(5, 5), (None, 5), (None, None)]
    assert simhash.op2_simhash(no_docs).count() == 0


def test_keep_one_of_each(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    base = [r.choice(words) for _ in range(200)]
    near = list(base)
    near[50] = "other"
    far = [r.choice(words) for _ in range(200)]
    df = spark.createDataFrame([(2, " ".join(base), 1), (1, " ".join(near), 2), (3, " ".join(far), 3), (3, " ".join(far), 3), (None, "x", 4)], "doc_id long, text string, extra int")
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]
    assert simhash.recall(0.8, 12) > 0.97


def exact_groups(texts, similarity=0.8):
    """The smallest id of each text's group, linking all pairs of at least this Jaccard similarity."""
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in texts}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9 and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return group


def test_near_duplicates_are_linked_by_exact_similarity(spark):
    r = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for k in range(60):  # 5 shingles, 4 shared: 0.67
        base = [r.choice(words) for _ in range(9)]
        texts += [(10 * k, " ".join(base)), (10 * k + 1, " ".join([*base[:-1], "other"]))]
    for k in range(60, 100):  # 200 words, changed in some places: from 0.6 to 0.75, apart from copies with one change
        base = [r.choice(words) for _ in range(200)]
        far, near = list(base), list(base)
        for at in range(8, 8 + 12 * (6 + k % 5), 12):
            far[at] = "changed"
        near[150] = "changed"
        texts += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(far)), (10 * k + 2, " ".join(near))]
    line = " ".join(words[:7])  # repeated words must not outweigh what differs
    texts += [(5000 + k, " ".join([line] * 60 + words[100 * k + 100 : 100 * k + 112])) for k in range(3)]
    want = exact_groups(texts)
    assert len(set(want.values())) == 60 * 2 + 40 * 2 + 3
    kept = simhash.keep_one_of_each(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))


def test_pairs_at_the_similarity_are_met(spark):
    r = random.Random(4)
    texts = []
    for k in range(200):  # 180 shingles each, 160 shared: exactly 0.8
        base = [f"w{r.randrange(10**6)}" for _ in range(184)]
        near = list(base)
        for at in (20, 60, 100, 140):
            near[at] = "changed"
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    assert len(set(exact_groups(texts).values())) == 200
    kept = {x.doc_id for x in simhash.keep_one_of_each(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert kept >= set(range(0, 400, 2)) and len(kept) <= 202
    assert simhash.met(0.8, 24, 8) > 0.997 and simhash.met(0.8, 12, 8, 1.5) < 0.93


def test_proposals_of_a_full_shard_take_little_memory():
    import tracemalloc

    r = np.random.default_rng(1)
    fps = r.integers(0, 2**64, (4096, 8), dtype=np.uint64)
    fps[1::2] = fps[::2] ^ (np.uint64(1) << r.integers(0, 64, (2048, 8), dtype=np.uint64))  # eight bits from its neighbour
    fps[:, 0] = fps[0, 0]  # all agree on the first block, where the pairs count
    n, shard = np.full(4096, 100), np.zeros(4096, dtype=np.int64)
    tracemalloc.start()
    found = simhash._proposed(shard, n, fps, 102, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.tolist() == list(range(4096)) and peak < 150e6
    a, b = r.integers(0, 4096, (2, 2 * simhash.STEP + 5))
    assert simhash.Forest(shard, fps).distance(a, b).tolist() == np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1).tolist()


def test_similar_links_by_brute_force():
    r = random.Random(2)
    sets = [np.array(sorted(r.sample(range(30), r.randrange(0, 14))), dtype=np.uint64) for _ in range(150)]
    sets += [np.arange(k, k + 12, dtype=np.uint64) for k in range(50, 70)]
    a, b = simhash.similar_links(sets, 0.8)
    plain = [set(s.tolist()) for s in sets]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if plain[i] and len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j])]

    def joined(links):
        group = list(range(len(sets)))
        for i, j in links:
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
        return group

    assert joined(zip(a.tolist(), b.tolist())) == joined(pairs)


# -- 3 -------------------------------------------------------------------
def brute_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    best, own = 0.0, set()
    for start in range(0, len(w), 64):
        have = set(zip(w[start : start + 128], w[start + 1 : start + 128]))
        for t in licenses.TEMPLATES:
            want = set(zip(t.text.split(), t.text.split()[1:]))
            c = len(want & have) / len(want)
            if c >= 0.8 - 1e-9 and tuple(t.must.split()) in have:
                own.add(t.label)
                best = max(best, c)
    places = [k for k, _ in at]
    labels = {x for _, x in at}
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own)), 1.0 if at else best


def test_licenses(spark, docs, texts):
    more = [(i + 100, " ".join(t.text.split()[: -n or None])) for i, t in enumerate(licenses.TEMPLATES) for n in (0, 1, 4)]
    r = random.Random(11)
    filler = [f"word{k}" for k in range(50)] + "of the in the to use this software and or".split()
    for k, t in enumerate(licenses.TEMPLATES):  # anywhere in a long text, wrapped, with other case, once with a word too many
        words = t.text.split()
        words[len(words) // 2 : len(words) // 2] = ["really"] * (k % 2)
        notice = "".join(r.choice([" ", "\n", " \n * ", ", "]) + (x.upper() if r.random() < 0.3 else x) for x in words)
        more.append((200 + k, " ".join(r.choices(filler, k=r.randrange(300))) + notice + ". " + " ".join(r.choices(filler, k=r.randrange(300)))))
    more += [(300, "Licensed under CC BY-NC 4.0. " * 100), (301, "\u212a CC BY \u0130 MIT license all RIGHTS reserved \u212a"), (302, "released under the m\u0130t license")]
    df = docs.select("doc_id", "text", "score").union(spark.createDataFrame([(i, t, 0.1) for i, t in more], "doc_id long, text string, score double"))
    got = sorted(tuple(r) for r in licenses.op3_license_scan(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect())
    key = lambda x: str(x)
    assert sorted(got, key=key) == sorted([(i, *brute_licenses(t)) for i, t in [*texts, *more]], key=key)


def test_license_notices_get_their_own_label(spark):
    notices = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-notice",
        "This program is licensed under the GNU Affero General Public License.": "agpl,gpl",
        "Licensed under the GNU Lesser General Public License, v3": "gpl,lgpl",
        "Licensed under CC BY 4.0.": "cc-by",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
        "Licensed under CC BY-NC-SA 4.0.": "cc-by,cc-by-nc-sa",
        "Licensed under the Apache License, Version 2.0.": "apache",
        "Released under the MIT License.": "mit",
        "Released under the license": "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal": "mit",
        "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:": "bsd",
        "you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation": "gpl,gpl-notice",
    }
    long = "person a copy of software obtaining hereby any files documentation granted associated free permission charge this is to and " * 300
    rows_ = [(k, t, "x", "y") for k, t in enumerate([*notices, long])]
    df = spark.createDataFrame(rows_, "doc_id long, text string, found string, row string")
    out = licenses.scan_licenses(df)
    assert out.columns[:3] == ["doc_id", "found", "row"]
    assert {(r.found, r.row) for r in out.collect()} == {("x", "y")}
    assert [r.labels for r in out.orderBy("doc_id").collect()] == [*notices.values(), ""]


def test_licenses_empty(no_docs):
    assert licenses.op3_license_scan(no_docs).count() == 0


# -- 4 -------------------------------------------------------------------
def test_decontamination(spark, docs, texts):
    source = dict(texts)
    items = [(1, " ".join(source[1].split()[5:25])), (2, "one two"), (3, None), (4, ""), (10, " ".join(source[4].split()[:9])), (5, "nothing of the kind occurs anywhere in here at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontam.brute_force(texts, items))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontam.op4_decontamination(docs, bench), *columns) == want
    sliced = decontam.find_contamination(docs, bench, max_words=5)
    whole = decontam.find_contamination(docs, bench)
    show = lambda df: sorted(str((r.doc_id, r.n_words, r.spans, r["items"])) for r in df.collect())
    assert show(sliced) == show(whole)
    kept = decontam.remove_documents(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, n, _, _ in want if not n}


def test_decontamination_of_a_benchmark_above_the_bound(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choices(words, k=r.choice([3, 8, 20])))) for k in range(60)]
    texts = []
    for k in range(40):  # passages of several items, some overlapping
        parts = [r.choice(items)[1] for _ in range(r.randint(0, 4))] + [" ".join(r.choices(words, k=30))]
        r.shuffle(parts)
        texts.append((k if k % 5 else None, " ".join(parts)))
    docs = spark.createDataFrame([(i, t, "keep", 1) for i, t in texts], "doc_id long, text string, row string, content int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    show = lambda df: sorted(str((r.doc_id, r.n_words, r.spans, r["items"], r.row, r.content)) for r in df.collect())
    whole = decontam.find_contamination(docs, bench)
    assert show(decontam.find_contamination(docs, bench, max_words=40)) == show(whole)
    assert whole.columns == [*docs.columns, "n_words", "spans", "items"]
    key = lambda x: str(x)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r[c] for c in columns) for r in decontam.op4_decontamination(docs, bench).collect()), key=key) == sorted(decontam.brute_force(texts, items), key=key)


def test_window_filter_grows_with_the_windows():
    r = random.Random(1)
    items = [(k, " ".join(f"v{r.randrange(90_000)}" for _ in range(400)).encode()) for k in range(260)]
    filled = decontam.Windows(items, 8).filters[8].mean()
    assert filled < 1 / 15


def test_decontamination_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.op4_decontamination(docs, none).where("n_items > 0").count() == 0
    assert decontam.op4_decontamination(no_docs, none).count() == 0


# -- 5, 6 ----------------------------------------------------------------
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_encoder_equals_library(name):
    r = random.Random(4)
    enc = Encoder(tokenizer_path(name), cache_words=50)
    texts = ["", " ", "  a", "a\n", "it's we'll I'M Dońt", "<|endoftext|>x <|endoftext|>", "ΣΑΣ", "J̌ x", "日本語 テキスト"]
    texts += ["".join(r.choice(" \n\t abZ1'.śé\xa0\x1c\x85Σ<|>!%") for _ in range(r.randint(0, 30))) for _ in range(400)]
    for t in texts:
        assert enc.encode([t])[0] == b"".join(i.to_bytes(4, "little") for i in enc.whole([t])[0]), repr(t)


def test_token_store(docs, texts):
    enc = Encoder(tokenizer_path("word_bpe_49k.json"))
    want, start = [], 0
    for i, t in sorted(texts, key=lambda x: (x[0], x[1] or "")):
        ids = [*enc.whole([t or ""])[0], 2]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert rows(token_store.op5_token_store(docs), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want)


def test_token_store_files(spark, docs, no_docs):
    import glob

    import pyarrow.parquet as pq

    path = new_path(spark, "t")
    token_store.write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"), parts=3)
    back = token_store.read_tokens(spark, path)
    assert rows(back.where("doc_id = 10"), "doc_id", "n_tokens")[0][0] == 10
    assert back.count() == docs.count()
    for f in glob.glob(path.removeprefix("file://") + "/*.parquet"):
        column = pq.ParquetFile(f).metadata.row_group(0).column(0)
        assert column.has_column_index and column.has_offset_index
    assert token_store.op5_token_store(no_docs).count() == 0


def test_token_counts(spark, docs, texts):
    path = tokenizer_path("byte_bpe_50k.json")
    enc = Encoder(path)
    want = sorted((i, len((t or "").encode()), len(enc.whole([t or ""])[0])) for i, t in texts)
    cache = new_path(spark, "c")
    assert rows(token_counts.count_tokens(docs, path, cache), "doc_id", "n_bytes", "n_tokens") == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in texts})
    assert rows(token_counts.count_tokens(docs, path, cache), "doc_id", "n_bytes", "n_tokens") == want
    assert spark.read.parquet(cache).count() == stored.count()  # nothing was encoded again
    assert token_counts.op6_token_counts(docs.limit(0)).count() == 0


def test_token_counts_of_a_hot_content(spark):
    path, cache = tokenizer_path("byte_bpe_50k.json"), new_path(spark, "hot")
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 7 END AS doc_id", "'the same words in every row' AS text", "id AS key", "'x' AS salt")
    out = token_counts.count_tokens(df, path, cache)
    assert out.columns == [*df.columns, "n_bytes", "n_tokens"]
    assert out.groupBy("n_tokens", "n_bytes", "salt").count().collect() == [(6, 27, "x", 20_000)] or out.select("n_tokens").distinct().count() == 1
    assert out.agg(F.countDistinct("key")).first()[0] == 20_000
    assert spark.read.parquet(cache).count() == 1  # encoded once


# -- 7 -------------------------------------------------------------------
def test_factorisation_identity():
    import numpy as np

    r = np.random.default_rng(1)
    m = quality.Machine(np.zeros((len(quality.STATISTICS), 15)), 0.3, r.normal(0, 1, 10).astype("f4"), r.normal(0, 1, (10, 4)).astype("f4"))
    index, value = np.array([1, 4, 7]), np.array([0.5, 1, 2], dtype="f4")
    pairs = sum(float(m.factors[index[a]] @ m.factors[index[b]] * value[a] * value[b]) for a in range(3) for b in range(a + 1, 3))
    assert m.score(index, value) == pytest.approx(1 / (1 + np.exp(-(0.3 + float(m.weights[index] @ value) + pairs))), rel=1e-4)


def test_quality(spark, docs, no_docs):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeion") for _ in range(r.randint(2, 8)))
    good = [" ".join(word() for _ in range(50)) + "." for _ in range(150)]
    bad = [" ".join(word() + "***" for _ in range(50)) for _ in range(150)]
    made = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 150), 0) for k in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.op7_quality(made, labels).collect()
    held = [x for x in out if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in out)
    assert sum(x.predicted == (x.doc_id < 150) for x in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out)
    awkward = quality.op7_quality(docs, labels)
    assert awkward.count() == docs.count()
    kept = quality.keep_good(made.withColumn("score", F.lit("clash")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and {r.score for r in kept.collect()} == {"clash"}
    assert quality.op7_quality(no_docs, labels).count() == 0
    assert {x.score for x in quality.op7_quality(made, labels.limit(0)).collect()} == {0.5}


def test_scores_by_all_pairs_of_features(spark, docs):
    """The whole query against plain loops over every pair of features."""
    r = random.Random(9)
    made = [(k, " ".join(r.choice(["sea", "Wind", "rain!", "x9", "##"]) for _ in range(r.randint(1, 12))), r.randint(0, 90)) for k in range(60)] + [(100, "", 0), (101, None, None)]
    df = spark.createDataFrame(made, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, int("sea" in (made[k][1] or ""))) for k in range(60)], "doc_id long, quality int")
    machine = quality.train(df, labels)
    got = {x.doc_id: x.score for x in quality.op7_quality(df, labels).collect()}
    for doc_id, text, n_chars in made:
        raw = (text or "").encode()
        stats = [*quality.statistics(raw, raw.split()), float(np.log1p(n_chars or 0))]
        words = {zlib.crc32(w.lower()) % (1 << quality.WORD_BITS) for w in raw.split()}
        active = {b: 1 / np.sqrt(len(words)) for b in words}
        for k, x in enumerate(stats):
            active[(1 << quality.WORD_BITS) + k * quality.BINS + sum(e < x for e in machine.edges[k])] = 1.0
        total = machine.bias + sum(float(machine.weights[i]) * v for i, v in active.items())
        for (i, v), (j, w) in itertools.combinations(active.items(), 2):
            total += float(machine.factors[i].astype(float) @ machine.factors[j].astype(float)) * v * w
        assert got[doc_id] == pytest.approx(1 / (1 + np.exp(-total)), abs=2e-4), text


def test_metadata_is_a_feature(spark):
    r = random.Random(2)
    made = spark.createDataFrame([(k, " ".join(r.choices(["ab", "cd", "ef"], k=20)), 50 if k % 2 else 5000, "bad" if k == 4 else str(k)) for k in range(400)], "doc_id long, text string, n_chars long, extra string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int")
    out = [x for x in quality.op7_quality(made, labels).collect() if x.held_out]
    assert sum(x.predicted == x.doc_id % 2 for x in out) >= 0.97 * len(out)
    machine = quality.train(made, labels, metadata=("extra", "no such column"))
    assert quality.classify(made, machine).where("score BETWEEN 0 AND 1").count() == 400


def test_held_out_labels_do_not_teach(spark):
    made = spark.createDataFrame([(k, "x " * (k % 7 + 1)) for k in range(60)], "doc_id long, text string")
    a = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    b = a.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(quality.op7_quality(made, a), "doc_id", "score") == rows(quality.op7_quality(made, b), "doc_id", "score")


# -- 8 -------------------------------------------------------------------
def test_html_main_text(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>"
        "<article><h1>A &amp; B</h1><p><b>One<br>two<p>Three &copy; &lt;x&gt;</p><div class='ad-box ad'>Buy now</div><p>Last</p><section class='comments'><p>Nice</p></section></article>"
        "<aside>More</aside><form><input value=x><p>Mail</p></form><footer>2020</footer>"
    )
    cases = [(1, page), (2, None), (3, ""), (4, "<p>plain"), (5, "<nav><a href=x>only menu</a></nav>"), (1, page)]
    df = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, h in cases], "page_id long, url string, html string, text string")
    got = rows(html_text.op8_html_text(df), "page_id", "url", "text", "n_chars")
    text = "A & B\nOne two\nThree © <x>\nLast"
    assert got == [(1, "u1", text, len(text))] * 2 + [(2, "u2", "", 0), (3, "u3", "", 0), (4, "u4", "plain", 5), (5, "u5", "", 0)]
    assert html_text.op8_html_text(df.limit(0)).count() == 0
    assert html_text.main_text("<p>" + "x " * 200_000 + "<p>end").endswith("end")


_TEXT = "It was a long day for the crew, and the harbour lay still under the rain until the evening boats came in."


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="main-content has-sidebar"><p>{_TEXT}</p><p>{_TEXT}</p></div>', [_TEXT, _TEXT]),
        (f'<div class="page no-sidebar"><main><p>{_TEXT}</p><p>ok</p></main></div>', [_TEXT, "ok"]),
        (f'<form id="aspnetForm"><div id="content"><h1>Title</h1><p>{_TEXT}</p></div></form>', ["Title", _TEXT]),
        (f'<div class="post tag-search"><p>{_TEXT}</p></div>', [_TEXT]),
        (f'<article><header class="entry-header"><h1>Title</h1></header><p>{_TEXT}</p></article>', ["Title", _TEXT]),
        (f"<article><p>Let <math><mi>x</mi></math> be <label>the</label> rate.</p><p>{_TEXT}</p></article>", ["Let x be the rate.", _TEXT]),
        (f'<article><h2>Findings</h2><section id="discussion"><p>{_TEXT}</p></section><section class="comments"><p>{_TEXT}</p></section></article>', ["Findings", _TEXT]),
        (f'<div class="content-sidebar-wrap"><article><p>{_TEXT}</p></article><div class="sidebar"><p>{_TEXT}</p></div></div>', [_TEXT]),
        (f"<div><a href=a>Home</a></div><div>Topics</div><div><a href=b>Sport</a></div><div><h1>Rain</h1><p>{_TEXT}</p><p>Yes.</p></div>", ["Rain", _TEXT, "Yes."]),
        (f"<main><p>{_TEXT} <a href=x>more</a></p><nav><a href=1>One</a> <a href=2>two</a></nav></main><footer><p>{_TEXT}</p></footer>", [_TEXT + " more"]),
    ],
)
def test_html_parts_of_the_article_stay(page, want):
    assert html_text.main_text(page) == "\n".join(want)


def test_html_tree_learns_from_neighbours():
    tree = html_text.trained()
    assert {"words", "links", "words_before", "words_after", "links_before", "links_after"} <= tree.used()
    right = total = 0
    for page, labels in html_text.labelled_pages(2, seed=77):  # other texts and combinations than those it learnt from
        found = html_text.blocks(page)
        assert len(found) == len(labels)
        total += len(found)
        right += sum(tree.keeps(row) == (c == "m") for row, c in zip(html_text.describe(found), labels))
    assert right >= 0.98 * total


@pytest.mark.parametrize("unit", ["<div>", "<article>", "<nav><article>", "<b>", "<p><a>", "<li>", "</section>", "<div></section>"])
def test_html_blocks_take_linear_time(unit):
    import time

    def seconds(n):
        start = time.perf_counter()
        html_text.blocks(unit * n + "x" + "</i></section></b></div>" * n)
        return time.perf_counter() - start

    seconds(500)
    assert min(seconds(16_000) for _ in range(2)) < 12 * min(seconds(4_000) for _ in range(2)) + 0.05


def test_html_pages_of_the_table():
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    for page in pq.read_table(path)["html"].to_pylist():  # brute force: the article's markup, cut at block tags
        inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
        inside = re.sub(r"<!--.*?-->", "", re.sub(r'<div class="ad">.*?</div>', "<p>", inside, flags=re.S), flags=re.S)
        lines = re.split(r"</?(?:p|h1|h2|ul|li|div|table|tr|td)[^>]*>", inside.replace("<br>", " "))
        lines = [" ".join(html_text.entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in lines]
        assert html_text.main_text(page) == "\n".join(x for x in lines if x)


# -- 9 -------------------------------------------------------------------
def brute_lines(docs):
    strip = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders.setdefault(strip(line), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(strip(x)) < 10 or i is None or len(holders[strip(x)]) < 2 or min(holders[strip(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(docs, texts, no_docs):
    more = [(i, t) for i, t in texts]
    assert rows(line_dedup.op9_line_dedup(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(more)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "kept_text", "n_lines", "n_dropped"]
    assert line_dedup.op9_line_dedup(no_docs).count() == 0


def test_line_dedup_same_id_other_text(spark):
    df = spark.createDataFrame([(5, "a line of text\nfirst"), (5, "second\na line of text\nalso"), (2, "a line of text"), (None, "a line of text")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.kept_text) for r in line_dedup.dedup_lines(df).collect())
    assert got == [("2", "a line of text"), ("5", "first"), ("5", "second\nalso"), ("None", "a line of text")]


def test_clashing_columns_come_back_unchanged(spark):
    names = ["_t", "_d", "_dt", "_gone", "t", "d", "_first", "_keep", "first", "kept", "_quality", "score", "meta", "_digest", "_hash", "_doc", "_bytes", "content", "row", "key", "salt", "found", "low", "words", "own", "n"]
    texts = [(1, "a line of text\nfirst one here"), (2, "a line of text\nsecond"), (2, "a line of text\nsecond"), (3, None), (None, "")]
    df = spark.createDataFrame([(i, t, *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "nothing of this")], "item_id long, text string")
    whole = sorted(tuple(r[n] for n in names) for r in df.collect())
    outs = {
        "quality": quality.keep_good(df, labels.limit(0)), "classify": quality.classify(df, quality.train(df, labels), "p"), "lines": line_dedup.dedup_lines(df), "decontam": decontam.find_contamination(df, bench),
        "remove": decontam.remove_documents(df, bench), "counts": token_counts.count_tokens(df, tokenizer_path("byte_bpe_50k.json"), new_path(spark, "clash")),
        "licenses": licenses.scan_licenses(df.drop("score")),
    }
    for name, out in outs.items():
        have = names if name != "licenses" else [n for n in names if n != "score"]
        assert sorted(tuple(r[n] for n in have) for r in out.collect()) == sorted(tuple(x for n, x in zip(names, w) if n in have) for w in whole), name
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns and {tuple(r[n] for n in names) for r in kept.collect()} <= set(whole)


# -- 10 ------------------------------------------------------------------
def test_packing(spark):
    r = random.Random(8)
    lengths = [(k, r.choice([1, 5, 100, 511, 512, 513, 2000, 4096, 4097, 20_000])) for k in range(400)] + [(401, 0), (402, None), (7, 100), (None, 33)]
    out = packing.pack(spark.createDataFrame(lengths, "doc_id long, n_tokens long"), group=100).collect()
    bins, pieces = {}, {}
    for x in out:
        bins.setdefault(x.bin_id, []).append(x)
        pieces.setdefault(x.doc_id, []).append(x)
    for members in bins.values():
        members.sort(key=lambda x: x.bin_start)
        capacity, used = members[0].capacity, 0
        if capacity == 0:
            assert all(x.n_tokens == 0 for x in members)
            continue
        for x in members:
            assert x.bin_start == used and x.capacity == capacity
            used += x.n_tokens
        assert used <= capacity and all(c < used or c >= capacity for c in packing.CAPACITIES)  # downsized
    want = {}
    for i, n in lengths:
        want[i] = want.get(i, 0) + (n or 0)
    assert {i: sum(x.n_tokens for x in p) for i, p in pieces.items()} == want
    full = sum(x.n_tokens for x in out) / sum(m[0].capacity for m in bins.values())
    assert full > 0.9
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_packing_of_equal_rows(spark):
    df = spark.range(5000).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(100 AS LONG) AS n_tokens")
    out = packing.pack(df, group=500)
    groups = out.selectExpr("shiftright(bin_id, 32) AS g").groupBy("g").count().collect()
    assert len(groups) == 10 and max(r["count"] for r in groups) < 700
    assert out.agg(F.sum("n_tokens")).first()[0] == 500_000


def plain_best_fit(sizes, open_size, capacities):
    """Used space of each bin, looking through all bins for each piece."""
    bins = []
    for size in sorted(sizes, reverse=True):
        fitting = [b for b in bins if b[0] - b[1] >= size]
        if fitting:
            min(fitting, key=lambda b: b[0] - b[1])[1] += size
        else:
            bins.append([open_size if size <= open_size else min(c for c in capacities if c >= size), size])
    return sorted(used for _, used in bins)


def cheapest(sizes, capacities, overhead):
    """The least cost of any packing, by trying every way to put the pieces into bins."""
    best = [float("inf")]

    def place(k, used):
        cost = sum(min(c for c in capacities if c >= u) + overhead for u in used)
        if cost >= best[0]:
            return
        if k == len(sizes):
            best[0] = cost
            return
        for b in range(len(used)):
            if used[b] + sizes[k] <= capacities[-1]:
                place(k + 1, [*used[:b], used[b] + sizes[k], *used[b + 1 :]])
        place(k + 1, [*used, sizes[k]])

    place(0, [])
    return best[0]


def test_packing_by_brute_force():
    r = random.Random(12)
    capacities, overhead, ratio = [64, 128, 256], 8, []
    for _ in range(60):
        sizes = [r.randint(1, 256) for _ in range(r.randint(1, 7))]
        for open_size in (64, 128, 256, 0):
            found = packing.best_fit(sizes, open_size, capacities)
            assert sorted(i for b in found for i in b) == list(range(len(sizes)))
            assert sorted(sum(sizes[i] for i in b) for b in found) == plain_best_fit(sizes, open_size, capacities)
        cost = sum(c + overhead for c, _ in packing.pack_group(sizes, capacities, overhead))
        ratio.append(cost / cheapest(sizes, capacities, overhead))
    assert min(ratio) >= 1 and max(ratio) < 1.25 and sum(ratio) / len(ratio) < 1.02


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([60, 50, 40, 30, 20], 100, [100]) == [[0, 2], [1, 3, 4]]
    assert packing.pack_group([10], [16, 32], 2) == [(16, [0])]


def test_token_lengths(docs, texts):
    enc = Encoder(tokenizer_path("byte_bpe_50k.json"))
    want = sorted((i, len(enc.whole([t or ""])[0]) + 1) for i, t in texts)
    assert rows(packing.token_lengths(docs, tokenizer_path("byte_bpe_50k.json")), "doc_id", "n_tokens") == want
