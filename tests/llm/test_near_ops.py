"""Operators that link or score: against brute force on small tables, or held-out rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from leafcutter.llm import common, embed_dedup, licenses, line_dedup, simhash, toxicity


def components(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    random.seed(1)
    pairs = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(0, i) for i in range(301, 400)] + [(i, i + 1) for i in range(400, 460)]
    got = dict(common.connected_components(spark.createDataFrame(pairs, "a long, b long")).distinct().collect())
    want = components(461, pairs)
    assert all(got.get(i, i) == want[i] for i in range(461))


def test_bit_majority():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 1, 2, 3, 255, 256, 700, 0])
    h = rng.integers(0, 2**64, int(lengths.sum()), dtype=np.uint64)
    got, at = common.bit_majority(h, lengths), 0
    for g, n in zip(got.tolist(), lengths.tolist(), strict=True):
        part = h[at : at + n].tolist()
        at += n
        assert g == sum((2 * sum(x >> b & 1 for x in part) > n) << b for b in range(64))


def naive_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def near_texts():
    random.seed(2)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [[random.choice(words) for _ in range(random.choice([1, 2, 40, 300]))] for _ in range(30)]
    texts = [None, "", " \n", "A b C", "a B c"]
    for b in base:
        texts.append(" ".join(b))
        for k in (1, 2, 8):
            c = list(b)
            for _ in range(k):
                c[random.randrange(len(c))] = random.choice(words)
            texts.append(" ".join(c))
    return texts + texts[-3:]


def test_simhash_components(spark):
    texts = near_texts()
    ids = [i if i != 7 else None for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fingerprint string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fp = [naive_fingerprint(t) for t in texts]
    root = components(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    best = {r: min((ids[i] for i in range(len(fp)) if root[i] == r and ids[i] is not None), default=None) for r in root}
    assert got == {(ids[i], f"{fp[i]:016x}", best[root[i]]) for i in range(len(fp))}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [20_000, 4])
@pytest.mark.parametrize("tau", [3, 10])
def test_pigeonhole_finds_all_pairs(spark, monkeypatch, tau, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(3)
    fps = []
    for b in rng.integers(0, 2**64, 12, dtype=np.uint64).tolist():
        for _ in range(25):
            x = b
            for k in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << k
            fps.append(x)
    f = np.unique(np.array(fps, dtype=np.uint64))
    signed = f.view(np.int64).tolist()
    root = components(len(f), [(i, j) for i in range(len(f)) for j in range(i) if int(f[i] ^ f[j]).bit_count() <= tau])
    df = spark.createDataFrame([(x, x) for x in signed], "node long, fp long")
    got = dict(common.connected_components(simhash.link_fingerprints(df, tau)).distinct().collect())
    sets = {}
    for x, r in zip(signed, root, strict=True):
        sets.setdefault(r, set()).add(got.get(x, x))
    assert all(len(s) == 1 for s in sets.values()) and len(set().union(*sets.values())) == len(sets)


def test_plan_covers_the_distance():
    rng = np.random.default_rng(4)
    sample = rng.integers(0, 2**64, 500, dtype=np.uint64)
    for tau in (3, 6, 10):
        for n in (1000, 10**6, 10**10):
            plan = simhash.plan_partitions(sample, n, tau)
            assert sum(t + 1 for _, t in plan) == tau + 1
            places = [p for g, _ in plan for p in g]
            assert len(places) == len(set(places))


def test_keep_one_per_group(spark):
    texts = near_texts()
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(5, texts[5], "en"), (None, texts[6], "en")], "doc_id long, text string, _node string")
    out = simhash.keep_one_per_group(df)
    assert out.columns == df.columns
    kept = [r.text or "" for r in out.collect()]
    sets = [set(simhash.shingle_hashes(t, 5)) for t in kept]
    fp = [naive_fingerprint(t) for t in kept]
    for i in range(len(kept)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = (both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)) and (fp[i] ^ fp[j]).bit_count() <= simhash.CANDIDATE_BITS
            assert not linked
    every = [(t or "", set(simhash.shingle_hashes(t, 5))) for t in texts]
    for t, s in every:  # whatever goes has a kept text close to something it was linked with
        assert t in kept or any(2 * len(s & k) >= len(s | k) * 0.6 for k in sets)


def contiguous_edits():
    """Pairs at a Jaccard similarity of 0.80 to 0.85: a passage appended, replaced, or repeated many times."""
    random.seed(12)
    words = ["".join(random.choice("abcdefghijklm") for _ in range(5)) for _ in range(5000)]
    pairs = []
    for k in range(90):
        w = [random.choice(words) for _ in range(300)]
        more = [random.choice(words) for _ in range(66)]
        if k % 3 == 0:
            v = w + more
        elif k % 3 == 1:
            v = w[:130] + more[:26] + w[156:]
        else:
            v = w[:50] * 6 + w
        pairs.append((" ".join(w), " ".join(v)))
    return pairs


def test_near_duplicates_by_kind_of_edit(spark):
    pairs = contiguous_edits()
    sets = [[set(simhash.shingle_hashes(x, 5)) for x in p] for p in pairs]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in sets)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(x for p in pairs for x in p)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one_per_group(df).collect()}
    for kind in range(3):
        assert sum(2 * i + 1 not in kept for i in range(kind, 90, 3)) >= 29, kind
    assert all(2 * i in kept for i in range(90))


def test_edit_distance():
    random.seed(6)
    for _ in range(500):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(0, 12))) for _ in "xy")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert line_dedup.edit_distance(a, b) == row[-1]


def test_line_signatures():
    texts = [None, "", "A  b\n a b \n\nA b|\nx", "Straße İ Σ\u2003y\nA b", "w" * 600 + "\n" + "w" * 600 + "!\n| | |", "a b\r"]
    row, nth, words = line_dedup.split_words(pa.array(texts))
    node, fp, has = line_dedup.signatures(words)
    got = {(int(r), int(k)): (int(x), int(f)) for r, k, x, f, h in zip(row, nth, node, fp, has, strict=True) if h}
    want = {(r, k): line_dedup.normalise(x) for r, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if line_dedup.normalise(x)}
    assert got.keys() == want.keys()
    for a in want:
        for b in want:
            assert (got[a][0] == got[b][0]) == (want[a] == want[b]), (want[a], want[b])
    again = line_dedup.signatures(pa.array([w.split(" ") for w in want.values()]))
    assert list(zip(again[0].tolist(), again[1].tolist(), strict=True)) == [got[a] for a in want]
    assert got[2, 0][1] == got[2, 3][1]  # a sign at the end of a word changes no feature


def test_line_dedup(spark):
    random.seed(7)
    words = ["".join(random.choice("abcdefg") for _ in range(6)) for _ in range(300)]
    lines = [" ".join(random.choice(words) for _ in range(30)) for _ in range(25)]
    near = [" ".join(w if k != 4 else "zzz" for k, w in enumerate(x.split(" "))) for x in lines[:12]]
    pool = [*lines, *near, "", "  ", "|", "A  b", "a b"]
    docs = [(i, "\n".join(random.choice(pool) for _ in range(6)), "x") for i in range(30)] + [(30, None, "x"), (31, "", "x"), (None, lines[0], "x"), (32, lines[20] + "\r", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _th string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    occ = {}
    for d, t, _ in docs:
        for k, x in enumerate((t or "").split("\n")):
            if n := line_dedup.normalise(x):
                occ.setdefault(n, []).append((d is None, d or 0, k))
    names = list(occ)
    fp = line_dedup.signatures(pa.array([n.split(" ") for n in names]))[1].tolist()
    root = components(len(names), [(i, j) for i in range(len(names)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3 and line_dedup.similar(names[i], names[j])])
    groups = {}
    for n, r in zip(names, root, strict=True):
        groups.setdefault(r, []).extend(occ[n])
    stay = {min(g) for g in groups.values()}
    for r in out.collect():
        t = next(t for d, t, _ in docs if d == r.doc_id)
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not line_dedup.normalise(x) or (r.doc_id is None, r.doc_id or 0, k) in stay)
        assert r.text == want
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def edited_lines():
    """Lines of 10 to 40 words, each with one copy: a word replaced, a letter changed, or words left out."""
    random.seed(11)
    words = ["".join(random.choice("abcdefghijklm") for _ in range(random.randint(3, 8))) for _ in range(3000)]
    pairs = []
    for n in (10, 20, 30, 40):
        for k in range(60):
            w = [random.choice(words) for _ in range(n)]
            v = list(w)
            i = random.randrange(n)
            if k % 3 == 0:
                v[i] = random.choice(words)
            elif k % 3 == 1:
                v[i] = v[i][:-1] + "z"
            else:
                del v[i : i + 1 + n // 20]
            pairs.append((" ".join(w), " ".join(v)))
    return [(a, b) for a, b in pairs if a != b and line_dedup.similar(a, b)]


def test_line_dedup_by_edit_similarity_alone(spark):
    pairs = edited_lines()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(x for p in pairs for x in p)], "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.dedup_lines(df, bits=None).where("text <> ''").collect()}
    assert all(2 * i in got for i in range(len(pairs)))  # the first of each pair stays
    assert sum(2 * i + 1 not in got for i in range(len(pairs))) >= 0.98 * len(pairs)
    assert line_dedup.dedup_lines(df.limit(0), bits=None).count() == 0


def test_embeddings(spark, sf):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(150).collect()]
    first = rows[0]
    odd = [(10_000, first[1], first[2]), (10_001, first[1], first[2]), (10_001, first[1], first[2]), (10_002, None, first[2]), (10_003, first[1], None), (10_004, first[1], [0.0] * 64), (10_005, first[1], [float("nan")] * 64), (10_006, first[1], [1.0]), (10_007, first[1], []), (None, first[1], first[2]), (10_008, first[1], [None] * 64)]
    rows += odd
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    usable = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    pairs = []
    for i, (_, a, v) in enumerate(rows):
        for j in range(i):
            _, b, w = rows[j]
            if a is not None and a == b and usable(v) and usable(w) and len(v) == len(w):
                v1, w1 = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if v1 @ w1 / np.sqrt((v1 @ v1) * (w1 @ w1)) >= 0.93:
                    pairs.append((i, j))
    root = components(len(rows), pairs)
    links = [sum(i in p for p in pairs) for i in range(len(rows))]
    best = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    want = sorted(((rows[i][0], links[i], best[root[i]]) for i in range(len(rows))), key=str)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_embeddings(df).collect()), key=str)
    assert got == want
    assert embed_dedup.near_embeddings(df.limit(0)).count() == 0


def test_segments_are_the_maximal_ones():
    def brute(s, off=0):
        best = max(((sum(s[i : j + 1]), -i, -j) for i in range(len(s)) for j in range(i, len(s))), default=None)
        if best is None or best[0] <= 1e-9:
            return []
        i, j = -best[1], -best[2]
        return brute(s[:i], off) + [(i + off, j + off)] + brute(s[j + 1 :], off + j + 1)

    rng = np.random.default_rng(8)
    for _ in range(200):
        s = np.where(rng.random(rng.integers(1, 20)) < 0.4, rng.normal(1, 2, 1), 0) * rng.random()
        s = np.where(s != 0, s + rng.normal(0, 1, len(s)), 0)
        got = [(a, b) for a, b, _ in toxicity.segments([(i, float(v)) for i, v in enumerate(s) if v], 0.3)]
        assert got == brute(list(s - 0.3))


def test_toxicity(spark):
    random.seed(9)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(400):
        w = [random.choice(words) for _ in range(80)]
        bad = i % 4 == 0
        if bad:
            for k in range(20, 50, 5):
                w[k] = "zork" + random.choice(["a", "ing", "ed"])
        docs.append((i, " ".join(w[:40]) + "\n" + " ".join(w[40:]), "zorka"))
        labels.append((i, int(bad)))
    docs += [(None, None, None), (1000, "", None), (1001, "\n", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (4, 1)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert all((got[i].score >= 0.3) == bool(y) for i, y in labels)
    assert got[1000].score < 0.3 and got[None].score == got[1000].score
    p = got[0].passages[0]
    assert p["first"] <= 20 and p["last"] >= 45 and p["expected"] < 1
    assert toxicity.drop_toxic(d, model).count() == 300 + 3
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = toxicity.fit(d, lab.limit(0))
    assert all(r.score < 1e-6 for r in toxicity.score(d, empty).collect())
    assert toxicity.score(d.limit(0), model).count() == 0


def test_licenses(spark):
    files = [
        ("LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", 1),
        ("a/x.py", "# Licensed under the Apache License, Version 2.0.\n" + "code " * 30, 2), ("a/y.py", "code", 3), ("b/COPYING", "This work is licensed under the GNU General Public License, version 3.", 4), ("b/c/z.py", None, 5),
        (None, "Released under the MIT License.", 6), ("b/c/z2.py", "mit der lizenz " * 2000, 7),
    ]
    df = spark.createDataFrame(files, "path string, text string, license_ long")
    got = {r.license_: (r.direct_license, r.license, r.inherited_from, r.status) for r in licenses.scan_licenses(df).collect()}
    assert got == {
        1: ("MIT", "MIT", None, "direct"), 2: ("Apache-2.0", "Apache-2.0", None, "direct"), 3: (None, "MIT", "", "inherited"), 4: ("GPL-3.0", "GPL-3.0", None, "direct"),
        5: (None, "GPL-3.0", "b", "inherited"), 6: (None, None, None, "none"), 7: (None, "GPL-3.0", "b", "inherited"),
    }
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_lines_between_three_quarters_and_four_fifths(spark):
    files = [("a/LICENSE", "MIT License\n\nCopyright (c) 2020 Someone"), ("a/b/x.py", "code")]
    got = {r.path: (r.direct_license, r.license) for r in licenses.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["a/LICENSE"] == ("MIT", "MIT") and got["a/b/x.py"] == (None, "MIT")


WRAPPED = {
    "gpl/a.c": ("GPL-3.0", "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint x;"),
    "bsd/a.go": ("BSD-3-Clause", "// Copyright 2009 The Authors.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\npackage x"),
    "bsd2/a.c": ("BSD-3-Clause", "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n\ncode"),
    "mit/COPYING": ("MIT", "Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"),
    "apache/LICENSE": ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    "gpl/COPYING": ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies"),
}


def test_wrapped_licenses(spark):
    files = [(p, x) for p, (_, x) in WRAPPED.items()] + [("mit/src/a.py", "code"), ("other/a.py", "code\nfree\nfile")]
    got = {r.path: (r.direct_license, r.license) for r in licenses.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: got[p][0] for p in WRAPPED} == {p: name for p, (name, _) in WRAPPED.items()}
    assert got["mit/src/a.py"] == (None, "MIT") and got["other/a.py"] == (None, None)


def test_license_anchors_lose_no_line(spark):
    t = licenses.Templates()
    for _, _, v in t.vectors:
        rest = sum(x * x for w, x in v.items() if w not in t.anchors)
        assert math.sqrt(rest) < licenses.THRESHOLD


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(p.STAGES):
        out = common.cut(stage(spark, docs, sf))
        if k < len(p.STAGES) - 1:
            assert out.columns == columns, name
        docs = out
    assert 0 < docs.count() <= 3 * n and docs.where("n_tokens <> size(ids)").count() == 0
    assert docs.where(F.col("n_tokens") > 0).count() > 0


def test_edit_distance_with_a_limit():
    random.seed(9)
    for _ in range(300):
        a = "".join(random.choice("abc") for _ in range(random.randint(0, 90)))
        b = "".join(random.choice("abc") for _ in range(random.randint(0, 90)))
        n, limit = line_dedup.edit_distance(a, b), random.randint(0, 60)
        assert line_dedup.edit_distance(a, b, limit) == min(n, limit + 1)
        assert line_dedup.similar(a, b, 0.6) == (n <= math.floor(0.4 * max(len(a), len(b)) + 1e-9))


def test_nearest_forest_joins_what_is_close():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, 30) for c in (0, 5, 9)])
    a, b = map(np.array, zip(*[(i, j) for i in range(90) for j in range(i)], strict=True))
    d = np.abs(x[a] - x[b])
    at = common.nearest_forest(90, a, b, d)
    assert len(at) == 89 and len(set(common.local_roots(90, a[at], b[at]).tolist())) == 1
    near = at[d[at] < 2]  # inside the clusters, each joined by its own links
    assert len(set(common.local_roots(90, a[near], b[near]).tolist())) == 3
    assert not len(common.nearest_forest(3, a[:0], b[:0], d[:0]))


def test_filter_lets_all_wanted_through(spark):
    rng = np.random.default_rng(5)
    wanted, other = rng.integers(-(2**63), 2**63, 500), rng.integers(-(2**63), 2**63, 2000)
    bits = common.filter_of(spark.createDataFrame([(int(x),) for x in wanted], "h long"), "h").value
    assert common.passes(bits, wanted).all() and common.passes(bits, other).mean() < 0.01
    assert not common.passes(common.filter_of(spark.createDataFrame([], "h long"), "h").value, wanted).any()


def test_hot_keys_meet_all_the_same(spark, monkeypatch):
    pairs = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(20)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = sorted(map(tuple, common.connected_components(edges).distinct().collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "HOT_SHARE", 0.2)
    assert sorted(map(tuple, common.connected_components(edges).distinct().collect())) == want


CLASHES = ["Score", "_declared", "_up", "license", "status", "_js", "_j1", "_j2", "_k2", "_t2", "_wk", "_wt", "_th", "_lost", "_node", "_dir", "_path", "_key2"]


def test_extra_columns_of_any_name(spark):
    from leafcutter.llm import mixing

    df = spark.createDataFrame([(1, "a b c\nsame line here", "s", "d/LICENSE"), (2, "same line here", None, "d/x"), (None, None, "s", None)], "doc_id long, text string, source string, path string")
    wide = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    assert [r.text for r in line_dedup.dedup_lines(wide, bits=None).orderBy("doc_id").collect()] == [None, "a b c\nsame line here", ""]
    for got in (line_dedup.dedup_lines(wide), simhash.keep_one_per_group(wide), mixing.mix(wide)):
        assert got.columns == wide.columns and got.count() >= 2
    scanned = licenses.scan_licenses(wide)
    assert len({c.lower() for c in scanned.columns}) == len(scanned.columns) and scanned.count() == 3
    assert mixing.mix_plan(wide, size=mixing.n_words(F.col("text"))).count() == 3


def test_license_words_of_all_rows_of_a_path(spark):
    line = "Licensed under the Apache License, Version 2.0."
    rows = [("d/a", line), ("d/a", "word " * 500), ("d/a", "word " * 500), ("d/b", "nothing"), ("e/a", line), ("e/a", line), ("e/b", "nothing")]
    got = {r.path: (r.license, r.status) for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"d/a": ("Apache-2.0", "direct"), "d/b": (None, "none"), "e/a": ("Apache-2.0", "direct"), "e/b": ("Apache-2.0", "inherited")}


def test_many_distances_at_once():
    rng = random.Random(8)

    def edited(x, k, letters):
        x = list(x)
        for _ in range(k):
            p = rng.randrange(len(x) + 1)
            x[p : p + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        return "".join(x)

    for letters, length in [("ab", 0), ("ab", 63), ("abcdefgh ", 64), ("aé漢\U0001f600 bcd", 65), ("abcdefgh ", 700), ("abc ", line_dedup.MANY_LENGTH + 5)]:
        base = ["".join(rng.choice(letters) for _ in range(length)) for _ in range(3)]
        lines = base + [edited(b, int(length * f), letters) for b in base for f in (0, 0.1, 0.2, 0.3, 0.4)]
        left, right = (np.array(x) for x in zip(*[(i, j) for i in range(len(lines)) for j in range(i)], strict=True))
        want = [line_dedup.similar(lines[i], lines[j]) for i, j in zip(left, right, strict=True)]
        assert line_dedup.similar_many(lines, left, right).tolist() == want


def test_waiting_pairs_are_all_checked(spark, monkeypatch):
    # unlike members first, so that the links of a member come after its failures
    monkeypatch.setattr(common, "TURN", 3)
    rows = [(1, i, 0, f"{i % 4}") for i in range(60)]
    tiled = common.tile_groups(spark.createDataFrame(rows, "grp long, id long, fp long, item string"), "grp", "id")

    def many(items, left, right):
        return np.array([items[i] == items[j] for i, j in zip(left, right, strict=True)], dtype=bool)

    got = common.verify_groups(tiled, "grp", "id", "fp", 0, lambda t: t.column("item").to_pylist(), lambda x, y: x == y, None, many)
    roots = dict(common.connected_components(got).distinct().collect())
    assert [roots.get(i, i) for i in range(60)] == [i % 4 for i in range(60)]


def test_settled_checks_few_pairs_of_a_group_and_all_between_groups():
    # 200 items of two groups: a chain of links is enough inside, every pair between them is looked at
    items = [k % 2 for k in range(200)]
    left, right = (np.array(x) for x in zip(*[(i, j) for i in range(200) for j in range(i)], strict=True))
    seen = []

    def many(x, a, b):
        seen.extend(zip(a.tolist(), b.tolist(), strict=True))
        return np.array([x[i] == x[j] for i, j in zip(a, b, strict=True)], dtype=bool)

    assert common.settled(items, left, right, np.abs(left - right), many).tolist() == items
    assert len(seen) == len(set(seen)) and sum(items[i] == items[j] for i, j in seen) < 2 * 200
    assert sum(items[i] != items[j] for i, j in seen) == 100 * 100
    seen.clear()
    assert common.settled(items, left, right, np.abs(left - right), many, np.array(items)).tolist() == items
    assert len(seen) == 100 * 100 and all(items[i] != items[j] for i, j in seen)


def test_few_links_are_connected_without_a_shuffle(spark):
    edges = common.cut(spark.createDataFrame([(k, k + 1) for k in range(500)] + [(900, 901), (5, None)], "a long, b long"))
    got = common.connected_components(edges)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(k, 0) for k in range(501)] + [(900, 900), (901, 900)]


def test_large_groups_of_lines_meet_only_where_something_is_open(spark, monkeypatch):
    random.seed(12)
    words = ["".join(random.choice("abcdefghijklm") for _ in range(random.randint(3, 8))) for _ in range(400)]
    bases = [[random.choice(words) for _ in range(30)] for _ in range(3)]
    lines = []
    for base in bases:
        other = base[:15] + [random.choice(words) for _ in range(15)]
        lines += [" ".join(w if random.random() > 0.04 else random.choice(words) for w in random.choice([base, other])) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(lines)], "doc_id long, text string")
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, bits=None).collect()}
    dealt, across = [], line_dedup.across_tiles

    def counted(*args):
        dealt.append((args[0].count(), across(*args).count()))
        return across(*args)

    monkeypatch.setattr(line_dedup, "across_tiles", counted)
    monkeypatch.setattr(common, "TILE", 4)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df, bits=None).collect()} == want
    # before, each member met all of its group's tiles with its text
    assert all(n < members * 4 for members, n in dealt) and len(dealt) == 1


def test_candidates_of_lines_are_the_same_in_any_order(spark, monkeypatch):
    """Ties between pairs of a bucket were decided by the order in which rows arrived."""
    random.seed(8)
    rows = [(b, n, random.choice([7, 8, 11, 1 << 40, -1])) for b in range(40) for n in random.sample(range(1000), random.choice([1, 2, 5, 90]))]
    rows += [(99, n, 5) for n in range(300)]
    got = []
    for most in (simhash.MOST, 150):
        monkeypatch.setattr(simhash, "MOST", most)
        for _ in range(2):
            random.shuffle(rows)
            parts = [np.array(rows[k : k + 50], dtype=np.int64) for k in range(0, len(rows), 50)]
            batches = [b for p in parts for b in simhash.packed([p], 3)]
            df = spark.createDataFrame([(r["share"], r["rows"]) for b in batches for r in b.to_pylist()], "share int, rows binary")
            found = [(r.a, r.b) for r in simhash.links_in_packed(df, 3, 200).collect()]
            assert [a for a, b in found if b is None] == [99]
            got.append(sorted(x for x in found if x[1] is not None))
    assert got[0] == got[1] == got[2] == got[3]
    keyed = spark.createDataFrame([(b, 0, n, fp) for b, n, fp in rows if b != 99], "bucket long, part int, node long, fp long")
    want = [(r.a, r.b) for r in simhash.links_in_buckets(keyed, 3, None, True).collect()]
    assert len(got[0]) == len(want)
    assert components(1000, got[0]) == components(1000, want)


def test_lines_normalised_with_and_without_words(spark):
    texts = ["A b\nC", None, "", " a", "a ", "a  b", "a\n\nb", "\n", "a \nb", "a\n b", "x\ty\r", "é È", "漢 字 x", "a", " ", "b\n"]
    for part in (pa.array(texts), pa.array(texts).slice(3), pa.array(texts[:1]), pa.array(texts[3:4])):
        row, nth, lines = line_dedup.normal_lines(part)
        want = {(r, k): line_dedup.normalise(x) for r, t in enumerate(part.to_pylist()) for k, x in enumerate((t or "").split("\n"))}
        assert dict(zip(zip(row.tolist(), nth.tolist(), strict=True), lines.to_pylist(), strict=True)) == want


def test_distances_look_at_a_window_only():
    """A column had a bit for each character of a line, and pairs of one batch of rows only were decided together."""
    random.seed(4)
    base = ["".join(random.choice("abcdefgh ") for _ in range(n)) for n in (90, 400, 1500)]
    lines = [x for b in base for x in (b, b[5:] + b[:5], b[len(b) // 6 :], b[: len(b) * 9 // 10], b[len(b) // 9 :] + b[: len(b) // 9], b[::-1])]
    left, right = (np.array(x) for x in zip(*[(i, j) for i in range(len(lines)) for j in range(i)], strict=True))
    for similarity in (0.6, 0.8, 0.95):
        want = [line_dedup.edit_distance(lines[i], lines[j]) <= math.floor((1 - similarity) * max(len(lines[i]), len(lines[j])) + 1e-9) for i, j in zip(left, right, strict=True)]
        assert line_dedup.similar_many(lines, left, right, similarity).tolist() == want
    tables = [pa.table({"x": [k] * 5}) for k in range(7)]
    assert [t.num_rows for t in common.gathered(iter(tables), 12)] == [15, 15, 5]
    assert [t.num_rows for t in common.gathered(iter(tables), 0)] == [5] * 7


def test_digits_keep_every_pair_with_enough_equal_minima(spark):
    """Candidates without enough minima in common went through two joins before they were dropped."""
    rng = np.random.default_rng(9)
    n, width = line_dedup.KEYS * line_dedup.ROWS, 8 + line_dedup.KEYS * line_dedup.ROWS * line_dedup.WIDTH
    marks = rng.integers(0, 256, (60, width), dtype=np.uint8)
    marks[:, :8] = 0  # all within the SimHash's distance
    for k in range(1, 60):  # each takes over some minima of the one before
        for at in rng.choice(n, k % (n + 1), replace=False):
            place = slice(8 + line_dedup.WIDTH * at, 8 + line_dedup.WIDTH * (at + 1))
            marks[k, place] = marks[k - 1, place]
    b = pa.RecordBatch.from_arrays([pa.array([m.tobytes() for m in marks], pa.binary())], ["mark"])
    digits, low = line_dedup._digits(b), line_dedup.minima(pa.chunked_array([b.column(0)]))
    left, right = np.triu_indices(60, 1)
    equal = (low[left] == low[right]).sum(axis=1)
    found = simhash.equal_digits(digits[left], digits[right], n)
    assert (found >= equal).all() and (found < line_dedup.AGREE)[equal == 0].mean() > 0.9
    rows = np.stack([np.zeros(60, dtype=np.int64), np.arange(60), np.zeros(60, dtype=np.int64), digits], axis=1)
    got = spark.createDataFrame([(r["share"], r["rows"]) for p in simhash.packed([rows], 2) for r in p.to_pylist()], "share int, rows binary")
    kept, whole = ({(r.a, r.b) for r in simhash.links_in_packed(got, 3, 200, x).collect()} for x in ((n, line_dedup.AGREE), (n, 0)))
    assert kept == {(x, y) for x, y in whole if simhash.equal_digits(digits[[x]], digits[[y]], n)[0] >= line_dedup.AGREE} and len(kept) < len(whole) == 59
