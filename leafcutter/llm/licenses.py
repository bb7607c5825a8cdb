"""Licence scans with DataFrame functions alone.

Every line of every file, every window of up to ten short lines (a notice is often wrapped) and every
licence file as a whole is compared with templates, notices and whole licence texts, by the cosine of sparse TF-IDF
vectors (weights from the templates; a word that no template has weighs as the rarest). A
line can reach the threshold only if it holds one of a template's anchors: words so heavy that
what remains of the template without them has a norm below the threshold. So a search for
anchors drops all other files and lines before any word is taken apart.

A file's direct licence is its best line's or window's. A file that is a licence file by name, or whose
matching lines hold at least ``DOMINANT`` of its words, declares its licence for its directory.
Files without a direct licence inherit from the nearest ancestor directory that declares
one: directories are joined with their own ancestors' paths, never files with files.

Defined cases: a null path or text has no direct licence, a null path no directory; rows with
equal path are one file (their lines together); equal scores are decided by template
name, equal declarations by words matched, licence, path; an empty table gives an empty result;
further columns are kept by ``scan_licenses``.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_names, table

THRESHOLD, DOMINANT = 0.75, 0.5
#: Lines that are joined for a notice wrapped over lines, where the first and the last hold a word of a template
#: other than ``COMMON``; a line of over WRAP characters is not wrapped.
WINDOWS, WRAP = (2, 3, 4, 5, 6, 8, 10), 200
FILE_NAMES = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"
WORD_CUT = r"[^a-z0-9.]+"

#: Words that prose of some language is full of.
COMMON = frozenset("a all an and any as at be but by can code copy file for form found free from if in is it like may mit nc no not of on or public sa source style subject terms that the this to under use v with without work you".split())

#: Short notices by licence.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "Proprietary and confidential. Unauthorized copying is prohibited."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES'
#: Heads of licence files, compared like the notices, and whole texts, compared with whole licence files.
HEADS = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
}
WHOLE = {"BSD-3-Clause": [f"BSD 3-Clause License Copyright (c) All rights reserved. {_BSD}"], "MIT": [_GRANT, f"MIT License Copyright (c) {_GRANT} {_NOTICE} {_AS_IS}"]}


def words_of(text: str) -> list[str]:
    import re

    return [w for w in (x.strip(".") for x in re.split(WORD_CUT, text.lower())) if w]


class Templates:
    """Unit TF-IDF vectors of the notices, idf of other words, anchors, and telling words (not common ones)."""

    def __init__(self, notices: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        rows = [(name, f"{name}#{i}", Counter(words_of(t))) for name, texts in sorted(notices.items()) for i, t in enumerate(texts)]
        df = Counter(w for _, _, c in rows for w in c)
        self.idf = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}
        self.other = math.log(1 + len(rows)) + 1
        # heads and whole texts give no weights
        for kind, more in (("head", HEADS), ("whole", WHOLE)):
            rows += [(name, f"{name}#{kind}{i}", Counter(words_of(x))) for name, texts in sorted(more.items()) for i, x in enumerate(texts)]
        self.vectors, self.whole = [], []
        anchors: set[str] = set()
        for name, place, c in rows:
            v = {w: n * self.idf.get(w, self.other) for w, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {w: x / norm for w, x in v.items()}
            (self.whole if "#whole" in place else self.vectors).append((name, place, v))
            if "#whole" in place:  # whole files are compared without a search
                continue
            left = 1.0
            # common words last; known anchors first, then long words, which prose holds least
            for w in sorted(v, key=lambda w: (w in COMMON, w not in anchors, -len(w), w)):
                if left < (threshold - 1e-6) ** 2:
                    break
                anchors.add(w)
                left -= v[w] ** 2
        self.anchors = sorted(anchors)
        self.telling = sorted({w for _, _, v in self.vectors for w in v} - COMMON)

    @property
    def stems(self) -> list[str]:
        """Anchors without those that hold another one: whatever holds an anchor holds a stem."""
        return [a for a in self.anchors if not any(b != a and b in a for b in self.anchors)]


def direct_licenses(files: DataFrame, path: str = "path", text: str = "text", templates: Templates | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(path, license, score, matched, words)``, one row per path with a licence line."""
    t = templates or Templates()
    spark = files.sparkSession

    def hit(c):
        # the array holds the text in lower case, once, for all searches
        return F.exists(F.array(F.lower(c)), lambda low: reduce(lambda a, b: a | b, [low.contains(x) for x in t.stems]))

    body = F.col(f"`{text}`")
    some = files.select(F.col(f"`{path}`").alias("p"), body.alias("x")).where(F.col("p").isNotNull() & hit(F.col("x")))
    word = F.lit(r"[^\x20\x09-\x0D]+")
    split = some.select("p", F.xxhash64("x").alias("row"), F.regexp_count("x", word).alias("all"), F.split("x", "\n").alias("ls"))
    telling = F.array(*[F.lit(w) for w in t.telling])
    tells = lambda x: (F.length(x) <= WRAP) & F.arrays_overlap(F.split(F.lower(x), WORD_CUT), telling)
    split = split.withColumn("hs", F.transform("ls", hit)).withColumn("ts", F.transform("ls", tells))
    named = F.regexp_extract("p", r"([^/]*)$", 1).rlike(FILE_NAMES)  # only of files with a stem
    size = F.size("ls")
    start = F.explode(F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at("hs", i) | F.element_at("ts", i)))
    many = F.array(F.lit(1), *[F.lit(w) for w in WINDOWS])

    def useful(i, w):
        # a window begins and ends with lines that hold a telling word, and has an anchor's stem
        wrapped = (i + w - 1 <= size) & F.element_at("ts", i) & F.try_element_at("ts", i + w - 1) & F.exists(F.slice("hs", i, w), lambda h: h)
        return F.when(w == 1, F.element_at("hs", i)).otherwise(wrapped & F.forall(F.slice("ls", i, w), lambda x: F.length(x) <= WRAP))

    windows = split.select("p", "row", "all", "ls", "hs", "ts", start.alias("at")).select("*", F.explode(F.filter(many, lambda w: useful(F.col("at"), w))).alias("span"))
    part = F.slice("ls", F.col("at"), F.col("span"))
    counts = lambda a: F.transform(a, lambda x: F.regexp_count(x, word))
    units = windows.select("p", "row", "all", "at", F.array_join(part, " ").alias("line"), counts(part).alias("longs"), F.lit(False).alias("whole"))
    # a licence file is compared as a whole too
    units = units.union(split.where(named & (size > 1)).select("p", "row", "all", F.lit(1), F.array_join("ls", " "), counts(F.col("ls")), F.lit(True)))
    tokens = F.filter(F.transform(F.split(F.lower("line"), WORD_CUT), lambda w: F.regexp_replace(w, r"^\.+|\.+$", "")), lambda w: w != "")
    units = units.select("p", "row", "all", "at", "longs", "whole", F.xxhash64("p", "row", "at", "line", "whole").alias("id"), F.explode(F.array(tokens)).alias("ws"))  # words are cut once
    # a cosine is at most the norm of what the template shares with the unit: units without an anchor as a
    # word (the stems were found inside words), or with too little of every template, cannot reach the threshold
    shares = F.array(*[F.array(*[F.struct(F.lit(w).alias("w"), F.lit(x * x).alias("m")) for w, x in sorted(v.items())]) for _, _, v in t.vectors])
    enough = lambda words: F.exists(F.array(words), lambda have: F.exists(shares, lambda v: F.aggregate(F.filter(v, lambda x: F.array_contains(have, x["w"])), F.lit(0.0), lambda m, x: m + x["m"]) >= (threshold - 1e-6) ** 2))
    known = F.array(*[F.lit(w) for w in sorted({w for _, _, v in t.vectors for w in v})])
    anchored = F.arrays_overlap("ws", F.array(*[F.lit(w) for w in t.anchors]))
    lines = cut(units.where(F.col("whole") | (anchored & enough(F.array_intersect("ws", known)))))
    # bounded by the templates, so they may be broadcast
    idf = F.broadcast(spark.createDataFrame([(w, x) for w, x in sorted(t.idf.items())], "w string, idf double"))
    vectors = F.broadcast(spark.createDataFrame([(n, k, w, x) for n, k, v in t.vectors + t.whole for w, x in sorted(v.items())], "license string, template string, w string, v double"))
    # a row read twice doubles all counts of its units, which leaves their cosines as they are
    counts = lines.select("id", F.explode("ws").alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias("tf"))
    weighed = counts.join(idf, "w", "left").select("id", "w", (F.col("tf") * F.coalesce("idf", F.lit(t.other))).alias("x"))
    weighed = cut(weighed)
    whole = lines.where("whole").select("id").distinct().withColumn("whole", F.lit(True))
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(vectors, "w").groupBy("id", "license", "template").agg(F.sum(F.col("x") * F.col("v")).alias("dot"))
    scored = dots.join(norms, "id").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    scored = scored.join(whole, "id", "left").where(F.col("whole") | ~F.col("template").contains("#whole"))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "template", "license")).alias("b")).select("id", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), F.col("b.template").alias("template"))
    found = cut(lines.select("p", "row", "at", "id", "all", "longs").join(best, "id").dropDuplicates(["id"]))
    # a line that stands in many matching windows counts once
    covered = found.select("p", "row", "at", F.posexplode("longs").alias("k", "long")).groupBy("p", "row", (F.col("at") + F.col("k")).alias("nth")).agg(F.max("long").alias("long"))
    matched = covered.groupBy("p").agg(F.sum("long").alias("matched"))
    top = found.groupBy("p").agg(F.min(F.struct((-F.col("score")).alias("s"), "template", "license")).alias("b"), F.max("all").alias("words"))
    # rows of one path are one file: its words are those of all its different rows, with or without a licence
    every = files.select(F.col(f"`{path}`").alias("p"), body.alias("x"))
    several = cut(every.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(top.select("p"), "p", "left_semi").select("p"))
    sums = every.join(several, "p").groupBy("p", F.xxhash64("x").alias("row")).agg(F.max(F.regexp_count("x", word)).alias("n")).groupBy("p").agg(F.sum("n").alias("sum"))
    top = top.join(matched, "p").join(sums, "p", "left").withColumn("words", F.coalesce("sum", "words"))
    return top.select(F.col("p").alias("path"), F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "matched", "words")


def parent(path):
    return F.when(path.isNotNull(), F.regexp_replace(path, r"/?[^/]*$", ""))


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", **how) -> DataFrame:
    """``files`` without the text, with direct_license, score, license, inherited_from, status (with
    ``_`` after a name that ``files`` has)."""
    rest = [c for c in files.columns if c != text]
    d, p2, own_, up_ = fresh_names(files.columns, "_dir", "_path", "_own", "_nearest")
    names = fresh_names(rest, "direct_license", "score", "license", "inherited_from", "status")
    direct = cut(direct_licenses(files, path, text, **how))
    declares = F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAMES) | (F.col("matched") >= DOMINANT * F.col("words"))
    declared = direct.where(declares).groupBy(parent(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("matched")).alias("m"), "license", "path")).alias("b")).select("dir", F.col("b.license").alias("declared"))
    declared = cut(declared)
    rows = files.select(*[F.col(f"`{c}`") for c in rest], parent(F.col(f"`{path}`")).alias(d))
    # each directory with its ancestors, itself included, the root last
    dirs = rows.select(F.col(d).alias("dir")).where(F.col("dir").isNotNull()).distinct()
    steps = F.split("dir", "/")
    chain = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("depth", "up"))
    nearest = chain.join(declared.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "declared", "up")).alias(up_)).withColumnRenamed("dir", d)
    own = direct.select(F.col("path").alias(p2), F.struct("license", "score").alias(own_))
    out = rows.join(own, F.col(f"`{path}`") == F.col(p2), "left").join(nearest, d, "left")
    direct_, near = F.col(f"{own_}.license"), F.col(f"{up_}.declared")
    mine = direct_.isNotNull()
    values = [direct_, F.col(f"{own_}.score"), F.coalesce(direct_, near), F.when(~mine, F.col(f"{up_}.up")), F.when(mine, "direct").when(near.isNotNull(), "inherited").otherwise("none")]
    return out.select(*[F.col(f"`{c}`") for c in rest], *[v.alias(n) for v, n in zip(values, names, strict=True)])


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files ``source/lang/doc_id``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return scan_licenses(docs).drop("path")
