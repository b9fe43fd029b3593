"""License scans with DataFrame functions only: MinHash bands over text windows, then exact containment.

Method.  A text becomes lower-case words of [a-z0-9]; five in a row are a shingle
(a template with fewer words is one shingle of all).  Templates fall into classes
by size: 1, 4, 16 or 64 shingles, the largest that fits.  For each class a text is
cut into windows of that many shingles, overlapping by half; a template gives its
windows of that size at every start.  Where a copy has one and a half windows' shingles
or more, some window of the text lies wholly inside it whatever its place, and has the
same shingles as one of the template's, but for the words that were changed; of a
shorter template the best window shares three quarters of its shingles at least.
Each window has ``BANDS`` MinHash
values, one row a band; one equal value makes the template a candidate.  With
windows alike to degree s that is missed with probability (1 - s) ** BANDS: under
0.0014 at s = 2/3, which a containment of 0.8 implies for the mean window, and each
further window of a copy lowers it.  Candidates are verified exactly: the share of
the template's distinct shingles that the whole text holds.

Texts are first sieved by a test that loses nothing: a set of words so chosen that
a text without any of them cannot reach the threshold for any template.

All of this is decided row by row: no shuffle, no Python on the executors.  The
templates are a fixed list, so what is sent along as literals is bounded.

Defined results: null or empty text matches nothing; repeated rows are judged
each; several licenses in one text give a row each; an empty table gives an empty
result; nulls in other columns do not matter, as those are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch

# Public license notices, as their publishers word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""",
    "mit-line": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}
WORDS = 5
CLASSES = (64, 16, 4, 1)
BANDS = 6


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def shingles_of(text: str, k: int = WORDS) -> list[str]:
    w = words_of(text)
    return [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def sieve_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words such that a text without any of them holds less than the threshold of every template."""
    need = {}
    for name, text in templates.items():
        shingles = set(shingles_of(text))
        need[name] = (shingles, len(shingles) - threshold * len(shingles))  # more than so many must hold a chosen word
    chosen: list[str] = []

    def short(name: str) -> bool:
        shingles, most = need[name]
        return sum(any(w in s.split() for w in chosen) for s in shingles) <= most + 1e-9

    while left := [n for n in templates if short(n)]:
        options = sorted({w for n in left for s in need[n][0] for w in s.split()} - set(chosen))
        chosen.append(max(options, key=lambda w: (sum(any(w in s.split() for s in need[n][0]) for n in left) * min(len(w), 7), len(w), w)))
    return chosen


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, though the body's lambdas use it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shingle_hashes(text: Column) -> Column:
    def of(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (WORDS - 1), F.lit(1)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, WORDS), " ")))
        return F.when(F.size(words) > 0, hashes).otherwise(F.array().cast("array<bigint>"))

    return _let(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), of)


def _band_keys(hashes: Column, size: int, step: int) -> Column:
    """Hashes of (class, band, MinHash) for windows of ``size`` shingles, ``step`` apart."""
    bands = BANDS if size > 1 else 1
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - (size - step), F.lit(1)), F.lit(step))

    def window(i: Column) -> Column:
        part = F.slice(hashes, i, size)
        return F.array(*(F.xxhash64(F.lit(size), F.lit(b), F.array_min(F.transform(part, lambda h: F.xxhash64(h, F.lit(b))))) for b in range(bands)))

    return F.when(F.size(hashes) > 0, F.array_distinct(F.flatten(F.transform(starts, window)))).otherwise(F.array().cast("array<bigint>"))


def _class_of(n: int) -> int:
    return next(c for c in CLASSES if c <= n)


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")  # folded to a literal by the optimiser


def _prepared(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, int, list[int], list[int]]]:
    """For each template: name, class, shingle hashes and band keys, by the very expressions that texts go through."""
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("\\", "\\\\").replace("'", "\\'")) for n, t in templates.items())
    rows = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(name, text)").select("name", _shingle_hashes(F.col("text")).alias("h"))
    for c in CLASSES:
        rows = rows.withColumn(f"k{c}", _band_keys(F.col("h"), c, 1))
    out = []
    for r in rows.collect():  # the fixed list of templates
        c = _class_of(len(r["h"]))
        out.append((r["name"], c, sorted(set(r["h"])), sorted(r[f"k{c}"])))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, license, n_found, n_shingles, containment: a row for each text and template it holds."""
    templates = templates or TEMPLATES
    spark = docs.sparkSession
    known = _prepared(spark, templates)
    folded = F.lower("text")
    sieve = None
    for w in sieve_words(templates, threshold):
        sieve = folded.contains(w) if sieve is None else sieve | folded.contains(w)
    scratch = Scratch(spark, "licenses")
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).filter(sieve).select("doc_id", _shingle_hashes(F.col("text")).alias("h"))
    rows = scratch.save(rows, "shingles")  # of what the sieve left; written, so that no plan computes them twice
    every = _longs(sorted({k for _, _, _, keys in known for k in keys}))
    keys = F.flatten(F.array(*(_band_keys(F.col("h"), c, max(1, c // 2)) for c in CLASSES if any(x[1] == c for x in known))))
    rows = scratch.save(rows.withColumn("hits", F.array_intersect(keys, every)), "hits").filter(F.size("hits") > 0)
    scratch.drop("shingles")
    own = F.array_distinct("h")
    found = [
        F.when(F.arrays_overlap("hits", _longs(k)), F.struct(F.lit(name).alias("license"), F.size(F.array_intersect(own, _longs(h))).cast("long").alias("n_found"), F.lit(len(h)).cast("long").alias("n_shingles")))
        for name, _, h, k in known
    ]
    one = rows.select("doc_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("m"))
    share = F.col("m.n_found") / F.col("m.n_shingles")
    return one.filter(share >= threshold).select("doc_id", "m.license", "m.n_found", "m.n_shingles", F.round(share, 6).alias("containment"))


def oracle(templates: dict[str, str] | None = None, threshold: float = 0.8) -> str:
    """The same by brute force, as SQL: every shingle of every text against every template's."""
    rows = ", ".join(f"('{name}', '{s}', {len(set(shingles_of(text)))})" for name, text in (templates or TEMPLATES).items() for s in sorted(set(shingles_of(text))))
    return rf"""WITH t(license, s, n) AS (VALUES {rows}),
    w AS (SELECT rid, doc_id, [x for x in string_split_regex(lower(text), '[^a-z0-9]+') if x <> ''] AS w
          FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents WHERE text IS NOT NULL)),
    d AS (SELECT DISTINCT rid, doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS s
          FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0))
    SELECT doc_id, license, count(*) AS n_found, CAST(n AS BIGINT) AS n_shingles, round(count(*) / n, 6) AS containment
    FROM d JOIN t USING (s) GROUP BY rid, doc_id, license, n HAVING count(*) / n >= {threshold}"""
