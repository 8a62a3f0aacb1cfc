"""Licence scans by sparse TF-IDF cosine to templates and nearest-ancestor inheritance; DataFrame functions only.

Units of a text are its lines and its paragraphs of several lines (a header may be wrapped, and stand anywhere in a text;
whole texts are scanned), and for files named like LICENSE, LICENCE, COPYING, NOTICE or UNLICENSE also the whole text.
Words are runs of ASCII letters and digits in lower case. The weight of a word in a unit is 1 + ln of
its count, times ln((1 + N) / (1 + df)) + 1, where df counts the documents of the corpus that hold the word. A unit matches a template if
their cosine is at least the template's threshold; of several the highest cosine counts, then the smallest name.

A file's own licence is its best unit's. A file without one inherits that of the licence file in its nearest ancestor
directory that has one, found by joining the exploded ancestors of its path with the directories of licence files (the
best licence file of a directory, ties by path).

1. The documents that hold each word are counted over the corpus, words being counted on the map side first.
2. Of each template the heaviest words are anchors, so many that the others together cover less of its norm than its
   threshold asks for: by Cauchy and Schwarz a unit without any anchor cannot match. Texts without anchors are passed
   over, of the others the units with an anchor are written.
3. The words of those units are joined with their counts (broadcast up to BROADCAST words) and with the templates'
   vectors; norms and products are summed for each unit.

Edge cases: null and empty texts have no own licence but may inherit; null paths inherit nothing; repeated rows are
scanned each and share one result for equal (path, doc_id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

COSINE, NAMED, STRICT = 0.6, 0.68, 0.9
#: Rows of a table that may be broadcast (words with their weights; directories with their licences).
BROADCAST = 1_000_000
_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
#: What public licences say in their texts, and the headers that they propose.
TEMPLATES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("BSD-2-Clause", _BSD + " " + _BSD_WARRANTY),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _FREE.format("GNU General Public License", "2")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _FREE.format("GNU General Public License", "3")),
    ("LGPL-3.0", _FREE.format("GNU Lesser General Public License", "3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _FREE.format("GNU Affero General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide. CC0 1.0 Universal."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
)
#: Full names of licences in public lists, by which notices in words of their own are known; identifiers with hyphens are names too.
NAMES = (
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("MIT", "The MIT License"),
    ("BSD-2-Clause", "The 2-Clause BSD License"),
    ("BSD-3-Clause", "The 3-Clause BSD License"),
    ("ISC", "ISC License"),
    ("Zlib", "zlib License"),
    ("BSL-1.0", "Boost Software License 1.0"),
    ("GPL-2.0", "GNU General Public License version 2"),
    ("GPL-3.0", "GNU General Public License version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3"),
    ("AGPL-3.0", "GNU Affero General Public License version 3"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License version 2.0"),
    ("Unlicense", "The Unlicense"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "CC-BY-4.0"),
    ("CC-BY-SA-4.0", "CC-BY-SA-4.0"),
    ("CC-BY-NC-4.0", "CC-BY-NC-4.0"),
)
#: Identifiers of the public SPDX list; their lines must match almost word by word.
SPDX = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
#: Names of licence files.
FILE = r"(?i)(^|/)(un)?licen[cs]e[^/]*$|(^|/)(copying|notice)[^/]*$"
#: Lines between these are a paragraph.
_GAP = r"\n[\x20\t\r]*\n"


def template_rows() -> list[tuple[int, str, float, str]]:
    """(number, license, threshold, text) of all templates."""
    rows = [(name, COSINE, text) for name, text in TEMPLATES] + [(name, NAMED, text) for name, text in NAMES] + [(name, STRICT, f"SPDX-License-Identifier: {name}") for name in SPDX]
    return [(i, *r) for i, r in enumerate(rows)]


def _split(text):
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")


def words(text):
    """The words of a text, in order."""
    return F.array_remove(_split(text), "")


def _vectors(counts: DataFrame, n: int) -> list[tuple[int, str, float, str, float]]:
    """(template, license, threshold, word, unit weight); their number is bounded by the templates."""
    spark = counts.sparkSession
    rows = spark.createDataFrame(template_rows(), "template int, license string, threshold double, notice string")
    tf = rows.select("template", "license", "threshold", F.explode(words(F.col("notice"))).alias("word")).groupBy("template", "license", "threshold", "word").agg(F.count("*").alias("tf"))
    vocabulary = F.broadcast(tf.select("word").distinct())
    df = {r["word"]: r["df"] for r in counts.join(vocabulary, "word", "left_semi").collect()}
    raw = [(r["template"], r["license"], r["threshold"], r["word"], (1 + math.log(r["tf"])) * _idf(df.get(r["word"], 0), n)) for r in tf.collect()]
    square: dict[int, float] = {}
    for t, _, _, _, w in sorted(raw):
        square[t] = square.get(t, 0.0) + w * w
    return [(t, name, least, word, w / math.sqrt(square[t])) for t, name, least, word, w in sorted(raw)]


def _idf(df: int, n: int) -> float:
    return math.log((n + 1) / (df + 1)) + 1


def _anchors(vectors: list[tuple[int, str, float, str, float]]) -> list[str]:
    """Words of which a unit must hold one to reach some template's threshold."""
    by_template: dict[int, list[tuple[float, str, float]]] = {}
    for t, _, least, word, u in vectors:
        by_template.setdefault(t, []).append((u, word, least))
    out = set()
    for rows in by_template.values():
        rest = sum(u * u for u, _, _ in rows)
        for u, word, least in sorted(rows, reverse=True):
            if rest < least * least - 1e-9:
                break
            out.add(word)
            rest -= u * u
    return sorted(out)


def scan(files: DataFrame) -> DataFrame:
    """(doc_id, path, license, cosine, inherited_from) for each distinct (doc_id, path) of files (doc_id, path, text)."""
    spark = files.sparkSession
    rows = files.select(F.col("doc_id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    n = rows.count()
    counts = settle(rows.select(F.explode(F.array_distinct(_split(F.col("text")))).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("df")), "words")
    vectors = _vectors(counts, n)
    anchors = F.array(*map(F.lit, _anchors(vectors)))
    texts = rows.where(F.arrays_overlap(_split(F.col("text")), anchors))
    several = F.filter(F.split("text", _GAP), lambda p: F.instr(p, "\n") > 0)
    named = F.coalesce(F.col("path").rlike(FILE), F.lit(False))
    units = F.concat(F.split("text", "\n"), several, F.when(named, F.array("text")).otherwise(F.array().cast("array<string>")))
    found = texts.select("doc_id", "path", F.explode(units).alias("unit")).select("doc_id", "path", words(F.col("unit")).alias("words"))
    able = settle(found.where(F.arrays_overlap("words", anchors)).withColumn("unit", F.monotonically_increasing_id()), "units")
    # Words of units with their weights, then norms and products by unit.
    held = able.select("unit", F.explode("words").alias("word")).groupBy("unit", "word").agg(F.count("*").alias("c"))
    known = settle(counts.join(able.select(F.explode("words").alias("word")).distinct(), "word", "left_semi").select("word", (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")), "known")
    weighed = held.join(_small(known), "word").select("unit", "word", ((F.log("c") + 1.0) * F.col("idf")).alias("w"))
    templates = F.broadcast(spark.createDataFrame(vectors, "template int, license string, threshold double, word string, u double"))
    sides = weighed.join(templates, "word", "left")
    dots = sides.where("template is not null").groupBy("unit", "template").agg(F.first("license").alias("license"), F.first("threshold").alias("threshold"), F.sum(F.col("w") * F.col("u")).alias("dot"))
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    cosine = F.round(F.col("dot") / F.col("norm"), 9)
    near = dots.join(norms, "unit").withColumn("cosine", cosine).where("cosine >= threshold").groupBy("unit").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best"))
    own = able.select("unit", "doc_id", "path").join(near, "unit").groupBy("doc_id", "path").agg(F.min("best").alias("best"))
    own = own.select(F.col("doc_id").alias("d"), F.col("path").alias("p"), F.col("best.license").alias("license"), (-F.col("best.minus")).alias("cosine"))
    every = rows.select("doc_id", "path").distinct()
    return inherit(every.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("path").eqNullSafe(F.col("p")), "left").select("doc_id", "path", "license", "cosine"))


def _small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it is settled and has at most BROADCAST rows."""
    return F.broadcast(table) if table.count() <= BROADCAST else table


def ancestors(path):
    """(directory, depth) of all directories above a path, the root being the empty one."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"), i.alias("depth")))


def inherit(own: DataFrame) -> DataFrame:
    """Fills in licences from the licence file of the nearest ancestor directory; (doc_id, path, license, cosine).

    Directories with a licence are broadcast up to BROADCAST of them; beyond that both sides are salted, as every path has the root above it.
    """
    own = settle(own, "own")
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    declared = own.where(F.col("path").rlike(FILE) & F.col("license").isNotNull()).select(directory.alias("dir"), F.struct((-F.col("cosine")).alias("minus"), "path", "license").alias("file"))
    declared = settle(declared.groupBy("dir").agg(F.min("file").alias("file")), "declared")
    open_ = own.where(F.col("license").isNull() & F.col("path").isNotNull()).select("path").distinct().select("path", F.inline(ancestors(F.col("path"))))
    if declared.count() <= BROADCAST:
        met = open_.join(F.broadcast(declared), "dir")
    else:
        met = open_.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(64))).join(declared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))), ["dir", "salt"])
    # One row for each path and ancestor with a licence; the nearest is a maximum, aggregated on the map side.
    nearest = met.groupBy("path").agg(F.max(F.struct("depth", "file")).alias("from"))
    out = own.join(nearest, "path", "left")
    return out.select("doc_id", "path", F.coalesce("license", "from.file.license").alias("license"), "cosine", F.when(F.col("license").isNull(), F.col("from.file.path")).alias("inherited_from"))
