"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from licence files.

Native: DataFrame functions only. Compared are single lines, paragraphs (without comment marks, so that
wrapped notices are whole), runs of paragraphs in the words of licenses, and the whole text of licence files. A
unit's weights are term counts times inverse document frequency over all lines of the corpus; terms that
no template has weigh like a term never seen. A line is compared with a notice only if the notice's terms that
it has could reach the threshold, which is exact: by Cauchy-Schwarz the cosine is at most the share of the
template's length that those terms make up. The same bound
decides which texts are cut into paragraphs at all, and it is computed only where a unit has one of the anchors of a
template: its rarest terms, without which the others can't reach the threshold.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, text_of, widen

# Short notices by which texts name their license.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0",
                   "This file is licensed under the Apache License, Version 2.0"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "This software is distributed under the MIT License"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3",
                "Licensed under the GNU General Public License version 3 or later", "Released under the GPL version 3"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "Released under the GPL version 2"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}
# Standard titles, headers and whole texts of licenses.
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as "
        "published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.")
_GNU_2 = _GNU.replace("software: you", "software; you").replace("either version {1}", "; either version {1}")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:")
_MIT_REST = (" The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
             "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
             "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
             "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
             "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.")
_BSD_NAME = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
             "from this software without specific prior written permission.")
_BSD_REST = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
             "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
             "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
             "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
             "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
             "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
           "You may obtain a copy of the License at")
_APACHE_REST = (" http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
                "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
                "for the specific language governing permissions and limitations under the License.")
LONG_TEMPLATES = {
    "AGPL-3.0": (_GNU.format("Affero ", 3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "Apache-2.0": (_APACHE, _APACHE + _APACHE_REST, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    "BSD-2-Clause": (_BSD + _BSD_REST, "BSD 2-Clause License"),
    "BSD-3-Clause": (_BSD + _BSD_NAME + _BSD_REST, "BSD 3-Clause License"),
    "GPL-2.0": (_GNU_2.format("", 2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "GPL-3.0": (_GNU.format("", 3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies.", "ISC License"),
    "LGPL-2.1": (_GNU_2.format("Lesser ", "2.1").replace("program", "library"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0": (_GNU.format("Lesser ", 3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "MIT": (_MIT, _MIT + _MIT_REST, "MIT License"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                  "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
}
# Names that a line of the form "SPDX-License-Identifier: name" gives.
SPDX = tuple("AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 EPL-2.0 GPL-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 "
             "LGPL-3.0 MIT MIT-0 MPL-1.1 MPL-2.0 Unlicense Zlib".split())


def long_templates() -> dict[str, tuple[str, ...]]:
    """Titles, headers, whole texts and identifier lines by license."""
    return {name: (*LONG_TEMPLATES.get(name, ()), *(f"SPDX-License-Identifier: {x}" for x in SPDX if x == name))
            for name in sorted({*LONG_TEMPLATES, *SPDX})}


THRESHOLD = 0.8
# Terms that a match shares with its template at least.
SHARED_TERMS = 2
# File names that hold the license of their directory and all below it.
LICENSE_FILE = r"(?i)^(un)?(licen[cs]e|copying)([._-].*)?$"
# Directories with a license that are broadcast at most.
BROADCAST_DIRS = 500_000


# What a line of a comment begins and ends with.
_MARK = r"^\s*(?:<!--|[#*;%!]+|//+|/\*+|--+|(?i:dnl|rem)(?=\s))\s?|\s*(?:\*+/|-->)\s*$"
_MARKED = r"^\s*(?:<!--|[#*;%!]|//|/\*|--)"

# What separates terms: ASCII characters other than letters and digits.
_BREAK = r"[\x00-/:-@\[-`{-\x7f]+"


def terms(text: Column) -> Column:
    """Lower-case runs of letters, digits and characters beyond ASCII; there may be an empty one at either end."""
    return F.split(F.lower(text), _BREAK)


def _terms(text: str) -> list[str]:
    import re
    return [t for t in re.split(_BREAK, text.lower()) if t]


def units_of(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """path, units: the whole text if the file is a licence file, else "", then the lines."""
    rows = files.select(files[path_col].alias("path"), files[text_col].alias("text")).select("path", text_of().alias("text"))
    whole = F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1).rlike(LICENSE_FILE)
    return rows.select("path", F.concat(F.array(F.when(whole, F.col("text")).otherwise("")), F.split("text", "\n")).alias("units"))


def _known(unit: Column, vocabulary: list[str]) -> Column:
    return F.array_distinct(F.filter(terms(unit), lambda t: t.isin(vocabulary)))


def document_frequencies(units: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """Lines that have each term of the templates, and lines in all; counted over the whole corpus.

    The vocabulary is that of the templates, so a bounded number of counts reaches the driver. The
    empty term stands for the line itself.
    """
    marked = F.transform(F.filter("units", lambda u: u != ""), lambda u: F.concat(F.array(F.lit("")), _known(u, vocabulary)))
    found = units.select(F.explode(F.flatten(marked)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c")).collect()
    counts = {r["term"]: r["c"] for r in found}
    return counts, counts.pop("", 0)


def score_units(units: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD,
                long: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """path, line (from 1, where the unit begins; 0 for a licence file's whole text), license and similarity of each
    unit's best template, where it reaches the threshold.

    A single shared term names no license. Ties go to the license that comes first by name. Lines are compared with `templates`; of texts without such a
    line but with enough terms of any template, the lines, paragraphs, runs and, for licence files, the whole
    with those and `long`.
    """
    long = long_templates() if long is None else long
    listed = [(name, text) for group in (templates, long) for name in sorted(group) for text in group[name]]
    vocabulary = sorted({t for _, text in listed for t in _terms(text)})
    frequency, total = document_frequencies(units, vocabulary)
    idf = {t: math.log((1 + total) / (1 + frequency.get(t, 0))) + 1 for t in vocabulary}
    unseen = math.log(1 + total) + 1
    every = []
    for name, text in listed:
        found = _terms(text)
        weight = {t: found.count(t) * idf[t] for t in sorted(set(found))}
        every.append((name, weight, math.sqrt(sum(w * w for w in weight.values()))))
    vectors = every[:sum(map(len, templates.values()))]
    # the explode holds each line's terms fixed: what follows reads them and doesn't split the line again
    least = _min_terms(vectors, threshold)
    anchors = [_anchors(weight, norm, frequency, threshold) for _, weight, norm in every]
    line_anchors = {t for found in anchors[:len(vectors)] for t in found}
    numbered = F.transform("units", lambda u, k: F.struct(k.alias("line"), u.alias("unit"), _known(u, vocabulary).alias("known")))
    rows = units.select("path", "units", numbered.alias("numbered"))
    rows = rows.select("path", "units", "numbered", F.array_distinct(F.flatten("numbered.known")).alias("all"))
    rows = rows.select("*", _anchored("all", anchors).alias("anchored"))
    text = F.struct(F.lit(-1).alias("line"), F.array_join(F.slice("units", 2, F.size("units")), "\n").alias("unit"), F.col("all").alias("known"))
    whole = F.when(_passes("all", "anchored", every, anchors, threshold), F.array(text)).otherwise(F.array().cast("array<struct<line:int,unit:string,known:array<string>>>"))
    rows = rows.select("path", F.explode(F.concat(F.filter("numbered", lambda s: (s["line"] > 0) & (F.size(s["known"]) >= least) & F.exists(
        s["known"], lambda t: t.isin(sorted(line_anchors)))), whole)).alias("at"))
    rows = rows.select("path", "at.line", "at.unit", "at.known")
    reach = [sum((F.when(F.array_contains("known", t), w * w).otherwise(0.0) for t, w in weight.items()), F.lit(0.0)) >= (threshold * norm) ** 2 * (1 - 1e-9)
             for _, weight, norm in vectors]
    possible = F.col("line") == -1
    for r in reach:
        possible = possible | r
    first = store(rows.where(possible).select("path", "line", "unit"), "license-candidates")
    by_line = store(_best_templates(first.where("line > 0").distinct(), vectors, idf, unseen, threshold), "license-by-line")
    rest = first.where("line = -1").join(by_line.select(F.col("path").alias("done")).distinct(), F.col("path") == F.col("done"), "left_anti")
    named = F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE)
    parts = store(blocks_of(rest.select("path", F.col("unit").alias("text")), vocabulary).where(F.size("known") >= SHARED_TERMS), "license-parts")
    parts = parts.select("*", _anchored("known", anchors).alias("anchored"))
    parts = parts.where(_passes("known", "anchored", every, anchors, threshold)).select("path", "line", "unit")
    parts = parts.unionByName(rest.where(named).select("path", F.lit(0).alias("line"), "unit"))
    wider = _best_templates(store(parts.distinct(), "license-units"), every, idf, unseen, threshold)
    return by_line.unionByName(wider)


def _best_templates(found: DataFrame, vectors: list, idf: dict[str, float], unseen: float, threshold: float) -> DataFrame:
    """path, line, license, similarity: the best template of each unit (path, line, unit) that reaches the threshold."""
    spark = found.sparkSession
    found = found.withColumn("h", F.xxhash64("path", "line", "unit"))
    idfs = _small(spark, [{"term": t, "idf": x} for t, x in idf.items()], "term string, idf double")
    entries = _small(spark, [{"term": t, "k": k, "share": w / norm} for k, (_, weight, norm) in enumerate(vectors) for t, w in weight.items()],
                     "term string, k int, share double")
    names = _small(spark, [{"k": k, "license": name} for k, (name, _, _) in enumerate(vectors)], "k int, license string")
    counts = found.select("h", F.explode(F.filter(terms(F.col("unit")), lambda t: t != "")).alias("term")).groupBy("h", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = counts.join(F.broadcast(idfs), "term", "left").select("h", "term", (F.col("tf") * F.coalesce("idf", F.lit(unseen))).alias("weight"))
    counts = store(counts, "license-vectors")
    lengths = counts.groupBy("h").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    dots = counts.join(F.broadcast(entries), "term").groupBy("h", "k").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"), F.count(F.lit(1)).alias("shared"))
    similar = dots.join(lengths, "h").join(F.broadcast(names), "k").withColumn("similarity", F.round(F.col("dot") / F.col("length"), 6))
    best = similar.where((F.col("similarity") >= threshold) & (F.col("shared") >= SHARED_TERMS)).groupBy("h").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b"))
    return found.join(best, "h").select("path", "line", F.col("b.license").alias("license"), (-F.col("b.s")).alias("similarity"))


def _small(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of what the templates hold, made without Python workers."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _anchors(weight: dict[str, float], norm: float, frequency: dict[str, int], threshold: float) -> list[str]:
    """Terms of a template without which the others can't reach the threshold, few and rare in the corpus."""
    left, chosen = 1.0, []
    for t in sorted(weight, key=lambda t: (frequency.get(t, 0) / weight[t] ** 2, -weight[t], t)):
        if left < threshold ** 2 * (1 - 1e-9) - 1e-9:
            break
        left -= (weight[t] / norm) ** 2
        chosen.append(t)
    return chosen


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{t}'" for t in words)


def _anchored(known: str, anchors: list[list[str]]) -> Column:
    """Those of the terms that are an anchor of any template."""
    return F.expr(f"filter({known}, t -> t IN ({_listed(sorted({t for found in anchors for t in found}))}))")


def _passes(known: str, anchored: str, vectors: list, anchors: list[list[str]], threshold: float) -> Column:
    """Whether the distinct terms of `known` make up enough of some template's length to reach the threshold.

    The sums run in SQL text, as expressions of hundreds of terms are slow to build one by one.
    """
    tests = []
    for (_, weight, norm), found in zip(vectors, anchors):
        shares = ", ".join(f"'{t}', {(w / norm) ** 2!r}D" for t, w in sorted(weight.items()))
        tests.append(f"arrays_overlap({anchored}, array({_listed(found)})) AND "
                     f"aggregate({known}, 0D, (s, t) -> s + coalesce(element_at(map({shares}), t), 0D)) >= {threshold ** 2 * (1 - 1e-9)!r}D")
    return F.expr(f"size({anchored}) > 0 AND ({' OR '.join(tests)})")


def blocks_of(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """path, line, unit, known of every line, paragraph and run of the texts (path, text).

    Paragraphs end at blank lines and where comment lines begin or end; comment marks are taken off. A run is
    a series of paragraphs of which each has at least as many distinct terms of templates as others.
    """
    lines = rows.select("path", F.xxhash64("path", "text").alias("h"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    lines = lines.dropDuplicates(["path", "h", "pos"]).select(
        "path", "h", (F.col("pos") + 1).alias("line"), F.trim(F.regexp_replace("raw", _MARK, "")).alias("unit"), F.col("raw").rlike(_MARKED).alias("marked"))
    ordered = Window.partitionBy("path", "h").orderBy("line")
    starts = (F.col("unit") == "") | (F.col("marked") != F.lag("marked", 1).over(ordered))
    lines = lines.withColumn("part", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(ordered)).where("unit != ''")

    def joined(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy("path", "h", *keys).agg(F.sort_array(F.collect_list(F.struct("line", "unit"))).alias("u")).select(
            "path", "h", *keys, F.col("u")[0]["line"].alias("line"), F.array_join("u.unit", " ").alias("unit"))
    paragraphs = joined(lines, "part").withColumn("known", _known(F.col("unit"), vocabulary))
    words = F.size(F.array_distinct(F.filter(terms(F.col("unit")), lambda t: t != "")))
    paragraphs = paragraphs.withColumn("alike", 2 * F.size("known") >= words)
    place = Window.partitionBy("path", "h").orderBy("line")
    runs = paragraphs.withColumn("n", F.row_number().over(place)).where("alike")
    runs = joined(runs.withColumn("run", F.col("n") - F.row_number().over(place)), "run")
    alone = lines.select("path", "line", "unit")
    both = alone.unionByName(runs.select("path", "line", "unit")).withColumn("known", _known(F.col("unit"), vocabulary))
    return both.unionByName(paragraphs.select("path", "line", "unit", "known"))


def _min_terms(vectors: list, threshold: float) -> int:
    """Fewest distinct terms by which any template can be reached."""
    least = 10 ** 9
    for _, weight, norm in vectors:
        mass, n = 0.0, 0
        for w in sorted(weight.values(), reverse=True):
            mass, n = mass + w * w, n + 1
            if mass >= (threshold * norm) ** 2 * (1 - 1e-9):
                break
        least = min(least, n)
    return least


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, the root "" last."""
    parts = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.reverse(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """License of every file: `path_col`, license, similarity, line, origin, from_path.

    origin is "header" if a line of the file itself matches a notice or else a wider part any template (the best, the
    first of equals; `line` is where it begins, 0 for a licence file's whole text), "inherited" if the nearest directory above that has a licence file with a
    match gives it (of several files there the best match, then the first by name), else "none". Null
    texts are empty; a null path has no directory; rows that repeat a path share the best match of them all
    and are returned each time; an empty table gives an empty result. Lines without a template term
    never leave the scan. Directories with a license are joined by broadcast up to a bound, else by shuffle.
    """
    paths = files.select(files[path_col].alias("path"))
    matched = store(score_units(units_of(widen(files), path_col, text_col), templates, threshold), "license-lines")
    best = F.max(F.struct("similarity", (-F.col("line")).alias("up"), "license")).alias("b")
    own = store(matched.groupBy("path").agg(best).select(
        F.col("path").alias("own_path"), F.col("b.license").alias("license"), F.col("b.similarity").alias("similarity"), (-F.col("b.up")).alias("line")), "license-own")
    name = F.element_at(F.split("own_path", "/"), -1)
    given = own.where(F.col("own_path").isNotNull() & name.rlike(LICENSE_FILE)).groupBy(directory(F.col("own_path")).alias("dir")).agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), F.col("own_path").alias("p"), F.col("license").alias("l"))).alias("g"))
    given = store(given.select("dir", F.col("g.l").alias("dir_license"), (-F.col("g.s")).alias("dir_similarity"), F.col("g.p").alias("from_path")), "license-dirs")
    fits = given.count() <= BROADCAST_DIRS
    lookup = paths.where("path is not null").groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    bare = lookup.join(own, lookup["path"] == own["own_path"], "left_anti")
    above = bare.select("path", F.posexplode(ancestors(F.col("path"))).alias("up", "dir"))
    nearest = above.join(F.broadcast(given) if fits else given, "dir").groupBy("path").agg(
        F.min(F.struct("up", "dir_license", "dir_similarity", "from_path")).alias("n"))
    nearest = store(nearest.select(F.col("path").alias("near_path"), "n.dir_license", "n.dir_similarity", "n.from_path"), "license-nearest")
    met = paths.join(own, paths["path"].eqNullSafe(own["own_path"]), "left").join(nearest, paths["path"] == nearest["near_path"], "left")
    origin = F.when(F.col("license").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return met.select(F.col("path").alias(path_col), F.coalesce("license", "dir_license").alias("license"),
                      F.coalesce("similarity", "dir_similarity").alias("similarity"), "line", origin.alias("origin"), "from_path")
