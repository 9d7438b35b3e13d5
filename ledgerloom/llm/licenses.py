"""License scans with DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance from the nearest
ancestor directory by joins on paths.

A file is cut into blocks: its lines; paragraphs, which are runs of lines with a letter or digit; comment runs, which are
runs of lines that begin with a comment mark; the sentences of lines and paragraphs; and a licence file (LICENSE, LICENCE,
COPYING or UNLICENSE, with any extension) as a whole. Every block is a sparse vector of term frequency times idf. The idf
of a template's term comes from the lines of all files, idf(t) = ln((1 + lines) / (1 + lines with t)) + 1; terms of no
template can't match and weigh as a term of no line does. The best cosine of a file's blocks with any template, if it
reaches the threshold, gives the file's own licence. A file without one takes that of the nearest directory above it that
has a licence file with one.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged

_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'


def _gnu(what: str, name: str, version: str) -> str:
    return f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


#: SPDX identifiers and the published texts of each licence: whole ones where they are short, else the title
#: of the licence file and the standard header of source files; notices of one line.
_TEXTS: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _gnu("program", "Affero General Public License", "3")),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (f"{_GRANT} {_DISCLAIMER}", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License."),
    "BSD-3-Clause": (f"{_GRANT} {_NO_NAMES} {_DISCLAIMER}", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    "CC-BY-4.0": ("This work is licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0.", "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _gnu("program", "General Public License", "2")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _gnu("program", "General Public License", "3")),
    "ISC": ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _gnu("library", "Lesser General Public License", "2.1")),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _gnu("library", "Lesser General Public License", "3")),
    "MIT": ("Released under the MIT License.", _MIT, f"{_MIT} {_MIT_REST}"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
}
TEMPLATES = {name: (*texts, f"SPDX-License-Identifier: {name}") for name, texts in _TEXTS.items()}
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([.-][^/]*)?$"
SPLIT = "[^a-z0-9]+"
#: What ends a sentence, what a line needs to be part of a paragraph, and how a comment's line begins.
SENTENCE, WORDY, COMMENT = "[.!?;][ \t\n\r]+", "[a-zA-Z0-9]", r"^[ \t]*(#|//|/[*]|[*]|--|;|%|<!--)"
#: A-Z to lower case and nothing else, so that every engine cuts alike.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scores are rounded to so many decimals before they are compared.
DECIMALS = 6


def template_terms(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, Counter]]:
    """(name, terms) of every text, names in order."""
    return [(k, Counter("".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split())) for k in sorted(templates) for t in templates[k]]


def terms(block: Column) -> Column:
    return F.filter(F.split(F.translate(block, UPPER, LOWER), SPLIT), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def blocks(path: Column, text: Column) -> Column:
    """All blocks of a file, those that say nothing new left out."""
    runs = lambda cut, pattern: F.split(F.array_join(F.transform(cut, lambda x: F.when(x.rlike(pattern), x).otherwise("")), "\n"), "\n\n+")
    sentences = lambda spans: F.flatten(F.transform(spans, lambda x: F.split(x, SENTENCE)))
    whole = F.when(path.rlike(LICENCE_FILE), F.array(F.coalesce(text, F.lit("")))).otherwise(F.array().cast("array<string>"))
    some = let(lines(text), lambda cut: let(F.concat(cut, runs(cut, WORDY)), lambda spans: F.concat(spans, sentences(spans), runs(cut, COMMENT))))
    return F.array_distinct(F.concat(some, whole))


def idf(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """The templates' terms' idf over all lines of files, and that of a term of no line. As many rows reach the driver
    as the templates have terms."""
    held = F.transform(lines(F.col("text")), lambda x: F.array_distinct(F.filter(F.split(F.translate(x, UPPER, LOWER), SPLIT), lambda w: w.isin(vocabulary))))
    found = files.select(F.explode(F.concat(F.flatten(held), F.transform(lines(F.col("text")), lambda _: F.lit("")))).alias("t"))
    df = {r["t"]: r["n"] for r in found.groupBy("t").agg(F.count("*").alias("n")).collect()}
    n = df.pop("", 0)
    return {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}, math.log(1 + n) + 1


def heavier(share: dict[str, float], weights: dict[str, float], limit: float) -> set[str]:
    """Terms left when those of most lines (the least idf) whose shares together stay below the limit are taken away."""
    found, total = set(share), 0.0
    for t in sorted(share, key=lambda t: (weights[t], t)):
        if total + share[t] < limit:
            total += share[t]
            found.discard(t)
    return found


def own_licence(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """files (path, text and any others) with own_license and own_score, null where no block reaches the least cosine;
    equal scores go to the first name.

    The cosine with a template is at most the norm of the shared terms' part of the template over the template's norm
    (Cauchy and Schwarz). As many of a template's commonest terms as stay below the threshold together are left aside; a
    file or block without any of the others can't match, and only files and blocks with one are cut up and scored.
    """
    wanted = template_terms(templates)
    vocabulary = sorted({t for _, c in wanted for t in c})
    weights, other = idf(files, vocabulary)
    norms = [math.sqrt(sum((n * weights[t]) ** 2 for t, n in c.items())) for _, c in wanted]
    limit = max(0.0, least - 10.0**-DECIMALS) ** 2 - 1e-9
    heavy = sorted(set().union(*(heavier({t: (n * weights[t] / norm) ** 2 for t, n in c.items()}, weights, limit) for (_, c), norm in zip(wanted, norms))))
    # a term's squared idf, and its part of the product with every template; as JSON it is one literal to the planner
    parts = {t: {"w": weights[t] ** 2, "dots": [c[t] * weights[t] ** 2 / norm for (_, c), norm in zip(wanted, norms)]} for t in vocabulary}
    known = F.from_json(F.lit(json.dumps(parts)), "map<string, struct<w: double, dots: array<double>>>")

    def scored(words: Column) -> Column:
        """(score, place of the template) of a block's best template, the first of equal ones, from its sorted terms."""
        first = F.struct(F.lit("").alias("word"), F.lit(0).alias("n"), F.array().cast("array<struct<word:string,n:int>>").alias("runs"))
        done = lambda a: F.concat(a["runs"], F.array(F.struct(a["word"].alias("word"), a["n"].alias("n"))))
        runs = F.aggregate(
            F.filter(words, lambda w: w.isin(vocabulary)),
            first,
            lambda a, w: F.when(a["word"] == w, F.struct(w.alias("word"), (a["n"] + 1).alias("n"), a["runs"].alias("runs"))).otherwise(F.struct(w.alias("word"), F.lit(1).alias("n"), done(a).alias("runs"))),
            done,
        )
        inner = F.transform(F.filter(runs, lambda r: r["n"] > 0), lambda r: F.struct(r["n"].cast("double").alias("n"), F.element_at(known, r["word"]).alias("v")))
        empty = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
        # every other distinct term weighs `other`; squares of their frequencies come from runs of the sorted words
        rest = F.aggregate(
            F.filter(words, lambda w: ~w.isin(vocabulary)),
            empty,
            lambda a, w: F.when(a["word"] == w, F.struct(w.alias("word"), (a["n"] + 1.0).alias("n"), (a["sum"] + 2.0 * a["n"] + 1.0).alias("sum"))).otherwise(F.struct(w.alias("word"), F.lit(1.0).alias("n"), (a["sum"] + 1.0).alias("sum"))),
            lambda a: a["sum"],
        )

        def cosine(x: Column) -> Column:
            norm = F.sqrt(F.aggregate(x["inner"], F.lit(0.0), lambda a, r: a + r["n"] * r["n"] * r["v"]["w"]) + x["rest"] * F.lit(other * other))
            dots = F.aggregate(x["inner"], F.array_repeat(F.lit(0.0), len(wanted)), lambda a, r: F.zip_with(a, r["v"]["dots"], lambda d, y: d + r["n"] * y))
            best = let(norm, lambda n: F.array_min(F.transform(dots, lambda d, i: F.struct((-F.round(d / n, DECIMALS)).alias("score"), i.alias("place")))))
            return F.when(F.size(x["inner"]) > 0, best)

        return let(F.struct(inner.alias("inner"), rest.alias("rest")), cosine)

    heavy_words = F.array(*map(F.lit, heavy))
    some = F.arrays_overlap(terms(F.coalesce("text", F.lit(""))), heavy_words)
    likely = F.filter(blocks(F.col("path"), F.col("text")), lambda b: F.arrays_overlap(terms(b), heavy_words))
    scores = F.transform(F.when(some, likely).otherwise(F.array().cast("array<string>")), lambda b: let(F.array_sort(terms(b)), scored))
    out = files.withColumn("_top", F.array_min(F.filter(scores, lambda x: x.isNotNull())))
    good = -F.col("_top.score") >= least
    name = F.element_at(F.lit([k for k, _ in wanted]), F.col("_top.place") + 1)
    return out.withColumn("own_license", F.when(good, name)).withColumn("own_score", F.when(good, -F.col("_top.score"))).drop("_top")


def directory(path: Column) -> Column:
    """The path up to its last slash, without it; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan_licences(files: DataFrame, keys: list[str], templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """Every row of files (path, text and keys): keys, path, own_license, own_score, license, license_path, distance.

    license is the file's own, else the nearest ancestor directory's; license_path the file that it comes from and
    distance the directories between (0: itself or its own directory). Of a directory's licence files the best score
    wins, then the first path. Null and empty texts have no licence, rows with a null path inherit none; repeated rows are
    kept; an empty table gives an empty result; other columns, whatever their names, are not read. Inheritance is found once a directory, not once a file; a directory or a root
    that many share is a skewed key of a join of narrow rows, which adaptive execution splits.
    """
    renamed = files.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    own = staged(own_licence(renamed, templates, least).drop("text"), "licences").withColumn("_dir", directory(F.col("path")))
    given = own.where(F.col("own_license").isNotNull() & F.col("path").rlike(LICENCE_FILE))
    given = given.groupBy("_dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("from"), F.col("own_license").alias("name"))).alias("best"))
    given = given.select(F.col("_dir").alias("above"), "best.from", "best.name")
    places = own.where("path is not null and own_license is null").select("_dir").distinct()
    steps = F.split("_dir", "/")
    depth = F.when(F.col("_dir") == "", 0).otherwise(F.size(steps))
    up = places.select("_dir", F.explode(F.sequence(F.lit(0), depth)).alias("distance"))
    up = up.withColumn("above", F.array_join(F.slice(F.split("_dir", "/"), F.lit(1), F.size(F.split("_dir", "/")) - F.col("distance")), "/")).withColumn("above", F.when(F.col("_dir") == "", F.lit("")).otherwise(F.col("above")))
    near = up.join(given, "above").groupBy("_dir").agg(F.min(F.struct("distance", "from", "name")).alias("near"))
    rows = own.join(near.withColumnRenamed("_dir", "_d"), (F.col("_dir") == F.col("_d")) & F.col("own_license").isNull() & F.col("path").isNotNull(), "left")
    mine = F.col("own_license").isNotNull()
    return rows.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", "near.name").alias("license"),
        F.when(mine, F.col("path")).otherwise(F.col("near.from")).alias("license_path"),
        F.when(mine, F.lit(0)).otherwise(F.col("near.distance")).cast("long").alias("distance"),
    )
