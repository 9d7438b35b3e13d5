"""Licences: cosine and inheritance against plain code."""

import math
import re
from collections import Counter

from ledgerloom.llm import licenses, registry
from tests.compare import same

FILES = "key long, path string, text string, license string, distance string, own_score int"


def words(block):
    return [w for w in re.split("[^a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in block)) if w]


def blocks(path, text):
    """Lines, paragraphs, comment runs, sentences of the first two, and a licence file as a whole."""
    cut = (text or "").split("\n")

    def runs(keep):
        out, run = [], []
        for line in [*cut, None]:
            if line is not None and keep(line):
                run.append(line)
            elif run:
                out.append("\n".join(run))
                run = []
        return out

    spans = cut + runs(lambda x: re.search("[a-zA-Z0-9]", x))
    marks = ("#", "//", "/*", "*", "--", ";", "%", "<!--")
    comments = runs(lambda x: x.lstrip(" \t").startswith(marks))
    sentences = [s for b in spans for s in re.split("[.!?;][ \t\n\r]+", b)]
    return {*spans, *comments, *sentences, *([text or ""] if re.search(licenses.LICENCE_FILE, path or "") else [])}


def brute(rows, least=0.6):
    wanted = [(k, Counter(words(t))) for k in sorted(licenses.TEMPLATES) for t in licenses.TEMPLATES[k]]
    vocabulary = {t for _, c in wanted for t in c}
    every = [line for _, _, text in rows for line in (text or "").split("\n")]
    df, n = Counter(), len(every)
    for b in every:
        df.update(set(words(b)) & vocabulary)
    idf = lambda t: (math.log((1 + n) / (1 + df[t])) if t in vocabulary else math.log(1 + n)) + 1
    norms = [math.sqrt(sum((m * idf(t)) ** 2 for t, m in w.items())) for _, w in wanted]

    def own(path, text):
        best = None
        for b in blocks(path, text):
            c = Counter(words(b))
            norm = math.sqrt(sum((m * idf(t)) ** 2 for t, m in c.items()))
            for i, ((name, w), size) in enumerate(zip(wanted, norms)):
                dot = sum(c[t] * m * idf(t) ** 2 for t, m in w.items())
                score = round(dot / norm / size, 6) if norm else 0
                if score >= least and (best is None or (-score, i, name) < best):
                    best = (-score, i, name)
        return (best[2], -best[0]) if best else (None, None)

    mine = [own(p, t) for _, p, t in rows]
    given = {}
    for (name, score), (_, path, _) in zip(mine, rows):
        if name and path is not None and re.search(licenses.LICENCE_FILE, path):
            d = path.rpartition("/")[0]
            given[d] = min(given.get(d, (1, "", "")), (-score, path, name))
    out = []
    for (key, path, _), (name, score) in zip(rows, mine):
        if name:
            out.append((key, path, name, score, name, path, 0))
            continue
        found = (None, None, None)
        if path is not None:
            d, k = path.rpartition("/")[0], 0
            while True:
                if d in given:
                    found = (given[d][2], given[d][1], k)
                    break
                if not d:
                    break
                d, k = d.rpartition("/")[0], k + 1
        out.append((key, path, None, None, *found))
    return sorted(out, key=str)


def examine(spark, rows):
    files = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], FILES)
    got = sorted(map(tuple, licenses.scan_licences(files, ["key"]).collect()), key=str)
    want = brute(rows)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all((g[3] is None) == (w[3] is None) and (g[3] is None or abs(g[3] - w[3]) < 2e-6) for g, w in zip(got, want))
    return got


def rows():
    prose = "some words of no importance, then more of them and the rest\nanother line that is this work"
    mit, apache = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["Apache-2.0"][0]
    return [
        (1, "a/LICENSE", mit),
        (2, "a/x.py", prose),
        (3, "a/b/c/y.py", prose),
        (4, "a/b/LICENSE.txt", f"{apache}\nmore\n{mit}"),
        (5, "a/b/c/z.py", f"# {apache.upper()}\n{prose}"),
        (6, "other/f", prose),
        (7, "copying", "This work is licensed under\nthe GNU General Public\nLicense, version 3."),
        (8, "q/r", None),
        (9, None, mit),
        (10, None, prose),
        (None, "a/x.py", prose),
        (None, "a/x.py", prose),
        (11, "a/COPYING", licenses.TEMPLATES["GPL-3.0"][0]),
        (12, "a/licensee/file", ""),
        (13, "/abs/file", "x " * 100_000),
        (14, "e/LICENSE", "nothing here"),
        (15, "é/LICENCE", "Licensed under CC BY-NC 4.0."),
        (16, "é/ü/f", prose),
    ]


def test_files(spark):
    got = {g[0]: g for g in examine(spark, rows()) if g[0] is not None}
    assert got[3][4:] == ("Apache-2.0", "a/b/LICENSE.txt", 1) and got[2][4] in ("MIT", "GPL-3.0")
    assert got[5][2] == "Apache-2.0" and got[6][4] == "GPL-3.0" and got[10][4] is None and got[9][2] == "MIT"
    assert got[16][4:] == ("CC-BY-NC-4.0", "é/LICENCE", 1)


def test_empty(spark):
    assert licenses.scan_licences(spark.createDataFrame([], FILES), ["key"]).count() == 0


def test_plan_is_native(spark):
    files = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows()], FILES)
    plan = licenses.own_licence(files)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query(spark, sf_dir):
    files = [tuple(r) for r in registry.repository(registry.table(spark, sf_dir, "documents")).collect()]
    got = sorted(map(tuple, registry.op2_licenses(spark, sf_dir).collect()), key=str)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in brute(files)]
    same(registry.op2_licenses(spark, sf_dir), registry.SQL["op2_licenses"], sf_dir)


APACHE = """# Copyright 2024 Some Company, Inc.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""
GPL = """/*
 * frob - a program that frobs
 * Copyright (C) 2019  A. Hacker
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
 */
int main(void) { return 0; }
"""


def wrapped(text, width=70, mark=""):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_real_licences(spark):
    """Standard headers and licence files as they occur, wrapped, in comments, with copyright lines and other text."""
    mit = licenses.TEMPLATES["MIT"][2]
    grant, rest = mit.split("conditions: ")
    mit_file = "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + wrapped(grant + "conditions:") + "\n\n" + wrapped(rest)
    bsd2, bsd3 = licenses.TEMPLATES["BSD-2-Clause"][0], licenses.TEMPLATES["BSD-3-Clause"][0]
    wanted = {
        "h/a.py": (APACHE, "Apache-2.0"),
        "h/b.c": (GPL, "GPL-3.0"),
        "h/c.c": (GPL.replace("version 3 of", "version 2 of"), "GPL-2.0"),
        "h/d.c": (GPL.replace("This program is free", "This library is free").replace("GNU General", "GNU Lesser General"), "LGPL-3.0"),
        "h/e.rs": ("// SPDX-License-Identifier: MIT\nfn main() {}", "MIT"),
        "h/f.py": ("# SPDX-License-Identifier: Apache-2.0\nx = 1", "Apache-2.0"),
        "h/g.txt": ("Copyright (c) 2020 Jane Doe. Released under the MIT License.", "MIT"),
        "h/h.txt": ("Copyright 2020 Foo Bar Inc. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        "h/i.c": ("/*\n" + wrapped("Copyright (c) 2011, The Authors. All rights reserved. " + bsd3, mark=" * ") + "\n */\nint x;", "BSD-3-Clause"),
        "l1/LICENSE": (mit_file, "MIT"),
        "l2/LICENSE": (mit_file.partition("\n\n")[2], "MIT"),
        "l3/LICENSE": ("Copyright (c) 2011, The Authors\n\n" + wrapped(bsd3), "BSD-3-Clause"),
        "l4/LICENSE": ("Copyright (c) 2011, The Authors\n\n" + wrapped(bsd2), "BSD-2-Clause"),
        "l5/COPYING": (" " * 20 + "GNU GENERAL PUBLIC LICENSE\n" + " " * 22 + "Version 3, 29 June 2007\n\n Everyone is permitted to copy this licence document.\n\n" + "The terms follow here at great length. " * 200, "GPL-3.0"),
        "l6/LICENSE.txt": (" " * 30 + "Apache License\n" + " " * 25 + "Version 2.0, January 2004\n" + " " * 22 + "http://www.apache.org/licenses/\n\n" + "1. Definitions and much more. " * 200, "Apache-2.0"),
        "l7/LICENSE.md": (wrapped(licenses.TEMPLATES["ISC"][0]), "ISC"),
        "n/prose.txt": ("We use the software, copy it and modify it without a notice.\nNothing here is licensed in any way that matters to us.", None),
        "n/blank": ("\n" * 50_000, None),
    }
    rows = [(i, path, text) for i, (path, (text, _)) in enumerate(wanted.items())]
    rows += [(100 + i, f"x/{i}", f"plain line {i} of other text\nand one more") for i in range(200)]
    got = {g[1]: g[2] for g in examine(spark, rows)}
    assert {p: got[p] for p in wanted} == {p: name for p, (_, name) in wanted.items()}


def test_scores_at_the_threshold(spark):
    """A cosine that is only rounded up to the threshold counts, by prefilter and by score alike."""
    rows = [(i, f"p{i}", "Released under the MIT License " + "word" * (i % 5) + " other" * (i % 4)) for i in range(40)]
    scores = sorted({r[3] for r in brute(rows, 0.0) if r[3]})
    for least in scores[1:4]:
        files = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], FILES)
        got = licenses.scan_licences(files, ["key"], least=least).where("own_license is not null").count()
        assert got == sum(r[3] is not None for r in brute(rows, least))
