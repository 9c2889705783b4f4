import math
import os
import re
import textwrap
from collections import Counter

import pytest

from sparkvec.llm import licenses as L

FILES = [
    ("a/LICENSE", "Released under the MIT License.\nMore words here"),
    ("a/b/COPYING.txt", "Licensed under the Apache License, Version 2.0"),
    ("a/b/c/code.py", "no statement\nat all"),
    ("a/x.py", "text"),
    ("a/y.py", "# Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
    ("a/z.py", "Released the under of a License MIT the the words go on and on so that nothing matches"),
    ("top.py", None), ("q/none.py", ""), (None, "Released under the MIT License"), ("a/x.py", "text"), ("/abs/LICENSE", "nothing"),
    ("long/t.py", "word " * 5000 + "\nthis work is licensed under the gnu general public license, version 3"),
]


MARKED = ("<!--", "#", "*", ";", "%", "!", "//", "/*", "--")


def bare(line):
    line = re.sub(r"\s*(\*+/|-->)\s*$", "", re.sub(r"^\s*(<!--|[#*;%!]+|//+|/\*+|--+)\s?", "", line))
    return line.strip(" ")


def blocks(text, vocabulary):
    """Lines, paragraphs and runs with the number of the line where each begins."""
    out, paragraphs, open_, last = [], [], False, None
    for k, raw in enumerate(text.split("\n"), 1):
        line, marked = bare(raw), raw.lstrip().startswith(MARKED)
        if line:
            out.append((k, line))
            if open_ and marked == last:
                paragraphs[-1][1].append(line)
            else:
                paragraphs.append((k, [line]))
        open_, last = bool(line), marked
    run = []
    for k, lines in [*paragraphs, (0, [])]:
        found = set(L._terms(" ".join(lines)))
        out.append((k, " ".join(lines)))
        if lines and 2 * len(found & vocabulary) >= len(found):
            run.append((k, " ".join(lines)))
        else:
            out += [(run[0][0], " ".join(x for _, x in run))] if run else []
            run = []
    return [(k, u) for k, u in out if u]


def brute(files):
    every = [(name, x) for group in (L.TEMPLATES, L.long_templates()) for name in sorted(group) for x in group[name]]
    vocabulary = {t for _, x in every for t in L._terms(x)}
    named = lambda p: re.match(r"(?i)^(un)?(licen[cs]e|copying)([._-].*)?$", (p or "").split("/")[-1])
    lines = [(p, k, u) for p, t in files for k, u in enumerate([(t or "") if named(p) else "", *(t or "").split("\n")]) if u]
    df = Counter(t for p, k, u in lines for t in set(L._terms(u)) & vocabulary)
    total = len(lines)
    idf = {t: math.log((1 + total) / (1 + df[t])) + 1 for t in vocabulary}
    weigh = lambda c: {t: n * idf.get(t, math.log(1 + total) + 1) for t, n in c.items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    vectors = [(name, v, norm(v)) for name, x in every for v in [weigh(Counter(L._terms(x)))]]
    short = sum(map(len, L.TEMPLATES.values()))
    best = {}

    def score(units, vectors, found):
        for p, k, u in set(units):
            w = weigh(Counter(L._terms(u)))
            for name, v, length in vectors:
                s = round(sum(w.get(t, 0) * x for t, x in v.items()) / ((norm(w) * length) or 1), 6)
                if s >= L.THRESHOLD and len(w.keys() & v.keys()) >= 2:
                    found[p] = min(found.get(p, (0, 0, "")), (-s, k, name))
    score([x for x in lines if x[1]], vectors[:short], best)
    wider = {}
    score([x for x in lines if not x[1]] + [(p, k, u) for p, t in files for k, u in blocks(t or "", vocabulary)], vectors, wider)
    return {**wider, **best}


def test_matches_brute_force_and_inherits(spark):
    docs = spark.createDataFrame([(p, t, "clash", 1) for p, t in FILES], "path string, text string, license string, line int")
    got = L.scan(docs).collect()
    assert len(got) == len(FILES)
    want = brute(FILES)
    for r in got:
        if r["origin"] == "header":
            s, k, name = want[r["path"]]
            assert (r["license"], r["line"]) == (name, k) and abs(r["similarity"] + s) < 2e-6
        else:
            assert r["path"] not in want
    by = {r["path"]: (r["license"], r["origin"], r["from_path"]) for r in got}
    assert by["a/b/c/code.py"] == ("Apache-2.0", "inherited", "a/b/COPYING.txt")
    assert by["a/x.py"] == ("MIT", "inherited", "a/LICENSE")
    assert by["a/y.py"][:2] in {("CC-BY-NC-4.0", "header"), ("MIT", "header")}
    assert by["top.py"] == by["q/none.py"] == by["/abs/LICENSE"] == (None, "none", None)
    assert by["long/t.py"][0] == "GPL-3.0" and by[None][0] == "MIT"


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def code(template, width=60, mark="# "):
    return "\n".join(mark + x for x in textwrap.wrap(template, width)) + "\nimport os\n\ndef run():\n    return os.name"


FULL = "Copyright (c) 2021 Some Body\n\n" + L._MIT + "\n\n" + L._MIT_REST.strip()
HEADERS = {
    "w/apache.py": (code("Copyright 2020 The Authors. " + L._APACHE + L._APACHE_REST), "Apache-2.0"),
    "w/short.c": ("/*\n * Licensed under the Apache License,\n * Version 2.0\n */\nint x;", "Apache-2.0"),
    "w/gpl3.c": ("/* " + code(L._GNU.format("", 3), 50, " * ").replace("\nimport", " */\nimport", 1), "GPL-3.0"),
    "w/gpl2.py": (code(L._GNU_2.format("", 2)), "GPL-2.0"),
    "w/lgpl.py": (code(L._GNU.format("Lesser ", 3)), "LGPL-3.0"),
    "w/mpl.js": (code(L.LONG_TEMPLATES["MPL-2.0"][0], 40, "// "), "MPL-2.0"),
    "w/spdx.py": ("# SPDX-License-Identifier: MIT\nx = 1", "MIT"),
    "m/LICENSE": ("MIT License\n\n" + FULL, "MIT"), "m2/README.md": ("# A tool\n\nSome words on it.\n\n" + FULL, "MIT"),
    "b2/LICENSE": ("Copyright 2001 A\n\n" + L._BSD + "\n\n" + L._BSD_REST.strip(), "BSD-2-Clause"),
    "b3/LICENSE": ("Copyright 2001 A\n\n" + L._BSD + "\n\n" + L._BSD_NAME.strip() + "\n\n" + L._BSD_REST.strip(), "BSD-3-Clause"),
    "n/one.py": ("# You may read the license of this file somewhere else.\nx = 1", None),
    "n/two.py": ("# SPDX-License-Identifier: LicenseRef-Own\nx = 2", None),
    "n/five.md": ("# Tool\n\n## License\n\nSee there.", None),
    "n/three.txt": ("The software is provided to the public by its authors, who hold the copyright.\n\nAll rights reserved.", None),
    "n/four.txt": ("Permission to park was hereby granted to any person.\nRedistribution of wealth is another matter.", None),
}


def test_headers_and_whole_texts(spark):
    other = [(f"o/{i}.txt", "\n".join(f"the words of a text that is here {i * 7 + k} and this any {k % 5}" for k in range(40))) for i in range(25)]
    files = [*((p, t) for p, (t, _) in HEADERS.items()), *other]
    got = {r["path"]: r for r in L.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: got[p]["license"] for p in HEADERS} == {p: want for p, (_, want) in HEADERS.items()}
    assert {r["license"] for p, r in got.items() if p.startswith("o/")} == {None}
    want = brute(files)
    assert {p for p, r in got.items() if r["origin"] == "header"} == set(want)
    for p, (s, k, name) in want.items():
        assert (got[p]["license"], got[p]["line"]) == (name, k) and abs(got[p]["similarity"] + s) < 2e-6


def test_licence_files_of_the_system(spark):
    folder = "/usr/share/common-licenses"
    kinds = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    here = {k: v for k, v in kinds.items() if os.path.exists(f"{folder}/{k}")}
    if not here:
        pytest.skip("no licence files")
    files = [(f"{k}/COPYING", open(f"{folder}/{k}", encoding="utf-8", errors="replace").read()) for k in here] + [(f"{k}/a.c", "int x;") for k in here]
    got = {r["path"]: (r["license"], r["origin"]) for r in L.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {**{f"{k}/COPYING": (v, "header") for k, v in here.items()}, **{f"{k}/a.c": (v, "inherited") for k, v in here.items()}}
