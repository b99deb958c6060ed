import hashlib
import math
import random
import re
import textwrap

import pytest
from cases import DOCS, no_docs, odd_docs, prose
from pyspark.sql import functions as F

from songloom.llm import licences as l


@pytest.fixture(scope="module")
def texts():
    notices = {f"{f}/{i}": t for f in l.FAMILIES for i, (t, _, _) in enumerate(l.TEMPLATES[f])}
    rows = [(prose(40, i) + "\n" + t + "\n" + prose(20, i), [name.rpartition("/")[0]]) for i, (name, t) in enumerate(notices.items())]
    rows += [
        (prose(30, 50) + "\nThis code is Licensed under the Apache License, Version 2.0.", ["apache"]),
        ("Released under the MIT License.\n" + prose(9, 3) + "\nReleased under the MIT License.\nLicensed under CC BY 4.0.", ["cc-by", "mit"]),
        ("His driver license was released under the general law.\n" + prose(30, 51), []),
        ("The license version is 2.0 and the work is public.", []),
    ]
    return rows + [(prose(50, 100 + i), []) for i in range(200)]


def test_families_are_found_and_confirmed(spark, texts):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, (t, _) in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in l.scan(docs).collect()}
    assert {i: list(got[i]["families"]) for i in got} == {i: f for i, (_, f) in enumerate(texts)}
    assert got[[i for i, (_, f) in enumerate(texts) if f == ["cc-by", "mit"]][0]]["n_notices"] == 3


def test_wrapped_notices_of_each_family_are_found(spark, texts):
    """Wrapped at 40 characters, as plain lines or as comments, with prose right before and after."""
    rows = []
    for family in l.FAMILIES:
        longest = max((t for t, _, _ in l.TEMPLATES[family]), key=len)
        for mark in ("", "# ", " * "):
            lines = [mark + x for x in textwrap.wrap(longest, 40)]
            rows.append((prose(30, len(rows)) + "\n\n" + "\n".join(lines) + "\n\n" + prose(9, 7), [family]))
            rows.append((prose(9, len(rows)) + "\n" + "\n".join(lines) + "\n" + prose(9, 8), [family]))
    rows += texts
    docs = spark.createDataFrame([(i, t, None, None, None) for i, (t, _) in enumerate(rows)], DOCS)
    got = {r["doc_id"]: (list(r["families"]), r["n_notices"]) for r in l.scan(docs).collect()}
    wrapped = len(rows) - len(texts)
    assert [got[i] for i in range(wrapped)] == [(f, 1) for _, f in rows[:wrapped]]


def test_licences_next_to_each_other_are_told_apart(spark, texts):
    """Single notices, each the right family or none."""
    told = {
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.": "lgpl",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.": "agpl",
        "SPDX-License-Identifier: AGPL-3.0-or-later": "agpl", "SPDX-License-Identifier: LGPL-3.0-or-later": "lgpl",
        "Licensed under the Elastic License 2.0.": None, "Licensed under the Elastic License, Version 2.0.": None,
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "cc-by-nd",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc-sa",
        "SPDX-License-Identifier: GPL-2.0-only": "gpl-2", "SPDX-License-Identifier: BSD-2-Clause": "bsd-2", "Licensed under the ISC License.": "isc",
        "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa", "This work is licensed under the GNU General Public License, version 4.": None,
        "Licensed under the BSD 4-Clause License.": None, "Released under the NIT License.": None,
    }
    rows = [(prose(30, i) + "\n" + t + "\n" + prose(9, i), [f] if f else []) for i, (t, f) in enumerate(told.items())] + texts
    docs = spark.createDataFrame([(i, t, None, None, None) for i, (t, _) in enumerate(rows)], DOCS)
    got = {r["doc_id"]: list(r["families"]) for r in l.scan(docs).collect()}
    assert {t: got[i] for i, t in enumerate(told)} == {t: [f] if f else [] for t, f in told.items()}


def all_covering(text):
    """(paragraph, first line, last line) of every window that covers a template and lacks no
    needed gram, by trying all."""
    forms = [(l.template_grams(t), set(needs)) for f in l.FAMILIES for t, needs, _ in l.TEMPLATES[f]]
    found = []
    for number, part in enumerate(re.split(r"\n[^\w\n]*(?=\n)", text)):
        lines = [x for x in (re.findall(r"[a-z0-9]+", line.lower()) for line in part.split("\n")) if x]
        for start in range(len(lines)):
            for end in range(start, min(len(lines), start + l.longest())):
                words = sum(lines[start : end + 1], [])
                held = {*words, *map(" ".join, zip(words, words[1:]))}
                if any(needs <= held and len(held & g) >= math.ceil(l.COVERAGE * len(g)) for g, needs in forms):
                    found.append((number, start, end))
    return found


def test_no_covering_window_is_lost(spark):
    """Against all windows of all lines, on notices with words dropped, wrapped, and mixed with prose."""
    rng, rows = random.Random(4), []
    for name in l.FAMILIES:
        for text, _, _ in l.TEMPLATES[name]:
            for drop in (0, 0.1, 0.25):
                words = [w for w in text.split() if rng.random() >= drop]
                noise = prose(rng.randint(0, 6), len(rows)).split() + ["under", "the", "License"][: rng.randint(0, 3)]
                at = rng.randint(0, len(words))
                words = words[:at] + (noise if rng.random() < 0.4 else []) + words[at:]
                rows.append(prose(7, len(rows)) + "\n" * rng.randint(1, 2) + "\n".join(textwrap.wrap(" ".join(words), rng.choice([20, 45, 90]))) + "\n" + prose(8, 3))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(rows)], DOCS)
    got = {}
    for r in l.windows(docs.select("doc_id", "text")).select(F.hex("key").alias("k"), "number", "start", "end").collect():
        got.setdefault(r["k"].lower(), set()).add((r["number"], r["start"], r["end"]))
    total = 0
    for text in rows:
        mine, every = got.get(hashlib.md5(text.encode()).hexdigest(), set()), all_covering(text)
        assert mine <= set(every)
        for number, start, end in every:  # what is left out holds a smaller one
            assert any(n == number and start <= a and b <= end for n, a, b in mine)
        total += bool(every)
    assert total > len(rows) / 3


def test_odd_rows_and_empty_table(spark):
    assert l.scan(odd_docs(spark)).count() == 13
    assert l.scan(no_docs(spark)).collect() == []
