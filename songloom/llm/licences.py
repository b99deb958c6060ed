"""Licence notices in documents: a trained paragraph classifier, confirmed by templates.

A paragraph (neighbouring lines with no blank line between them; lines of comment marks alone
are blank) is looked at in windows of one or more whole lines, so that wrapped notices are
found, and notices next to prose too. A window is described by its words and word pairs. A multinomial
logistic regression over the ones that occur in training gives each window a probability
per licence family and one for "unknown"; most of its weights are zero. The probabilities are calibrated on paragraphs kept out of training (a temperature on the
scores). A predicted family counts only if the window also covers most of one of the
family's templates, holds the words that it cannot lack ("lesser", "noncommercial", a version) and
none that make it another licence's; paragraphs and windows that cover none need no score. Of overlapping windows,
the one that ends first counts, and of these the shortest.

Training data are the templates with words dropped, with usual words before them and with text of
the corpus around them,
and, as unknown, lines of the corpus, templates without the words that tell them from others, and
phrases that merely speak of licences; the corpus sample is bounded by ``SAMPLE``. Scanning covers all paragraphs of all texts and uses
DataFrame functions only.

Null and empty texts have no paragraph; texts are known by a digest, so copies are scored
alike; repeated paragraphs are counted each; very long texts are read whole; an empty table gives no
rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.tables import saved

#: Usual notices of licence families, each with the words (or word pairs) it cannot
#: lack and those that make it another licence's.
_GPL_KIN = ("lesser general", "library general", "affero general")
_CC_KIN = {"nc": ("by nc", "attribution noncommercial"), "sa": ("by sa", "nc sa", "attribution sharealike", "noncommercial sharealike"),
           "nd": ("by nd", "nc nd", "attribution noderivatives", "attribution noderivs", "noncommercial noderivatives")}


def _cc(code: str, name: str, *kin: str) -> list[tuple[str, tuple, tuple]]:
    """Notices of a Creative Commons licence; ``kin`` are the conditions it does not have."""
    bars = tuple(gram for k in kin for gram in _CC_KIN[k])
    marks = [w for w in code.lower().split("-") if w != "by"]
    words = name.lower().split("-")
    return [
        (f"Licensed under CC {code} 4.0.", ("cc", "by", *marks), bars),
        (f"This work is licensed under a Creative Commons {name} 4.0 International License.", ("commons", *words), bars),
        (f"SPDX-License-Identifier: CC-{code}-4.0", ("spdx", "cc by", *marks), bars),
    ]


TEMPLATES = {
    "agpl": [
        ("This work is licensed under the GNU Affero General Public License, version 3.", ("affero", "gnu"), ()),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", ("affero", "gnu"), ()),
        ("SPDX-License-Identifier: AGPL-3.0-or-later", ("spdx", "agpl"), ()),
    ],
    "apache": [
        ("Licensed under the Apache License, Version 2.0.", ("apache",), ()),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", ("apache",), ()),
        ("SPDX-License-Identifier: Apache-2.0", ("spdx", "apache"), ()),
    ],
    "bsd": [
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ("redistribution", "binary"), ()),
        ("Licensed under the BSD 3-Clause License.", ("bsd", "3 clause"), ()),
        ("SPDX-License-Identifier: BSD-3-Clause", ("spdx", "bsd", "3 clause"), ()),
    ],
    "bsd-2": [
        ("Licensed under the BSD 2-Clause License.", ("bsd", "2 clause"), ()),
        ("SPDX-License-Identifier: BSD-2-Clause", ("spdx", "bsd", "2 clause"), ()),
    ],
    "cc-by": _cc("BY", "Attribution", "nc", "sa", "nd"),
    "cc-by-nc": _cc("BY-NC", "Attribution-NonCommercial", "sa", "nd"),
    "cc-by-nc-nd": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "sa"),
    "cc-by-nc-sa": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "nd"),
    "cc-by-nd": _cc("BY-ND", "Attribution-NoDerivatives", "nc", "sa"),
    "cc-by-sa": _cc("BY-SA", "Attribution-ShareAlike", "nc", "nd"),
    "cc0": [
        ("This work is dedicated to the public domain under CC0 1.0 Universal.", ("cc0", "universal"), ()),
        ("SPDX-License-Identifier: CC0-1.0", ("spdx", "cc0"), ()),
    ],
    "epl": [
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", ("eclipse",), ()),
        ("SPDX-License-Identifier: EPL-2.0", ("spdx", "epl"), ()),
    ],
    "gpl": [
        ("This work is licensed under the GNU General Public License, version 3.", ("gnu", "version 3"), _GPL_KIN),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", ("gnu general",), _GPL_KIN),
        ("SPDX-License-Identifier: GPL-3.0-or-later", ("spdx", "gpl 3"), ()),
        ("SPDX-License-Identifier: GPL-3.0-only", ("spdx", "gpl 3"), ()),
    ],
    "gpl-2": [
        ("This work is licensed under the GNU General Public License, version 2.", ("gnu", "version 2"), _GPL_KIN),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ("spdx", "gpl 2"), ()),
        ("SPDX-License-Identifier: GPL-2.0-only", ("spdx", "gpl 2"), ()),
    ],
    "isc": [
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", ("fee", "distribute"), ()),
        ("Licensed under the ISC License.", ("isc",), ()),
        ("SPDX-License-Identifier: ISC", ("spdx", "isc"), ()),
    ],
    "lgpl": [
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ("lesser", "gnu"), ()),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", ("lesser", "gnu"), ()),
        ("SPDX-License-Identifier: LGPL-3.0-or-later", ("spdx", "lgpl"), ()),
    ],
    "mit": [
        ("Released under the MIT License.", ("mit license",), ()),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", ("charge", "deal"), ()),
        ("SPDX-License-Identifier: MIT", ("spdx", "mit"), ()),
    ],
    "mpl": [
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla",), ()),
        ("SPDX-License-Identifier: MPL-2.0", ("spdx", "mpl"), ()),
    ],
    "unlicense": [
        ("This is free and unencumbered software released into the public domain.", ("unencumbered",), ()),
        ("SPDX-License-Identifier: Unlicense", ("spdx", "unlicense"), ()),
    ],
}
#: Phrases that speak of licences and are none.
OTHERS = [
    "He renewed his driver license at the public office under the new version of the law.",
    "The restaurant lost its license and was released under general conditions.",
    "A license fee is due for the use of the work in any form.",
    "The institute of technology released a new version of the source under review.",
    "Free software and public copies of the files are a general subject of the terms.",
    "The creative commons of the village is open to any person without restriction.",
    "All rights reserved.",
    "Permission to enter is granted to the following persons.",
    "Licensed under the Elastic License 2.0.",
    "This work is licensed under the European Union Public Licence, version 1.2.",
]
#: What often stands before a notice, whatever the licence.
LEADS = ["This code is", "This file is", "The software is", "All content of this work is", "This program is", "The text is"]
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
#: Bounds: corpus paragraphs in training, variants per template, grams in the model.
SAMPLE, VARIANTS, GRAMS = 3000, 40, 4096
#: A family needs this probability, and this share of a template's grams in the paragraph.
PROBABILITY, COVERAGE = 0.5, 0.8


def grams(text: Column | str) -> Column:
    """Distinct lower-case words and word pairs."""
    return _grams_of(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def _pairs_of(words: Column) -> Column:
    following = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    return F.array_compact(F.zip_with(words, following, lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))))


def _grams_of(words: Column) -> Column:
    return F.array_distinct(F.concat(words, _pairs_of(words)))


def templates(spark) -> DataFrame:
    """family (number), template (number), text, needs, bars."""
    rows = [(f, 10 * f + i, t, list(needs), list(bars)) for f, name in enumerate(FAMILIES) for i, (t, needs, bars) in enumerate(TEMPLATES[name])]
    return spark.createDataFrame(rows, "family int, template int, text string, needs array<string>, bars array<string>")


def template_words(text: str) -> list[str]:
    """Distinct lower-case words of a template, as :func:`grams` finds them."""
    return list(dict.fromkeys(re.findall(r"[a-z0-9]+", text.lower())))


def template_grams(text: str) -> set[str]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    return {*words, *map(" ".join, zip(words, words[1:]))}


def probe_words(frequency: dict[str, int]) -> list[list[str]]:
    """Per template, words of which every window that covers it holds one.

    Such a window lacks at most ``size - ceil(COVERAGE * size)`` of the template's grams, so not
    all grams of a set of words that is in more grams than that. Of all such sets, one of words
    that are rare by ``frequency``.
    """
    found = []
    for text in (t for name in FAMILIES for t, _, _ in TEMPLATES[name]):
        whole = template_grams(text)
        spare = len(whole) - ceil(COVERAGE * len(whole))
        chosen: list[str] = []
        for word in sorted(template_words(text), key=lambda w: (frequency.get(w, 0), -len(w), w)):
            chosen.append(word)
            if sum(any(w in chosen for w in g.split()) for g in whole) > spare:
                break
        found.append(chosen)
    return found


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Distinct lines of a bounded sample of the corpus: those with the smallest hashes."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    first = lines.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(sample)  # bounded: for training only
    return saved(first.select("text").distinct(), "licence-sample")


def training_rows(chosen: DataFrame, variants: int = VARIANTS) -> DataFrame:
    """label, grams, held: variants of the templates, and lines of the sample as unknown."""
    spark = chosen.sparkSession
    numbered = chosen.select("text", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(97)).alias("slot"))
    around = numbered.groupBy("slot").agg(F.min("text").alias("around"))
    many = templates(spark).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    words = F.split("text", " ")
    chance = lambda i: F.pmod(F.xxhash64("template", "variant", i), F.lit(100))
    kept = F.filter(words, lambda w, i: (F.col("variant") == 0) | (chance(i) >= 8))
    varied = many.select(
        F.col("family").alias("label"), F.array_join(kept, " ").alias("text"),
        F.pmod(F.xxhash64("template", "variant", F.lit(7)), F.lit(97)).alias("slot"), "variant",
    ).join(F.broadcast(around), "slot", "left")  # at most 97 rows
    # a third of the variants stand inside other text
    inside = F.concat_ws(" ", F.substring("around", 1, 60), "text", F.substring("around", 61, 60))
    leads = F.array(*[F.lit(x) for x in LEADS])
    led = F.concat_ws(" ", F.get(leads, F.col("slot") % len(LEADS)), "text")
    turn = F.col("variant") % 3
    positives = varied.select("label", F.when(turn == 2, inside).when(turn == 1, led).otherwise(F.col("text")).alias("text"))
    whole = grams("text")
    notice = F.lit(False)
    for form in (grams(F.lit(t)) for name in FAMILIES for t, _, _ in TEMPLATES[name]):
        notice = notice | (F.size(F.array_intersect(form, whole)) >= COVERAGE * F.size(form))
    unknown = chosen.filter(~notice).select(F.lit(UNKNOWN).alias("label"), "text")
    # a notice without what tells its licence from others is one of a licence that is not known
    bare = many.filter("variant < 8").select(
        F.lit(UNKNOWN).alias("label"),
        F.array_join(F.filter(words, lambda w, i: ~F.exists("needs", lambda n: F.contains(F.lower(w), F.element_at(F.split(n, " "), 1))) & (chance(i) >= 8)), " ").alias("text"),
    )
    others = spark.createDataFrame([(UNKNOWN, t) for t in OTHERS for _ in range(10)], "label int, text string")
    rows = positives.unionByName(unknown).unionByName(bare).unionByName(others)
    return saved(
        rows.select("label", grams("text").alias("grams"), (F.pmod(F.xxhash64("text", F.lit(3)), F.lit(5)) == 0).alias("held")),
        "licence-training",
    )


def train(rows: DataFrame) -> tuple[DataFrame, list[float]]:
    """Weights (gram hash, array of weights by class) and biases, divided by the temperature."""
    spark = rows.sparkSession
    vectors = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=GRAMS, minDF=3, binary=True).fit(rows)
    table = vectors.transform(rows).select("label", "features", "held")
    fitted = LogisticRegression(regParam=0.003, elasticNetParam=0.5, maxIter=60, family="multinomial").fit(table.filter("not held"))
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()  # at most GRAMS columns
    best = _temperature(fitted.transform(table.filter("held")))
    weights = [
        (gram, [float(x) / best for x in matrix[:, i]]) for i, gram in enumerate(vectors.vocabulary) if matrix[:, i].any()
    ]
    named = spark.createDataFrame(weights, "name string, weights array<double>")
    return named.select(F.xxhash64("name").alias("gram"), "weights"), [float(x) / best for x in bias]


def _temperature(scored: DataFrame) -> float:
    """The divisor of the scores that makes the held rows likeliest."""
    from pyspark.ml.functions import vector_to_array

    scores = scored.select("label", vector_to_array("rawPrediction").alias("s"))
    grid = [0.25 * 2 ** (i / 2) for i in range(9)]

    def loss(t: float) -> Column:
        top = F.array_max("s")
        total = F.aggregate(F.transform("s", lambda x: F.exp((x - top) / t)), F.lit(0.0), lambda a, b: a + b)
        return F.avg(F.log(total) - (F.get("s", F.col("label")) - top) / t)

    row = scores.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(grid)]).first()
    losses = [x if x is not None else 0.0 for x in row]
    return grid[min(range(len(grid)), key=lambda i: (losses[i], abs(grid[i] - 1)))]


_PLACE = ["key", "number", "start", "end"]


def _words(text: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _once(value: Column) -> Column:
    """The value, in a generator: filters on it do not compute it anew for each use."""
    return F.explode(F.array(value))


def word_frequency(chosen: DataFrame) -> dict[str, int]:
    """In how many lines of the sample each word of a template occurs. It only chooses which words
    are looked for first; what is found does not depend on it."""
    words = sorted({w for name in FAMILIES for t, _, _ in TEMPLATES[name] for w in template_words(t)})
    seen = chosen.select(F.explode(F.array_intersect(_words("text"), F.array(*[F.lit(w) for w in words]))).alias("w"))
    return {r["w"]: r["count"] for r in seen.groupBy("w").count().collect()}  # at most the words


def form_grams(spark) -> DataFrame:
    """family, template, gram, role (1 one of the template's grams, 2 needed too, 3 barred), and of the
    template: size, needed (grams it cannot lack), enough (grams that make a cover)."""
    rows = []
    for f, name in enumerate(FAMILIES):
        for i, (text, needs, bars) in enumerate(TEMPLATES[name]):
            whole = template_grams(text)
            shape = (len(whole), len(needs), ceil(COVERAGE * len(whole)))
            rows += [(f, 10 * f + i, g, 2 if g in needs else 1, *shape) for g in sorted(whole)] + [(f, 10 * f + i, g, 3, *shape) for g in bars]
    return spark.createDataFrame(rows, "family int, template int, gram string, role int, size int, needed int, enough int")


def windows(docs: DataFrame, frequency: dict[str, int] | None = None) -> DataFrame:
    """key, number of the paragraph, first and last line, and grams of the smallest windows that
    cover a template and hold the grams it cannot lack, of at most :func:`longest` lines.

    What a window covers, its paragraph and its text cover too, so most texts and paragraphs are
    left out whole: those without any of the words of which a cover needs one, then those that
    lack more words of every template than a cover may. In the others the template's grams are
    placed: from a first line on, a gram is held as of the line of its first occurrence, so
    the window ends where enough grams, and all needed ones, have come.
    """
    spark, reach = docs.sparkSession, longest()
    texts = [t for name in FAMILIES for t, _, _ in TEMPLATES[name]]
    probes = probe_words(frequency or {})
    rare = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted({w for p in probes for w in p}))})(?![\p{{L}}\p{{N}}])"
    hopeful = F.lit(False)
    for text, probe in zip(texts, probes):
        size, words = len(template_grams(text)), template_words(text)
        there = F.size(F.array_intersect(F.array(*[F.lit(w) for w in words]), "words"))
        spare = size - ceil(COVERAGE * size)
        hopeful = hopeful | (F.arrays_overlap(F.array(*[F.lit(w) for w in probe]), "words") & (there >= len(words) - spare))
    cut = F.split("text", r"\n[^\p{L}\p{N}\n]*(?=\n)")
    some = docs.filter(F.lower("text").rlike(rare))
    parts = some.select(F.unhex(F.md5("text")).alias("key"), F.posexplode(cut).alias("number", "part"))
    parts = parts.filter(F.lower("part").rlike(rare)).select("key", "number", "part", _once(_words("part")).alias("words")).filter(hopeful)
    lines = F.filter(F.transform(F.split("part", "\n"), _words), lambda x: F.size(x) > 0)
    parts = saved(parts.dropDuplicates(["key", "number"]).select("key", "number", lines.alias("lines")), "licence-parts")

    # words, pairs of a line, and the pair across its end
    line = parts.select("key", "number", "lines", F.posexplode("lines").alias("first", "words"))
    across = F.slice(F.coalesce(F.get("lines", F.col("first") + 1), F.array().cast("array<string>")), 1, 1)
    pair = F.when(F.size(across) > 0, F.concat_ws(" ", F.element_at("words", -1), across[0]))
    inside = F.transform(_grams_of(F.col("words")), lambda g: F.struct(g.alias("gram"), F.col("first").alias("last")))
    over = F.array(F.struct(pair.alias("gram"), (F.col("first") + 1).alias("last")))
    placed = line.select("key", "number", "first", F.explode(F.concat(inside, over)).alias("x")).select("key", "number", "first", "x.gram", "x.last")
    forms = form_grams(spark).filter("role < 3")
    met = placed.join(F.broadcast(forms), "gram")  # the templates' grams
    # a stretch of lines holds the windows that begin in its first half
    half = F.floor(F.col("first") / reach)
    met = met.withColumn("stretch", F.explode(F.filter(F.array(half, half - 1), lambda x: x >= 0)))
    group = ["key", "number", "stretch", "template"]
    held = met.groupBy(*group, "gram").agg(
        F.sort_array(F.collect_set(F.struct("first", "last"))).alias("at"), *(F.first(c).alias(c) for c in ("role", "enough", "needed"))
    )
    gram = F.struct("at", (F.col("role") == 2).alias("need"))
    sets = held.groupBy(*group).agg(
        F.collect_list(gram).alias("grams"), F.first("enough").alias("enough"), F.first("needed").alias("needed")
    ).filter((F.size("grams") >= F.col("enough")) & (F.size(F.filter("grams", lambda g: g["need"])) == F.col("needed")))

    def come(grams: Column, start: Column) -> Column:
        """Lines as of which the grams are held from line ``start`` on, sorted."""
        lines_of = F.transform(grams, lambda g: F.get(F.filter(g["at"], lambda x: x["first"] >= start), F.lit(0))["last"])
        return F.array_sort(F.array_compact(lines_of))

    def window(start: Column) -> Column:
        every, needs = come(F.col("grams"), start), come(F.filter("grams", lambda g: g["need"]), start)
        end = F.greatest(F.get(every, F.col("enough") - 1), F.when(F.size(needs) == F.col("needed"), F.element_at(needs, -1)))
        whole = (F.size(every) >= F.col("enough")) & (F.size(needs) == F.col("needed"))
        return F.struct(start.alias("start"), F.when(whole, end).alias("end"))

    starts = F.array_sort(F.array_distinct(F.flatten(F.transform("grams", lambda g: g["at"]["first"]))))
    mine = F.filter(starts, lambda s: F.floor(s / reach) == F.col("stretch"))
    found = sets.select("key", "number", "template", F.explode(F.transform(mine, window)).alias("w")).select("key", "number", "template", "w.*")
    found = found.filter(F.col("end").isNotNull() & (F.col("end") - F.col("start") < reach))
    # of windows with one end, the one that begins last is the smallest
    smallest = found.groupBy("key", "number", "template", "end").agg(F.max("start").alias("start")).select("key", "number", "start", "end").distinct()
    text = F.flatten(F.slice("lines", F.col("start") + 1, F.col("end") - F.col("start") + 1))
    return smallest.join(parts, ["key", "number"]).select(*_PLACE, _grams_of(text).alias("grams"))


def longest() -> int:
    """Lines of a window at most: a notice has a word in each of its lines, but for one."""
    return max(len(t.split()) for name in FAMILIES for t, _, _ in TEMPLATES[name]) + 1


def notices(docs: DataFrame, weights: DataFrame, bias: list[float], frequency: dict[str, int]) -> DataFrame:
    """key, family and probability of every confirmed notice."""
    spark = docs.sparkSession
    in_forms = form_grams(spark).groupBy(F.xxhash64("gram").alias("gram")).agg(
        F.collect_list(F.struct("family", "template", "size", "needed", "role")).alias("forms")
    )
    # one bounded table of all grams that matter, in the model or in a template
    known = saved(weights.join(in_forms, "gram", "full"), "licence-grams")
    found = (
        windows(docs, frequency).select(*_PLACE, F.explode(F.transform("grams", lambda g: F.xxhash64(g))).alias("gram"))
        .join(F.broadcast(known), "gram")  # at most GRAMS and the templates' grams
        .groupBy(*_PLACE, "gram").agg(F.first("weights").alias("weights"), F.first("forms").alias("forms"))
    )  # copies of a text give its grams once
    found = saved(found, "licence-found")
    sums = [F.coalesce(F.sum(F.get("weights", F.lit(i))), F.lit(0.0)) + b for i, b in enumerate(bias)]
    scored = found.groupBy(*_PLACE).agg(F.array(*sums).alias("s"))
    top = F.array_max("s")
    total = F.aggregate(F.transform("s", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b)
    predicted = scored.select(*_PLACE, (F.array_position("s", top) - 1).cast("int").alias("family"), (1 / total).alias("probability"))
    predicted = predicted.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= PROBABILITY))
    role = lambda n: F.sum((F.col("role") == n).cast("int"))
    covered = (
        found.select(*_PLACE, F.explode("forms").alias("f")).select(*_PLACE, "f.*")
        .groupBy(*_PLACE, "family", "template", "size", "needed").agg(role(1).alias("plain"), role(2).alias("needs"), role(3).alias("bars"))
        .filter((F.col("needs") == F.col("needed")) & (F.col("bars") == 0))
        .groupBy(*_PLACE, "family").agg(F.max((F.col("plain") + F.col("needs")) / F.col("size")).alias("coverage"))
    )
    confirmed = predicted.join(covered, [*_PLACE, "family"]).filter(F.col("coverage") >= COVERAGE)
    window = F.struct("end", (-F.col("start")).alias("back"), "family", "probability")
    listed = confirmed.groupBy("key", "number").agg(F.array_sort(F.collect_list(window)).alias("w"))
    none = F.slice("w", 1, 0)
    after = lambda kept, w: (F.size(kept) == 0) | (-w["back"] > F.element_at(kept, F.greatest(F.size(kept), F.lit(1)))["end"])
    kept = F.aggregate("w", none, lambda k, w: F.when(F.size(k) == 0, F.array(w)).when(after(k, w), F.concat(k, F.array(w))).otherwise(k))
    return listed.select("key", F.explode(kept).alias("w")).select("key", "w.family", "w.probability")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_notices, families (sorted names), probability of the surest one."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = sampled(texts)
    weights, bias = train(training_rows(chosen))
    names = F.array(*[F.lit(f) for f in FAMILIES])
    by_text = saved(
        notices(texts, weights, bias, word_frequency(chosen)).groupBy("key").agg(
            F.count("*").alias("n_notices"),
            F.array_sort(F.collect_set(F.get(names, F.col("family")))).alias("families"),
            F.max("probability").alias("probability"),
        ),
        "licence-texts",
    )
    rows = texts.select("doc_id", F.unhex(F.md5("text")).alias("key")).join(by_text, "key", "left")
    return rows.select(
        "doc_id", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"), "probability",
    )
