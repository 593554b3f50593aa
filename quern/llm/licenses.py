"""Licence scans with DataFrame functions only.

Units of a text (each line, and the whole text if it has several) are normalised to words
and compared with short licence notices by the Dice coefficient of their word bigrams
(multisets). As 2 min(a, b) / (a + b) bounds the coefficient of sets of sizes a and b, a
unit's word count alone rules out all templates that are too short or too long, before any
bigram is made. Everything happens in the row; nothing is shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.85

# Customary short notices of public licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: What stands between words: ASCII that is no letter or digit.
BETWEEN = "[^a-z0-9\\x{80}-\\x{10FFFF}]+"


def normal(text: str) -> list[str]:
    """Words of a template, as normalise() makes them."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.sub("[^a-z0-9\\x80-\U0010ffff]+", " ", folded).split(" ")


def _words(text: str) -> list[str]:
    return [w for w in normal(text) if w]


def bigrams(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def normalise(text: Column) -> Column:
    """Words joined by single spaces, A-Z lower-cased."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(folded, BETWEEN, " "))


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Bigram counts that can reach the threshold with a template of n bigrams."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def licenses(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_hits, licenses, best.

    n_hits counts units whose best template reaches the threshold, licenses lists their
    distinct identifiers in order, joined by commas, best is the highest coefficient (null
    without a hit). Of a unit's equal scores the first identifier counts. A null text
    counts as empty; texts of any length are read as a whole; repeated rows give a row each.
    """
    rows = []
    for name, text in TEMPLATES:
        grams = bigrams(_words(text))
        if len(set(grams)) < len(grams):
            raise ValueError(f"a template repeats a bigram: {text!r}")
        rows.append((name, grams, *bounds(len(grams), threshold)))
    known = F.array(*[F.struct(F.lit(n).alias("id"), F.array(*[F.lit(x) for x in g]).alias("grams"), F.lit(len(g)).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, g, lo, hi in rows])
    least, most = min(r[2] for r in rows), max(r[3] for r in rows)
    # the words of a unit are one more than its bigrams; characters bound them from below
    shortest = 2 * least + 1

    def best(words: Column) -> Column:
        n = F.size(words) - 1
        grams = F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))

        def over(g: Column) -> Column:
            near = F.filter(known, lambda t: (n >= t["lo"]) & (n <= t["hi"]))
            return F.array_min(F.transform(near, lambda t: F.struct((-(F.lit(2.0) * F.size(F.array_intersect(g, t["grams"])) / (n + t["n"]))).alias("minus"), t["id"].alias("id"))))

        return F.when((n >= least) & (n <= most), F.transform(F.array(grams), over)[0])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    units = F.split(text, "\n", -1)
    units = F.when(F.size(units) > 1, F.concat(units, F.array(text))).otherwise(units)
    units = F.filter(units, lambda u: F.char_length(u) >= shortest)
    flat = F.filter(F.transform(units, normalise), lambda u: (F.char_length(u) - F.char_length(F.replace(u, F.lit(" "), F.lit("")))).between(least, most))
    hits = F.filter(F.transform(flat, lambda u: best(F.split(u, " "))), lambda h: h["minus"] <= -threshold)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hits.alias("hits"))
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["id"])))
    return out.select("doc_id", F.size("hits").cast("long").alias("n_hits"), F.array_join(ids, ",").alias("licenses"), (-F.array_min(F.transform("hits", lambda h: h["minus"]))).alias("best"))
