r"""Licence scans in DataFrame functions only.

A text is normalised once: lower case, ``! ? : ;`` before white space become full stops, and
everything else but letters, digits, ``.``, ``+``, ``-`` and line ends becomes a blank. Its units
are its sentences (within lines, and within paragraphs whose lines are joined), its lines, its
paragraphs and the whole. A unit matches a template if the Dice coefficient of
their sets of word bigrams, 2 |A n B| / (|A| + |B|), is at least ``threshold``, and if
the words that tell licences of one family apart agree: the unit holds every version number and
family word of the template, and no other family word.

Two bounds prune, and neither loses a match. Size: the coefficient is at most
2 min(|A|, |B|) / (|A| + |B|), so a template is compared only with units between
t / (2 - t) and (2 - t) / t of its size. Anchors: a match shares at least
t / (2 - t) of a template's bigrams, so it holds one of any
floor(|B| (1 - t / (2 - t))) + 1 of them, and a text without any anchor of any
template is never cut into units.

Nothing is exploded or shuffled: the work is a narrow projection.

Defined results: null and empty texts have no licence; a unit that fits two
templates equally well counts for the first id; the same text gives the same
result on every row; columns of the input are kept, clashing ones are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices by which a work names its licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
            "the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                 "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Words that tell licences of one family apart; numbers with at most one point do so too where a template has them.
FAMILY = (
    "lesser", "library", "affero", "by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd", "attribution", "attribution-sharealike", "attribution-noncommercial",
    "attribution-noderivatives", "attribution-noncommercial-sharealike", "attribution-noncommercial-noderivatives", "sharealike", "noncommercial", "noderivatives",
)
# "by" and "library" also occur in running text, so they count only where a template has them.
_ALONE = ("by", "library")
VERSION = r"[0-9]+(?:[.][0-9]+)?"

_STOP, _STOPPED = r"[!?:;]+([\"')\]]*)([ \t\r\n]|\z)", ".$1$2"
_OTHER = r"[^\p{L}\p{N}.+\n-]+"
_WORDS = r"\.*[ \n]+"
_PARAGRAPH = r"\n[ ]*\n\s*"


def template_words(text: str) -> list[str]:
    stopped = re.sub(_STOP.replace(r"\z", r"\Z"), r".\1\2", text.lower())
    return [w for w in re.split(_WORDS, re.sub(r"[^\w.+\n-]+|_", " ", stopped).strip().rstrip(".")) if w]


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, as ``bigrams`` finds them in a unit."""
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def template_marks(text: str) -> list[str]:
    """The version numbers and family words of a template, which a unit must hold."""
    return sorted({w for w in template_words(text) if w in FAMILY or re.fullmatch(VERSION, w)} - {"by" if "published by" in text else ""})


def anchors(templates: tuple[tuple[str, str], ...], threshold: float) -> list[str]:
    """Enough bigrams of each template, the rarest among the templates first, that every match holds one."""
    sets = [template_bigrams(text) for _, text in templates]
    common = Counter(b for s in sets for b in s)
    found: dict[str, None] = {}
    for own in sets:
        need = int(len(own) * (1 - threshold / (2 - threshold)) + 1e-9) + 1
        # Bigrams that are anchors already come first, then the rarer and longer ones.
        found |= dict.fromkeys(sorted(own, key=lambda b: (b not in found, common[b], -len(b), b))[:need])
    return list(found)


def normalised(text: Column) -> Column:
    stopped = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _STOP, _STOPPED)
    return F.regexp_replace(stopped, _OTHER, " ")


def unit_words(unit: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(unit, r"\.+$", ""), _WORDS), lambda w: w != "")


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b)))


def scan(docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``matches``: an array of (license, dice), one for each distinct unit that matches."""
    # A little wider than exact, so that no rounding excludes a pair at the very bound.
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    known = F.array(*[
        F.struct(
            F.lit(name).alias("license"), F.array(*map(F.lit, template_bigrams(t))).alias("bigrams"),
            F.array(*map(F.lit, template_marks(t))).cast("array<string>").alias("marks"),
            F.array(*[F.lit(w) for w in FAMILY if w not in (*template_words(t), *_ALONE)]).cast("array<string>").alias("others"),
        )
        for name, t in templates
    ])
    sizes = [len(template_bigrams(t)) for _, t in templates]
    least, most = min(sizes) * low, max(sizes) * high

    def compared(unit):
        own = unit.bigrams
        agrees = lambda t: (F.size(F.array_except(t.marks, unit.words)) == 0) & ~F.arrays_overlap(t.others, unit.words)
        fits = lambda t: (F.size(own) >= F.size(t.bigrams) * low) & (F.size(own) <= F.size(t.bigrams) * high) & agrees(t)
        dice = lambda t: 2.0 * F.size(F.array_intersect(own, t.bigrams)) / (F.size(own) + F.size(t.bigrams))
        scored = F.transform(F.filter(known, fits), lambda t: F.struct((-dice(t)).alias("order"), t.license.alias("license")))
        return F.array_min(F.filter(scored, lambda s: s["order"] <= -threshold + 1e-12))

    norm = "_license_text"
    found = docs.withColumn(norm, normalised(F.col(text)))
    pattern = "|".join(rf"{a.replace('.', '[.]').replace('+', '[+]').replace(' ', r'[. \n]*[ \n]')}" for a in anchors(templates, threshold))
    near = F.col(norm).rlike(f"(?<![^ \\n])(?:{pattern})(?![^ .\\n])")
    joined = F.flatten(F.transform(F.split(F.col(norm), _PARAGRAPH), lambda p: F.split(F.translate(p, "\n", " "), r"\.+[ ]+")))
    units = F.array_distinct(F.concat(
        F.split(F.col(norm), r"\.+[ \n]+|\n"), F.split(F.col(norm), "\n"), F.split(F.col(norm), _PARAGRAPH), joined, F.array(F.col(norm)),
    ))
    # Words are counted by their gaps before any bigram is built; a unit has at most one bigram for each gap.
    gaps = lambda u: F.length(u) - F.length(F.translate(u, " \n", ""))
    words = F.transform(F.filter(units, lambda u: gaps(u) >= least), unit_words)
    sets = F.transform(words, lambda w: F.struct(bigrams(w).alias("bigrams"), w.alias("words")))
    sets = F.filter(sets, lambda s: (F.size(s.bigrams) >= least) & (F.size(s.bigrams) <= most))
    best = F.transform(sets, lambda s: F.struct(F.array_sort(s.bigrams).alias("bigrams"), compared(s).alias("best")))
    best = F.transform(F.array_distinct(F.filter(best, lambda b: b.best.isNotNull())), lambda b: b.best)
    matches = F.transform(best, lambda b: F.struct(b.license.alias("license"), (-b["order"]).alias("dice")))
    nothing = F.array().cast("array<struct<license:string,dice:double>>")
    return found.withColumn("matches", F.when(near, matches).otherwise(nothing)).drop(norm)
