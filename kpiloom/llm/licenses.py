"""License scans by the Dice coefficient over word bigrams (DataFrame functions only).

Texts and templates are normalised to lower-case runs of letters a-z and digits.  Units of a
document (its lines, its paragraphs, its whole text) are compared with every
license template: 2 * shared bigrams / (bigrams of the unit + bigrams of the template).

A score of at least t needs a unit between t/(2-t) and (2-t)/t times the
template's size, which prunes templates before any bigram is compared; and it
needs that share of the template's own bigrams, so a document that holds none of a
template's anchor words (words whose bigrams leave less than that share) has no match.  Neither bound loses a match.

With ``windows``, runs of words inside a text are units too, so that other words before and after a notice, or line
feeds in it, don't hide it.  Of all windows within the size bounds the best begins and ends with a bigram of the template,
so only those are compared.

Scale: everything happens inside the row; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, quoted, whole_text

THRESHOLD = 0.8

# License notices and texts, as published.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "bsd-clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions:"),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

# More notices, one-line forms and titles of the full texts; for scans inside texts.
NOTICES = {
    **TEMPLATES,
    "agpl-3.0": "GNU Affero General Public License version 3",
    "apache-2.0-title": "Apache License Version 2.0, January 2004",
    "apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "bsd-notice": "Licensed under the BSD License.",
    "bsd-2-clause": "BSD 2-Clause License",
    "bsd-3-clause": "BSD 3-Clause License",
    "cc-by-4.0-text": "Creative Commons Attribution 4.0 International",
    "cc-by-nc-4.0-text": "Creative Commons Attribution-NonCommercial 4.0 International",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-text": "Creative Commons Attribution-ShareAlike 4.0 International",
    "cc0-1.0": "CC0 1.0 Universal",
    "gpl-2.0-notice": "GNU General Public License version 2",
    "gpl-3.0-notice": "GNU General Public License version 3",
    "lgpl-2.1": "GNU Lesser General Public License version 2.1",
    "lgpl-3.0": "GNU Lesser General Public License version 3",
    "mit-notice": "Licensed under the MIT License.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "mpl-2.0": "Mozilla Public License Version 2.0",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(map(" ".join, zip(w, w[1:]))))


def size_bounds(size: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bigrams that a unit must have, at least and at most, to reach the threshold."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def anchors(templates: dict[str, str], threshold: float = THRESHOLD) -> list[str]:
    """Words such that a text with none of them reaches the threshold with no template.

    For each template its rarest words, over all templates by length first, until the bigrams without them are too few."""
    out: set[str] = set()
    for text in templates.values():
        grams = bigrams_of(text)
        need = size_bounds(len(grams), threshold)[0]
        common = Counter(w for g in grams for w in set(g.split()))
        left = [g for g in grams if not out & set(g.split())]
        for w in sorted(common, key=lambda w: (-len(w), w)):
            if len(left) < need:
                break
            if any(w in g.split() for g in left):
                out.add(w)
                left = [g for g in left if w not in g.split()]
    return sorted(out)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _bigrams(text: Column) -> Column:
    pairs = lambda w: F.array_distinct(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
                                                   lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))
    return let(_words(text), pairs)


def _scores(grams: Column, templates: dict[str, str], threshold: float) -> Column:
    """(license, dice) of the templates that a unit's bigrams match."""
    found = []
    for name, text in sorted(templates.items()):
        own = bigrams_of(text)
        low, high = size_bounds(len(own), threshold)
        dice = 2 * F.size(F.array_intersect(grams, F.array(*map(F.lit, own)))) / (F.size(grams) + len(own))
        found.append(F.struct(F.lit(name).alias("license"),
                              F.when(F.size(grams).between(low, high), dice).otherwise(F.lit(0.0)).alias("dice")))
    return F.filter(F.array(*found), lambda x: x["dice"] >= threshold)


def _units(text: Column) -> Column:
    return F.array_distinct(F.concat(F.split(text, r"\n"), F.split(text, r"\n[ \t\r]*\n"), F.array(text)))


def _window_scores(text: Column, templates: dict[str, str], threshold: float) -> Column:
    """(license, dice) of the templates that a window of ``text`` matches, at its best."""
    own = {name: bigrams_of(t) for name, t in sorted(templates.items())}
    all_ = sorted({g for x in own.values() for g in x})

    def best_of(name: str, hits: Column, grams: Column) -> Column:
        low, high = size_bounds(len(own[name]), threshold)

        def dice(a: Column, b: Column, within: Column) -> Column:
            size = F.size(F.array_distinct(F.slice(grams, a["i"] + 1, b["i"] - a["i"] + 1)))
            shared = F.size(F.array_distinct(F.transform(F.filter(within, lambda x: x["i"] <= b["i"]), lambda x: x["g"])))
            return 2 * shared / (size + len(own[name]))

        def from_(a: Column, k: Column) -> Column:  # fewer than ``low`` hits can't match
            near = F.filter(F.slice(hits, k + 1, high), lambda x: x["i"] < a["i"] + high)
            return let(near, lambda w: F.array_max(F.transform(F.slice(w, low, high), lambda b: dice(a, b, w))))

        score = F.when(F.size(hits) >= low, F.array_max(F.transform(hits, from_)))
        return F.struct(F.lit(name).alias("license"), F.coalesce(score, F.lit(0.0)).alias("dice"))

    def scores(grams: Column) -> Column:
        hits = F.filter(F.transform(grams, lambda g, i: F.struct(i.alias("i"), g.alias("g"))), lambda x: x["g"].isin(all_))
        of = lambda name, h: let(F.filter(h, lambda x: x["g"].isin(own[name])), lambda y: best_of(name, y, grams))
        found = lambda h: F.array(*[of(name, h) for name in own])
        return F.filter(let(hits, found), lambda m: m["dice"] >= threshold)

    pairs = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    return let(let(_words(text), pairs), scores)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
         threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """(id, matches: array of license, dice) for every row of ``docs``: one entry for each distinct unit and
    template that match.  With ``windows``, also one for each template that no unit, but a window of the text matches.

    A null or empty text has no matches, nor has a unit of fewer than two words;
    repeated rows and null ids give a row each; an empty table gives no rows;
    other columns are not read, whatever their names."""
    templates = TEMPLATES if templates is None else templates
    text = whole_text(text_col)
    anchored = F.arrays_overlap(_words(text), F.array(*map(F.lit, anchors(templates, threshold))).cast("array<string>"))
    none = F.array().cast("array<struct<license:string,dice:double>>")
    each = F.transform(_units(text), lambda u: let(_bigrams(u), lambda g: _scores(g, templates, threshold)))
    matches = F.flatten(each)
    if windows:
        inside = lambda m: F.concat(m, F.filter(_window_scores(text, templates, threshold),
                                                lambda w: ~F.exists(m, lambda x: x["license"] == w["license"])))
        matches = let(matches, inside)
    return docs.select(F.col(quoted(id_col)).alias("id"), F.when(anchored, matches).otherwise(none).alias("matches"))


def best(matches) -> Column:
    """(score as a negative number, license) of the highest score; of equal ones the first by name.  Null if there is none."""
    return F.array_min(F.transform(matches, lambda m: F.struct(F.negative(m["dice"]).alias("minus"), m["license"].alias("license"))))
