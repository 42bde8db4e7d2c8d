"""Licence scan: normalised text against licence templates by the Dice coefficient of word-bigram sets.

Units of a document are its lines, its paragraphs (blocks between blank lines), its whole text, and, per template,
windows of as many words as the template over the whole text: one from each of the template's bigrams on, the last one
moved back to end with the text. So a licence within a longer line or text is found. A unit is
normalised (A-Z lower-cased, runs of other than letters and digits become one space) and its distinct word bigrams
are compared with each template's: 2 |A and B| / (|A| + |B|) >= THRESHOLD. That needs
|B| t / (2 - t) <= |A| <= |B| (2 - t) / t, so a unit is compared with the templates of fitting size only, and most
units with none; units that share no bigram with any template go before the coefficient is taken. It also needs
|A and B| >= |B| t / (2 - t), and a unit's bigrams are all in the whole text: a document that holds fewer of a
template's bigrams isn't compared with it, and most documents with none.

All expressions are built-in and work inside the row; no text is shuffled.

Defined results: null and empty texts carry no licence; equal scores go to the template named first; a licence found
in many units counts once with its best score; repeated rows are judged each on their own; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Licence id -> notices and texts in common use.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
NOT_WORD = "[^\\p{L}\\p{N}]+"


def bigrams_of(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _lengths(templates: dict[str, list[str]]) -> list[int]:
    """Bigrams of each template with repeats, in the order of _templates."""
    return [len(re.sub(r"[\W_]+", " ", t.lower()).split()) - 1 for texts in templates.values() for t in texts]


def _templates(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return [(name, bigrams_of(t)) for name, texts in templates.items() for t in texts]


def _words(unit: Column) -> Column:
    return F.filter(F.split(F.lower(unit), NOT_WORD), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Bigrams in their order, with repeats."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_pairs(words))


def find(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_licenses, licenses (ids, comma-joined, sorted), best_dice (rounded to 6; 0 if none)."""
    known = _templates(templates)
    low = min(len(b) for _, b in known) * threshold / (2 - threshold)
    high = max(len(b) for _, b in known) * (2 - threshold) / threshold
    every = sorted({g for _, b in known for g in b})
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lit = F.array(*[F.lit(g) for g in every])
    d = d.select("doc_id", "text", _words(F.col("text")).alias("words"))
    d = d.select("doc_id", "text", _pairs(F.col("words")).alias("all"))
    d = d.select("doc_id", "text", "all", F.array_intersect("all", lit).alias("hits"))
    array = lambda b: F.array(*[F.lit(x) for x in b])
    enough = lambda b: F.size(F.array_intersect("hits", array(b))) >= len(b) * threshold / (2 - threshold)
    # Few documents hold enough of a template; all others skip every template.
    d = d.select("doc_id", "text", "all", F.when(F.size("hits") >= low, F.array(*[enough(b) for _, b in known])).alias("may"))
    d = d.select("doc_id", "text", "all", "may", F.coalesce(F.exists("may", lambda m: m), F.lit(False)).alias("some"))
    units = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", "\n[ \\t\\r]*\n"), F.array("text")))
    none = F.expr("cast(array() as array<string>)")
    d = d.select("doc_id", "all", "may", "some", F.when(F.col("some"), F.filter(units, lambda u: F.length(u) >= int(low))).otherwise(none).alias("units"))
    # Sizes before contents: distinct bigrams are at most words - 1, so units with too few words go at once.
    d = d.select("doc_id", "all", "may", "some", F.filter(F.transform("units", _words), lambda w: F.size(w) - 1 >= low).alias("units"))
    grams = F.filter(F.transform("units", _bigrams), lambda g: (F.size(g) >= low) & (F.size(g) <= high))
    d = d.select("doc_id", "all", "may", "some", F.filter(grams, lambda g: F.arrays_overlap(g, lit)).alias("units"))

    def dice(g: Column, b: list[str]) -> Column:
        n = len(b)
        fits = (F.size(g) >= n * threshold / (2 - threshold)) & (F.size(g) <= n * (2 - threshold) / threshold)
        return F.when(fits, 2.0 * F.size(F.array_intersect(g, array(b))) / (F.size(g) + n)).otherwise(0.0)

    def windows(b: list[str], m: int) -> Column:
        """Coefficients of the windows of m bigrams."""
        last = F.greatest(F.size("all") - m + 1, F.lit(1))
        at = F.filter(F.transform("all", lambda x, i: F.when(x.isin(b), F.least(i + 1, last))), lambda i: i.isNotNull())
        return F.transform(F.array_distinct(at), lambda i: F.transform(F.array(F.array_distinct(F.slice("all", i, F.lit(m)))), lambda g: dice(g, b))[0])

    def best(k: int, b: list[str], m: int) -> Column:
        every = F.concat(F.transform("units", lambda g: dice(g, b)), windows(b, m))
        return F.when(F.get("may", F.lit(k)), F.coalesce(F.array_max(every), F.lit(0.0))).otherwise(0.0)

    scores = [(name, best(k, b, m)) for k, ((name, b), m) in enumerate(zip(known, _lengths(templates)))]
    found = F.array(*[F.struct(F.lit(name).alias("name"), s.alias("dice")) for name, s in scores])
    kind = "array<struct<name:string,dice:double>>"
    d = d.select("doc_id", F.when(F.col("some"), F.filter(found, lambda x: x["dice"] >= threshold)).otherwise(F.expr(f"cast(array() as {kind})")).alias("found"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["name"])))
    return d.select(
        "doc_id",
        F.size(names).cast("long").alias("n_licenses"),
        F.array_join(names, ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda x: x["dice"])), F.lit(0.0)), 6).alias("best_dice"),
    )


def sql(templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same as SQL: every unit and every window against every template, without pruning."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, [{', '.join(map(quote, b))}], {m})" for (n, b), m in zip(_templates(templates), _lengths(templates)))
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT rid, unnest(list_distinct(list_concat(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')), [text]))) AS u FROM d),
w AS (SELECT rid, list_filter(regexp_split_to_array(lower(u), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM u),
t AS (SELECT * FROM (VALUES {rows}) t(name, b, m)),
g AS (SELECT rid, name, b, list_distinct({pairs}) AS g FROM w, t WHERE len(w) > 1),
whole AS (SELECT rid, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM d),
a AS (SELECT rid, {pairs} AS al FROM whole WHERE len(w) > 1),
i AS (SELECT rid, name, b, m, al, unnest(list_distinct(list_filter(list_transform(al, lambda x, i: CASE WHEN list_contains(b, x) THEN least(i, greatest(len(al) - m + 1, 1)) END), lambda i: i IS NOT NULL))) AS i FROM a, t),
e AS (SELECT rid, name, b, g FROM g UNION ALL SELECT rid, name, b, list_distinct(list_slice(al, i, i + m - 1)) FROM i),
s AS (SELECT rid, name, max(2.0 * len(list_intersect(g, b)) / (len(g) + len(b)))::DOUBLE AS dice FROM e GROUP BY rid, name),
f AS (SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names, max(dice) AS best FROM s WHERE dice >= {threshold} GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses, round(coalesce(best, 0), 6) AS best_dice FROM d LEFT JOIN f ON d.rid = f.rid
"""
