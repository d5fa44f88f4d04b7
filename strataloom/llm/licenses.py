"""Licence notices in texts by the Dice coefficient over word bigrams.

A text's units are its lines, its paragraphs (cut at blank lines) and so, where
it has no blank line, the whole text.  A unit is put in ASCII lower case, every
run of other characters than a-z and 0-9 becomes a space, and its set of word
bigrams is compared with each template's: 2 |A n B| / (|A| + |B|).  As that is
at most 2 min / (|A| + |B|), a template is compared only with units whose set
is of a fitting size, and a unit whose numbers of words already rule every
template out gets no set at all: a set has at most one bigram less than the
unit has words, and at least one less than it has distinct words.

``scan_runs`` compares runs of a text's words as well, whatever lines and
comment marks they go over: for each template every run that starts and ends
with one of its bigrams and has at most as many bigrams as could still match.

All of it is one projection of column functions: no shuffle, no Python.

Defined cases: a null or empty text has no match (null, 0.0, 0); ties go to the
smaller licence name; a licence found in several units counts each of them;
repeated rows get equal values; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import take

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.8

# Notices as the licences' own texts give them, with the SPDX names.
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bigrams_of(text: str) -> list[str]:
    """A template's distinct bigrams, by the rule that units follow."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def words_of(unit: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.translate(unit, UPPER, LOWER), "[^a-z0-9]+", " "))
    return F.split(plain, " ")


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, score, n_matches: the best licence of each row of ``docs`` (doc_id, text), its Dice coefficient, and the number of (unit, template) matches."""
    rows = take(docs, "doc_id", "text")
    sets = [(name, grams) for name, text in templates if (grams := bigrams_of(text))]
    if not sets:
        return rows.select("doc_id", F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("score"), F.lit(0).alias("n_matches"))
    known = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("n")) for name, grams in sets))
    least = min(len(g) for _, g in sets) * threshold / (2 - threshold)
    most = max(len(g) for _, g in sets) * (2 - threshold) / threshold
    text = F.coalesce("text", F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n")))
    words = F.filter(F.transform(units, words_of), lambda w: (F.size(w) - 1 >= least))
    words = F.filter(words, lambda w: F.size(F.array_distinct(w)) - 1 <= most)
    grams = F.transform(words, lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))

    def compared(own: Column) -> Column:
        fits = F.filter(known, lambda t: (2 * F.least(F.size(own), t["n"]) >= threshold * (F.size(own) + t["n"])))
        dice = F.transform(fits, lambda t: F.struct((-2.0 * F.size(F.array_intersect(own, t["grams"])) / (F.size(own) + t["n"])).alias("less"), t["name"].alias("name")))
        return F.filter(dice, lambda t: t["less"] <= -threshold)

    found = rows.select("doc_id", F.flatten(F.transform(grams, compared)).alias("found"))
    best = F.array_min("found")
    return found.select("doc_id", best["name"].alias("license"), F.coalesce(-best["less"], F.lit(0.0)).alias("score"), F.size("found").alias("n_matches"))


def scan_runs(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, score, n_matches: as ``scan``, but of all runs of words, and the number of templates that some run matches."""
    rows = take(docs, "doc_id", "text")
    sets = [(name, grams) for name, text in templates if (grams := bigrams_of(text))]
    if not sets:
        return rows.select("doc_id", F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("score"), F.lit(0).alias("n_matches"))
    least = threshold / (2 - threshold)  # of a template's bigrams, in a run that matches
    known = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("n")) for name, grams in sets))
    words = words_of(F.coalesce("text", F.lit("")))
    own = rows.select("doc_id", words.alias("words"))
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    own = own.select("doc_id", F.when(F.size("words") > 1, pairs).otherwise(F.array().cast("array<string>")).alias("grams"))
    places = F.transform("grams", lambda g, i: F.struct(i.alias("i"), g.alias("g")))
    own = own.withColumn("hits", F.filter(places, lambda h: h["g"].isin(sorted({g for _, grams in sets for g in grams}))))

    def hits_of(t: Column) -> Column:
        hits = F.filter("hits", lambda h: F.array_contains(t["grams"], h["g"]))
        return F.struct(t["name"].alias("name"), t["grams"].alias("grams"), t["n"].alias("n"), hits.alias("hits"))

    def best_run(t: Column) -> Column:
        def runs_from(first: Column, at: Column) -> Column:
            far = F.filter(F.slice(t["hits"], at + 1, F.size(t["hits"]) - at), lambda last, k: (k + 1 >= t["n"] * least) & (last["i"] - first["i"] + 1 <= t["n"] / least))
            return F.transform(far, lambda last: less_of(F.slice("grams", first["i"] + 1, last["i"] - first["i"] + 1)))

        def less_of(run: Column) -> Column:
            return -2.0 * F.size(F.array_intersect(run, t["grams"])) / (F.size(F.array_distinct(run)) + t["n"])

        return F.struct(F.array_min(F.flatten(F.transform(t["hits"], runs_from))).alias("less"), t["name"].alias("name"))

    likely = F.filter(F.transform(known, hits_of), lambda t: F.size(F.array_distinct(t["hits"]["g"])) >= t["n"] * least)
    own = own.select("doc_id", "grams", likely.alias("likely"))
    found = own.select("doc_id", F.filter(F.transform("likely", best_run), lambda t: t["less"] <= -threshold).alias("found"))
    best = F.array_min("found")
    return found.select("doc_id", best["name"].alias("license"), F.coalesce(-best["less"], F.lit(0.0)).alias("score"), F.size("found").alias("n_matches"))


def sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan in DuckDB's SQL, over ``documents``."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(name)}, [{', '.join(map(quote, grams))}])" for name, text in templates if (grams := bigrams_of(text)))
    return rf"""
WITH t(license, grams) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT DISTINCT row, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n[ \t\r]*\n'))) AS unit FROM d),
w AS (SELECT row, string_split(trim(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM u),
s AS (SELECT row, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS own FROM w),
m AS (SELECT row, license, 2.0 * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice FROM s, t
  WHERE 2 * least(len(own), len(grams)) >= {threshold} * (len(own) + len(grams))),
b AS (SELECT row, first(license ORDER BY dice DESC, license) AS license, max(dice)::DOUBLE AS score, count(*)::INT AS n_matches FROM m WHERE dice >= {threshold} GROUP BY row)
SELECT doc_id, license, coalesce(score, 0)::DOUBLE AS score, coalesce(n_matches, 0)::INT AS n_matches FROM d LEFT JOIN b USING (row)"""
