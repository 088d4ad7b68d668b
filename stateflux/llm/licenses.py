"""Licence scans: normalised text held against templates by the Dice coefficient over word bigrams.

Only DataFrame functions: no Python runs on rows. A document's lines, its
paragraphs and the document itself are the units. For each, the templates whose
number of bigrams is within the bounds that the coefficient allows are compared,
with the templates as a constant of the plan: no join, and no shuffle until the
few matches are gathered by document. Licences that no unit gives are looked for
in stretches as long as a template, wherever lines and paragraphs end. The work
grows with a text's length, not with its square.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices by which works are put under a licence, as their publishers word them.
TEMPLATES = {
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "all-rights-reserved": ["All rights reserved."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "bsd-2-clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "bsd-3-clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "lgpl-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "public-domain": ["This work is in the public domain."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
}

#: Least Dice coefficient of a match, in thousandths.
LEAST = 800


def bigrams(text: str) -> list[str]:
    """A template's distinct word bigrams, in order."""
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def table(templates: Mapping[str, list[str]]) -> list[tuple[str, int, list[str]]]:
    """(licence, place in its list, bigrams) of each template with two words or more."""
    return [(name, k, grams) for name in sorted(templates) for k, text in enumerate(templates[name]) if (grams := bigrams(text))]


def bounds(size: int, least: int) -> tuple[int, int]:
    """The numbers of bigrams that a text can have if its coefficient with one of ``size`` is to be ``least`` thousandths.

    2 c / (a + b) can be least only if 2 min(a, b) / (a + b) is.
    """
    return -(-least * size // (2000 - least)), (2000 - least) * size // least


def units(text: Column) -> Column:
    """The words (runs of letters and digits, lower-cased) of a text's lines, paragraphs and whole; equal units once."""

    def parts(plain: Column) -> Column:
        paragraphs = F.when(plain.rlike(r"\n ?\n"), F.split(plain, r"\n ?\n")).otherwise(F.array().cast("array<string>"))
        joined = F.transform(F.concat(paragraphs, F.array(plain)), lambda x: F.trim(F.regexp_replace(x, r"[ \n]+", " ")))
        # texts are told apart by a hash, arrays of words would be compared with each other
        return F.transform(F.array_distinct(F.concat(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), joined)), lambda x: F.split(x, " "))

    # a lambda's argument is evaluated once, an expression wherever it stands
    return F.flatten(F.transform(F.array(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")), parts))


def gram_hash(gram: str) -> int:
    """What Spark's xxhash64 makes of a bigram's two words."""
    seed = 42
    for word in gram.split(" "):
        seed = xxhash.xxh64_intdigest(word.encode(), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def matches(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, dice, unit of every unit of a text that is near a template, by the nearest (of several, the name that sorts last).

    ``unit`` is a 64-bit hash of the unit's words. A licence that no unit gives but
    a stretch of words does has one row, with its nearest stretch and null as unit.

    Units are worked off inside one chain of array functions, each evaluated
    once. Most hold fewer of the templates' bigrams than any match needs and go
    at once. A text without words, an empty one and a null one match nothing, an
    empty table has no matches. Repeated rows match alike. Texts of any length are
    scanned whole, in time that grows with their length. Other columns of
    ``docs``, whatever their names, are not read.
    """
    rows = table(templates)
    bound = [bounds(len(grams), least) for _, _, grams in rows]
    low, high = min(b[0] for b in bound), max(b[1] for b in bound)
    every = sorted({gram_hash(g) for _, _, grams in rows for g in grams})
    known = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*[F.lit(gram_hash(g)) for g in grams]).alias("grams"), F.lit(len(grams)).alias("n"), F.lit(b[0]).alias("low"), F.lit(b[1]).alias("high")) for (name, _, grams), b in zip(rows, bound)])
    found = F.filter(units(F.col(text)), lambda ws: F.size(ws) > low)
    grams = lambda ws: F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws)), lambda a, b: F.xxhash64(a, b))
    found = F.transform(found, lambda ws: F.struct(ws.alias("ws"), grams(ws).alias("gs")))
    # 2 c >= least (size + n) needs c >= low, as size >= c
    found = F.filter(found, lambda u: F.size(F.array_distinct(F.filter(u["gs"], lambda g: g.isin(every)))) >= low)
    found = F.filter(F.transform(found, lambda u: F.struct(F.xxhash64(F.array_join(u["ws"], " ")).alias("unit"), F.array_distinct(u["gs"]).alias("gs"))), lambda u: F.size(u["gs"]).between(low, high))

    def nearest(u: Column) -> Column:
        near = F.filter(known, lambda t: F.size(u["gs"]).between(t["low"], t["high"]))
        return F.array_max(F.transform(near, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(t["grams"], u["gs"])) / (t["n"] + F.size(u["gs"]))).alias("dice"), t["license"].alias("license"), u["unit"].alias("unit"))))

    found = F.filter(F.transform(found, nearest), lambda m: m["dice"] * 1000 >= least)
    # the licences alone, once each, are held against those of stretches
    both = F.flatten(F.transform(F.array(found), lambda f: F.concat(f, F.flatten(F.transform(F.array(F.array_distinct(f["license"])), lambda own: F.filter(stretches(F.col(text), known, every, low, least), lambda m: ~F.array_contains(own, m["license"])))))))
    # explode() would have Spark evaluate the chain once more, in a filter on its size
    out = docs.select(F.col(doc_id).alias("doc_id"), F.explode_outer(both).alias("m"))
    return out.where("m is not null").select("doc_id", "m.license", "m.dice", "m.unit")


def stretches(text: Column, known: Column, every: list[int], low: int, least: int) -> Column:
    """(dice, license) of the licences that stretches with as many bigrams as a template are near to, by each licence's best stretch.

    A stretch begins where the template would if a bigram that both have were at
    its place in the template. Of stretches that overlap, the one with most of
    its template's bigrams counts, so that a licence within another's text is
    not named beside it (of several, the nearest, then the name that sorts
    last). Stretches are sorted, and each is compared with those that begin
    within the longest stretch's length. Templates of which the whole text has
    too few bigrams are not tried.
    """
    once = lambda x, f: F.flatten(F.transform(F.array(x), f))  # noqa: E731  # a lambda's argument is evaluated once
    none = F.array().cast("array<struct<at:int,n:int,common:int,dice:double,license:string>>")
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")

    def tried(t: Column, hits: Column, gs: Column) -> Column:
        def near(at: Column) -> Column:
            def said(own: Column) -> Column:
                def held(common: Column) -> Column:
                    dice = F.lit(2.0) * common / (t["n"] + F.size(own))
                    return F.array(F.struct(at.alias("at"), t["n"].alias("n"), common.alias("common"), dice.alias("dice"), t["license"].alias("license")))

                return once(F.size(F.array_intersect(t["grams"], own)), held)

            return once(F.array_distinct(F.slice(gs, at, t["n"])), said)

        def within(own: Column) -> Column:
            starts = F.array_distinct(F.transform(own, lambda h: F.greatest(h["p"] - F.array_position(t["grams"], h["g"]).cast("int") + 1, F.lit(1))))
            return F.when(F.size(F.array_distinct(own["g"])) >= t["low"], F.filter(F.flatten(F.transform(starts, near)), lambda m: m["dice"] * 1000 >= least)).otherwise(none)

        return once(F.filter(hits, lambda h: F.array_contains(t["grams"], h["g"])), within)

    def begun(ms: Column, shift: Column) -> Column:
        """For each of the sorted stretches, how many begin before its own begin plus ``shift``."""
        marks = F.sort_array(F.concat(F.transform(ms, lambda m: F.struct((m["at"] + shift).alias("at"), F.lit(0).alias("kind"))), F.transform(ms, lambda m: F.struct(m["at"].alias("at"), F.lit(1).alias("kind")))))
        asked = F.filter(F.transform(marks, lambda m, i: F.struct(m["kind"].alias("kind"), i.alias("i"))), lambda m: m["kind"] == 0)
        return F.transform(asked, lambda m, i: m["i"] - i)

    def nearest(ms: Column) -> Column:
        rank = lambda m: F.struct(m["common"], m["dice"], m["license"])

        def compared(each: Column) -> Column:
            def beaten(m: Column, low: Column, high: Column) -> Column:
                return F.exists(F.slice(ms, low + 1, high - low), lambda o: (o["at"] < m["at"] + m["n"]) & (m["at"] < o["at"] + o["n"]) & (rank(o) > rank(m)))

            return F.filter(F.transform(each, lambda e: F.when(~beaten(e["m"], e["low"], e["high"]), F.struct(e["m"]["license"].alias("license"), e["m"]["dice"].alias("dice")))), lambda m: m.isNotNull())

        def zipped(longest: Column) -> Column:
            places = F.zip_with(begun(ms, 1 - longest), begun(ms, longest), lambda low, high: F.struct(low.alias("low"), high.alias("high")))
            return F.zip_with(ms, places, lambda m, p: F.struct(m.alias("m"), p["low"].alias("low"), p["high"].alias("high")))

        best = lambda alone: F.transform(F.array_distinct(alone["license"]), lambda name: F.struct(F.array_max(F.transform(F.filter(alone, lambda m: m["license"] == name), lambda m: m["dice"])).alias("dice"), name.alias("license"), F.lit(None).cast("long").alias("unit")))
        return once(once(once(F.array_max(ms["n"]), zipped), compared), best)

    def places(gs: Column) -> Column:
        hits = F.filter(F.transform(gs, lambda g, i: F.struct(g.alias("g"), (i + 1).cast("int").alias("p"))), lambda h: h["g"].isin(every))
        return once(hits, lambda h: F.when(F.size(h) >= low, F.flatten(F.transform(known, lambda t: tried(t, h, gs)))).otherwise(none))

    grams = lambda ws: F.when(F.size(ws) > 1, F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws)), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
    return F.coalesce(once(once(once(once(words, grams), places), lambda ms: F.sort_array(ms)), nearest), F.array().cast("array<struct<dice:double,license:string,unit:bigint>>"))


def scan(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, n_units, dice of every licence found in a document: in how many different units (1 if only in a stretch), and the best coefficient.

    Rows that share a doc_id are one document: a unit that they repeat counts
    once. A null doc_id is one document too. Only matches are shuffled, summed
    in each task before.
    """
    found = matches(docs, templates, least, doc_id, text).groupBy("doc_id", "license", "unit").agg(F.max("dice").alias("dice"))
    return found.groupBy("doc_id", "license").agg(F.greatest(F.count("unit"), F.lit(1)).alias("n_units"), F.round(F.max("dice"), 6).alias("dice"))
