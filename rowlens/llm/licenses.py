"""Licence scan: Dice coefficient over word bigrams against licence templates.

Only DataFrame functions. Every line of a document, and the document as a
whole, is normalised and compared with the templates. The coefficient of two
sets cannot reach a threshold unless their sizes are close, so a candidate is
paired only with the templates whose size bounds it meets.

A licence that no line and not the whole text shows may still stand in a
passage: wrapped over lines, inside a line, or as a whole licence text with
other text around it. Passages are runs of words of any place; see
:func:`passages`.
"""

from __future__ import annotations

from math import ceil
from pathlib import Path

import regex
from pyspark.sql import Column, DataFrame, functions as F

MIN_DICE = 0.8

# Public licence notices, by their usual short identifiers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
}

# Whole licence texts; they are looked for as passages only.
TEXTS = {f"{p.stem}-text": p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
# A passage of a template of more pairs than this may begin at every (pairs / this)-th shared pair only.
STARTS = 128


def normalised(text: Column) -> Column:
    """Lower case; everything but letters, digits and single spaces between words is gone."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; a single word stands for itself."""
    n = F.size(words)
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.array_distinct(F.when(n > 1, pairs).otherwise(words))


def template_words(template: str) -> list[str]:
    return regex.sub(r"[^\p{L}\p{N}]+", " ", template.lower()).split()


def template_grams(template: str) -> list[str]:
    """As :func:`bigrams` of the normalised text, for the few constant templates."""
    words = template_words(template)
    return sorted({" ".join(p) for p in zip(words, words[1:])} or set(words))


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` under a name, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def passages(words: str, known: str, templates: dict[str, str], threshold: float) -> str:
    """SQL of ``array<struct<license, dice>>``: the best passage of each template that reaches the threshold.

    A passage is a run of words that begins with a pair of the template and has
    at most ``(2 - threshold) / threshold`` times its pairs. For each beginning
    the end moves word by word and the distinct pairs, and those of the template,
    are counted up; the pair at a place is new if its last place before is ahead
    of the beginning. A passage above the threshold shares at least
    ``threshold / (2 - threshold)`` of the template's pairs, so a text with fewer
    of them, or a beginning with fewer in reach, is left out. Templates named in
    ``known`` are not looked for again.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    kind = "array<struct<license:string,dice:double>>"
    among = {n: "({})".format(", ".join(f"'{g}'" for g in template_grams(t))) for n, t in sorted(templates.items())}
    sizes = {n: len(template_grams(t)) for n, t in templates.items()}
    spans = {n: len(template_words(t)) - 1 for n, t in templates.items()}
    found = []
    for name, grams in among.items():
        size, need = sizes[name], ceil(low * sizes[name] - 1e-9)
        if spans[name] < 1:
            continue
        reach, step = int(high * spans[name] + 1e-9), max(1, size // STARTS)
        begins = (
            f"filter(own, (h, j) -> j % {step} = 0 and coalesce(get(own, j + {need - 1}).at - h.at < {reach}, false))"
        )
        sequence = _let(
            "keyed",
            "sort_array(transform(pairs, (g, i) -> struct(g as g, i as i)))",
            "sort_array(transform(keyed, (k, j) -> struct(k.i as at, "
            "if(get(keyed, j - 1).g = k.g, get(keyed, j - 1).i, -1) as prev, "
            f"k.g in {grams} as hit)))",
        )
        shared = "s.c + if(x.prev < b.at and x.hit, 1, 0)"
        distinct = "s.g + if(x.prev < b.at, 1, 0)"
        score = (
            f"aggregate(slice(seq, b.at + 1, {reach}), struct(0 as c, 0 as g, 0D as d), (s, x) -> "
            f"struct({shared} as c, {distinct} as g, "
            f"greatest(s.d, 2 * ({shared}) / ({distinct} + {size})) as d), s -> s.d)"
        )
        best = f"if(size(begins) > 0, {_let('seq', sequence, f'array_max(transform(begins, b -> {score}))')}, 0D)"
        searched = f"if(size(array_distinct(own.gram)) >= {need}, {_let('begins', begins, best)}, 0D)"
        hits = f"if(array_contains({known}, '{name}'), slice(hits, 1, 0), filter(hits, h -> h.gram in {grams}))"
        found.append(f"struct('{name}' as license, {_let('own', hits, searched)} as dice)")
    if not found:
        return f"cast(array() as {kind})"
    every = ", ".join(sorted({f"'{g}'" for t in templates.values() for g in template_grams(t)}))
    hits = f"filter(transform(pairs, (g, i) -> if(g in ({every}), struct(i as at, g as gram), null)), h -> h is not null)"
    listed = f"filter(array({', '.join(found)}), m -> m.dice >= {threshold}D)"
    n = "size(w) - 1"
    pairs = f"zip_with(slice(w, 1, greatest({n}, 0)), slice(w, 2, greatest({n}, 0)), (a, b) -> concat(a, ' ', b))"
    return _let("w", words, _let("pairs", pairs, _let("hits", hits, listed)))


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    threshold: float = MIN_DICE,
    id_column: str = "doc_id",
    text_column: str = "text",
    texts: dict[str, str] = TEXTS,
) -> DataFrame:
    """One row per document: id, ``licenses`` (sorted), ``n_matches``, ``best_license``, ``best_dice``.

    A unit is a distinct line or the whole text; a template or whole licence
    text that no unit shows is looked for in passages and counts once. Null and empty texts match
    nothing: an empty list, 0, null, null. A tie for the best goes to the first
    identifier. Rows that repeat an id are scanned each by itself. The few
    templates are constants of the plan, so a document is scanned where it is
    read and nothing is shuffled.
    """
    grams = {name: template_grams(t) for name, t in sorted(templates.items())}
    grams = {name: g for name, g in grams.items() if g}
    # The bounds are rounded outwards; the coefficient itself decides.
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    sizes = [len(g) for g in grams.values()]
    least, most = min(sizes, default=1) * low, max(sizes, default=0) * high
    constants = F.array(
        *[
            F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g)).alias("size"))
            for n, g in grams.items()
        ]
    )

    def dice(unit: Column, template: Column) -> Column:
        size = F.size(unit)
        near = (size >= low * template["size"]) & (size <= high * template["size"])
        shared = F.size(F.array_intersect(unit, template["grams"]))
        return F.when(near, 2 * shared / (size + template["size"]))

    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text"))
    lines = F.array_distinct(F.concat(F.split("text", "\n"), F.array("text")))
    # n pairs have n words at least, and n words 2n - 1 characters.
    units = rows.select("id", "text", F.filter(lines, lambda u: F.length(u) >= 2 * least - 1).alias("units"))
    words = F.transform("units", lambda u: F.split(normalised(u), " "))
    pairs = units.select("id", "text", F.transform(words, bigrams).alias("units"))
    candidates = pairs.select("id", "text", F.filter("units", lambda g: F.size(g).between(least, most)).alias("units"))
    found = F.transform(
        "units",
        lambda g: F.filter(
            F.transform(constants, lambda t: F.struct(t["license"].alias("license"), dice(g, t).alias("dice"))),
            lambda m: m["dice"] >= threshold,
        ),
    )
    matched = candidates.select("id", "text", F.flatten(found).alias("by_unit"))
    words = matched.select("id", "by_unit", F.split(normalised(F.col("text")), " ").alias("words"))
    more = F.expr(passages("words", "by_unit.license", {**texts, **templates}, threshold))
    scanned = words.select("id", F.concat("by_unit", more).alias("found"))
    best = F.array_min(F.transform("found", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"))))
    return scanned.select(
        F.col("id").alias(id_column),
        F.array_sort(F.array_distinct(F.transform("found", lambda m: m["license"]))).alias("licenses"),
        F.size("found").cast("long").alias("n_matches"),
        best["license"].alias("best_license"),
        (-best["d"]).alias("best_dice"),
    )
