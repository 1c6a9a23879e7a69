"""Licence scan: text units against licence templates by the Dice coefficient of word bigrams.

Units are a document's sentences (up to ``.``, ``!`` or ``?`` before white space, or an empty line, so that a notice
inside a longer line or over several lines is one), its lines, its paragraphs (where it has blank lines) and
the whole document (where it has several lines). Text is normalised to ASCII letters and digits in lower
case, everything else being one space. Dice is taken over bigrams with their counts, 2 * common / (bigrams
of both), and compared with the threshold in whole numbers. The number of words bounds it: only
templates whose size lies within a factor t / (2 - t) of the unit's can reach the threshold t.

Templates are whole notices and each of their sentences that no other licence has. Before any units are made,
documents without an anchor word are left out: anchors are chosen so that every template has more bigrams with
an anchor than a unit at the threshold can lack, so no unit that counts is lost.

A unit counts for the template with the highest coefficient (of ties, the first by name). Result: one
row for each document and licence found, with the best coefficient, the kind and number of the unit
that has it (a document before a paragraph, a line and a sentence, then the first) and the number of units.
Null, empty and wordless texts have no rows; repeated rows are scanned each on its own.
"""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.store import documents

THRESHOLD = 0.8

# Notices and grants as their licences give them.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ],
    "lgpl-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ],
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met:"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0."],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0."],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work."],
}
MAX_TEMPLATE_BIGRAMS = 50_000       # bound of the broadcast side
SENTENCE = "[.!?]+[\x20\t\r\n]+|\n[\x20\t\r]*\n"
LEAST = 4                           # letters of an anchor; bigrams of a sentence that is a template
UNITS = ("sentence", "line", "paragraph", "document")


def words_of(text: str) -> list[str]:
    return re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")


def flat_templates(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(licence, words) of the notices and of their own sentences of ``LEAST`` bigrams or more, by licence."""
    out, licences = [], {}
    for name in sorted(templates):
        for text in templates[name]:
            parts = [words_of(p) for p in re.split(SENTENCE, text)]
            for w in [words_of(text)] + [p for p in parts if len(parts) > 1 and len(p) > LEAST]:
                if (name, w) not in out:
                    out.append((name, w))
                    licences.setdefault(tuple(w), set()).add(name)
    return [(name, w) for name, w in out if len(licences[tuple(w)]) == 1]


def template_rows(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple]:
    """(template number, licence, bigrams of the template, bigram, its count)."""
    rows = []
    for number, (name, w) in enumerate(flat_templates(templates)):
        pairs = Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))
        rows += [(number, name, len(w) - 1, pair, n) for pair, n in sorted(pairs.items())]
    if len(rows) > MAX_TEMPLATE_BIGRAMS:
        raise ValueError(f"{len(rows)} template bigrams; at most {MAX_TEMPLATE_BIGRAMS} are broadcast")
    return rows


def fraction(threshold: float) -> tuple[int, int]:
    """The threshold as a fraction of whole numbers."""
    f = Fraction(str(threshold))
    return f.numerator, f.denominator


def sizes_in_reach(size: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of units that can reach a template of this size."""
    p, q = fraction(threshold)
    return -(-size * p // (2 * q - p)), size * (2 * q - p) // p


def reach(threshold: float = THRESHOLD, templates: dict = TEMPLATES) -> list[tuple[int, int]]:
    """Ranges of numbers of bigrams from which some template can be reached, merged."""
    out = []
    for lo, hi in sorted({sizes_in_reach(n, threshold) for _, _, n, _, _ in template_rows(templates)}):
        lo = max(lo, 1)
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _has(words, pair) -> bool:
    """Whether a text with this bigram holds all the words, alone or inside longer ones."""
    return all(any(x in y for y in pair) for x in words)


def anchors(threshold: float = THRESHOLD, templates: dict = TEMPLATES) -> list[tuple[str, ...]]:
    """Words, or pairs of short words, of which every unit at the threshold has one.

    A unit that reaches a template shares at least t / 2 of both sizes with it, so it can lack no more than the
    rest of the template's bigrams; words are taken until more than that many have one.
    """
    p, q = fraction(threshold)
    lacking = []
    for _, w in flat_templates(templates):
        size = len(w) - 1
        least = -(-p * (size + max(1, sizes_in_reach(size, threshold)[0])) // (2 * q))
        lacking.append([list(zip(w, w[1:], strict=False)), size - max(least, 1) + 1])
    chosen = []
    while open_ones := [(pairs, need) for pairs, need in lacking if need > 0]:
        gain = Counter()
        for pairs, need in open_ones:
            for x in {x for pair in pairs for x in pair if len(x) >= LEAST}:
                gain[x,] += min(need, sum(_has((x,), pair) for pair in pairs))
        gain = gain or Counter(pair for pairs, _ in open_ones for pair in pairs)
        best = max(sorted(gain), key=lambda x: gain[x] * len("".join(x)) ** 2)           # long words are rarer
        chosen.append(best)
        for entry in lacking:
            left = [pair for pair in entry[0] if not _has(best, pair)]
            entry[1] -= len(entry[0]) - len(left)
            entry[0] = left
    return sorted(chosen)


def _n_words(c):
    """Words of a trimmed text with single spaces."""
    return F.when(F.length(c) == 0, 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def _within(n_bigrams, ranges):
    hit = F.lit(False)
    for lo, hi in ranges:
        hit = hit | n_bigrams.between(lo, hi)
    return hit


def text_units(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, doc_id, kind, number, words, n): units that are within some template's reach."""
    ranges = reach(threshold)
    d = documents(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low, anchored = F.lower("text"), F.lit(False)
    for words in anchors(threshold):
        anchored = anchored | reduce(Column.__and__, [F.contains(low, F.lit(w)) for w in words])
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").where(anchored)
    d = d.select("row", "doc_id", "text", F.lower(F.regexp_replace("text", "[^A-Za-z0-9\n]+", " ")).alias("t"))
    trimmed = lambda parts: F.transform(parts, lambda x: F.trim(x))
    d = d.withColumn("lines", trimmed(F.split("t", "\n")))
    blank = F.col("t").contains("\n\n") | F.col("t").contains("\n \n")
    flat = F.array_join(F.filter("lines", lambda x: F.length(x) > 0), " ")
    paragraphs = F.transform(F.split("t", "\n ?\n"), lambda p: F.trim(F.regexp_replace(p, "[ \n]+", " ")))
    none = F.array().cast("array<string>")

    def tagged(parts, kind):
        return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), x.alias("words")))

    # a whole document counts only if its lines' words together are within reach
    total = F.aggregate("lines", F.lit(0), lambda a, x: a + _n_words(x))
    whole = F.when((F.size("lines") > 1) & _within(total - 1, ranges), F.array(flat)).otherwise(none)
    sentences = F.transform(F.split("text", SENTENCE), lambda p: F.trim(F.lower(F.regexp_replace(p, "[^A-Za-z0-9]+", " "))))
    units = F.concat(tagged(sentences, 0), tagged(F.col("lines"), 1), tagged(F.when(blank, paragraphs).otherwise(none), 2),
                     tagged(whole, 3))
    d = d.select("row", "doc_id", F.explode(units).alias("u")).select("row", "doc_id", "u.kind", "u.number", "u.words")
    return d.withColumn("n", _n_words(F.col("words")) - 1).where(_within(F.col("n"), ranges))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    spark, (p, q) = docs.sparkSession, fraction(threshold)
    templates = spark.createDataFrame(template_rows(), "template int, license string, size int, pair string, times int")
    units = text_units(docs, threshold)
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                        lambda i: F.concat(F.col("w")[i], F.lit(" "), F.col("w")[i + 1]))
    found = (units.withColumn("w", F.split("words", " "))
             .select("row", "doc_id", "kind", "number", "n", F.explode(pairs).alias("found"))
             .join(F.broadcast(templates), (F.col("found") == F.col("pair"))
                   & (F.col("size") * p <= F.col("n") * (2 * q - p)) & (F.col("n") * p <= F.col("size") * (2 * q - p))))
    key = ["row", "doc_id", "kind", "number"]
    common = (found.groupBy(*key, "n", "template", "license", "size", "pair", "times").agg(F.count(F.lit(1)).alias("c"))
              .groupBy(*key, "n", "template", "license", "size").agg(F.sum(F.least("c", F.col("times").cast("long"))).alias("common")))
    hits = (common.withColumn("dice", F.lit(2.0) * F.col("common") / (F.col("n") + F.col("size")))
            .where(F.col("common") * 2 * q >= (F.col("n") + F.col("size")) * p))
    best = hits.groupBy(*key).agg(F.max(F.struct("dice", (-F.col("template")).alias("t"), "license")).alias("b"))
    top = F.max(F.struct("b.dice", "kind", (-F.col("number")).alias("number"))).alias("m")
    return (best.groupBy("row", "doc_id", F.col("b.license").alias("license")).agg(top, F.count(F.lit(1)).alias("n_units"))
            .select("doc_id", "license", F.col("m.dice").alias("dice"),
                    F.element_at(F.array(*[F.lit(u) for u in UNITS]), F.col("m.kind") + 1).alias("unit"),
                    (-F.col("m.number")).cast("long").alias("unit_number"), "n_units"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same rows computed per unit and template in DuckDB, without pruning."""
    values = ", ".join(f"({i}, '{name}', '{' '.join(words)}')" for i, (name, words) in enumerate(flat_templates(TEMPLATES)))
    p, q = fraction(threshold)
    return f"""
WITH t AS (SELECT *, string_split(words, ' ') AS w FROM (VALUES {values}) v(template, license, words)),
tb AS (SELECT template, license, len(w) - 1 AS size, w[i] || ' ' || w[i + 1] AS pair, count(*) AS times
       FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT row, doc_id, 0 AS kind, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS number
  FROM (SELECT row, doc_id, string_split_regex(text, '[.!?]+[\\x20\\t\\r\\n]+|\\n[\\x20\\t\\r]*\\n') AS p FROM d)
  UNION ALL
  SELECT row, doc_id, 1, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number FROM d
  UNION ALL
  SELECT row, doc_id, 2, unnest(p), generate_subscripts(p, 1) - 1
  FROM (SELECT row, doc_id, string_split_regex(regexp_replace(text, '[^A-Za-z0-9\\n]+', ' ', 'g'), '\\n ?\\n') AS p FROM d) WHERE len(p) > 1
  UNION ALL
  SELECT row, doc_id, 3, text, 0 FROM d WHERE contains(text, chr(10))),
u AS (SELECT *, string_split(words, ' ') AS w FROM (
  SELECT row, doc_id, kind, number, lower(trim(regexp_replace(part, '[^A-Za-z0-9]+', ' ', 'g'))) AS words FROM parts) WHERE words <> ''),
ub AS (SELECT row, doc_id, kind, number, len(w) - 1 AS n, w[i] || ' ' || w[i + 1] AS pair, count(*) AS c
       FROM (SELECT *, unnest(range(1, len(w))) AS i FROM u) GROUP BY ALL),
hits AS (SELECT row, doc_id, kind, number, template, license, 2.0::DOUBLE * sum(least(c, times)) / (n + size) AS dice
         FROM ub JOIN tb USING (pair) GROUP BY row, doc_id, kind, number, n, template, license, size
         HAVING 2 * {q} * sum(least(c, times)) >= {p} * (n + size)),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY row, kind, number ORDER BY dice DESC, template) = 1)
SELECT doc_id, license, dice, ['sentence', 'line', 'paragraph', 'document'][kind + 1] AS unit,
       number AS unit_number, n_units
FROM (SELECT *, count(*) OVER (PARTITION BY row, license) AS n_units FROM best)
QUALIFY row_number() OVER (PARTITION BY row, license ORDER BY dice DESC, kind DESC, number) = 1"""
