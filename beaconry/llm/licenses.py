"""Licence scans with DataFrame functions only.

Each line of a text, and the whole text where it has several lines, is a unit.  A unit is normalised (A-Z to lower
case; runs of characters other than a-z and 0-9 become one space) and compared with every licence template by the
Dice coefficient over distinct word bigrams, 2 |A & B| / (|A| + |B|).  A coefficient of t or more needs
|A| between |B| t / (2 - t) and |B| (2 - t) / t, so a unit's size leaves few templates, most often none.  A text
matches a template with the best of its units; equal coefficients go to the template that comes first by name.

A notice may be wrapped: runs of consecutive lines, blank ones aside, are units as well, up to the number of words that
the largest template allows.  A run counts where no run or line that overlaps it matches the same licence better; of
equal ones the one of fewest lines is better, then the first.  A run holds t / (2 - t) of its template's bigrams
at least, so runs are built only in texts, and of lines, that hold so many.  Lines stay whole: a short
notice inside a line of other words is no match.  The SQL of this query has no runs; both agree where no notice is wrapped.

Null and empty texts, and those without a unit that reaches the threshold, have a null license, coefficient 0 and
no matches.  Every row of the input gives one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: name -> texts: a usual notice line, and the body where it is short
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-1.0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}


def words_of(text: str) -> list[str]:
    import re

    return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c.isascii() else c for c in text)).split()


def template_rows(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, int, list[str]]]:
    """(license, number, sorted distinct bigrams)"""
    out = []
    for name in sorted(templates):
        for k, text in enumerate(templates[name]):
            w = words_of(text)
            out.append((name, k, sorted({f"{a} {b}" for a, b in zip(w, w[1:])})))
    return out


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: dict[str, list[str]] = TEMPLATES, id_col: str = "doc_id") -> DataFrame:
    """doc_id, license (the best), dice (its coefficient), n_units (units that match a template), licenses (all that match, sorted)."""
    rows = template_rows(templates)
    low = min(len(b) for _, _, b in rows) * threshold / (2 - threshold)
    high = max(len(b) for _, _, b in rows) * (2 - threshold) / threshold
    vocabulary = sorted({w for _, _, b in rows for x in b for w in x.split()})
    text = F.coalesce("text", F.lit(""))
    # bounds in bytes: a bigram set of n has over n words, and `high` distinct bigrams may repeat
    lines = F.split(text, "\n")
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array(text))).otherwise(lines)
    # a unit must hold two neighbouring words of some template: a cheap test in front of the bigrams
    pairs = sorted({x for _, _, b in rows for x in b})
    starts = sorted({x.split()[0] for x in pairs})
    guard = r"(?i)(?<![a-z0-9])(?:" + "|".join(starts) + r")[^a-z0-9]+(?:" + "|".join(vocabulary) + r")(?![a-z0-9])"
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marked = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.when(text.rlike(guard), units).otherwise(F.array().cast("array<string>")).alias("_units"))
    split = lambda u: F.split(F.trim(F.regexp_replace(lower(u), "[^a-z0-9]+", " ")), " ")
    pairs_of = lambda w: F.array_distinct(F.transform(F.slice(w, 2, F.size(w)), lambda x, i: F.concat_ws(" ", w[i], x)))
    words = F.transform(F.filter("_units", lambda u: u.rlike(guard)), split)
    table = F.array(*[F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, b)).alias("b")) for n, _, b in rows])

    def dice(unit, t):
        return F.lit(2.0) * F.size(F.array_intersect(unit, t["b"])) / (F.size(unit) + F.size(t["b"]))

    def compare(unit, among):
        near = F.filter(among, lambda t: (F.size(t["b"]) >= F.size(unit) * F.lit(threshold / (2 - threshold))) & (F.size(t["b"]) * F.lit(threshold / (2 - threshold)) <= F.size(unit)))
        return F.filter(F.transform(near, lambda t: F.struct((-dice(unit, t)).alias("minus"), t["license"].alias("license"))), lambda m: -m["minus"] >= F.lit(threshold))

    none = F.array().cast("array<string>")
    bigrams = marked.select("doc_id", "_units", F.transform(words, pairs_of).alias("_b"))
    fits = F.filter("_b", lambda b: (F.size(b) >= F.lit(low)) & (F.size(b) <= F.lit(high)))
    # the whole text is the last unit, if it isn't the only one; what it holds of the templates bounds what a run can hold
    found = bigrams.select(
        "doc_id",
        "_units",
        F.filter(F.transform(fits, lambda b: compare(b, table)), lambda m: F.size(m) > 0).alias("_m"),
        F.when(F.size("_units") > 1, F.array_intersect(F.element_at("_b", -1), F.array(*map(F.lit, pairs)))).otherwise(none).alias("_hit"),
    )
    least = threshold / (2 - threshold)
    near = F.when(F.size("_hit") >= F.lit(low - 1e-9), F.filter(table, lambda t: F.size(F.array_intersect("_hit", t["b"])) >= F.size(t["b"]) * F.lit(least) - F.lit(1e-9)))
    found = found.select("doc_id", "_units", "_m", "_hit", F.coalesce(near, F.filter(table, lambda t: F.lit(False))).alias("_near"))
    lines = F.filter(F.transform(F.slice("_units", 1, F.size("_units") - 1), split), lambda w: w[0] != "")
    found = found.select("doc_id", "_m", "_hit", "_near", F.when(F.size("_near") > 0, lines).otherwise(F.array().cast("array<array<string>>")).alias("_w"))
    # words and template bigrams of each line, the one into the next line included
    ahead = lambda w, i: F.concat(w, F.slice(F.flatten(F.slice("_w", i + 2, F.lit(1))), 1, 1))
    found = found.select(
        "doc_id", "_m", "_near", "_w",
        F.transform("_w", lambda w: F.size(w)).alias("_n"),
        F.transform(F.transform("_w", ahead), lambda w: F.size(F.array_intersect(pairs_of(w), "_hit"))).alias("_h"),
        F.array_min(F.transform("_near", lambda t: F.size(t["b"]) * F.lit(least) - F.lit(1e-9))).alias("_need"),
    )
    sums = lambda c: F.transform(F.sequence(F.lit(0), F.size(c)), lambda k: F.aggregate(F.slice(c, 1, k), F.lit(0), lambda x, y: x + y))
    found = found.select("doc_id", "_m", "_near", "_w", "_h", "_need", sums("_n").alias("_ns"), sums("_h").alias("_hs"))
    most = int(max(len(words_of(x)) for v in templates.values() for x in v) * (2 - threshold) / threshold) + 1
    last = lambda i: F.least(F.size("_w") - i, F.lit(most))
    over = lambda c, i, k: F.col(c)[i + k] - F.col(c)[i]
    lengths = lambda i: F.filter(F.sequence(F.lit(1), last(i)), lambda k: (F.col("_h")[i] > 0) & (over("_ns", i, k) <= F.lit(most)) & (over("_hs", i, k) >= F.col("_need")))
    runs = F.flatten(F.transform("_w", lambda w, i: F.transform(lengths(i), lambda k: F.struct(i.alias("i"), k.alias("k"), F.flatten(F.slice("_w", i + 1, k)).alias("w")))))
    runs = F.transform(runs, lambda r: F.struct(r["i"].alias("i"), r["k"].alias("k"), pairs_of(r["w"]).alias("b")))
    matches = lambda r: F.transform(
        compare(r["b"], F.col("_near")),
        lambda m: F.struct(r["i"].alias("i"), (r["i"] + r["k"]).alias("end"), m["license"].alias("license"), m["minus"].alias("minus"), F.struct(m["minus"], r["k"], r["i"]).alias("rank")),
    )
    found = found.select("doc_id", "_m", F.size("_w").alias("_all"), F.flatten(F.transform(runs, matches)).alias("_r"))
    beaten = lambda m: F.exists("_r", lambda o: (o["license"] == m["license"]) & (o["i"] < m["end"]) & (m["i"] < o["end"]) & (o["rank"] < m["rank"]))
    # single lines and the whole text are units already
    more = F.filter("_r", lambda m: (m["end"] - m["i"] > 1) & (m["end"] - m["i"] < F.col("_all")) & ~beaten(m))
    found = found.select("doc_id", "_m", more.alias("_r"))
    found = found.select("doc_id", F.flatten("_m").alias("_f"), F.transform("_r", lambda m: F.struct(m["minus"], m["license"])).alias("_g"), (F.size("_m") + F.size(F.array_distinct(F.transform("_r", lambda m: F.struct(m["i"], m["end"]))))).alias("_u"))
    found = found.select("doc_id", F.concat("_f", "_g").alias("_m"), "_u")
    best = F.array_min("_m")
    return found.select(
        "doc_id",
        best["license"].alias("license"),
        F.coalesce(-best["minus"], F.lit(0.0)).alias("dice"),
        F.col("_u").cast("long").alias("n_units"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("_m", lambda m: m["license"])))).alias("licenses"),
    )


def license_sql(threshold: float = 0.8, templates: dict[str, list[str]] = TEMPLATES) -> str:
    values = ", ".join(f"('{n}', {k}, '{x}')" for n, k, b in template_rows(templates) for x in b)
    t = threshold / (2 - threshold)
    return f"""
WITH template(license, k, bigram) AS (VALUES {values}),
sizes AS (SELECT license, k, count(*) AS n FROM template GROUP BY ALL),
base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, string_split(text, chr(10)) AS l, text FROM base),
units AS (SELECT r, u, row_number() OVER () AS unit FROM
  (SELECT r, unnest(CASE WHEN len(l) > 1 THEN list_append(l, text) ELSE l END) AS u FROM lines)),
words AS (SELECT r, unit, string_split(trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
grams AS (SELECT DISTINCT r, unit, w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT r, unit, w, unnest(range(1, len(w))) AS i FROM words)),
counts AS (SELECT r, unit, count(*) AS n FROM grams GROUP BY ALL),
shared AS (SELECT g.r, g.unit, t.license, t.k, count(*) AS both FROM grams g JOIN template t USING (bigram) GROUP BY ALL),
scores AS (SELECT s.r, s.unit, s.license, 2.0::DOUBLE * s.both / (c.n + z.n) AS dice
  FROM shared s JOIN counts c ON s.r = c.r AND s.unit = c.unit JOIN sizes z ON s.license = z.license AND s.k = z.k),
hits AS (SELECT * FROM scores WHERE dice >= {threshold}::DOUBLE),
best AS (SELECT r, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, count(DISTINCT unit) AS n_units, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM hits GROUP BY r)
SELECT b.doc_id, h.license, coalesce(h.dice, 0::DOUBLE) AS dice, coalesce(h.n_units, 0)::BIGINT AS n_units, coalesce(h.licenses, '') AS licenses
FROM base b LEFT JOIN best h USING (r)"""
