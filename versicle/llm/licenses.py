"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

DataFrame functions only. A text is its words (runs of a-z and 0-9 after lower-casing), and
these its shingles of ``SHINGLE`` words; a template shorter than that is one shingle of its own
length and isn't used. Templates are classed by their number of shingles, rounded up to a power
of two ``s``; windows of ``2 s`` shingles begin at every ``s``-th, so each occurrence of a template
lies whole in some window. Of a window that holds ``CONTAINMENT`` of a template, the Jaccard
similarity is bounded below; the number of bands is chosen from that bound so that window and
template share a band with probability ``COLLISION`` at least. Candidates are verified by exact
containment of the template's shingles.

Bands retrieve: what is looked up in a text are the shingles that are a band's minimum in some template, and a
window is a candidate where such a shingle is the minimum of the window itself under the same band's seed. Windows
without any of these shingles share no band, so their minima need not be computed; no other shingle is looked up.

Templates are a parameter: pairs of license and text, or a table ``template int, license, text`` of any size,
which is scanned ``GROUP`` templates at a time, so that the minima in a plan and the bands broadcast are bounded.
Defined cases: null and empty texts and texts shorter than a shingle match nothing; rows with equal ids are one
document in the result; repeated passages count once, at their first word; empty tables give no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
COLLISION = 0.9999
#: Templates scanned in one pass: at most 41 minima of each are in the plan.
GROUP = 400

# Short public notices and the openings of public licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def shingles_of(text: str, k: int = SHINGLE) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)))


def step_of(n: int) -> int:
    """The stride of the windows for a template of ``n`` shingles."""
    return 1 << max(0, n - 1).bit_length()


def bands_for(n: int, containment: float = CONTAINMENT, collision: float = COLLISION) -> int:
    """Bands of one minimum each for a template of ``n`` shingles: enough for the least similarity that containment allows."""
    shared = math.ceil(containment * n - 1e-9)
    least = shared / (2 * step_of(n) + n - shared)
    return 1 if least >= 1 else math.ceil(math.log(1 - collision) / math.log(1 - least))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: str, k: int) -> Column:
    # Never below zero: the optimizer may evaluate this before it drops texts shorter than a shingle.
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - k))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i + 1, k), " "))


def _minima(shingles: str, bands: Column) -> Column:
    """The least ``hash, shingle`` under each of ``bands`` seeds, as one array."""
    seeds = F.sequence(F.lit(0), bands - 1)
    return F.transform(seeds, lambda seed: F.array_min(F.transform(shingles, lambda s: F.struct(F.xxhash64(s, seed).alias("hash"), s.alias("shingle")))))


def template_table(spark: SparkSession, templates=TEMPLATES, k: int = SHINGLE, containment: float = CONTAINMENT, collision: float = COLLISION) -> DataFrame:
    """``template, license, step, bands, known array<string>`` for each template of ``k`` words or more."""
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame([(n, name, text) for n, (name, text) in enumerate(templates)], "template int, license string, text string")
    rows = templates.select("template", "license", _words(F.col("text")).alias("words")).where(F.size("words") >= k)
    rows = rows.select("template", "license", F.array_distinct(_shingles("words", k)).alias("known")).withColumn("n", F.size("known"))
    rows = rows.withColumn("step", F.when(F.col("n") <= 1, 1).otherwise(F.pow(F.lit(2), F.length(F.bin(F.col("n") - 1)))).cast("int"))
    shared = F.ceil(containment * F.col("n") - 1e-9)
    least = shared / (2 * F.col("step") + F.col("n") - shared)
    bands = F.when(least >= 1, 1).otherwise(F.ceil(math.log(1 - collision) / F.log(1 - least))).cast("int")
    return rows.select("template", "license", "step", bands.alias("bands"), "known")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, k: int = SHINGLE, containment: float = CONTAINMENT, collision: float = COLLISION) -> DataFrame:
    """``id_col, license, template int, first_word int (from 0), containment double`` of each template found in each document."""
    table = template_table(df.sparkSession, templates, k, containment, collision)
    groups = -(-table.count() // GROUP)
    none = "CAST(NULL AS string) AS license, CAST(NULL AS int) AS template, CAST(NULL AS int) AS first_word, CAST(NULL AS double) AS containment"
    if not groups:
        return df.limit(0).selectExpr(f"`{id_col}`", *none.split(", "))
    parts = [table.where(F.pmod(F.xxhash64("template"), F.lit(groups)) == n) if groups > 1 else table for n in range(groups)]
    docs = df.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words")).where(F.size("words") >= k)
    docs = docs.select("id", _shingles("words", k).alias("shingles"))
    found = [_scan(docs, part, containment) for part in parts]
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id", id_col)


def _scan(docs: DataFrame, table: DataFrame, containment: float) -> DataFrame:
    """``docs(id, shingles)`` against about ``GROUP`` templates."""
    theirs = table.select("step", "template", F.posexplode(_minima("known", F.col("bands"))).alias("band", "least"))
    theirs = theirs.groupBy("step", "band", F.col("least")["hash"].alias("least"), F.col("least")["shingle"].alias("shingle")).agg(F.collect_set("template").alias("templates"))
    # At most 41 minima of each of the group's templates.
    minima: dict[int, set[str]] = {}
    bands: dict[int, int] = {}
    for row in theirs.select("step", "band", "shingle").collect():
        minima.setdefault(row.step, set()).add(row.shingle)
        bands[row.step] = max(bands.get(row.step, 0), row.band + 1)
    every = sorted(set().union(*minima.values()))
    hits = F.filter(F.transform("shingles", lambda s, i: F.when(s.isin(every), F.struct(i.alias("i"), s.alias("s")))), lambda h: h.isNotNull())
    # Each hit's two windows of its classes; windows that several hits share are one. Few rows come of many
    # shingles: an explode of the shingles themselves would copy the array beside each.
    both = lambda step: lambda h: F.array(*[F.struct(F.lit(step).alias("step"), (F.floor(h["i"] / F.lit(step)) - back).cast("int").alias("window")) for back in (0, 1)])
    of = lambda step: F.filter("hits", lambda h: h["s"].isin(sorted(minima[step])))
    near = F.array_distinct(F.concat(*[F.flatten(F.transform(of(step), both(step))) for step in sorted(minima)]))
    # No filter on the hits: it would be pushed below the shingles and make them anew for each place.
    windows = docs.select("id", "shingles", hits.alias("hits")).select("id", "shingles", F.explode(near).alias("w"))
    windows = windows.select("id", "shingles", "w.step", "w.window").where("window >= 0")
    windows = windows.select("id", "step", "window", F.slice("shingles", F.col("window") * F.col("step") + 1, 2 * F.col("step")).alias("shingles"))
    windows = windows.groupBy("id", "step", "window").agg(F.first("shingles").alias("shingles"))
    n_bands = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(bands.items()) for x in pair]), F.col("step"))
    met = windows.select("id", "step", "window", "shingles", F.posexplode(_minima("shingles", n_bands)).alias("band", "m"))
    met = met.select("id", "step", "window", "shingles", "band", F.col("m")["hash"].alias("least"))
    # Both sides of this join and of the next are broadcast from a bounded group of templates.
    met = met.join(F.broadcast(theirs.drop("shingle")), ["step", "band", "least"]).select("id", "step", "window", "shingles", F.explode("templates").alias("template"))
    met = met.groupBy("id", "step", "window", "template").agg(F.first("shingles").alias("shingles")).join(F.broadcast(table.drop("step", "bands")), "template")
    shared = F.size(F.array_intersect("shingles", "known"))
    places = F.transform("shingles", lambda s, i: F.when(F.array_contains("known", s), i))
    first = F.col("window") * F.col("step") + F.array_min(places)
    found = met.select("id", "license", "template", first.alias("first_word"), (shared / F.size("known")).alias("containment")).where(F.col("containment") >= containment)
    return found.groupBy("id", "license", "template").agg(F.min("first_word").alias("first_word"), F.max("containment").alias("containment"))


def sql(templates=TEMPLATES, k: int = SHINGLE, containment: float = CONTAINMENT) -> str:
    """Exact containment over the same windows, by joining every shingle with those of the templates."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [f"({n}, {quote(name)}, {step_of(len(s))}, {len(s)}, {quote(x)})" for n, (name, text) in enumerate(templates) if (s := shingles_of(text, k)) for x in s]
    return f"""
WITH known(template, license, step, size, shingle) AS (VALUES {', '.join(rows)}),
words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
places AS (SELECT doc_id, p, array_to_string(w[p + 1:p + {k}], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(0, len(w) - {k - 1})) AS p FROM words)),
hits AS (SELECT doc_id, template, license, step, size, shingle, p FROM places JOIN known USING (shingle)),
windowed AS (
  SELECT *, p // step AS win FROM hits UNION ALL SELECT *, p // step - 1 FROM hits WHERE p >= step
),
matches AS (
  SELECT doc_id, license, template, min(p) AS first_word, count(DISTINCT shingle) / any_value(size)::DOUBLE AS containment
  FROM windowed GROUP BY doc_id, license, template, win HAVING count(DISTINCT shingle) / any_value(size)::DOUBLE >= {containment}
)
SELECT doc_id, license, template, min(first_word)::INT AS first_word, max(containment) AS containment FROM matches GROUP BY doc_id, license, template
"""
