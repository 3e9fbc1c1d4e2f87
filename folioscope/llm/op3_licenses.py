"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts are lower-cased and cut into words of letters and digits; shingles are
five words, or the whole template if it has fewer.  A template of N shingles,
repeats included, is sought in windows of 2N shingles that start every N/2, so it
lies whole in one even where up to N/2 words have been put into it.  A window that
contains the share ``least`` of the template's n different shingles has a Jaccard
similarity of ``least * n / (2 * N + n - least * n)`` at least, and ``bands_for`` sets
as many one-row bands as make a miss rarer than ``miss`` for any template.  A
retrieved window is a match if it contains the share ``least`` of the template's
shingles exactly.

A band can only collide on one of the template's own minima, so documents and
windows without any of those shingles are left out before their MinHashes are
taken; this loses no collision.  Everything happens within a row: nothing is
shuffled.  Templates travel as literals and are meant to be some hundreds.

Defined cases: null, empty and short texts match nothing; null or repeated ids
are rows like any other; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 5
LEAST = 0.8
MISS = 1e-6
#: Wordings of public licenses and notices.
TEMPLATES = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    (
        "mit-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
    ),
    (
        "apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
)


def bands_for(similarity: float, miss: float) -> int:
    """One-row bands after which windows of this similarity are missed with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column, width: int) -> Column:
    """Hash of every run of ``width`` words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def _minima(shingles: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b))))


@dataclass(frozen=True)
class Template:
    name: str
    width: int
    total: int  #: shingles, repeats included
    shingles: list[int]  #: different ones
    minima: list[int]
    cues: list[int]  #: the shingles that give the minima


def prepared(spark: SparkSession, templates: tuple[tuple[str, str], ...], least: float, miss: float) -> tuple[list[Template], int]:
    """The templates that have words, and the number of bands."""
    rows = spark.createDataFrame([(n, t) for n, t in templates], "name string, text string").withColumn("words", words_of(F.col("text"))).filter(F.size("words") > 0)
    every = []
    for width in range(1, WIDTH + 1):
        own = rows.filter(F.least(F.size("words"), F.lit(WIDTH)) == width).withColumn("all", shingle_hashes(F.col("words"), width))
        every.append((width, own.select("name", F.size("all").alias("total"), F.array_distinct("all").alias("shingles")).collect()))
    similarities = [least * len(r["shingles"]) / (2 * r["total"] + (1 - least) * len(r["shingles"])) for _, found in every for r in found]
    bands = bands_for(min(similarities), miss) if similarities else 1
    out = []
    for width, found in every:
        if found:
            own = spark.createDataFrame(found, "name string, total int, shingles array<long>").withColumn("minima", _minima(F.col("shingles"), bands))
            cues = F.filter("shingles", lambda x: F.exists(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.xxhash64(x, b) == F.element_at("minima", b)))
            out += [Template(r["name"], width, r["total"], r["shingles"], r["minima"], r["cues"]) for r in own.withColumn("cues", cues).collect()]
    return out, bands


def _literal(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" if v != -(1 << 63) else "cast('-9223372036854775808' as bigint)" for v in values) + ")")


def _best_match(h: Column, template: Template, bands: int, least: float) -> Column:
    """The template's best window among shingle hashes, or null."""
    n, total = len(template.shingles), template.total
    mine, own_minima, own_cues = _literal(template.shingles), _literal(template.minima), _literal(template.cues)

    def retrieved(window: Column) -> Column:
        collides = F.exists(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.array_min(F.transform(window, lambda x: F.xxhash64(x, b))) == F.element_at(own_minima, b))
        return F.arrays_overlap(window, own_cues) & collides

    windows = F.transform(F.sequence(F.lit(0), F.size(h) - 1, F.lit(max(1, total // 2))), lambda s: F.struct((-s).alias("start"), F.slice(h, s + 1, F.lit(2 * total)).alias("shingles")))
    kept = F.filter(windows, lambda w: retrieved(w["shingles"]))
    best = F.array_max(F.transform(kept, lambda w: F.struct((F.size(F.array_intersect(w["shingles"], mine)) / n).alias("containment"), w["start"].alias("start"))))
    match = let(best, lambda b: F.when(b["containment"] >= least, F.struct(F.lit(template.name).alias("license"), b["containment"].alias("containment"), (-b["start"]).cast("long").alias("start_word"))))
    return F.when(F.arrays_overlap(h, own_cues), match)


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, license, containment, start_word): the best window of each template found in a document."""
    known, bands = prepared(docs.sparkSession, templates, least, miss)
    widths = sorted({k.width for k in known})
    hashed = let(words_of(F.col(text_col)), lambda w: F.struct(*[shingle_hashes(w, k).alias(f"h{k}") for k in widths]))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.array(hashed)).alias("h")).select("id", *[F.col(f"h.h{w}").alias(f"h{w}") for w in widths])
    cued = F.lit(False)
    for w in widths:
        cued = cued | F.arrays_overlap(f"h{w}", _literal(sorted({c for k in known if k.width == w for c in k.cues})))
    found = F.when(cued, F.array(*[_best_match(F.col(f"h{k.width}"), k, bands, least) for k in known]))
    return rows.select(F.col("id").alias(id_col), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("m")).select(id_col, "m.*")


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> str:
    """The same matches by plain joins of shingles."""
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates)
    cut = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH t0 AS (SELECT name, {cut} AS w FROM (VALUES {values}) v(name, text)),
t1 AS (SELECT DISTINCT name, least(len(w), {WIDTH}) AS width, len(w) - least(len(w), {WIDTH}) + 1 AS total, array_to_string(w[i + 1 : i + least(len(w), {WIDTH})], ' ') AS shingle
       FROM t0, unnest(range(len(w) - least(len(w), {WIDTH}) + 1)) u(i)),
t2 AS (SELECT *, count(*) OVER (PARTITION BY name) AS n, greatest(1, total // 2) AS step FROM t1),
d0 AS (SELECT row_number() OVER () AS r, doc_id, {cut} AS w FROM documents),
d1 AS (SELECT r, doc_id, width, i AS pos, array_to_string(w[i + 1 : i + width], ' ') AS shingle
       FROM d0, (SELECT DISTINCT width FROM t1) x, unnest(range(greatest(len(w) - width + 1, 0))) u(i)),
hits AS (SELECT r, doc_id, name, n, step, total, pos, shingle, pos // step - unnest(range((2 * total - 1) // step + 1)) AS win FROM d1 JOIN t2 USING (width, shingle)),
wins AS (SELECT r, doc_id, name, win, n, step, CAST(count(DISTINCT shingle) AS DOUBLE) / n AS containment FROM hits WHERE win >= 0 AND pos - win * step < 2 * total GROUP BY r, doc_id, name, win, n, step),
best AS (SELECT r, doc_id, name, max(containment) AS containment FROM wins GROUP BY r, doc_id, name)
SELECT b.doc_id, b.name AS license, b.containment, CAST(min(w.win * w.step) AS BIGINT) AS start_word
FROM best b JOIN wins w ON b.r = w.r AND b.name = w.name AND b.containment = w.containment
WHERE b.containment >= {least} GROUP BY b.r, b.doc_id, b.name, b.containment
"""
