"""License texts in documents, by DataFrame functions alone.

Templates and documents are cut into words and runs of five words (a shorter template is
one run of all its words). Documents are read in overlapping windows of runs, twice as
long as the templates of a size class and half overlapping, so a template lies in some
window as a whole. Each window's MinHash signature has one row a band; a window and a
template meet where any band agrees. What meets is checked exactly: the share of the
template's runs that the window holds.

Bands: a window that holds the wanted share of a template has a Jaccard similarity J with
it of at least ``least_similarity``; with b bands it is missed with probability (1-J)**b.
b is chosen per size class so that this is below ``MISS``.

Who holds the wanted share of a template's n runs lacks fewer than some number m of them,
so holds one at least of any m. A document without any of m fixed runs of each template of
a size class can hold none of the class and isn't cut into windows for it, and a window
without any isn't looked at further; that leaves the result as it is. Templates are a parameter of bounded number and size;
they are sent to every executor, and nothing of the documents is shuffled but the
matches.
"""

from __future__ import annotations

import math
import pkgutil
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RUN = 5
CONTAINMENT = 0.8
MISS = 1e-5
#: Templates, and words of all templates, at most: the runs needed of them are part of the query.
MOST_TEMPLATES, MOST_WORDS = 2000, 150_000

#: One-sentence notices.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "all-rights-reserved": "All rights reserved.",
}

_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."

#: What the licenses tell authors to put ahead of each file.
HEADERS = {
    "GPL-2.0-header": _GNU.format(name="General Public License", version="2"),
    "GPL-3.0-header": _GNU.format(name="General Public License", version="3"),
    "LGPL-2.1-header": _GNU.format(name="Lesser General Public License", version="2.1").replace("This program", "This library"),
    "LGPL-3.0-header": _GNU.format(name="Lesser General Public License", version="3"),
    "AGPL-3.0-header": _GNU.format(name="Affero General Public License", version="3"),
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

#: Licenses whose whole text is in the folder licenses.
BODIES = "0BSD Apache-2.0 Artistic-1.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 MIT MPL-1.1 MPL-2.0 Unlicense Zlib".split()

TEMPLATES = NOTICES | HEADERS | {f"{n}-text": pkgutil.get_data(__package__, f"licenses/{n}.txt").decode() for n in BODIES}

#: What parts words: anything that is neither an ASCII digit or letter nor beyond ASCII.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_GAP, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; of a null none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP), lambda w: w != "")


def runs_of(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order."""
    whole = F.greatest(F.size(words) - (k - 1), F.lit(0))
    lined = F.arrays_zip(*(F.slice(words, F.lit(j + 1), whole).alias(f"w{j}") for j in range(k)))
    return F.transform(lined, lambda run: F.xxhash64(*(run[f"w{j}"] for j in range(k))))


def settled(value: Column) -> Column:
    """The value as a column of its own: the optimizer would copy an expression into the
    function that uses it, and evaluate it anew for every element there."""
    return F.explode(F.array(value))


def constant(values: set[int]) -> Column:
    """Numbers as an array that is one literal once optimized."""
    return F.split(F.lit(",".join(map(str, sorted(values)))), ",").cast("array<bigint>")


def needed(runs: list[int]) -> list[int]:
    """As many of a template's runs as leave less than the wanted share without them."""
    return sorted(runs)[: len(runs) - math.ceil(CONTAINMENT * len(runs) - 1e-9) + 1]


def least_similarity(runs: int, window: int) -> float:
    """Of a template of so many runs and a window that holds the wanted share of them."""
    held = math.ceil(CONTAINMENT * runs - 1e-9)
    return held / (window + runs - held)


def bands_for(runs: list[int], window: int) -> int:
    return max(1, max(math.ceil(math.log(MISS) / math.log1p(-min(0.999, least_similarity(n, window)))) for n in runs))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and template that some window of it contains by 80 % or
    more: the document's id, license_id, n_runs (of the template, distinct), n_found (the most
    of them in a window) and first_word (where the first such window begins).

    Null and empty texts match nothing; equal ids and repeated rows count as one document;
    a row whose id is null is left out; other columns are ignored whatever their names; an
    empty table, or no templates, gives no rows. Templates without words match nothing.
    """
    given = {k: template_words(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    given = {k: v for k, v in given.items() if v}
    if len(given) > MOST_TEMPLATES or sum(map(len, given.values())) > MOST_WORDS:
        raise ValueError(f"at most {MOST_TEMPLATES} templates of {MOST_WORDS} words in all can be sent to every executor")
    spark = docs.sparkSession
    kinds: dict[int, dict[str, list[int]]] = {}
    for k in sorted({min(RUN, len(v)) for v in given.values()}):
        own = [(n, v) for n, v in given.items() if min(RUN, len(v)) == k]
        frame = spark.createDataFrame(own, "license_id string, words array<string>").select("license_id", F.array_distinct(runs_of(F.col("words"), k)).alias("runs"))
        kinds[k] = {r.license_id: list(r.runs) for r in frame.collect()}
    found = spark.createDataFrame([], "of_doc long, license_id string, n_runs int, n_found int, first_word long")
    cut = docs.select(F.col(id_col).cast("long").alias("of_doc"), settled(words_of(F.col(text_col))).alias("words")).where("of_doc is not null")
    classes: dict[tuple[int, int], dict[str, list[int]]] = {}
    some = F.lit(False)
    for k, sized in kinds.items():
        cut = cut.select("*", settled(runs_of(F.col("words"), k)).alias(f"runs_{k}"))
        for name, runs in sized.items():
            classes.setdefault((k, (len(runs) - 1).bit_length()), {})[name] = runs
    for (k, level), fit in classes.items():
        cut = cut.withColumn(f"may_{k}_{level}", settled(F.arrays_overlap(f"runs_{k}", constant({h for runs in fit.values() for h in needed(runs)}))))
        some = some | F.col(f"may_{k}_{level}")
    cut, _ = stored(cut.drop("words").where(some), "license-runs")
    for (k, level), fit in classes.items():
        half = 1 << level
        may = cut.where(f"may_{k}_{level}").select("of_doc", F.col(f"runs_{k}").alias("runs"))
        found = found.unionByName(_scan_class(may, fit, half, bands_for([len(r) for r in fit.values()], 2 * half)))
    best = found.groupBy("of_doc", "license_id", "n_runs").agg(F.max("n_found").alias("n_found"), F.min("first_word").alias("first_word"))
    return best.withColumnRenamed("of_doc", id_col)


def _bands(runs: Column, count: int) -> Column:
    """The signature: under each band's hash the least of the runs, with the band's number."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: F.xxhash64(b, F.array_min(F.transform(runs, lambda h: F.xxhash64(h, b)))))


def _scan_class(cut: DataFrame, templates: dict[str, list[int]], half: int, bands: int) -> DataFrame:
    spark = cut.sparkSession
    known = spark.createDataFrame(list(templates.items()), "license_id string, template array<long>").coalesce(1)
    keyed = known.select("license_id", F.explode(_bands(F.col("template"), bands)).alias("band"))
    starts = F.sequence(F.lit(0), F.greatest((F.size("runs") - 1) / half, F.lit(0)).cast("int"))
    windows = cut.select("of_doc", F.explode(F.transform(starts, lambda i: F.struct((i * half).cast("long").alias("at"), F.array_distinct(F.slice("runs", i * half + 1, F.lit(2 * half))).alias("held")))).alias("w"))
    # What holds for a document holds for a window: without any of the runs that no match can do without there is none.
    windows = windows.where(F.arrays_overlap("w.held", constant({h for runs in templates.values() for h in needed(runs)})))
    met = windows.select("of_doc", "w.at", "w.held", F.explode(_bands(F.col("w.held"), bands)).alias("band")).join(F.broadcast(keyed), "band").join(F.broadcast(known), "license_id")
    share = F.size(F.array_intersect("held", "template"))
    return met.select("of_doc", "license_id", F.size("template").alias("n_runs"), share.alias("n_found"), F.col("at").alias("first_word")).where(F.col("n_found") >= F.ceil(F.col("n_runs") * F.lit(CONTAINMENT) - 1e-9))


def oracle() -> str:
    """The same windows, each compared with every template, in DuckDB SQL."""
    values = ", ".join("({}, {})".format("'" + n.replace("'", "''") + "'", "[" + ", ".join(f"'{w}'" for w in template_words(v)) + "]") for n, v in TEMPLATES.items())
    return f"""
WITH given(license_id, words) AS (VALUES {values}),
templates AS (
  SELECT license_id, least(5, len(words)) AS k,
         list_distinct(list_transform(range(1, len(words) - least(5, len(words)) + 2), lambda i: list_aggregate(words[i:i + least(5, len(words)) - 1], 'string_agg', ' '))) AS template
  FROM given),
sized AS (SELECT *, len(template) AS n_runs, CAST(2 ** ceil(log2(len(template))) AS BIGINT) AS half FROM templates),
cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
runs AS (
  SELECT doc_id, k, list_transform(range(1, len(words) - k + 2), lambda i: list_aggregate(words[i:i + k - 1], 'string_agg', ' ')) AS runs
  FROM cut, (SELECT DISTINCT k FROM sized)),
starts AS (
  SELECT doc_id, runs, license_id, template, n_runs, half, unnest(range(0, greatest(len(runs), 0), half)) AS first_word
  FROM runs JOIN sized USING (k)
  WHERE list_has_any(runs, template)),
found AS (
  SELECT doc_id, license_id, n_runs, first_word, len(list_distinct(list_filter(runs[first_word + 1:first_word + 2 * half], lambda r: list_contains(template, r)))) AS n_found
  FROM starts)
SELECT doc_id, license_id, CAST(n_runs AS INTEGER) AS n_runs, CAST(max(n_found) AS INTEGER) AS n_found, CAST(min(first_word) AS BIGINT) AS first_word
FROM found WHERE n_found >= ceil(0.8 * n_runs - 1e-9)
GROUP BY ALL
"""
