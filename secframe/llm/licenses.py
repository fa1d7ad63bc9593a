"""Licence scan: TF-IDF cosine of text lines to notice templates, then inheritance along directories.

A line is a sparse vector of log-scaled term counts times the inverse document frequencies of the
corpus.  Terms that no template has count with the largest weight there can be.  A file whose words
are in good part notices is a licence file: it speaks for its directory and all below, until a
nearer one does.
"""
from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from secframe.llm.common import Scratch, ascii_lower, table, text_of

#: Name -> notice, in the words of the licences' own recommendations.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
}
#: A line is a notice from this cosine on; a file is a licence file from this share of notice words on.
LIKE, FILE_SHARE = 0.75, 0.25


def _terms(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), "[^a-z0-9]+"), "")


def term_weights(docs: DataFrame, text: str, terms: list[str]) -> tuple[dict, float]:
    """(inverse document frequency per template term, the weight of any other term), over all documents."""
    has = docs.select(F.explode_outer(F.array_intersect(_words(text_of(text)), F.array(*map(F.lit, terms)))).alias("term"),
                      F.monotonically_increasing_id().alias("rid"))
    counts = {r.term: r.n for r in has.filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = docs.count()
    weigh = lambda df: math.log((1 + n) / (1 + df)) + 1
    return {t: weigh(counts.get(t, 0)) for t in terms}, weigh(0)


def notice_lines(docs: DataFrame, carry: list[Column], text: str = "text", templates: dict | None = None, like: float = LIKE) -> DataFrame:
    """``carry``, line, n_words, license, similarity of every line that is like a template (the first by name among equals)."""
    templates = templates or TEMPLATES
    vectors = {name: Counter(_terms(t)) for name, t in templates.items()}
    terms = sorted({t for v in vectors.values() for t in v})
    idf, other = term_weights(docs, text, terms)
    at = docs.select(*carry, F.posexplode(F.split(text_of(text), "\n")).alias("line", "__l"))
    at = at.withColumn("__w", _words(F.col("__l"))).drop("__l")
    at = at.withColumn("__k", F.filter("__w", lambda w: w.isin(terms))).withColumn("n_words", F.size("__w")).drop("__w")
    # (1 + ln c)^2 <= 1.48 c and no term weighs more than the others do: no line can be lost here
    at = at.filter(1.48 * F.size("__k") >= like * like * (0.48 * F.size("__k") + F.col("n_words")))
    is_term = lambda t: lambda w: w == t
    count = {t: F.size(F.filter("__k", is_term(t))) for t in terms}
    tf = lambda c: F.when(c > 0, 1 + F.log(c)).otherwise(0.0)
    at = at.select("*", *[(tf(count[t]) * idf[t]).alias(f"__t{i}") for i, t in enumerate(terms)])
    w = {t: F.col(f"__t{i}") for i, t in enumerate(terms)}
    norm = F.sqrt(sum((w[t] * w[t] for t in terms), F.lit(0.0)) + (F.col("n_words") - F.size("__k")) * (other * other))
    scored = []
    for name in sorted(vectors):
        v = {t: (1 + math.log(c)) * idf[t] for t, c in vectors[name].items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        dot = sum((w[t] * F.lit(x) for t, x in v.items()), F.lit(0.0))
        scored.append(F.struct((dot / (norm * length)).alias("similarity"), F.lit(name).alias("license")))
    names = [c for c in at.columns if not c.startswith("__")]
    at = at.filter(F.size("__k") > 0).select(*names, F.array(*scored).alias("__s"))
    top = F.array_max(F.transform("__s", lambda s: s["similarity"]))
    at = at.withColumn("__top", top).filter(F.col("__top") >= like)
    return at.select(*names, F.filter("__s", lambda s: s["similarity"] == F.col("__top"))[0]["license"].alias("license"),
                     F.col("__top").alias("similarity"))


def parent(path: Column) -> Column:
    """Directory of a path, '' at the top."""
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def license_scan(docs: DataFrame, path: Column, id: str = "doc_id", text: str = "text", templates: dict | None = None,
                 like: float = LIKE, file_share: float = FILE_SHARE) -> DataFrame:
    """One row per document row: ``id``, path, license, similarity, n_notices, origin, from_dir.

    A document's own licence is that of its most similar notice line, of the first such line among
    equals; origin is then 'own'.  Others inherit from the nearest directory at or above theirs that
    has a licence file ('inherited'; the most similar file speaks for a directory, of equals the
    first path), or have none ('none').  Null texts have no notice, a null path lies at the top, a
    null id is kept, repeated rows are scanned each; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    where = F.coalesce(path, F.lit(""))
    rows = docs.select(F.struct(F.col(id).alias("id")).alias("doc"), where.alias("path"), text_of(text).alias("text"),
                       F.xxhash64(text_of(text)).alias("version"), F.size(_words(text_of(text))).alias("words"))
    lines = notice_lines(rows, [F.col(c) for c in ("doc", "path", "version", "words")], "text", templates, like)
    key = ["doc", "path", "version"]
    # a repeated row repeats its lines: they are counted once
    lines = scratch.keep(lines.dropDuplicates([*key, "line"]), "lines")
    best = F.max(F.struct("similarity", (-F.col("line")).alias("first"), "license"))
    own = lines.groupBy(*key, "words").agg(best.alias("best"), F.count(F.lit(1)).alias("n_notices"), F.sum("n_words").alias("notice_words"))
    own = scratch.keep(own.select(*key, "best.license", "best.similarity", "n_notices", (F.col("notice_words") >= file_share * F.col("words")).alias("file")), "own")
    files = own.filter("file").select(parent(F.col("path")).alias("dir"), "license", "similarity", "path")
    speaks = files.groupBy("dir").agg(F.max("similarity").alias("similarity")).join(files, ["dir", "similarity"])
    speaks = speaks.groupBy("dir").agg(F.min(F.struct("path", "license")).alias("file")).select(F.col("dir").alias("above"), F.col("file.license").alias("given"))
    places = scratch.keep(rows.select("doc", "path", "version"), "places")
    dirs = places.select(parent(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    # a directory's name joined up to each depth, and the top
    ups = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))).alias("above"))
    near = ups.join(speaks, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "given")).alias("near"))
    out = places.withColumn("dir", parent(F.col("path")))
    out = out.join(own.select(*key, "license", "similarity", "n_notices"), key, "left")
    out = out.join(near, "dir", "left")
    has = F.col("license").isNotNull()
    return out.select(
        F.col("doc.id").alias(id), "path", F.coalesce("license", "near.given").alias("license"), "similarity",
        F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"),
        F.when(has, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("near.above")).alias("from_dir"))


def op3_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return license_scan(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
