"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

All of it is built-in DataFrame functions. Passages are the lines of a file that speak of a licence, each alone and
with its neighbours, and the whole text of licence files. Equal passages are scored once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import stored

#: Licence identifiers with usual wordings of their notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]
MARKER = r"licen[cs]e|copyright|rights reserved|spdx|creative commons|public domain|hereby granted|free software"
TERM = "[a-z]+|[0-9]+(?:[.][0-9]+)?"
#: Names of licence files, whose whole text is a passage.
LICENCE_FILE = "^(?:licen[cs]e|copying|unlicense)(?:[.][a-z]+)?$"
MIN_COSINE = 0.6


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def template_weights(templates: DataFrame) -> DataFrame:
    """``(t, licence, term, weight, idf)``: unit TF-IDF vectors of ``templates(t, licence, text)``."""
    tf = templates.select("t", "licence", F.explode(_terms(F.col("text"))).alias("term")).groupBy("t", "licence", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(F.col("term").alias("d_term")).agg(F.count("*").alias("df"))
    idf = df.select("d_term", (F.log(F.lit(1 + templates.count()) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(idf, F.col("term") == F.col("d_term")).withColumn("x", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy("t").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).withColumnRenamed("t", "n_t")
    return weighted.join(norm, F.col("t") == F.col("n_t")).select("t", "licence", "term", (F.col("x") / F.col("norm")).alias("weight"), "idf")


def passages(text: Column, is_licence_file: Column) -> Column:
    """The distinct passages of a file: marked lines, each with its neighbours, and the whole of a licence file."""
    lines = F.split(text, "\n")
    near = lambda x: F.filter(F.transform(x, lambda line, i: F.when(
        F.lower(line).rlike(MARKER), F.array(line, F.concat_ws(" ", F.get(x, i - 1), line, F.get(x, i + 1))))), lambda p: p.isNotNull())
    marked = F.flatten(F.transform(F.array(lines), near)[0])
    return F.array_distinct(F.concat(marked, F.when(is_licence_file, F.array(text)).otherwise(F.array().cast("array<string>"))))


def passage_scores(found: DataFrame, templates: DataFrame) -> DataFrame:
    """``(pid, licence, score)``: the best template of each passage of ``found(pid, passage)`` that reaches MIN_COSINE.

    ``pid`` is a hash of the passage; equal passages are counted together map-side and never sent whole. Terms that no
    template has count in a passage's length with the weight of a term of no template. Ties go to the first licence in
    order. Scores are rounded to 6 digits.
    """
    weights = stored(template_weights(templates), "licence-weights")
    oov = F.log(1 + F.lit(templates.count())) + 1
    times = found.groupBy(F.col("pid").alias("t_pid")).agg(F.count("*").alias("times"))
    tf = found.select("pid", F.explode(_terms(F.col("passage"))).alias("p_term")).groupBy("pid", "p_term").agg(F.count("*").alias("all"))
    idf = weights.select(F.col("term").alias("i_term"), "idf").distinct()
    weighted = tf.join(idf, F.col("p_term") == F.col("i_term"), "left").withColumn("x", F.col("all") * F.coalesce("idf", oov))
    norm = weighted.groupBy(F.col("pid").alias("n_pid")).agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    norm = norm.join(times, F.col("n_pid") == F.col("t_pid")).select("n_pid", "times", F.sqrt(F.col("square") / F.col("times") / F.col("times")).alias("norm"))
    dots = weighted.where("idf is not null").join(weights, F.col("p_term") == F.col("term")).groupBy("pid", "t", "licence").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(norm, F.col("pid") == F.col("n_pid")).select("pid", "licence", F.round(F.col("dot") / F.col("times") / F.col("norm"), 6).alias("score"))
    best = scored.where(F.col("score") >= MIN_COSINE).groupBy("pid").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("pid", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def scan(files: DataFrame, templates: DataFrame, path: Column, text: Column, carry: list[str] | None = None) -> DataFrame:
    """``(row, path, own, score, licence, inherited_from)`` per row, ``row`` being its columns (only ``carry`` if given).

    ``own`` is the licence that the file's best passage names, with its cosine (ties: first licence in order).
    ``licence`` is that or else the one of the nearest ancestor directory with a licence file, ``inherited_from`` (the
    root is ``""``). Of several licence files in a directory the best score decides, then the first path. Rows with
    the same path are versions of one file and share its licence. A null path inherits nothing and a null text names
    nothing; repeated rows stay repeated.
    """
    rows = files.select(F.struct(*[files[c] for c in (files.columns if carry is None else carry)]).alias("row"), path.alias("path"), text.alias("text"))
    name = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    is_file = F.coalesce(name.rlike(LICENCE_FILE), F.lit(False))
    found = stored(rows.where(F.lower("text").rlike(MARKER) | is_file).where("text is not null")
                   .select("path", F.explode(passages(F.col("text"), is_file)).alias("passage")).withColumn("pid", F.unhex(F.md5("passage"))), "licence-passages")
    scores = stored(passage_scores(found, templates), "licence-scores")
    own = found.select("path", "pid").join(scores, "pid").groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    own = stored(own.select(F.col("path").alias("o_path"), F.col("b.licence").alias("own"), (-F.col("b.s")).alias("score")), "licence-own")

    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    given = own.where(F.lower(F.regexp_extract("o_path", "[^/]*$", 0)).rlike(LICENCE_FILE)).groupBy(folder(F.col("o_path")).alias("g_dir")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), "o_path", "own")).alias("b")).select("g_dir", F.col("b.own").alias("given"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))
    folders = rows.where("path is not null").select(folder(F.col("path")).alias("dir")).distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.*")
    nearest = folders.join(given, F.col("above") == F.col("g_dir")).groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("n"))
    nearest = nearest.select("dir", F.col("n.given").alias("from_above"), F.col("n.above").alias("above"))

    out = rows.select("row", "path").join(own, F.col("path") == F.col("o_path"), "left")
    out = out.join(nearest, folder(F.col("path")) == F.col("dir"), "left")
    return out.select("row", "path", "own", "score", F.coalesce("own", "from_above").alias("licence"), F.when(F.col("own").isNull(), F.col("above")).alias("inherited_from"))
