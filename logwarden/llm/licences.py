"""Licences of files: sparse TF-IDF cosine of windows of terms to templates, then inheritance from the nearest directory above.

All in DataFrame operations. Each file's terms, without comment signs and line breaks, are cut into windows of a template's
length; its single lines count as windows too. Windows that hold too few of the template's terms for the least cosine (a bound, so none is
lost) are left out before anything is exploded. A window is compared with each template by the cosine of their
TF-IDF vectors (frequencies of terms in the templates; a term of no template weighs as one of a single template, and so
only lengthens the window). The best window of a file gives its own licence. A *licence file* is one that is named like one, or
one whose words all together resemble a template; it licenses its directory. A file without a licence of its own takes that of the
nearest directory at or above its own that has one, found by joining its ancestors' paths.

Null texts are empty and null paths are a file in the root of their own, without inheritance. Ties go to the better line, then
the licence first in the alphabet; of several licence files in a directory the best, then the first path. Rows repeated in full
give repeated results. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.cluster import broadcast_if_small, written

#: Licence and the usual wording of its notice.
TEMPLATES = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership."),
    ("EPL-2.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal license."),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words of notices, by which op9_licence_scan names a folder's licence file; ``scan`` does not use them.
MARKERS = "licen[cs]|copyright|redistribut|hereby granted|public domain"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|copyright|notice|unlicense)([.-][a-z0-9.+-]*)?$"
_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_TERM})"), 1)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(TEMPLATES)], "template int, licence string, notice string")


def _vectors(rows: DataFrame, keys: list[str], idf: DataFrame, most: Column) -> DataFrame:
    """(keys, term, weight) with weight = count * idf, of rows with an array column ``terms``."""
    counts = rows.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(idf), "term", "left").select(*keys, "term", (F.col("n") * F.coalesce("idf", most)).alias("weight"))


def similar(rows: DataFrame, keys: list[str], given: DataFrame, least: float) -> DataFrame:
    """(keys, licence, similarity): the best template of each row with terms, if its cosine is at least ``least``.

    The templates are given by the caller and few (``TEMPLATES``, or a table the caller knows to be small)."""
    total = given.select(F.count("*").alias("total"))
    each = given.select("template", "licence", terms(F.col("notice")).alias("terms"))
    df = each.select("template", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(total)).select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    most = F.lit(1.0) + F.log((F.lit(1.0) + F.lit(given.count())) / 2)
    theirs = _vectors(each, ["template", "licence"], idf, most)
    norms = theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("their_norm"))
    theirs = theirs.join(F.broadcast(norms), "template").select("template", "licence", "term", F.col("weight").alias("their_weight"), "their_norm")
    # dealt by key before they are cut into terms: every grouping below then stays inside its task
    mine = _vectors(rows.repartition(*keys), keys, idf, most)
    # norm and products in one grouping: terms of no template have a null template and add to the norm only
    paired = mine.join(F.broadcast(theirs), "term", "left")
    products = paired.filter("template is not null").groupBy(*keys, "template", "licence").agg(
        F.sum(F.col("weight") * F.col("their_weight")).alias("product"), F.first("their_norm").alias("their_norm"))
    norm = mine.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    found = products.join(norm, keys).withColumn("similarity", F.round(F.col("product") / (F.col("norm") * F.col("their_norm")), 9))
    best = found.filter(F.col("similarity") >= least).groupBy(*keys).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "licence")).alias("best"))
    return best.select(*keys, F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("similarity"))


def _masses(given: list, bound: float) -> tuple[Column, Column, Column]:
    """Of the templates (few, see ``similar``): their terms, those of which a text like any of them holds one at least, and an array of
    (terms, size, shares of the squared norm).

    A text whose cosine to a template is at least ``least`` holds terms with at least ``least ** 2`` of its squared norm (Cauchy-Schwarz)."""
    counts = [Counter(x.terms) for x in given if x.terms]
    df = Counter(t for c in counts for t in c)
    parts, anchors = [], set()
    for c in counts:
        square = {t: (n * (math.log((1 + len(given)) / (1 + df[t])) + 1)) ** 2 for t, n in c.items()}
        whole = sum(square.values())
        # the heaviest terms, until the others alone are too light
        rest = whole
        for t in sorted(square, key=lambda t: (-square[t], t)):
            if rest < bound * whole:
                break
            anchors.add(t)
            rest -= square[t]
        shares = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(x / whole).alias("share")) for t, x in square.items()])
        parts.append(F.struct(F.array(*map(F.lit, c)).alias("terms"), F.lit(sum(c.values())).alias("size"), shares.alias("shares")))
    return F.array(*map(F.lit, df)), F.array(*map(F.lit, sorted(anchors))), F.array(*parts)


def _resembles(x: Column, held: Column, bound: float) -> Column:
    return F.aggregate(x["shares"], F.lit(0.0), lambda s, p: s + F.when(F.array_contains(held, p["term"]), p["share"]).otherwise(0.0)) >= bound


def _spans(text: Column, patterns: Column, bound: float) -> Column:
    """Arrays of terms that may resemble a template: windows of its length, across line breaks, from each of its terms on; and single lines."""
    def of(x: Column, t: Column, lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: F.array_contains(x["terms"], F.get(t, i - 1)))
        return F.filter(F.concat(F.transform(starts, lambda i: F.slice(t, i, x["size"])), lines), lambda span: _resembles(x, span, bound))

    # arrays of one element bind what would else be worked out anew for each template
    both = F.array(F.struct(terms(text).alias("t"), F.transform(F.split(text, "\r?\n"), terms).alias("lines")))
    return F.array_distinct(F.flatten(F.flatten(F.transform(both, lambda b: F.transform(
        F.filter(patterns, lambda x: _resembles(x, b["t"], bound)), lambda x: of(x, b["t"], b["lines"]))))))


def scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", given: DataFrame | None = None, least: float = 0.75,
         least_file: float = 0.9) -> DataFrame:
    """Per file: id, path, ``licence`` (null if none), ``similarity``, ``origin`` (header, inherited or none) and ``from_dir``."""
    given = templates(files.sparkSession) if given is None else given
    rows = files.select(F.col(id_col).alias("id"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # rows with equal id, path and text are one file here, and each gets its result in the end
    unnamed = [F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in ("id", "path")]
    rows = rows.withColumn("file", F.sha2(F.concat_ws("\x00", *unnamed, "text"), 256))
    known = given.select(terms(F.col("notice")).alias("terms")).collect()
    bound = min(least, least_file) ** 2 - 1e-6
    vocabulary, anchors, patterns = _masses(known, bound)
    held = F.array(F.array_intersect(terms(F.col("text")), vocabulary))
    marked = rows.withColumn("named", F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)))
    # the few files that may resemble a template at all, found once
    marked = written(marked.filter(F.exists(held, lambda h: F.arrays_overlap(h, anchors) & F.exists(patterns, lambda x: _resembles(x, h, bound)))), "licence-files")
    # what is read more than once is written: each reader would cut and weigh the windows again
    spans = written(marked.select("file", "text").distinct().select("file", F.posexplode(_spans(F.col("text"), patterns, bound)).alias("span", "terms")), "spans")
    own = similar(spans, ["file", "span"], given, least).groupBy("file").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "licence")).alias("own")).select("file", F.col("own.licence").alias("own"), (-F.col("own.s")).alias("own_similarity"))
    own = written(own, "own-licences")
    whole = marked.select("file", terms(F.col("text")).alias("terms")).distinct()
    whole = similar(whole, ["file"], given, least_file).select("file", F.col("licence").alias("of_whole"), F.col("similarity").alias("whole_similarity"))
    scanned = marked.select("file", "path", "named").distinct().join(own, "file", "left").join(whole, "file", "left")
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise("")
    licensed = scanned.filter("path is not null and (of_whole is not null or named and own is not null)").select(
        folder.alias("dir"), F.struct((-F.coalesce("whole_similarity", "own_similarity")).alias("s"), "path", F.coalesce("of_whole", "own").alias("licence")).alias("found"))
    licensed = licensed.groupBy("dir").agg(F.min("found").alias("found")).select("dir", F.col("found.licence").alias("licence"))
    base = rows.select("id", "path", "file", folder.alias("dir")).join(broadcast_if_small(own), "file", "left")
    # nearest licensed ancestor of each directory, not of each file: directories are counted in the map tasks first
    dirs = base.filter("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))).alias("u")).select("dir", "u.depth", F.col("u.above").alias("above"))
    nearest = up.join(licensed.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(
        F.max_by(F.struct("above", "licence"), "depth").alias("near")).select(F.col("dir").alias("_dir"), F.col("near.above").alias("from_dir"), F.col("near.licence").alias("inherited"))
    nearest = written(nearest, "licensed-folders")
    joined = base.join(broadcast_if_small(nearest), F.col("path").isNotNull() & (F.col("dir") == F.col("_dir")), "left")
    origin = F.when(F.col("own").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return joined.select(F.col("id").alias(id_col), "path", F.coalesce("own", "inherited").alias("licence"), F.col("own_similarity").alias("similarity"),
                         origin.alias("origin"), F.when(F.col("own").isNull(), F.col("from_dir")).alias("from_dir"))
