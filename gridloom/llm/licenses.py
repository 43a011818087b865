"""License scan: MinHash bands over overlapping windows retrieve templates, shingle containment verifies.

A text is cut into blocks of ``BLOCK`` shingles; a window is two blocks, so any run of ``BLOCK`` + 1
shingles lies in one. Templates are cut into pieces of at most that many. A piece of ``m`` shingles that
occurs in a window of ``2 BLOCK`` has a resemblance of at least ``m / (2 BLOCK)``; with ``BANDS``
bands of one row each it is retrieved with probability ``1 - (1 - m / (2 BLOCK)) ** BANDS``, which
is 0.9995 for three shingles and more for longer pieces. Templates of several pieces have as many
chances. A template of at most ``BLOCK`` shingles is only found whole at the containment asked for by
default, so its first shingles are looked up among the text's own: none is missed.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import attach, stored

WIDTH = 3
BLOCK = 4
BANDS = 16
CONTAINMENT = 0.8
GAP = r"[^\p{L}\p{N}]+"
# Licenses and the sentences that state them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without permission."),
    ("proprietary", "All rights reserved."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("GPL-3.0", "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program"),
    ("GPL-2.0", "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("LGPL-2.1", "By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("AGPL-3.0", "By contrast, our General Public Licenses are intended to guarantee your freedom to share and change all versions of a program"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License"),
    ("Apache-2.0", '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    ("MPL-2.0", '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC0-1.0", "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator"),
)


def seeds(bands: int) -> list[int]:
    """Random masks; a band's value is the least ``hash XOR mask`` of a window."""
    source = random.Random(20240)
    return [source.getrandbits(64) - (1 << 63) for _ in range(bands)]


def words_of(text):
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def shingle_hashes(words, width: int):
    """Hashes of all runs of ``width`` words; of the whole if there are fewer."""
    n = F.greatest(F.size(words) - width, F.lit(0))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def template_table(spark: SparkSession, templates=TEMPLATES, width: int = WIDTH) -> DataFrame:
    """``template, license, n_words, shingles, pieces`` of the templates, which are an argument and few."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, license string, text string").withColumn("w", words_of(F.col("text")))
    hashed = table.where(F.size("w") > 0).withColumn("h", shingle_hashes(F.col("w"), width))
    starts = F.sequence(F.lit(1), F.size("h"), F.lit(BLOCK))
    pieces = F.transform(starts, lambda s: F.slice("h", F.greatest(F.least(s, F.size("h") - (BLOCK - 1)), F.lit(1)), F.lit(BLOCK)))
    return hashed.select("template", "license", F.size("w").alias("n_words"), F.array_distinct("h").alias("shingles"), pieces.alias("pieces"))


def license_matches(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, width: int = WIDTH, bands: int = BANDS) -> DataFrame:
    """``doc_id, license, template, containment, first_word`` per row of ``docs`` and template found.

    ``containment`` is the share of the template's shingles that stand within a template's length of a
    retrieved window, the largest over windows; of templates found at one place the best stays. NULL and empty texts match nothing; repeated rows each
    have their matches; no templates or an empty table give an empty result. Nothing is shuffled but
    retrieved windows.
    """
    spark = docs.sparkSession
    masks = seeds(bands)
    table = stored(template_table(spark, templates, width), "license-templates")
    band = lambda hashes: F.array(*[F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(m)))) for m in masks])
    # Of a short template as many shingles as may be missing, and one more: one of them is in any text that holds it.
    sure = F.slice("shingles", 1, F.floor(F.size("shingles") * (1 - containment) + 1e-9).cast("int") + 1)
    short = table.where(F.size("shingles") <= BLOCK).select("template", F.explode(sure).alias("key"), F.lit(True).alias("own"))
    banded = table.select("template", F.explode("pieces").alias("p")).select("template", F.explode(band(F.col("p"))).alias("key"), F.lit(False).alias("own"))
    keys = stored(banded.unionByName(short).distinct(), "license-keys")
    # As many values as pieces of the given templates times bands.
    values = keys.select("key", "own").distinct().collect()
    wanted, own = [r["key"] for r in values if not r["own"]], [r["key"] for r in values if r["own"]]
    reach = table.agg(F.max("n_words")).first()[0] or 0
    span = 2 * BLOCK + width - 1

    texts = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    hashed = texts.where(F.size("w") > 0).withColumn("h", shingle_hashes(F.col("w"), width))
    # Every block's least value per band; entries beyond the end are NULL and skipped.
    least = lambda b, m: F.least(*[F.get("h", b * BLOCK + k).bitwiseXOR(m) for k in range(BLOCK)])
    last = F.ceil(F.size("h") / BLOCK).cast("int") - 1
    mask_column = F.array(*[F.lit(m) for m in masks])
    blocks = hashed.withColumn("m", mask_column).withColumn(
        "b", F.transform(F.sequence(F.lit(0), last), lambda b: F.transform("m", lambda m: least(b, m)))
    ).withColumn("s", F.filter(F.transform("h", lambda h, i: F.struct(F.floor(i / BLOCK).cast("int").alias("at"), h.alias("key"))), lambda x: x["key"].isin(own))).drop("m", "h")
    window = lambda b: F.zip_with(F.get("b", b), F.coalesce(F.get("b", b + 1), F.get("b", b)), lambda x, y: F.least(x, y))
    hits = F.transform(F.sequence(F.lit(0), F.size("b") - 1), lambda b: F.struct(
        b.alias("at"), F.concat(F.filter(window(b), lambda k: k.isin(wanted)), F.transform(F.filter("s", lambda x: x["at"] == b), lambda x: x["key"])).alias("keys")
    ))
    # The row number tells rows apart; not being deterministic, it also keeps the filter on the hits
    # from being moved below and computed over again.
    found = blocks.select("doc_id", "w", F.filter(hits, lambda x: F.size(x["keys"]) > 0).alias("hits"), F.monotonically_increasing_id().alias("row"))
    begin = lambda at: F.greatest(at * BLOCK - reach, F.lit(0))
    regions = found.select("doc_id", "row", F.explode(F.transform("hits", lambda x: F.struct(
        begin(x["at"]).alias("begin"), F.slice("w", begin(x["at"]) + 1, F.lit(span + 2 * reach)).alias("words"), x["keys"].alias("keys")
    ))).alias("r")).select("doc_id", "row", F.col("r.begin").alias("begin"), F.col("r.words").alias("words"), F.explode("r.keys").alias("key"))
    candidates = attach(regions, keys.groupBy("key").agg(F.collect_set("template").alias("templates")), ["key"], "inner")
    each = candidates.select("doc_id", "row", "begin", "words", F.explode("templates").alias("template")).distinct()
    verified = attach(each, table.select("template", "license", "n_words", "shingles"), ["template"], "inner").withColumn("h", shingle_hashes(F.col("words"), width))
    common = F.array_intersect("shingles", "h")
    first = F.col("begin") + F.array_position(F.transform("h", lambda h: F.array_contains("shingles", h)), True) - 1
    scored = verified.select("doc_id", "row", "license", "template", (F.size(common) / F.size("shingles")).alias("containment"), first.alias("first_word"))
    # Of templates that begin at one place the best stays, the first of equal ones.
    order = F.max(F.struct("containment", (-F.col("template")).alias("t"), "license")).alias("best")
    placed = scored.where(F.col("containment") >= containment).groupBy("doc_id", "row", "first_word").agg(order)
    best = placed.select("doc_id", "row", "best.license", (-F.col("best.t")).alias("template"), "best.containment", "first_word").groupBy(
        "doc_id", "row", "license", "template"
    ).agg(F.max("containment").alias("containment"), F.min("first_word").cast("long").alias("first_word"))
    return best.drop("row")
