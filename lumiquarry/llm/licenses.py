"""License scans in DataFrame operations alone.

Overlapping windows of a text's five-word shingles, as long as the templates are (in powers of two), are sketched by
MinHash; each hash is a band, and a window that shares a band with a template retrieves it. To share a band, a window
must hold the very shingle that is the template's minimum there, so only windows around those shingles are sketched: that
retrieves what sketches of all windows would. What is retrieved counts if the text holds enough of the template's
shingles, counted exactly.

A window of the grid holds three quarters of a contained template at least, so their similarity is 0.4 or more even where
a fifth of the template is changed; with 32 bands of one row it is missed with a probability below 1e-7.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiquarry.session import table

WORDS, BANDS, PERCENT = 5, 32, 80
#: Shingles of the templates that one pass over the texts looks for: they are a constant of its plan. More templates take more passes.
MOST = 20_000

# Notices and opening paragraphs of common licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("BSD-clauses", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("CC-BY-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT-line", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def with_shingles(df: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """(keep, row, sh): the hashes of all runs of WORDS words, lower case, of ASCII letters and digits, in order.

    ``row`` numbers the rows and, being no function of them, keeps filters on sh from being computed a second time below.
    """
    words = df.select(*keep, F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda w: F.xxhash64(w)).alias("w"))
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - WORDS), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WORDS))))
    names = [c for c in words.columns if c != "w"]
    return words.select(*names, F.monotonically_increasing_id().alias("row"), F.when(F.size("w") >= WORDS, runs).otherwise(F.array().cast("array<bigint>")).alias("sh"))


def bands(size: int, shingles: Column) -> Column:
    """The keys of a window of class ``size``: of each band, its number and the least of its hashes."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.xxhash64(F.lit(size), b, F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b)))))


def license_matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row for each text and template of which the text holds ``percent`` of the shingles or more: ``id_col``, license_id, n_shared, n_shingles.

    n_shingles counts the template's distinct runs of five words, n_shared those that the whole text holds. Null, empty
    and shorter texts match nothing; repeated rows are answered each; an empty table gives no rows; further columns are
    not read. Templates need different names and five words at least; there may be any number of any length, in blocks
    of MOST shingles that each read the texts once.
    """
    spark: SparkSession = docs.sparkSession
    if len({n for n, _ in templates}) < len(templates):
        raise ValueError("two templates share a name")
    least = lambda b: F.array_min(F.transform("sh", lambda x: F.struct(F.xxhash64(x, b), x.alias("sh"))))["sh"]
    own = with_shingles(spark.createDataFrame(list(templates), "name string, text string"), F.col("text"), F.col("name")).select("name", F.array_distinct("sh").alias("sh"))
    own = own.select("name", "sh", F.transform(F.sequence(F.lit(1), F.lit(BANDS)), least).alias("minima"))
    got = [(r["name"], r["sh"], r["minima"]) for r in own.collect()]
    if any(not sh for _, sh, _ in got):
        raise ValueError(f"a template has fewer than {WORDS} words")
    text = with_shingles(docs, F.col(text_col), F.col(id_col).alias("id"))
    out, block, size = None, [], 0
    for k, template in enumerate(got):
        block, size = [*block, template], size + len(template[1])
        if k == len(got) - 1 or size + len(got[k + 1][1]) > MOST:
            found = _matches(text, own, block, percent)
            out, block, size = found if out is None else out.union(found), [], 0
    return out.select(F.col("id").alias(id_col), "license_id", "n_shared", "n_shingles")


def _matches(text: DataFrame, own: DataFrame, block: list[tuple[str, list[int], list[int]]], percent: int) -> DataFrame:
    """The matches of the block's templates (name, shingles, shingles that are minima of the bands)."""
    every, minima = (F.array(*[F.lit(x).cast("bigint") for x in sorted({x for t in block for x in t[k]})]) for k in (1, 2))
    sizes = {name: 1 << (len(sh) - 1).bit_length() for name, sh, _ in block}
    keys = None
    for size in sorted(set(sizes.values())):
        of = own.where(F.col("name").isin([n for n, s in sizes.items() if s == size])).select("name", F.col("sh").alias("template"), F.explode(bands(size, F.col("sh"))).alias("key"))
        keys = of if keys is None else keys.union(of)

    text = text.where(F.arrays_overlap("sh", minima))
    # ``kept`` is as ``row`` is: with it, what is computed here is not computed again for every shingle below.
    text = text.select("id", "row", "sh", F.array_intersect("sh", every).alias("shared"), F.array_intersect("sh", minima).alias("minima"), F.monotonically_increasing_id().alias("kept"))
    hits = F.filter(F.sequence(F.lit(0), F.size("sh") - 1), lambda i: F.array_contains("minima", F.get("sh", i)))
    text = text.select("id", "row", "kept", "sh", "shared", hits.alias("hits"))

    def windows(size: int) -> Column:
        """The keys of the grid's windows of ``size`` shingles that hold a hit."""
        step = max(1, size // 4)
        around = lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - size + 1) / step).cast("int")) * step, p - p % step, F.lit(step))
        starts = F.array_distinct(F.flatten(F.transform("hits", around)))
        return F.flatten(F.transform(starts, lambda at: bands(size, F.slice("sh", at + 1, F.lit(size)))))

    sketched = text.select("id", "row", "kept", "shared", F.explode(F.array_distinct(F.concat(*[windows(s) for s in sorted(set(sizes.values()))]))).alias("key"))
    found = sketched.join(F.broadcast(keys), "key").groupBy("row", "kept", "name").agg(F.first("id").alias("id"), F.first("shared").alias("shared"), F.first("template").alias("template"))
    shared = F.size(F.array_intersect("shared", "template"))
    return found.where(shared * 100 >= F.size("template") * percent).select(
        "id", F.col("name").alias("license_id"), shared.cast("long").alias("n_shared"), F.size("template").cast("long").alias("n_shingles")
    )


def op8_license_scans(spark, sf_dir: str) -> DataFrame:
    """doc_id, license_id, n_shared, n_shingles of every document and notice of which it holds four fifths. Null texts match nothing."""
    return license_matches(table(spark, sf_dir, "documents"))
