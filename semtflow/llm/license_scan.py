"""License notices found by MinHash bands over overlapping windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semtflow.llm.common import cut, exploded, row_key, small

#: Words of a shingle, least share of a template's shingles, and bands of one MinHash each.
SPAN, SHARE, BANDS = 5, 0.8, 16
# fixed values: wording of notices in common use
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0-header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "MIT-terms": "under the terms of the MIT License",
    "MIT-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-3-Clause": (
        "may be used to endorse or promote products derived from this software without specific prior written permission"
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0-SPDX": "SPDX-License-Identifier: Apache-2.0",
    "GPL-2.0-SPDX": "SPDX-License-Identifier: GPL-2.0",
    "GPL-3.0-SPDX": "SPDX-License-Identifier: GPL-3.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def _shingles(text: Column) -> Column:
    """Hashes of all runs of SPAN words; case and punctuation do not count."""
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(plain) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def shingled(df: DataFrame, keep: list[str]) -> DataFrame:
    """The named columns with _s, the hash of the run of words at every position."""
    rows = df.select(*keep, _shingles(F.col("text")).alias("_w")).filter(F.size("_w") >= SPAN)
    w = F.col("_w")
    return rows.select(*keep, F.transform(F.sequence(F.lit(0), F.size("_w") - SPAN), lambda i: F.xxhash64(*[w[i + k] for k in range(SPAN)])).alias("_s"))


def band_table(templates: DataFrame) -> DataFrame:
    """license, tpl (its shingles), must (those with a number or the name GNU), m, band, low (its MinHash) and anchor (the shingle that has it)."""
    rows = shingled(templates.withColumn("_words", _shingles(F.col("text"))), ["license", "_words"])
    number = lambda i: F.exists(F.slice("_words", i + 1, SPAN), lambda w: w.rlike(r"\p{N}|^gnu$"))
    rows = rows.select("license", F.array_distinct("_s").alias("tpl"), F.array_distinct(F.filter("_s", lambda x, i: number(i))).alias("must"), F.size("_s").alias("m"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    best = F.array_min(F.transform("tpl", lambda x: F.struct(F.xxhash64(x, F.col("band")).alias("low"), x.alias("anchor"))))
    return rows.select("license", "tpl", "must", "m", "band", best.alias("b")).select("license", "tpl", "must", "m", "band", "b.low", "b.anchor")


def scan_licenses(docs: DataFrame, templates: DataFrame, share: float = SHARE) -> DataFrame:
    """_id, _th, license, containment, start and n_windows of every template found in a document.

    Windows that follow each other by an eighth of a template's length, each long enough to
    hold all of it, meet a template if one of BANDS MinHashes agrees: a window that holds
    ``share`` = 0.8 of the shingles is missed with a probability below 1e-6. A MinHash can only
    agree where the window holds the template's smallest shingle, so only such windows are
    hashed. What meets is checked: the share of the template's shingles in the window, and that
    every shingle with a number, so a version, or with the word GNU, so a name, is there. start is the word at which the first of
    the fullest windows begins. Very long texts are scanned whole.

    Templates (license, text) under five words never match. Null and short texts have no
    window. Rows that agree in id and text share a result; null ids are the smallest long.
    Other columns are not read.
    """
    bands = cut(band_table(templates))
    anchors = [r[0] for r in bands.select("anchor").distinct().collect()]  # at most BANDS per template
    if not anchors:
        return docs.select(*row_key(), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("start"), F.lit(0).cast("long").alias("n_windows")).limit(0)
    reach = bands.agg(F.max("m")).first()[0] * 2
    rows = shingled(docs.select(*row_key(), "text"), ["_id", "_th"])
    s = F.col("_s")
    # a grid window around p lies within reach of it
    at = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: s[i].isin(anchors))
    rows = rows.select("_id", "_th", "_s", at.alias("_at"))
    near = lambda p: F.struct(p.alias("p"), s[p].alias("anchor"), F.greatest(p - reach, F.lit(0)).alias("base"), F.slice(s, F.greatest(p - reach, F.lit(0)) + 1, F.lit(2 * reach)).alias("near"))
    hits = exploded(rows, ["_id", "_th"], F.transform("_at", near), "h").select("_id", "_th", "h.*")
    hits = hits.join(small(bands, F.size("tpl") * 8 + 64), "anchor").withColumn("step", F.greatest(F.floor(F.col("m") / 8), F.lit(1)).cast("int"))
    first = F.greatest(F.ceil((F.col("p") - F.col("m") - F.col("step") + 2) / F.col("step")), F.lit(0)).cast("int")
    hits = hits.withColumn("k", F.explode_outer(F.sequence(first, F.floor(F.col("p") / F.col("step")).cast("int")))).withColumn("start", F.col("k") * F.col("step"))
    hits = hits.withColumn("win", F.slice("near", F.col("start") - F.col("base") + 1, F.col("m") + F.col("step") - 1))
    same = F.array_min(F.transform("win", lambda x: F.xxhash64(x, F.col("band")))) == F.col("low")
    met = hits.filter(same).dropDuplicates(["_id", "_th", "license", "start"])
    met = met.withColumn("containment", F.size(F.array_intersect("win", "tpl")) / F.size("tpl")).filter(F.col("containment") >= share)
    met = met.filter(F.size(F.array_except("must", "win")) == 0)  # another version is another license
    best = F.max(F.struct("containment", (-F.col("start")).alias("s")))
    return met.groupBy("_id", "_th", "license").agg(best.alias("b"), F.count(F.lit(1)).alias("n_windows")).select("_id", "_th", "license", "b.containment", (-F.col("b.s")).alias("start"), "n_windows")


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items()) + " AS t(license, text)")
