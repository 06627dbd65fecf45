"""License scans by MinHash bands over overlapping windows, verified by exact shingle containment.

A text is its sequence of 3-word shingles (lower-cased; ASCII white space and punctuation part words),
seen through windows of 4 shingles that start every 2 words. Each window, and the windows at every word
of each template, have ``BANDS`` bands of one MinHash value, each with a hash function of its own. A text
that holds 5 shingles of a template in a row has a window equal to one of the template, which shares all
bands. A template of 3 shingles fills three quarters of one of the text's windows, which shares a band
with probability ``1 - (1/4)^BANDS`` = 0.9998. Only pairs of text and template that share a band are
verified: the distinct shingles of the template that occur anywhere in the text are counted exactly, and
their share must reach ``containment``.

Windows are cut and hashed in generated code, row by row, where a text is read; what leaves a task are
pairs of text and template. Those are written, and only texts among them are read again for verification.
Templates are a fixed table of notices (a few thousand windows), held in a broadcast.

Null, empty and short texts (under 3 words) match nothing. Texts are read whole, whatever their length.
Rows that repeat a doc_id count as one text, and so do rows without an id. Extra columns are not read.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.plans.storage import Scratch

#: Notices by which texts name their license, as the licenses and their stewards word them.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-file": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
WORDS, STEP, WINDOW, BANDS = 3, 2, 4, 6
#: Up to four words with what follows them: two windows start in each.
BLOCK = r"(?:[^\s\p{Punct}]++[\s\p{Punct}]*+){1,4}"


def _shingled(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per block of four words: ``keep`` and h0 to h5, the shingles that start there and in the next two words
    (null past the text's end)."""
    rows = rows.select(*keep, F.regexp_extract_all(F.lower("text"), F.lit(BLOCK), 0).alias("b0"))
    rows = rows.select(*keep, "b0", F.slice("b0", F.lit(2), F.greatest(F.size("b0"), F.lit(0))).alias("b1"))
    rows = rows.select(*keep, F.explode(F.arrays_zip("b0", "b1")).alias("b"))
    rows = rows.select(*keep, F.split(F.concat_ws(" ", "b.b0", "b.b1"), r"[\s\p{Punct}]+").alias("w"))

    def hashed(i: int) -> Column:
        words = [F.get("w", F.lit(i + j)) for j in range(WORDS)]
        return F.when(words[-1] != "", F.xxhash64(*words))

    # each step feeds a generator of one row, past which nothing is computed twice
    return rows.select(*keep, F.inline(F.array(F.struct(*(hashed(i).alias(f"h{i}") for i in range(STEP + WINDOW)))))).where("h0 is not null")


def _bands(rows: DataFrame, keep: list[str], starts: tuple[int, ...], bands: int) -> DataFrame:
    """(keep, value): the least hash of each band of the windows that start at the block's words ``starts``."""
    values = []
    for start in starts:
        for band in range(bands):
            # a window cut short by the text's end repeats its first shingle, which changes no minimum
            hashes = [F.xxhash64(F.coalesce(f"h{i}", f"h{start}"), F.lit(band)) for i in range(start, start + WINDOW)]
            values.append(F.when(F.col(f"h{start}").isNotNull(), F.least(*hashes)))
    return rows.select(*keep, F.explode(F.array(*values)).alias("value")).where("value is not null")


def _template_windows(known: list[tuple[str, str]], spark: SparkSession) -> DataFrame:
    """Rows (license_id, text): each template from its first and from its second word on, so that windows start at every word."""
    rows = spark.createDataFrame(known, "license_id string, text string")
    words = F.filter(F.split(F.lower("text"), r"[\s\p{Punct}]+"), lambda w: w != "")
    shifted = F.explode(F.transform(F.sequence(F.lit(1), F.lit(STEP)), lambda k: F.array_join(F.slice(words, k, F.size(words)), " ")))
    return rows.select("license_id", shifted.alias("text"))


def candidates(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = BANDS) -> DataFrame:
    """(doc_id, license_id) of the templates that a text (doc_id, text) shares a band with."""
    known = sorted((templates or TEMPLATES).items())
    table = _bands(_shingled(_template_windows(known, docs.sparkSession), ["license_id"]), ["license_id"], (0, STEP), bands).distinct()
    found = _bands(_shingled(docs, ["doc_id"]), ["doc_id"], (0, STEP), bands).join(F.broadcast(table), "value")
    return found.select("doc_id", "license_id").distinct()


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license_id, n_shingles, n_found): templates that a text holds."""
    spark: SparkSession = docs.sparkSession
    known = sorted((templates or TEMPLATES).items())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pairs = Scratch(spark).keep(candidates(texts, templates, bands), "candidates")

    def own(rows: DataFrame, keep: list[str]) -> DataFrame:
        return rows.select(*keep, F.explode(F.array(*(f"h{i}" for i in range(4)))).alias("shingle")).where("shingle is not null")

    table = own(_shingled(spark.createDataFrame(known, "license_id string, text string"), ["license_id"]), ["license_id"]).distinct()
    sizes = table.groupBy("license_id").agg(F.count("*").alias("n_shingles"))
    asked = pairs.select(F.col("doc_id").alias("_id")).distinct()
    again = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    held = own(_shingled(again, ["doc_id"]), ["doc_id"]).join(F.broadcast(table), "shingle").distinct()
    held = held.groupBy("doc_id", "license_id").agg(F.count("*").alias("n_found"))
    named = pairs.select(F.col("doc_id").alias("_id"), F.col("license_id").alias("_name"))
    held = held.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("license_id") == F.col("_name")), "left_semi")
    found = held.join(F.broadcast(sizes), "license_id").where(F.col("n_found") >= F.col("n_shingles") * containment)
    return found.select("doc_id", "license_id", "n_shingles", "n_found")
