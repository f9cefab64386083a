"""License scans with DataFrame functions only.

Texts and license templates are cut into words and shingles of ``SHINGLE`` words. Templates fall in size
classes of 1, 2, 4, ... ``LARGEST`` shingles; of each class that occurs, documents are cut into
windows of that many shingles (every offset up to 4 shingles, then a quarter of the window
apart; a shorter document is one window), templates into all of theirs. A window's MinHash signature has ``BANDS`` bands of one
row each: windows that share half their shingles meet in a band with probability
1 - 0.5 ** BANDS (0.998 for 9) and equal windows always. A template retrieved by a band is
verified exactly: the share of its shingles contained in the document must reach ``CONTAINED``.

Two screens lose nothing. A document that holds ``CONTAINED`` of a template holds one of its anchors: long
words that lie in so many of its shingles that the rest are too few; texts without any anchor are not cut into
shingles. And a band of one row meets only if the window's smallest shingle hash is a template's shingle, so
documents without any template shingle are screened out before signatures are made.

The template side is a catalogue given as a parameter (at most ``MOST_TEMPLATES`` entries,
checked), so it is broadcast.

Defined cases: null and empty texts have no license; texts or templates shorter than a shingle
have none and match none; repeated rows each get their result; more than ``MOST_TEMPLATES`` templates
raise a ValueError. ``scan`` keeps the id alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from survperf.llm.common import ascii_lower, let

SHINGLE, BANDS, CONTAINED, LARGEST = 5, 9, 0.8, 64
MOST_TEMPLATES = 1000
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"

#: Notices by which texts state their license, with SPDX names.
TEMPLATES = {
    "MIT": "Released under the MIT License",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Apache-2.0-text": "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
}


def _hashes(words: Column) -> Column:
    """Hashes of all shingles of a column of words."""
    return let(words, lambda w: F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))).otherwise(F.array().cast("array<bigint>")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _bands(hashes: Column, size: int, step: int) -> Column:
    """Array of (band, smallest permuted hash) of all windows of ``size`` shingles."""
    at = F.sequence(F.lit(1), F.greatest(F.size(hashes) - size + 1, F.lit(1)), F.lit(step))
    count = 1 if size == 1 else BANDS
    bands = [_band(hashes, at, size, b) for b in range(count)]
    return F.when(F.size(hashes) > 0, F.concat(*bands)).otherwise(F.array().cast("array<struct<band:int,low:bigint>>"))


def _band(hashes: Column, at: Column, size: int, band: int) -> Column:
    """Distinct smallest hashes, under permutation ``band``, of the windows that start at ``at``."""
    turned = F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band)))
    low = let(turned, lambda t: F.transform(at, lambda i: F.array_min(F.slice(t, i, size))))
    return F.transform(F.array_distinct(low), lambda v: F.struct(F.lit(band).alias("band"), v.alias("low")))


def _keys(hashes: Column, cls: int) -> Column:
    """Array of (c, band, low) of a text's windows of one size class."""
    step = 1 if cls <= 4 else cls // 4
    return F.transform(_bands(hashes, cls, step), lambda x: F.struct(F.lit(cls).alias("c"), x["band"].alias("band"), x["low"].alias("low")))


def catalogue(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(template, w, shingles, n, cls): templates of a shingle or more."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MOST_TEMPLATES} can be broadcast")
    rows = spark.createDataFrame(sorted(templates.items()), "template string, body string").select("template", words_of(F.col("body")).alias("w"))
    hashed = rows.select("template", "w", F.array_distinct(_hashes(F.col("w"))).alias("shingles"), F.greatest(F.size("w") - (SHINGLE - 1), F.lit(0)).alias("n")).filter("n > 0")
    cls = F.least(F.lit(LARGEST), F.pow(F.lit(2), F.floor(F.log2("n"))).cast("int"))
    return hashed.withColumn("cls", cls)


def anchors(templates: list[list[str]]) -> list[str]:
    """Words of which a text that holds ``CONTAINED`` of the shingles of any template has one.

    Of each template the longest words are taken until fewer than ``CONTAINED`` of its shingles are without one.
    """
    chosen: set[str] = set()
    for words in templates:
        grams = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        left = [g for g in grams if not chosen & set(g)]
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if len(left) < CONTAINED * len(grams):
                break
            if any(word in g for g in left):
                chosen.add(word)
                left = [g for g in left if word not in g]
    return sorted(chosen)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licenses): for every row, the sorted (template, share of its shingles that the text holds) that are verified."""
    templates = TEMPLATES if templates is None else templates
    cat = catalogue(docs.sparkSession, templates)
    small = cat.collect()  # the catalogue itself, at most MOST_TEMPLATES rows
    some = anchors([r["w"] for r in small])
    may = let(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), lambda t: reduce(Column.__or__, [t.contains(word) for word in some], F.lit(False)))
    hashes = F.when(may, _hashes(words_of(F.col(text_col)))).otherwise(F.array().cast("array<bigint>"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), hashes.alias("h"))
    if not small:
        return rows.select("id", F.array().cast("array<struct<template:string,share:double>>").alias("licenses"))
    known = F.array(*[F.lit(h) for h in sorted({h for r in small for h in r["shingles"]})])
    sides, keys = [], []
    for c in sorted({r["cls"] for r in small}):
        own = cat.filter(F.col("cls") == c).select("template", "shingles", F.explode(_bands(F.col("shingles"), c, 1)).alias("x"))
        sides.append(own.select(F.lit(c).alias("c"), "x.band", "x.low", "template", "shingles").distinct())
        keys.append(_keys(F.col("h"), c))
    side = sides[0]
    for more in sides[1:]:
        side = side.unionAll(more)
    # the first element, a null, stands for the row itself
    own_row = F.array(F.lit(None).cast("struct<c:int,band:int,low:bigint>"))
    # outer, or a filter on the size of the array would compute all of it once more
    probes = rows.select("id", "text_hash", "h", F.explode_outer(F.when(F.arrays_overlap("h", known), F.concat(own_row, *keys)).otherwise(own_row)).alias("k"))
    got = probes.join(F.broadcast(side), (F.col("k.c") == side.c) & (F.col("k.band") == side.band) & (F.col("k.low") == side.low), "left")
    share = F.size(F.array_intersect("shingles", "h")) / F.size("shingles")
    verified = F.when(F.col("template").isNotNull() & (share >= CONTAINED), F.struct("template", share.alias("share")))
    per_row = got.select("id", "text_hash", F.col("k").isNull().cast("long").alias("own"), verified.alias("v")).filter("own = 1 or v is not null")
    found = per_row.groupBy("id", "text_hash").agg(F.sum("own").alias("copies"), F.array_sort(F.collect_set("v")).alias("licenses"))
    return found.select("id", "licenses", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
