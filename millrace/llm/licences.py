"""Licence scan: Dice coefficient over word bigrams against templates, with size bounds on the candidates.

Only DataFrame functions. A segment can reach a coefficient of t with a template of b bigrams only if its own count lies
between b * t / (2 - t) and b * (2 - t) / t, and only if it shares that lower part of the template's bigrams; so every match
holds one of a few witness words, chosen such that fewer bigrams than that are without any.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices as they are usually printed.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "bsd-notice": "Released under the BSD License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
COMMON = frozenset("a an and any are as be by for from have if in is it may must not of on or other provided subject such that the their this to under with without you your".split())
NOISE = r"[^\p{L}\p{N}]+"
#: Where a sentence ends: its last character, then white space, that of line and paragraph ends included. A number in front of
#: an item of a list ends none.
ENDS, CUT = r"((?:[^0-9\x20\t\n\r]|[0-9]\.[0-9]+)[.!?;])[\x20\t\n\r]+", "\x01"


def template_grams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def most_sentences(templates: dict[str, str]) -> int:
    """Sentences to a run: as many as the longest template has, and one more."""
    return 1 + max((len(re.sub(ENDS, r"\1" + CUT, t).split(CUT)) for t in templates.values()), default=0)


def witnesses(grams: dict[str, list[str]], least: float) -> list[str]:
    """Words of which every segment that reaches `least` with some template holds one.

    A match shares at least b * t / (2 - t) of a template's b bigrams; words are added until the bigrams without any of them
    are fewer than that, for every template.
    """
    chosen: list[str] = []
    for name in sorted(grams):
        need = least / (2 - least) * len(grams[name])
        left = [g for g in grams[name] if not set(g.split()) & set(chosen)]
        while len(left) >= need:
            words = sorted({w for g in left for w in g.split()}, key=lambda w: (-sum(w in g.split() for g in left) * (0.01 if w in COMMON else len(w)), w))
            chosen.append(words[0])
            left = [g for g in left if words[0] not in g.split()]
    return chosen


def bigrams(text: Column) -> Column:
    """Distinct bigrams of a lower-case text."""
    words = F.split(F.trim(F.regexp_replace(text, NOISE, " ")), " ")
    n = F.size(words) - 1
    pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))  # no lambda over words: it would be made anew for each
    return F.when(n > 0, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """(id, segment, number, sentences, licence, dice): every segment that reaches `least` with a template, and that template.

    Segments are the lines of a text (`line`, numbered from 1), its paragraphs of several lines (`paragraph`), where it
    has several paragraphs the whole text (`text`, 1), and, for notices inside a line or across paragraphs, runs of its
    sentences (`run`: the first one's number, and how many, up to one more than the longest template has; else sentences is
    0). Text is normalised to lower-case words; bigrams count once. A segment may match several templates, and a notice
    several segments; all are returned, ties included. Null and empty texts, and segments of one word, match nothing; rows are scanned one
    by one, so repeats give repeats; empty tables give none. Other columns are not read.
    """
    grams = {name: template_grams(text) for name, text in sorted((templates or TEMPLATES).items())}
    grams = {name: g for name, g in grams.items() if g}
    known = F.from_json(F.lit(json.dumps([{"name": n, "grams": g} for n, g in grams.items()])), "array<struct<name string, grams array<string>>>")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    words = witnesses(grams, least)

    def witness(lowered: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(lowered, F.lit(w))
        return out

    # The explode is a barrier: a condition moved below it would lower the text anew for every witness.
    rows = rows.select("_id", F.explode(F.array(F.lower("_text"))).alias("_text")).where(witness(F.col("_text")))
    lines = F.transform(F.split("_text", "\n"), lambda x, k: F.struct(F.lit("line").alias("segment"), (k + 1).alias("number"), x.alias("part")))
    blocks = F.split("_text", r"\n[\x20\t\r]*\n")
    paragraphs = F.filter(F.transform(blocks, lambda x, k: F.struct(F.lit("paragraph").alias("segment"), (k + 1).alias("number"), x.alias("part"))), lambda s: F.contains(s["part"], F.lit("\n")))
    whole = F.when(F.size(blocks) > 1, F.array(F.struct(F.lit("text").alias("segment"), F.lit(1).alias("number"), F.col("_text").alias("part")))).otherwise(F.array().cast("array<struct<segment string, number int, part string>>"))
    parts = rows.select("_id", F.explode(F.concat(lines, paragraphs, whole)).alias("s")).select("_id", "s.segment", "s.number", F.lit(0).alias("sentences"), F.col("s.part").alias("part"))
    parts = parts.where(witness(F.col("part")))

    most = most_sentences(templates or TEMPLATES)
    split = rows.select("_id", F.split(F.regexp_replace("_text", ENDS, f"$1{CUT}"), CUT).alias("all"))
    marked = F.filter(F.transform("all", lambda x, k: F.when(witness(x), k + 1)), lambda k: k.isNotNull())
    # The array is exploded for what it holds, so the marks are made once.
    split = split.select("_id", F.explode(F.array(F.struct("all", marked.alias("marked")))).alias("s")).select("_id", "s.*").where(F.size("marked") > 0)
    # Of a run's marked sentences the first one makes it: a run begins after the mark before.
    first = lambda k, at: F.greatest(F.lit(1), k - (most - 1), F.coalesce(F.get("marked", at - 1) + 1, F.lit(1)))
    near = F.transform("marked", lambda k, at: F.struct(k.alias("at"), first(k, at).alias("low"), F.slice("all", first(k, at), k - first(k, at) + most).alias("near")))
    runs = split.select("_id", F.size("all").alias("n"), F.explode(near).alias("s")).select("_id", "n", "s.*")
    runs = runs.withColumn("number", F.explode(F.sequence("low", "at")))
    runs = runs.withColumn("sentences", F.explode(F.sequence(F.col("at") - F.col("number") + 1, F.least(F.lit(most), F.col("n") - F.col("number") + 1))))
    run = F.array_join(F.slice("near", F.col("number") - F.col("low") + 1, F.col("sentences")), " ")
    parts = parts.unionByName(runs.select("_id", F.lit("run").alias("segment"), "number", "sentences", run.alias("part")))
    n, ratio = F.size("grams"), least / (2 - least)
    fits = F.filter(known, lambda t: (n >= F.size(t["grams"]) * ratio - 1e-9) & (n <= F.size(t["grams"]) / ratio + 1e-9))
    # The bigrams are made once, below an explode: above it they would be made anew for every template.
    measured = parts.select("_id", F.explode(F.array(F.struct("segment", "number", "sentences", bigrams(F.col("part")).alias("grams")))).alias("s")).select("_id", "s.*")
    pairs = measured.select("_id", "segment", "number", "sentences", "grams", F.explode(fits).alias("t"))
    dice = 2.0 * F.size(F.array_intersect("grams", "t.grams")) / (n + F.size("t.grams"))
    found = pairs.select("_id", "segment", "number", "sentences", F.col("t.name").alias("licence"), dice.alias("dice")).where(F.col("dice") >= least)
    return found.select(F.col("_id").alias(id_col), "segment", F.col("number").cast("int").alias("number"), F.col("sentences").cast("int").alias("sentences"), "licence", F.round("dice", 6).alias("dice"))


def op7_licences(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(least: float = 0.8) -> str:
    values = ", ".join(f"('{name}', [{', '.join(repr(g) for g in template_grams(text))}])" for name, text in sorted(TEMPLATES.items()))
    ratio = least / (2 - least)
    return rf"""
        WITH templates(licence, t) AS (VALUES {values}),
        blocks AS (SELECT doc_id, text, string_split_regex(text, '\n[\x20\t\r]*\n') AS bs FROM documents WHERE text IS NOT NULL),
        parts AS (
            SELECT doc_id, 'line' AS segment, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS number, unnest(string_split(text, chr(10))) AS part FROM blocks
            UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(1, len(bs) + 1)), unnest(bs) AS part FROM blocks) WHERE contains(part, chr(10))
            UNION ALL SELECT doc_id, 'text', 1, text FROM blocks WHERE len(bs) > 1),
        sents AS (SELECT doc_id, string_split(regexp_replace(text, '{ENDS}', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents WHERE text IS NOT NULL),
        firsts AS (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM sents),
        segments AS (
            SELECT doc_id, segment, number, 0 AS sentences, part FROM parts
            UNION ALL SELECT doc_id, 'run', i, k, array_to_string(ss[i : i + k - 1], ' ') FROM firsts, range(1, {most_sentences(TEMPLATES) + 1}) t(k) WHERE i + k - 1 <= len(ss)),
        words AS (SELECT doc_id, segment, number, sentences, string_split(trim(regexp_replace(lower(part), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS ws FROM segments),
        grams AS (SELECT doc_id, segment, number, sentences, list_distinct(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) AS g FROM words WHERE len(ws) > 1),
        scored AS (
            SELECT doc_id, segment, number, sentences, licence, 2.0 * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice
            FROM grams JOIN templates ON len(g) >= len(t) * {ratio} - 1e-9 AND len(g) <= len(t) / {ratio} + 1e-9)
        SELECT doc_id, segment, number::INTEGER AS number, sentences::INTEGER AS sentences, licence, round(dice, 6) AS dice FROM scored WHERE dice >= {least}
    """


SQL = _sql()
