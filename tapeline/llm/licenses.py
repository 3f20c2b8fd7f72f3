"""License scans by sparse TF-IDF cosine, in DataFrame operations only, with inheritance along directories.

Passages of a file that hold a telling word of a license template are candidates: the line, its sentences, runs
of neighbouring lines (a wrapped header) and its paragraph, without comment marks; of licence files (LICENSE,
COPYING, NOTICE) the whole text too, which is what the templates of whole licences are for. Their terms are
weighed by frequency and by their rarity among the templates, and the cosine with every template a passage shares
a term with is summed up over an equi-join on terms. A file's license is its best passage's, if alike enough.
Files without one inherit: the licence files with a license of their own cover their directory and all below it,
and the nearest ancestor counts, found by an equi-join of each file's ancestor paths.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeline.llm.common import reliable

# Short notices and standard headers of licenses, as their publishers word them.
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Words that reserve rights in files of any license; they count where nothing else is found.
GENERAL = [("proprietary", "All rights reserved.")]
# Whole licence texts, without the holder's line.
TEXTS = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]
# Words so frequent that sharing them alone says nothing.
FREQUENT = frozenset("a an and are as at be by for from in is it of on or that the this to under was with without you your".split())
# Everyday words that licenses use too; as many of them as can be are not looked for.
EVERYDAY = frozenset("""above action advised all and any appear arising associated author authors business but can caused charge claim code
    common compliance conditions connection contract copies copy damage data deal dealings derived direct distribute distribution do
    documentation domain either even event except express fee file files fitness following form forms found foundation free furnished
    general goods governed granted hereby holder holders however http identifier included including indirect international into january
    june kind later license limitation limited list loss material materials may modify must name names neither no not notice november
    obtain obtaining only option or org other otherwise out particular performance permission permit permitted person persons portions
    possibility prior products profits program promote provided public publish published purpose regard released resulting retain rights
    sell services shall so software source special specific strict style subject substitute such terms theory united universal use used v
    version whether whom work written www""".split())
LICENCE_FILES = ("license", "licence", "copying", "notice")
LEAST = 0.7
#: Longest run of neighbouring lines that is compared; longer headers are met as paragraphs.
SPAN = 4


def _no_texts() -> Column:
    return F.expr("cast(array() as array<string>)")


def templates_table(spark: SparkSession) -> DataFrame:
    """The templates above: license, notice, whole (a licence's whole text), general (counts if nothing else does)."""
    rows = [(*t, False, False) for t in HEADERS] + [(*t, False, True) for t in GENERAL] + [(*t, True, False) for t in TEXTS]
    return spark.createDataFrame(rows, "license string, notice string, whole boolean, general boolean")


def terms(text: Column) -> Column:
    """Lower-case runs of letters, digits and dots inside numbers, without frequent words."""
    every = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|[0-9]+(?:\.[0-9]+)*"), F.lit(0))
    return F.filter(every, lambda t: ~t.isin(*sorted(FREQUENT)))


def _weighed(rows: DataFrame, key: list[str], idf: DataFrame, other: Column) -> DataFrame:
    """key, term, weight with the row's weights scaled to length 1; terms of no template weigh `other`."""
    tf = rows.groupBy(*key, "term").agg(F.count("*").alias("tf")).join(idf, "term", "left")
    tf = tf.withColumn("w", F.col("tf") * F.coalesce("idf", other))
    norm = tf.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return tf.filter(F.col("idf").isNotNull()).join(norm, key).select(*key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def _telling(weights: list, least: float) -> list[str]:
    """Words of which a passage must hold one to be `least` alike to any of these templates. Of each template
    numbers, everyday and light words are left out, as long as what is left out is shorter than `least`:
    a passage that shares nothing else has a smaller cosine."""
    out: set[str] = set()
    for notice in {r["notice"] for r in weights}:
        own = sorted((r["term"].isalpha(), r["term"] not in EVERYDAY, r["t_weight"], r["term"]) for r in weights if r["notice"] == notice)
        spent = 0.0
        for *_, w, term in own:
            spent += w * w
            if spent >= least * least * 0.999:
                out.add(term)
    return sorted(out)


def _bound(weights: list, least: float, numbers: bool = True) -> tuple[Column, Callable[[Column], Column]]:
    """The templates' words, and whether different ones of them can reach `least`: a cosine is at most the length
    of a template's part that is shared with it. Without `numbers`, all numbers of a template count as shared."""
    notices: dict[str, dict[str, float]] = {}
    for r in sorted(weights, key=lambda r: (r["notice"], r["term"])):
        term = r["term"] if numbers or r["term"].isalpha() else ""
        own = notices.setdefault(r["notice"], {})
        own[term] = own.get(term, 0.0) + r["t_weight"] ** 2
    table = F.array(*[F.create_map(F.lit(""), F.lit(n.pop("", 0.0)), *[F.lit(x) for pair in n.items() for x in pair]) for n in notices.values()])
    vocabulary = F.array(*[F.lit(t) for t in sorted({t for n in notices.values() for t in n})])

    def any_notice(shared: Column) -> Column:
        return F.exists(table, lambda n: F.aggregate(shared, F.try_element_at(n, F.lit("")), lambda acc, t: acc + F.coalesce(
            F.try_element_at(n, t), F.lit(0.0))) >= least * least * 0.999)

    return vocabulary, any_notice


def _reaches(words: Column, weights: list, least: float, numbers: bool = True) -> Column:
    vocabulary, any_notice = _bound(weights, least, numbers)
    # bound to a variable, so that it is made once and not for each template
    return F.element_at(F.transform(F.array(F.array_intersect(words, vocabulary)), any_notice), 1)


def _name(path: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/]*)$", 1)), r"\..*$", "")


def _holds(text: Column, weights: list, least: float) -> Column:
    """Whether a text can reach any of these templates, by a plain split into words first."""
    wanted = _telling(weights, least)
    if not wanted:
        return F.lit(False)
    plain = all(t.isalpha() for t in wanted)
    words = F.split(F.lower(text), "[^a-z]+") if plain else terms(text)
    return F.arrays_overlap(words, F.array(*[F.lit(t) for t in wanted])) & _reaches(words, weights, least, not plain)


def _inside(words: Column, idf: dict[str, float]) -> tuple[Column, Column]:
    """Of a passage's words: the square of its length in terms of templates, and how many different others it has."""
    table = F.create_map(*[F.lit(x) for pair in sorted(idf.items()) for x in pair])
    shared = F.array_intersect(words, F.map_keys(table))
    squares = F.aggregate(shared, F.lit(0.0), lambda acc, t: acc + F.pow(
        F.size(F.filter(words, lambda x: x == t)) * F.try_element_at(table, t), F.lit(2.0)))
    return squares, F.size(F.array_distinct(words)) - F.size(shared)


def passages(text: Column, weights: list, least: float, idf: dict[str, float], other: float, span: int = SPAN) -> Column:
    """The different passages of a text that may reach one of these templates: of every line with a telling word the
    line, its sentences, and all runs of up to `span` lines that it is in; and every paragraph. Comment marks at
    the ends of lines are taken away. Runs that other words fill too much are left out: a run's length in terms of
    templates is at most the sum of its lines' lengths, and it has as many other words as any one of its lines."""
    telling = F.array(*[F.lit(t) for t in _telling(weights, least)])
    vocabulary, any_notice = _bound(weights, least)
    shapes = F.array(*[F.struct(F.lit(before).alias("before"), F.lit(size).alias("size")) for size in range(1, span + 1) for before in range(size)])
    lines = F.filter(F.split(text, "\r\n|\r|\n"), lambda x: x.rlike(r"\S"))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"^[\s/*#;%<>!\x22'-]+|[\s/*#<>!\x22'-]+$", ""))

    def around(b: Column, i: Column) -> Column:
        inside = F.filter(shapes, lambda w: (i - w["before"] >= 1) & (i - w["before"] + w["size"] - 1 <= F.size(b["lines"])))
        def dense(w: Column) -> Column:
            facts = F.slice(b["facts"], i - w["before"], w["size"])
            length = F.aggregate(facts, F.lit(0.0), lambda acc, f: acc + f["length"])
            others = F.array_max(F.transform(facts, lambda f: f["others"]))
            return length * length * (1.0 - least * least * 0.999) >= least * least * 0.999 * other * other * others

        able = F.filter(F.filter(inside, dense), lambda w: any_notice(F.array_distinct(F.flatten(
            F.transform(F.slice(b["facts"], i - w["before"], w["size"]), lambda f: f["shared"])))))
        runs = F.transform(able, lambda w: F.array_join(F.slice(b["lines"], i - w["before"], w["size"]), " "))
        sentences = F.split(F.element_at(b["lines"], i), r"(?<=[.;:!?])\s+")
        return F.concat(runs, F.when(any_notice(F.element_at(b["facts"], i)["shared"]), sentences).otherwise(_no_texts()))

    def near_hits(b: Column) -> Column:
        hits = F.transform(b["facts"], lambda f, i: F.when(F.arrays_overlap(f["shared"], telling), i + 1))
        return F.flatten(F.transform(F.filter(hits, lambda i: i.isNotNull()), lambda i: around(b, i)))

    # lines and their words are bound to variables, else they would be made again for each use
    def facts_of(words: Column) -> Column:
        squares, others = _inside(words, idf)
        return F.struct(F.array_intersect(words, vocabulary).alias("shared"), F.sqrt(squares).alias("length"), others.alias("others"))

    bound = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), F.transform(
        x, lambda line: F.element_at(F.transform(F.array(terms(line)), facts_of), 1)).alias("facts")))
    paragraphs = F.filter(F.split(text, r"(?:\r?\n[\s/*#;%-]*){2,}|\n[/*#;%-]+(?=\n)"), lambda x: _reaches(terms(x), weights, least))
    return F.array_distinct(F.concat(F.element_at(F.transform(bound, near_hits), 1), paragraphs))


def headers(files: DataFrame, templates: DataFrame, least: float = LEAST, span: int = SPAN) -> DataFrame:
    """(path, license, score): the license of the passage that is most alike to a template, of files that have
    one of at least `least`; general templates count only where no other is met; ties by license name. Null texts
    and files without such a passage give no row; files of the same path are one file. Templates are a short
    list: their terms are read by the driver."""
    templates = templates.select("license", "notice", "whole", "general")
    n = templates.count()
    words = templates.select("license", "notice", "whole", "general", F.explode(terms(F.col("notice"))).alias("term"))
    df = words.select("notice", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    other = F.log(F.lit(n + 1.0)) + 1.0
    known = _weighed(words, ["license", "notice", "whole", "general"], idf, other).withColumnRenamed("weight", "t_weight")
    weights = known.select("notice", "whole", "term", "t_weight").collect()
    brief = [w for w in weights if not w["whole"]]
    if not _telling(weights, least):
        return files.limit(0).select(F.col("path"), F.lit("").alias("license"), F.lit(0.0).alias("score"))
    licence = _name(F.col("path")).isin(*LICENCE_FILES)
    # texts that hold no telling word cannot reach the threshold
    maybe = files.filter("path is not null").select("path", "text", licence.alias("licence")).filter(
        _holds(F.col("text"), brief, least) | (F.col("licence") & _holds(F.col("text"), weights, least)))
    rare = {r["term"]: float(r["idf"]) for r in idf.collect()}
    rarest = math.log(n + 1.0) + 1.0
    cut = F.concat(passages(F.col("text"), brief, least, rare, rarest, span) if _telling(brief, least) else _no_texts(),
                   F.when(F.col("licence"), F.array("text")).otherwise(_no_texts()))
    # terms are made before the explosion, after which a filter cannot bring them about again
    found = (maybe.select("path", F.explode(F.transform(F.array_distinct(cut), lambda x: F.struct(x.alias("passage"), terms(x).alias("terms")))).alias("p"))
             .select("path", "p.passage", "p.terms").filter(_reaches(F.col("terms"), weights, least)))
    # no passage is more alike than the share of its length that lies in terms of templates: the squares of
    # these, against at least one of `other` for each different term that no template has
    inside, outside = _inside(F.col("terms"), rare)
    outside = outside * rarest * rarest
    found = found.withColumn("inside", inside).filter(F.col("inside") >= least * least * 0.999 * (F.col("inside") + outside))
    # few passages are left: written once, so that texts are read once
    rows = reliable(found.select("path", F.md5("passage").alias("passage"), F.explode("terms").alias("term")))
    cosine = (_weighed(rows, ["path", "passage"], idf, other).join(known, "term").groupBy("path", "passage", "license", "notice", "general")
              .agg(F.sum(F.col("weight") * F.col("t_weight")).alias("score")))
    cosine = cosine.withColumn("score", F.round("score", 9)).filter(F.col("score") >= least)
    best = F.min(F.struct("general", (-F.col("score")).alias("minus"), F.col("license").alias("license")))
    return cosine.groupBy("path").agg(best.alias("b")).select("path", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score"))


def ancestors(path: Column) -> Column:
    """Directories above a path, from the root '' down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def scan(files: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """Per path: license, score, origin (the file whose text said so: the path itself, or the licence file
    that it inherits from; nulls if none). Of several licence files in one directory the first by path
    covers it. Rows with a null path give nothing; repeated paths are one file."""
    own = reliable(headers(files, templates, least))
    covering = own.filter(_name(F.col("path")).isin(*LICENCE_FILES)).withColumn(
        "dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    first = F.min(F.struct("path", "license", "score"))
    covering = covering.groupBy("dir").agg(first.alias("c"))
    paths = files.filter("path is not null").select("path").distinct()
    above = paths.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "dir"))
    nearest = above.join(covering, "dir").groupBy("path").agg(F.max(F.struct("depth", "c")).alias("n"))
    joined = paths.join(own, "path", "left").join(nearest, "path", "left")
    has = F.col("license").isNotNull()
    return joined.select(
        "path", F.when(has, F.col("license")).otherwise(F.col("n.c.license")).alias("license"),
        F.when(has, F.col("score")).otherwise(F.col("n.c.score")).alias("score"),
        F.when(has, F.col("path")).otherwise(F.col("n.c.path")).alias("origin"))
