"""Licence scans, in built-in functions only.

Every sentence of a file that could match is compared with licence templates by the cosine of
sparse TF-IDF vectors, in the file's own row: nothing is exploded or moved. Sentences are cut from
the lines as they stand and from paragraphs, whose lines are joined first, so that wrapped headers
and licence files match as well; comment markers hold no term. Document frequencies of the
templates' terms are counted over all files; a term of no template weighs as much as an unseen
one. Sentences are only scored if they hold a term without which the threshold cannot be reached.
Licence files then set the licence of their directory, and files without one of their own inherit
from the nearest ancestor directory by joins on paths.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

THRESHOLD = 0.75
#: Directories up to this number are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_DIRS = 50_000
#: File names of licence files.
LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying|copyright|notice)s?([-._].*)?$"
#: (SPDX id, sentence) of well-known licence headers, statements, titles and clauses, as published. Fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)


def terms(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def inverse_frequencies(files: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[dict[str, float], float]:
    """The inverse document frequency of each vocabulary term over all files, and of an unseen term.

    One row per term reaches the driver.
    """
    tokens = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+")
    n = files.count()
    held = files.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, vocabulary)))).alias("t")).groupBy("t").count()
    seen = {r["t"]: r["count"] for r in held.collect()}
    return {t: math.log((1 + n) / (1 + seen.get(t, 0))) + 1 for t in vocabulary}, math.log(1 + n) + 1


def template_vectors(idf: dict[str, float], templates=TEMPLATES) -> list[tuple[str, dict[str, float]]]:
    """(SPDX id, unit vector) of each template."""
    out = []
    for spdx, text in templates:
        ts = terms(text)
        v = {t: ts.count(t) * idf[t] for t in dict.fromkeys(ts)}
        norm = math.sqrt(sum(w * w for w in v.values()))
        out.append((spdx, {t: w / norm for t, w in v.items()}))
    return out


def needed_terms(vectors: list[tuple[str, dict[str, float]]], threshold: float) -> list[str]:
    """Terms of which a sentence must hold one to reach the threshold with any template.

    Per template, the heaviest terms until those left have a norm below the threshold: by the
    Cauchy-Schwarz inequality a sentence of the others alone stays below it.
    """
    out: dict[str, None] = {}
    for _, v in vectors:
        left = 1.0
        for t, w in sorted(v.items(), key=lambda x: (-x[1], x[0])):
            if left < (threshold - 1e-9) ** 2:
                break
            out[t] = None
            left -= w * w
    return list(out)


def _cut(text: Column) -> Column:
    """Lines, cut after full stops, question and exclamation marks that white space follows."""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r]+", "$1\n"), "\n")


def wrapped(text: Column) -> Column:
    """Sentences of the paragraphs of more than one line, their lines joined by spaces. A line without a letter or digit ends a paragraph."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike("[a-z0-9]"), x).otherwise(""))
    some = F.filter(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda p: p.contains("\n"))
    return F.flatten(F.transform(some, lambda p: _cut(F.translate(p, "\n", " "))))


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, "[^a-z0-9]+"), "")


def _constant(value: list, kind: str) -> Column:
    """A literal of many numbers or words, folded by the optimizer."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def best_match(text: Column, vectors: list[tuple[str, dict[str, float]]], idf: dict[str, float], unseen: float, threshold: float) -> Column:
    """struct(score, spdx, words, n) of the best sentence of a lower-cased text.

    words counts those of all matching sentences, of lines or of paragraphs, whichever are more; n
    counts all words. The work grows with the length of a sentence: a term is counted by one
    replacement, the other terms by the runs of the sorted words.
    """
    vocabulary = list(idf)
    needed = F.array(*map(F.lit, needed_terms(vectors, threshold)))
    terms_, weights = _constant(vocabulary, "array<string>"), _constant([idf[t] for t in vocabulary], "array<double>")
    rows, names = _constant([[v.get(t, 0.0) for t in vocabulary] for _, v in vectors], "array<array<double>>"), _constant([s for s, _ in vectors], "array<string>")
    nothing = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("squares"))

    def squares(tokens: Column) -> Column:
        """The sum of the squared counts of all words."""

        def step(a: Column, x: Column) -> Column:
            return F.when(x == a["last"], F.struct(x.alias("last"), (a.run + 1).alias("run"), (a.squares + 2 * a.run + 1).alias("squares"))).otherwise(F.struct(x.alias("last"), F.lit(1).cast("long").alias("run"), (a.squares + 1).alias("squares")))

        return F.aggregate(F.sort_array(tokens), nothing, step, lambda a: a.squares)

    def score(tokens: Column) -> Column:
        spaced = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))

        def counted(string: Column) -> Column:
            count = lambda t: ((F.length(string) - F.length(F.replace(string, F.concat(F.lit(" "), t, F.lit(" ")), F.lit("")))) / (F.length(t) + 2)).cast("long")
            return F.transform(F.array_intersect(tokens, terms_), lambda t: F.struct(F.array_position(terms_, t).cast("int").alias("at"), count(t).alias("tf")))

        def cosines(found: Column) -> Column:
            own = F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.tf * x.tf)
            known = F.aggregate(found, F.lit(0.0), lambda a, x: a + F.pow(x.tf * F.element_at(weights, x.at), F.lit(2.0)))
            norm = F.sqrt(known + F.lit(unseen * unseen) * (squares(tokens) - own))
            dot = lambda row: F.aggregate(found, F.lit(0.0), lambda a, x: a + x.tf * F.element_at(weights, x.at) * F.element_at(row, x.at))
            return let(norm, lambda length: F.array_max(F.transform(rows, lambda row, k: F.struct(F.round(dot(row) / length, 6).alias("score"), F.get(names, k).alias("spdx")))))

        return let(let(let(spaced, counted), cosines), lambda m: F.struct(m.score.alias("score"), m.spdx.alias("spdx"), F.size(tokens).alias("words")))

    def matches(sentences: Column) -> Column:
        held = F.filter(F.transform(sentences, _tokens), lambda t: F.arrays_overlap(t, needed))
        return F.filter(F.transform(held, score), lambda m: m.score >= threshold)

    def both(m: Column) -> Column:
        best = F.array_max(F.concat(m.lines, m.paragraphs))
        words = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x.words)
        return F.struct(best.score.alias("score"), best.spdx.alias("spdx"), F.greatest(words(m.lines), words(m.paragraphs)).alias("words"))

    def of(tokens: Column) -> Column:
        found = let(F.struct(matches(_cut(text)).alias("lines"), matches(wrapped(text)).alias("paragraphs")), both)
        some = F.when(F.arrays_overlap(tokens, needed), found)
        return let(some, lambda m: F.struct(m.score.alias("score"), m.spdx.alias("spdx"), F.coalesce(m.words, F.lit(0)).alias("words"), F.size(tokens).alias("n")))

    return let(_tokens(text), of)


def with_directory(rows: DataFrame, near: DataFrame) -> DataFrame:
    """rows joined to what their directory inherits; over BROADCAST_DIRS directories by a shuffle, in which a directory's rows go to 64 salts."""
    if near.count() <= BROADCAST_DIRS:
        return rows.join(F.broadcast(near), "dir", "left")
    salted = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    spread = rows.withColumn("salt", F.pmod(F.xxhash64("key", "path"), F.lit(64)).cast("int"))
    # rows without a directory have nothing to meet and would meet each other
    out = spread.filter("dir is not null").join(salted, ["dir", "salt"], "left").drop("salt")
    return out.unionByName(spread.filter("dir is null").drop("salt"), allowMissingColumns=True)


def scan(files: DataFrame, path: str = "path", text: str = "text", key: str = "path", threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """key, path, license, score, origin and licensed_dir of each row of files.

    origin is own for a licence found in the file, inherited for one from the nearest ancestor
    directory with a licence file, else null. A licence file is one whose name says so, or at
    least half of whose words are in matching sentences; of several in a directory the best
    score counts, then the later SPDX id. Null paths have no directory and inherit nothing, null
    texts hold nothing. Repeated rows are judged alike; an empty table gives no rows.
    """
    vocabulary = list(dict.fromkeys(t for _, x in templates for t in terms(x)))
    idf, unseen = inverse_frequencies(files, vocabulary, text)
    vectors = template_vectors(idf, templates)
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    name = F.element_at(F.split(F.col(path), "/"), -1)
    rows = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.regexp_replace(F.col(path), "/?[^/]*$", "").alias("dir"), let(lowered, lambda t: best_match(t, vectors, idf, unseen, threshold)).alias("m"), name.rlike(LICENCE_FILE).alias("named"))
    rows = materialize(rows.select("key", "path", "dir", "m.score", "m.spdx", (F.coalesce("named", F.lit(False)) | (2 * F.col("m.words") >= F.col("m.n"))).alias("whole")), "license-files")
    owners = rows.filter("whole and spdx is not null and dir is not null").groupBy("dir").agg(F.max(F.struct("score", "spdx")).alias("o"))
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))
    dirs = rows.filter("dir is not null").select("dir").distinct().select(F.col("dir").alias("below"), F.explode(up).alias("a")).select("below", "a.depth", "a.dir")
    owners = owners.select(F.array_join(parts, "/").alias("dir"), "o").groupBy("dir").agg(F.max("o").alias("o"))
    near = dirs.join(owners, "dir").groupBy("below").agg(F.max(F.struct("depth", "dir", "o")).alias("best"))
    near = materialize(near.select(F.col("below").alias("dir"), F.col("best.dir").alias("licensed_dir"), F.col("best.o.spdx").alias("from_dir"), F.col("best.o.score").alias("dir_score")), "license-dirs")
    out = with_directory(rows, near)
    own = F.col("spdx").isNotNull()
    return out.select(F.col("key").alias(key) if key != "path" else F.col("key").alias("path"), *([] if key == "path" else ["path"]), F.coalesce("spdx", "from_dir").alias("license"), F.coalesce("score", "dir_score").alias("score"), F.when(own, "own").when(F.col("from_dir").isNotNull(), "inherited").alias("origin"), F.when(~own, F.col("licensed_dir")).alias("licensed_dir"))
