"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along paths.

Of a text, comment marks are taken off and these units are compared, as TF-IDF vectors,
with template headers and licence texts: each line, each two and three lines in a row (a
notice may be wrapped), and each paragraph (a header, or what a licence file is made of).
A document takes the best match of its units. A licence file (by its name, or because its
best match opens it) speaks for its directory. A document without a notice inherits from
its nearest ancestor directory that has a licence, by a join of directories with the
ancestors of each distinct directory.

The templates' tokens are the vocabulary. Their document frequencies are counted over the
whole corpus and go to the driver (a token that no template has weighs like the mean of
them). It weighs the templates and finds, for each, rare tokens of which any unit at
``LEAST`` must have one: by Cauchy and Schwarz the templates' other tokens can't reach it.
Only units with such a token are turned into vectors; that loses none.

Only DataFrame functions run. What is broadcast are the templates' vectors, of a fixed size.
Documents are joined to directories by a join that Spark may split where one directory
holds a large share of rows.

Nulls: a null text has no notice and may inherit; a null path has no directory and inherits
nothing; repeated rows get equal results. Equal scores go to the alphabetically first
licence, then to the first path. Long texts are read whole. An empty table gives no rows.
Input columns named like a result give way to it; others are carried along.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ponding.llm.common import materialize, table, text_tag

#: Notices, headers, openings and texts by licence (fixed values).
TEMPLATES = {
    "AGPL-3.0": ["This program is free software licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "Apache License Version 2.0, January 2004"],
    "BSD-2-Clause": ["Licensed under the 2-Clause BSD License.", "SPDX-License-Identifier: BSD-2-Clause", "BSD 2-Clause License"],
    "BSD-3-Clause": ["Licensed under the 3-Clause BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD 3-Clause License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0, dedicated to the public domain.", "Creative Commons Zero v1.0 Universal"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2", "SPDX-License-Identifier: GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3", "SPDX-License-Identifier: GPL-3.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC License", "SPDX-License-Identifier: ISC"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "MIT License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
LICENCE_FILE = "(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
TOKEN = "[a-z]+|[0-9]+(?:\\.[0-9]+)*"
LEAST, OPENING = 0.7, 0.85
#: What stands around the words of a comment.
COMMENT = "(?m)^[ \\t]*(?://+|#+|/?\\*+/?|--+|;+|%+|<!--)?[ \\t]*|[ \\t\\r]*(?:\\*+/|-->)?[ \\t\\r]*$"
RESULTS = ("licence", "score", "own", "inherited_from")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def frequencies(files: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """How many rows of the corpus have each token of the vocabulary; so many numbers go to the driver."""
    known = F.array_intersect(tokens(F.col("text")), F.array(*[F.lit(t) for t in sorted(vocabulary)]))
    return {r.token: r["count"] for r in files.select(F.explode(known).alias("token")).groupBy("token").count().collect()}


def idf(df: float, rows: int) -> float:
    return math.log((1 + rows) / (1 + df)) + 1


def template_vectors(df: dict[str, int], rows: int, templates: dict[str, list[str]]) -> list[tuple[int, str, str, float]]:
    """(template, licence, token, unit weight) from the document frequencies of the templates' tokens."""
    out = []
    for k, (name, text) in enumerate((n, t) for n, texts in templates.items() for t in texts):
        weight = {t: (1 + math.log(n)) * idf(df.get(t, 0), rows) for t, n in Counter(re.findall(TOKEN, text.lower())).items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        out += [(k, name, t, w / norm) for t, w in weight.items()]
    return out


def needed(vectors: list[tuple[int, str, str, float]], df: dict[str, int], least: float) -> set[str]:
    """Tokens, the rarest of each template, of which every unit with a cosine of ``least`` has one."""
    out = set()
    for k in {v[0] for v in vectors}:
        rest = 1.0
        for _, _, token, w in sorted((v for v in vectors if v[0] == k), key=lambda v: (df.get(v[2], 0), v[2])):
            if rest < 0.999 * least * least:
                break
            out.add(token)
            rest -= w * w
    return out


def gate_of(wanted: set[str]) -> str:
    """A pattern that any text with one of the tokens matches."""
    words, numbers = ("|".join(re.escape(t) for t in sorted(wanted) if t[0].isdigit() == digits) for digits in (False, True))
    return "|".join([f"(?<![a-z])(?:{words})(?![a-z])"] * bool(words) + [f"(?<![0-9])(?:{numbers})(?![0-9])"] * bool(numbers))


def units(text: Column, gate: str) -> Column:
    """(place, said) of the lines, of two and three lines in a row, and of the paragraphs; place: of the first line (of a paragraph, 0 for the first, else 1). Only those that match the gate."""
    clean = F.regexp_replace(text, COMMENT, "")
    lines = F.filter(F.split(clean, "\n"), lambda x: x != "")
    paragraphs = F.filter(F.split(clean, "\n{2,}"), lambda x: F.trim(x, F.lit(" \n")) != "")
    entry = lambda place, said: F.struct(place.cast("int").alias("place"), said.alias("said"))

    def windows(lines: Column) -> list[Column]:
        return [F.transform(F.filter(F.sequence(F.lit(0), F.size(lines)), lambda i: i + k <= F.size(lines)), lambda i: entry(i, F.array_join(F.slice(lines, i + 1, F.lit(k)), " "))) for k in (1, 2, 3)]

    every = F.element_at(F.transform(F.array(lines), lambda x: F.concat(*windows(x), F.transform(paragraphs, lambda p, i: entry(F.least(i, F.lit(1)), p)))), 1)
    return F.array_distinct(F.filter(every, lambda u: F.lower(u.said).rlike(gate)))


def notices(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """files: path, tag, text. Each unit at ``least`` with its best template: path, tag, place (0: the text opens with it), licence, score."""
    spark = files.sparkSession
    rows = files.count()
    vocabulary = {t for texts in templates.values() for text in texts for t in re.findall(TOKEN, text.lower())}
    df = frequencies(files, vocabulary)
    known = {t: idf(df.get(t, 0), rows) for t in sorted(vocabulary)}
    weights = F.broadcast(spark.createDataFrame(list(known.items()), "token string, idf double"))
    found = template_vectors(df, rows, templates)
    vectors = F.broadcast(spark.createDataFrame(found, "template int, licence string, token string, weight double"))
    gate = gate_of(needed(found, df, least))
    said = files.where(F.lower("text").rlike(gate)).select("path", "tag", F.explode(units(F.col("text"), gate)).alias("u")).select("path", "tag", "u.*")
    unit = ["path", "tag", "place", "u", "v"]
    # A unit goes on under two hashes, not with its text beside every token.
    said = said.select("path", "tag", "place", F.xxhash64("said").alias("u"), F.xxhash64(F.lit(1), "said").alias("v"), tokens(F.col("said")).alias("tokens")).dropDuplicates(unit)
    tf = said.select(*unit, F.explode("tokens").alias("token")).groupBy(*unit, "token").agg(F.count(F.lit(1)).alias("n"))
    tf = tf.join(weights, "token", "left").withColumn("w", (1 + F.log("n")) * F.coalesce("idf", F.lit(sum(known.values()) / len(known))))
    norms = tf.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(vectors, "token").groupBy(*unit, "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    best = dots.groupBy(*unit).agg(F.min(F.struct((-F.round("dot", 9)).alias("minus"), "licence")).alias("b"))
    norms = norms.withColumnsRenamed({c: f"n_{c}" for c in unit})
    both = best.join(norms, [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in unit])
    return both.select("path", "tag", "place", F.col("b.licence").alias("licence"), (-F.col("b.minus") / F.col("norm")).alias("score")).where(F.col("score") >= least)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder itself, then its parents up to the root (the empty string)."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """files: path, text and others. Adds licence, score, own (it has a notice itself) and inherited_from."""
    carried = [c for c in files.columns if c not in RESULTS]
    keyed = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")).select("path", "text", "row", text_tag())
    found = notices(keyed.select("path", "tag", "text"), templates)
    own = found.groupBy("path", "tag").agg(F.min(F.struct((-F.round("score", 9)).alias("minus"), "licence", "place")).alias("b"))
    own = own.select(F.col("path").alias("o_path"), F.col("tag").alias("o_tag"), F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("score"), ((F.col("b.place") == 0) & (-F.col("b.minus") >= OPENING)).alias("opens"))
    own = materialize(own, "notices")
    speaks = F.col("opens") | F.element_at(F.split("o_path", "/"), -1).rlike(LICENCE_FILE)
    folders = own.where(speaks & F.col("o_path").isNotNull()).groupBy(directory(F.col("o_path")).alias("folder")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence", "o_path")).alias("b"))
    folders = folders.select(F.col("folder").alias("from"), F.col("b.licence").alias("folder_licence"), (-F.col("b.minus")).alias("folder_score"))
    wanted = keyed.where(F.col("path").isNotNull()).select(directory(F.col("path")).alias("f")).distinct()
    nearest = wanted.select("f", F.explode(ancestors(F.col("f"))).alias("from")).join(folders, "from")
    nearest = nearest.groupBy("f").agg(F.max(F.struct(F.length("from").alias("n"), "from", "folder_licence", "folder_score")).alias("b")).select(F.col("f").alias("f_dir"), "b.from", "b.folder_licence", "b.folder_score")
    out = keyed.drop("text").join(own, keyed.path.eqNullSafe(own.o_path) & (keyed.tag == own.o_tag), "left").withColumn("f_own", directory(F.col("path")))
    out = out.join(nearest, out.f_own == nearest.f_dir, "left")
    has = F.col("o_tag").isNotNull()
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in carried],
        F.coalesce("licence", "folder_licence").alias("licence"),
        F.round(F.coalesce("score", "folder_score"), 6).alias("score"),
        has.alias("own"),
        F.when(~has, F.col("from")).alias("inherited_from"),
    )


def document_path(docs: DataFrame) -> Column:
    """A made-up place for each document, as ``documents`` has no paths: source, language, thousands of doc_ids, file."""
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", document_path(docs).alias("path"), "text")
    return scan(files).select("doc_id", "path", "licence", "score", "own", "inherited_from")
