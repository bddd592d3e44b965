"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory by path joins.

A text is looked at in three units: each line, each paragraph (lines up to one without a token, so that a notice wrapped over lines or set in
comment marks is one unit), and the whole file. A unit is a vector of its tokens (runs of letters and digits, lower-cased), weighted by count
times idf. The idf of a template token is ln((1 + lines) / (1 + lines that hold it)) over all lines of the corpus; a token of no template has
the idf of a token in no line. Templates are one-line notices, standard headers and the texts of licence files. A file's own license is that
of the template with the best cosine over its units, if that reaches `least`.

Only units that can reach it are scored: a cosine is at most the share of the template's norm on the tokens in common, so a unit needs a
token outside the lightest ones that together hold less than least ** 2 of the template's squared norm. Those core tokens are few and become
one array literal. The texts are read twice: for the idf, and for the units' tokens, which are written to the shared folder. Units with the same
tokens are one vector, scored once and in its own row, since unlike texts with one notice are all vectors.

A file named like LICENSE or COPYING declares its license for its directory. A file without one of its own takes that of the nearest
directory above it that declares one: its ancestor paths are joined with the declaring directories and the longest wins.

Defined results: null text has no lines, null path no directory; rows with one id share the best unit among them, a null id has none; templates with equal cosine go by name; of several license files in one
directory the best score wins, then the name; repeated rows are scanned alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

TOKEN = r"[a-z0-9]+"

#: Notices, headers and licence texts as they are published (SPDX identifier, text).
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)
FILES = r"(?i)^(licen[sc]e|copying|unlicense)([._-].*)?$"


def _lines(files: DataFrame) -> DataFrame:
    """(id, path, line_no, tokens) of all lines with a token."""
    line = F.posexplode(F.split(F.lower(F.col("text")), r"\r\n|\r|\n"))
    lines = files.where("text IS NOT NULL").select("id", line.alias("line_no", "line"))
    return lines.select("id", "line_no", F.regexp_extract_all("line", F.lit(TOKEN), 0).alias("tokens"))


def _units(files: DataFrame, core: Column) -> DataFrame:
    """(id, unit, tokens) of the lines, paragraphs and whole texts that hold a token of core. Unit numbers are unlike within a file."""
    text = F.regexp_replace(F.lower(F.col("text")), r"\r\n?", "\n")
    pieces = F.concat(F.array(text), F.split(text, r"\n(?:[^a-z0-9\n]*\n)+"), F.split(text, r"\n"))
    units = files.where("text IS NOT NULL").select("id", F.posexplode(pieces).alias("unit", "piece"))
    units = units.select("id", "unit", F.regexp_extract_all("piece", F.lit(TOKEN), 0).alias("tokens"))
    return units.where(F.arrays_overlap("tokens", core))


def core_tokens(vectors: dict[str, dict[str, float]], least: float) -> list[str]:
    """Tokens of which a line must have at least one to reach the cosine `least` with any template."""
    core = set()
    for v in vectors.values():
        norm, held = sum(x * x for x in v.values()), 0.0
        for token, x in sorted(v.items(), key=lambda kv: (kv[1], kv[0])):
            held += x * x
            if held >= least * least * norm * (1 - 1e-9):
                core.add(token)
    return sorted(core)


def _has_any(text: Column, tokens: list[str]) -> Column:
    """A cheap test of the whole text that no line with one of the tokens fails."""
    return F.lower(text).rlike("|".join(map(re.escape, tokens)))


def _best(tokens: Column, names: list[str], vectors: list[dict[str, float]], vocab: list[str], idf: dict[str, float], other: float, least: float) -> Column:
    """The least struct of s (the negative cosine) and name that reaches `least`, or null; worked out in the unit's own row.

    The tokens are sorted together with one of each token of vocab, so that runs are counts and the k-th run of a token of vocab is that of
    vocab[k - 1]: no token is looked up, joined or made a row. Each run adds its square to the norm and, if known, its share to every dot.
    """
    numbers = lambda xs: f"array({', '.join(f'{x!r}D' for x in xs)})"
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    known, weight = F.array(*map(F.lit, vocab)), F.expr(numbers(idf[t] for t in vocab))
    share = F.expr(f"array({', '.join(numbers(idf[t] * v.get(t, 0.0) / n for v, n in zip(vectors, norms, strict=True)) for t in vocab)})")

    def closed(acc: Column) -> tuple[Column, Column]:
        """The squared norm and the dots with the run that has just ended."""
        mine = (acc["k"] > 0) & (F.get(known, acc["k"] - 1) == acc["t"])
        w = F.when(mine, (acc["n"] - 1) * F.get(weight, acc["k"] - 1)).otherwise(acc["n"] * other)
        more = F.zip_with(acc["dots"], F.get(share, acc["k"] - 1), lambda d, x: d + (acc["n"] - 1) * x)
        return acc["sq"] + w * w, F.when(mine & (acc["n"] > 1), more).otherwise(acc["dots"])

    def state(t: Column, n: Column, k: Column, sq: Column, dots: Column) -> Column:
        return F.struct(t.alias("t"), n.alias("n"), k.alias("k"), sq.alias("sq"), dots.alias("dots"))

    def step(acc: Column, x: Column) -> Column:
        again = state(acc["t"], acc["n"] + 1, acc["k"], acc["sq"], acc["dots"])
        k = acc["k"] + F.when(F.get(known, acc["k"]) == x, 1).otherwise(0)
        return F.when(x == acc["t"], again).otherwise(state(x, F.lit(1.0), k, *closed(acc)))

    def finish(acc: Column) -> Column:
        sq, dots = closed(acc)
        each = F.zip_with(dots, F.array(*map(F.lit, names)), lambda d, name: F.struct((-F.round(d / F.sqrt(sq), 9)).alias("s"), name.alias("name")))
        return F.array_min(F.filter(each, lambda x: x["s"] <= -least))

    start = state(F.lit(""), F.lit(0.0), F.lit(0), F.lit(0.0), F.expr(numbers([0.0] * len(names))))
    return F.aggregate(F.sort_array(F.concat(tokens, known)), start, step, finish)


def scan(files: DataFrame, templates=TEMPLATES, least: float = 0.6) -> DataFrame:
    """id, path, own_license, own_score, license, license_from (own, directory or null), directory for every row of files(id, path, text)."""
    spark = files.sparkSession
    names, counts = [n for n, _ in templates], [Counter(re.findall(TOKEN, text.lower())) for _, text in templates]
    vocab = sorted({t for c in counts for t in c})
    known = F.array(*map(F.lit, vocab))
    # every line also counts for the empty token
    df = _lines(files).select(F.explode(F.array_append(F.array_intersect("tokens", known), F.lit(""))).alias("t"))
    per = {r["t"]: r["n"] for r in df.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_lines = per.get("", 0)
    idf = {t: math.log((1 + n_lines) / (1 + per.get(t, 0))) + 1e-9 for t in vocab}
    other = math.log(1 + n_lines) + 1e-9
    vectors = [{t: k * idf[t] for t, k in c.items()} for c in counts]
    core = core_tokens(dict(enumerate(vectors)), least)

    # units of equal tokens are scored once, so that a notice that all files have is one vector
    units = _units(files.where(_has_any(F.col("text"), core)), F.array(*map(F.lit, core)))
    units = staged(units.select("id", F.unhex(F.sha2(F.array_join("tokens", " "), 256)).alias("key"), "tokens"), "units")
    texts = units.groupBy("key").agg(F.first("tokens").alias("tokens"))
    found = staged(texts.select("key", _best(F.col("tokens"), names, vectors, vocab, idf, other, least).alias("b")), "vectors")
    of_text = found.where("b IS NOT NULL")
    best = units.select("id", "key").join(of_text, "key").groupBy("id").agg(F.min("b").alias("b"))
    best = staged(best.select("id", F.col("b.name").alias("own_license"), (-F.col("b.s")).alias("own_score")), "licenses")

    parts = F.split("path", "/")
    here = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    rows = files.select("id", "path").join(best, "id", "left").withColumn("dir", here).withColumn("file", F.element_at(parts, -1))
    declared = rows.where(F.col("own_license").isNotNull() & F.col("file").rlike(FILES)).groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("name"))).alias("d"))
    declared = declared.select(F.col("dir").alias("directory"), F.col("d.name").alias("dir_license"))
    need = rows.where(F.col("own_license").isNull() & F.col("path").isNotNull()).select("dir").distinct()
    steps = F.split("dir", "/")
    ups = need.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("directory"))
    near = ups.join(declared, "directory").groupBy("dir").agg(F.max_by(F.struct("directory", "dir_license"), F.length("directory")).alias("n"))
    out = rows.join(near, "dir", "left")
    own = F.col("own_license").isNotNull()
    return out.select(
        "id", "path", "own_license", "own_score", F.coalesce("own_license", "n.dir_license").alias("license"),
        F.when(own, "own").when(F.col("n").isNotNull(), "directory").alias("license_from"), F.when(~own, F.col("n.directory")).alias("directory"),
    )


def document_paths(docs: DataFrame, group: int = 37) -> DataFrame:
    """(id, path, text): documents as files of a tree. Every `group` neighbouring ids of a source are a directory in the source's; ids
    divisible by `group` are its license files."""
    name = F.when(F.col("doc_id") % group == 0, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")))
    top = F.coalesce(F.col("source").cast("string"), F.lit("unknown"))
    path = F.concat_ws("/", top, F.floor(F.col("doc_id") / (group * 25)).cast("string"), F.floor(F.col("doc_id") / group).cast("string"), name)
    return docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
