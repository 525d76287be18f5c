"""License scans: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

A text is looked at in windows of a line (long lines in overlapping windows) and in windows of several sizes over all its
terms, wherever lines end, each window as a vector over the templates' terms, weighted by inverse document frequencies counted
over all documents. The template with the largest cosine names the window's licence, if the cosine is large enough, and the
best window names the file's. That rights are reserved says least: any other licence in the file goes before it. An SPDX line
names its licence itself.

Windows that can't be close to a template are passed over: a vector without any of a set of terms is no closer to a template
than the root of the share that the other terms have in the template's square. gate_terms() takes the rarest terms of each
template until that bound is under the smallest cosine that counts, so nothing is missed by asking for one of them.

A licence file is one whose name says so, or whose whole text, other words included, is close to a template (which names the
file's licence if no window does); it holds for its directory. A file without a licence of its own gets the one of the nearest directory above it that has one.

All of it is DataFrame expressions and joins. Directories are made distinct before they are joined to their ancestors, so
a directory with a third of all files is one row there; the join back to the files is salted. Inverse frequencies are one row
a template term.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import written

#: Notices by licence, in the words that files use.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying is prohibited."),
    ("Proprietary", "All rights reserved."),
)
TERM = "[a-z]+|[0-9]+(?:[.][0-9]+)*"
SPDX = "(?i)SPDX-License-Identifier:[ \\t]*([A-Za-z0-9.-]+?)(?:-only|-or-later)?[+]?(?![A-Za-z0-9.+-])"
#: The licence that any other goes before, and the words, in this order, without which a text doesn't have it.
LEAST, RESERVED = "Proprietary", "(?i)all[^a-z0-9]+rights[^a-z0-9]+reserved"
#: The licence of a text that has the terms of the one before it, and a clause more.
SHORTER, LONGER, CLAUSE = "BSD-2-Clause", "BSD-3-Clause", "(?i)neither[^a-z0-9]+the[^a-z0-9]+names?[^a-z0-9]"
FILE_NAME = "(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
WINDOW, STRIDE = 64, 32
#: Sizes of the windows over a whole text; they overlap by three quarters.
RUNS = (16, 32, 64, 128)
HEADER_COSINE = 0.75
#: Tasks over which the files of one directory are spread where they meet its licence.
SALTS = 32
#: Of a whole text that counts as a licence file; source files with a notice above their code stay below.
FILE_COSINE = 0.75


def template_terms() -> list[str]:
    return sorted({t for _, text in TEMPLATES for t in re.findall(TERM, text.lower())})


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def inverse_frequencies(files: DataFrame) -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the term)) + 1 for every template term, over all rows of ``files`` (text)."""
    terms = template_terms()
    vocabulary = F.array(*map(F.lit, terms))
    rows = files.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(terms_of(F.coalesce("text", F.lit(""))), vocabulary))).alias("term"))
    counts = {x.term: x.n for x in rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = counts.get("", 0)
    return {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 1 for t in terms} | {"": math.log(1 + n) + 1}


def template_vectors(weights: dict[str, float]) -> list[list[float]]:
    """Unit vectors of the templates over the sorted terms."""
    terms, out = template_terms(), []
    for _, text in TEMPLATES:
        found = re.findall(TERM, text.lower())
        v = [found.count(t) * weights[t] for t in terms]
        size = math.sqrt(sum(x * x for x in v))
        out.append([x / size for x in v])
    return out


def gate_terms(weights: dict[str, float], least: float) -> list[str]:
    """Terms of which every vector has one whose cosine to a template is ``least`` or more."""
    terms, chosen = template_terms(), set()
    for v in template_vectors(weights):
        left = sum(x * x for t, x in zip(terms, v, strict=True) if t not in chosen)
        # Words before numbers, rare ones first.
        for t, x in sorted(zip(terms, v, strict=True), key=lambda p: (p[0][0].isdigit(), -weights[p[0]], p[0])):
            if left < least * least * (1 - 1e-9):
                break
            if x and t not in chosen:
                chosen.add(t)
                left -= x * x
    return sorted(chosen)


def gate_pattern(terms: list[str]) -> str:
    """A pattern that is in every lower-case text that has one of the terms (and in few others). Words with one first letter
    are one branch."""
    by: dict[str, list[str]] = {}
    for t in terms:
        by.setdefault(t[0], []).append(t[1:])
    words = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by.items()) if not c.isdigit())
    numbers = "|".join(re.escape(t) for t in terms if t[0].isdigit())
    return "|".join(x for x in (f"(?<![a-z])(?:{words})(?![a-z])" if words else "", numbers) if x)


def _best(terms: Column, weights: dict[str, float], others: bool) -> Column:
    """(cosine, template) of the closest template to an array of terms; ``others``: terms that no template has count too."""
    names = template_terms()
    numbers = lambda x: F.split(F.lit(",".join(map(repr, x))), ",").cast("array<double>")
    known, own = F.array(*map(F.lit, names)), numbers([weights[t] for t in names])
    vectors = F.array(*[numbers(v) for v in template_vectors(weights)])
    zero = F.lit(0.0)
    codes = F.sort_array(F.transform(terms, lambda w: F.array_position(known, w).cast("int")))
    n = F.size(codes)

    def compared(code):
        # Runs of equal codes give the term frequencies; code 0 stands for all other terms.
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.get(code, i) != F.get(code, i - 1), F.lit(True)))
        runs = F.transform(F.array(ends), lambda e: F.transform(e, lambda x, k: F.struct((F.get(code, x - 1) - 1).alias("c"), (x - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("double").alias("n"))))
        weighted = F.transform(F.get(runs, F.lit(0)), lambda r: F.struct(r["c"].alias("c"), (r["n"] * F.when(r["c"] >= 0, F.get(own, r["c"])).otherwise(F.lit(weights[""] if others else 0.0))).alias("w")))

        def scored(v):
            # Other terms are taken for as many different ones: their squares add up one by one.
            square = F.aggregate(v, zero, lambda s, x: s + F.when(x["c"] >= 0, x["w"] * x["w"]).otherwise(x["w"] * F.lit(weights[""] if others else 0.0)))
            dots = F.transform(vectors, lambda t: F.aggregate(F.filter(v, lambda x: x["c"] >= 0), zero, lambda s, x: s + x["w"] * F.get(t, x["c"])))
            return F.array_max(F.transform(dots, lambda d, k: F.struct(F.when(square > 0, d / F.sqrt(square)).otherwise(zero).alias("cosine"), (-k).alias("template"))))

        return F.get(F.transform(F.array(weighted), scored), F.lit(0))

    found = F.get(F.transform(F.array(codes), compared), F.lit(0))
    none = F.struct(zero.alias("cosine"), F.lit(0).alias("template"))
    return F.when(n > 0, found).otherwise(none)


def cut(terms: Column, size: int, stride: int) -> Column:
    """Overlapping windows of an array of terms."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(terms) - size) / stride).cast("int")))
    return F.transform(starts, lambda i: F.slice(terms, i * stride + 1, F.lit(size)))


def windows_of(text: Column, pattern: str) -> Column:
    """Arrays of terms: of each line of a lower-case text that has the gate's pattern, long lines in overlapping windows."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))
    return F.flatten(F.transform(F.transform(lines, terms_of), lambda t: cut(t, WINDOW, STRIDE)))


def runs_of(text: Column, gate: list[str]) -> Column:
    """Arrays of terms: the windows over all terms of a text that have one of the gate's."""
    wanted = F.array(*map(F.lit, gate)).cast("array<string>")
    held = lambda t: F.concat(*[F.filter(cut(t, n, n // 4), lambda w: F.arrays_overlap(w, wanted)) for n in RUNS])
    return F.flatten(F.transform(F.array(terms_of(text)), held))


def own_licenses(files: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``files`` (path, text) with __own (the licence of the best window), __cosine, and __file (the licence that a licence
    file gives its directory). Windows beyond a line count if they are close enough to name a licence. __cosine is the largest
    of a line's windows or of those; it is exact from FILE_COSINE on, and may be too small below."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lower, gate = F.lower(text), gate_terms(weights, min(FILE_COSINE, HEADER_COSINE))
    labels = F.array(*[F.lit(k) for k, _ in TEMPLATES])
    name = lambda best: F.get(labels, -best["template"])

    def ranked(t):
        best = F.transform(F.array(_best(t, weights, False)), lambda x: F.struct(((x["cosine"] >= HEADER_COSINE) & (name(x) != LEAST)).alias("first"), x["cosine"].alias("cosine"), x["template"].alias("template")))
        return F.get(best, F.lit(0))

    some = lower.rlike(gate_pattern(gate)) if gate else F.lit(False)
    line = F.array_max(F.transform(windows_of(lower, gate_pattern(gate)), ranked))
    run = F.array_max(F.filter(F.transform(runs_of(lower, gate), ranked), lambda x: x["cosine"] >= HEADER_COSINE))
    found = files.withColumns({"__line": F.when(some, line), "__run": F.when(some, run), "__whole": F.when(some, _best(terms_of(text), weights, True))})
    found = found.withColumn("__best", F.greatest("__line", "__run"))
    base = F.element_at(F.split("path", "/"), -1)
    spdx = F.lower(F.regexp_extract(text, SPDX, 1))
    said = F.get(F.filter(labels, lambda x: F.lower(x) == spdx), F.lit(0))
    close = F.coalesce(F.col("__whole.cosine"), F.lit(0.0)) >= FILE_COSINE
    fuller = lambda label: F.when((label == SHORTER) & text.rlike(CLAUSE), LONGER).otherwise(label)
    least = lambda label: F.when((label != LEAST) | text.rlike(RESERVED), fuller(label))
    far = F.when(F.col("__best.cosine") >= HEADER_COSINE, least(name(F.col("__best"))))
    own = F.coalesce(F.when(spdx != "", said), F.when(F.col("__best.first"), far), F.when(close, least(name(F.col("__whole")))), far)
    found = found.withColumn("__own", own)
    named = F.coalesce(base.rlike(FILE_NAME), F.lit(False)) | close
    return found.withColumns({"__cosine": F.coalesce(F.col("__best.cosine"), F.lit(0.0)), "__file": F.when(named, F.col("__own"))}).drop("__line", "__run", "__best", "__whole")


def parent(path: Column) -> Column:
    """The directory of a path; the empty string for the root and for no path."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


def inherit(found: DataFrame) -> DataFrame:
    """Rows of own_licenses() without __own, __cosine and __file, and with license, license_from and cosine."""
    columns = [c for c in found.columns if c not in ("__own", "__cosine", "__file", "license", "license_from", "cosine")]
    found = found.withColumn("__dir", parent(F.col("path")))
    votes = found.where(F.col("__file").isNotNull()).groupBy("__dir", "__file").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("__dir").orderBy(F.desc("n"), "__file")
    given = votes.withColumn("k", F.row_number().over(first)).where("k = 1").select(F.col("__dir").alias("above"), F.col("__file").alias("given"))
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    dirs = found.select("__dir").distinct()
    ancestors = dirs.select("__dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = ancestors.join(given, "above").groupBy("__dir").agg(F.max_by("given", F.length("above")).alias("inherited"))
    # A directory's files are spread over SALTS tasks, each of which gets the directory's row.
    spread = nearest.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = found.withColumn("__salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    joined = salted.join(spread, ["__dir", "__salt"], "left")
    kind = F.when(F.col("__own").isNotNull(), "header").when(F.col("inherited").isNotNull(), "directory").otherwise("none")
    named = joined.withColumns({"license": F.coalesce("__own", "inherited"), "license_from": kind, "cosine": F.round("__cosine", 6)})
    return named.select(*columns, "license", "license_from", "cosine")


def scan(files: DataFrame) -> DataFrame:
    """``files`` (path, text, other columns; text is left out) with license, license_from and cosine (to the closest
    template, see own_licenses()). What the files say themselves is written first, so the texts are never shuffled.

    license_from is ``header`` for a licence in the file itself, ``directory`` for an inherited one, else ``none`` with a null
    license. Where a directory's files disagree, the licence that most of them have holds, the first by name if as many. Null
    texts have no licence of their own, null paths lie in the root directory. No row is dropped or added.
    """
    return inherit(written(own_licenses(files, inverse_frequencies(files)).drop("text"), "own-licenses"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, path, license, license_from, cosine) for every row of ``docs`` (doc_id, text, lang, source), which as a file
    lies at source/lang/doc_id.txt."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), name)
    return scan(docs.select("doc_id", path.alias("path"), F.col("text").cast("string")))
