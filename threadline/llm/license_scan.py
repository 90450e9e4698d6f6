"""License scans, in DataFrame functions only.

Lines of any part of a text that hold a licence word are compared with licence templates: with
notices and headers, and with what the texts of licences begin with or are known by. Windows
as long as the template, which begin with the line or where the line has the template's first
term and reach into the following lines, become sparse TF-IDF vectors and are compared by
cosine. A window counts only if it has the same distinguishing terms (versions, numbers of clauses,
"lesser", "noncommercial", ...) as the template, so that a near relative never gives its name. The inverse
document frequencies of the template terms come from all such lines of
the corpus; any other term has their mean, however large the corpus is. The first SPDX line whose
identifiers are all known is taken at its word, with AND, OR and WITH. A document without a licence of its own takes that of the nearest
ancestor directory with a licence file: directories are made distinct first, each is joined
with the licence files of its ancestors, and documents join the outcome by directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Usual notices of common licences, and sentences that their texts are known by.
TEMPLATES = {
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS", "BSD Zero Clause License"),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "Apache-1.1": ("The Apache Software License, Version 1.1",),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "licenses this file to You under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    ),
    "Artistic-2.0": ("The Artistic License 2.0",),
    "BSD-2-Clause": ("Use of this source code is governed by a BSD-style 2-Clause license", "BSD 2-Clause License"),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style 3-Clause license", "BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ),
    "CC-BY-3.0": ("Licensed under CC BY 3.0", "Creative Commons Attribution 3.0 Unported"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    "CC-BY-SA-3.0": ("Licensed under CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    "EPL-1.0": ("made available under the terms of the Eclipse Public License v1.0", "Eclipse Public License - v 1.0"),
    "EPL-2.0": ("This program is made available under the terms of the Eclipse Public License 2.0", "made available under the terms of the Eclipse Public License v2.0", "Eclipse Public License - v 2.0"),
    "EUPL-1.2": ("Licensed under the EUPL, Version 1.2", "European Union Public Licence v. 1.2"),
    "GPL-2.0": (
        "Licensed under the GNU General Public License, version 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "under the terms of the GNU General Public License version 2 only, as published by the Free Software Foundation",
        "licensed under the terms of the GNU General Public License version 2 only",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "MIT": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL-1.1": ("subject to the Mozilla Public License Version 1.1", "Mozilla Public License Version 1.1"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1", "SIL Open Font License Version 1.1"),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",),
    "Zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",),
}
#: The terms that tell a licence from its near relatives.
MARKS = (
    "0", "1", "1.0", "1.1", "1.2", "2", "2.0", "2.1", "2.5", "3", "3.0", "4", "4.0", "v1.0", "v2", "v2.0", "v3", "zero", "two", "three", "four",
    "affero", "lesser", "library", "lgpl", "agpl", "boost", "organization", "cc0", "nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike",
)
#: Identifiers of licences and exceptions that an SPDX line may name, also with "+", "-only" or "-or-later".
SPDX_IDS = (
    *TEMPLATES, "AFL-3.0", "Apache-1.0", "BSD-1-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BlueOak-1.0.0", "CC-BY-2.0", "CC-BY-2.5", "CC-BY-NC-3.0", "CC-BY-NC-SA-3.0", "CDDL-1.0", "CDDL-1.1", "CPL-1.0",
    "ECL-2.0", "EUPL-1.1", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "HPND", "ICU", "IJG", "LGPL-2.0", "MIT-0", "MPL-1.0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OpenSSL", "OSL-3.0", "PHP-3.01",
    "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "UPL-1.0", "Unicode-DFS-2016", "W3C", "X11", "ZPL-2.1", "bzip2-1.0.6", "curl", "libpng-2.0",
    "Autoconf-exception-3.0", "Bison-exception-2.2", "Classpath-exception-2.0", "Font-exception-2.0", "GCC-exception-3.1", "Linux-syscall-note", "LLVM-exception", "OpenSSL-exception",
)
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
HINT = r"(?i)licen[sc]|copyright|public domain|hereby granted|redistribution and use|general public|apache|mozilla|creative commons|unencumbered|without any express"
SPDX = r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)"
IN_BRACKETS = r"^\(([^()]*)\)$"
NO_NAME = r"\(|\)|[ \t]+(?:AND|OR|WITH)[ \t]+"
SUFFIX = r"(?:\+|-only|-or-later)$"


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def longest(templates: Mapping[str, tuple[str, ...]]) -> int:
    return max(len(terms_of(t)) for texts in templates.values() for t in texts)


def spdx(text: Column) -> Column:
    """The first SPDX expression of a text that has known identifiers only, without brackets around the whole."""
    known = [x.lower() for x in SPDX_IDS]
    names = lambda e: F.split(F.regexp_replace(e, NO_NAME, " "), " ")
    good = F.filter(F.regexp_extract_all(text, F.lit(SPDX), 1), lambda e: F.forall(names(e), lambda x: F.lower(F.regexp_replace(x, SUFFIX, "")).isin("", *known)))
    return F.regexp_replace(F.get(good, 0), IN_BRACKETS, "$1")


def licence_lines(docs: DataFrame, id_col: str, text_col: str, path: Column, reach: int) -> DataFrame:
    """(doc_id, path, dir, spdx, lines): the candidate lines of each row of docs, as structs of their own
    terms and of those with up to ``reach`` more from as many following lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.when(text.rlike(HINT) | text.contains("SPDX"), text).otherwise("").alias("text"))
    rows = rows.select("doc_id", "path", spdx(F.col("text")).alias("spdx"), F.split("text", "\n").alias("each"))
    rows = rows.withColumn("terms", F.transform("each", lambda x: F.regexp_extract_all(F.lower(x), F.lit(TERM), 0)))
    places = F.filter(F.sequence(F.lit(0), F.size("each") - 1), lambda i: F.get("each", i).rlike(HINT))
    lines = F.transform(places, lambda i: F.struct(F.get("terms", i).alias("own"), F.slice(F.flatten(F.slice("terms", i + 1, reach + 1)), F.lit(1), F.size(F.get("terms", i)) + reach).alias("all")))
    return rows.select("doc_id", "path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "spdx", F.array_distinct(lines).alias("lines"))


def scan_licences(docs: DataFrame, path: Column, is_licence_file: Column, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, least: float = 0.6, salts: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, path, licence, score (cosine, 4 places; 1 for an SPDX line), origin.

    licence is an identifier, or the expression of an SPDX line as it stands there. origin is "header" (an SPDX
    line, or a window agrees with a template in MARKS and matches by ``least`` or more), a
    directory (its licence file is the nearest above), or null with licence null. Ties go to
    the licence first in the alphabet. Null and empty texts have no lines; a null path has no
    ancestors; repeated rows each give a row; an empty table gives no rows; other columns are
    ignored; a long text is scanned whole, in its row."""
    rows = written(licence_lines(docs, id_col, text_col, path, longest(templates)).withColumn("file", is_licence_file), "licence-lines")
    vocabulary = sorted({t for texts in templates.values() for text in texts for t in terms_of(text)})
    lines = rows.select(F.explode("lines").alias("line")).select(F.array_intersect("line.own", F.array(*map(F.lit, vocabulary))).alias("known"))
    n = lines.count()
    seen = {r.t: r.n for r in lines.select(F.explode("known").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # template terms only
    idf = {t: math.log((1 + n) / (1 + seen.get(t, 0))) + 1 for t in vocabulary}
    weight = F.create_map(*(F.lit(v) for pair in idf.items() for v in pair))
    other = sum(idf.values()) / len(idf)

    def template(name: str, text: str) -> Column:
        own = {t: n * idf[t] for t, n in Counter(terms_of(text)).items()}
        size = math.sqrt(sum(w * w for w in own.values()))
        given = F.create_map(*(F.lit(x) for t, w in own.items() for x in (t, w / size)))
        marks = F.array(*map(F.lit, sorted(own.keys() & set(MARKS)))).cast("array<string>")
        return F.struct(F.lit(name).alias("name"), F.lit(terms_of(text)[0]).alias("first"), F.lit(len(terms_of(text))).alias("n"), given.alias("given"), marks.alias("marks"))

    def cosine(window: Column, given: Column) -> Column:
        dot = F.aggregate(window, F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.try_element_at(given, x["t"]), F.lit(0.0)))
        size = F.aggregate(window, F.lit(0.0), lambda a, x: a + x["w"] * x["w"] * F.size(F.filter(window, lambda y: y["t"] == x["t"])))
        return dot / F.sqrt(size)

    def agrees(window: Column, marks: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(F.filter(window, lambda x: x["mark"]), lambda x: x["t"]))) == marks

    def best_of(line: Column) -> Column:  # the template of the highest score, then of the first name
        weighted = F.transform(line["all"], lambda t: F.struct(t.alias("t"), F.coalesce(F.try_element_at(weight, t), F.lit(other)).alias("w"), t.isin(*MARKS).alias("mark")))
        given = F.array(*(template(name, text) for name, texts in sorted(templates.items()) for text in texts))

        def score(v: Column, t: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(line["own"]) - 1), lambda i: (i == 0) | (F.get(line["own"], i) == t["first"]))
            windows = F.filter(F.transform(starts, lambda i: F.slice(v, i + 1, t["n"])), lambda w: agrees(w, t["marks"]))
            return F.coalesce(F.array_max(F.transform(windows, lambda w: F.round(cosine(w, t["given"]), 4))), F.lit(0.0))

        # weighted once for all templates
        return F.array_min(F.flatten(F.transform(F.array(weighted), lambda v: F.transform(given, lambda t: F.struct((-score(v, t)).alias("s"), t["name"].alias("name"))))))

    best = F.array_min(F.filter(F.transform("lines", best_of), lambda s: s["s"] <= -least))
    own = written(rows.select("doc_id", "path", "dir", "file", F.coalesce("spdx", best["name"]).alias("own"), F.when(F.col("spdx").isNotNull(), 1.0).otherwise(-best["s"]).alias("score")), "own-licences")
    files = own.filter(F.col("file") & F.col("own").isNotNull() & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own").alias("licence"))).alias("best"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    asked = own.filter("own is null and dir is not null").select("dir").distinct().select("dir", F.posexplode(above).alias("depth", "at"))
    found = asked.join(files.withColumnRenamed("dir", "at"), "at").groupBy("dir").agg(F.max_by(F.struct("at", "best"), "depth").alias("near"))
    spread = found.select(F.col("dir").alias("of"), "near", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    out = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    out = out.join(spread, (F.col("dir") == F.col("of")) & (F.col("salt") == F.col("s")), "left")
    mine = F.col("own").isNotNull()
    return out.select(
        "doc_id", "path", F.when(mine, F.col("own")).otherwise(F.col("near.best.licence")).alias("licence"),
        F.when(mine, F.col("score")).otherwise(-F.col("near.best.s")).alias("score"), F.when(mine, F.lit("header")).otherwise(F.col("near.at")).alias("origin"),
    )
