import random
import pytest
from pyspark.sql import functions as F

from threadline.llm import license_scan as L
from threadline.llm import quality_rules as Q
from threadline.llm import url_filter as U


def plain_counts(text):
    words = [w for w in (text or "").translate(str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))).split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.translate(str.maketrans("", "", " \t\n\x0b\x0c\r"))]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered)


def test_counts_of_awkward_rows(spark, awkward, nothing):
    rows = Q.rule_counts(awkward.filter("doc_id is null or doc_id <> 5")).collect()
    texts = {r.doc_id: r.text for r in awkward.select("doc_id", "text").collect()}
    for r in rows:
        assert tuple(r)[2:] == plain_counts(texts[r.doc_id])
    assert tuple(Q.rule_counts(awkward.filter("doc_id = 5")).first())[2:] == (100_000, 440_000, 0, 1, 0, 100_000)
    judged = Q.quality_rules(awkward).collect()
    assert len(judged) == awkward.count()
    assert all(r.base_failed for r in judged if r.doc_id in (3, 4, 6, 5))
    assert Q.quality_rules(nothing).count() == 0


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "x x x x x x x", "a b c d e f", "1 2 3 4 5 6 1 2 3 4 5 9 2 3 4 5 6", "a\x0bb\x85c #*$ |\n\n \nq\nq"])
def test_counts(spark, text):
    got = Q.rule_counts(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert tuple(got)[2:] == plain_counts(text)


def test_bad_hosts_lose_all(spark):
    rows = [(i, "bad", 20, 100, 0, 5, 0, 20) for i in range(40)] + [(100, "bad", 20, 100, 0, 5, 0, 0)] + [(1000 + i, "good", 20, 100, 0, 5, 0, 0) for i in range(40)] + [(2000, "new", 20, 100, 0, 5, 0, 20)] + [(3000, "good", 20, 100, 19, 5, 0, 0)]
    counts = spark.createDataFrame(rows, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    kept = {r.doc_id: r.kept for r in Q.judge(counts).collect()}
    assert not kept[100] and kept[1000] and not kept[3000] and not kept[2000]


def licensed(spark):
    rows = [
        (1, "Released under the MIT License.", "r/LICENSE"), (2, "licensed under the apache license, version 2.0 .", "r/a/LICENSE"), (3, "nothing", "r/a/b/c.txt"), (4, "nothing", "r/x.txt"), (5, "text\nLicensed under CC BY-NC 4.0.\nmore", "r/a/d.txt"),
        (6, None, "other/x.txt"), (7, "", None), (8, "a licence to print money and many other unrelated words", "r/a/e.txt"), (3, "nothing", "r/a/b/c.txt"), (None, "x", "r/a/b/z.txt"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, p string").withColumn("licence", F.lit("clash")).withColumn("dir", F.lit("clash"))


def test_licences(spark):
    docs = licensed(spark)
    scan = lambda d: L.scan_licences(d, F.col("p"), F.coalesce(F.col("path").endswith("/LICENSE"), F.lit(False)))
    rows = scan(docs).collect()
    got = {r.doc_id: (r.licence, r.origin) for r in rows}
    assert len(rows) == docs.count()
    assert got == {1: ("MIT", "header"), 2: ("Apache-2.0", "header"), 3: ("Apache-2.0", "r/a"), 4: ("MIT", "r"), 5: ("CC-BY-NC-4.0", "header"), 6: (None, None), 7: (None, None), 8: ("Apache-2.0", "r/a"), None: ("Apache-2.0", "r/a")}
    assert scan(docs.filter(F.lit(False))).count() == 0


COUNTS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def test_hosts_that_differ_by_chance_get_no_verdict(spark):
    for seed in range(5):
        draw = random.Random(seed)
        rows = [(i, f"h{draw.randrange(30)}", 100, 400, 40 * (draw.random() < 0.06), 5, 4 * (draw.random() < 0.05), 100 * (draw.random() < 0.1)) for i in range(1500)]
        for r in Q.judge(spark.createDataFrame(rows, COUNTS)).collect():
            assert r.kept == (not r.base_failed and r.n_symbols == 0 and r.n_dup_lines == 0)


def test_planted_hosts_among_chance(spark):
    draw = random.Random(7)
    share = {"bad": 0.9, "code": 0.4}  # over half of any rule, and the host goes
    rows = []
    for i in range(4000):
        host = draw.choice(("bad", "code")) if i % 10 == 0 else f"h{draw.randrange(40)}"
        rows.append((i, host, 100, 400, 40 * (draw.random() < share["code"] * (host == "code")), 5, 0, 100 * (draw.random() < (share["bad"] if host == "bad" else 0.05))))
    kept = {}
    for r in Q.judge(spark.createDataFrame(rows, COUNTS)).collect():
        kept.setdefault(r.host, []).append((r.kept, r.base_failed))
    assert not any(k for k, _ in kept["bad"]) and any(not b for _, b in kept["bad"])
    assert all(k == (not b) for host, found in kept.items() if host != "bad" for k, b in found)


def test_prior_takes_chance_out():
    assert Q.beta_prior(1, 50, 2500.0, 10, 2.0, 3.0) == (0.2, None) and Q.beta_prior(0, None, None, None, None, 3.0) == (0.0, None)
    n, rates = 1000, [0.1, 0.3] * 20
    mean, weight = Q.beta_prior(40, 40 * n, 40.0 * n * n, int(sum(rates) * n), sum((p * n) ** 2 / n for p in rates), 3.0)
    assert mean == 0.2 and abs(1 / (1 + weight) - 0.01 / 0.16) < 0.01  # variance of the rates over p (1 - p)


def test_habits_of_a_host(spark):
    row = lambda i, host, symbols, base=0: (i, host, 100, 400, symbols, 5, 0, 100 * base)
    rows = [row(i, "code", 40 if i % 2 else 0) for i in range(400)] + [row(1000 + i, f"h{i % 40}", 40 if i % 201 == 0 else 0) for i in range(4000)]
    counts = spark.createDataFrame(rows, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    kept = {r.doc_id: r.kept for r in Q.judge(counts).collect()}
    assert all(kept[i] for i in range(400))  # full of symbols by habit
    assert sorted(i for i in kept if not kept[i]) == [1000 + i for i in range(0, 4000, 201)]


RULES = (U.Rule("allow", "org", "/"), U.Rule("block", "example.org", "/es/"), U.Rule("allow", "com", "/fr/"))


def urls(spark):
    rows = [(1, "HTTPS://Www.Example.org/es/1?x"), (2, "http://a.org/es/"), (3, "http://org"), (4, "x://spam.net/a#b"), (5, None), (6, "no scheme"), (7, "http://good.net"), (8, "http://notexample.org/es/"), (7, "http://good.net"), (9, "a://b.com/fr/?://x"), (None, "")]
    return spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit("clash"))


def LISTED(spark):
    return spark.createDataFrame([("spam.net",), ("spam.net",), (None,), ("nowhere.example",)], "key string")


#: Usual licence texts, written as they stand in files, with the licence each should give.
USUAL = [
    ("SPDX-License-Identifier: Apache-2.0\nint main() {}", "Apache-2.0"), ("// SPDX-License-Identifier: MIT", "MIT"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.", "GPL-3.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", "Apache-2.0"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.", "GPL-2.0"),
    ("Copyright (c) 2020, A B\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n* Redistributions", "BSD-3-Clause"),
    ("BSD 3-Clause License\n\nCopyright (c) 2020", "BSD-3-Clause"), ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy", "Unlicense"),
    ("MIT License\n\nCopyright (c) 2021 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal", "MIT"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache-2.0"),
    ("Some words before. This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", "MPL-2.0"), ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted", "ISC"),
]


#: Near relatives, headers in comments and expressions, and texts that name no licence.
RELATIVES = [
    ("Boost Software License - Version 1.0 - August 17th, 2003", "BSL-1.0"), ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
    ("Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the \"Software\")", "BSL-1.0"),
    ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999", "LGPL-2.1"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    (" * modify it under the terms of the GNU Lesser General Public License as\n * published by the Free Software Foundation, either version 3 of the\n * License, or (at your option) any later version.", "LGPL-3.0"),
    ("                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007", "AGPL-3.0"),
    ("it under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version.", "AGPL-3.0"),
    ("BSD 2-Clause License\n\nCopyright (c) 2020", "BSD-2-Clause"), ("BSD 3-Clause License", "BSD-3-Clause"), ("BSD Zero Clause License", "0BSD"),
    ("// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.", "BSD-3-Clause"),
    ("Licensed under CC BY 3.0", "CC-BY-3.0"), ("Licensed under CC BY-SA 3.0", "CC-BY-SA-3.0"), ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("Creative Commons Attribution-NoDerivatives 4.0 International", "CC-BY-ND-4.0"),
    ("Creative Commons Attribution-ShareAlike 4.0 International", "CC-BY-SA-4.0"), ("Creative Commons Attribution 4.0 International", "CC-BY-4.0"), ("Creative Commons Legal Code\n\nCC0 1.0 Universal", "CC0-1.0"),
    ("# Licensed to the Apache Software Foundation (ASF) under one or more\n# contributor license agreements.  See the NOTICE file distributed with\n# this work for additional information regarding copyright ownership.\n# The ASF licenses this file to You under the Apache License, Version 2.0\n# (the \"License\"); you may not use this file except in compliance with\n# the License.", "Apache-2.0"),
    ("# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License version 2 as\n# published by the Free Software Foundation.", "GPL-2.0"),
    ("# it under the terms of the GNU General Public License version 2 only, as\n# published by the Free Software Foundation.", "GPL-2.0"),
    ("it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "GPL-3.0"),
    ("The Apache Software License, Version 1.1", "Apache-1.1"), ("Mozilla Public License Version 1.1", "MPL-1.1"), ("Mozilla Public License Version 2.0\n==================================", "MPL-2.0"),
    ("Eclipse Public License - v 1.0", "EPL-1.0"), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "EPL-2.0"), ("Licensed under the EUPL, Version 1.2", "EUPL-1.2"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"), ("The Artistic License 2.0", "Artistic-2.0"), ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.", "Zlib"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\"", "0BSD"),
    ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0-only WITH Linux-syscall-note"), ("SPDX-License-Identifier: MIT OR GPL-3.0", "MIT OR GPL-3.0"),
    ("# SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT OR Apache-2.0"), ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", "(MIT OR Apache-2.0) AND BSD-3-Clause"), ("SPDX-License-Identifier: LGPL-2.1+", "LGPL-2.1+"),
    ("SPDX-License-Identifier: NONE-OF-THE-ABOVE", None), ("SPDX-License-Identifier: MIT OR Whatever-1.0", None), ("SPDX-License-Identifier: nothing\nSPDX-License-Identifier: Zlib", "Zlib"), ("SPDX-License-Identifier:", None),
    ("The driver's license was issued in 2020 by the general public office.", None), ("GNU Library General Public License, version 2", None), ("Copyright 2020 by the authors, all rights reserved", None),
    ("Licensed under the Apache License", None), ("Licensed under CC BY 2.5", None), ("GNU GENERAL PUBLIC LICENSE Version 1, February 1989", None), ("The museum keeps public domain prints and copyright records", None), ("Licensed under a licence of version 2.0 that nobody reads", None),
]


def test_relatives_expressions_and_no_licences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = spark.createDataFrame([(10_000 + i, t) for i, (t, _) in enumerate(RELATIVES)], "doc_id long, text string")
    for rows in (texts, docs.union(texts)):
        found = {r.doc_id: r.licence for r in L.scan_licences(rows, F.concat(F.lit("r/"), F.col("doc_id")), F.lit(False)).filter("doc_id >= 10000").collect()}
        got = [(t, found[10_000 + i], want) for i, (t, want) in enumerate(RELATIVES)]
        assert [x for x in got if x[1] is not None and x[1] != x[2]] == []  # no wrong licence
        assert sum(x[1] == x[2] for x in got) >= 0.95 * len(got), [x for x in got if x[1] != x[2]]


def test_usual_licence_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    usual = spark.createDataFrame([(10_000 + i, t) for i, (t, _) in enumerate(USUAL)], "doc_id long, text string")
    for rows in (usual, docs.union(usual)):
        found = {r.doc_id: r.licence for r in L.scan_licences(rows, F.concat(F.lit("r/"), F.col("doc_id")), F.lit(False)).filter("doc_id >= 10000").collect()}
        assert sum(found[10_000 + i] == name for i, (_, name) in enumerate(USUAL)) >= 0.9 * len(USUAL), found


def test_link_heavy_hosts(spark):
    rows = [(1, "http://A.net/x", "<p>a<p b><a href=x>"), (2, "http://a.net/y", '<a href="1"><a href=2><a href=3>'), (3, "http://b.net", "<p>a<a href=x>"), (4, "http://casino.b", None), (5, None, "<a href=1>"), (6, "http://c.net", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    assert sorted(r.key for r in U.link_heavy(pages, ["casino"]).collect()) == ["", "a.net", "casino.b"]
    assert U.link_heavy(pages.filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_urls(spark, limit):
    got = {r.page_id: tuple(r)[1:] for r in U.filter_urls(urls(spark), LISTED(spark), RULES, max_filter_bytes=limit).collect()}
    assert got == {
        1: ("www.example.org", "/es/1", "example.org/es/", "block"), 2: ("a.org", "/es/", "org/", "allow"), 3: ("org", "", None, "allow"), 4: ("spam.net", "/a", None, "block"), 5: ("", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("good.net", "", None, "allow"), 8: ("notexample.org", "/es/", "org/", "allow"), 9: ("b.com", "/fr/", "com/fr/", "allow"), None: ("", "", None, "allow"),
    }
    assert U.filter_urls(urls(spark), LISTED(spark), RULES).count() == 11
    assert U.filter_urls(urls(spark).filter(F.lit(False)), LISTED(spark), RULES).count() == 0


@pytest.mark.parametrize("listed", ["key % 3 = 0", "key % 97 = 0", "key <> 5", "false", "true"])
def test_cascade_is_exact(spark, listed):
    universe = spark.range(3000).select(F.col("id").alias("key")).withColumn("listed", F.expr(listed)).cache()
    cascade = U.build_cascade(universe.withColumn("key", F.col("key").cast("string")))
    wrong = universe.withColumn("key", F.col("key").cast("string")).filter(cascade.contains(F.col("key")) != F.col("listed"))
    assert wrong.count() == 0
