import math
import re
from collections import Counter

from millrace.llm.license_scan import MODIFIERS, TEMPLATES, TERM, VERSION, scan


def cosine_of(piece):
    vectors = [Counter(re.findall(TERM, t.lower())) for _, t in TEMPLATES]
    df = Counter(w for v in vectors for w in v)
    idf = {w: math.log((1 + len(TEMPLATES)) / (1 + n)) + 1 for w, n in df.items()}
    weigh = lambda v: {w: n * idf.get(w, math.log(1 + len(TEMPLATES)) + 1) for w, n in v.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = weigh(Counter(re.findall(TERM, piece.lower())))
    fits = lambda v: all(w in own for w in v if re.fullmatch(VERSION, w)) and not any(w in own and w not in v for w in MODIFIERS)
    scores = [(-sum(own.get(w, 0) * x for w, x in weigh(v).items()) / norm(weigh(v)) / norm(own) if fits(v) else 0.0, name) for v, (name, _) in zip(vectors, TEMPLATES)]
    return min(scores)


def test_scores_and_inheritance(spark):
    mit, apache = "Released under the MIT License.", "licensed under the apache license version 2.0"
    files = [
        ("/a/LICENSE", f"Some text. {mit} More of it."), ("/a/x.txt", "nothing"), ("/a/b/c/y.txt", None), ("/a/b/COPYING", "no licence matches these words"), ("/a/b/c/z.py", "code\n" + apache + "\ncode"),
        ("/d/e.txt", ""), ("/LICENSE", "All rights reserved."), ("top.txt", "plain"), (None, mit), ("/a/x.txt", "nothing"), ("/long.txt", "filler " * 50000 + ".\n" + mit),
    ]
    df = spark.createDataFrame([(p, t, 1.0) for p, t in files], "path string, text string, score double").repartition(4)
    got = {r.path: r for r in scan(df).collect()}
    assert len(got) == 10 - 1 and got["/a/LICENSE"].own_license == "MIT" and abs(got["/a/LICENSE"].score - 1) < 1e-9
    assert (got["/a/x.txt"].license, got["/a/x.txt"].inherited_from) == ("MIT", "/a")
    assert (got["/a/b/c/y.txt"].license, got["/a/b/c/y.txt"].inherited_from) == ("MIT", "/a")
    assert got["/a/b/c/z.py"].own_license == "Apache-2.0" and abs(got["/a/b/c/z.py"].score + cosine_of(apache)[0]) < 1e-6 and got["/a/b/c/z.py"].inherited_from is None
    assert (got["/d/e.txt"].license, got["/d/e.txt"].inherited_from) == ("Proprietary", "") and got["top.txt"].license is None
    assert got["/long.txt"].own_license == "MIT" and scan(df.limit(0)).count() == 0


def test_wrapped_notices(spark):
    files = {
        "/mpl.c": ("// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\nint x;", "MPL-2.0"),
        "/mpl2.c": ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, version 2.0.\n", "MPL-2.0"),
        "/bsd.go": ("# Use of this source code is governed by a BSD-style\n# license that can be found in the LICENSE file.\n", "BSD-3-Clause"),
        "/cc0.md": ("This work is dedicated to the public\ndomain under CC0 1.0.\n", "CC0-1.0"),
        "/narrow.c": (" * This program is free\n * software: you can redistribute\n * it and/or modify it under\n * the terms of the GNU\n * General Public License,\n * version 3.\n", "GPL-3.0"),
        "/de.txt": ("Das ist alles. Mit. Und mehr.\n", None),
        "/plain.txt": ("The public house is subject to the terms\nof this file, and you may not use it.\n", None),
    }
    df = spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string")
    assert {r.path: r.own_license for r in scan(df).collect()} == {p: name for p, (_, name) in files.items()}


def test_texts_of_one_path_are_scanned_apart(spark):
    rows = [("/a/LICENSE", "Released under the MIT License."), ("/a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("/a/LICENSE", "Released under the MIT License."), ("/b/LICENSE", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.")]
    got = {r.path: (r.own_license, round(r.score, 9)) for r in scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"/a/LICENSE": ("Apache-2.0", 1.0), "/b/LICENSE": ("Apache-2.0", 1.0)}
    got = scan(spark.createDataFrame([("/a/LICENSE", "Released under the MIT License."), ("/a/LICENSE", "some Apache notes")], "path string, text string")).first()
    assert (got.own_license, round(got.score, 9)) == ("MIT", 1.0)


def test_files_of_whole_licences(spark):
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal\nin the Software without restriction, including without limitation the rights.\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    bsd = "Copyright 2019 B. Person\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.\n"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
    files = {"/m/LICENSE": (mit, "MIT"), "/b/LICENSE": (bsd, "BSD-2-Clause"), "/i/COPYING": (isc, "ISC"), "/u/LICENSE": ("This is free and unencumbered software released into the public domain.\n", "Unlicense")}
    df = spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string")
    assert {r.path: r.own_license for r in scan(df).collect()} == {p: name for p, (_, name) in files.items()}


def test_the_bound_loses_no_notice(spark):
    """Every piece of three to six words of a template, among others: found if and only if its cosine reaches the threshold."""
    import random

    rnd = random.Random(2)
    words = sorted({w for _, t in TEMPLATES for w in re.findall(TERM, t.lower())})
    pieces = [" ".join(rnd.sample(re.findall(TERM, rnd.choice(TEMPLATES)[1].lower()), 3) + rnd.sample(words, rnd.randrange(0, 4))) for _ in range(400)]
    got = {r.path: r.own_license for r in scan(spark.createDataFrame([(f"/{i}/x", p) for i, p in enumerate(pieces)], "path string, text string")).collect()}
    best = [cosine_of(p) for p in pieces]
    assert {f"/{i}/x" for i, b in enumerate(best) if round(-b[0], 9) >= 0.6} == {p for p, name in got.items() if name and name != "unknown"}


BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\nthis list of conditions and the following disclaimer in the documentation\nand/or other materials provided with the distribution.\n"
THIRD = "\n3. Neither the name of the copyright holder nor the names of its contributors\nmay be used to endorse or promote products derived from this software without\nspecific prior written permission.\n"
CASES = {
    "BSD-2-Clause": [BSD, BSD.replace("\n", "\n * ")], "BSD-3-Clause": [BSD + THIRD],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "# SPDX-License-Identifier: GPL-2.0-or-later"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "// This library is free software; you can redistribute it and/or\n// modify it under the terms of the GNU Lesser General Public\n// License as published by the Free Software Foundation; either\n// version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License Version 3, 29 June 2007"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-1.1": ["The Apache Software License, Version 1.1", "Licensed under the Apache Software License, Version 1.1."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License\nVersion 2.0, January 2004"],
    "MIT": ["x\nSPDX-License-Identifier: MIT\ny", "Released under the MIT License."],
    "unknown": ["Licensed under the Frobnicate Public License 7.", "SPDX-License-Identifier: Frob-1.0", "This work is licensed under the GNU General Public License, version 9."],
    None: ["All rights are not reserved.", "Mit freundlichen Grüßen.", "version 3", ""],
}


def test_versions_and_clauses_are_told_apart(spark):
    rows = [(f"/{name}/{i}", text, name) for name, texts in CASES.items() for i, text in enumerate(texts)]
    got = {r.path: r.own_license for r in scan(spark.createDataFrame(rows, "path string, text string, license string")).collect()}
    assert got == {path: name for path, _, name in rows}


def test_versions_and_clauses_in_the_sql(spark, tmp_path):
    import duckdb

    from millrace.llm.license_scan import SQL, query

    rows = [(7 * i + 1, text, "s") for i, text in enumerate(t for texts in CASES.values() for t in texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "own_license", "score", "license", "inherited_from"]
    assert sorted(map(str, con.sql(f"select {', '.join(columns)} from ({SQL})").fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in query(spark, str(tmp_path)).collect())
