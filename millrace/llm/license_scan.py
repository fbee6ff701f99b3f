"""Licence scans with DataFrame functions only.

Every text is cut into sentences and lines, and so are its lines joined by paragraph and by two and three neighbours, for
notices are wrapped; pieces that share enough of a template to reach the threshold become sparse TF-IDF vectors, whose cosine
with the templates' vectors comes from a join on terms. The inverse document frequencies are those of the template table, which
is small by nature and is the only thing broadcast; words outside it count in the norm with the largest weight. A file with
no licence of its own takes that of the licence file in its nearest ancestor directory: nearest licences are found once per
directory by joining its ancestor paths, then joined to files by directory.
"""

from __future__ import annotations

import math

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.scratch import materialize

#: Licence names and the wording of their notices, titles and clauses. A wording of several licences names them all.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-2-Clause|BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied."),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1 of the License."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause|BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
]
#: Words that make another licence, or none, of a wording that lacks them.
MODIFIERS = ["affero", "lesser", "library", "not", "software"]
#: Numbers of versions, which a piece must share with a template that has them.
VERSION = r"v?[0-9]+([.][0-9]+)*"
STATED = r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)"
OTHER = r"(?i)\b(licen[sc]ed under|released under|distributed under|under the terms of) [^.\n]{0,80}\blicen[sc]e\b"
UNKNOWN = "unknown"
TERM = "[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]"
THRESHOLD = 0.6
LICENCE_FILES = ["license", "licence", "copying", "license.txt", "licence.txt", "license.md", "copying.txt"]


def terms(text):
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"))


def template_weights(spark: SparkSession, templates: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(term, idf) and (term, template, license, weight, must, bars, needed): the weights are divided by their template's norm;
    must marks versions, of which the template has ``needed``; modifiers that it lacks are there with weight 0 and bar it. A
    template of several licences has its terms for each."""
    base = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    counts = base.select("template", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))
    idf = counts.groupBy("term").agg((F.log(F.lit(1 + len(templates)) / (1 + F.count("*"))) + 1).alias("idf"))
    weights = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count_if(F.regexp_like("term", F.lit(f"^{VERSION}$"))).alias("needed"))
    rows = weights.join(norms, "template").select("term", "template", (F.col("w") / F.col("norm")).alias("weight"), F.regexp_like("term", F.lit(f"^{VERSION}$")).cast("int").alias("must"), F.lit(0).alias("bars"), "needed")
    lacked = base.select("template", F.explode(F.array(*map(F.lit, MODIFIERS))).alias("term")).join(counts.select("template", "term"), ["template", "term"], "left_anti")
    barred = lacked.join(norms, "template").select("term", "template", F.lit(0.0).alias("weight"), F.lit(0).alias("must"), F.lit(1).alias("bars"), "needed")
    names = base.select("template", F.explode(F.split("license", r"\|")).alias("license"))
    return idf, rows.unionByName(barred).join(F.broadcast(names), "template")


def sentences(text):
    return F.split(F.regexp_replace(text, r"([.!?])\s+(\p{Lu})", "$1\n$2"), "\n")


def pieces_of(text):
    """Sentences within lines, within two and three neighbouring lines, and within paragraphs of lines joined; the marks that
    begin the lines of a comment are left out of what is joined."""
    lines = F.split(F.regexp_replace(text, r"\r?\n[ \t/#*;%-]*", "\n"), "\n")
    beside = lambda near, k: F.zip_with(near, F.slice(lines, k, F.size(lines)), lambda a, b: F.concat_ws(" ", a, b))
    two = beside(lines, 2)
    joined = F.concat(two, beside(two, 3), F.split(F.regexp_replace(F.array_join(lines, "\n"), r"([^\n])\n(?=[^\n])", "$1 "), "\n"))
    return F.concat(sentences(text), F.flatten(F.transform(joined, sentences)))


def able_to_reach(weights: DataFrame, threshold: float):
    """Tests of texts and of pieces: can a piece (of the text) have the cosine? By Cauchy and Schwarz a piece's cosine is at most
    the root of the shared terms' squared weights. A template's lightest terms don't reach it all together, so one of its others
    must be there, or its version if it has one; that is tested first, and only templates of such terms are summed. A piece's own vector has a part outside the templates' words, which have the largest weight there, and only
    the rest of its length counts; that is tested first. Terms are found once a text, so they are bound by lambdas."""
    held: dict[int, dict[str, float]] = {}
    versions: dict[int, set[str]] = {}
    for r in weights.filter("weight > 0").collect():  # the templates' terms
        held.setdefault(r.template, {})[r.term] = r.weight**2
        if r.must:
            versions.setdefault(r.template, set()).add(r.term)

    def heavy_of(template: int) -> list[str]:
        """One of these a piece must have to match the template."""
        own, light, out = held[template], 0.0, []
        if template in versions:
            return [max(versions[template], key=lambda t: (own[t], t))]
        for term, w in sorted(own.items(), key=lambda x: (x[1], x[0])):
            light += w
            if light >= threshold**2 - 1e-6:
                out.append(term)
        return out

    every = F.array(*map(F.lit, sorted({t for own in held.values() for t in own})))
    by_term = lambda values: F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    by_heavy: dict[str, list[dict[str, float]]] = {}
    for k, own in held.items():
        for term in heavy_of(k):
            by_heavy.setdefault(term, []).append(own)
    heavy = F.array(*map(F.lit, sorted(by_heavy)))
    squares_of = F.create_map(*(x for term, owns in sorted(by_heavy.items()) for x in (F.lit(term), F.array(*map(by_term, owns)))))
    mass = lambda own, known: F.aggregate(known, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(own, t), F.lit(0.0)))

    def inside(words, known):
        """The share of a piece's squared length that lies in the templates' words, at most: were all of these of the largest
        weight, and all repeats those of one word."""
        others = F.size(F.array_distinct(words)) - F.size(known)
        repeats = (F.size(words) - others - F.size(known) + 1).cast("double")
        squares = repeats * repeats + F.size(known) - 1
        return squares / (squares + others)

    def test(share):
        def able(text):
            reached = lambda known, part: F.exists(F.array_intersect(known, heavy), lambda t: F.exists(F.try_element_at(squares_of, t), lambda own: mass(own, known) * part >= threshold**2 - 1e-6))
            enough = lambda words, known: (F.size(known) > 1) & F.exists(F.array(share(words, known)), lambda part: (part >= threshold**2 - 1e-6) & reached(known, part))
            known_enough = lambda words: F.exists(F.array(F.array_intersect(words, every)), lambda known: enough(words, known))
            return F.exists(F.array(terms(text)), lambda words: F.arrays_overlap(words, heavy) & known_enough(words))

        return able

    return test(lambda words, known: F.lit(1.0)), test(inside)


def own_licenses(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files: (path, text). (path, license, score) of files with a notice.

    A piece matches a template by cosine if it has the template's versions and no modifier that the template lacks; a single
    shared word (German Mit) is no notice. A file's licence is that of which most wordings match, by the sum of their scores,
    then the first name; the score is that of its best piece. A stated identifier is
    the licence with score 1; one that no template has, or a file that names a licence and matches none, is unknown with score
    0. A path may have several texts, whose pieces are told apart."""
    idf, weights = template_weights(files.sparkSession, templates)
    most = math.log(1.0 + len(templates)) + 1
    text_able, piece_able = able_to_reach(weights, threshold)
    pieces = F.filter(F.array_distinct(pieces_of(F.col("text"))), piece_able)
    found = files.filter(text_able(F.col("text"))).select("path", F.explode(pieces).alias("piece")).select("path", F.xxhash64("piece").alias("s1"), F.crc32(F.col("piece").cast("binary")).alias("s2"), "piece")
    # equal pieces of a path are one here: their counts grow alike, which leaves the cosine as it is
    counts = found.select("path", F.struct("s1", "s2").alias("seg"), F.explode(terms(F.col("piece"))).alias("term")).groupBy("path", "seg", "term").agg(F.count("*").alias("tf"))
    weighed = counts.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(most)))
    weighed = weighed.select("path", "seg", "term", "w", F.sqrt(F.sum(F.col("w") * F.col("w")).over(_segment())).alias("norm"))
    sums = [(F.sum(F.col("w") * F.col("weight")) / F.first("norm")).alias("score"), F.count_if(F.col("bars") == 0).alias("shared"), F.sum("must").alias("musts"), F.sum("bars").alias("barred"), F.first("needed").alias("needed")]
    cosine = weighed.join(F.broadcast(weights), "term").groupBy("path", "seg", "template", "license").agg(*sums)
    matched = cosine.filter((F.round("score", 9) >= threshold) & (F.col("shared") > 1) & (F.col("musts") >= F.col("needed")) & (F.col("barred") == 0))
    named = sorted({name for names, _ in templates for name in names.split("|")})
    by_template = matched.groupBy("path", "template", "license").agg(F.max(F.round("score", 9)).alias("score"))
    by_license = by_template.groupBy("path", "license").agg(F.round(F.sum("score"), 9).alias("total"), F.max("score").alias("score"))
    best = by_license.groupBy("path").agg(F.min(F.struct(-F.col("total"), "license", "score")).alias("b")).select("path", F.col("b.license").alias("license"), F.col("b.score").alias("score"))
    stated = F.regexp_replace(F.regexp_extract("text", STATED, 1), "-(only|or-later)$", "")
    told = files.filter(F.contains(F.col("text"), F.lit("SPDX-License-Identifier:"))).select("path", F.when(stated.isin(named), stated).otherwise(UNKNOWN).alias("license")).filter(F.col("license").isNotNull())
    told = told.groupBy("path").agg(F.min("license").alias("license"))  # capitals come before unknown
    other = files.filter(F.regexp_like("text", F.lit(OTHER))).select("path").distinct()
    rows = told.select("path", F.lit(0).alias("place"), "license", F.when(F.col("license") == UNKNOWN, 0.0).otherwise(1.0).alias("score"))
    rows = rows.unionByName(best.select("path", F.lit(1).alias("place"), "license", "score")).unionByName(other.select("path", F.lit(2).alias("place"), F.lit(UNKNOWN).alias("license"), F.lit(0.0).alias("score")))
    first = rows.groupBy("path").agg(F.min(F.struct("place", "license", "score")).alias("f"))
    return first.select("path", F.col("f.license").alias("license"), F.col("f.score").alias("score"))


def _segment():
    from pyspark.sql import Window

    return Window.partitionBy("path", "seg")


def parent(path):
    return F.regexp_replace(path, "/[^/]*$", "")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per path: path, own_license, score, license, inherited_from (directory, null for an own licence or none).

    Null or empty text has no own licence. Paths are compared as written; rows that repeat a path are one file, whose texts are
    all scanned. A null path is left out, for it has no place in the tree. A licence file whose text matches no template gives
    its directory nothing, so the search goes on above. An empty table gives no rows. Other columns are not read."""
    rows = files.filter(F.col(path_col).isNotNull()).select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    own = materialize(own_licenses(rows, templates, threshold), "own-licenses")
    paths = rows.select("path").distinct().join(own, "path", "left").withColumn("dir", parent(F.col("path")))
    paths = materialize(paths, "licensed-paths")
    name = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    given = paths.filter(F.col("license").isNotNull() & (F.col("license") != UNKNOWN) & name.isin(LICENCE_FILES)).groupBy("dir").agg(F.min(F.struct("path", "license")).alias("g")).select(F.col("dir").alias("ancestor"), F.col("g.license").alias("given"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, 1, k)))
    dirs = paths.select("dir").distinct().select("dir", F.posexplode(above).alias("depth", "ancestor"))
    nearest = dirs.join(given, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "given")).alias("n")).select("dir", F.col("n.ancestor").alias("ancestor"), F.col("n.given").alias("given"))
    nearest = materialize(nearest, "nearest-licenses")
    joined = paths.join(nearest, "dir", "left")
    return joined.select(
        "path", F.col("license").alias("own_license"), "score", F.coalesce("license", "given").alias("license"),
        F.when(F.col("license").isNull(), F.col("ancestor")).alias("inherited_from"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """A directory tree for the documents, /hundred/ten/source/file: the first document of a hundred is the licence file of
    that directory, and the first of every other ten that of its own."""
    hundred, ten = F.floor(F.col("doc_id") / 100).cast("string"), F.floor(F.col("doc_id") / 10).cast("string")
    path = (
        F.when(F.col("doc_id") % 100 == 0, F.concat(F.lit("/"), hundred, F.lit("/LICENSE")))
        .when(F.col("doc_id") % 10 == 0, F.concat(F.lit("/"), hundred, F.lit("/"), ten, F.lit("/LICENSE")))
        .otherwise(F.concat(F.lit("/"), hundred, F.lit("/"), ten, F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    )
    return docs.select(path.alias("path"), "text", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    files = document_paths(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = scan(files)
    return files.select("doc_id", "path").join(found, "path", "left").select("doc_id", "path", "own_license", F.round("score", 6).alias("score"), "license", "inherited_from")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = rf"""
with t as (select * from (values {", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))}) t(template, license, text)),
tc as (select template, term, count(*) as tf from (select template, unnest(regexp_extract_all(lower(text), '{TERM}')) as term from t) group by all),
tl as (select template, unnest(string_split(license, '|')) as license from t),
idf as (select term, ln({1 + len(TEMPLATES)}.0 / (1 + count(*))) + 1 as idf from tc group by term),
tw as (select template, term, tf * idf as w, regexp_full_match(term, '{VERSION}') as must from tc join idf using (term)),
tn as (select template, term, w / sqrt(sum(w * w) over (partition by template)) as weight, must, sum(must::int) over (partition by template) as needed from tw),
ba as (select template, term from t, (select unnest([{", ".join(map(_quoted, MODIFIERS))}]) as term) where (template, term) not in (select (template, term) from tc)),
f as (select doc_id, text, case when doc_id % 100 = 0 then '/' || doc_id // 100 || '/LICENSE'
                                when doc_id % 10 = 0 then '/' || doc_id // 100 || '/' || doc_id // 10 || '/LICENSE'
                                else '/' || doc_id // 100 || '/' || doc_id // 10 || '/' || coalesce(source, 'none') || '/' || doc_id || '.txt' end as path from documents),
li as (select path, text, string_split(regexp_replace(text, '\r?\n[ \t/#*;%-]*', chr(10), 'g'), chr(10)) as l from f where text is not null),
p0 as (select path, text as x from li union all select path, unnest(list_transform(l, lambda x, i: concat_ws(' ', x, l[i + 1]))) from li union all select path, unnest(list_transform(l, lambda x, i: concat_ws(' ', x, l[i + 1], l[i + 2]))) from li
       union all select path, unnest(list_transform(regexp_split_to_array(array_to_string(l, chr(10)), '\n\n+'), lambda x: replace(x, chr(10), ' '))) from li),
p1 as (select distinct path, unnest(string_split(regexp_replace(x, '([.!?])\s+(\p{{Lu}})', '\1' || chr(10) || '\2', 'g'), chr(10))) as piece from p0),
p as (select *, row_number() over () as seg from p1),
c as (select path, seg, term, count(*) as tf from (select path, seg, unnest(regexp_extract_all(lower(piece), '{TERM}')) as term from p) group by all),
w as (select path, seg, term, tf * coalesce(idf, ln({1 + len(TEMPLATES)}.0) + 1) as w from c left join idf using (term)),
n as (select *, sqrt(sum(w * w) over (partition by path, seg)) as norm from w),
s as (select path, seg, template, round(sum(w * weight) / min(norm), 9) as score from n join tn using (term) group by path, seg, template having count(*) > 1 and sum(must::int) >= any_value(needed)),
sm as (select path, template, max(score) as score from s where score >= {THRESHOLD} and not exists (select 1 from n join ba using (term) where n.path = s.path and n.seg = s.seg and ba.template = s.template) group by 1, 2),
sl as (select path, license, round(sum(score), 9) as total, max(score) as score from sm join tl using (template) group by 1, 2),
sp as (select path, min(case when y in (select license from tl) then y else '{UNKNOWN}' end) as license from (select path, regexp_replace(regexp_extract(text, '{STATED}', 1), '-(only|or-later)$', '') as y from f where contains(text, 'SPDX-License-Identifier:')) group by 1),
ow as (select path, 0 as place, license, case when license = '{UNKNOWN}' then 0 else 1 end::double as score from sp
  union all select * from (select path, 1, license, score from sl qualify row_number() over (partition by path order by total desc, license) = 1)
  union all select distinct path, 2, '{UNKNOWN}', 0 from f where regexp_matches(text, '{OTHER}')),
own as (select path, license, score from ow qualify row_number() over (partition by path order by place, license) = 1),
l as (select f.doc_id, f.path, regexp_replace(f.path, '/[^/]*$', '') as dir, own.license, own.score from f left join own on own.path = f.path),
g as (select dir, min_by(license, path) as given from l where license is not null and license <> '{UNKNOWN}' and lower(regexp_extract(path, '[^/]*$')) in ({", ".join(map(_quoted, LICENCE_FILES))}) group by dir),
a as (select l.path, max_by(g.dir, length(g.dir)) as ancestor, max_by(g.given, length(g.dir)) as given from l join g on g.dir = l.dir or starts_with(l.dir, g.dir || '/') group by l.path)
select l.doc_id, l.path, l.license as own_license, round(l.score, 6) as score, coalesce(l.license, a.given) as license,
       case when l.license is null then a.ancestor end as inherited_from
from l left join a on a.path = l.path
"""
