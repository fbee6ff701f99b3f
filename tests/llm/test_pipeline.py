import random

import pyspark.sql.functions as F

import corpus_pipeline
from millrace.llm import jaccard_join

from .test_line_dedup import brute
from .test_shingle_joins import components, grams


def folder(spark, tmp_path):
    rnd = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("ne", "the", "or", "and") for b in ("ka", "lo", "mi", "st", "un", "er", "ou")]
    body = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    item = body(30)
    near = body(120).split()
    rows = [(i, "\n".join(body(30) for _ in range(4)), "en") for i in range(40)]
    rows += [(50, "123 456 !!", "en"), (51, None, "en"), (52, "", None)]
    rows += [(60 + i, " ".join(near[:i] + ["changed"] + near[i + 1 :]), "en") for i in range(4)]
    rows += [(70, body(20) + " " + item + " " + body(20), "en")]
    shared = "\n".join(body(60) for _ in range(2))
    rows += [(80 + i, body(25) + "\n" + shared, "en") for i in range(3)]
    docs = spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), item


def test_stages_against_brute_force(spark, tmp_path):
    sf, item = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    seen = rows(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = rows(out)
        if name == "language_id":
            want = {k: t for k, t in seen.items() if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            want = {k: t for k, t in brute(list(seen.items())) if t.strip()}
        elif name == "near_duplicates":
            keep = {k for k, n, c in components(list(seen.items())) if k == c}
            want = {k: t for k, t in seen.items() if k in keep}
        else:
            own = grams(item)
            want = {k: t for k, t in seen.items() if len(own & grams(t)) < 0.75 * len(own)}
        assert got == want, name
        assert all(r.n_chars == len(r.text) for r in out.collect())
        out.write.parquet(f"{sf}/{name}")
        docs, seen = spark.read.parquet(f"{sf}/{name}"), got
    assert 70 not in seen and len({60, 61, 62, 63} & seen.keys()) == 1 and set(range(40)) <= seen.keys()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == seen.keys()
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect()) == sorted(tuple(r)[:5] for r in packed.collect())


def test_order_of_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"] and jaccard_join


def test_texts_of_no_learned_language_go(spark):
    rnd = random.Random(4)
    words = {"en": ["the", "house", "and", "water", "with", "other"], "fr": ["le", "maison", "et", "avec", "eau", "autre"], "de": ["das", "haus", "und", "wasser", "mit", "andere"], "es": ["la", "casa", "agua", "con", "otro", "pero"]}
    rows = [(10 * i + j, " ".join(rnd.choice(own) for _ in range(200)), lang) for i, (lang, own) in enumerate(words.items()) for j in range(10)]
    noise = " ".join("".join(rnd.choice("bcdfghjkqvwxyz") for _ in range(7)) for _ in range(60))
    rows += [(100, "สวัสดีครับ " * 30, None), (101, "你好世界 " * 30, None), (102, noise, None), (103, "the house " + "สวัสดีครับ " * 30, None), (104, "the house", None), (105, "你好", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "").collect()} == {*range(40), 104}


def test_one_row_of_each_group_of_near_duplicates_stays(spark):
    rnd = random.Random(6)
    text = lambda: " ".join(str(rnd.random()) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [
        (1, a, "x"), (2, near(a), "x"), (2, b, "x"),  # one id, two texts: only the copy goes
        (3, c, "z"), (3, c, "y"), (3, c, "y"), (4, near(c), "x"),  # repeated rows
        (None, d, "x"), (None, d, "x"), (None, near(d), "x"), (None, e, "x"), (9, near(e), "x"),  # null ids
        (5, "", "x"), (5, "", "x"), (None, None, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert len([r for r in got if r[0] is None and r[1] in (d, near(d))]) == 1
    rest = [r for r in got if not (r[0] is None and r[1])]
    assert sorted(rest, key=str) == sorted([(1, a, "x"), (2, b, "x"), (3, c, "y"), (9, near(e), "x"), (5, "", "x"), (5, "", "x"), (None, None, "x")], key=str)


def test_columns_of_callers_come_through(spark, tmp_path):
    text = "\n".join(" ".join(f"the{a}{b} and" for b in "klmnop") for a in "abcd")
    extra = ["score", "supported", "row_key", "row_id", "lines", "removed_chunks", "lang_pred", "spans", "repeats", "k1", "c0", "node", "column_9"]
    rows = [(i, text.replace("thea", f"the{'xyz'[i]}a{i}"), "en", *(f"{c}{i}" for c in extra)) for i in range(3)]
    spark.createDataFrame([(1, "not in any of these documents")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", *extra]).withColumn("doc_id", F.col("doc_id").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", *extra], name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = docs.drop("text").collect()
    assert left and all(tuple(r) == (r.doc_id, "en", *(f"{c}{r.doc_id}" for c in extra)) for r in left)
