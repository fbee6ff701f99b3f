import os
import random
import shutil

import pyarrow.parquet as pq
import pyspark.sql.functions as F
import pytest

from millrace.operators import lexical as L
from millrace.operators import segments as S

WORDS = [f"w{i}" for i in range(60)]


def texts(spark, seed, ids, most=30):
    rnd = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [(i, i // 3, " ".join(rnd.choices(WORDS, weights, k=rnd.randrange(0, most)))) for i in ids]
    return spark.createDataFrame(rows, "chunk_id long, doc_id long, text string")


def contents(store):
    posts = sorted(tuple(r) for r in store.postings().select("term", "chunk_id", "doc_id", "length", "tf").collect())
    return posts, sorted(tuple(r) for r in store.chunks().select("chunk_id", "doc_id", "length").collect()), sorted((r.term, r.df, round(r.idf, 9)) for r in store.terms().collect()), (store.n, store.length)


def size(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_grown_store_equals_one_built_anew(spark, tmp_path):
    whole = texts(spark, 1, range(400))
    store = S.create(whole.filter("chunk_id < 150"), str(tmp_path / "a"), buckets=2)
    for low, high in ((100, 200), (200, 260), (250, 330), (330, 400)):
        store = S.add(store, whole.filter(f"chunk_id >= {low} and chunk_id < {high}"))
    gone = spark.createDataFrame([(3,), (50,), (51,), (900,), (3,)], "doc_id long")
    store = S.remove(store, gone)
    store = S.remove(store, gone)
    store = S.add(store, whole.filter("doc_id = 50"))  # comes back
    anew = S.create(whole.filter("doc_id not in (3, 51)"), str(tmp_path / "b"), buckets=1)
    assert contents(store) == contents(anew) == contents(S.open_store(spark, str(tmp_path / "a"))) and len(store.segments) < 6
    queries = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=5))) for i in range(20)], "query_id long, query string")
    hits = lambda s: [(r.query_id, r.chunk_id, r.rank, round(r.score, 9)) for r in S.search(s, queries, 5).orderBy("query_id", "rank").collect()]
    assert hits(store) == hits(anew)


def test_adding_writes_what_is_new(spark, tmp_path):
    whole, path = texts(spark, 2, range(4000), 120), str(tmp_path / "s")
    store = S.create(whole.filter("chunk_id % 100 > 0"), path, buckets=3)
    before, files = size(f"{path}/postings"), {f for d, _, names in os.walk(f"{path}/postings") for f in names}
    [old] = store.segments
    shutil.move(f"{path}/postings/segment={old}", f"{path}/aside")  # no old posting can be read
    store = S.add(store, whole.filter("chunk_id % 100 = 0"))
    own = {f for d, _, names in os.walk(f"{path}/postings") for f in names if f.endswith(".parquet")}
    assert own and not own & files and sum(s[2] for k, s in store.segments.items() if k != old) < 0.02 * store.segments[old][2] and before > 0
    shutil.move(f"{path}/aside", f"{path}/postings/segment={old}")
    assert contents(store) == contents(S.create(whole, str(tmp_path / "anew"), buckets=1))


@pytest.mark.parametrize(("k", "at_once"), [(1, 0), (500, 0), (5, S.AT_ONCE)])
def test_search_equals_a_full_sum(spark, tmp_path, monkeypatch, k, at_once):
    monkeypatch.setattr(S, "AT_ONCE", at_once)
    chunks = texts(spark, 4, range(1500), 60)
    store = S.create(chunks.filter("chunk_id < 900"), str(tmp_path / "s"), buckets=2)
    store = S.add(S.remove(store, spark.createDataFrame([(7,), (8,)], "doc_id long")), chunks.filter("chunk_id >= 900"))
    rows = L.counted(chunks.filter("doc_id not in (7, 8)"))
    plain = L.index_of(L.posts_of(rows), L.lengths_of(rows))
    rnd = random.Random(k)
    queries = spark.createDataFrame([(i, " ".join(rnd.choices(WORDS, k=rnd.randrange(0, 9)))) for i in range(30)] + [(77, None), (78, "unknown words"), (79, "w0 w0 w0")], "query_id long, query string")
    scope = spark.range(0, 500, 3).withColumnRenamed("id", "doc_id")
    for more in ({}, {"doc_ids": scope}):
        shown = lambda df: [(r.query_id, r.chunk_id, r.doc_id, r.rank, round(r.score, 9)) for r in df.orderBy("query_id", "rank").collect()]
        assert shown(S.search(store, queries, k, **more)) == shown(L.search(plain, queries, k, **more))
    assert shown(S.search(store, queries, k, most_queries=20, rewritten=True)) == shown(L.search(plain, queries, k, rewritten=True))


def test_blocks_that_cannot_give_a_hit_are_left_for_candidates():
    bounds = {"rare": {0: (1.5, 5), 1: (2.0, 2)}, "common": {0: (1.0, 10_000), 3: (1.6, 40)}}
    asked = {1: {"rare": 6.0, "common": 0.5}}
    assert [(t, level) for _, t, level, _ in S._plan(asked, bounds, None, 1).first] == [("rare", 1), ("rare", 0)]
    plan = S._plan(asked, bounds, {1: 5.0}, 1)
    assert {(t, level) for _, t, level, _ in plan.needed} == {("rare", 0), ("rare", 1)} and {(t, level) for _, t, level, _ in plan.others} == {("common", 0), ("common", 3)} and plan.rest[1] == (5.0, 0.8)
    assert len(S._plan(asked, bounds, {}, 1).needed) == 4


def test_scans_name_their_buckets(spark, tmp_path, capsys):
    store = S.create(texts(spark, 6, range(50)), str(tmp_path / "s"))
    store.postings(F.col("bucket").isin([3, 5])).explain("formatted")
    assert "bucket" in (plan := capsys.readouterr().out) and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket ").replace("(bucket", "bucket") or "IN (3,5)" in plan


def test_a_chunks_postings_lie_together(spark, tmp_path):
    """Postings are dealt by bucket and not sorted by term, which takes time and more disk and saves no reader anything."""
    store = S.create(texts(spark, 7, range(300)).repartition(4), str(tmp_path / "s"), buckets=1)
    [file] = [f"{d}/{f}" for d, _, names in os.walk(tmp_path / "s/postings") for f in names if f.endswith(".parquet")]
    ids = pq.ParquetFile(file).read(["chunk_id"]).column(0).to_pylist()
    assert len(ids) == store.segments[[*store.segments][0]][2] and 1 + sum(a != b for a, b in zip(ids, ids[1:])) == len(set(ids)) > 200


def test_what_no_manifest_names_does_not_count(spark, tmp_path):
    path = str(tmp_path / "s")
    store = S.create(texts(spark, 7, range(30)), path, buckets=1)
    want = contents(store)
    S.add(store, texts(spark, 8, range(30, 40)))
    os.remove(f"{path}/manifests/000000002/_SUCCESS")  # the job ended before its manifest was whole
    assert contents(S.open_store(spark, path)) == want
    with pytest.raises(ValueError):
        S.open_store(spark, str(tmp_path / "nothing"))
    none = S.create(texts(spark, 9, []), str(tmp_path / "none"))
    assert S.search(none, spark.createDataFrame([(1, "w1")], "query_id long, query string"), 3).count() == 0 and contents(S.add(none, texts(spark, 7, range(30)))) == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_common_terms_score_whole_chunks(spark, tmp_path, monkeypatch, kind):
    """Ties, copies, ids of both kinds and null texts."""
    monkeypatch.setattr(S, "AT_ONCE", 10)
    monkeypatch.setattr(S, "JOINED", 0.0)
    chunks = texts(spark, 11, range(600), 40).unionByName(spark.createDataFrame([(i, i, "w0 w1 w2") for i in range(700, 760)] + [(800, 800, None)], "chunk_id long, doc_id long, text string")).withColumn("chunk_id", F.col("chunk_id").cast(kind))
    store = S.remove(S.add(S.create(chunks.filter("doc_id < 150"), str(tmp_path / "s"), buckets=2), chunks.filter("doc_id >= 150")), spark.createDataFrame([(7,), (703,)], "doc_id long"))
    rows = L.counted(chunks.filter("doc_id not in (7, 703)"))
    plain = L.index_of(L.posts_of(rows), L.lengths_of(rows))
    queries = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=4))) for i in range(40)] + [(90, "w0 w1 w2")], "query_id long, query string")
    scope = spark.range(0, 900, 2).withColumnRenamed("id", "doc_id")
    shown = lambda df: [(r.query_id, r.chunk_id, r.doc_id, r.rank, round(r.score, 9)) for r in df.orderBy("query_id", "rank").collect()]
    want = {more: shown(L.search(plain, queries, 7, doc_ids=more and scope)) for more in (None, True)}
    whole, runs = S._scored_whole, []
    monkeypatch.setattr(S, "_scored_whole", lambda *x: runs.append(1) or whole(*x))
    for more in (None, True):
        assert shown(S.search(store, queries, 7, doc_ids=more and scope)) == want[more]
    assert shown(S.search(store, queries, 7, most_queries=10)) == want[None] and len(runs) > 3


def test_levels(spark):
    rows = spark.range(1, 5000).select("id", S.level_of(F.col("id")).alias("level")).collect() + spark.createDataFrame([(x + d,) for x in S.LEVELS[20:] for d in (-1, 0, 1)], "id long").select("id", S.level_of(F.col("id")).alias("level")).collect()
    assert all(r.level == sum(x <= r.id for x in S.LEVELS) - 1 for r in rows)


def test_words_are_counted_in_their_row(spark, tmp_path):
    chunks = texts(spark, 12, range(50)).unionByName(spark.createDataFrame([(90, 90, None), (91, 91, "  "), (92, 92, "B a b")], "chunk_id long, doc_id long, text string"))
    want = sorted((r.chunk_id, max(r.length, 0), r.term, r.tf) for r in L.counted(chunks).collect())
    rows = L.counted_words(chunks)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.chunk_id, r.length, r.term, r.tf) for r in rows.select("chunk_id", "length", F.explode_outer("words").alias("w")).select("chunk_id", "length", "w.*").collect()) == want
    twice = S.create(chunks.unionByName(chunks), str(tmp_path / "twice"))
    assert twice.n == 53 and {r.tf for r in twice.postings().filter("chunk_id = 92 and term = 'b'").collect()} == {4}
