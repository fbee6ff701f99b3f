import math
from zlib import crc32

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import pytest

from millrace.functions import cells as C
from millrace.functions import vectors as V
from millrace.operators import fusion as R
from millrace.operators import lexical as L
from millrace.params import Params

CORPUS = [(1, 1, "python is a programming language"), (2, 1, "java is a programming language too"), (3, 2, "machine learning uses data"), (4, 2, "deep learning is machine learning"), (5, 3, "databases store data"), (6, 4, "clouds run distributed systems")]


def corpus(spark):
    return spark.createDataFrame(CORPUS, "chunk_id long, doc_id long, text string")


def find(spark, query, **more):
    rows = L.counted(corpus(spark))
    return L.search(L.index_of(L.posts_of(rows), L.lengths_of(rows)), spark.createDataFrame([(1, query)], "query_id long, query string"), 5, **more).orderBy("rank").collect()


def contents(index):
    return {name: sorted((tuple(r) for r in getattr(index, name).collect()), key=str) for name in ("postings", "chunks", "terms", "stats")}


def test_a_stored_index_grows_and_shrinks_like_one_built_anew(spark, tmp_path):
    rows = spark.createDataFrame([*CORPUS, (7, 5, ""), (8, 5, "the of and")], "chunk_id long, doc_id long, text string")
    whole = L.save_index(rows, str(tmp_path / "whole"))
    part = L.save_index(rows.filter("chunk_id in (1, 2, 7)"), str(tmp_path / "part"))
    assert whole.chunks.count() == 8 and L.index_errors(whole, 8).count() == 0 and [r.reason for r in L.index_errors(whole, 9).collect()] == ["chunks differ"]
    assert [r.reason for r in L.index_errors(L.save_index(rows.limit(0), str(tmp_path / "none")), 0).collect()] == ["empty"]
    changed = rows.filter("chunk_id > 1").union(spark.createDataFrame([(1, 1, "other words that are not read")], rows.schema))
    assert contents(L.added(part, changed)) == contents(whole)
    left = L.removed(whole, spark.createDataFrame([(1,), (4,)], "doc_id long"))
    assert contents(left) == contents(L.save_index(rows.filter("doc_id not in (1, 4)"), str(tmp_path / "left")))


def test_bm25_against_plain_python(spark):
    stop = set(Params().stop_words)
    texts = {c: [w for w in t.split() if w not in stop] for c, _, t in CORPUS}
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    df = {w: sum(w in t for t in texts.values()) for t in texts.values() for w in t}
    raw = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    query = ["learning", "data", "learning", "absent"]
    want = {c: sum(idf.get(q, 0) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for q in query) for c, t in texts.items()}
    got = {r.chunk_id: r.score for r in find(spark, "learning data learning absent")}
    assert got.keys() == {c for c, s in want.items() if s > 0} and all(abs(got[c] - want[c]) < 1e-9 for c in got)


def test_filters(spark):
    ids = spark.createDataFrame([(1,)], "doc_id long")
    assert {r.doc_id for r in find(spark, "language learning", doc_ids=ids)} == {1}
    assert find(spark, "quantum entanglement") == []
    many = spark.range(600).select(F.col("id").alias("doc_id"))
    assert len(find(spark, "learning", doc_ids=many)) == 2


def test_fusion_prefers_what_both_find(spark):
    kind = "query_id long, chunk_id long, score double, rank int"
    dense = spark.createDataFrame([(1, 10, 0.9, 1), (1, 20, 0.7, 2)], kind)
    bm25 = spark.createDataFrame([(1, 20, 0.8, 1), (1, 30, 0.5, 2), (1, None, 0.1, 3)], kind)
    rows = R.fuse(dense, bm25, Params(dense_weight=0.5, bm25_weight=0.5)).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == [20, 10, 30] and abs(rows[0].score - (0.5 / 62 + 0.5 / 61)) < 1e-12
    assert rows[1].bm25_score == 0 and R.fuse(dense, bm25, Params(dense_weight=0.0)).filter("chunk_id = 10").first().score == 0


def test_top_k_is_exact(spark):
    import numpy as np

    rnd = np.random.default_rng(4)
    v = rnd.normal(size=(300, 8)).round(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, vector array<double>")
    queries = df.filter("id < 7").select(F.col("id").alias("query_id"), "vector")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for most in (4096, 3):
        got = V.top_k(df, queries, 4, most).orderBy("query_id", "rank").collect()
        assert [r.id for r in got] == np.argsort(-(unit[:7] @ unit.T), axis=1)[:, :4].ravel().tolist()


def test_rerank_and_encoder_cache(spark):
    texts = spark.createDataFrame([(1, 1, "Paris is the capital city of France"), (1, 2, "bananas are yellow"), (1, 3, "Berlin is a capital")], "query_id long, chunk_id long, text string")
    asked = spark.createDataFrame([(1, "What is the capital of France?")], "query_id long, query string")
    assert R.rerank_by_tfidf(texts, asked, 1).first().chunk_id == 1
    cache = spark.createDataFrame([], "key string, vector array<float>")
    first, cache = V.encode_with_cache(texts.select(F.col("chunk_id").alias("id"), "text"), cache, V.hashed_encoder(16))
    assert first.count() == 3 and V.encode_with_cache(texts.select(F.col("chunk_id").alias("id"), "text"), cache, V.hashed_encoder(16))[1].count() == 3


def test_words_whose_signs_cancel_out_are_encoded(spark, tmp_path):
    """e1_encode gives every text with words length one, as its SQL does."""
    import duckdb

    from millrace.plans import retrieval as Q

    words = {}
    for i in range(2000):
        h = crc32(f"w{i}".encode())
        words.setdefault((h % 64, h >> 31), f"w{i}")
    pairs = [f"{words[d, 0]} {words[d, 1]}" for d in range(64)]
    rows = [*enumerate([*pairs, " ".join(pairs), None, "", " \n", "\u00a0", "\x0b", "a b"])]
    made = V.hashed_encoder()(F.col("text"))
    assert {tuple(r[0]) for r in spark.createDataFrame(rows[:64], "doc_id long, text string").select(made).collect()} == {(0.0,) * 64}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.e1_encode(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(Q.SQL["e1_encode"]).fetchall())
    assert sum(r.norm for r in got) == 64 + 1 + 3


def test_rewrites_are_bounded_and_start_with_the_original(spark):
    rows = [("q", ["a", "q", "b", "c", "d"]), ("q", []), ("q", ["a", "a", " "])]
    got = [list(r.x) for r in spark.createDataFrame(rows, "o string, g array<string>").coalesce(1).select(R.rewrites(F.col("o"), F.col("g"), 3).alias("x")).collect()]
    assert got == [["q", "a", "b", "c"], ["q", "q"], ["q", "a"]]


def test_inverted_file_loses_no_hit(spark, tmp_path):
    from millrace.plans.retrieval import e3_inverted_file

    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(rnd.normal(size=(900, 24)))]
    vectors = spark.createDataFrame([*rows, (2000, None, 0)], "vec_id long, embedding array<float>, label int")
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    v = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    own = v.filter("id % 100 = 0").select((F.col("id") / 100).cast("long").alias("query_id"), "vector")
    want = {(r.query_id, r.rank, r.id) for r in V.top_k(v, own, 10).collect()}
    assert {(r.query_id, r.rank, r.chunk_id) for r in e3_inverted_file(spark, str(tmp_path)).collect()} == want and len(want) == 90


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_probed_cells(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    own = rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    cells = C.build(rows, str(tmp_path / "cells"))
    hits = lambda df: {(r.query_id, r.id) for r in df.collect()}
    want = hits(V.top_k(rows, own, 10))
    assert hits(C.search(cells, own, 10)) == want and cells.seen["vectors"] < 0.1 * cells.seen["queries"] * rows.count()
    cells.seen.clear()
    got = hits(C.search(cells, own, 10, C.probes_for(cells, 10)))
    read = {x: cells.seen[x] / cells.seen["queries"] / rows.count() for x in ("codes", "vectors")}
    print(sf_dir, len(got & want) / len(want), read)
    assert len(got & want) >= 0.9 * len(want) and read["vectors"] < 1 / 3


def test_cells_of_odd_vectors(spark, tmp_path):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(50, [0.0, 0.0]), (51, [0.0, 2.0]), (52, None), (53, [-1.0, 1e-9])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    own = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "query_id long, vector array<double>")
    cells = C.build(df, str(tmp_path / "cells"), 3)
    for k in (3, 100):
        assert sorted(map(tuple, C.search(cells, own, k).select("query_id", "id", "score", "rank").collect())) == sorted(map(tuple, V.top_k(df, own, k).select("query_id", "id", "score", "rank").collect()))
    assert C.search(cells, own, 3, 1).filter("query_id = 1").orderBy("rank").first().id == 0 and C.probes_for(cells, 5) >= 1
    none = C.build(df.limit(0), str(tmp_path / "none"))
    assert C.search(none, own, 3).count() == 0 and C.search(cells, own.limit(0), 3).count() == 0


def test_ties_go_to_smaller_ids_however_rows_are_batched(spark):
    rows = [(i, [1.0, float(i % 2)]) for i in range(60)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(parts)
        got = V.top_k(df, spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 0.0])], "query_id long, vector array<double>"), 5).orderBy("query_id", "rank").collect()
        assert [r.id for r in got] == [1, 3, 5, 7, 9, 0, 2, 4, 6, 8]


def test_equal_vectors_are_compared_once(spark):
    """Of each distinct vector the k first keys are enough, and queries of one vector are asked once."""
    rows = [(f"k{i:04d}", [float(i % 3), 1.0]) for i in range(3000)] + [(None, [1.0, 1.0]), ("null", None)]
    records = spark.createDataFrame(rows, "name string, vector array<float>").repartition(5)
    kept = V.distinct_vectors(records, 4, "name")
    assert sorted(r.name for r in kept.collect()) == [f"k{i:04d}" for i in range(12)]
    queries = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(40)], "query_id long, vector array<float>")
    found = {}
    for r in V.top_k_keyed(records, queries, 6, "name").orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.name, round(r.score, 9)))
    for i in range(40):
        q = np.array([i % 2, 1.0])
        cosine = lambda v: round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 9)  # noqa: B023, E731
        assert found[i] == [(n, s) for s, n in sorted((-cosine(np.array(v)), n) for n, v in rows if n and v)[:6] for s in [-s]]
    small = [*V.first_of_equals(2, "name", 3)(iter([pd.DataFrame({"name": ["b", "c"], "vector": [np.ones(2)] * 2}), pd.DataFrame({"name": ["a"], "vector": [np.ones(2)]})]))]
    assert [n for part in small for n in part["name"]] == ["a", "b"]


def test_a_search_compares_each_vector_once(spark, monkeypatch):
    """By vectors or by texts, and in a hybrid search; the hits are those of comparing every record."""
    rows = [(i, i % 5, f"part p{i % 7} w{i % 11}") for i in range(2000)]
    texts = spark.createDataFrame(rows, "chunk_id long, doc_id long, text string").repartition(4)
    vectors = texts.select("chunk_id", V.hashed_encoder()(F.col("text")).alias("vector"))
    queries = spark.createDataFrame([(i, f"part p{i % 9} w{i % 4}") for i in range(30)], "query_id long, lexical string").withColumn("vector", V.hashed_encoder()(F.col("lexical")))
    shown = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    want = shown(V.top_k(vectors.withColumnRenamed("chunk_id", "id"), queries, 40).withColumnRenamed("id", "chunk_id"))
    compared, own = [], V.top_k
    monkeypatch.setattr(V, "top_k", lambda v, q, *more: compared.append((v.count(), q.count())) or own(v, q, *more))
    assert shown(V.top_k_keyed(vectors, queries, 40, "chunk_id")) == want and shown(V.top_k_keyed(texts.select("chunk_id", "text"), queries, 40, "chunk_id")) == want
    rows = L.counted(texts)
    assert R.hybrid(L.index_of(L.posts_of(rows), L.lengths_of(rows)), vectors, queries, 20).count() > 0
    assert len(compared) == 3 and all(v <= 77 and q <= 30 for v, q in compared)


def test_a_scan_holds_few_scores_at_once(monkeypatch):
    """Blocks get smaller as queries get more, and outdone candidates go on the way; the short list stays whole."""
    from types import SimpleNamespace

    rnd = np.random.default_rng(1)
    q, rows, centres = C.unit(rnd.normal(size=(50, 8))), rnd.normal(size=(3000, 8)), C.unit(rnd.normal(size=(2, 8)))
    [coded] = C.coded(SimpleNamespace(value=centres))(iter([pd.DataFrame({"id": np.arange(3000), "vector": list(rows)})]))
    shared = SimpleNamespace(value=(np.arange(50), q, centres, {c: np.arange(50) for c in (0, 1)}))
    batches = [coded.iloc[i : i + 1000][["id", "code", "scale", "error", "cell"]] for i in range(0, 3000, 1000)]
    sizes, own = [], C.best_of
    monkeypatch.setattr(C, "best_of", lambda scores, ids, k: sizes.append(scores.size) or own(scores, ids, k))
    monkeypatch.setattr(C, "SCORES", 5000)
    monkeypatch.setattr(C, "HELD", 2000)
    [found] = C.scan(shared, 5)(iter(batches))
    assert max(sizes) <= 5000 + 50 * 5
    exact = q @ C.unit(rows).T
    have = set(zip(found["query_id"], found["id"], strict=True))
    assert all((i, j) in have for i in range(50) for j in np.argsort(-exact[i])[:5]) and len(have) == len(found) < 20 * 50
