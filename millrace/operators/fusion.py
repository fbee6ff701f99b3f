"""Rank fusion, reranking, thresholds and the retrieval trace, for batches of queries."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from millrace.functions.vectors import cosine, top_k_keyed
from millrace.operators import lexical
from millrace.operators.text import tokens
from millrace.params import DEFAULT, Params
from millrace.sources.scratch import stored


def fetch_size(k: int, params: Params = DEFAULT) -> int:
    return min(k * params.over_fetch, params.fetch_cap)


def ranked(rows: DataFrame, score: str = "score") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order))


def fuse(dense: DataFrame, bm25: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """dense: (query_id, chunk_id, score, rank[, rewrite]); bm25: the same without rewrite. Weighted reciprocal rank fusion:
    every dense rewrite adds its own share, bm25 counts once. Null chunk ids are dropped; a weight of 0 is honoured."""
    if "rewrite" not in dense.columns:
        dense = dense.withColumn("rewrite", F.lit(0))
    both = dense.select("query_id", "chunk_id", "rank", F.col("score").alias("dense_score"), F.lit(None).cast("double").alias("bm25_score"), "rewrite", F.lit(float(params.dense_weight)).alias("w"))
    both = both.unionByName(bm25.select("query_id", "chunk_id", "rank", F.lit(None).cast("double").alias("dense_score"), F.col("score").alias("bm25_score"), F.lit(None).cast("int").alias("rewrite"), F.lit(float(params.bm25_weight)).alias("w")))
    fused = both.filter("chunk_id is not null").groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("w") / (params.rrf_k + F.col("rank"))).alias("score"),
        F.coalesce(F.max("dense_score"), F.lit(0.0)).alias("dense_score"),
        F.coalesce(F.max("bm25_score"), F.lit(0.0)).alias("bm25_score"),
        F.sort_array(F.collect_set("rewrite")).alias("source_queries"),
    )
    return ranked(fused)


def rewrites(original, generated, n: int):
    """The list of queries to run: n - 1 to n + 1 of them, the original first and not repeated, padded with it."""
    others = F.filter(F.array_distinct(generated), lambda q: (q != original) & (F.trim(q) != ""))
    whole = F.slice(F.concat(F.array(original), others), 1, n + 1)
    return F.concat(whole, F.array_repeat(original, F.greatest(F.lit(n - 1) - F.size(whole), F.lit(0))))


def rerank_by_vector(candidates: DataFrame, k: int) -> DataFrame:
    """candidates: (query_id, chunk_id, query_vector, vector). rerank_score = max(0, cosine), the k best."""
    scored = candidates.withColumn("rerank_score", F.greatest(F.lit(0.0), cosine(F.col("query_vector"), F.col("vector"))))
    return ranked(scored, "rerank_score").filter(F.col("rank") <= k)


def rerank_by_tfidf(candidates: DataFrame, queries: DataFrame, k: int, params: Params = DEFAULT) -> DataFrame:
    """candidates: (query_id, chunk_id, text); queries: (query_id, query). TF-IDF cosine within each query's own texts: words of
    two letters or more, ln((1 + n) / (1 + df)) + 1, unit length."""
    texts = candidates.select("query_id", "chunk_id", "text").unionByName(queries.join(candidates.select("query_id").distinct(), "query_id").select("query_id", F.lit(None).cast("bigint").alias("chunk_id"), F.col("query").alias("text")))
    words = F.filter(tokens(F.col("text"), params), lambda w: F.length(w) > 1)
    tf = stored(texts.select("query_id", "chunk_id", F.explode(words).alias("term")).groupBy("query_id", "chunk_id", "term").agg(F.count("*").alias("tf")), "candidate-terms")
    n = texts.groupBy("query_id").agg(F.count("*").alias("n"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    weighed = tf.join(df, ["query_id", "term"]).join(n, "query_id").withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    unit = weighed.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id", "chunk_id"))))
    asked = unit.filter("chunk_id is null").select("query_id", "term", F.col("w").alias("q"))
    score = unit.filter("chunk_id is not null").join(asked, ["query_id", "term"]).groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("q")).alias("rerank_score"))
    full = candidates.select("query_id", "chunk_id").join(score, ["query_id", "chunk_id"], "left").fillna(0.0, ["rerank_score"])
    return ranked(full, "rerank_score").filter(F.col("rank") <= k)


def rerank_by_answer(candidates: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """candidates: (query_id, chunk_id, rank); answers: (query_id, response) with a JSON list of places from 0. Places out of
    range are dropped; the i-th of n gets 1 - i / n."""
    n = candidates.groupBy("query_id").agg(F.count("*").alias("n"))
    listed = F.from_json(F.regexp_extract("response", r"(?s)\[.*\]", 0), "array<int>")
    places = answers.select("query_id", F.posexplode(listed).alias("i", "place"))
    sized = places.join(n, "query_id").filter("place between 0 and n - 1")
    kept = sized.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("i")) - 1).withColumn("m", F.count("*").over(Window.partitionBy("query_id")))
    joined = kept.join(candidates.withColumn("place", F.col("rank") - 1), ["query_id", "place"])
    scored = joined.select("query_id", "chunk_id", (1 - F.col("i") / F.col("m")).alias("rerank_score"))
    return ranked(scored, "rerank_score").filter(F.col("rank") <= k)


def cut(fused: DataFrame, top: int, threshold: float, score: str = "rerank_score") -> DataFrame:
    """Rows of rank ``top`` or better whose score reaches the threshold; 0 turns the threshold off."""
    rows = fused.filter(F.col("rank") <= top)
    return rows.filter(F.coalesce(F.col(score), F.lit(0.0)) >= threshold) if threshold else rows


def hybrid(index: lexical.Index, vectors: DataFrame, queries: DataFrame, k: int, params: Params = DEFAULT) -> DataFrame:
    """vectors: (chunk_id, vector); queries: (query_id, lexical, vector), so that the two sides may ask differently: words by
    the one column, meaning by the other. Over-fetched from both, fused, the first ``k`` reranked by vectors, cut at the
    threshold: (query_id, chunk_id, rerank_score, rank)."""
    fetch = fetch_size(k, params)
    words = stored(lexical.search(index, queries.select("query_id", F.col("lexical").alias("query")), fetch, params), "lexical-hits")
    dense = stored(top_k_keyed(vectors.select("chunk_id", "vector"), queries.select("query_id", "vector"), fetch, "chunk_id"), "dense-hits")
    fused = fuse(dense, words, params).filter(F.col("rank") <= k).select("query_id", "chunk_id")
    pairs = fused.join(vectors.select("chunk_id", "vector"), "chunk_id").join(queries.select("query_id", F.col("vector").alias("query_vector")), "query_id")
    return cut(rerank_by_vector(pairs, params.rerank_k), params.rerank_k, params.rerank_threshold)


def trace(fused: DataFrame, catalog: DataFrame, threshold: float, most: int) -> DataFrame:
    """The fused list with scores over the query's best, a flag for the dense threshold, and file names (document id if unknown)."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    named = fused.join(catalog.select("doc_id", "filename"), "doc_id", "left")
    return named.withColumn("normalised", F.round(F.col("score") / best, 4)).filter(F.col("rank") <= most).select(
        "query_id", "rank", "chunk_id", F.coalesce("filename", F.col("doc_id").cast("string")).alias("file"), "normalised",
        F.round("dense_score", 4).alias("dense_score"), (F.col("dense_score") >= threshold).alias("above_threshold"), F.array_join(F.transform("source_queries", lambda x: x.cast("string")), ",").alias("source_queries"),
    )
