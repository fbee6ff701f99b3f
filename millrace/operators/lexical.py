"""BM25 as stored tables: postings by bucket of the term, chunk lengths, term statistics and totals; searches for whole batches of
queries. An index is built by one pass over the texts; adding and removing chunks changes its tables without reading texts again."""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from millrace.operators.text import tokens
from millrace.params import DEFAULT, Params

BUCKETS = 64


@dataclass
class Index:
    """postings: (bucket, term, chunk_id, doc_id, length, tf); chunks: (chunk_id, doc_id, length), empty ones included; terms:
    (bucket, term, df, idf); stats: one row (n, avg_length)."""

    postings: DataFrame
    chunks: DataFrame
    terms: DataFrame
    stats: DataFrame


def bucket(term="term", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def counted(chunks: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """chunks: (chunk_id, doc_id, text). (chunk_id, doc_id, length, term, tf); a chunk without words has one row of a null term."""
    words = chunks.select("chunk_id", "doc_id", tokens(F.col("text"), params).alias("t"))
    exploded = words.select("chunk_id", "doc_id", F.coalesce(F.size("t"), F.lit(0)).alias("length"), F.explode_outer("t").alias("term"))
    return exploded.groupBy("chunk_id", "doc_id", "length", "term").agg(F.count("*").alias("tf"))


def counted_words(chunks: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """chunks: (chunk_id, doc_id, text). (chunk_id, doc_id, length, words): each row's words and their counts, from the places
    where a word begins in the sorted list. Nothing is shuffled or held but a row."""
    rows = chunks.select("chunk_id", "doc_id", F.sort_array(tokens(F.col("text"), params)).alias("t")).withColumn("n", F.coalesce(F.size("t"), F.lit(0)))
    starts = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == 1) | (F.get("t", i - 1) != F.get("t", i - 2)))
    rows = rows.select("chunk_id", "doc_id", F.greatest(F.col("n"), F.lit(0)).alias("length"), "t", F.when(F.col("n") > 0, starts).alias("s"))
    ends = F.concat(F.slice("s", 2, F.size("s")), F.array(F.col("length") + 1))
    return rows.select("chunk_id", "doc_id", "length", F.zip_with("s", ends, lambda a, b: F.struct(F.get("t", a - 1).alias("term"), (b - a).cast("bigint").alias("tf"))).alias("words"))


def postings(chunks: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return posts_of(counted(chunks, params))


def posts_of(rows: DataFrame) -> DataFrame:
    return rows.filter("term is not null").select(bucket().alias("bucket"), "term", "chunk_id", "doc_id", "length", "tf")


def lengths_of(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", "doc_id", F.when(F.col("length") < 0, 0).otherwise(F.col("length")).alias("length")).distinct()


def stats_of(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))


def term_stats(posts: DataFrame, stats: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(bucket, term, df, idf): ln((n - df + .5) / (df + .5)), negative ones replaced by epsilon times the vocabulary's mean idf."""
    df = posts.groupBy("bucket", "term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # stats is one row
    raw = df.withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))
    floored = F.when(F.col("raw") < 0, params.epsilon * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("bucket", "term", "df", floored.alias("idf"))


def index_of(posts: DataFrame, lengths: DataFrame, params: Params = DEFAULT) -> Index:
    stats = stats_of(lengths)
    return Index(posts, lengths, term_stats(posts, stats, params), stats)


def save_index(chunks: DataFrame, path: str, params: Params = DEFAULT) -> Index:
    """The index of chunks (chunk_id, doc_id, text), written below path. Texts are read once; a frequent term's postings are
    dealt out by chunk as well, so no task has them all."""
    spark = chunks.sparkSession
    rows = counted(chunks, params)
    rows.write.mode("overwrite").parquet(f"{path}/counts")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/counts")
    return write_index(posts_of(rows), lengths_of(rows), path, params)


def write_index(posts: DataFrame, lengths: DataFrame, path: str, params: Params = DEFAULT) -> Index:
    spark = posts.sparkSession
    posts.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/chunks")
    stored = spark.read.schema(posts.schema).parquet(f"{path}/postings")
    stats = stats_of(spark.read.schema(lengths.schema).parquet(f"{path}/chunks"))
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    term_stats(stored, spark.read.schema(stats.schema).parquet(f"{path}/stats"), params).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> Index:
    chunks = spark.read.parquet(f"{path}/chunks")
    kind = {c: chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "doc_id")}  # tables without rows have no files that tell
    posts = spark.read.schema(f"term string, chunk_id {kind['chunk_id']}, doc_id {kind['doc_id']}, length int, tf bigint, bucket int").parquet(f"{path}/postings")
    terms = spark.read.schema("term string, df bigint, idf double, bucket int").parquet(f"{path}/terms")
    return Index(posts.select("bucket", "term", "chunk_id", "doc_id", "length", "tf"), chunks, terms.select("bucket", "term", "df", "idf"), spark.read.parquet(f"{path}/stats"))


def index_errors(index: Index, n_chunks: int) -> DataFrame:
    """Rows of reasons for which an index can't be used: no posting, another number of chunks, or terms of over 200 characters."""
    found = index.postings.agg(F.count("*").alias("postings"), F.sum((F.length("term") > 200).cast("int")).alias("long_terms")).crossJoin(index.chunks.agg(F.count("*").alias("chunks")))
    reasons = F.array_compact(F.array(F.when(F.col("postings") == 0, F.lit("empty")), F.when(F.col("chunks") != n_chunks, F.lit("chunks differ")), F.when(F.col("long_terms") > 0, F.lit("long terms"))))
    return found.select(F.explode(reasons).alias("reason"))


def added(index: Index, new: DataFrame, params: Params = DEFAULT) -> Index:
    """The index with those chunks of new (chunk_id, doc_id, text) whose ids it lacks; only their texts are read."""
    rows = counted(new.join(index.chunks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "doc_id", "text"), params)
    return index_of(index.postings.unionByName(posts_of(rows)), index.chunks.unionByName(lengths_of(rows)), params)


def removed(index: Index, doc_ids: DataFrame, params: Params = DEFAULT) -> Index:
    """The index without the chunks of these documents (doc_id)."""
    gone = doc_ids.select("doc_id").distinct()
    return index_of(index.postings.join(gone, "doc_id", "left_anti").select(*index.postings.columns), index.chunks.join(gone, "doc_id", "left_anti").select(*index.chunks.columns), params)


def query_terms(queries: DataFrame, params: Params = DEFAULT, rewritten: bool = False) -> DataFrame:
    """queries: (query_id, query). (query_id, bucket, term, times): by white space if the query was rewritten, else as the index."""
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "") if rewritten else tokens(F.col("query"), params)
    return queries.select("query_id", F.explode(words).alias("term")).groupBy("query_id", bucket().alias("bucket"), "term").agg(F.count("*").alias("times"))


def search(index: Index, queries: DataFrame, k: int, params: Params = DEFAULT, doc_ids: DataFrame | None = None, rewritten: bool = False) -> DataFrame:
    """(query_id, chunk_id, doc_id, score, rank): positive BM25 scores, the k best of each query, ties by chunk_id. Only the
    buckets of the queries' terms are read. doc_ids, if given, restricts the chunks by a semi join of any size."""
    posts = index.postings
    if doc_ids is not None:
        posts = posts.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = query_terms(queries, params, rewritten).join(index.terms, ["bucket", "term"])
    hits = posts.join(asked, ["bucket", "term"]).crossJoin(F.broadcast(index.stats))
    k1, b = params.k1, params.b
    norm = k1 * (1 - b + b * F.col("length") / F.col("avg_length"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    scored = hits.groupBy("query_id", "chunk_id", "doc_id").agg(F.sum(part).alias("score")).filter(F.col("score") > 0)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def normalised(hits: DataFrame) -> DataFrame:
    """Scores divided by the best of their query."""
    return hits.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
