"""BM25 as a log of segments that grows and shrinks by small writes, and searches that read what can matter.

A store is a folder. Postings, chunk lengths and term counts lie by segment; postings and counts also by bucket of the term.
Adding chunks writes a segment of them and nothing else; removing documents writes which chunks of which segments are gone and
what that takes from the term counts. A version is a manifest, written last: the segments that count, their sizes, and how many
terms have which document frequency, which is all that idf needs. Segments of about one size are merged once there are several.

A term's postings are in blocks by level of frequency (1, 2, 3, 4, 6, 8 ...), and with a block its count, largest frequency and
smallest length are kept; so the most that a posting of it can add to a score is known before it is read.

With a chunk its words and their counts are kept as well. Queries whose terms are common read these rows in place of postings:
a task has all of a chunk, scores it for every query, and only the k best of each query leave it."""

from __future__ import annotations

import functools
import math
import uuid
from collections import defaultdict
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from millrace.functions.vectors import best_of_chunks, sparse_weights
from millrace.operators.lexical import bucket, counted, counted_words, query_terms
from millrace.params import DEFAULT, Params
from millrace.sources.scratch import children, stored

LEVELS = sorted({x << k for x in (2, 3) for k in range(28)} | {1})
#: Postings of a bucket of a store's first segment, about, and buckets at most, if their number isn't given.
BUCKET_ROWS, MOST_BUCKETS = 1 << 20, 1024
#: Segments of one size that are merged, how much larger the next size is, and postings of a file.
MERGED, TIMES, FILE_ROWS = 4, 8, 2_000_000
#: Candidates that are sent to the tasks at most; more are joined by shuffle.
SENT = 1 << 18
#: Postings of a block of queries that are read at once, for finding out what to leave would cost more.
AT_ONCE = 4_000_000
#: Beyond AT_ONCE, the share of a store's postings that a block of queries joins at most; with more, chunks are scored whole.
JOINED = 0.125
POSTINGS = "term string, chunk_id {chunk}, doc_id {doc}, length int, tf bigint, level int, segment string, bucket int"
TERMS = "term string, level int, df bigint, max_tf bigint, min_length int, segment string, bucket int"
GONE = "chunk_id {chunk}, doc_id {doc}, length int, segment string"
WORDS = "chunk_id {chunk}, doc_id {doc}, length int, words array<struct<term:string,tf:bigint>>, segment string"


@dataclass
class Store:
    """A version of a store: segments (name: chunks, length, postings), chunks and their length in all, and terms by their df."""

    spark: SparkSession
    path: str
    version: int
    segments: dict[str, tuple[int, int, int]]
    removals: list[str]
    n: int
    length: int
    frequencies: dict[int, int]
    kinds: dict[str, str]

    @property
    def buckets(self) -> int:
        return int(self.kinds["buckets"])

    def table(self, name: str, schema: str, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(schema.format(**self.kinds)).option("basePath", f"{self.path}/{name}")
        return reader.parquet(*(f"{self.path}/{name}/{x}" for x in folders)) if folders else self.spark.createDataFrame([], schema.format(**self.kinds))

    def of_segments(self, name: str, schema: str) -> DataFrame:
        return self.table(name, schema, [f"segment={x}" for x in self.segments])

    def gone(self, name: str, schema: str) -> DataFrame:
        """What removals took from segments that are still there."""
        rows = self.table(f"removed-{name}", schema.replace(", segment string, bucket int", ", bucket int, segment string"), [f"removal={x}" for x in self.removals])
        return rows.filter(F.col("segment").isin([*self.segments]))

    def postings(self, where=None) -> DataFrame:
        """Postings that count. where: a condition on their columns, for which segments and buckets are pruned."""
        rows = self.of_segments("postings", POSTINGS)
        rows = rows if where is None else rows.filter(where)
        return rows.join(self.gone("chunks", GONE).select("segment", "chunk_id"), ["segment", "chunk_id"], "left_anti") if self.removals else rows

    def chunks(self) -> DataFrame:
        return self.words().select("chunk_id", "doc_id", "length", "segment")

    def words(self) -> DataFrame:
        """Chunks with their words."""
        rows = self.of_segments("chunks", WORDS)
        return rows.join(self.gone("chunks", GONE).select("segment", "chunk_id"), ["segment", "chunk_id"], "left_anti") if self.removals else rows

    def counts(self, where=None) -> DataFrame:
        """Rows of blocks; what was removed counts against df and leaves the bounds as they are."""
        rows = self.of_segments("terms", TERMS).select("bucket", "term", "level", "df", "max_tf", "min_length")
        if self.removals:
            rows = rows.unionByName(self.gone("terms", TERMS).select("bucket", "term", "level", (-F.col("df")).alias("df"), "max_tf", "min_length"))
        return rows if where is None else rows.filter(where)

    def idf(self, params: Params = DEFAULT):
        """A function of df. Of the whole vocabulary only the frequencies' counts are needed."""
        raw = lambda df: math.log((self.n - df + 0.5) / (df + 0.5))
        words = sum(self.frequencies.values())
        mean = sum(n * raw(df) for df, n in self.frequencies.items()) / words if words else 0.0
        return lambda df: raw(df) if raw(df) >= 0 else params.epsilon * mean

    def terms(self, params: Params = DEFAULT) -> DataFrame:
        """(term, df, idf) of the vocabulary."""
        idf = self.idf(params)
        known = self.spark.createDataFrame([(df, float(idf(df))) for df in self.frequencies] or [(0, 0.0)], "df bigint, idf double")  # a row per frequency
        return self.counts().groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0").join(F.broadcast(known), "df").select("term", "df", "idf")


def level_of(tf):
    """The place of the largest of LEVELS that tf reaches: two for each power of two."""
    power = F.length(F.bin(tf)) - 1
    return F.when(tf < 2, 0).otherwise(F.least(F.lit(len(LEVELS) - 1), 2 * power - 1 + F.when(tf >= 3 * F.pow(F.lit(2.0), power - 1), 1).otherwise(0)))


def _commit(spark: SparkSession, path: str, segments: dict, removals: list[str], frequencies: dict[int, int], kinds: dict[str, str], gone: tuple[int, int]) -> Store:
    n, length = sum(s[0] for s in segments.values()) - gone[0], sum(s[1] for s in segments.values()) - gone[1]
    version = 1 + max(map(int, children(spark, f"{path}/manifests")), default=0)  # also beyond one that a dead job left
    rows = [("segment", name, *sizes) for name, sizes in segments.items()] + [("removal", x, 0, 0, 0) for x in removals] + [("df", str(df), c, 0, 0) for df, c in frequencies.items() if c]
    rows += [("kind", f"{k} {v}", 0, 0, 0) for k, v in kinds.items()] + [("total", "", n, length, 0)]
    spark.createDataFrame(rows, "what string, name string, a bigint, b bigint, c bigint").coalesce(1).write.parquet(f"{path}/manifests/{version:09d}")
    return Store(spark, path, version, segments, removals, n, length, {df: c for df, c in frequencies.items() if c}, kinds)


def open_store(spark: SparkSession, path: str, version: int | None = None) -> Store:
    """The latest version whose manifest was written whole, or a given one. Folders that no manifest names don't count."""
    whole = [x for x in children(spark, f"{path}/manifests") if "_SUCCESS" in children(spark, f"{path}/manifests/{x}")]
    if not whole:
        raise ValueError(f"no index in {path}")
    name = f"{version:09d}" if version else max(whole)
    by: dict[str, list] = defaultdict(list)
    for r in spark.read.parquet(f"{path}/manifests/{name}").collect():
        by[r.what].append(r)
    total = by["total"][0]
    return Store(spark, path, int(name), {r["name"]: (r.a, r.b, r.c) for r in by["segment"]}, [r["name"] for r in by["removal"]], total.a, total.b, {int(r["name"]): r.a for r in by["df"]}, dict(r["name"].split(" ", 1) for r in by["kind"]))


def _posts(chunks: DataFrame, *more: str) -> DataFrame:
    return chunks.select(F.explode("words").alias("w"), "chunk_id", "doc_id", "length", *more).select("w.term", "chunk_id", "doc_id", "length", "w.tf", level_of(F.col("w.tf")).cast("int").alias("level"), *more)


def _write_segment(spark: SparkSession, path: str, chunks: DataFrame, buckets: int | None) -> tuple[str, tuple[int, int, int], int]:
    """chunks: (chunk_id, doc_id, length, words). Gives the segment's name, sizes and number of buckets. However many buckets
    there are, a task sorts about the rows of a few, by bucket alone: a scan reads all of a bucket and joins, so an order of terms
    would not save it anything, and a chunk's postings that lie together compress better than those of a term."""
    name = uuid.uuid4().hex[:12]
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks/segment={name}")
    chunks = spark.read.schema(chunks.schema).parquet(f"{path}/chunks/segment={name}")
    sums = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"), F.coalesce(F.sum(F.coalesce(F.size("words"), F.lit(0))), F.lit(0)).alias("size")).first()
    size = sums["size"]
    buckets = buckets or min(MOST_BUCKETS, max(8, size // BUCKET_ROWS))
    files = max(1, -(-size // FILE_ROWS))
    rows = _posts(chunks).select(bucket("term", buckets).alias("bucket"), "term", "chunk_id", "doc_id", "length", "tf", "level")
    parts = 2 * buckets * -(-files // buckets)
    dealt = rows.repartition(parts, "bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(-(-files // buckets)))).sortWithinPartitions("bucket")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings/segment={name}")
    blocks = _posts(chunks).groupBy("term", "level").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))
    blocks = blocks.select(bucket("term", buckets).alias("bucket"), "term", "level", "df", "max_tf", "min_length")  # once a block, not once a posting
    blocks.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(-(-files // buckets)))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms/segment={name}")
    return name, (sums.n, sums.length, size), buckets


def _counted(chunks: DataFrame, params: Params) -> DataFrame:
    """(chunk_id, doc_id, length, words). Words are counted in their row; only rows that repeat an id are brought together."""
    if chunks.groupBy("chunk_id", "doc_id").count().filter("count > 1").isEmpty():
        return counted_words(chunks, params)
    rows = counted(chunks, params).withColumn("length", F.greatest(F.col("length"), F.lit(0)))
    return rows.groupBy("chunk_id", "doc_id", "length").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("words"))


def create(chunks: DataFrame, path: str, params: Params = DEFAULT, buckets: int | None = None) -> Store:
    """A store of chunks (chunk_id, doc_id, text), whose ids are distinct; texts are read once. The number of buckets stays, so
    give it where the first chunks are few of those to come."""
    spark = chunks.sparkSession
    name, sizes, buckets = _write_segment(spark, path, _counted(chunks, params), buckets)
    kinds = {"buckets": str(buckets), "chunk": chunks.schema["chunk_id"].dataType.simpleString(), "doc": chunks.schema["doc_id"].dataType.simpleString()}
    dfs = {r.df: r.n for r in spark.read.schema(TERMS).parquet(f"{path}/terms/segment={name}").groupBy("bucket", "term").agg(F.sum("df").alias("df")).groupBy("df").agg(F.count("*").alias("n")).collect()}  # a row per frequency
    return _commit(spark, path, {name: sizes}, [], dfs, kinds, (0, 0))


def _moved(store: Store, change: DataFrame) -> dict[int, int]:
    """How many terms have which df after a change (bucket, term, df) of some. Only changed terms' counts are looked up."""
    change = stored(change, "changed-terms")
    buckets = [r.bucket for r in change.select("bucket").distinct().collect()]
    before = store.counts(F.col("bucket").isin(buckets)).join(change.select("bucket", "term"), ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("df").alias("before"))
    moves = change.join(before, ["bucket", "term"], "left").select(F.coalesce("before", F.lit(0)).alias("a"), (F.coalesce("before", F.lit(0)) + F.col("df")).alias("b"))
    out = defaultdict(int, store.frequencies)
    for r in moves.groupBy("a", "b").agg(F.count("*").alias("n")).collect():  # pairs of frequencies
        out[r.a] -= r.n
        out[r.b] += r.n
    out.pop(0, None)
    return dict(out)


def add(store: Store, new: DataFrame, params: Params = DEFAULT, merging: bool = True) -> Store:
    """The version with those chunks of new (chunk_id, doc_id, text) whose ids it lacks. Old postings are neither read nor
    written, unless there are segments to merge afterwards."""
    spark, path = store.spark, store.path
    unseen = new.join(store.chunks().select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "doc_id", "text").dropDuplicates(["chunk_id"])
    unseen = stored(counted_words(unseen, params), "unseen")
    if unseen.isEmpty():
        return store
    name, sizes, _ = _write_segment(spark, path, unseen, store.buckets)
    change = spark.read.schema(TERMS).option("basePath", f"{path}/terms").parquet(f"{path}/terms/segment={name}").groupBy("bucket", "term").agg(F.sum("df").alias("df"))
    gone = _gone(store)
    made = _commit(spark, path, store.segments | {name: sizes}, store.removals, _moved(store, change), store.kinds, gone)
    return merged(made) if merging else made


def _gone(store: Store) -> tuple[int, int]:
    return sum(s[0] for s in store.segments.values()) - store.n, sum(s[1] for s in store.segments.values()) - store.length


def remove(store: Store, doc_ids: DataFrame) -> Store:
    """The version without the chunks of these documents (doc_id). Of the words of chunks only theirs are looked at; what is
    written is a row for each chunk that goes, and its terms' counts."""
    ids = doc_ids.select("doc_id").distinct()
    rows = stored(store.words().join(ids, "doc_id", "left_semi").select("chunk_id", "doc_id", "length", "words", "segment"), "removed")
    chunks = rows.drop("words")
    sums = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    if not sums.n:
        return store
    name = uuid.uuid4().hex[:12]
    posts = _posts(rows, "segment").withColumn("bucket", bucket("term", store.buckets))
    terms = stored(posts.groupBy("bucket", "term", "level", "segment").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length")), "removed-terms")
    terms.select("term", "level", "df", "max_tf", "min_length", "bucket", "segment").write.parquet(f"{store.path}/removed-terms/removal={name}")
    chunks.write.parquet(f"{store.path}/removed-chunks/removal={name}")
    dfs = _moved(store, terms.groupBy("bucket", "term").agg((-F.sum("df")).alias("df")))
    was = _gone(store)
    return _commit(store.spark, store.path, store.segments, [*store.removals, name], dfs, store.kinds, (was[0] + sums.n, was[1] + sums.length))


def merged(store: Store) -> Store:
    """The version in which segments of one size, if there are MERGED of them, are one; chunks that are gone stay behind."""
    tiers: dict[int, list[str]] = defaultdict(list)
    for name, (_, _, size) in store.segments.items():
        tiers[int(math.log(max(size, 1), TIMES))].append(name)
    own = next((names for _, names in sorted(tiers.items()) if len(names) >= MERGED), None)
    if own is None:
        return store
    rest = {k: v for k, v in store.segments.items() if k not in own}
    part = Store(store.spark, store.path, store.version, {k: store.segments[k] for k in own}, store.removals, 0, 0, {}, store.kinds)
    name, sizes, _ = _write_segment(store.spark, store.path, part.words().select("chunk_id", "doc_id", "length", "words"), store.buckets)
    segments = rest | {name: sizes}
    gone = sum(s[0] for s in segments.values()) - store.n, sum(s[1] for s in segments.values()) - store.length
    made = _commit(store.spark, store.path, segments, store.removals if gone[0] else [], store.frequencies, store.kinds, gone)
    return merged(made)


def impact(tf, length, average: float, params: Params = DEFAULT):
    return tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * length / average))


@dataclass
class Plan:
    """Of a block of queries, what to read: weights (query, term), and for each query which blocks of its terms can give a hit
    by themselves, and how much the others can add at most."""

    first: list[tuple]
    needed: list[tuple]
    others: list[tuple]
    rest: dict


def _plan(asked: dict, bounds: dict, theta: dict | None, k: int) -> Plan:
    """asked: query -> {term: weight}; bounds: term -> {level: (most that a posting gives, postings)}; theta: query -> a score
    that the k-th hit reaches. Without theta only ``first`` is made: of each query the blocks of highest bounds that have some
    postings more than k."""
    plan = Plan([], [], [], {})
    for query, weights in asked.items():
        blocks = sorted(((w * b, n, t, level) for t, w in weights.items() for level, (b, n) in bounds[t].items()), key=lambda x: (-x[0], x[2], x[3]))
        if theta is None:
            taken = 0
            for _, n, t, level in blocks:
                if taken >= 4 * k:
                    break
                plan.first.append((query, t, level, weights[t]))
                taken += n
            continue
        least, idle = theta.get(query, -math.inf), defaultdict(float)
        while blocks and sum(idle.values()) - idle[blocks[-1][2]] + max(idle[blocks[-1][2]], blocks[-1][0]) < least:
            bound, _, t, level = blocks.pop()
            idle[t] = max(idle[t], bound)
            plan.others.append((query, t, level, weights[t]))
        plan.needed += [(query, t, level, weights[t]) for _, _, t, level in blocks]
        plan.rest[query] = (least, sum(idle.values()))
    return plan


def _first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _scored_whole(chunks: DataFrame, asked: dict, average: float, k: int, params: Params, schema: str) -> DataFrame:
    """(query_id, chunk_id, doc_id, score): of chunks (chunk_id, doc_id, length, words), each task's k best of every query."""
    spark, terms = chunks.sparkSession, sorted({t for weights in asked.values() for t in weights})
    number = {t: i for i, t in enumerate(terms)}
    shared = spark.sparkContext.broadcast(([*asked], sparse_weights(len(terms), [(q, number[t], w) for q, weights in enumerate(asked.values()) for t, w in weights.items()])))
    known = F.broadcast(spark.createDataFrame([*number.items()], "term string, no int"))
    rows = chunks.withColumn("at", F.monotonically_increasing_id()).select("at", "chunk_id", "doc_id", "length", F.explode("words").alias("w"))
    rows = rows.select("at", "chunk_id", "doc_id", "length", F.col("w.term").alias("term"), F.col("w.tf").alias("tf")).join(known, "term")  # in their order, so a chunk's words stay together
    rows = rows.select("at", "chunk_id", "doc_id", "no", impact(F.col("tf"), F.col("length"), average, params).alias("part"))
    return rows.mapInArrow(best_of_chunks(shared, k, schema.rsplit(",", 1)[0]), schema.rsplit(",", 1)[0])


def search(store: Store, queries: DataFrame, k: int, params: Params = DEFAULT, doc_ids: DataFrame | None = None, rewritten: bool = False, most_queries: int = 2048) -> DataFrame:
    """(query_id, chunk_id, doc_id, score, rank): positive BM25 scores, the k best of each query, ties by chunk_id. doc_ids, if
    given, restricts the chunks by a semi join of any size.

    Queries are asked in blocks, whose terms' buckets are literals in every scan. The blocks of postings with the highest
    bounds are read first and give a score that the k-th hit reaches. Blocks that together can't reach it are then read only for
    chunks that another block has, and only for those that could still reach it. Where that would join more than JOINED of all
    postings, tasks score whole chunks instead, and what is shuffled is k rows of a query from each."""
    spark, schema = store.spark, f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {store.kinds['chunk']}, doc_id {store.kinds['doc']}, score double, rank int"
    total, out = queries.count(), []
    idf, average = store.idf(params), store.length / store.n if store.n else 1.0
    blocks = max(1, -(-total // most_queries))
    for b in range(blocks if store.n and store.length else 0):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        words = query_terms(own, params, rewritten).withColumn("bucket", bucket("term", store.buckets)).collect()  # of a block of queries
        if not words:
            continue
        buckets, wanted = sorted({r.bucket for r in words}), spark.createDataFrame([(t,) for t in sorted({r.term for r in words})], "term string")
        here = F.col("bucket").isin(buckets)
        bounds: dict[str, dict] = defaultdict(dict)
        for r in store.counts(here).join(F.broadcast(wanted), "term", "left_semi").groupBy("term", "level").agg(F.sum("df").alias("df"), F.max("max_tf").alias("tf"), F.min("min_length").alias("length")).collect():
            bounds[r.term][r.level] = (impact(r.tf, r.length, average, params), r.df)
        weight = {t: idf(sum(n for _, n in levels.values())) for t, levels in bounds.items() if sum(n for _, n in levels.values()) > 0}
        asked: dict = defaultdict(dict)
        for r in words:
            if r.term in weight:
                asked[r.query_id][r.term] = r.times * weight[r.term]
        if not asked:
            continue
        kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, term string, level int, w double"
        scope = None if doc_ids is None else stored(doc_ids.select("doc_id").distinct(), "scope")

        def scored(rows: list[tuple], kind=kind, scope=scope) -> DataFrame:
            """(query_id, chunk_id, doc_id, part) of the postings of these blocks."""
            sent = spark.createDataFrame(rows, kind)
            posts = store.postings(F.col("bucket").isin(sorted({where[r[1]] for r in rows})))
            posts = posts if scope is None else posts.join(scope, "doc_id", "left_semi")
            return posts.join(F.broadcast(sent), ["term", "level"]).select("query_id", "chunk_id", "doc_id", (F.col("w") * impact(F.col("tf"), F.col("length"), average, params)).alias("part"))

        where = {r.term: r.bucket for r in words}
        summed = lambda rows: rows.groupBy("query_id", "chunk_id", "doc_id").agg(F.sum("part").alias("score"))
        theta: dict = {}
        if sum(n for t in weight for _, n in bounds[t].values()) > AT_ONCE and all(w >= 0 for terms in asked.values() for w in terms.values()):
            order = Window.partitionBy("query_id").orderBy(F.desc("score"))
            sure = summed(scored(_plan(asked, bounds, None, k).first)).withColumn("n", F.row_number().over(order)).filter(F.col("n") == k)
            theta = {r.query_id: r.score - 1e-6 for r in sure.collect()}  # a row per query of the block
        plan = _plan(asked, bounds, theta, k)
        many = sum(bounds[t][level][1] for _, t, level, _ in plan.needed)
        if many > max(AT_ONCE, JOINED * sum(s[2] for s in store.segments.values())):
            rows = store.words() if scope is None else store.words().join(scope, "doc_id", "left_semi")
            found = _scored_whole(rows, asked, average, k, params, schema)
            out.append(stored(_first(found, k), "bm25") if blocks > 1 else _first(found, k))
            continue
        found = summed(scored(plan.needed)) if plan.needed else spark.createDataFrame([], schema).drop("rank")
        if plan.others and plan.needed:
            rest = spark.createDataFrame([(q, float(a) if a > -math.inf else -1e300, float(s)) for q, (a, s) in plan.rest.items()], kind.split(",")[0] + ", least double, more double")
            found = stored(found.join(F.broadcast(rest), "query_id").filter(F.col("score") + F.col("more") >= F.col("least")).drop("least", "more"), "candidates")
            few = found.count() <= SENT
            ids = found.select("query_id", "chunk_id")
            more = scored(plan.others).join(F.broadcast(ids) if few else ids, ["query_id", "chunk_id"])
            found = summed(found.withColumnRenamed("score", "part").unionByName(more.select("query_id", "chunk_id", "doc_id", "part")))
        hits = _first(found.filter("score > 0"), k)
        out.append(stored(hits, "bm25") if blocks > 1 else hits)
    return functools.reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)
