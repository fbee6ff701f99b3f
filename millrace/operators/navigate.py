"""Walks on the fact graph for many seeds at once: an edge table is (fact_key, subject, predicate, object)."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from millrace.params import DEFAULT
from millrace.sources.scratch import among, stored

#: Relations worth following to widen a search.
WHITELIST = ["ACQUIRED", "RELATED_TO_TECH", "USED_IN", "AFFECTS", "PART_OF", "DEPENDS_ON", "DEVELOPS", "PROVIDES_TECHNOLOGY_FOR", "COMPETES_WITH", "INTEGRATED_INTO", "POWERS", "SUPPORTS"]


def both_ways(edges: DataFrame) -> DataFrame:
    one = edges.select("fact_key", F.col("subject").alias("a"), "predicate", F.col("object").alias("b"))
    return one.unionByName(one.select("fact_key", F.col("b").alias("a"), "predicate", F.col("a").alias("b")))


def seeds(names: DataFrame, terms: DataFrame) -> DataFrame:
    """names: (name) or (name, entity_key); terms: (query_id, term). (query_id, seed): names that contain the term, or whose key
    does, in any case. Null and empty terms find nothing."""
    lower = terms.select("query_id", F.lower("term").alias("needle"))
    texts = names.select(F.col("name").alias("key"), F.lower("name").alias("text"))
    if "entity_key" in names.columns:
        texts = texts.unionByName(names.select(F.col("name").alias("key"), F.lower("entity_key").alias("text")))
    found = contained(texts, lower.select("needle"))
    return found.join(lower, "needle").select("query_id", F.col("key").alias("seed")).distinct()


def first_links(links: DataFrame, most: int) -> DataFrame:
    """Of every node, enough links for the first ``most`` paths by target and path that go on from it: its first targets, one
    more than that for the seed, which is no target, and of each the first links. Both limits apply before the shuffle."""
    to = Window.partitionBy("a", "b").orderBy(F.concat("predicate", F.lit("]")), "fact_key")
    few = links.withColumn("rn", F.row_number().over(to)).filter(F.col("rn") <= most + 4).drop("rn")
    targets = few.select("a", "b").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy("b"))).filter(F.col("rn") <= most + 1).drop("rn")
    return few.join(targets, ["a", "b"])


def k_hops(edges: DataFrame, starts: DataFrame, hops: int = DEFAULT.hops, most: int = DEFAULT.paths_per_seed) -> DataFrame:
    """starts: (query_id, seed). Undirected paths of up to ``hops`` facts, none used twice, that end elsewhere than at the seed:
    query_id, seed, target, distance, relations, path; at most ``most`` for each seed by distance, target and path.

    Shorter paths come first, so a seed that has ``most`` of them goes no further, and a hop follows only those links of a node
    that can be among the first ``most``: what is joined is bounded for each seed, however large the hubs. A seed is walked once,
    for however many queries, and only links of nodes that a hop comes from are sorted."""
    asked = stored(starts.select("query_id", "seed").distinct(), "starts")
    front = asked.select("seed").distinct().select("seed", F.col("seed").alias("target"), F.lit(0).alias("distance"), F.array().cast("array<string>").alias("relations"), F.array().cast("array<string>").alias("used"), F.col("seed").alias("path"), F.lit(0).cast("long").alias("seen"))
    found = None
    ours = Window.partitionBy("seed")
    for _ in range(hops):
        front = front.filter(F.col("seen") < most)
        links = first_links(among(both_ways(edges), front.select(F.col("target").alias("a")), "a"), most)
        grown = front.join(links, front["target"] == links["a"]).filter(~F.array_contains("used", F.col("fact_key")))
        front = grown.select(
            "seed", F.col("b").alias("target"), (F.col("distance") + 1).alias("distance"), F.concat("relations", F.array("predicate")).alias("relations"),
            F.concat("used", F.array("fact_key")).alias("used"), F.concat("path", F.lit(" -["), "predicate", F.lit("]-> "), "b").alias("path"), "seen",
        ).withColumn("seen", F.col("seen") + F.count(F.when(F.col("seed") != F.col("target"), 1)).over(ours))
        front = stored(front, "front")
        found = front if found is None else found.unionByName(front)
    order = Window.partitionBy("seed").orderBy("distance", "target", "path")
    ranked = found.filter(F.col("seed") != F.col("target")).withColumn("place", F.row_number().over(order))
    return asked.join(ranked.filter(F.col("place") <= most).drop("used", "seen"), "seed").select("query_id", "seed", "target", "distance", "relations", "path", "place")


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 3, most: int = 10) -> DataFrame:
    """pairs: (query_id, source, goal). The shortest undirected paths up to ``depth`` facts, at most ``most`` for each pair, by
    path and relations.

    Breadth first: each round keeps a node once per query, with its ``most`` first paths from the source, which are enough, for
    what follows a node is the same behind each of them. A query ends when it has reached its goal."""
    links = both_ways(edges).select("a", "predicate", "b")
    front = stored(pairs.select("query_id", "goal", F.col("source").alias("at"), F.col("source").alias("path"), F.lit("").alias("relations")).distinct(), "front")
    seen = front.select("query_id", "at").distinct()
    done, order = None, Window.partitionBy("query_id", "at").orderBy("path", "relations")
    for k in range(depth):
        grown = front.join(links, front["at"] == links["a"]).join(seen.withColumnRenamed("at", "b"), ["query_id", "b"], "left_anti")
        grown = grown.select("query_id", "goal", F.col("b").alias("at"), F.concat("path", F.lit(" > "), "b").alias("path"), F.concat_ws(",", F.nullif("relations", F.lit("")), "predicate").alias("relations"))
        grown = stored(grown.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place"), "front")
        hit = grown.filter("at = goal").select("query_id", "path", F.lit(k + 1).alias("distance"), "relations")
        done = hit if done is None else done.unionByName(hit)
        seen = seen.unionByName(grown.select("query_id", "at").distinct())
        front = grown.join(hit.select("query_id").distinct(), "query_id", "left_anti").select(*grown.columns)
    best = Window.partitionBy("query_id").orderBy("path", "relations")
    return done.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most).select("query_id", "path", "distance", "relations")


def relevant(paths: DataFrame, whitelist: list[str] = WHITELIST) -> DataFrame:
    """Paths with a listed relation; all of a query's paths if none has one."""
    flagged = paths.withColumn("listed", F.arrays_overlap("relations", F.array(*map(F.lit, whitelist))))
    return flagged.withColumn("some", F.max("listed").over(Window.partitionBy("query_id"))).filter("listed or not some").drop("listed", "some")


def needle_blocks(needles: DataFrame, most: int, most_bytes: int) -> Iterator[tuple[list[str], bool]]:
    """Distinct needles in blocks of about so many of them and so many bytes, and whether there are several blocks."""
    wanted = stored(needles.filter("needle <> ''").select("needle").distinct(), "needles")
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("needle")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // most), -(-size.bytes // most_bytes))
    for b in range(blocks):
        own = [r.needle for r in wanted.filter(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b).collect()]
        if own:
            yield own, blocks > 1


def automaton_of(needles: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for needle in needles:
        automaton.add_word(needle, needle)
    automaton.make_automaton()
    return automaton


def contained(texts: DataFrame, needles: DataFrame, most: int = 100_000, most_bytes: int = 8 << 20) -> DataFrame:
    """texts: (key, text); needles: (needle). (key, needle) where the text holds the needle, once per row of texts. Null and
    empty needles are nowhere. Needles go to the tasks in blocks of about ``most`` and ``most_bytes``, each compiled to one
    automaton and written before the next is sent."""
    spark, kind, out = texts.sparkSession, texts.schema["key"].dataType.simpleString(), []
    for own, several in needle_blocks(needles, most, most_bytes):
        shared = spark.sparkContext.broadcast(own)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automaton = automaton_of(shared.value)
            for batch in batches:
                rows = [(key, needle) for key, text in zip(batch["key"], batch["text"], strict=True) if text for needle in {hit for _, hit in automaton.iter(text)}]
                yield pd.DataFrame(rows, columns=["key", "needle"])

        part = texts.select("key", "text").mapInPandas(scan, f"key {kind}, needle string")
        if several:
            part = stored(part, "contained")
            shared.unpersist()
        out.append(part)
    return functools.reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"key {kind}, needle string")


def first_mentions(hits: DataFrame, names: DataFrame, most: int = 10, most_names: int = 100_000, most_bytes: int = 8 << 20, most_queries: int = 10_000) -> DataFrame:
    """hits: (query_id, text); names: (name). (query_id, name): the first ``most`` names in order that any text of the query
    holds. A task keeps so many names for each query while it reads texts, and passes them on when it has ``most_queries``
    queries, so neither a query of many hits nor a text of many names grows what is shuffled."""
    spark, kind = hits.sparkSession, hits.schema["query_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"query_id {kind}, name string")
    for own, several in needle_blocks(names.select(F.col("name").alias("needle")), most_names, most_bytes):
        shared = spark.sparkContext.broadcast(own)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automaton, first = automaton_of(shared.value), {}
            flat = lambda: pd.DataFrame([(q, name) for q, held in first.items() for name in held], columns=["query_id", "name"])
            for batch in batches:
                for query, text in zip(batch["query_id"], batch["text"], strict=True):
                    if text and (said := {hit for _, hit in automaton.iter(text)}):
                        first[query] = heapq.nsmallest(most, said.union(first.get(query, ())))
                if len(first) > most_queries:
                    yield flat()
                    first.clear()
            yield flat()

        part = hits.select("query_id", "text").mapInPandas(scan, f"query_id {kind}, name string")
        found = found.unionByName(stored(part, "first-names") if several else part)
    order = Window.partitionBy("query_id").orderBy("name")
    return found.distinct().withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).drop("rn")


def enriched_hits(hits: DataFrame, names: DataFrame, edges: DataFrame, most_names: int = 10, hops: int = DEFAULT.hops) -> DataFrame:
    """hits: (query_id, text, ...) with graph_context added: the entities that the texts of a query's hits name, the first
    ``most_names`` of them, are expanded together for all queries, and the lines of their paths, each once, by entity and then
    in the order of ``k_hops``, go to every hit of the query. Empty if there are none; null texts name nothing."""
    starts = stored(first_mentions(hits, names, most_names).withColumnRenamed("name", "seed"), "starts")
    once = k_hops(edges, starts, hops).groupBy("query_id", "seed", "path").agg(F.min("place").alias("place"))
    lines = once.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("seed", "place", "path"))).alias("lines"))  # at most most_names times paths_per_seed
    context = lines.select("query_id", F.array_join(F.transform("lines", lambda x: F.concat(F.lit("[Graph] "), x["path"])), "\n").alias("graph_context"))
    return hits.join(context, "query_id", "left").fillna("", ["graph_context"])


def mentions(chunks: DataFrame, names: DataFrame, most_names: int = 100_000) -> DataFrame:
    """chunks: (chunk_id, text); names: (name). (chunk_id, name) where the text holds the name."""
    found = contained(chunks.select(F.col("chunk_id").alias("key"), "text"), names.select(F.col("name").alias("needle")), most_names)
    return found.select(F.col("key").alias("chunk_id"), F.col("needle").alias("name"))


def enriched_query(queries: DataFrame, related: DataFrame, most: int = 15) -> DataFrame:
    """queries: (query_id, query); related: (query_id, name). The query with the first names in order behind it."""
    names = related.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_set("name")), 1, most).alias("names"))
    return queries.join(names, "query_id", "left").select("query_id", F.concat_ws(" ", "query", F.array_join(F.coalesce("names", F.array().cast("array<string>")), " ")).alias("query"))


def graph_context(paths: DataFrame, most: int = 40) -> DataFrame:
    """(query_id, context): the first distinct paths, a line each."""
    lines = paths.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_set("path")), 1, most).alias("lines"))
    return lines.select("query_id", F.array_join(F.transform("lines", lambda x: F.concat(F.lit("[Graph] "), x)), "\n").alias("context"))


def detail(edges: DataFrame, chunks: DataFrame, entities: DataFrame, most: int = 10) -> DataFrame:
    """chunks: (chunk_id, doc_id, text); entities: (name). Per entity: its neighbours, the first chunks that mention it, and
    their documents, each once; ``most`` bounds the chunks that a page shows."""
    links = both_ways(edges).select(F.col("a").alias("name"), F.col("b").alias("neighbour")).distinct()
    around = links.join(entities, "name", "left_semi").groupBy("name").agg(F.sort_array(F.collect_set("neighbour")).alias("neighbours"))
    said = mentions(chunks, entities).withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy("chunk_id"))).filter(F.col("rn") <= most)
    of = said.join(chunks.select("chunk_id", "doc_id").distinct(), "chunk_id")
    found = of.groupBy("name").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunks"), F.sort_array(F.collect_set("doc_id")).alias("documents"))
    return entities.distinct().join(around, "name", "left").join(found, "name", "left")


def navigate(edges: DataFrame, entities: DataFrame, relations: DataFrame, mode: str = "hybrid", first: int = 5) -> tuple[DataFrame, DataFrame]:
    """entities: (query_id, name, rank), relations: (query_id, subject, object, rank), as two index searches found them. Gives
    the paths (query_id, seed, target, path, place) and the related names (query_id, name).

    The first entities are expanded by two hops unless the mode is global, the first relations' subjects by one. Related are
    all entities that were found, the ends of the entities' paths, and both ends of the first relations."""
    columns = ["query_id", "seed", "target", "path", "place"]
    head = relations.filter(F.col("rank") <= first)
    paths = k_hops(edges, head.select("query_id", F.col("subject").alias("seed")), 1).select(*columns)
    named = [entities.select("query_id", "name"), head.select("query_id", F.col("subject").alias("name")), head.select("query_id", F.col("object").alias("name"))]
    if mode in ("local", "hybrid"):
        near = stored(k_hops(edges, entities.filter(F.col("rank") <= first).select("query_id", F.col("name").alias("seed"))).select(*columns), "paths")
        paths = near.unionByName(paths)
        named += [near.select("query_id", F.col("seed").alias("name")), near.select("query_id", F.col("target").alias("name"))]
    return paths, functools.reduce(DataFrame.unionByName, named).filter("name <> ''").distinct()


def with_fallback(records: DataFrame, queries: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """queries: (query_id, query); starts: (query_id, seed). When there are no entity records to search, the queries for plain
    retrieval: (query_id, query, path), seeds first widened to their related names where a query has any. With records the
    queries come back as they are."""
    if not records.isEmpty():
        return queries.select("query_id", "query", F.lit("entity_index").alias("path"))
    paths = relevant(k_hops(edges, starts).dropDuplicates(["query_id", "path"]))
    found = paths.select("query_id", F.col("target").alias("name")).unionByName(starts.select("query_id", F.col("seed").alias("name"))).distinct()
    seeded = starts.select("query_id", F.lit(True).alias("seeded")).distinct()
    return enriched_query(queries, found).join(seeded, "query_id", "left").select("query_id", F.trim("query").alias("query"), F.when(F.col("seeded"), "fallback_graph").otherwise("fallback_plain").alias("path"))
