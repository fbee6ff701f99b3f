from zlib import crc32

import numpy as np

from millrace.functions import vectors as V
from millrace.operators import evidence as E
from millrace.operators import navigate as N

ITEM = '{"evidence_type": "entity", "entity_type": " Organization ", "entity_name": " 阿里巴巴 "}'
FACT = '{"evidence_type": "FACT", "subject_type": "Person", "subject_name": "A", "predicate": "works for", "object_type": "Org", "object_name": "B", "confidence": 0.9}'


def responses(spark):
    quoted = '"' + ITEM.replace('"', '\\"') + '"'
    bodies = [f"[{ITEM}]", None, "[]", ITEM, '"' + f"[{ITEM}]".replace('"', '\\"') + '"', f"[{ITEM}, {quoted}]", "42", "null", '"{broken"', f"[{ITEM}, {FACT}, {ITEM.replace('entity', 'Entity', 1)}]"]
    rows = [(str(i), "{}" if b is None else f'Here: {{"evidence_items": {b}}} done') for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "chunk_hash string, response string")


def test_responses_of_all_shapes(spark):
    got = {r.chunk_hash: r["count"] for r in E.parse_items(responses(spark)).groupBy("chunk_hash").count().collect()}
    assert [got.get(str(i), 0) for i in range(10)] == [1, 0, 0, 1, 1, 2, 0, 0, 0, 3 - 0]


def test_keys_and_defaults(spark):
    rows = E.typed(E.parse_items(responses(spark))).filter("chunk_hash = '9'").collect()
    fact = next(r for r in rows if r.evidence_type == "FACT")
    assert fact.predicate == "WORKS_FOR" and fact.subject_key == "person:A" and fact.confidence == 0.9
    entity = next(r for r in rows if r.evidence_type == "ENTITY")
    assert entity.entity_key == "organization:阿里巴巴" and entity.confidence == 0.5


def test_incremental_counts_equal_a_rebuild(spark):
    rows = E.typed(E.parse_items(responses(spark)))
    after, keys = E.deactivate(rows, spark.createDataFrame([("9",), ("0",)], "chunk_hash string"))
    applied = {tuple(r) for r in E.apply_counts(E.support(rows), E.support(after), keys).collect()}
    assert applied == {tuple(r) for r in E.support(after).collect()}
    assert E.inconsistent(after, E.support(after)).count() == 0 and E.inconsistent(after, E.support(rows)).count() == 2
    assert E.deactivate(after, spark.createDataFrame([("9",)], "chunk_hash string"))[1].count() == 0


def test_hops_paths_and_whitelist(spark):
    rows = [("a", "LOCATED_IN", "b"), ("b", "PART_OF", "c"), ("c", "PART_OF", "d"), ("a", "KNOWS", "a2")]
    edges = spark.createDataFrame([("|".join(r), *r) for r in rows], "fact_key string, subject string, predicate string, object string")
    seeds = N.seeds(edges.selectExpr("subject as name").distinct(), spark.createDataFrame([(1, "A")], "query_id long, term string"))
    paths = N.k_hops(edges, seeds, 2)
    assert {(r.target, r.distance) for r in paths.collect()} == {("b", 1), ("a2", 1), ("c", 2)}
    assert [r.target for r in N.relevant(paths).collect()] == ["c"]
    assert N.relevant(paths.filter("distance = 1")).count() == 2
    short = N.shortest_paths(edges, spark.createDataFrame([(1, "d", "a"), (2, "a", "zz")], "query_id long, source string, goal string"))
    assert [(r.query_id, r.path, r.distance) for r in short.collect()] == [(1, "d > c > b > a", 3)]


def test_mentions(spark):
    chunks = spark.createDataFrame([(1, "Alpha and beta"), (2, None), (3, "betabeta")], "chunk_id long, text string")
    names = spark.createDataFrame([("beta",), ("Alpha",), (None,), ("gamma",)], "name string")
    for most in (100, 1):
        assert {tuple(r) for r in N.mentions(chunks, names, most).collect()} == {(1, "Alpha"), (1, "beta"), (3, "beta")}


def all_paths(edges, seed, hops):
    """Every undirected path by recursion: (target, distance, path)."""
    links = [(f, a, p, b) for f, s, p, o in edges for a, b in ((s, o), (o, s))]
    found, front = [], [(seed, (), seed)]
    for k in range(hops):
        front = [(b, (*used, f), f"{path} -[{p}]-> {b}") for at, used, path in front for f, a, p, b in links if a == at and f not in used]
        found += [(at, k + 1, path) for at, _, path in front if at != seed]
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def test_hops_and_shortest_paths_against_recursion(spark):
    import random

    rnd = random.Random(5)
    edges = [(f"f{i}", f"n{rnd.randrange(12)}", rnd.choice(["P", "PA", "Q"]), f"n{rnd.randrange(12)}") for i in range(45)]
    df = spark.createDataFrame(edges, "fact_key string, subject string, predicate string, object string")
    starts = spark.createDataFrame([(i, f"n{i}") for i in range(12)], "query_id long, seed string")
    for most in (50, 3):
        got = [(r.query_id, r.target, r.distance, r.path) for r in N.k_hops(df, starts, 2, most).collect()]
        assert sorted(got) == sorted((i, *x) for i in range(12) for x in all_paths(edges, f"n{i}", 2)[:most])
    pairs = [(100 * i + j, f"n{i}", f"n{j}") for i in range(12) for j in range(12) if i != j]
    got = {}
    for r in N.shortest_paths(df, spark.createDataFrame(pairs, "query_id long, source string, goal string"), most=4).orderBy("path", "relations").collect():
        got.setdefault(r.query_id, []).append((r.path, r.distance))
    for key, a, b in pairs:
        to = [(d, p) for t, d, p in all_paths(edges, a, 3) if t == b]
        least = min((d for d, _ in to), default=None)
        nodes = [" > ".join(x.split("]-> ")[-1] if i else x for i, x in enumerate(p.split(" -["))) for d, p in to if d == least]
        assert got.get(key, []) == [(p, least) for p in sorted(nodes)[:4]], key


def test_a_hub_is_not_expanded(spark):
    hub = spark.range(100_000).selectExpr("concat('f', id) as fact_key", "'hub' as subject", "'P' as predicate", "concat('x', lpad(id, 6, '0')) as object")
    edges = hub.unionByName(spark.createDataFrame([("s1", "seed", "P", "hub"), ("s2", "seed", "P", "mid")], "fact_key string, subject string, predicate string, object string"))
    assert N.first_links(N.both_ways(edges), 50).filter("a = 'hub'").count() == 51
    rows = N.k_hops(edges, spark.createDataFrame([(1, "seed")], "query_id long, seed string")).orderBy("distance", "target").collect()
    assert len(rows) == 50 and [r.target for r in rows[:4]] == ["hub", "mid", "x000000", "x000001"]
    short = N.shortest_paths(edges, spark.createDataFrame([(1, "mid", "x000007")], "query_id long, source string, goal string")).collect()
    assert [r.path for r in short] == ["mid > seed > hub > x000007"]


def test_seeds_and_fallback(spark):
    names = spark.createDataFrame([("Alpha Beta",), ("beta",), (None,)], "name string")
    terms = spark.createDataFrame([(1, "BETA"), (2, "alpha"), (3, ""), (4, None)], "query_id long, term string")
    assert {tuple(r) for r in N.seeds(names, terms).collect()} == {(1, "Alpha Beta"), (1, "beta"), (2, "Alpha Beta")}
    keyed = spark.createDataFrame([("Alpha Beta", "beta:Alpha Beta"), ("gamma", "Person:gamma")], "name string, entity_key string")
    assert sorted(tuple(r) for r in N.seeds(keyed, spark.createDataFrame([(1, "beta"), (2, "PERSON")], "query_id long, term string")).collect()) == [(1, "Alpha Beta"), (2, "gamma")]
    edges = spark.createDataFrame([("f", "a", "PART_OF", "b"), ("g", "a", "KNOWS", "c")], "fact_key string, subject string, predicate string, object string")
    queries = spark.createDataFrame([(1, "what of a"), (2, "plain")], "query_id long, query string")
    starts = spark.createDataFrame([(1, "a")], "query_id long, seed string")
    none = spark.createDataFrame([], "id long")
    assert {tuple(r) for r in N.with_fallback(none, queries, edges, starts).collect()} == {(1, "what of a a b", "fallback_graph"), (2, "plain", "fallback_plain")}
    assert {r.path for r in N.with_fallback(spark.range(1), queries, edges, starts).collect()} == {"entity_index"}


def word_vector(text):
    v = np.zeros(64)
    for word in text.lower().split():
        v[crc32(word.encode()) % 64] += 1 if crc32(word.encode()) & 0x8000_0000 else -1
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32).astype(float)


def test_index_searches_against_plain_python(spark):
    from millrace.plans import graph as G
    from millrace.plans import navigated as P

    small = "/root/testdata/sf0.001"
    evidence = G.evidence(spark, small)
    records = {"entity": [(r.entity_key, r.text) for r in E.entity_records(evidence).collect()], "relation": [(r.text, r.text) for r in E.relation_records(evidence).collect()]}
    want = []
    for key in [r.p_partkey for r in spark.read.parquet(f"{small}/part.parquet").collect() if r.p_partkey % 100 == 0]:
        q = word_vector(f"P{key}: Part P{key}")
        for kind, rows in records.items():
            scores = [(-round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 9), name) for name, text in rows if (v := word_vector(text)).any()]
            want += [(key, kind, name, place + 1, -round(s, 6)) for place, (s, name) in enumerate(sorted(scores)[:10])]
    assert sorted((r.query_id, r.kind, r.record, r.rank, r.score) for r in P.i1_index_search(spark, small).collect()) == sorted(want) and len({w[1] for w in want}) == 2


def test_numbers_of_keys_are_dense_and_in_order(spark):
    keys = [f"k{i * 7919 % 1000}" for i in range(1000)] + ["é", "", "Z"]
    df = spark.createDataFrame([(k, i) for i, k in enumerate([*keys, *keys[:50], None])], "name string, id long").repartition(5)
    got = {r.id: r.name for r in V.numbered(df, "name").collect()}
    assert [got[i] for i in range(len(got))] == sorted(set(keys), key=str.encode)


def test_walk_from_both_indexes(spark):
    rows = [("a", "OF", "b"), ("b", "OF", "c"), ("c", "OF", "d"), ("x", "OF", "y"), ("y", "OF", "z")]
    edges = spark.createDataFrame([("|".join(r), *r) for r in rows], "fact_key string, subject string, predicate string, object string")
    near = spark.createDataFrame([(1, "a", 1), (1, "far", 6), (1, "d", 7)], "query_id long, name string, rank int")
    links = spark.createDataFrame([(1, "x", "y", 1), (1, "y", "z", 6)], "query_id long, subject string, object string, rank int")
    paths, names = N.navigate(edges, near, links)
    assert sorted((r.seed, r.target) for r in paths.collect()) == [("a", "b"), ("a", "c"), ("x", "y")]
    assert {r.name for r in names.collect()} == {"a", "b", "c", "far", "d", "x", "y"}
    paths, names = N.navigate(edges, near, links, "global")
    assert [r.path for r in paths.collect()] == ["x -[OF]-> y"] and {r.name for r in names.collect()} == {"a", "far", "d", "x", "y"}


def test_hits_get_the_context_of_their_own_entities(spark):
    import random

    rnd = random.Random(3)
    names = [f"N{i:02d}x" for i in range(40)]
    facts = sorted({(rnd.choice(names), rnd.choice(["P", "Q"]), rnd.choice(names)) for _ in range(60)})
    edges = [("|".join(f), *f) for f in facts]
    hits = [(q, 100 * q + i, " and ".join(rnd.choices(names, k=rnd.randrange(0, 6))) or None) for q in range(10) for i in range(4)]
    df = spark.createDataFrame(edges, "fact_key string, subject string, predicate string, object string")
    asked = spark.createDataFrame(hits, "query_id long, chunk_id long, text string").repartition(3)
    named = spark.createDataFrame([(n,) for n in [*names, None, "", "nowhere"]], "name string")
    want = {}
    for q in range(10):
        own = sorted({n for n in names for k, _, t in hits if k == q and t and n in t})[:10]
        want[q] = "\n".join(dict.fromkeys(f"[Graph] {p}" for n in own for _, _, p in all_paths(edges, n, 2)[:50]))
    for most_names in (100_000, 7):
        first = N.first_mentions(asked, named, 10, most_names, most_queries=2)
        assert {(r.query_id, r["name"]) for r in first.collect()} == {(q, n) for q in range(10) for n in sorted({n for n in names for k, _, t in hits if k == q and t and n in t})[:10]}
    got = N.enriched_hits(asked, named, df).collect()
    assert len(got) == len(hits) and all(r.graph_context == want[r.query_id] for r in got) and any(want.values())


def test_hits_that_name_a_hub(spark):
    hub = spark.range(100_000).selectExpr("concat('f', id) as fact_key", "'hub' as subject", "'P' as predicate", "concat('x', lpad(id, 6, '0')) as object")
    hits = spark.createDataFrame([(1, "the hub"), (1, None), (2, "nothing")], "query_id long, text string")
    rows = {(r.query_id, r.text): r.graph_context for r in N.enriched_hits(hits, spark.createDataFrame([("hub",)], "name string"), hub).collect()}
    assert rows[1, "the hub"] == rows[1, None] == "\n".join(f"[Graph] hub -[P]-> x{i:06d}" for i in range(50)) and rows[2, "nothing"] == ""


def test_long_needles_go_in_blocks_of_bytes(spark):
    texts = spark.createDataFrame([(i, f"{'ab' * 500}{i} tail") for i in range(20)], "key long, text string")
    needles = spark.createDataFrame([(f"{'ab' * 500}{i}",) for i in range(20)], "needle string")
    assert N.contained(texts, needles, most_bytes=3000).count() == N.contained(texts, needles).count() == 20 + 10  # 1 is in 1 and 10 to 19


def test_a_seed_of_many_queries_is_walked_once(spark, monkeypatch):
    """Only links of nodes that a hop comes from are sorted, and what a hop makes doesn't grow with the queries of a seed."""
    rows = [("a", "OF", "b"), ("b", "OF", "c"), ("b", "IN", "d"), *((f"far{i}", "OF", f"off{i}") for i in range(500))]
    edges = spark.createDataFrame([("|".join(r), *r) for r in rows], "fact_key string, subject string, predicate string, object string")
    links, fronts, first, stored = [], [], N.first_links, N.stored
    monkeypatch.setattr(N, "first_links", lambda df, most: links.append(df.count()) or first(df, most))

    def counted(df, name):
        made = stored(df, name)
        fronts.extend([made.count()] * (name == "front"))
        return made

    monkeypatch.setattr(N, "stored", counted)
    starts = spark.createDataFrame([(i, "a") for i in range(200)] + [(3, None), (4, "a"), (5, "nowhere")], "query_id long, seed string")
    got = sorted((r.query_id, r.place, r.path) for r in N.k_hops(edges, starts).collect())
    want = ["a -[OF]-> b", "a -[OF]-> b -[OF]-> c", "a -[OF]-> b -[IN]-> d"]
    assert got == [(i, n + 1, path) for i in range(200) for n, path in enumerate(want)]
    assert links == [1, 3] and fronts == [1, 2]


def test_names_of_a_fact_are_those_of_its_entities(spark):
    """An entity of one name is not looked up; of several the least is shown, of none the key."""
    def made(rows):
        columns = "active boolean, evidence_type string, entity_key string, entity_name string, entity_type string, subject_key string, subject_name string, subject_type string, predicate string, object_key string, object_name string, object_type string"
        return spark.createDataFrame([(x[0], "FACT", None, None, None, x[1], x[2], "T", "P", x[3], x[4], "T") if len(x) == 5 else (x[0], "ENTITY", x[1], x[2], "T", *[None] * 7) for x in rows], columns)

    once = made([(True, "t:a", "a", "t:b", "b"), (True, "t:a", "a", "t:b", "b"), (True, "t:b", "b", "t:c", None), (False, "t:z", "z", "t:b", "b")])
    got = E.relation_records(once)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.text for r in got.collect()) == ["a P b", "b P t:c"]
    several = made([(True, "t:a", "a", "t:b", "b"), (True, "t:a", "A", "t:b", None), (True, "t:c", None, "t:a", "a"), (True, "t:c", "c"), (True, None, "x", "t:b", "b")])
    rows = [(r.subject, r.object, r.text) for r in E.relation_records(several).collect()]
    assert sorted(rows, key=str) == [("A", "b", "A P b"), ("c", "A", "c P A"), (None, "b", "P b")]


def test_evidence_of_parts_that_are_not_listed(spark, tmp_path):
    """Every lineitem is evidence, as in the SQL, whether or not the table of parts has its part."""
    import os

    import duckdb

    from millrace.plans import graph as G

    con = duckdb.connect()
    for name in ("lineitem", "orders", "part"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
        if name != "part":
            os.symlink(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").filter("p_partkey % 2 = 0").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(map(tuple, G.g6_support(spark, str(tmp_path)).collect())) == sorted(con.execute(G.SQL["g6_support"]).fetchall())
