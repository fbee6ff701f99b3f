import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from millrace.llm.prefix_trie import SQL, DoubleArray, dense, prefix_trie, query, rebuilt, sequences

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(own: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    """own: the turns of each conversation, which are taken as they are."""
    members: dict[tuple, list[int]] = {}
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in ids if len(own[c]) == len(node))))
        rows.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(len(x) == len(node) + 1 for x in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def rebuilt_turns(own: dict[int, list]) -> dict[int, list]:
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def found(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def made(seed: int, n: int, most: int, kinds: int) -> dict[int, list]:
    rnd = random.Random(seed)
    texts = ["", "a", "é", "some text", "字"][:kinds]
    return {c: [(rnd.choice(["user", ""]), rnd.choice(texts)) for _ in range(rnd.randrange(0, most))] for c in rnd.sample(range(10 * n), n)}


@pytest.mark.parametrize(("seed", "shard"), [(1, 1), (2, 3), (3, 20), (4, 1 << 17), (5, 7)])
def test_tries_of_any_shards_against_brute_force(spark, seed, shard):
    own = made(seed, 60, 9, 2 + seed % 4)
    own |= {1000 + k: own[min(own)] for k in range(20)} | {2000: [("user", "a")] * 40, 2001: [("user", "a")] * 39 + [("user", "b")], 2002: [("user", "a")] * 30}
    own = {c: t for c, t in own.items() if t}
    rows = [(c, k, role, text, 5) for c, turns in own.items() for k, (role, text) in enumerate(turns)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, seq int")
    assert found(prefix_trie(sequences(df), shard)) == brute_force(own)


def test_rebuilt_conversations(spark):
    own = {c: t for c, t in made(9, 80, 14, 5).items() if t}
    rows = [(c, None if k == 0 else k, role or None, text or None) for c, turns in own.items() for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame([*rows, (None, 1, "user", "nobody's")], "conv_id long, turn int, role string, text string")
    assert found(prefix_trie(rebuilt(sequences(df)), 16)) == brute_force(rebuilt_turns(own))
    assert prefix_trie(rebuilt(sequences(df.limit(0)))).count() == 0


def test_a_conversation_without_turns_ends_at_the_root(spark):
    df = spark.createDataFrame([(8, 0, "user", "x")], "conv_id long, turn int, role string, text string")  # its three first turns are those of conversation 5
    assert zlib.crc32(b"8") % 9 > 0
    assert found(prefix_trie(rebuilt(sequences(df)))) == [(8, 0, None, 1, 0, 1, 0, hashlib.sha256(b"8").hexdigest())]


def test_repeated_rows_and_equal_turn_numbers(spark):
    df = spark.createDataFrame([(1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, "user", "x")], "conv_id long, turn int, role string, text string")
    x = ("user", "x")
    assert found(prefix_trie(sequences(df))) == brute_force({1: [x, x], 2: [x]})


def test_long_conversations_and_hot_ones(spark):
    own = {c: [("user", f"t{k}") for k in range(3000)] + [("user", str(c % 3))] for c in range(6)} | {c: [("user", "hello")] for c in range(100, 3000)}
    rows = [(c, k, *t) for c, turns in own.items() for k, t in enumerate(turns)]
    out = {(r.depth, r.conv_id): r for r in prefix_trie(sequences(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")), 1000).collect()}
    assert len(out) == 1 + 3000 + 3 + 1
    root, hot = out[0, 0], out[1, 100]
    assert (root.n_convs, root.n_children, root.n_leaves) == (2906, 2, 4) and out[2999, 0].n_leaves == 3
    assert root.saved_tokens == 2899 * 5 + 5 * sum(len(f"t{k}") for k in range(3000)) + 3
    assert hot.ends_sha256 == hashlib.sha256(",".join(map(str, range(100, 3000))).encode()).hexdigest()


def test_double_arrays():
    rnd = np.random.default_rng(5)
    trie, arcs = DoubleArray(4), {}
    level = np.zeros(1, np.int64)
    for _ in range(6):
        pairs = sorted({(int(p), int(t)) for p in level for t in rnd.integers(0, 50, rnd.integers(1, 5))})
        parents, turns = np.array(pairs).T
        trie.add(parents, turns)
        cells = trie.step(parents, turns)
        assert len(set(cells.tolist())) == len(cells) and not {*cells.tolist()} & {*arcs.values()} and 0 not in cells
        arcs |= dict(zip(pairs, cells.tolist(), strict=True))
        level = cells
    assert all(trie.step(np.array([p]), np.array([t]))[0] == c for (p, t), c in arcs.items())
    assert set(dense(np.array([[5, 1], [5, 2], [5, 1]], np.uint64), np.array([0, 1, 1])).tolist()) == {0, 1}


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = con.sql(f"select {', '.join(COLUMNS)} from ({SQL})").fetchall()
    assert found(query(spark, sf_dir)) == sorted(want, key=str)
