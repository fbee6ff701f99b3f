import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from millrace.llm import signature_search
from millrace.llm.hashing import word_hashes
from millrace.llm.scratch import plain
from millrace.llm.signature_search import SPACE, SQL, Asked, bounds_of, index_of, keyed, query, search, signatures, terms_of

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, k=10):
    counts = [(key, Counter(words(text))) for key, text in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for (key, c), n in zip(counts, sizes, strict=True):
            score = 0
            for t in words(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (100 - 75 + (75 * n * n_docs) // total)))
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item_id, r + 1, None if none else key, -score) for r, (score, none, key) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    rows = keyed(spark.createDataFrame([(key, text, 1) for key, text in docs], "doc_id long, text string, score int").repartition(3))
    asked = spark.createDataFrame([(key, text, 1) for key, text in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in search(index_of(rows), rows, asked, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def made(seed, n, words_in, vocabulary):
    rnd = random.Random(seed)
    kinds = ["alpha", "BETA", "Ünd", "ünd", "字", "x9", "9", "é"] + [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(len(kinds))]
    text = lambda most: rnd.choice([" ", ", ", "\n", "_", "\x7f"]).join(rnd.choices(kinds, weights, k=rnd.randrange(0, most)))
    return [(i, text(words_in)) for i in range(n)], [(i, text(20)) for i in range(12)]


@pytest.mark.parametrize(("seed", "n", "most", "vocabulary"), [(1, 300, 60, 300), (2, 80, 900, 40), (3, 12, 5, 3)])
def test_search_against_brute_force(spark, seed, n, most, vocabulary):
    docs, items = made(seed, n, most, vocabulary)
    assert found(spark, docs, items) == brute_force(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " -- "), (4, "one two"), (4, "one two"), (4, "one"), (None, "one two"), (5, "a " * 100_000 + "one"), (6, "ONE TWO two")]
    items = [(1, "one Two two"), (2, None), (3, ""), (4, "missing"), (None, "a"), (1, "TWO")]
    assert found(spark, docs, items) == brute_force(docs, items)
    assert found(spark, docs, items, 2) == brute_force(docs, items, 2)
    assert found(spark, [(1, "x")], []) == [] and found(spark, [], items) == [] and found(spark, [(1, None)], items) == []


def test_every_way_gives_the_same_rows(spark, monkeypatch):
    """Several blocks of items, and joined instead of sent keys."""
    docs, items = made(8, 200, 80, 100)
    monkeypatch.setattr(signature_search, "ITEM_BYTES", 200)
    monkeypatch.setattr(signature_search, "SENT_KEYS", 0)
    monkeypatch.setattr(signature_search, "VOCABULARY", 10)
    assert found(spark, docs, items) == brute_force(docs, items)


def blocks(docs):
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["key", "text"])
    return [r for b in signatures(iter([batch])) for r in b.to_pylist() if r["bits"]]


def test_bounds_are_never_below_the_score_and_leave_most_documents_out():
    docs, items = made(5, 3000, 120, 3000)
    counts = {k: Counter(map(str.encode, words(t))) for k, t in docs}
    df = Counter(t for c in counts.values() for t in c)
    asked = Asked([terms_of(t) for _, t in items], df, len(docs), sum(sum(c.values()) for c in counts.values()))
    hashes = word_hashes(pa.array(asked.names, pa.binary()), SPACE)[0]
    exact, bound = {}, {}
    for b in blocks(docs):
        keys, sizes = np.frombuffer(b["keys"], "<i8"), np.frombuffer(b["sizes"], "<i8")
        ub = bounds_of(asked, hashes, b["bits"], sizes, np.frombuffer(b["slices"], np.uint8).reshape(b["bits"], -1))
        for j, key in enumerate(keys.tolist()):
            m = asked.length_factor(int(sizes[j]))
            for i, own in enumerate(asked.items):
                exact[i, key] = sum(n * int(asked.weights[t]) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)) for t, n in own.items() if (tf := counts[key][asked.names[t]]))
                bound[i, key] = int(ub[i, j])
    assert all(bound[x] >= exact[x] for x in exact)
    for i, own in enumerate(asked.items):
        if own:
            tenth = sorted((s for (k, _), s in exact.items() if k == i), reverse=True)[9]
            assert sum(b >= tenth for (k, _), b in bound.items() if k == i) < 0.1 * len(docs)


def test_plain_state_and_terms():
    assert [x.decode() for x in terms_of("Ab-cD_é9É\x7fz\x00[q]")] == ["ab", "cd", "é9É", "z", "q"]
    assert plain(Asked([[b"a"]], {b"a": 1}, 1, 1))["names"] == [b"a"]


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(f"select item_id, rank, doc_id, score from ({SQL})").fetchall()
    got = query(spark, sf_dir).select("item_id", F.col("rank"), "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
