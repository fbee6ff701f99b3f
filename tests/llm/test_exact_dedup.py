import hashlib
import random
from collections import defaultdict

from millrace.llm.exact_dedup import PatriciaTrie, exact_dedup


def test_trie_finds_equal_keys_and_flushes_closed_subtrees():
    rnd = random.Random(5)
    keys = sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 9))) for _ in range(400))
    trie, out = PatriciaTrie(), []
    for i, key in enumerate(keys):
        node = trie.insert(key)
        node.payload = [key, 1 + (node.payload[1] if node.payload else 0)]
        if i % 7 == 0:
            out += trie.flush(spare=True)
    out += trie.flush()
    assert sorted(out) == sorted([k, keys.count(k)] for k in set(keys))


def brute(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    out = []
    for text, keys in groups.items():
        owner = max((k for k in keys if k is not None), default=None)
        out += [(k, owner, len(keys), k is not None and k == owner, hashlib.sha256(text.encode()).hexdigest()) for k in keys]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["", None, "a", "A", "é", "long " * 5000, "hot", "hot", "hot", f"own {i}"])) for i in range(500)] + [(7, "hot"), (7, "hot"), (None, "a"), (None, "only null"), (None, "only null")]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, owner int, rep string").repartition(9)
    for trie_bytes, hot in ((64 << 20, 1000), (10, 1000), (64 << 20, 3), (10, 1)):  # with hot keys from many batches
        out = exact_dedup(df, trie_bytes=trie_bytes, hot=hot)
        assert sorted((tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str) == brute(rows)
    assert exact_dedup(df.limit(0)).count() == 0
