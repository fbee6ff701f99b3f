import random
import re

import numpy as np
import pyarrow as pa

from millrace.llm import hashing as H
from millrace.llm import jaccard_join as J
from millrace.llm.decontaminate import contaminated, without_items
from millrace.llm.jaccard_join import near_duplicates, node_links

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


def grams(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_word_hashes_against_regex(monkeypatch):
    rnd = random.Random(1)
    for piece in (16, 1 << 20):
        monkeypatch.setattr(H, "PIECE", piece)
        for _ in range(150):
            texts = [None if rnd.random() < 0.05 else "".join(rnd.choice("ab C\n\xa0é") for _ in range(rnd.randrange(0, 60))) for _ in range(rnd.randrange(0, 12))]
            hashes, begin = H.word_hashes(pa.array(texts, pa.string()))
            seen = {}
            for i, text in enumerate(texts):
                own = hashes[begin[i] : begin[i + 1]].tolist()
                assert len(own) == len(words(text)) and all(seen.setdefault(w, h) == h for w, h in zip(words(text), own))
            assert len(set(seen.values())) == len(seen)


def components(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[rnd.choice(vocabulary) for _ in range(n)] for n in (6, 9, 30, 80, 200, 400)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(260):
        text = list(rnd.choice(base)) if i % 3 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 60))]
        for _ in range(rnd.randrange(0, 1 + len(text) // 25)):
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        if i % 4 == 0:
            text += passage
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(base[3][: 80 - i] + [f"u{i}x{j}" for j in range(i)])) for i in range(25)]  # around the threshold
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2004, "one\tTWO"), (2005, "two one"), (7, rows[7][1]), (None, rows[7][1]), (3000, "a b c d e " * 20000)]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, n int").repartition(6)
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted(components(rows), key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_cells_within_a_partition_change_nothing(spark, monkeypatch):
    rnd = random.Random(18)
    base = [[f"c{rnd.randrange(900)}" for _ in range(n)] for n in (12, 60, 300)]
    rows = []
    for i in range(200):
        text = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 1 + len(text) // 20)):
            text[rnd.randrange(len(text))] = f"c{rnd.randrange(900)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(J, "PART", 300)
    monkeypatch.setattr(J, "WIDTH", 3)
    monkeypatch.setattr(J, "shuffle_width", lambda spark: 3)
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == sorted(components(rows))


def test_cells_hold_as_much_at_ten_times_the_shingles():
    rnd = np.random.default_rng(6)
    largest = {}
    for times in (1, 10):
        nodes = np.array([(int(k), 100) for k in rnd.integers(-(2**62), 2**62, 400 * times)], J._NODE)
        value = np.unique(rnd.integers(0, 2**J.BITS, 40_000 * times, dtype=np.uint64))
        at, cells, width = rnd.integers(0, len(nodes), len(value)), 4 * times, 7
        whole = {}
        for part in range(width):
            batches = []
            mine = np.flatnonzero(value.view(np.int64) % width == part)
            for some in np.array_split(mine, 5 * times):
                used, local = np.unique(at[some], return_inverse=True)
                packed = J.planes((value[some] << np.uint64(16)) | local.astype(np.uint64))
                batches.append(pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([False]), pa.array([J.planes(nodes[used])], pa.binary()), pa.array([packed], pa.binary())], ["part", "common", "nodes", "packed"]))
            for batch in J.cells_of_parts(width, cells)(iter(batches)):
                for cell, _, own, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own, packed = J.unpack(own, J._NODE), J.unpack(packed)
                    assert cell // cells == part
                    whole.setdefault(cell, []).extend(zip((packed >> np.uint64(16)).tolist(), own["node"][(packed & np.uint64(J.LAST)).astype(int)].tolist(), strict=True))
        largest[times] = max(map(len, whole.values()))
        assert sorted(x for rows in whole.values() for x in rows) == sorted(zip(value.tolist(), nodes["node"][at].tolist(), strict=True))
    assert largest[10] < 1.2 * largest[1]


def test_a_large_group_costs_one_pair_per_member(spark):
    rnd = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(600):
        text = list(base)
        for _ in range(2):
            text[rnd.randrange(120)] = f"x{i}_{rnd.randrange(9)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    _, _, links = node_links(df.select(F.xxhash64("doc_id").alias("row_key"), "doc_id", "text"), 75)
    assert links.count() < 6 * 600
    want = components(rows)
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == sorted(want)


def test_open_rows_are_those_that_pairs_need(spark):
    """k texts that share shingles late in their prefixes can't link by these, so no such row is open; every pair that passes
    the positional filter keeps both of its rows."""
    late = spark.createDataFrame([(s, node, 100, 15 + s, 15, node) for s in range(5) for node in range(40)], "shingle long, node long, n long, pos long, own long, component long")
    assert J.open_rows(late, 75).count() == 0
    rnd, rows, fewer = random.Random(3), [], 0
    for s in range(300):
        for node in rnd.sample(range(60), rnd.randrange(1, 6)):
            n = 8 + node % 17
            rows.append((s, node, n, rnd.randrange(J.prefix_length(n, 75)), 0, node % 7))
    kept = {tuple(r) for r in J.open_rows(spark.createDataFrame(rows, late.schema), 75).collect()}
    need = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[5] != b[5] and 100 * a[2] >= 75 * b[2] and 100 * b[2] >= 75 * a[2] and min(a[2] - a[3], b[2] - b[3]) >= J.least_overlap(a[2], b[2], 75):
                need.add((*a[:5], a[5]))
    mixed = {r for r in rows if len({x[5] for x in rows if x[0] == r[0]}) > 1}
    assert need <= kept < mixed and len(need) > 50


def test_rounds_go_on_with_open_rows_only(spark, monkeypatch):
    """After the first look at all prefixes a round handles only what the one before left open, and loses nothing by that."""
    rnd = random.Random(9)
    long = [f"s{rnd.randrange(10**6)}" for _ in range(600)]
    rows = [(i, " ".join(long[4 * i : 4 * i + 90])) for i in range(120)]  # windows link with the next few, so a group is a chain
    rows += [(1000 + i, " ".join(f"p{i}x{j}" if j < 60 else f"t{j}" for j in range(80))) for i in range(60)]  # a shared end that links none
    rows += [(2000 + i, " ".join(rnd.choice("abc") + str(rnd.randrange(50)) for _ in range(40))) for i in range(60)]
    judged, opened, whole, known, plain, joined = [], [], [], [], J.open_rows, J.components

    def watched(df, percent):
        found = plain(df, percent)
        judged.append(df.count())
        opened.append(found.count())
        if len(judged) > 1:
            again = whole[0].drop("component").join(known[-1], "node", "left").selectExpr("shingle", "node", "n", "pos", "own", "coalesce(component, node) as component")
            assert {r[:2] for r in plain(again, percent).collect()} == {r[:2] for r in found.collect()}
        else:
            whole.append(df)
        return found

    monkeypatch.setattr(J, "components", lambda links: known.append(joined(links)) or known[-1])
    monkeypatch.setattr(J, "open_rows", watched)
    monkeypatch.setattr(J, "pairs_across", lambda rows, percent: (1 << 40, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == sorted(components(rows))
    assert len(judged) > 2 and judged[1:] == opened[:-1] and judged[-1] < judged[0] / 2, (judged, opened)


def test_containment_against_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 60)))) for i in range(40)] + [(50, None), (51, ""), (52, "ONE two"), (3, "again the same id here twice")]
    docs = []
    for i in range(150):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 300))]
        if i % 2:
            own = (rnd.choice(items)[1] or "").split()
            for _ in range(rnd.randrange(0, 3)):
                if own:
                    own[rnd.randrange(len(own))] = "changed"
            text[len(text) // 2 : len(text) // 2] = own
        docs.append((i, " ".join(text)))
    docs += [(200, None), (201, ""), (202, "x one Two y"), (203, "v1 " * 50000), (5, docs[5][1])]
    want = []
    for d, text in docs:
        for k, item in items:
            n = len(words(item))
            if n:
                own, held = grams(item, min(5, n)), grams(text, min(5, n)) if len(words(text)) >= min(5, n) else set()
                if len(own & held) >= 0.75 * len(own):
                    want.append((d, k, len(own), len(own & held)))
    d, i = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 200):
        assert sorted(tuple(r) for r in contaminated(d, i, block=block).collect()) == sorted(want)
    left = sorted(r.doc_id for r in without_items(d, i, block=200).collect())
    assert left == sorted(k for k, _ in docs if k not in {w[0] for w in want})
    assert contaminated(d.limit(0), i).count() == 0 and contaminated(d, i.limit(0)).count() == 0


def test_sketches_never_miss():
    from millrace.llm.decontaminate import Index

    rnd = np.random.default_rng(3)
    for n in range(1, 90):
        own = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        index = Index([(1, 1, own.view(np.int64).tolist())], 0.75)
        sketch = index.by_k[1][0]
        missed = len(own) - int(np.ceil(0.75 * len(own)))
        assert len(sketch) >= missed + 1 or len(sketch) == len(own)
