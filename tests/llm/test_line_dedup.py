import hashlib
import random
from collections import Counter, defaultdict

import pytest

from millrace.llm import line_dedup as D
from millrace.llm.line_dedup import line_dedup

LONG = 50


def chunk_bounds(lines):
    """The chunks of two lines or more and the long lines, by the rule of the module's docstring, written anew."""
    value = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in lines]
    alone = [len(x.encode().split()) >= LONG for x in lines]
    ends = set()
    for i in range(len(lines)):
        before = value[i - 1] if i else 0
        if (value[i] * 0x9E3779B97F4A7C15 + before * 0xD6E8FEB86659FD93 >> 17) % 2 == 0 or alone[i] or (i + 1 < len(lines) and alone[i + 1]):
            ends.add(i + 1)
    edges = [0, *sorted(ends | {len(lines)})]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b - a > 1 or b > a and alone[a]]


def brute(rows):
    """Text by row. Passages are chunks and pairs of lines; the first place of each passage is kept whole, at its other places
    the lines of chunks go, and runs of repeated lines of LONG words. Equal (id, text) rows are one document."""
    chunks, pairs = defaultdict(list), defaultdict(list)
    order = lambda place: ((place[0] is not None, place[0] or 0), place[1], place[2])
    split = {(doc, text): text.split("\n") for doc, text in set(rows) if text is not None}
    for (doc, text), lines in split.items():
        for a, b in chunk_bounds(lines):
            chunks["\n".join(lines[a:b])].append((doc, text, a, b))
        for i in range(len(lines) - 1):
            if all(len(x.encode().split()) < LONG for x in lines[i : i + 2]):
                pairs["\n".join(lines[i : i + 2])].append((doc, text, i, i + 2))
    leader = lambda places: min(places, key=order)
    out, kept_lines = [], {}
    for (doc, text), lines in split.items():
        here = lambda held: [(own, p) for own, places in held.items() if len(places) > 1 for p in places if p[:2] == (doc, text)]
        keep, hard, soft = set(), set(), set()
        for own, p in here(pairs):
            (keep if leader(pairs[own]) == p else soft).update(range(p[2], p[3]))
        for own, p in here(chunks):
            first = leader(chunks[own]) == p
            if first and p[3] - p[2] > 1:  # do its lines stand in a row at an earlier place?
                spots = [(leader(pairs["\n".join(lines[i : i + 2])]), i) for i in range(p[2], p[3] - 1)]
                first = any(q[:2] == (doc, text) and q[2] == i for q, i in spots) or len({(*q[:2], q[2] - i) for q, i in spots}) > 1
            (keep if first else hard).update(range(p[2], p[3]))
        marked, gone, i = hard | soft, set(), 0
        while i < len(lines):
            j = i
            while j in marked:
                j += 1
            run = set(range(i, j))
            gone |= run if sum(len(lines[k].encode().split()) for k in run) >= LONG else run & hard
            i = max(j, i + 1)
        kept_lines[doc, text] = "\n".join(x for k, x in enumerate(lines) if k not in gone - keep)
    for doc, text in rows:
        out.append((doc, None if text is None else kept_lines[doc, text]))
    return out


def cleaned(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r.doc_id, r.text) for r in line_dedup(df, **more).collect()), key=str)


def test_first_places_stay_whole(spark):
    line = lambda c, n=30: " ".join(f"{c}{i}" for i in range(n))
    a, b, c = line("a"), line("b"), line("c")
    assert cleaned(spark, [(1, f"{a}\n{b}"), (2, f"{a}\n{b}\n{c}"), (3, f"{b}\n{c}")]) == [(1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (3, "")]
    assert cleaned(spark, [(1, "\n".join([a] * 3))]) == [(1, f"{a}\n{a}")]
    assert cleaned(spark, [(1, f"{a}\n{b}\n{a}\n{b}\n{a}\n{b}")])[0][1].startswith(f"{a}\n{b}\n{a}")


def test_every_repeated_pair_still_stands_somewhere(spark):
    rnd = random.Random(3)
    for size in (6, 25):
        lines = [" ".join(f"l{k}w{i}" for i in range(20)) for k in range(size)]
        rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 9)))) for i in range(40)]
        got = cleaned(spark, rows)
        assert got == sorted(brute(rows), key=str)
        pairs = lambda texts: Counter(p for t in texts for p in zip(t.split("\n"), t.split("\n")[1:]))
        assert {p for p, n in pairs(t for _, t in rows).items() if n > 1} <= pairs(t for _, t in got).keys()


def test_a_short_passage_goes_wherever_it_stands(spark):
    passage = [" ".join(f"p{k}w{i}" for i in range(18)) for k in range(3)]
    rows = [(i, "\n".join([f"one {i} {j}" for j in range(i % 4)] + passage + [f"two {i}"])) for i in range(12)]
    small = [(100 + i, f"mine {i}\nshort line\nother short line\nalso mine {i}") for i in range(1)]
    got = dict(cleaned(spark, rows + small))
    assert got[0] == rows[0][1] and all("w3" not in got[i] and f"two {i}" in got[i] for i in range(1, 12)) and got[100] == small[0][1]


def test_chunks_cover_the_text_and_move_with_the_lines():
    lines = [f"line {i} of the text".encode() for i in range(60)]
    whole = lambda x: {tuple(x[a:b]) for a, b in D.chunks_of(x, 2, LONG)}
    assert D.chunks_of(lines, 2, LONG) == chunk_bounds([x.decode() for x in lines])
    assert len(whole(lines) - whole([b"another", *lines])) <= 2


ROWS = [
    *[(i, "\n".join([f"own {i} a", f"own {i} b", *[f"shared line number {k} with some more words" for k in range(12)], f"own {i} c"])) for i in range(20)],
    (30, "x\n" + " ".join(f"w{i}" for i in range(60)) + "\ny"), (31, "z z\n" + " ".join(f"w{i}" for i in range(60))), (32, None), (33, ""), (33, ""), (34, "a\n\n\n\nb"), (35, "a\n\n\n\nb"), (36, "long " * 20000),
]


def test_against_brute_force(spark):
    rows = [*ROWS, (40, ROWS[3][1]), (40, ROWS[3][1])]
    names = ["doc_id", "text", "gone", "__key", "__clean", "k1", "repeats", "c0", "hash"]
    df = spark.createDataFrame([(d, t, *range(7)) for d, t in rows], "doc_id long, text string, gone int, __key int, __clean int, k1 int, repeats int, c0 int, hash int").repartition(5).withColumn("lines", D.F.lit("old"))
    out = line_dedup(df)
    assert out.columns == [*names, "lines", "removed_lines", "removed_chunks"]
    got = out.collect()
    assert all(tuple(r)[2:9] == tuple(range(7)) for r in got)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(brute(rows), key=str)
    assert {r.doc_id: (r.lines, r.removed_lines, r.removed_chunks) for r in got if r.doc_id in (31, 32, 33)} == {31: (2, 1, 1), 32: (0, 0, 0), 33: (1, 0, 0)}


@pytest.mark.parametrize("modulus", [1, 7])
def test_equal_hashes_of_unequal_bytes(spark, monkeypatch, modulus):
    real = D.digest
    monkeypatch.setattr(D, "digest", lambda data, kind: (real(data, kind) % modulus) * 2 + bool(kind))
    rows = [*ROWS, (50, "x\n" + " ".join(f"v{i}" for i in range(60)) + "\ny"), (51, " ".join(f"v{i}" for i in range(60)))]
    assert cleaned(spark, rows) == sorted(brute(rows), key=str)


def test_empty(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_and_equal_ids_with_different_texts(spark):
    long_line = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long_line), (1, long_line), (1, long_line + "\nmore")]
    assert set(cleaned(spark, rows)) == {(None, long_line), (1, ""), (1, "more")}
