import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from millrace.llm.packing import pack, plan_slots
from millrace.llm.tokens import public_file


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(5)
    for _ in range(200):
        counts = {rnd.randrange(1, 41): rnd.randrange(1, 50) for _ in range(rnd.randrange(1, 20))}
        places: dict[int, list] = {}
        for length, lo, hi, each, first, offset in plan_slots(counts, 40):
            for rank in range(lo, hi):
                places.setdefault(first + (rank - lo) // each, []).append((offset + (rank - lo) % each * length, length))
        for inside in places.values():
            at = 0
            for offset, length in sorted(inside):
                assert offset == at
                at += length
            assert at <= 40
        assert sum(map(len, places.values())) == sum(counts.values())
        room: list[int] = []
        for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
            fits = [i for i, r in enumerate(room) if r >= length]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= length
            else:
                room.append(40 - length)
        assert len(places) == len(room)


def test_pieces_and_places(spark):
    rnd = random.Random(9)
    texts = [None, "", " ", "x", "<|endoftext|>"] + [" ".join(rnd.choice(["alpha", "beta", "ñu", "42"]) for _ in range(rnd.randrange(1, 1500))) for _ in range(120)] + ["word " * 5000, "a" + " " * 1_500_000 + "b"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "x"), (None, "no id")]
    out = pack(spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id long, text string, length int").repartition(7)).collect()
    t = Tokenizer.from_file(public_file())
    want = []
    for key, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(key, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    places: dict[int, list] = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= 1.02 * sum(w[3] for w in want) / 1024 + 1
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
