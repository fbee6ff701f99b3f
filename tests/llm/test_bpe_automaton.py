import hashlib
import itertools
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm.bpe_automaton import Automaton, Coder, decoded, encoded, query, share
from millrace.llm.tokens import public_file

SMALL = "/root/testdata/sf0.001"
LONG = 5_000_000


@pytest.fixture(scope="module")
def automaton():
    return Automaton.of_file(public_file())


@pytest.fixture(scope="module")
def coder(automaton):
    return Coder(automaton)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_file())


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def by_rules(word: bytes, rules: list[tuple[bytes, bytes]]) -> list[bytes]:
    out = [bytes([b]) for b in word]
    for left, right in rules:
        k = 0
        while k + 1 < len(out):
            if (out[k], out[k + 1]) == (left, right):
                out[k : k + 2] = [left + right]
            k += 1
    return out


def test_gadgets_accept_what_rules_make_and_nothing_else():
    rnd = random.Random(4)
    for _ in range(60):
        tokens, rules = [b"a", b"b", b"c"], []
        for _ in range(rnd.randrange(1, 14)):
            left, right = rnd.choice(tokens), rnd.choice(tokens)
            if left + right not in tokens:
                tokens.append(left + right)
                rules.append((left, right))
        ids = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(tokens[3:])}
        coder = Coder(Automaton(ids, rules))
        for n in range(1, 7):
            for word in map(bytes, itertools.product(b"abc", repeat=n)):
                assert [coder.labels[t] for t in coder.path(word)] == by_rules(word, rules), (rules, word)
    with pytest.raises(ValueError):
        Automaton({bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}, [(b"ab", b"c"), (b"a", b"b")])


def test_encodes_as_the_library(coder, library):
    rnd = random.Random(7)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "中", "1", "٣", "s", "'", "'ll", "!?", "<|endoftext|>", "　", "_", "👍🏽", "\r\n", "\x00", "word", "՘", "\U0003fc3d", "\x85", "²", "ⅷ", "<|endof"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 30)))
        assert coder.encode(text) == ids_of(library, text)
        assert coder.decode(coder.encode(text)) == library.decode(library.encode(text, add_special_tokens=False).ids, skip_special_tokens=False) == text


def test_every_character_as_the_library(coder, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 20_000):
        text = " ".join(f"a{c}1{c}" for c in points[k : k + 20_000])
        assert coder.encode(text) == ids_of(library, text)


@pytest.mark.parametrize("text", [" " * LONG + "x", "a" * LONG + " b", "\t" * 500_000, "-=" * 200_000, "é" * 200_000, "<|endoftext|>" * 20_000])
def test_very_long_words(coder, library, text):
    assert coder.encode(text) == ids_of(library, text)


def test_decodes_any_ids_as_the_library(coder, library):
    rnd = random.Random(11)
    for _ in range(500):
        ids = [rnd.randrange(50_257) for _ in range(rnd.randrange(0, 40))]
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    assert coder.decode(np.array([64, 4_000_000_000, 65], "<u4").tobytes()) == coder.decode(np.array([64, 65], "<u4").tobytes())


def test_operators(spark, automaton, library):
    shared = share(spark, automaton)
    rows = [(1, "hello world", b"x"), (2, None, b"x"), (3, "", b"x"), (3, "", b"x"), (None, "x y", b"x"), (4, "word " * 200_000, b"x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary").repartition(3)
    out = decoded(encoded(docs, shared), shared).collect()
    assert sorted(((r.doc_id, bytes(r.ids), r.text) for r in out), key=str) == sorted(((k, ids_of(library, t or ""), t or "") for k, t, _ in rows), key=str)
    assert encoded(docs.limit(0), shared).count() == 0
    assert decoded(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), shared).first().text == ""


def test_query_against_the_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = query(spark, SMALL).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = ids_of(library, docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest())
