import random
import zlib

import pyspark.sql.functions as F
import pytest
from tokenizers import Tokenizer

from millrace.llm.token_counts import CountedText, edited_trees, query, token_trees, with_edits
from millrace.llm.tokens import encoder, public_file

SMALL = "/root/testdata/sf0.001"


def reference():
    t = Tokenizer.from_file(public_file())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoder_gives_the_tokenizers_ids():
    rnd, own, other = random.Random(7), encoder(public_file()), reference()
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "中", "1", "٣", "s", "'", "'ll", "!?", "<|endoftext|>", " ", "_", "👍🏽", "\r\n", "\x00", "word"]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 30)))
        assert own(text) == other(text)


@pytest.mark.parametrize("text", [c * 5_000_000 + end for c in (" ", "\t", "\n", "a") for end in ("", "x")] + ["one" + " " * 1_000_000 + "<|endoftext|>" + "\n" * 1_000_000 + " two " + " \t" * 900_000 + "three  four"], ids=str.__len__)
def test_long_runs_are_encoded_as_the_library_does(text):
    assert encoder(public_file())(text) == reference()(text)


def deepest(node):
    return 0 if node.text is not None else 1 + max(deepest(node.left), deepest(node.right))


def test_edits_keep_counts_equal_to_encoding_anew():
    rnd, encode = random.Random(3), encoder(public_file())
    words = ["alpha", "be", "it's", "x9", "\n", "  ", "end.", "ñandú", "ab cd", "-", " \n", "слово", "字。字", "かな、", "ที่นี่", "<|endoftext|>", "中文字" * 9, "\r\n", "\t1"]
    for _ in range(80):
        text = "".join(rnd.choice(words) + rnd.choice([" ", "", " "]) for _ in range(rnd.randrange(0, 900)))
        tree = CountedText(text, encode)
        for _ in range(8):
            a = rnd.randrange(0, len(text) + 3)
            b = a + rnd.choice([0, 0, 1, 3, 40, 700])
            new = rnd.choice(["", " ", "z", " w ", "'s", "\n\n", "many words go in here " * 30, "<|endof", "。", "字", "|>"])
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.root.chars == len(text)
            assert tree.root.tokens == len(encode(text)) == sum(x.tokens for x in tree.leaves())
            assert all(x.tokens == len(encode(x.text)) for x in tree.leaves())
            kept = CountedText(text, encode, [len(x.text) for x in tree.leaves()], [x.tokens for x in tree.leaves()])
            assert kept.text() == text and kept.root.tokens == tree.root.tokens


@pytest.mark.parametrize("text", ["some words here " * 5000, "несколько слов здесь " * 4000, "字一二三四五六七八九。" * 6000, "ที่นี่มีคำหลายคำ" * 4000, "1 22 333\n" * 8000, "αβγ, δε. " * 9000])
def test_only_touched_regions_are_encoded_again(text):
    tree = CountedText(text, encoder(public_file()))
    tree.edit(40_000, 40_005, "other")
    assert 0 < tree.encoded_again < 2000


def test_many_edits_leave_a_shallow_tree():
    tree = CountedText("some words here " * 2000, encoder(public_file()))
    for i in range(3000):
        tree.edit(i * 7 % tree.root.chars, i * 7 % tree.root.chars, " and some more words that go in " * 9)
    assert deepest(tree.root) <= 1.45 * len(tree.leaves()).bit_length() + 2


def test_operator(spark):
    docs = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (3, "", 5), (None, "x y", 5), (4, "word " * 30000, 5)], "doc_id long, text string, tokens int")
    edits = spark.createDataFrame([(1, 2, 0, 0, "oh "), (1, 1, 0, 5, "goodbye"), (2, 1, 9, 12, "new"), (4, 1, None, None, None), (9, 1, 0, 1, "")], "doc_id long, seq int, start int, end int, replacement string")
    out = edited_trees(with_edits(token_trees(docs), edits))
    rows = [(r.doc_id, r.tokens_before, r.tokens, r.text) for r in out.collect()]
    ids = reference()
    assert sorted(rows, key=str) == sorted([
        (1, len(ids("hello world")), len(ids("oh goodbye world")), "oh goodbye world"), (2, 0, len(ids("new")), "new"), (3, 0, 0, ""), (3, 0, 0, ""),
        (None, 2, 2, "x y"), (4, len(ids("word " * 30000)), len(ids("word " * 30000)), "word " * 30000)], key=str)
    again = edited_trees(with_edits(out.drop("tokens_before", "encoded_again"), edits.filter("doc_id = 1 and seq = 2")))
    assert {r.doc_id: (r.tokens_before, r.text) for r in again.collect()}[1] == (len(ids("oh goodbye world")), "oh oh goodbye world")
    assert token_trees(docs.limit(0)).count() == 0
    spaces = spark.createDataFrame([(1, "a" + " " * 2_000_000 + "b"), (2, "c")], "doc_id long, text string")
    assert {r.doc_id: r.tokens for r in token_trees(spaces).collect()} == {1: len(ids("a" + " " * 2_000_000 + "b")), 2: 1}
    with pytest.raises(ValueError):
        with_edits(docs.withColumn("edits", F.lit(1)), edits)


def test_kept_trees_are_read_and_not_encoded(spark, tmp_path):
    docs = spark.createDataFrame([(i, "слова и ещё слова " * 3000) for i in range(4)], "doc_id long, text string")
    token_trees(docs).write.parquet(str(tmp_path / "trees"))
    edits = spark.createDataFrame([(2, 1, 30_000, 30_001, "x")], "doc_id long, seq int, start int, end int, replacement string")
    rows = {r.doc_id: r for r in edited_trees(with_edits(spark.read.parquet(str(tmp_path / "trees")), edits)).collect()}
    assert [rows[i].encoded_again for i in (0, 1, 3)] == [0, 0, 0] and 0 < rows[2].encoded_again < 2000
    assert rows[2].tokens == len(reference()(rows[2].text)) and rows[0].tokens == rows[0].tokens_before


def test_query_against_encoding_anew(spark):
    ids, docs = reference(), {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in query(spark, SMALL).collect():
        t = docs[r.doc_id]
        n = len(t)
        after = t[: n // 2] + t[:12] + " " + t[n // 2 + 8 :]
        at = r.doc_id % (n + 1)
        after = after[:at] + " [edited] " + after[at:]
        after = after[: n - 5] + after[n:] if n >= 5 else after
        if n >= 8:
            assert (r.tokens_before, r.tokens_after, r.chars_after, r.text_crc32) == (len(ids(t)), len(ids(after)), len(after), zlib.crc32(after.encode()))
