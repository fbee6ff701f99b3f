import random

import pandas as pd
import pyspark.sql.functions as F

from millrace.functions.splitter import split_text
from millrace.operators import text as T

MARKDOWN = "# Harbour\nBoats lie here.\n\n## Crane\nIt lifts crates.\n\n### Winch\nIts rope is new."


def test_sections_and_chunks(spark):
    rows = T.chunks(spark.createDataFrame([("d", MARKDOWN), ("e", "no heading"), ("n", None)], "doc_id string, markdown string")).orderBy("doc_id", "chunk_index").collect()
    assert [r.heading for r in rows] == ["Harbour", "Harbour > Crane", "Harbour > Crane > Winch", ""]
    assert rows[1].text.startswith("Harbour > Crane\nIt lifts crates.") and rows[1].chunk_id == "d_chunk_0001" and rows[1].chapter == "Harbour"
    assert rows[3].text == "no heading" and len(rows[3].chunk_hash) == 32


def test_a_shallower_heading_resets_the_path(spark):
    rows = T.sections(spark.createDataFrame([("d", "# A\n### C\nx\n## B\ny\n# Z\n### W")], "doc_id string, markdown string")).orderBy("sec_no").collect()
    assert [list(r.heading_path) for r in rows] == [["A"], ["A", "C"], ["A", "B"], ["Z"], ["Z", "W"]]


def test_splitter_bounds_and_coverage():
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choice(["ab ", "c", "\n", "\n\n", "。", "，", "word"]) for _ in range(rnd.randrange(0, 400)))
        pieces = split_text(text, 40, 8)
        assert all(0 < len(p) <= 40 and p in text for p in pieces)
        assert {c for c in text if not c.isspace()} == {c for p in pieces for c in p if not c.isspace()}
        assert sum(len(p) for p in pieces) >= len("".join(text.split()))


def test_tables(spark):
    md = spark.createDataFrame([("d", "fares\n| line | zone | price |\n|---|---|---|\n| U7 | b | 2.9 |\n| S1 |  | 3.5 |\nsee above")], "doc_id string, markdown string")
    [t] = T.markdown_tables(md).collect()
    assert (list(t.headers), [list(r) for r in t.rows], t.num_rows, t.num_cols) == (["line", "zone", "price"], [["U7", "b", "2.9"], ["S1", "3.5"]], 2, 3)
    assert [list(r) for r in T.markdown_tables(md, keep_empty=True).first().rows][1] == ["S1", "", "3.5"]
    html = "<table class=x><caption>Tides <i>today</i></caption><tr><th>hour</th><th>height</th></tr><tr><td>04:10</td><td>1.2 m</td></tr><tr></tr></table>"
    x = spark.range(1).select(T.html_table(F.lit(html)).alias("t")).first().t
    assert x.caption == "Tides today" and list(x.headers) == ["hour", "height"] and [list(r) for r in x.rows] == [["04:10", "1.2 m"]]
    two = spark.createDataFrame([("d", i, "rates" if i < 3 else None, ["from", "rate"], [[str(i), "7"]] * (i + 1), 2) for i in range(4)], "doc_id string, ord int, caption string, headers array<string>, rows array<array<string>>, num_cols int")
    assert [r.num_rows for r in T.merge_tables(two).orderBy("ord").collect()] == [6, 4]
    five = spark.createDataFrame([("d", 0, "stock", ["shelf", "pieces"], [["k", "9"]] * 7, 2)], "doc_id string, ord int, caption string, headers array<string>, rows array<array<string>>, num_cols int")
    assert [r.num_rows for r in T.table_chunks(five, 4).orderBy("part_index").collect()] == [4, 3]


def test_merge_neighbours_and_dedup(spark):
    rows = spark.createDataFrame([("p", 0, "a", "Oak", "hard wood", "text"), ("p", 1, "b", "Oak", "old trees", "text"), ("p", 2, "c", "Elm", "e" * 600, "text"), ("p", 3, "d", None, "z", "table")], "doc_id string, ord int, chunk_id string, heading string, text string, type string")
    out = T.merge_neighbours(rows, 500).orderBy("ord").collect()
    assert [(r.chunk_id, r.text[:12]) for r in out] == [("a+", "hard wood\n\no"), ("c", "e" * 12), ("d", "z")]
    assert T.first_by_prefix(rows.withColumn("text", F.lit("same")), ["ord"]).count() == 1


def test_clean_tokens_and_bigrams(spark):
    row = spark.range(1).select(T.clean(F.lit(" A​  b\t c\n\n\nD ")).alias("c"), T.tokens(F.lit("The Cat, the DOG 42")).alias("t"), T.bigrams(F.lit("abc")).alias("b"), T.bigrams(F.lit("X")).alias("one")).first()
    assert row.c == "a b c\nd" and list(row.t) == ["cat", "dog", "42"] and list(row.b) == ["ab", "bc"] and list(row.one) == ["x"]


SOUND = [
    "plain", "", "café", "naïve “quote” – it’s", "Привет, мир", "日本語テキスト", "Ünïcödé ñ", "€ 5", "👍🏽 ok", "ελληνικά", "Straße", "déjà vu — “café”—", "«CAFÉ»", "NÃO", "São Paulo", "«МИР»", "Ёлка ёж", "Â", "Ã", "â", "x ± y ≤ z",
    "Õ×", "ÉÈÊ ÇA", "É»", "café”—", "à «»", "l’été…", "à­b", "Ñandú™", "√2 ≈ 1.41", "¬p ∨ q", "ĀāĂă", "ﾊﾛｰ", "‘Äpfel’ ‚Öl‘", "\x00\x7f", "a\u0085b", "ÿ¿",
]


def test_sound_texts_stay_and_misread_ones_come_back(spark):
    from millrace.functions.encoding import badness, repair, repaired

    assert [repaired(t) for t in SOUND] == SOUND and repaired(None) is None and not any(map(badness, SOUND))
    for text in ("café", "Ünïcödé ñ", "Straße", "€ 5", "naïve “quote”", "Привет, мир", "日本語テキスト", "ελληνικά"):
        read = text
        for _ in range(3):
            read = read.encode().decode("latin-1")
            assert repaired(read) == text and repaired(f"vor – {read} – und «nach»") == f"vor – {text} – und «nach»"
    for text, page in (("it’s “so”", "cp1251"), ("Привет, мир", "cp1251"), ("Straße", "mac_roman"), ("café", "mac_roman"), ("l’été", "cp1252"), ("l’été", "mac_roman")):
        assert repaired(text.encode().decode(page)) == text, (text, page)
    assert repaired("â€™\ud7ff cafÃ©".replace("\ud7ff", "")) == "’ café" and repaired("Ã") == "Ã"
    long = "cafÃ© " * 20_000 + "ÃƒÂ©"
    assert repaired(long) == "café " * 20_000 + "é"
    df = spark.createDataFrame([(t.encode().decode("latin-1"),) for t in SOUND[2:6]] + [(None,)], "t string")
    assert {r[0] for r in df.select(repair("t")).collect()} == {*SOUND[2:6], None}


def every_path(run, longest):
    if not run:
        return [[]]
    return [[run[:k], *rest] for k in range(1, min(longest, len(run)) + 1) for rest in every_path(run[k:], longest)]


def test_words_are_the_best_path_of_all(spark):
    import random

    from millrace.functions import words as W

    rnd = random.Random(6)
    letters = "日月山川水火"
    for _ in range(60):
        counts = {c: rnd.randrange(1, 50) for c in letters[:5]} | {"".join(rnd.choices(letters, k=rnd.randrange(2, 5))): rnd.randrange(1, 30) for _ in range(12)}
        weights = W.weights_of(counts)
        unknown = min(weights.values()) - W.SCALE
        for _ in range(10):
            run = "".join(rnd.choices(letters, k=rnd.randrange(1, 11)))
            paths = [p for p in every_path(run, W.LONGEST) if all(w in weights or len(w) == 1 for w in p)]
            score = lambda p: sum(weights.get(w, unknown) for w in p)  # noqa: E731, B023
            most = max(map(score, paths))
            assert W.best_path(run, weights, unknown) == max((p for p in paths if score(p) == most), key=lambda p: [len(w) for w in p])


def test_a_learned_dictionary_cuts_and_finds(spark, tmp_path):
    import random
    from dataclasses import replace

    from millrace.functions import words as W
    from millrace.operators import segments as S
    from millrace.params import DEFAULT

    rnd = random.Random(1)
    words = ["机器", "学习", "数据库", "模型", "图书馆", "ภาษา", "ไทย", "ひらがな", "語"]
    rows = [(i, i, "".join(rnd.choices(words, k=12)) + (" Spark 4 の" if i % 2 else "。")) for i in range(300)] + [(900, 900, "plain words"), (901, 901, None), (902, 902, "")]
    texts = spark.createDataFrame(rows, "chunk_id long, doc_id long, text string")
    params = replace(DEFAULT, segment=W.segmenter(W.learned(texts)))
    cut = {r.chunk_id: r.t for r in texts.select("chunk_id", T.tokens(F.col("text"), params).alias("t")).collect()}
    own = {i: set(cut[i]) - {"spark", "4", "の"} for i in range(300)}
    right = sum(len(x & set(words)) for x in own.values()) / sum(map(len, own.values()))
    assert right > 0.95 and cut[1][-3:] == ["spark", "4", "の"] and cut[900] == ["plain", "words"] and cut[901] is None and cut[902] == []
    store = S.create(texts.filter("chunk_id < 20 or chunk_id >= 900").unionByName(spark.createDataFrame([(50, 50, "我的图书馆很大")], texts.schema)), str(tmp_path / "s"), params, buckets=1)
    asked = spark.createDataFrame([(1, "图书馆很大"), (2, "words")], "query_id long, query string")
    best = {r.query_id: r.chunk_id for r in S.search(store, asked, 1, params).collect()}
    assert best == {1: 50, 2: 900}


def test_many_runs_are_cut_as_one_by_one_and_counted_once(spark, monkeypatch):
    from collections import Counter

    from millrace.functions import words as W

    rnd = random.Random(3)
    letters = [chr(0x4E00 + 37 * i) for i in range(6)] + ["ก", "ぁ"]
    runs = ["".join(rnd.choices(letters, k=rnd.choice([1, 2, 3, 4, 5, 30, 700]))) for _ in range(60)] + ["龟", letters[0] * 3000]
    counts = Counter(run[i : i + k] for run in runs for k in range(1, 5) for i in range(len(run) - k + 1))
    kept = {w: n for w, n in counts.items() if len(w) == 1 or rnd.random() < 0.3}
    del kept["龟"]
    weights = W.weights_of(kept)
    unknown = min(weights.values()) - W.SCALE
    for few in (0, 8, 100):
        monkeypatch.setattr(W, "FEW", few)
        assert W.best_paths(runs, W.hashed(weights), unknown) == [W.best_path(run, weights, unknown) for run in runs]
    monkeypatch.setattr(W, "AT_ONCE", 100)
    monkeypatch.setattr(W, "COUNTED", 50)
    found = Counter()
    for rows in W.counted(iter([pd.DataFrame({"run": runs[:30]}), pd.DataFrame({"run": runs[30:]})])):
        found.update(dict(zip(W.word_of.func(rows["key"]), rows["n"], strict=True)))
    assert set(W.word_of.func(pd.Series([k for k in [int.from_bytes("机器".encode("utf-16-be"), "big")]]))) == {"机器"} and found == counts
    made = W.learned(spark.createDataFrame([(x,) for x in runs], "text string"), 1)
    assert {r.word: r.n for r in made.collect() if len(r.word) == 1} == {w: n for w, n in counts.items() if len(w) == 1}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 0  # texts are read once


def test_a_batch_of_long_texts_is_cut_a_portion_at_a_time(monkeypatch):
    """The words of a whole batch are held as Arrow's arrays only: as Python's strings these would take over 100 MB."""
    import random
    import tracemalloc

    import pyarrow as pa

    from millrace.functions import words as W

    rnd = random.Random(5)
    letters = "\u4e00\u4e25\u4e4a\u4e6f\u4e94"
    weights = W.weights_of({w: rnd.randrange(5, 50) for w in [*letters, *(a + b for a in letters for b in letters[:2])]})
    table, unknown = W.hashed(weights), min(weights.values()) - W.SCALE
    few = [["".join(rnd.choices(letters, k=n)), "abc", "", "x1"] for n in (1, 5, 40)] + [None, []]
    monkeypatch.setattr(W, "CUT_AT_ONCE", 30)
    want = [None if x is None else [w for s in x for w in (W.best_path(s, weights, unknown) if s and s[0] in letters else [s])] for x in few]
    assert W.cut_strings(pa.array(few), table, unknown).to_pylist() == want and W.cut_strings(pa.array(few).slice(1, 3), table, unknown).to_pylist() == want[1:4]
    monkeypatch.setattr(W, "CUT_AT_ONCE", 1 << 16)
    long = pa.array([["".join(rnd.choices(letters, k=400)) for _ in range(50)] for _ in range(150)])  # 3 million letters
    tracemalloc.start()
    got = W.cut_strings(long, table, unknown)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and "".join(got.flatten().to_pylist()) == "".join(long.flatten().to_pylist())
