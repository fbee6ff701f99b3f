import random
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyspark.sql.functions as F

from millrace.llm import language_id as L
from millrace.llm import toxicity as X

SMALL = "/root/testdata/sf0.01"


def labelled(spark):
    rows = [("the cat and the dog went with that house", "en"), ("und der hund ist nicht mit der katze im haus", "de"), ("кот и собака живут дома", "ru")] * 30
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)] + [(900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string")


def test_spans_scripts_and_edges(spark):
    model = L.fit(labelled(spark))
    mixed = "the cat and the dog went with that house the cat " + "und der hund ist nicht mit der katze und der hund " * 2
    rows = [(1, "the dog and the cat"), (2, "собака"), (3, None), (4, ""), (5, "12 !?"), (6, mixed), (7, "中文"), (1, "the dog and the cat"), (None, "der hund"), (8, "the dog " * 60000)]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in L.annotate(df, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, None, 8)] == ["en", "ru", "und", "und", "und", "de", "en"]
    assert got[7].lang_pred in model.langs and 0 < got[7].score < 0.5 and got[3].score == 0
    assert [s.lang for s in got[6].spans] == ["en", "de"] and got[6].lang_pred == "de" and abs(got[6].spans[0].end - 49) <= 1
    assert got[6].spans[0].start == 0 and got[6].spans[1].end == len(mixed) and L.annotate(df, model).count() == len(rows)
    assert L.annotate(df.limit(0), model).count() == 0
    assert L.annotate(df, L.fit(labelled(spark).limit(0))).filter("lang_pred <> 'und'").count() == 0


def best_path(scores, penalty):
    """All paths by plain recursion over every language pair."""
    n, m = scores.shape
    best = [(scores[0][k], [k]) for k in range(m)]
    for t in range(1, n):
        best = [max(((best[j][0] - (penalty if j != k else 0) + scores[t][k], best[j][1] + [k]) for j in range(m)), key=lambda x: x[0]) for k in range(m)]
    return max(best, key=lambda x: x[0])[0]


def value(scores, path, penalty):
    return sum(scores[t][k] for t, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_labelling_is_optimal():
    rnd = np.random.default_rng(2)
    for _ in range(300):
        scores = -rnd.integers(0, 5, (rnd.integers(1, 30), 3)).astype(np.float32)
        for penalty in (0.5, 3.0, 12.0):
            path = L.label(scores, penalty)
            path = [path] * len(scores) if isinstance(path, int) else path.tolist()
            assert abs(value(scores, path, penalty) - best_path(scores, penalty)) < 1e-4


def test_words_match_the_pattern(monkeypatch):
    alphabet, rnd = L.Alphabet(), random.Random(3)
    monkeypatch.setattr(L, "PIECE", 40)
    for _ in range(60):
        texts = ["".join(rnd.choice("aBé ц中_1.-\n") for _ in range(rnd.randrange(0, 50))) for _ in range(5)]
        whole = "".join(texts)
        found = [whole[a + at : b + at] for _, start, end, at in L.pieces(texts, alphabet) for a, b in zip(start, end)]
        want = [w for t in texts for w in L.WORD.findall(t)]
        assert "".join(found) == "".join(want) and len(found) >= len(want)


def bucket(gram):
    """The hash bucket of one n-gram of 1 to 3 letters or word ends, in plain integers."""
    x = ord(gram[0]) * 0x9E3779B1 % 2**32
    for c, times, plus in zip(gram[1:], (0x85EBCA77, 0xC2B2AE3D), (0x27D4EB2F, 0x165667B1)):
        x ^= (ord(c) * times + plus) % 2**32
    return ((x ^ x >> 15) * 0x2C1B3C6D % 2**32) >> (32 - L.BITS)


def grams_of(word):
    ends = "<" + word.lower() + ">"
    return [bucket(ends[i : i + n]) for n in (1, 2, 3) for i in range(len(ends) - n + 1)]


def script_of(word):
    return [name for first, name in L.SCRIPTS if first <= ord(word[0])][-1]


def test_word_scores_against_plain_python(spark):
    rows = [(r.text, r.lang) for r in labelled(spark).collect() if r.text and r.lang]
    langs = sorted({lang for _, lang in rows})
    seen, written = {k: defaultdict(int) for k in langs}, {k: defaultdict(int) for k in langs}
    for text, lang in rows:
        for word in L.WORD.findall(text):
            written[lang][script_of(word)] += 1
            for g in grams_of(word):
                seen[lang][g] += 1
    total = {k: sum(seen[k].values()) for k in langs}
    texts = ["the Hund und KATZE, собака дома", "", "x 12 中文 house_of Ελλάδα", "supercalifragilistic " * 3]
    want = []
    for word in L.WORD.findall("\n".join(texts)):
        able = [k for k in langs if written[k][script_of(word)] >= max(0.01 * sum(written[k].values()), 1)]
        logp = {k: sum(np.log((seen[k][g] + 0.2) / (total[k] + 0.2 * L.BUCKETS)) for g in grams_of(word)) for k in able}
        want.append([max(logp[k] - max(logp.values()), -L.MOST) if k in able else -L.MOST if able else 0 for k in langs])
    model = L.fit(labelled(spark))
    got, places, sizes = model.scores(texts)
    assert model.langs == langs and got.shape == (len(want), len(langs))
    assert np.allclose(got, want, atol=1e-3)
    assert ["".join(texts)[a : a + n] for a, n in zip(places, sizes)] == L.WORD.findall("\n".join(texts))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = L.query(spark, SMALL).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def toxic_rows():
    rnd = random.Random(6)
    neutral = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(900):
        text = [rnd.choice(neutral) for _ in range(rnd.randrange(5, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            text[0] = rnd.choice(["idiot", "scum", "moron"])
        if toxic and rnd.random() < 0.6 or rnd.random() < 0.03:
            text[-1] = "muslim"  # a group that the sample abuses more often than others
        rows.append((i, " ".join(text), toxic))
    return rows


def test_classifier_and_counterfactuals(spark):
    df = spark.createDataFrame([(t, x) for _, t, x in toxic_rows()], "text string, toxic int")
    index, w = model = X.fit(df)
    rows = [(1, "you idiot"), (2, "a quiet word1"), (3, "muslim neighbours word3"), (4, None), (5, ""), (1, "you idiot"), (None, "scum"), (6, "word2 " * 50000 + "moron")]
    got = defaultdict(list)
    for r in X.score(spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double"), model).collect():
        got[r.doc_id].append(r.score)
    assert min(*got[1], *got[None], *got[6]) >= 0.7 > max(*got[2], *got[3], *got[4], *got[5]) and len(got[1]) == 2 and got[4] == got[5]
    plain = X.fit(df, penalty=0.0)
    logit = lambda m, word: float(np.dot(*(lambda at, value: (m[1][at], value))(*X.features(word, m[0]))))
    gap = lambda m: abs(logit(m, "muslim") - logit(m, "christian"))
    assert gap(model) < 0.3 * gap(plain)
    alarms = lambda m: int((X.mention_scores(m) >= X.THRESHOLD).sum())
    assert alarms(model) == 0 < alarms(plain)
    assert X.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_scores_against_plain_python(spark):
    rnd = random.Random(1)
    vocabulary = {w: i for i, w in enumerate(["idiot", "idio*", "walk*", "walking", "é"])}
    w = np.array([2.0, 0.5, -1.0, 3.0, 0.25, -1.5])
    texts = [" ".join(rnd.choice(["Idiot", "idiots", "walking", "walked", "walk", "É", "x1y"]) for _ in range(rnd.randrange(0, 20))) for _ in range(50)]
    got = {r.doc_id: r.score for r in X.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (vocabulary, w)).collect()}
    for i, text in enumerate(texts):
        words = [x.lower() for x in text.replace("1", " ").split()]
        counts = [words.count("idiot"), sum(x[:4] == "idio" and len(x) > 4 for x in words), sum(x[:4] == "walk" and len(x) > 4 for x in words), words.count("walking"), words.count("é")]
        logit = -1.5 + sum(a * np.log(1 + min(n, 5)) for a, n in zip(w, counts))
        assert abs(got[i] - 1 / (1 + np.exp(-logit))) < 1e-9


def test_vocabulary_against_plain_python(spark):
    rows = [(t, x) for _, t, x in toxic_rows()]
    seen = defaultdict(lambda: [0, 0, 0, 0])
    for text, toxic in rows:
        words = [w for w in "".join(c if c.isalpha() else " " for c in text).split()]
        names = [*words, *(f"{w[:k]}*" for w in words for k in (4, 5, 6, 7) if len(w) > k)]
        for name in set(names):
            seen[name][1 - toxic] += min(names.count(name), 5)
            seen[name][3 - toxic] += 1
    total = [5 * sum(x for _, x in rows), 5 * sum(1 - x for _, x in rows)]
    seen = {k: v for k, v in seen.items() if v[2] + v[3] >= 3}
    told = {}
    for name, (a, b, in_toxic, _) in seen.items():
        table, n = [[a, b], [total[0] - a, total[1] - b]], sum(total)
        g = 2 * sum(x * np.log(x * n / (sum(table[i]) * total[j])) for i in (0, 1) for j, x in enumerate(table[i]) if x)
        if in_toxic >= 2 and g >= np.log(len(seen)):
            told[name] = g
    df = spark.createDataFrame(rows, "text string, label int").select("label", "text")
    assert X.vocabulary_of(df, 9) == sorted(told, key=lambda k: (-round(told[k], 6), k))[:9] and "idiot" in told


def test_fit_is_near_the_least_loss():
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 3, (80, 4)).astype(float)
    y = (x[:, 0] + rnd.random(80) > 1.4).astype(float)
    change = np.array([[0.0, 0.7, -0.7, 0.0]])
    rows = [SimpleNamespace(label=int(b), at=np.flatnonzero(a).tolist(), value=a[a > 0].tolist()) for a, b in zip(x, y)]

    def loss(w, penalty):
        z = x @ w[:-1] + w[-1]
        return np.mean(np.log1p(np.exp(z)) - y * z) + 5e-5 * w[:-1] @ w[:-1] + penalty * np.mean((change @ w[:-1]) ** 2)

    for penalty in (0.0, 20.0):
        found = X.descend(rows, [([1, 2], [0.7, -0.7], 3)], 4, penalty)
        w = np.zeros(5)
        for _ in range(20_000):  # plain descent along numeric gradients
            w -= 0.05 * np.array([(loss(w + d, penalty) - loss(w - d, penalty)) / 2e-5 for d in 1e-5 * np.eye(5)])
        assert loss(found, penalty) < loss(w, penalty) + 2e-3
    assert abs(found[1] - found[2]) < 0.05


def test_swaps_stay_within_language_and_kind():
    line = {t: set(words.split()) for words in X.IDENTITIES.values() for t in words.split()}
    assert all(set(other) <= line[t] - {t} and other for t, other in X.SWAP.items())
    index = {t: i for i, t in enumerate(X.SWAP)}
    [(at, value), *_] = X.differences("Women and the house", index)
    assert [list(index)[j] for j in at] == ["women", "men"] and abs(sum(value)) < 1e-6
    assert list(X.differences("no term here", index)) == []


def test_held_out_toxic_documents(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    out = X.query(spark, SMALL).filter("held_out").join(labels, "doc_id")
    found = out.agg(F.sum("toxic"), F.expr("count_if(toxic = 1 and predicted = 1)"), F.expr("count_if(toxic = 0 and predicted = 1)")).first()
    assert found[1] >= 0.8 * found[0] and found[2] == 0  # three of the eighteen are junk that holds no toxic word


def test_no_toxic_example_gives_low_scores(spark):
    df = spark.createDataFrame([("some words here", 0), ("other words there", 0), (None, 1)], "text string, toxic int")
    out = X.score(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), X.fit(df)).first()
    assert 0 <= out.score < 0.7
