"""A counterfactually regularised toxicity classifier.

Logistic regression over words and word beginnings, learned from a bounded sample of labelled rows. Every sampled sentence that
holds an identity term, and neutral sentences made from templates, are paired with copies in which the term is swapped for
others of its language and kind, and squared changes of the score between the two are penalised, so that mentioning a group
does not move a score by itself. The vocabulary is what tells the labels apart best: likelihood ratios above what chance gives
among so many candidates; the fit runs on the sample's sparse rows, and every whole text is then scored by Spark.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Row

from millrace.llm.hashing import slices
from millrace.llm.language_id import held_out
from millrace.llm.scratch import materialize, small_batches, tidied

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
TRAIN_ROWS = 20_000
VOCABULARY = 2000
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6, 7)
MOST = 5
SWAPS = 3
PENALTY = 20.0
#: Terms that name groups, by language and kind; a term is swapped with the others of its line.
IDENTITIES = {
    ("en", "gender"): "women men girls boys",
    ("en", "person"): "woman man",
    ("en", "belief"): "muslims christians jews hindus buddhists atheists",
    ("en", "believer"): "muslim christian jewish hindu buddhist atheist",
    ("en", "origin"): "black white asian african european american arab latino",
    ("en", "status"): "immigrants refugees",
    ("en", "newcomer"): "immigrant refugee",
    ("en", "orientation"): "gay lesbian straight transgender bisexual",
    ("en", "body"): "disabled deaf blind old young",
    ("de", "gender"): "frauen männer",
    ("de", "person"): "frau mann",
    ("de", "belief"): "muslime christen juden",
    ("de", "origin"): "schwarze weiße asiaten einwanderer flüchtlinge",
    ("fr", "gender"): "femmes hommes",
    ("fr", "person"): "femme homme",
    ("fr", "belief"): "musulmans chrétiens juifs",
    ("fr", "origin"): "noirs blancs asiatiques immigrés réfugiés",
    ("es", "gender"): "mujeres hombres",
    ("es", "person"): "mujer hombre",
    ("es", "belief"): "musulmanes cristianos judíos",
    ("es", "origin"): "negros blancos asiáticos inmigrantes refugiados",
}
#: Neutral sentences that mention a group.
NEUTRAL = {
    "en": ["many {} live in this town", "the {} neighbours came to dinner", "a book about {} people and their history"],
    "de": ["viele {} leben in dieser stadt", "ein buch über {} und ihre geschichte"],
    "fr": ["beaucoup de {} vivent dans cette ville", "un livre sur les {} et leur histoire"],
    "es": ["muchos {} viven en esta ciudad", "un libro sobre {} y su historia"],
}
SWAP = {term: [line[(k + j) % len(line)] for j in range(1, min(SWAPS, len(line) - 1) + 1)] for line in map(str.split, IDENTITIES.values()) for k, term in enumerate(line)}
WORDS = "word string, toxic bigint, clean bigint, toxic_rows bigint, clean_rows bigint"
ROWS = "label int, at array<int>, value array<float>"
DIFFERENCES = "at array<int>, value array<float>"


def names_of(word: str) -> list[str]:
    """The features of a word: itself and its beginnings, for insults are inflected."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By feature and label: occurrences, at most MOST of a row, and rows."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own: Counter = Counter()
            for word, n in Counter(WORD.findall(text.lower())).items():
                for name in names_of(word):
                    own[name] += n
            for name, n in own.items():
                held = counts.setdefault(name, [0, 0, 0, 0])
                held[1 - label] += min(n, MOST)
                held[3 - label] += 1
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), *(pa.array(x, pa.int64()) for x in zip(*counts.values(), strict=True))], ["word", "toxic", "clean", "toxic_rows", "clean_rows"])


def features(text: str, vocabulary: dict[str, int]) -> tuple[list[int], list[float]]:
    """Indexes of known features and log(1 + count), counts beyond MOST as MOST, for a long text is no more toxic for its length."""
    found: dict[int, int] = {}
    for word, n in Counter(WORD.findall(text.lower())).items():
        for name in names_of(word):
            j = vocabulary.get(name)
            if j is not None:
                found[j] = found.get(j, 0) + n
    return list(found), [math.log1p(min(n, MOST)) for n in found.values()]


def differences(sentence: str, vocabulary: dict[str, int]) -> Iterator[tuple[list[int], list[float]]]:
    """What swapping the identity terms of a sentence, each for the next ones of its line, changes in its features."""
    words = WORD.findall(sentence.lower())
    terms = [w for w in words if w in SWAP]
    for k in range(max((len(SWAP[w]) for w in terms), default=0)):
        change = dict(zip(*features(sentence, vocabulary), strict=True))
        swapped = " ".join(SWAP[w][k % len(SWAP[w])] if w in SWAP else w for w in words)
        for j, v in zip(*features(swapped, vocabulary), strict=True):
            change[j] = change.get(j, 0.0) - v
        change = {j: v for j, v in sorted(change.items()) if v}
        if change:
            yield list(change), list(change.values())


def neutral_sentences() -> list[str]:
    return [form.format(term) for (language, _), line in IDENTITIES.items() for term in line.split() for form in NEUTRAL[language]]


def sparse_rows(shared):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        kind = pa.schema([("label", pa.int32()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])
        for batch in batches:
            rows = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, value = features(text, vocabulary)
                rows.append({"label": label, "at": at, "value": value})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return run


def swap_rows(shared):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        kind = pa.schema([("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                if SWAP.keys().isdisjoint(WORD.findall(text.lower())):
                    continue
                rows += [{"at": at, "value": value} for sentence in SENTENCE.split(text) for at, value in differences(sentence, vocabulary)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return run


class Sparse:
    """Rows of (columns, values), enough for products with a vector from either side."""

    def __init__(self, rows: list[tuple], width: int) -> None:
        self.n, self.width = len(rows), width
        sizes = [len(at) for at, _ in rows]
        self.row = np.repeat(np.arange(self.n), sizes)
        self.at = np.fromiter((x for at, _ in rows for x in at), np.int64, sum(sizes))
        self.value = np.fromiter((x for _, v in rows for x in v), np.float64, sum(sizes))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * r[self.row], self.width)


def descend(rows: list, swaps: list, width: int, penalty: float = PENALTY, ridge: float = 1e-4, steps: int = 400) -> np.ndarray:
    """Weights, the intercept last: log loss + ridge + penalty * mean squared change of the logit under swaps, by Adam.
    rows: (label, at, value); swaps: (at, value, n)."""
    x = Sparse([(r.at, r.value) for r in rows], width)
    y = np.array([r.label for r in rows], float)
    change = Sparse([(at, value) for at, value, _ in swaps], width)
    times = np.array([n for _, _, n in swaps], float)
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + b, -30, 30)))
        r = (p - y) / max(len(y), 1)
        grad = np.append(x.back(r) + ridge * w, r.sum())
        if change.n:
            grad[:-1] += change.back(change.dot(w) * times * (2 * penalty / times.sum()))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return np.append(w, b)


def likelihood_ratio(a, b, toxic, clean):
    """2 log of the likelihood ratio of a and b occurrences among so many of each label."""
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / share)).otherwise(0.0)
    rate, both = toxic / (toxic + clean), a + b
    rest = toxic + clean - both
    return 2 * (part(a, both * rate) + part(b, both * (1 - rate)) + part(toxic - a, rest * rate) + part(clean - b, rest * (1 - rate)))


def vocabulary_of(sample: DataFrame, most: int) -> list[str]:
    """The features whose likelihood ratio is beyond chance among so many, of two toxic rows and three rows at least."""
    total = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("toxic"), F.count("*").alias("n")).first()
    if not 0 < total.toxic < total.n:
        return []
    words = sample.mapInArrow(count_words, WORDS).groupBy("word").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_rows", "clean_rows")))
    words = materialize(words.filter("toxic_rows + clean_rows >= 3"), "toxicity-words")
    tested = max(words.count(), 2)
    g = likelihood_ratio(F.col("toxic").cast("double"), F.col("clean").cast("double"), F.lit(float(MOST * total.toxic)), F.lit(float(MOST * (total.n - total.toxic))))
    told = words.filter("toxic_rows >= 2").withColumn("g", g).filter(F.col("g") >= math.log(tested))
    return [r.word for r in told.orderBy(F.desc("g"), "word").limit(most).collect()]


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, vocabulary: int = VOCABULARY, penalty: float = PENALTY) -> tuple[dict[str, int], np.ndarray]:
    """From (toxic, text) rows, at most about ``train_rows`` of them; gives the vocabulary and its weights. Labels other than
    0 and 1 and null texts teach nothing; without both labels the vocabulary is the identity terms alone."""
    small_batches(labelled.sparkSession)
    sample = labelled.filter("toxic in (0, 1) and text is not null").select(F.col("toxic").cast("int").alias("label"), "text")
    index = {w: i for i, w in enumerate(dict.fromkeys([*vocabulary_of(sample, vocabulary), *SWAP]))}
    shared = labelled.sparkSession.sparkContext.broadcast(index)
    rows = sample.mapInArrow(sparse_rows(shared), ROWS).collect()  # bounded by train_rows and the vocabulary
    rows.append(Row(label=0, at=[], value=[]))  # a text that says nothing is not toxic
    rows.sort(key=lambda r: (r.label, r.at, r.value))
    seen = sample.mapInArrow(swap_rows(shared), DIFFERENCES).groupBy("at", "value").agg(F.count("*").alias("n")).collect()  # few: a swap changes the features of its terms alone
    swaps = [(at, value, 1) for sentence in neutral_sentences() for at, value in differences(sentence, index)]
    swaps += sorted((list(r["at"]), list(r.value), r.n) for r in seen)
    return index, calibrated(rows, descend(rows, swaps, len(index), penalty))


def mention_scores(model: tuple[dict[str, int], np.ndarray]) -> np.ndarray:
    """Scores of the neutral sentences that mention a group: those of THRESHOLD or more are false alarms."""
    index, w = model
    return np.array([probability(w, *features(x, index)) for x in neutral_sentences()])


def probability(w: np.ndarray, at: list[int], value: list[float]) -> float:
    logit = w[-1] + np.dot(w[at], value) if at else w[-1]
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def calibrated(rows: list, weights: np.ndarray) -> np.ndarray:
    """The intercept moved so that THRESHOLD is where the sample's labels part best: in the gap between two neighbouring logits
    with the fewest errors (the first such gap from above), a third up from its lower end, for rows that were not learned from
    hold fewer of the known features."""
    x = Sparse([(r.at, r.value) for r in rows], len(weights) - 1)
    logit, label = x.dot(weights[:-1]) + weights[-1], np.array([r.label for r in rows])
    if not label.any() or label.all():
        return weights
    order = np.argsort(-logit, kind="stable")
    logit, label = logit[order], label[order]
    errors = label.sum() - np.cumsum(2 * label - 1)[:-1]
    gap = np.flatnonzero(logit[:-1] > logit[1:])
    if not len(gap):
        return weights
    cut = gap[errors[gap].argmin()]
    return np.append(weights[:-1], weights[-1] - (logit[cut] + 2 * logit[cut + 1]) / 3 + np.log(THRESHOLD / (1 - THRESHOLD)))


def sampled(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(toxic, text) of labelled documents, at most about ``train_rows``, chosen by a hash of the id. The chosen labels are few
    by that bound, so they are broadcast and no text is shuffled."""
    n = labels.count()
    chosen = labels.select("doc_id", "toxic").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(min(1 << 30, int((1 << 30) * train_rows / max(n, 1)))))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def score(df: DataFrame, model: tuple[dict[str, int], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of df; null and empty texts get the score of a text without known words. Repeated rows and
    null ids come out as they are; an empty table gives no rows."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, w = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in part.column(1).to_pylist():
                    out.append(probability(w, *features(text or "", vocabulary)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(sampled(docs, labels.filter(~held_out(3, 1))))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
