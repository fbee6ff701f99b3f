"""Language identification of mixed-language texts.

Languages are learned as hashed character n-grams (1 to 3, with word ends) from a bounded sample of labelled rows, along with
the scripts that their words are written in. The script of a word narrows the candidates; each word then has one score per
language, and Viterbi with a penalty for every switch labels spans. A text that no switch can improve is recognised by the
largest gain of any run of words in another language (differences of prefix sums); only the others take the full recursion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import DataFrame

from millrace.llm.hashing import slices
from millrace.llm.scratch import plain, restored, small_batches, tidied

WORD = re.compile(r"[^\W\d_]+")
BITS = 16
BUCKETS = 1 << BITS
PIECE = 1 << 18
PENALTY = 12.0
MOST = 4.0
TRAIN_ROWS = 5000
#: The first code points of Unicode script ranges and the scripts' names.
SCRIPTS = [
    (0x0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Devanagari"),
    (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"),
    (0xE00, "Thai"), (0xE80, "Lao"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Latin"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"),
]
COUNTS = "lang string, kind string, at int, n bigint"


class Alphabet:
    """By code point: is it a letter, and which single code point is its lower case."""

    def __init__(self) -> None:
        points = [chr(i) for i in range(0x110000)]
        self.letter = np.zeros(len(points), bool)
        self.letter[[ord(c) for c in WORD.findall("\n".join(points[:0xD800] + points[0xE000:])) for c in c]] = True
        self.lower = np.arange(len(points), dtype=np.uint32)
        for i in np.flatnonzero(self.letter).tolist():
            low = points[i].lower()
            if len(low) == 1:
                self.lower[i] = ord(low)


def words_of(points: np.ndarray, breaks: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word goes over a break."""
    letter = alphabet.letter[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[1:-1] = letter[1:] != letter[:-1]
    edge[0], edge[-1] = letter[0], letter[-1]
    at = np.flatnonzero(edge)
    inner = np.unique(breaks[(breaks > 0) & (breaks < len(points))])
    inner = inner[letter[inner] & letter[inner - 1]]
    if len(inner):
        at = np.sort(np.concatenate([at, inner, inner]), kind="stable")
    return at[0::2], at[1::2]


def gram_buckets(points: np.ndarray, start: np.ndarray, end: np.ndarray, alphabet: Alphabet) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that begin at each place of the words, all set between < and >, and where each word
    begins there; a gram that would leave its word has the spare bucket BUCKETS."""
    size = end - start
    first = np.cumsum(size + 2) - (size + 2)
    text = np.full(int((size + 2).sum()) + 2, ord("<"), np.uint32)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(first + 1, size) + place] = alphabet.lower[points[np.repeat(start, size) + place]]
    last = first + size + 1
    text[last] = ord(">")
    n = len(text) - 2
    one = text[:n] * np.uint32(0x9E3779B1)
    two = one ^ (text[1 : n + 1] * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F))
    three = two ^ (text[2:] * np.uint32(0xC2B2AE3D) + np.uint32(0x165667B1))
    out = [((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)).astype(np.int32) for x in (one, two, three)]
    out[1][last] = out[2][last] = BUCKETS
    out[2][last - 1] = BUCKETS
    return out, first


def pieces(texts: list[str], alphabet: Alphabet) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(code points, starts and ends of words in them, place of the piece in all texts joined), about PIECE code points at a
    time, cut where no word is."""
    whole = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.cumsum([0, *map(len, texts)])
    at = 0
    while at < len(whole):
        end = min(at + PIECE, len(whole))
        row = int(breaks[np.searchsorted(breaks, end, "right") - 1])
        if end < len(whole) and row > at:
            end = row
        elif end < len(whole):
            gaps = np.flatnonzero(~alphabet.letter[whole[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end  # a word longer than a piece is cut
        part = whole[at:end]
        start, stop = words_of(part, breaks[(breaks >= at) & (breaks <= end)] - at, alphabet)
        if len(start):
            yield part, start, stop, at
        at = end


def scripts_of(points: np.ndarray) -> np.ndarray:
    return np.searchsorted([x for x, _ in SCRIPTS], points, "right") - 1


def count_grams(shared):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = restored(Alphabet, shared.value)
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = (batch.column(i).to_pylist() for i in (0, 1))
            for lang in set(langs):
                for points, start, end, _ in pieces([t for x, t in zip(langs, texts, strict=True) if x == lang], alphabet):
                    grams, _ = gram_buckets(points, start, end, alphabet)
                    own = sum(np.bincount(g, minlength=BUCKETS + 1) for g in grams)[:BUCKETS]
                    counts[lang] = counts.get(lang, 0) + own
                    scripts[lang] = scripts.get(lang, 0) + np.bincount(scripts_of(points[start]), minlength=len(SCRIPTS))
        rows = [(lang, kind, int(at), int(own[at])) for kind, held in (("gram", counts), ("script", scripts)) for lang, own in held.items() for at in np.flatnonzero(own)]
        if rows:
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "kind", "at", "n"])

    return run


class Model:
    """Log probabilities of n-grams by language, and which scripts each language is written in."""

    def __init__(self, rows: list, alphabet: Alphabet, least_share: float = 0.01) -> None:
        names = sorted({name for _, name in SCRIPTS})
        named = np.array([names.index(name) for _, name in SCRIPTS])
        self.alphabet, self.langs = alphabet, sorted({r.lang for r in rows})
        seen = np.zeros((len(self.langs), BUCKETS))
        written = np.zeros((len(self.langs), len(names)))
        for r in rows:
            k = self.langs.index(r.lang)
            if r.kind == "gram":
                seen[k, r.at] += r.n
            else:
                written[k, named[r.at]] += r.n
        self.logp = np.zeros((BUCKETS + 1, len(self.langs)), np.float32)  # the spare bucket says nothing
        self.logp[:BUCKETS] = np.log((seen + 0.2) / (seen.sum(1, keepdims=True) + 0.2 * BUCKETS)).T
        # half way between how well the worst known language tells its own labelled text and chance, and how far grams stray
        own = self.logp[:BUCKETS].T.astype(np.float64)
        total = np.maximum(seen.sum(1), 1)
        mean = (seen * own).sum(1) / total
        self.level = float((mean.min(initial=0.0) - np.log(BUCKETS)) / 2)
        self.stray = float(np.sqrt(np.maximum((seen * own**2).sum(1) / total - mean**2, 0)).max(initial=0.0))
        self.able = (written >= np.maximum(least_share * written.sum(1, keepdims=True), 1)).T[named]

    def scores(self, texts: list[str], told: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all words in order (at most 0, at least -MOST; languages of other scripts have the least; all 0 when no
        language has the script), the words' places in the texts joined, and their lengths. To ``told`` is added, for each word,
        the log probability of its n-grams in the likeliest language of its script, or nan if no language has that."""
        out, places, sizes = [], [], []
        for points, start, end, at in pieces(texts, self.alphabet):
            grams, first = gram_buckets(points, start, end, self.alphabet)
            sums = self.logp.take(grams[0], axis=0)
            sums += self.logp.take(grams[1], axis=0)
            sums += self.logp.take(grams[2], axis=0)
            own = np.add.reduceat(sums, first, axis=0)
            able = self.able[scripts_of(points[start])]
            best = np.where(able, own, -np.inf).max(1, keepdims=True, initial=-1e9)
            if told is not None:
                told.append(np.where(able.any(1), best[:, 0], np.nan))
            own -= best
            own = np.where(able, np.maximum(own, -MOST), -MOST)
            own[~able.any(1)] = 0
            out.append(own.astype(np.float32))
            places.append(start + at)
            sizes.append(end - start)
        if not out:
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out), np.concatenate(places), np.concatenate(sizes)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word when every switch costs the penalty; ties stay, then take the first language."""
    tops, moved, best = [], [], scores[0].tolist()
    for row in scores[1:].tolist():
        top = max(best)
        least = top - penalty
        tops.append(best.index(top))
        moved.append([x < least for x in best])
        best = [(least if x < least else x) + s for x, s in zip(best, row, strict=True)]
    at = best.index(max(best))
    path = [at]
    for top, moves in zip(reversed(tops), reversed(moved), strict=True):
        at = top if moves[at] else at
        path.append(at)
    return np.array(path[::-1])


def label(scores: np.ndarray, penalty: float) -> np.ndarray | int:
    """One language's index if no switch pays, else a language for each word."""
    top = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, top : top + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
    # a run inside the text costs a switch for each of its languages; languages that cover the whole text cost one switch less
    ends = max(gain.max(), 0.0) + max((gain[-1] - low).max(), 0.0)
    if (gain - low).max() <= penalty and ends <= penalty:
        return top
    path = viterbi(scores, penalty)
    return int(path[0]) if (path == path[0]).all() else path


def identified(own: np.ndarray, place: np.ndarray, size: np.ndarray, length: int, model: Model, penalty: float) -> tuple[str, float, list[dict]]:
    if not len(own) or not model.langs:
        return "und", 0.0, []
    path = label(own, penalty)
    if isinstance(path, int):
        sure = own.mean(0) * min(len(own), 20)
        return model.langs[path], float(min(1 / np.exp(sure - sure[path]).sum(), 1.0)), [{"start": 0, "end": length, "lang": model.langs[path]}]
    weight = np.bincount(path, size, len(model.langs))
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist()]
    ends = [0, *(int(place[c]) for c in cuts[1:]), length]
    spans = [{"start": ends[j], "end": ends[j + 1], "lang": model.langs[path[c]]} for j, c in enumerate(cuts)]
    return model.langs[int(weight.argmax())], float(weight.max() / weight.sum()), spans


def supported(told: np.ndarray, size: np.ndarray, model: Model) -> bool:
    """Whether the words are of a learned language: at least half of the letters are in a script of one, and the words' n-grams
    are as likely as the model's level, less three standard errors of a mean of so many."""
    known = ~np.isnan(told)
    if not len(told) or 2 * size[known].sum() < size.sum():
        return False
    grams = 3 * int((size[known] + 1).sum())  # of size letters and two ends: size + 2, size + 1 and size
    return bool(told[known].sum() / grams >= model.level - 3 * model.stray / np.sqrt(grams))


def identify(shared, penalty: float, at: int, evidence: bool = False):
    """Appends lang_pred, score and spans to the columns, of which number ``at`` is the text, and supported if asked for."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = restored(Model, shared.value)
        model.alphabet = restored(Alphabet, model.alphabet)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            for part in slices(batch, at, PIECE):
                texts = [x or "" for x in part.column(at).to_pylist()]
                told: list | None = [] if evidence else None
                scores, place, size = model.scores(texts, told)
                begin = np.cumsum([0, *map(len, texts)])
                word = np.searchsorted(place, begin)
                found = [identified(scores[a:b], place[a:b] - begin[i], size[a:b], len(texts[i]), model, penalty) for i, (a, b) in enumerate(zip(word, word[1:], strict=False))]
                columns = [*part.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], span)]
                names = [*part.schema.names, "lang_pred", "score", "spans"]
                if evidence:
                    each = np.concatenate(told) if told else np.zeros(0)
                    columns.append(pa.array([supported(each[a:b], size[a:b], model) for a, b in zip(word, word[1:], strict=False)], pa.bool_()))
                    names.append("supported")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """From columns doc_id, text and lang. ``train_rows`` bounds how many rows are learned from, whatever the table's size."""
    known = labelled.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    n = known.select("doc_id").count()
    if n > train_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * train_rows / n)))
    small_batches(labelled.sparkSession)
    alphabet = Alphabet()
    counts = known.select("lang", "text").mapInArrow(count_grams(labelled.sparkSession.sparkContext.broadcast(plain(alphabet))), COUNTS).groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))
    return Model(counts.collect(), alphabet)  # at most languages * (BUCKETS + scripts) rows


def annotate(df: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY, evidence: bool = False) -> DataFrame:
    """df with lang_pred, score and spans (characters start to end - 1 and their language) added; columns of these names that
    it has are replaced.

    lang_pred is the language of most letters; ``und`` with score 0 and no spans if the text is null or has no letter, or if
    nothing was learned. The score is the share of letters in that language if there are several; else its probability against
    the others over up to 20 average words, so short texts are less sure. Whole texts of any length are read; ties take the
    language that is first by name. Repeated rows come out repeated, null ids as null; an empty table gives no rows.
    With ``evidence`` a column supported is added: whether any learned language explains the text, which the score, a comparison
    of the languages with each other, does not say."""
    small_batches(df.sparkSession)
    rows = df.drop("lang_pred", "score", "spans", *(["supported"] if evidence else []))
    shared = df.sparkSession.sparkContext.broadcast(plain(model))
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>" + (", supported boolean" if evidence else "")).fields])
    return rows.mapInArrow(identify(shared, penalty, rows.columns.index(text_col), evidence), schema)


def held_out(modulus: int, remainder: int, id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def trained(df: DataFrame, id_col: str = "doc_id") -> Model:
    return fit(df.filter(~held_out(4, 2, id_col)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = annotate(docs.select("doc_id", "text"), trained(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
