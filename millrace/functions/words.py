"""Words of scripts that are written without spaces: a dictionary learned from counts, and best paths through the word graph.

A run of such letters is a graph whose nodes are the places between them and whose edges are the dictionary's words; single
letters are edges too. The words of a run are the path of highest probability, words being drawn one by one as often as they
were counted. Weights are whole numbers, so the best path doesn't depend on the order of sums; among equals the longer first
word wins."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import ArrayType, StringType

from millrace.sources.scratch import stored

#: Han, Hiragana, Katakana, Thai, Lao, Myanmar and Khmer, with the marks of their letters.
LETTERS = "㐀-䶿一-鿿豈-﫿ぁ-ゟァ-ヿㇰ-ㇿก-ฺเ-๎ກ-ຽເ-ໍက-ဿក-៓"
RUN = f"[{LETTERS}]+"
#: Letters of a word at most (a word is a key of 64 bits, 16 a letter), and what its count must be times what chance would give
#: its two parts, at least.
LONGEST, COHESION = 4, 10.0
SCALE = 1_000_000
#: Letters that a task cuts at once and that it counts at once, distinct strings that it counts before it passes them on, and
#: runs that go on one by one.
CUT_AT_ONCE, AT_ONCE, COUNTED, FEW = 1 << 18, 1 << 20, 1 << 21, 8
#: The weight of a string that is no word.
NONE = -(1 << 50)


def parts(text: Column) -> Column:
    """Lower-case runs of letters without spaces, and words of other letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"({RUN}|(?:(?![{LETTERS}])[\p{{L}}\p{{N}}])+)"))


def keys_of(codes: np.ndarray) -> Iterator[np.ndarray]:
    """codes: letters as numbers, 0 behind each run. For lengths from 1 to LONGEST the key of what begins at each place, 0 where
    the run ends before."""
    key, left = np.zeros(len(codes), np.uint64), np.append(codes, np.zeros(LONGEST, codes.dtype)).astype(np.uint64)
    for k in range(LONGEST):
        letter = left[k : k + len(codes)]
        key = np.where((letter > 0) & ((key > 0) | (k == 0)), (key << np.uint64(16)) | letter, np.uint64(0))
        yield key


def codes_of(runs: list[str]) -> np.ndarray:
    return np.frombuffer("\0".join([*runs, ""]).encode("utf-16-le"), "<u2")


def portions(runs: list[str]) -> Iterator[list[str]]:
    """The runs in order, about AT_ONCE letters at a time."""
    ends = np.cumsum([len(x) for x in runs]) // AT_ONCE
    cuts = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1], [True]])) if runs else []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield runs[lo:hi]


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs to (key, n): the strings of up to LONGEST letters in them."""
    keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for runs in portions(batch["run"].tolist()):
            found = [np.unique(key[key > 0], return_counts=True) for key in keys_of(codes_of(runs))]
            keys, at = np.unique(np.concatenate([keys, *(x for x, _ in found)]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, *(c for _, c in found)]), len(keys)).astype(np.int64)
            if len(keys) > COUNTED:
                yield pd.DataFrame({"key": keys.view(np.int64), "n": n})
                keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield pd.DataFrame({"key": keys.view(np.int64), "n": n})


@F.pandas_udf(StringType())
def word_of(keys: pd.Series) -> pd.Series:
    return keys.map(lambda key: (key & (1 << 64) - 1).to_bytes(8, "big").decode("utf-16-be").lstrip("\0"))


def learned(texts: DataFrame, least: int = 5, most_words: int = 200_000) -> DataFrame:
    """texts: (text). (word, n): single letters, and longer strings of one run that come up ``least`` times or more and hold
    together at every place; the ``most_words`` most frequent, for a dictionary is sent to every task."""
    runs = texts.select(F.explode(F.filter(parts(F.col("text")), lambda x: F.regexp_like(x, F.lit(f"^{RUN}$")))).alias("run"))
    counts = runs.mapInPandas(counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    counts = stored(counts.filter((F.col("n") >= least) | F.col("key").between(0, 0xFFFF)).select(word_of("key").alias("word"), "n"), "words")
    total = counts.filter(F.length("word") == 1).agg(F.sum("n").alias("total"))
    cuts = counts.filter(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    cuts = cuts.select("word", "n", F.expr("substring(word, 1, k)").alias("a"), F.expr("substring(word, k + 1)").alias("b"))
    known = lambda name: counts.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    tied = cuts.join(known("a"), "a").join(known("b"), "b").crossJoin(F.broadcast(total))  # total is one row
    firm = tied.groupBy("word").agg(F.min(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("ratio")).filter(F.col("ratio") >= COHESION).select("word")
    kept = counts.join(firm, "word", "left_semi").unionByName(counts.filter(F.length("word") == 1))
    return kept.orderBy(F.desc("n"), "word").limit(most_words)


def weights_of(counts: dict[str, int]) -> dict[str, int]:
    total = sum(counts.values())
    return {w: round(SCALE * math.log(n / total)) for w, n in counts.items()}


def best_path(run: str, weights: dict[str, int], unknown: int) -> list[str]:
    """The words of a run, from its end to its beginning: of each place the best weight of what follows, and its first word."""
    size = len(run)
    best, word = [0] * (size + 1), [""] * (size + 1)
    for at in range(size - 1, -1, -1):
        found = None
        for end in range(min(size, at + LONGEST), at, -1):  # longer ones first
            w = weights.get(run[at:end], unknown if end == at + 1 else None)
            if w is not None and (found is None or w + best[end] > found):
                found, word[at] = w + best[end], run[at:end]
        best[at] = found
    out, at = [], 0
    while at < size:
        out.append(word[at])
        at += len(word[at])
    return out


def hashed(weights: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The words' keys and weights in a table of open addresses."""
    size = 1 << max(4, (4 * len(weights)).bit_length())
    keys, values = np.zeros(size, np.uint64), np.full(size, NONE)
    own = {w: x for w, x in weights.items() if 0 < len(w) <= LONGEST and max(w) <= "\uffff"}
    key = np.array([int.from_bytes(w.encode("utf-16-be"), "big") for w in own], np.uint64)
    at, value, left = slots(key, size), np.array([*own.values()], np.int64), np.arange(len(own))
    while len(left):
        free = left[keys[at[left]] == 0]
        keys[at[free]] = key[free]  # of several the last stays
        sits = keys[at[left]] == key[left]
        values[at[left[sits]]] = value[left[sits]]
        left = left[~sits]
        at[left] = (at[left] + 1) % size
    return keys, values


def slots(key: np.ndarray, size: int) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def looked_up(key: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, values = table
    at = slots(key, len(keys))
    held = keys[at]
    out = np.where((held == key) & (key > 0), values[at], NONE)
    left = np.flatnonzero((held != key) & (held > 0) & (key > 0))
    while len(left):
        at[left] = (at[left] + 1) % len(keys)
        held = keys[at[left]]
        same = held == key[left]
        out[left[same]] = values[at[left[same]]]
        left = left[~same & (held > 0)]
    return out


def best_steps(runs: list[str], table: tuple[np.ndarray, np.ndarray], unknown: int) -> list[int]:
    """``best_path`` of many runs: one place of each at a time, all from their ends; the last FEW, if longer, one by one. Of each
    place, and of the one behind each run, how many letters the first word from there has."""
    codes = codes_of(runs)
    weights = [looked_up(key, table) for key in keys_of(codes)]
    weights[0][(weights[0] == NONE) & (codes > 0)] = unknown
    best, size = np.zeros(len(codes) + LONGEST, np.int64), np.ones(len(codes), np.int8)
    lengths = np.array([len(x) for x in runs])
    ends = np.cumsum(lengths + 1) - 1
    order = np.argsort(-lengths, kind="stable")
    ends, lengths = ends[order], lengths[order]
    j = 1
    while (active := int(np.searchsorted(-lengths, -j, side="right"))) > FEW:
        p = ends[:active] - j
        found, word = weights[LONGEST - 1][p] + best[p + LONGEST], np.full(active, LONGEST, np.int8)
        for k in range(LONGEST - 1, 0, -1):  # longer ones first
            other = weights[k - 1][p] + best[p + k]
            more = other > found
            found, word = np.where(more, other, found), np.where(more, np.int8(k), word)
        best[p], size[p] = found, word
        j += 1
    for end, length in zip(ends[:active].tolist(), lengths[:active].tolist(), strict=True):
        own = [w[end - length : end].tolist() for w in weights]
        after = best[end - j + 1 : end - j + 1 + LONGEST].tolist()  # of the next places
        for at in range(length - j, -1, -1):
            found, word = own[LONGEST - 1][at] + after[LONGEST - 1], LONGEST
            for k in range(LONGEST - 1, 0, -1):
                if own[k - 1][at] + after[k - 1] > found:
                    found, word = own[k - 1][at] + after[k - 1], k
            after = [found, *after[: LONGEST - 1]]
            size[end - length + at] = word
    return size.tolist()


def best_paths(runs: list[str], table: tuple[np.ndarray, np.ndarray], unknown: int) -> list[list[str]]:
    """``best_path`` of many runs."""
    out, start, steps = [], 0, best_steps(runs, table, unknown)
    for run in runs:
        words, at = [], 0
        while at < len(run):
            words.append(run[at : at + steps[start + at]])
            at += steps[start + at]
        out.append(words)
        start += len(run) + 1
    return out


def begins_of(runs: list[str], table: tuple[np.ndarray, np.ndarray], unknown: int) -> Iterator[np.ndarray]:
    """Of each run the places where its words begin."""
    start, steps = 0, best_steps(runs, table, unknown) if runs else []
    for run in runs:
        begins, at, end = [], start, start + len(run)
        while at < end:
            begins.append(at)
            at += steps[at]
        yield np.array(begins, np.int64) - start
        start = end + 1


def cut_strings(column: pa.Array, table: tuple[np.ndarray, np.ndarray], unknown: int) -> pa.Array:
    """Lists of strings, as ``parts`` gives them, to lists of words. The words share the bytes of the strings, only where they
    begin is new; besides that CUT_AT_ONCE letters are held as strings, or one longer string."""
    own, flat = re.compile(f"[{LETTERS}]").match, column.flatten()
    offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    n, whole, begins = np.zeros(len(flat), np.int64), np.zeros(1, np.int64), [np.zeros(0, np.int32)]
    ends = np.cumsum(np.diff(offsets), dtype=np.int64) // (3 * CUT_AT_ONCE)  # these letters have three bytes each
    cuts = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1], [True]])).tolist() if len(flat) else []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        strings = flat.slice(lo, hi - lo).to_pylist()
        runs = [*dict.fromkeys(x for x in strings if own(x))]
        known = dict(zip(runs, begins_of(runs, table, unknown), strict=True))
        found = [known.get(x, whole) for x in strings]
        n[lo:hi] = [len(x) for x in found]
        begins.append((np.concatenate(found) * 3 + np.repeat(offsets[lo:hi], n[lo:hi])).astype(np.int32))
    last = np.concatenate([*begins, offsets[-1:]])
    values = pa.StringArray.from_buffers(len(last) - 1, pa.py_buffer(last), flat.buffers()[2] or pa.py_buffer(b"")) if len(flat) else flat
    lists = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = np.concatenate([[0], np.cumsum(n)])[lists]  # where each list begins
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values, mask=pc.is_null(column))


def segmenter(words: DataFrame) -> Callable[[Column], Column]:
    """words: (word, n), as ``learned`` gives it. A function for Params.segment: from ``parts`` to words."""
    counts = {r.word: r.n for r in words.collect()}  # at most most_words
    weights = weights_of(counts)
    shared = words.sparkSession.sparkContext.broadcast((hashed(weights), min(weights.values(), default=0) - SCALE))

    @F.arrow_udf(ArrayType(StringType()))
    def cut(column: pa.Array) -> pa.Array:
        return cut_strings(column, *shared.value)

    return lambda found: cut(found)
