"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds no postings. Every document has a Bloom signature of its terms, with a term once for each level of frequency
that it reaches (1, 2, 3, 4, 6, 8, 12 ...). Signatures of documents with about as many entries are stored across: a block is
one bitmap over its documents for every bit of the signature. The bitmaps of a term's bits, and-ed, show the documents that
may hold it, and those of its levels how often at most; so the weighted sum over a query's terms is at least the score, and is
the score itself but for false positives and for frequencies between two levels.

A search sums these bounds for all documents, rescores the best few of each item from their texts, and so learns a score that
the item's k-th hit can't fall short of. Every document whose bound reaches it is then rescored from its text; all others are
provably no hits. Scores are integers, so there are no roundings to allow for.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from millrace.llm.hashing import mix, slices, word_hashes
from millrace.llm.scratch import materialize, plain, restored, small_batches, tidied

#: Bits of a signature for each entry, at least (twice as many at most), bits that an entry sets, and bytes of a block.
BITS, SET, BLOCK = 8, 3, 1 << 20
#: Frequencies from which on a term has one entry more.
LEVELS = sorted({x << k for x in (2, 3) for k in range(30)} | {1})
#: Documents of a block at most, terms of which a task keeps counts, bytes of items sent at a time, and keys broadcast at most.
DOCUMENTS, VOCABULARY, ITEM_BYTES, SENT_KEYS = 1024, 200_000, 1 << 19, 1 << 20
#: Documents per hit wanted that are rescored to learn a score that hits must reach.
FIRST = 4
_U = np.uint64
_BETWEEN = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
SPACE = np.zeros(256, bool)
SPACE[_BETWEEN] = True
FOLDED = bytes(32 if b in set(_BETWEEN) else b + 32 if 65 <= b <= 90 else b for b in range(256))

ROWS = "bits int, documents int, terms bigint, keys binary, sizes binary, slices binary, term binary, df bigint"
HITS = "item int, doc_id bigint, score bigint"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(FOLDED).split()


def entry_bits(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bits of entries (rows) in signatures of a power of two of bits."""
    h = mix(hashes + _U(level * 0x9E3779B97F4A7C15 % 2**64))
    return ((h[:, None] + np.arange(SET, dtype=np.uint64) * ((h >> _U(32)) | _U(1))[:, None]) & _U(bits - 1)).astype(np.int64)


class Block:
    """Signatures of one width under construction, as bitmaps over documents."""

    def __init__(self, bits: int) -> None:
        self.bits, self.most = bits, max(8, min(DOCUMENTS, BLOCK * 8 // bits))
        self.slices, self.keys, self.sizes = np.zeros((bits, self.most // 8), np.uint8), [], []

    def add(self, key: int, size: int, rows: np.ndarray) -> bool:
        j = len(self.keys)
        self.slices[rows, j >> 3] |= np.uint8(128 >> (j & 7))
        self.keys.append(key)
        self.sizes.append(size)
        return j + 1 == self.most

    def row(self) -> dict:
        used = np.ascontiguousarray(self.slices[:, : -(-len(self.keys) // 8)])
        return {"bits": self.bits, "documents": len(self.keys), "terms": sum(self.sizes), "keys": np.array(self.keys, "<i8").tobytes(), "sizes": np.array(self.sizes, "<i8").tobytes(), "slices": used.tobytes()}


_SCHEMA = pa.schema([("bits", pa.int32()), ("documents", pa.int32()), ("terms", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("slices", pa.binary()), ("term", pa.binary()), ("df", pa.int64())])


@tidied
def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) to blocks, and to terms with the documents of this task that hold them. Documents without terms are in none."""
    blocks: dict[int, Block] = {}
    counts: Counter = Counter()

    def counted() -> pa.RecordBatch:
        n = len(counts)
        return pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in _SCHEMA.types[:6]), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=_SCHEMA)

    for batch in batches:
        for part in slices(batch, "text"):
            words, begin = word_hashes(part.column("text"), SPACE)
            full = []
            for i, (key, text) in enumerate(zip(*(c.to_pylist() for c in part.columns), strict=True)):
                own = words[begin[i] : begin[i + 1]]
                if not len(own):
                    continue
                counts.update(set(terms_of(text)))
                hashes, tf = np.unique(own, return_counts=True)
                levels, most = [hashes], int(tf.max())
                for level in LEVELS[1:]:
                    if level > most:
                        break
                    levels.append(hashes[tf >= level])
                bits = BITS << max(3, (sum(map(len, levels)) - 1).bit_length())
                rows = np.concatenate([entry_bits(h, k, bits).ravel() for k, h in enumerate(levels)])
                block = blocks.get(bits)
                if block is None:
                    block = blocks[bits] = Block(bits)
                if block.add(key, len(own), rows):
                    full.append(blocks.pop(bits).row())
            if full:
                yield pa.RecordBatch.from_pylist(full, schema=_SCHEMA)
            if len(counts) > VOCABULARY:
                yield counted()
                counts.clear()
    for block in blocks.values():
        yield pa.RecordBatch.from_pylist([block.row()], schema=_SCHEMA)
    if counts:
        yield counted()


@dataclass
class Index:
    """blocks: signatures; vocabulary: (term binary, df); documents, terms: those with at least one term, and all their terms."""

    blocks: DataFrame
    vocabulary: DataFrame
    documents: int
    terms: int


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, text). Equal rows have one key; should others share it too, they are only rescored in vain."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def index_of(rows: DataFrame) -> Index:
    """rows: of ``keyed``. One pass over the texts; the vocabulary is counted in tasks before it is shuffled."""
    small_batches(rows.sparkSession)
    made = materialize(rows.select("key", "text").mapInArrow(signatures, ROWS), "signatures")
    vocabulary = materialize(made.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df")), "vocabulary")
    blocks = made.filter("bits is not null").select("bits", "documents", "terms", "keys", "sizes", "slices")
    totals = blocks.agg(F.sum("documents").alias("n"), F.sum("terms").alias("l")).first()
    return Index(blocks, vocabulary, totals.n or 0, totals.l or 0)


class Asked:
    """Items of a block. weights: of the terms that some document holds; items: for each its terms' numbers, with repeats."""

    def __init__(self, items: list[list[bytes]], df: dict[bytes, int], documents: int, terms: int) -> None:
        self.documents, self.terms = documents, terms
        self.names = sorted({t for own in items for t in own if t in df})
        number = {t: i for i, t in enumerate(self.names)}
        self.number = number
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) for t in self.names], np.int64)
        self.items = [Counter(number[t] for t in own if t in number) for own in items]

    def length_factor(self, size):
        return 25 + (75 * size * self.documents) // self.terms


def bounds_of(asked: Asked, hashes: np.ndarray, bits: int, sizes: np.ndarray, slices_: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores, a row per item and a column per document of the block. hashes: of the asked terms."""
    n = len(sizes)
    m = np.array([asked.length_factor(int(x)) for x in sizes], np.int64)
    may = np.zeros((len(hashes), slices_.shape[1]), np.uint8)
    alive, most, level = np.arange(len(hashes)), np.zeros((len(hashes), n), np.int64), 0
    while len(alive):
        shown = np.bitwise_and.reduce(slices_[entry_bits(hashes[alive], level, bits)], axis=1)
        if level:
            shown &= may[alive]
        may[alive] = shown
        some = shown.any(1)
        alive = alive[some]
        at, doc = np.nonzero(np.unpackbits(shown[some], axis=1, count=n))
        top = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else np.iinfo(np.int64).max
        most[alive[at], doc] = np.minimum(top, sizes[doc])
        level += 1
        if level == len(LEVELS):
            break
    term, doc = np.nonzero(most)
    tf = most[term, doc]
    most[term, doc] = asked.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    out = np.zeros((len(asked.items), n), np.int64)
    for i, own in enumerate(asked.items):
        if own:
            out[i] = np.array(list(own.values()), np.int64) @ most[list(own)]
    return out


def bounded(shared, most: int | None, least):
    """Block rows to (item, key, bound): the ``most`` best of each item and task, or all that reach least[item]."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = restored(Asked, shared.value)
        hashes = word_hashes(pa.array(asked.names, pa.binary()), SPACE)[0] if asked.names else np.zeros(0, np.uint64)
        floor = np.array(least.value, np.int64)[:, None] if least is not None else 1
        best = None
        for batch in batches:
            for bits, n, keys, sizes, raw in zip(*(batch.column(c).to_pylist() for c in ("bits", "documents", "keys", "sizes", "slices")), strict=True):
                keys = np.frombuffer(keys, "<i8")
                found = bounds_of(asked, hashes, bits, np.frombuffer(sizes, "<i8"), np.frombuffer(raw, np.uint8).reshape(bits, -1))
                if most is None:
                    item, doc = np.nonzero(found >= floor)
                    yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(keys[doc]), pa.array(found[item, doc])], ["item", "key", "bound"])
                    continue
                own = np.broadcast_to(keys, found.shape)
                both = (found, own) if best is None else (np.hstack([best[0], found]), np.hstack([best[1], own]))
                if both[0].shape[1] > most:
                    keep = np.argpartition(-both[0], most - 1, axis=1)[:, :most]
                    both = tuple(np.take_along_axis(x, keep, 1) for x in both)
                best = both
        if best is not None:
            item, at = np.nonzero(best[0] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(best[1][item, at]), pa.array(best[0][item, at])], ["item", "key", "bound"])

    return run


def exact(shared):
    """Rows (doc_id, text, items) to the positive scores of these items."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = restored(Asked, shared.value)
        weights, number = asked.weights.tolist(), asked.number
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, text, items in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "items")), strict=True):
                    words = terms_of(text)
                    m = asked.length_factor(len(words))
                    part_of = {number[t]: (1_000_000_000 * tf) // (1000 * tf + 8 * m) for t, tf in Counter(words).items() if t in number}
                    for i in items:
                        score = sum(n * weights[t] * part_of.get(t, 0) for t, n in asked.items[i].items())
                        if score > 0:
                            rows.append((i, doc_id, score))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return run


def rescored(rows: DataFrame, pairs: DataFrame, shared) -> DataFrame:
    """rows: of ``keyed``; pairs: (item, key). Texts are not shuffled while there are few enough keys to send them instead."""
    asked_for = materialize(pairs.groupBy("key").agg(F.collect_set("item").alias("items")), "candidates")  # as many as items at most
    few = asked_for.count() <= SENT_KEYS
    return rows.join(F.broadcast(asked_for) if few else asked_for, "key").select("doc_id", "text", "items").mapInArrow(exact(shared), HITS)


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def item_blocks(items: DataFrame) -> Iterator[list]:
    """Rows (item_id, text), about ITEM_BYTES of texts at a time."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // ITEM_BYTES
    held = materialize(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items") if blocks > 1 else items.withColumn("block", F.lit(0))
    for b in range(blocks):
        own = held.filter(F.col("block") == b).collect()
        if own:
            yield own


def search(index: Index, rows: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """rows: of ``keyed``, those that the index was made of; items: (item_id, text). (item_id, rank, doc_id, score): the k best
    documents with a positive score for each row of items, equal scores by doc_id, null last.

    Null and empty texts have no terms and are no hits; items without terms have none. Repeated rows of documents are documents
    of their own. Items go to the tasks in blocks of bounded size, one pass over the signatures and two over the texts for each."""
    spark, out = rows.sparkSession, []
    found = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for own in item_blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text")) if index.documents else ():
        split = [terms_of(r.text) for r in own]
        names = spark.createDataFrame([(bytearray(t),) for t in sorted({t for x in split for t in x})], "term binary")
        df = {bytes(r.term): r.df for r in index.vocabulary.join(F.broadcast(names), "term").collect()}  # of this block's terms
        shared = spark.sparkContext.broadcast(plain(Asked(split, df, index.documents, index.terms)))
        bound = "item int, key bigint, bound bigint"
        order = Window.partitionBy("item").orderBy(F.desc("bound"), "key")
        first = index.blocks.mapInArrow(bounded(shared, FIRST * k, None), bound).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= FIRST * k)
        sure = {r.item: r.score for r in best_hits(rescored(rows, first, shared), k).filter(F.col("rank") == k).collect()}  # a row per item
        least = spark.sparkContext.broadcast([max(1, sure.get(i, 1)) for i in range(len(own))])
        left = index.blocks.mapInArrow(bounded(shared, None, least), bound)
        numbered = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], "item int, item_id bigint")
        hits = best_hits(rescored(rows, left, shared), k).join(F.broadcast(numbered), "item").select("item_id", "rank", "doc_id", "score")
        out.append(materialize(hits, "hits"))
    return functools.reduce(DataFrame.unionByName, out) if out else found


def query(spark, sf_dir: str) -> DataFrame:
    rows = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index_of(rows), rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
with words as (
  select k, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as k, doc_id, text from documents)),
counts as (select k, doc_id, term, count(*) as tf from words group by all),
sizes as (select k, sum(tf)::bigint as n from counts group by k),
totals as (select count(*) as docs, sum(n)::bigint as terms from sizes),
weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from counts, totals group by term),
asked as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
scored as (
  select a.item_id, c.k, c.doc_id, sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (25 + (75 * s.n * t.docs) // t.terms))))::bigint as score
  from asked a join counts c using (term) join weights w using (term) join sizes s using (k), totals t group by all)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
where rank <= 10
"""
