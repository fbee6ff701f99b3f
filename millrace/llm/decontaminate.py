"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle sets (powers of two). An item's sketch is the bottom of its MinHash
order: its u + 1 smallest shingle hashes, where u is how many shingles an item of the partition's largest size may miss at
the threshold. A document that contains the item well enough holds at least one hash of the sketch, so the search finds
every such document, however long; candidates are then verified by counting the item's shingles that the document holds.
(A MinHash signature of the long document itself would not do: 40 shingles among 20,000 agree in one hash of five hundred.)
Items are the query set and go to the tasks in blocks of bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from millrace.llm.hashing import K, shingles, slices, word_hashes
from millrace.llm.scratch import materialize, plain, restored, tidied

MATCHES = "doc_id bigint, item_id bigint, item_shingles bigint, shared bigint"
ITEMS = "item_id bigint, k int, shingles array<bigint>"


def missable(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - 1e-9)


def item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words, begin = word_hashes(part.column("text"))
            rows = []
            for i, key in enumerate(part.column(0).to_pylist()):
                own = words[begin[i] : begin[i + 1]]
                if len(own):
                    k = min(K, len(own))
                    rows.append({"item_id": key, "k": k, "shingles": shingles(own, k).view(np.int64).tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item_id", pa.int64()), ("k", pa.int32()), ("shingles", pa.list_(pa.int64()))]))


class Index:
    """Sketches and sets of one block of items, by shingle width."""

    def __init__(self, rows: list[tuple], threshold: float) -> None:
        self.threshold, self.by_k = threshold, {}
        for k in {row[1] for row in rows}:
            items = [(key, np.array(own, np.int64).view(np.uint64)) for key, width, own in rows if width == k]
            sketch_hash, sketch_item, sets = [], [], []
            for j, (key, own) in enumerate(items):
                own = np.sort(own)
                largest = (2 << int(math.log2(len(own)))) - 1
                bottom = own[: missable(largest, threshold) + 1]
                sketch_hash.append(bottom)
                sketch_item.append(np.full(len(bottom), j))
                sets.append((key, own))
            h, j = np.concatenate(sketch_hash), np.concatenate(sketch_item)
            order = np.argsort(h, kind="stable")
            self.by_k[k] = (h[order], j[order], sets)

    def matches(self, words: np.ndarray) -> Iterator[tuple]:
        for k, (sketch, item, sets) in self.by_k.items():
            if len(words) < k:
                continue
            own = shingles(words, k)
            at = np.searchsorted(sketch, own)
            hit = own[sketch[np.minimum(at, len(sketch) - 1)] == own]
            if not len(hit):
                continue
            lo, hi = np.searchsorted(sketch, hit, "left"), np.searchsorted(sketch, hit, "right")
            for j in sorted({int(x) for a, b in zip(lo, hi, strict=True) for x in item[a:b]}):
                key, whole = sets[j]
                spot = np.minimum(np.searchsorted(own, whole), len(own) - 1)
                shared = int((own[spot] == whole).sum())
                if shared >= self.threshold * len(whole) - 1e-9:
                    yield key, len(whole), shared


def search(index):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = restored(Index, index.value)
        for batch in batches:
            for part in slices(batch, "text"):
                words, begin = word_hashes(part.column("text"))
                rows = [(key, *m) for i, key in enumerate(part.column(0).to_pylist()) for m in found.matches(words[begin[i] : begin[i + 1]])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "item_id", "item_shingles", "shared"])

    return run


def indexes(items: DataFrame, threshold: float, item_col: str, text_col: str, block: int) -> Iterator:
    """Broadcast indexes of all items, each of about ``block`` shingles at most, and whether it is the only one. An index is
    made when the one before has been used and dropped, so one block at a time is in memory."""
    spark = items.sparkSession
    sets = materialize(items.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(item_sets, ITEMS), "items")
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = -(-total // block)
    for b in range(blocks):
        own = [tuple(r) for r in sets.filter(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == b).collect()]
        if own:
            yield spark.sparkContext.broadcast(plain(Index(own, threshold))), blocks == 1


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block: int = 1_000_000) -> DataFrame:
    """Pairs (doc_id, item_id, item_shingles, shared) for which the document holds at least ``threshold`` of the item's distinct
    5-word shingles (words lower-cased A-Z, split at white space; an item of fewer words is one shingle of that width).

    Null and empty texts, on either side, are in no pair. Rows that repeat an id and text repeat their pairs. ``block`` bounds
    how many shingles of items a pass over the documents holds. An empty table on either side gives no pairs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for index, only in indexes(items, threshold, item_col, text_col, block):
        found = rows.mapInArrow(search(index), MATCHES)
        if not only:
            found = materialize(found, "contaminated")
            index.destroy()
        out = out.unionByName(found)
    return out


def without_items(docs: DataFrame, items: DataFrame, threshold: float = 0.75, item_col: str = "item_id", text_col: str = "text", block: int = 1_000_000) -> DataFrame:
    """The rows of docs, with all columns, that hold no item by the rule of ``contaminated``; no shuffle. Column names are
    not looked at, but for the text's."""
    at = docs.columns.index(text_col)

    def only_clean(index):
        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = restored(Index, index.value)
            for batch in batches:
                for part in slices(batch, at):
                    words, begin = word_hashes(part.column(at))
                    yield part.filter(pa.array([next(found.matches(words[a:b]), None) is None for a, b in zip(begin, begin[1:], strict=False)], pa.bool_()))

        return run

    for index, only in indexes(items, threshold, item_col, text_col, block):
        docs = docs.mapInArrow(only_clean(index), docs.schema)
        if not only:
            docs = materialize(docs, "clean-of-block")
            index.destroy()
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "item_shingles", "shared", F.round(F.col("shared") / F.col("item_shingles"), 6).alias("containment"))


SQL = r"""
with w as (select 0 as item, doc_id as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
           union all
           select 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') from benchmark),
     k as (select distinct least(5, len(w)) as k from w where item = 1 and len(w) > 0),
     s as (select distinct item, id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s from w, k where len(w) >= k and (item = 0 or k = least(5, len(w)))),
     n as (select id, count(*) as n from s where item = 1 group by id),
     m as (select d.id as doc_id, i.id as item_id, count(*) as shared from s d join s i on d.s = i.s and d.k = i.k where d.item = 0 and i.item = 1 group by all)
select doc_id, item_id, n as item_shingles, shared, round(shared / n, 6) as containment from m join n on n.id = m.item_id where 100 * shared >= 75 * n
"""
