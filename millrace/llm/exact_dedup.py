"""Exact dedup by Patricia tries.

Rows are first combined inside each Arrow batch, so a text that a third of all rows carry reaches a partition once per
batch. Representatives are partitioned by (length, content hash) and sorted by their bytes; every partition inserts the
full byte strings into compressed radix tries, one per (length, hash), whose terminal nodes keep the owner's id. As the
bytes arrive in order, every subtree beside the latest path is complete: it is flushed ("spilled") to the output once a
trie holds more than ``trie_bytes``, and whole tries are flushed when the key moves on. Keys of many representatives (a text that
nearly every batch holds) first go through tries of salted partitions, so that a final partition gets a text once per salt.
Owners then reach the members of every representative by joins on unique representative numbers, which no hot text can skew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.scratch import materialize, shuffle_width, tidied

LOCAL = "rep bigint, length bigint, content_hash bigint, text binary, text_sha256 string, n bigint, owner bigint, members array<bigint>"
OWNED = "rep bigint, keep_id bigint, group_size bigint"
MERGED = "rep bigint, into bigint, length bigint, content_hash bigint, text binary, n bigint, owner bigint"
HOT = 1000
SALTS = 64


class Node:
    """A node of a compressed radix trie: the bytes that lead to it, its children by first byte, and a terminal's payload."""

    __slots__ = ("label", "children", "payload")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.payload = label, {}, None


class PatriciaTrie:
    def __init__(self) -> None:
        self.root, self.bytes, self.path = Node(b""), 0, []

    def insert(self, key: bytes) -> Node:
        """The terminal node of key, made if absent; edges are split where the bytes first differ."""
        node, at, path = self.root, 0, [self.root]
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(key) - at
                at = len(key)
            elif key.startswith(child.label, at):
                at += len(child.label)
            else:
                rest, same = key[at : at + len(child.label)], 0
                lo, hi = 0, min(len(rest), len(child.label))
                while lo < hi:  # the longest common prefix, by halving
                    same = (lo + hi + 1) // 2
                    lo, hi = (same, hi) if rest[:same] == child.label[:same] else (lo, same - 1)
                middle = Node(child.label[:lo])
                child.label = child.label[lo:]
                middle.children[child.label[0]] = child
                node.children[middle.label[0]] = middle
                child, at = middle, at + lo
            node = child
            path.append(node)
        self.path = path
        return node

    def flush(self, node: Node | None = None, spare: bool = False) -> Iterator[object]:
        """Payloads of all terminals below node, which are dropped; spare: those on the latest path stay."""
        stack, on_path = [node or self.root], set(map(id, self.path)) if spare else set()
        while stack:
            x = stack.pop()
            if x.payload is not None and id(x) not in on_path:
                yield x.payload
                x.payload = None
            stack += x.children.values()
            x.children = {k: v for k, v in x.children.items() if id(v) in on_path}
        self.bytes = sum(len(x.label) for x in self.path) if spare else 0


def combine_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    part, made = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        groups: dict[bytes, list] = {}
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            groups.setdefault(text or b"", []).append(key)
        rows = []
        for text, members in groups.items():
            owner = max((x for x in members if x is not None), default=None)
            rows.append({"rep": part | made, "length": len(text), "content_hash": xxhash.xxh3_64_intdigest(text) - (1 << 63), "text": text, "text_sha256": hashlib.sha256(text).hexdigest(), "n": len(members), "owner": owner, "members": members})
            made += 1
        for a in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_pylist(rows[a : a + 1000], schema=_SCHEMA)


_SCHEMA = pa.schema([("rep", pa.int64()), ("length", pa.int64()), ("content_hash", pa.int64()), ("text", pa.binary()), ("text_sha256", pa.string()), ("n", pa.int64()), ("owner", pa.int64()), ("members", pa.list_(pa.int64()))])


def trie_groups(trie_bytes: int, merge: bool):
    """Rows sorted by (length, content_hash, text), one trie for each key. Gives OWNED rows, or to merge, MERGED rows: (rep, into)
    for every row, with the text, n and owner at the first of its equals, which the others go into."""
    names, kinds = ([x.split()[i] for x in (MERGED if merge else OWNED).split(", ")] for i in (0, 1))
    kinds = [pa.binary() if kind == "binary" else pa.int64() for kind in kinds]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, key, out = PatriciaTrie(), None, []

        def emit(payloads):
            for reps, owner, n, held, text in payloads:
                if merge:
                    out.append((reps[0], reps[0], *held, text, n, owner))
                    out.extend((rep, reps[0], None, None, None, None, None) for rep in reps[1:])
                else:
                    out.extend((rep, owner, n) for rep in reps)

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("length", "content_hash", "text", "rep", "n", "owner")]
            for length, content_hash, text, rep, n, owner in zip(*columns, strict=True):
                if (length, content_hash) != key:
                    emit(trie.flush())
                    trie, key = PatriciaTrie(), (length, content_hash)
                node = trie.insert(text)
                if node.payload is None:
                    node.payload = [[], None, 0, key, text if merge else None]
                reps, best, count, _, _ = node.payload
                reps.append(rep)
                node.payload[1:3] = [max((x for x in (best, owner) if x is not None), default=None), count + n]
                if trie.bytes > trie_bytes:
                    emit(trie.flush(spare=True))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out.clear()
        emit(trie.flush())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = 64 << 20, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are one group. Rows that repeat an id are each counted and returned; each
    is kept if its id is the owner's. Null ids never own a text unless all ids of it are null (then keep_id is null and kept
    is false). An empty table gives no rows; other columns of the input, whatever their names, are not read.
    """
    rows, width = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), shuffle_width(df.sparkSession)
    local = materialize(rows.mapInArrow(combine_locally, LOCAL), "exact-local")
    reps = local.select("length", "content_hash", "text", "rep", "n", "owner")
    per_key = local.groupBy("length", "content_hash").agg(F.count("*").alias("rows"))
    least = max(hot, local.count() // 100_000)  # so there are at most 100,000 hot keys
    keys = materialize(per_key.filter(F.col("rows") > least).select("length", "content_hash"), "exact-hot-keys")
    merged = None
    if not keys.isEmpty():
        salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).alias("salt")
        own = reps.join(F.broadcast(keys), ["length", "content_hash"]).select("*", salt).repartition(width, "length", "content_hash", "salt")
        merged = materialize(own.sortWithinPartitions("length", "content_hash", "text").drop("salt").mapInArrow(trie_groups(trie_bytes, True), MERGED), "exact-merged")
        reps = reps.join(F.broadcast(keys), ["length", "content_hash"], "left_anti").select(*reps.columns).unionByName(merged.filter("text is not null").select(*reps.columns))
    owned = reps.repartition(width, "length", "content_hash").sortWithinPartitions("length", "content_hash", "text").mapInArrow(trie_groups(trie_bytes, False), OWNED)
    if merged is not None:
        owned = materialize(owned, "exact-owned")
        moved = merged.filter("rep <> into").select("rep", F.col("into").alias("to")).join(owned.withColumnRenamed("rep", "to"), "to")
        owned = owned.unionByName(moved.select(*owned.columns))
    return (
        local.select("rep", "text_sha256", "members")
        .join(owned, "rep")
        .select(F.explode("members").alias("doc_id"), "keep_id", "group_size", "text_sha256")
        .select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
