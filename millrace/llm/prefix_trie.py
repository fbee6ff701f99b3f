"""A prefix trie over conversations, in double arrays per shard of prefixes.

A turn is known by 128 bits of the SHA-256 of its role and text; a conversation is its turns' digests one behind another, with
the texts' lengths between them, so texts are read once and never shuffled. Equal conversations are counted first. The distinct
ones are dealt out by ranges of their bytes, so a stretch of sorted ones is a shard of the trie. A shard numbers its turns
densely and packs its nodes in BASE and CHECK arrays: the child of node s by turn c is the cell BASE[s] + c if its CHECK is s.
All conversations of a shard then walk these arrays together and leave their sums at the nodes.

Only nodes that begin both the last conversation of a shard and the first of the next are in several shards. Their sums are
made so that they add up: a shard counts a node that the shard before it has too neither as a child nor for the one copy that
isn't saved. These few nodes are merged by one aggregation; all others are complete where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from millrace.llm.scratch import materialize, shuffle_width, small_batches, tidied

#: Bytes of a turn in a sequence: 16 of digest, 4 of the text's length.
UNIT = 20
#: Turns of a shard, about; of a partition, at most this many times the shuffle's width of partitions are made.
SHARD, PARTITIONS = 1 << 17, 8
#: Conversation ids in one row, on the way to a node's digest.
CHUNK = 1 << 16
#: Free cells that are tried for a node of several children before it goes to the end.
TRIES = 32
NOTHING = hashlib.sha256().hexdigest()
NODE = "shared boolean, key binary, parent_key binary, end_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq): a row for each conversation, its turns in order. Turns come by number, null first, equal numbers by digest.
    Null roles and texts are empty; rows of a null id belong to no conversation. A conversation is one row of 20 bytes a turn."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.substring(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256), 1, 32)
    unit = F.concat(digest, F.lower(F.lpad(F.hex(F.octet_length(text)), 8, "0")))
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), unit.alias("unit")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.unhex(F.array_join(F.col("t.unit"), "")).alias("seq"))


def rebuilt(own: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """own: rows of ``sequences``. Of conversation c, the first h turns give way to those of conversation c - c % every, h being
    crc32 of c's decimals modulo ``heads``; all of them if there are fewer, none if there is no such conversation."""
    base = F.col("conv_id") - F.col("conv_id") % every
    first = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.substring("seq", 1, UNIT * (heads - 1)).alias("head"))
    cut = UNIT * (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = own.select("conv_id", "seq", base.alias("base"), cut.alias("cut")).join(first, "base", "left")
    none = F.lit("").cast("binary")
    return both.select("conv_id", F.concat(F.coalesce(F.expr("substring(head, 1, cut)"), none), F.expr("substring(seq, cut + 1)")).alias("seq"))


def key_of(seq: str = "seq"):
    return F.unhex(F.substring(F.sha2(seq, 256), 1, 32))


def short_digest(h) -> bytes:
    return h.digest()[:16]


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common from the start."""
    n = min(len(a), len(b)) // UNIT * UNIT
    unlike = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return (int(unlike[0]) if len(unlike) else n) // UNIT


class DoubleArray:
    """BASE and CHECK of a growing trie. Cell 0 is the root."""

    def __init__(self, size: int) -> None:
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.top, self.free = 1, np.zeros(0, np.int64)

    def reserve(self, upto: int) -> None:
        if upto > len(self.base):
            more = max(upto, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def add(self, parents: np.ndarray, turns: np.ndarray) -> None:
        """The children of nodes that have none yet, sorted by parent. A node of one child takes any free cell, one of several
        the first of some free places in which all of them fit, or the end."""
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        counts = np.diff(np.r_[starts, len(parents)])
        for at, n in zip(starts[counts > 1], counts[counts > 1], strict=True):
            own = np.sort(turns[at : at + n])
            away = own - own[0]
            for cell in self.free[:TRIES]:
                if cell + away[-1] < self.top and (self.check[cell + away] < 0).all():
                    break
            else:
                cell = self.top
                self.reserve(int(cell + away[-1]) + 1)
                self.top = int(cell + away[-1]) + 1
                gaps = np.setdiff1d(np.arange(cell, self.top), cell + away, assume_unique=True)
                self.free = np.concatenate([self.free, gaps])
            self.base[parents[at]] = cell - own[0]
            self.check[cell + away] = parents[at]
            self.free = self.free[self.check[self.free] < 0]
        single = starts[counts == 1]
        used, self.free = self.free[: len(single)], self.free[len(single) :]
        more = len(single) - len(used)
        self.reserve(self.top + more)
        cells = np.concatenate([used, np.arange(self.top, self.top + more)])
        self.top += more
        self.base[parents[single]] = cells - turns[single]
        self.check[cells] = parents[single]

    def step(self, nodes: np.ndarray, turns: np.ndarray) -> np.ndarray:
        cells = self.base[nodes] + turns
        if (self.check[cells] != nodes).any():
            raise ValueError("a conversation leaves the trie")
        return cells


def dense(digests: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Numbers of turns, counted in the order in which they come up, level by level, so that siblings are neighbours."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    ranked = digests[order]
    number = np.zeros(len(digests), np.int64)
    number[order] = np.cumsum(np.r_[False, (ranked[1:] != ranked[:-1]).any(1)])[: len(digests)]
    by_level = np.argsort(depth, kind="stable")
    _, first = np.unique(number[by_level], return_index=True)
    rank = np.zeros(len(first), np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(len(first))
    return rank[number]


def shard_rows(seqs: list[bytes], n: np.ndarray, conv: np.ndarray, left: int, right: int) -> pa.RecordBatch:
    """The nodes of a shard. seqs: sorted, distinct; n, conv: how many conversations each is, and the smallest. left, right: the
    turns that the first and the last have in common with the neighbouring shards, -1 without one."""
    lengths = np.array([len(s) // UNIT for s in seqs])
    begin = np.cumsum(np.r_[0, lengths[:-1]])
    cells = np.frombuffer(b"".join(seqs), np.uint8).reshape(-1, UNIT)
    digests, size = np.ascontiguousarray(cells[:, :16]).view(">u8").astype(np.uint64), np.ascontiguousarray(cells[:, 16:]).view(">u4").astype(np.int64).ravel()
    depth_of = np.arange(len(cells)) - np.repeat(begin, lengths)
    turns = dense(digests, depth_of) if len(cells) else np.zeros(0, np.int64)
    trie, at = DoubleArray(len(cells) + 1), np.zeros(len(seqs), np.int64)
    levels, sizes, order = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], np.arange(len(seqs))
    walks = [(at.copy(), order)]
    while True:
        depth = len(levels) - 1
        order = order[lengths[order] > depth]
        if not len(order):
            break
        place = begin[order] + depth
        parents, own = at[order], turns[place]
        new = np.flatnonzero(np.r_[True, (parents[1:] != parents[:-1]) | (own[1:] != own[:-1])])
        trie.add(parents[new], own[new])
        at[order] = trie.step(parents, own)
        levels.append(at[order[new]])
        sizes.append(size[place[new]])
        walks.append((at[order], order))
    top = trie.top
    count, least = np.zeros(top, np.int64), np.full(top, np.iinfo(np.int64).max)
    for nodes, who in walks:
        np.add.at(count, nodes, n[who])
        np.minimum.at(least, nodes, conv[who])
    nodes, depth = np.concatenate(levels), np.repeat(np.arange(len(levels)), list(map(len, levels)))
    text_bytes = np.zeros(top, np.int64)
    text_bytes[nodes] = np.concatenate(sizes)
    # of the shared nodes, which are on the first and the last path: digests of what leads to them
    key: dict[int, bytes] = {}
    with_left, with_right = np.zeros(top, bool), np.zeros(top, bool)
    for seq, most, marks in ((seqs[0], left, with_left), (seqs[-1], right, with_right)):
        h, node = hashlib.sha256(), 0
        s = 0 if marks is with_left else len(seqs) - 1
        for d in range(most + 1):
            if d:
                h.update(seq[UNIT * (d - 1) : UNIT * d])
                node = int(trie.base[node] + turns[begin[s] + d - 1])
            key[node], marks[node] = short_digest(h), True
    shared = with_left | with_right
    parent = trie.check[:top]
    children, leaves = np.zeros(top, np.int64), np.zeros(top, np.int64)
    has = np.zeros(top, bool)
    below = nodes[1:]
    np.add.at(children, parent[below], ~with_left[below])
    has[parent[below]] = True
    leaves[nodes] = ~has[nodes] & ~with_right[nodes]
    saved = (count - ~with_left) * text_bytes
    for level in levels[:0:-1]:
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    ends = {int(a): short_digest(hashlib.sha256(s)) for a, s in zip(at, seqs, strict=True)}
    listed, up = nodes.tolist(), parent[nodes].tolist()
    known = (depth > 0) & ~shared[parent[nodes]]
    columns = [
        pa.array(shared[nodes]), pa.array([key.get(x) for x in listed], pa.binary()), pa.array([key.get(p) if x else None for x, p in zip(listed, up, strict=True)], pa.binary()),
        pa.array([ends.get(x) for x in listed], pa.binary()), pa.array(least[nodes]), pa.array(depth.astype(np.int64)), pa.array(least[parent[nodes]], mask=~known),
        pa.array(count[nodes]), pa.array(children[nodes]), pa.array(leaves[nodes]), pa.array(saved[nodes]),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in NODE.split(", ")])


def tries(edges, shard: int):
    """Sorted rows (part, seq, n, conv_id) to NODE rows. edges: by part, the turns in common with the parts beside it."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        part, units, left = None, 0, -1

        def flushed(right: int) -> pa.RecordBatch:
            seqs, n, conv = zip(*own, strict=True)
            return shard_rows(list(seqs), np.array(n), np.array(conv), left, right)

        for batch in batches:
            for p, seq, n, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and (p != part or units >= shard):
                    with_next = edges.value[part][1] if p != part else common(own[-1][0], seq)
                    yield flushed(with_next)
                    left, own, units = with_next, [], 0
                if p != part:
                    part, left = p, edges.value[p][0]
                own.append((seq, n, conv))
                units += len(seq) // UNIT + 1
        if own:
            yield flushed(edges.value[part][1])

    return run


def edges_of(sorted_parts: DataFrame) -> dict[int, tuple[int, int]]:
    """By part, how many turns its first sequence has in common with the last of the part before, and its last with the first of
    the next: two numbers for each partition."""
    ends = materialize(sorted_parts.groupBy("part").agg(F.min("seq").alias("first"), F.max("seq").alias("last")), "trie-edges")
    parts = sorted(r.part for r in ends.select("part").collect())
    if len(parts) < 2:
        return {p: (-1, -1) for p in parts}
    spark = sorted_parts.sparkSession
    beside = spark.createDataFrame(list(zip(parts, parts[1:], strict=False)), "part int, after int")
    pairs = ends.select("part", "last").join(beside, "part").join(ends.select(F.col("part").alias("after"), F.col("first").alias("next")), "after").select("part", "last", "next")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [common(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], ["part", "turns"])

    shared = {r.part: r.turns for r in pairs.mapInArrow(run, "part int, turns int").collect()}
    before = dict(zip(parts[1:], parts, strict=False))
    return {p: (shared[before[p]] if p in before else -1, shared.get(p, -1)) for p in parts}


def end_digests(convs: DataFrame) -> DataFrame:
    """convs: (conv_id, end_key). (end_key, ends_sha256): of the ids, ascending, comma-joined. Ids are packed where they lie in
    ranges of their own, so that the conversations of one key go to its task as a few arrays, which pass through a running digest."""
    spark, width = convs.sparkSession, shuffle_width(convs.sparkSession)
    ranged = convs.repartitionByRange(width, "conv_id").select("end_key", F.spark_partition_id().alias("part"), "conv_id").sortWithinPartitions("end_key", "conv_id")

    @tidied
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            keys, part, conv = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [i for i in range(len(keys)) if i % CHUNK == 0 or keys[i] != keys[i - 1]]
            ids = pa.LargeListArray.from_arrays(pa.array([*cuts, len(keys)], pa.int64()), pa.array(conv, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in cuts], pa.binary()), part.take(pa.array(cuts, pa.int64())), pa.array([k] * len(cuts), pa.int32()), pa.array(conv[cuts], pa.int64()), ids.cast(pa.list_(pa.int64()))], ["end_key", "part", "batch", "least", "ids"])

    @tidied
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            done = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != key:
                    if key is not None:
                        done.append((key, h.hexdigest()))
                    key, h, mark = own, hashlib.sha256(), ""
                h.update((mark + ",".join(map(str, ids))).encode())
                mark = ","
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], ["end_key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], ["end_key", "ends_sha256"])

    rows = ranged.mapInArrow(packed, "end_key binary, part int, batch int, least bigint, ids array<bigint>")
    dealt = rows.repartition(width, "end_key").sortWithinPartitions("end_key", "part", "batch", "least").select("end_key", "ids")
    return dealt.mapInArrow(hashed, "end_key binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, shard: int = SHARD) -> DataFrame:
    """convs: (conv_id, seq), rows of ``sequences`` or ``rebuilt``. A row per distinct prefix: conv_id (smallest conversation that
    begins so), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves and saved_tokens of its subtree, and
    ends_sha256 of the conversations that end there. The last turn of a node is turn ``depth`` of conversation conv_id.

    A conversation without turns is a member of the root alone; without conversations there are no nodes. Repeated rows count
    as conversations of their own. A task holds one shard, or one conversation if that is longer."""
    spark = convs.sparkSession
    small_batches(spark)
    convs = materialize(convs.select("conv_id", "seq", key_of().alias("end_key")), "conversations")
    distinct = materialize(convs.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "sequences")
    total = distinct.agg(F.sum(F.length("seq") / UNIT + 1)).first()[0] or 0
    width = shuffle_width(spark)
    parts = int(max(1, min(PARTITIONS * width, max(total // shard, min(width, total // (shard // 16 or 1))))))
    dealt = materialize(distinct.repartitionByRange(parts, "seq").select(F.spark_partition_id().alias("part"), "seq", "n", "conv_id"), "ranges")
    edges = spark.sparkContext.broadcast(edges_of(dealt))  # two numbers a partition
    nodes = materialize(dealt.repartition(parts, "part").sortWithinPartitions("part", "seq").mapInArrow(tries(edges, shard), NODE), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = nodes.filter("shared").groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.max("end_key").alias("end_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums)
    merged = materialize(merged, "shared-nodes")
    columns = ["end_key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    none = F.lit(None).cast("long").alias("parent_conv_id")
    alone = nodes.filter("not shared")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    under = alone.filter("parent_key is not null").drop("parent_conv_id", "key", "shared").unionByName(merged.filter("parent_key is not null").drop("key")).join(parents, "parent_key")
    rows = alone.filter("parent_key is null").select(*columns).unionByName(under.select(*columns)).unionByName(merged.filter("parent_key is null").withColumn("parent_conv_id", none).select(*columns))
    ended = rows.filter("end_key is not null").join(end_digests(convs.select("conv_id", "end_key")), "end_key")
    return ended.drop("end_key").unionByName(rows.filter("end_key is null").drop("end_key").withColumn("ends_sha256", F.lit(NOTHING)))


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = """
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
  from conversations where conv_id is not null),
hashed as (
  select conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)) % 9 as h
  from (select distinct conv_id from turns)),
heads as (select c.conv_id, t.k as d, t.role, t.text from hashed c join turns t on t.conv_id = c.conv_id - c.conv_id % 5 and t.k <= c.h),
n_heads as (select c.conv_id, c.h, count(x.d) as n from hashed c left join heads x on x.conv_id = c.conv_id group by all),
rebuilt as (
  select * from heads union all
  select t.conv_id, n.n + t.k - n.h, t.role, t.text from turns t join n_heads n on n.conv_id = t.conv_id and t.k > n.h),
members as (
  select conv_id, d, strlen(text) as bytes, string_agg(md5(length(role)::varchar || ':' || role || text), '') over (partition by conv_id order by d) as prefix from rebuilt
  union all select conv_id, 0, 0, '' from hashed),
lengths as (select conv_id, max(d) as n from members group by conv_id),
nodes as (
  select d, prefix, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes, left(prefix, 32 * (d - 1)) as up from members group by d, prefix),
children as (select d - 1 as d, up as prefix, count(*) as n_children from nodes where d > 0 group by all),
own as (select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join children c using (d, prefix)),
subtrees as (
  select a.d, a.prefix, sum((n.n_children = 0)::int) as n_leaves, sum((n.n_convs - 1) * n.bytes) as saved_tokens
  from own n join members a on a.conv_id = n.conv_id and a.d <= n.d group by a.d, a.prefix),
ends as (select m.d, m.prefix, string_agg(m.conv_id::varchar, ',' order by m.conv_id) as ids from members m join lengths l on l.conv_id = m.conv_id and l.n = m.d group by m.d, m.prefix)
select o.conv_id, o.d::bigint as depth, p.conv_id as parent_conv_id, o.n_convs, o.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from own o join subtrees s using (d, prefix) left join ends e using (d, prefix) left join nodes p on o.d > 0 and p.d = o.d - 1 and p.prefix = o.up
"""
