"""Near-duplicate documents by a Jaccard join on word 5-shingles, with rare-first prefix filtering.

1. One pass hashes every whole text and gives each document a node: the hash of its shingle set, so documents of equal sets
   are one node from here on. It also finds the shingles that a good part of each batch holds ("common" ones).
2. A second pass deals (shingle, node) pairs by shingle, packed as arrays; each part counts how many nodes hold a shingle and
   sends those held by two or more back by node. Common shingles skip this and go straight to the node, as the last in the
   order, so no shingle gathers a third of all documents in one task.
3. A node orders its shingles rarest first. Those that nobody else holds come first and use up the prefix, which removes most
   nodes; what is left of the prefix is joined on the shingle.
4. Each prefix shingle first pairs its nodes with one centre (a node of few shingles of its own, such as the original of many
   copies); links join components. While that finds links and many pairs across components are left, further rounds do the
   same with other centres, each with the nodes that are in other components than it. In the end all nodes that still are in
   different components are paired with each other. So a large group of near copies costs a few pairs per member, and no link
   that could join two components is left out.
5. Pairs pass length, positional and suffix filters and are verified once.

What a task holds at once is a cell of about PART shingles, whatever the size of the input: cells grow in number with the
shingles counted in the first pass. Up to WIDTH cells are shuffle partitions of their own. Beyond, a partition has several
cells, which it brings together by a local sort (that can spill) and handles one after the other.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from millrace.llm.hashing import shingles, slices, word_hashes
from millrace.llm.scratch import materialize, shuffle_width, tidied

BITS = 48
LAST = 65535
COMMON = 50_000
SLOTS = 8
DEAL = 500_000
PART = 2_000_000
WIDTH = 20_000
ROUNDS = 12
CENTRES = 8
FIRST = "row_key bigint, doc_id bigint, node bigint, twin bigint, n bigint, shingle bigint, held bigint"
DEALT = "part int, common boolean, nodes binary, packed binary"
BACK = "bucket int, nodes binary, packed binary"
SETS = "node bigint, n bigint, own bigint, rest binary"
_NODE = np.dtype([("node", "<i8"), ("n", "<i4")])
_BACK = np.dtype([("shingle", "<u8"), ("at", "<u4"), ("df", "<u2")])


def least_overlap(a, b, percent: int):
    """Shingles that sets of a and b elements must share so that 100 * intersection >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


def sets_of(batch: pa.RecordBatch, twins: frozenset[int] = frozenset()) -> Iterator[tuple]:
    """(row key, doc id, node, twin, shingles) of each row; the shingles are cut to BITS bits and ascend. Node and twin are two
    hashes of the set; for a node in twins, which different sets share, the second one is the node."""
    for part in slices(batch, "text"):
        words, begin = word_hashes(part.column("text"))
        for i, (key, doc) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
            own = np.unique(shingles(words[begin[i] : begin[i + 1]]) >> np.uint64(64 - BITS))
            node, twin = struct.unpack("<qq", hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            yield key, doc, twin if node in twins else node, twin, own


def survey(share: float):
    """A row per document, and rows (shingle, held) for shingles that at least ``share`` of some hundreds of neighbouring nodes hold."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list, seen: dict) -> pa.RecordBatch:
            if len(seen) >= 50:
                values, counts = np.unique(np.concatenate(list(seen.values())), return_counts=True)
                often = counts >= max(20, share * len(seen))
                rows += [(None, None, None, None, None, int(v), int(c)) for v, c in zip(values[often], counts[often], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["row_key", "doc_id", "node", "twin", "n", "shingle", "held"])

        for batch in batches:
            rows, seen, size = [], {}, 0
            for key, doc, node, twin, own in sets_of(batch):
                rows.append((key, doc, node, twin, len(own), None, None))
                if len(own) and node not in seen:
                    seen[node] = own
                    size += len(own)
                if size > DEAL:
                    yield out(rows, seen)
                    rows, seen, size = [], {}, 0
            if rows:
                yield out(rows, seen)

    return run


def deal(parts: int, shared):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, twins = shared.value

        def out(held: dict) -> Iterator[pa.RecordBatch]:
            nodes = np.array([(k, len(v)) for k, v in held.items()], _NODE)
            value = np.concatenate(list(held.values()))
            at = np.repeat(np.arange(len(nodes), dtype=np.uint64), nodes["n"])
            often = np.zeros(len(value), bool)
            if len(common):
                often = common[np.minimum(np.searchsorted(common, value), len(common) - 1)] == value
            for chosen, flag in ((~often, False), (often, True)):
                v, a = value[chosen], at[chosen]
                part = (nodes["node"][a] if flag else v.view(np.int64)) % parts
                order = np.lexsort((v, part))
                v, a, part = v[order], a[order], part[order]
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
                rows = []
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    used, local = np.unique(a[lo:hi], return_inverse=True)
                    packed = (v[lo:hi] << np.uint64(16)) | local.astype(np.uint64)
                    rows.append((int(part[lo]), flag, planes(nodes[used]), planes(packed)))
                if rows:
                    kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "common", "nodes", "packed"])

        for batch in batches:
            held, size = {}, 0
            for _, _, node, _, own in sets_of(batch, twins):
                if len(own) and node not in held:
                    held[node] = own
                    size += len(own)
                if size > DEAL or len(held) >= 65_000:
                    yield from out(held)
                    held, size = {}, 0
            if held:
                yield from out(held)

    return run


def by_cell(cell: np.ndarray, nodes: np.ndarray, values: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
    """(cell, nodes, values, places among these nodes) of each cell; at are places among all nodes."""
    order = np.argsort(cell, kind="stable")
    cell, values, at = cell[order], values[order], at[order]
    cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])) if len(cell) else []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        used, local = np.unique(at[lo:hi], return_inverse=True)
        yield int(cell[lo]), nodes[used], values[lo:hi], local


def batched(rows: Iterator[tuple], most: int) -> Iterator[tuple]:
    """(nodes, values, places) of rows of arrays (nodes, values, places), some of them together, of about ``most`` nodes or values."""
    held, size = [], 0
    for row in rows:
        grows = max(len(row[0]), len(row[1]))
        if held and size + grows > most:
            yield joined(held)
            held, size = [], 0
        held.append(row)
        size += grows
    if held:
        yield joined(held)


def joined(rows: list[tuple]) -> tuple:
    shift = np.cumsum([0, *(len(nodes) for nodes, _, _ in rows)])
    nodes, same = np.unique(np.concatenate([nodes for nodes, _, _ in rows]), return_inverse=True)
    return nodes, np.concatenate([v for _, v, _ in rows]), np.concatenate([same[at.astype(np.int64) + base] for (_, _, at), base in zip(rows, shift, strict=False)])


def cells_of_parts(width: int, cells: int):
    """Rows of a part as rows of its cells, under their numbers: cell c of part p is c + p * cells. Common rows have no cell."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "common", "nodes", "packed"])

        for batch in batches:
            rows, plain = [], []
            for part, common, nodes, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if common:
                    rows.append((part * cells, True, nodes, packed))
                else:
                    v = unpack(packed)
                    plain.append((part, unpack(nodes, _NODE), v >> np.uint64(16), v & np.uint64(LAST)))
            for part in sorted({row[0] for row in plain}):
                for nodes, value, at in batched((row[1:] for row in plain if row[0] == part), 60_000):
                    for cell, own, v, local in by_cell((value.view(np.int64) // width) % cells, nodes, value, at):
                        rows.append((part * cells + cell, False, planes(own), planes((v << np.uint64(16)) | local.astype(np.uint64))))
            if rows:
                yield out(rows)

    return run


def cells_of_buckets(width: int, cells: int):
    """The same for the way back, where cells are ranges of nodes."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, plain = [], []
            for bucket, nodes, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entries = unpack(packed, _BACK)
                plain.append((bucket, unpack(nodes, _NODE), entries, entries["at"]))
            for bucket in sorted({row[0] for row in plain}):
                for nodes, entries, at in batched((row[1:] for row in plain if row[0] == bucket), DEAL):
                    for cell, own, some, local in by_cell(((nodes["node"][at] >> 7) // width) % cells, nodes, entries, at):
                        some["at"] = local
                        rows.append((bucket * cells + cell, planes(own), planes(some)))
            if rows:
                kinds = [pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "nodes", "packed"])

    return run


def planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then second bytes and so on, which compresses where high bytes agree."""
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def unpack(blob: bytes, kind=np.uint64) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(blob, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def shared_entries(value: np.ndarray, at: np.ndarray, slot: int) -> np.ndarray:
    """Of the shingles in one of SLOTS slots, those that two nodes or more hold."""
    chosen = (value >> np.uint64(BITS - 8)) % np.uint64(SLOTS) == slot
    value, at = value[chosen], at[chosen]
    order = np.lexsort((at, value))
    value, at = value[order], at[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1])
    value, at = value[new], at[new]
    first = np.ones(len(value), bool)
    first[1:] = value[1:] != value[:-1]
    df = np.diff(np.append(np.flatnonzero(first), len(value)))
    df = np.repeat(df, df)
    many = df > 1
    entries = np.empty(int(many.sum()), _BACK)
    entries["shingle"], entries["at"], entries["df"] = value[many], at[many], np.minimum(df[many], LAST - 1)
    return entries


def count_parts(buckets: int):
    """Rows sorted by part: of every shingle of a part that two nodes or more hold, (node, shingle, nodes) dealt by node."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def back(nodes: np.ndarray, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = (nodes["node"][entries["at"]] >> 7) % buckets
            order = np.argsort(bucket, kind="stable")
            entries, bucket = entries[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
            rows = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                own = entries[lo:hi].copy()
                used, local = np.unique(own["at"], return_inverse=True)
                own["at"] = local
                rows.append((int(bucket[lo]), planes(nodes[used]), planes(own)))
            if rows:
                kinds = [pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "nodes", "packed"])

        def finish() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            values = [unpack(packed) for _, packed in held]
            shift = np.cumsum([0, *(len(nodes) for nodes, _ in held)], dtype=np.int32)
            nodes, same = np.unique(np.concatenate([nodes for nodes, _ in held]), return_inverse=True)  # a node may have come from many batches
            at = np.concatenate([same[(v & np.uint64(LAST)).astype(np.int32) + base] for v, base in zip(values, shift, strict=False)]).astype(np.int32)
            value = np.concatenate(values) >> np.uint64(16)
            values.clear()
            held.clear()
            entries = np.concatenate([shared_entries(value, at, slot) for slot in range(SLOTS)])
            yield from back(nodes, entries)

        for batch in batches:
            for part, common, nodes, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodes = unpack(nodes, _NODE)
                if common:
                    v = unpack(packed)
                    entries = np.empty(len(v), _BACK)
                    entries["shingle"], entries["at"], entries["df"] = v >> np.uint64(16), v & np.uint64(LAST), LAST
                    yield from back(nodes, entries)
                    continue
                if part != now:
                    yield from finish()
                    now, held = part, []
                held.append((nodes, packed))
        yield from finish()

    return run


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def pack48(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def gather_nodes(percent: int):
    """Rows sorted by bucket: nodes whose prefix reaches shared shingles, with these in rare-first order."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            nodes = np.concatenate([nodes for nodes, _ in held])
            entries = np.concatenate([e for _, e in held])
            shift = np.repeat(np.cumsum([0, *(len(nodes) for nodes, _ in held[:-1])]), [len(e) for _, e in held])
            nodes, same = np.unique(nodes, return_inverse=True)
            at = same[entries["at"] + shift]
            order = np.lexsort((entries["shingle"], entries["df"], at))
            at, value = at[order], entries["shingle"][order]
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (value[1:] != value[:-1])])  # common shingles come from each batch
            at, value = at[new], value[new]
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            rows = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                node, n = nodes[at[lo]]
                own = int(n) - int(hi - lo)
                if prefix_length(int(n), percent) > own:
                    rows.append((int(node), int(n), own, pack48(value[lo:hi])))
            for a in range(0, len(rows), 2000):
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows[a : a + 2000], strict=True), kinds, strict=True)], ["node", "n", "own", "rest"])

        for batch in batches:
            for bucket, nodes, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from finish()
                    now, held = bucket, []
                held.append((unpack(nodes, _NODE), unpack(packed, _BACK)))
        yield from finish()

    return run


def prefixes(percent: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingle, node, size, place, alone = [], [], [], [], []
            for key, n, own, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = unpack48(rest)[: prefix_length(n, percent) - own]
                shingle.append(value.view(np.int64))
                node.append(np.full(len(value), key, np.int64))
                size.append(np.full(len(value), n, np.int64))
                place.append(own + np.arange(len(value), dtype=np.int64))
                alone.append(np.full(len(value), own, np.int64))
            if shingle:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (shingle, node, size, place, alone)], ["shingle", "node", "n", "pos", "own"])

    return run


def verify(percent: int):
    """Links among (x, y, nx, ny, rest_x, rest_y): a suffix filter by ranges of hashes, then the shared shingles."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(i, 500) for batch in batches for i in range(0, batch.num_rows, 500)):
            links = []
            for x, y, nx, ny, a, b in zip(*(c.to_pylist() for c in part.columns), strict=True):
                need = least_overlap(nx, ny, percent)
                a, b = unpack48(a), unpack48(b)
                bound = np.minimum(*(np.bincount((v >> np.uint64(BITS - 4)).astype(np.int64), minlength=16) for v in (a, b))).sum()
                if bound >= need and len(np.intersect1d(a, b, assume_unique=True)) >= need:
                    links.append((x, y))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*links, strict=True)], ["x", "y"])

    return run


def links_among(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs: distinct (x, y)."""
    side = lambda c, n, rest: sets.select(F.col("node").alias(c), F.col("n").alias(n), F.col("rest").alias(rest))
    both = pairs.join(side("x", "nx", "rest_x"), "x").join(side("y", "ny", "rest_y"), "y")
    return both.select("x", "y", "nx", "ny", "rest_x", "rest_y").mapInArrow(verify(percent), "x bigint, y bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of links (x, y): the smallest node reachable. Minimum labels spread along links and
    then jump to the label of their label, a logarithmic number of rounds; each round is a written table."""
    links = materialize(links, "links")
    both = materialize(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))), "links-both-ways")
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        spread = materialize(labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label")), "labels-spread")
        roots = spread.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = materialize(spread.join(roots, "label").select("node", "before", F.col("root").alias("label")), "labels-jumped")
        labels = jumped.select("node", "label")
        if jumped.filter("before != label").isEmpty():
            return labels.withColumnRenamed("label", "component")


def near(a: str, b: str, percent: int):
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def enough(nx: str, px: str, ny: str, py: str, percent: int):
    """The positional filter. A pair's first common shingle leaves the most behind it, so a pair that could link passes there,
    and one that could not passes nowhere: rows can be judged one by one, inside the join."""
    need = F.ceil(percent * (F.col(nx) + F.col(ny)) / (100 + percent))
    return F.least(F.col(nx) - F.col(px), F.col(ny) - F.col(py)) >= need


def star(rows: DataFrame, orders: list, percent: int) -> DataFrame:
    """rows: (shingle, node, n, pos, component). Distinct pairs (x, y) of each shingle's first node by every one of ``orders``
    and its nodes in other components."""
    centres = [F.min(F.struct(order.alias("o"), "node", "n", "pos", "component")) for order in orders]
    found = rows.groupBy("shingle").agg(F.array_distinct(F.transform(F.array(*centres), lambda c: F.struct(*(c[x].alias(x) for x in ("node", "n", "pos", "component"))))).alias("c"), F.count("*").alias("nodes"))
    found = found.filter("nodes > 1").select(F.col("shingle").alias("s"), F.explode("c").alias("c"))
    found = materialize(found.select("s", F.col("c.node").alias("cx"), F.col("c.n").alias("cn"), F.col("c.pos").alias("cp"), F.col("c.component").alias("cc")), "centres")
    found = rows.join(found, (F.col("shingle") == F.col("s")) & (F.col("component") != F.col("cc")) & near("n", "cn", percent) & enough("n", "pos", "cn", "cp", percent))
    return found.select(F.least("node", "cx").alias("x"), F.greatest("node", "cx").alias("y")).distinct()


def able(percent: int):
    """Whether a row can be the smaller side of a pair, or one of two equal sides: what follows must reach 2 * percent / (100 +
    percent) of its own set, the least that a set as large asks for. Of each pair that ``enough`` passes the smaller side is."""
    return F.col("pos") * (100 + percent) <= F.col("n") * (100 - percent)


def open_rows(rows: DataFrame, percent: int) -> DataFrame:
    """Those of shingles whose nodes are in several components that a pair could be made of: rows that are ``able``, and others
    that are at least as large as one of these in another component. No pair that ``enough`` passes is lost."""
    own = F.when(able(percent), F.col("component"))
    mixed = rows.groupBy("shingle").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min(F.when(able(percent), F.col("n"))).alias("least"), F.min(own).alias("c"), F.max(own).alias("d"))
    mixed = mixed.filter("a != b and least is not null").select("shingle", "least", "c", "d")
    used = able(percent) | ((F.col("n") >= F.col("least")) & ((F.col("component") != F.col("c")) | (F.col("component") != F.col("d"))))
    return materialize(rows.join(mixed, "shingle").filter(used).select("shingle", "node", "n", "pos", "own", "component"), "open-prefixes")


def placed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows under the components of known, (node, component); written once, for they are read twice."""
    found = rows.drop("component").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return materialize(found.select("shingle", "node", "n", "pos", "own", "component"), "placed-prefixes")


def pairs_across(rows: DataFrame, percent: int) -> tuple[int, int]:
    """About how many pairs of one shingle and different components would pass the positional filter, were all sets equally
    large, and of how many rows. This decides only how the pairs are looked for."""
    each = rows.filter(able(percent)).groupBy("shingle", "component").agg(F.count("*").cast("double").alias("k")).groupBy("shingle").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    found = each.agg(F.sum("k"), F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2)).first()
    return int(found[1] or 0), int(found[0] or 0)


def node_links(df: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """df: (row_key, doc_id, text). Gives (row_key, doc_id, node, n), and (node, component) of nodes in a link, and the links."""
    spark = df.sparkSession
    first = materialize(df.mapInArrow(survey(0.005), FIRST), "survey")
    rows = first.filter("n is not null").select("row_key", "doc_id", "node", "twin", "n")
    twins = rows.groupBy("node").agg(F.min("twin").alias("a"), F.max("twin").alias("b")).filter("a != b").select("node")
    twins = frozenset(r.node for r in twins.collect())  # chance alone makes them: some tens among 10**11 sets
    rows = rows.select("row_key", "doc_id", F.when(F.col("node").isin(*twins), F.col("twin")).otherwise(F.col("node")).alias("node") if twins else "node", "n")
    least = shuffle_width(spark)
    total = max(least, -(-(rows.agg(F.sum("n")).first()[0] or 0) // PART))
    width = min(total, max(least, WIDTH))
    cells = -(-total // width)
    common = first.filter("n is null").groupBy("shingle").agg(F.sum("held").alias("held")).orderBy(F.desc("held"), "shingle").limit(COMMON)
    common = np.sort(np.array([r.shingle for r in common.collect()], np.int64).view(np.uint64))  # at most COMMON
    dealt = df.mapInArrow(deal(width, spark.sparkContext.broadcast((common, twins))), DEALT).repartitionById(width, "part")
    if cells > 1:
        dealt = dealt.sortWithinPartitions("part").mapInArrow(cells_of_parts(width, cells), DEALT)
    back = dealt.sortWithinPartitions("part").mapInArrow(count_parts(width), BACK).repartitionById(width, "bucket")
    if cells > 1:
        back = back.sortWithinPartitions("bucket").mapInArrow(cells_of_buckets(width, cells), BACK)
    sets = materialize(back.sortWithinPartitions("bucket").mapInArrow(gather_nodes(percent), SETS), "sets")
    prefix = sets.mapInArrow(prefixes(percent), "shingle bigint, node bigint, n bigint, pos bigint, own bigint")
    prefix = materialize(prefix, "prefixes")

    left = open_rows(prefix.withColumn("component", F.col("node")), percent)
    known, links, tried = None, None, None
    for k in range(ROUNDS):
        alone = F.col("own") / F.col("n")
        chance = lambda j: F.pmod(F.xxhash64("node", F.lit(j)), F.lit(1 << 20)) / float(1 << 20)
        pairs = star(left, [alone] if k == 0 else [(alone + 0.01) * (0.2 + chance(CENTRES * k + j)) for j in range(CENTRES)], percent)
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti"), "star-pairs")
        found = materialize(links_among(pairs, sets, percent), "star-links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        n_found, n_pairs = found.count(), pairs.count()
        if known is None or n_found:
            known = components(links)
            left = open_rows(placed(left, known), percent)  # components only join, so what is not open never will be
        across, held = pairs_across(left, percent)
        if 10 * n_found <= n_pairs or across <= 2 * held:
            break

    one = left.select(F.col("shingle").alias("s"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("component").alias("cx"))
    other = left.select("shingle", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("component").alias("cy"))
    rest = one.join(other, (F.col("s") == F.col("shingle")) & (F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & near("nx", "ny", percent) & enough("nx", "px", "ny", "py", percent))
    rest = rest.select("x", "y").distinct().join(tried, ["x", "y"], "left_anti")
    more = materialize(links_among(materialize(rest, "rest-pairs"), sets, percent), "rest-links")
    return rows, (known if more.isEmpty() else components(links.unionByName(more))), links.unionByName(more)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    Documents link when 100 * intersection >= percent * union of their sets of distinct 5-word shingles (a text of fewer words
    is one shingle). Null, empty and blank texts have no shingles, link with nothing and are their own component. Rows that
    repeat an id are rows of their own; all rows of equal sets are in one component. A null id is never the smallest; a
    component of null ids alone has a null component_id. An empty table gives no rows. Shingles are compared by 48 bits of
    their hashes and sets by 128 bits."""
    rows = df.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found, known, _ = node_links(rows, percent)
    nodes = found.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = materialize(nodes, "nodes")
    least = materialize(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    of_node = materialize(nodes.select("node", "component").join(least, "component").select("node", "component_id"), "component-of-node")
    linked = found.filter("n > 0").join(of_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(found.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of df with exactly one of each component of near_duplicates: that of the smallest id, nulls last, then of the
    smallest hash of id and text. Of rows that repeat id and text, that of the smallest columns stays. A row goes by its own
    id and text, so others of its id are judged apart; rows are told apart by their id and 64 bits of both. Texts without
    shingles are in no component and all stay. Other columns may have any names."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    found, known, _ = node_links(df.select(key.alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    nodes = materialize(found.filter("n > 0").groupBy("node").agg(first).join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "nodes")
    kept = materialize(nodes.groupBy("component").agg(F.min("first").alias("first")).select("component", F.col("first.row_key").alias("kept"), F.coalesce("first.doc_id", F.lit(0)).alias("kept_id")), "components")
    of_node = materialize(nodes.select("node", "component").join(kept, "component").select("node", "kept", "kept_id"), "component-of-node")
    found = found.withColumn("row_id", F.coalesce("doc_id", F.lit(0)))
    stays = (F.col("row_key") == F.col("kept")) & (F.col("row_id") == F.col("kept_id"))
    linked = found.filter("n > 0").join(of_node, "node").groupBy("row_key", "row_id").agg(F.count("*").alias("rows"), F.bool_or(stays).alias("stays"))
    marked = materialize(linked.filter("not stays or rows > 1").select("row_key", "row_id", "stays"), "copies")
    places = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*places).withColumns({"row_key": F.xxhash64(*(F.col(places[df.columns.index(c)]) for c in (id_col, text_col))), "row_id": F.coalesce(F.col(places[df.columns.index(id_col)]).cast("long"), F.lit(0))})
    alone = rows.join(marked.hint("merge"), ["row_key", "row_id"], "left_anti").select(*places)
    again = marked.filter("stays")
    if not again.isEmpty():
        repeated = rows.join(again.hint("merge"), ["row_key", "row_id"], "left_semi").groupBy("row_key", "row_id").agg(F.min(F.struct(*places)).alias("row"))
        alone = alone.unionByName(repeated.select("row.*"))
    return alone.toDF(*df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as materialized (select doc_id, count(*) as n from s group by 1),
p as materialized (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as materialized (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 75 * (a.n + b.n - shared)),
r as (select doc_id as x, doc_id as y from documents union select r.x, l.y from r join l on r.y = l.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(y) from r where r.x = d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id
"""
