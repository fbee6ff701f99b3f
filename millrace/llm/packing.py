"""Best-fit packing planned on the histogram of piece lengths.

Documents are tokenised and cut once; the only thing gathered is how many pieces of each length (1 to 1024) there are. The
plan runs best-fit decreasing over those counts: a group of equal sequences is one entry with a multiplicity, so the plan's
size depends on the sequence length alone, never on the number of documents. Each group then owns a range of ranks of each
length that it uses, and every piece takes its slot by joining its rank within its length to these ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window

from millrace.llm.hashing import slices
from millrace.llm.scratch import materialize, tidied
from millrace.llm.tokens import encoder, public_file

CAPACITY = 1024
END = 2
PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, part int, local_rank bigint"
SLOTS = "length int, lo bigint, hi bigint, each int, first_sequence bigint, first_offset int"


def cut_pieces(tokenizer: str, capacity: int, end: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = []
                for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    ids = np.asarray([*encode(text or ""), end], "<u4")
                    first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
                    start = 0
                    for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                        rows.append((key, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), part, int(seen[stop - start])))
                        seen[stop - start] += 1
                        start = stop
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Best-fit decreasing over counts. A group is [sequences, room left, {length: how many in each}]; longer lengths go first,
    always into the groups with the least sufficient room, as many copies at once as fit. At most two groups are added per
    length, so there are at most 2 * capacity. Returns SLOTS rows: ranks lo to hi - 1 of a length, `each` per sequence."""
    groups: list[list] = []
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        for group in sorted((g for g in groups if g[1] >= length), key=lambda g: g[1]):
            if not left:
                break
            each = group[1] // length
            whole, over = divmod(left, each)
            if whole < group[0]:  # more room than pieces: only some of these sequences take them
                if over:
                    groups.append([1, group[1] - over * length, group[2] | {length: over}])
                groups.append([group[0] - whole - (1 if over else 0), group[1], dict(group[2])])
                group[0], left = whole, 0
            else:
                left -= group[0] * each
            group[1] -= each * length
            group[2][length] = each
        groups = [g for g in groups if g[0]]
        if left:
            each = capacity // length
            whole, over = divmod(left, each)
            if whole:
                groups.append([whole, capacity - each * length, {length: each}])
            if over:
                groups.append([1, capacity - over * length, {length: over}])
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for n, _, inside in groups:
        offset = 0
        for length, each in inside.items():
            rows.append((length, used[length], used[length] + n * each, each, sequence, offset))
            used[length] += n * each
            offset += each * length
        sequence += n
    return rows


def pack(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is its token ids and one end id; one longer than the capacity is cut from the back into full pieces, so the
    first may be shorter. Null and empty texts are the end id alone. Repeated ids and rows are packed each by itself; a null
    id stays null. An empty table gives no rows. An added token's string in a text is that token, as tokenizers has it by default.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = materialize(rows.mapInArrow(cut_pieces(tokenizer or public_file(), capacity, end), PIECES), "pieces")
    held = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "histogram")
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = held.select("length", "part", before.alias("before"))
    slots = F.broadcast(spark.createDataFrame(plan_slots(counts, capacity), SLOTS))  # its size depends on the capacity alone
    rank = F.col("before") + F.col("local_rank")
    at = F.col("rank") - F.col("lo")
    return (
        pieces.join(ranks, ["length", "part"])
        .withColumn("rank", rank)
        .join(slots, (pieces["length"] == slots["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select(
            "doc_id", "piece", "start", pieces["length"].cast("long").alias("length"), "ids_crc32",
            (F.col("first_sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("first_offset") + (at % F.col("each")) * pieces["length"]).cast("long").alias("offset"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
