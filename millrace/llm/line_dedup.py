"""Line dedup by content-defined chunks of lines.

Every line has a 64-bit hash; a chunk ends behind a line where a rolling hash over the last two line hashes is divisible by
``divisor``, and before and behind every line of ``long_line`` words or more, so that boundaries move with the lines and not
with their positions. A chunk counts if it has two lines or more or is such a long line. A short passage may hold no whole
chunk, so the rolling windows of two lines (none of them long) are looked up as well: a run of lines whose chunks and windows
all repeat is a repeated passage if it has ``long_line`` words or more. Hashes of chunks and windows (no text) are aggregated
over the corpus to the first place (the smallest doc_id, then position) and the number of places of each. The places then
join their texts once; equal bytes are combined in the tasks and grouped by their whole bytes, which shows any hash that
stands for two byte strings; those are told apart by their bytes. Copies go from every place but the first, and no line of a
first place goes, however many other passages it is part of. (A chunk that is the first with its boundaries, but whose lines
stand in a row at an earlier place by its windows, is a copy of those.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import DataFrame

from millrace.llm.hashing import slices
from millrace.llm.scratch import materialize, tidied

DIVISOR = 2
LONG_LINE = 50
WINDOW = 1 << 30  # places from here on are windows, by their first line
CHUNKS = "doc_id bigint, k1 bigint, k2 bigint, pos int, hash bigint, length int"
TEXTS = "hash bigint, length int, text binary"
PLACED = "hash bigint, length int, text binary, doc_id bigint, k1 bigint, k2 bigint, pos int"
TOLD = "array<struct<pos:int,first:boolean,f1:bigint,f3:int,alone:boolean>>"
ADDED = ["lines", "removed_lines", "removed_chunks"]


def is_long(line: bytes, long_line: int) -> bool:
    return len(line) >= 2 * long_line - 1 and len(line.split()) >= long_line


def chunks_of(lines: list[bytes], divisor: int, long_line: int) -> list[tuple[int, int]]:
    """(first line, past the last line) of the chunks that count."""
    out, first, before = [], 0, 0
    for i, line in enumerate(lines):
        alone = is_long(line, long_line)
        if alone:
            if i - first > 1:
                out.append((first, i))
            first = i
        own = int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little")
        if alone or (own * 0x9E3779B97F4A7C15 + before * 0xD6E8FEB86659FD93 >> 17) % divisor == 0 or i == len(lines) - 1:
            if alone or i > first:
                out.append((first, i + 1))
            first = i + 1
        before = own
    return out


def places_of(text: bytes, divisor: int, long_line: int) -> tuple[list[bytes], dict[int, tuple[int, int]]]:
    """The lines, and by place the lines (first, past the last) of every chunk and window."""
    lines = text.split(b"\n")
    places = dict(enumerate(chunks_of(lines, divisor, long_line)))
    alone = [is_long(x, long_line) for x in lines]
    places.update((WINDOW + i, (i, i + 2)) for i in range(len(lines) - 1) if not alone[i] and not alone[i + 1])
    return lines, places


def digest(data: bytes, kind: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data, kind) - (1 << 63)


def _texts(part: pa.RecordBatch, name: str) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in part.column(name).cast(pa.large_binary()))


def place_hashes(divisor: int, long_line: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, k1, k2, text in zip(*(part.column(i).to_pylist() for i in range(3)), _texts(part, "text"), strict=True):
                    lines, places = places_of(text, divisor, long_line)
                    for pos, (a, b) in places.items():
                        own = b"\n".join(lines[a:b])
                        rows.append((doc, k1, k2, pos, digest(own, pos >= WINDOW), len(own)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "k1", "k2", "pos", "hash", "length"])

    return run


def repeated_bytes(divisor: int, long_line: int):
    """(text, repeats: pos, hash, length, first) to the distinct (hash, length, bytes) of each slice."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            for part in slices(batch, "text"):
                found = set()
                for text, repeats in zip(_texts(part, "text"), part.column("repeats").to_pylist(), strict=True):
                    lines, places = places_of(text, divisor, long_line)
                    found.update((x["hash"], x["length"], b"\n".join(lines[slice(*places[x["pos"]])])) for x in repeats)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)], ["hash", "length", "text"])

    return run


def bytes_at(divisor: int, long_line: int):
    """(doc_id, k1, k2, text, repeats: pos, hash, length) to one row per repeat with its bytes."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, k1, k2, text, repeats in zip(*(part.column(i).to_pylist() for i in range(3)), _texts(part, "text"), part.column("repeats").to_pylist(), strict=True):
                    lines, places = places_of(text, divisor, long_line)
                    rows += [(x["hash"], x["length"], b"\n".join(lines[slice(*places[x["pos"]])]), doc, k1, k2, x["pos"]) for x in repeats]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["hash", "length", "text", "doc_id", "k1", "k2", "pos"])

    return run


def copies_and_firsts(places: dict[int, tuple[int, int]], repeats: list[dict], told: list[dict]) -> tuple[list[int], list[int]]:
    """Which repeated places are copies and which are first places. ``told`` replaces what the hashes say of some places."""
    at = {x["pos"]: x for x in repeats} | {x["pos"]: x for x in told}
    copies, firsts = [], []
    for pos, x in at.items():
        if x.get("alone"):
            continue
        first = x["first"]
        if first and pos < WINDOW:
            a, b = places[pos]
            inside = [at.get(WINDOW + i) for i in range(a, b - 1)]
            if inside and all(w and not w["first"] for w in inside):
                first = len({(w["f1"], w["f3"] - w["pos"]) for w in inside}) > 1
        (firsts if first else copies).append(pos)
    return copies, firsts


def remaining(text: bytes, repeats: list[dict], told: list[dict], divisor: int, long_line: int) -> tuple[list[bytes], int, int]:
    """The lines that stay, how many there were, and how many runs of lines went. Lines of copied chunks go, and the lines of
    copied windows if their whole run of copied lines has long_line words or more; lines of first places stay."""
    lines, places = places_of(text, divisor, long_line)
    copies, firsts = copies_and_firsts(places, repeats, told)
    in_chunk = {i for j in copies if j < WINDOW for i in range(*places[j])}
    marked = in_chunk | {i for j in copies if j >= WINDOW for i in range(*places[j])}
    drop: set[int] = set()
    i = 0
    while i < len(lines):
        end = i
        while end in marked:
            end += 1
        run = range(i, end)
        drop.update(run if sum(len(lines[k].split()) for k in run) >= long_line else in_chunk.intersection(run))
        i = max(end, i + 1)
    drop.difference_update(i for j in firsts for i in range(*places[j]))
    runs = sum(k in drop and k - 1 not in drop for k in range(len(lines)))
    return [x for k, x in enumerate(lines) if k not in drop], len(lines), runs


def without_copies(text_at: int, width: int, divisor: int, long_line: int):
    """Rows of width columns, then repeats and told (places that share their hash with other bytes)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at):
                texts, counts = [], []
                for text, repeats, told in zip(part.column(text_at).to_pylist(), part.column(width).to_pylist(), part.column(width + 1).to_pylist(), strict=True):
                    left, n, gone, runs = text, 0 if text is None else text.count("\n") + 1, 0, 0
                    if text is not None and repeats:
                        kept, n, runs = remaining(text.encode(), repeats, told or [], divisor, long_line)
                        left, gone = b"\n".join(kept).decode(), n - len(kept)
                    texts.append(left)
                    counts.append((n, gone, runs))
                columns = list(part.columns[:width])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                columns += [pa.array(x, pa.int32()) for x in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:width], *ADDED])

    return run


def by_their_bytes(placed: DataFrame, collided: DataFrame, divisor: int, long_line: int) -> DataFrame:
    """(k1, k2, told) for places whose (hash, length) stands for several byte strings: the first place of their own bytes, and
    whether they are alone with these."""
    own = placed.select("doc_id", "k1", "k2", F.explode("repeats").alias("x")).select("doc_id", "k1", "k2", "x.*")
    own = own.join(collided, ["hash", "length"], "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "hash", "length")).alias("repeats"))
    rows = placed.select("doc_id", "k1", "k2", "text").join(own, ["k1", "k2"]).select("doc_id", "k1", "k2", "text", "repeats").mapInArrow(bytes_at(divisor, long_line), PLACED).distinct()
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "k1", "k2", "pos")
    first = rows.groupBy("hash", "length", "text").agg(F.min(place).alias("f"), F.count("*").alias("n"))
    found = rows.join(first, ["hash", "length", "text"])
    is_first = (F.col("k1") == F.col("f.k1")) & (F.col("k2") == F.col("f.k2")) & (F.col("pos") == F.col("f.pos"))
    told = F.struct("pos", is_first.alias("first"), F.col("f.k1").alias("f1"), F.col("f.pos").alias("f3"), (F.col("n") == 1).alias("alone"))
    return found.groupBy("k1", "k2").agg(F.collect_list(told).alias("told"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, long_line: int = LONG_LINE) -> DataFrame:
    """All rows and columns of df, with the text column cleaned, and lines, removed_lines and removed_chunks (int; runs of lines) added.

    Lines are split at newlines. A document of which every line is gone has an empty text. Null text stays null (no lines)
    and an empty text stays empty (one line). Rows that repeat id and text are one document and keep the same text; rows of
    equal id and different text are told apart. A null id orders before all others. An empty table gives no rows. If df has
    columns named lines, removed_lines or removed_chunks, they are replaced; its other columns may have any names.
    Documents are told apart by 128 bits of hashes of id and text. The text is shuffled once, to its places."""
    spark = df.sparkSession  # joins of places are merge joins at every size: both sides grow with the documents
    df = df.drop(*ADDED)
    names = df.columns
    at, width = names.index(text_col), len(names)
    rows = df.toDF(*(f"c{i}" for i in range(width)))
    key, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{at}")
    rows = rows.withColumns({"k1": F.xxhash64(key, text), "k2": F.xxhash64(F.lit(1), text, key), "doc_id": key.cast("long")})
    places = rows.filter(text.isNotNull()).select("doc_id", "k1", "k2", text.alias("text")).mapInArrow(place_hashes(divisor, long_line), CHUNKS)
    places = materialize(places, "places")
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "k1", "k2", "pos")
    repeated = places.groupBy("hash", "length").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = materialize(repeated.select("hash", "length", F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2"), F.col("first.pos").alias("f3")), "repeated")
    first = (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")) & (F.col("pos") == F.col("f3"))
    repeats = places.join(repeated.hint("merge"), ["hash", "length"]).select("k1", "k2", F.struct("pos", "hash", "length", first.alias("first"), "f1", "f3").alias("x"))
    repeats = materialize(repeats.groupBy("k1", "k2").agg(F.collect_set("x").alias("repeats")), "repeats")  # at most the places of one document
    placed = materialize(rows.join(repeats.hint("merge"), ["k1", "k2"], "left"), "placed")
    with_places = placed.filter(F.col("repeats").isNotNull()).withColumn("text", F.col(f"c{at}"))
    texts = with_places.select("text", "repeats").mapInArrow(repeated_bytes(divisor, long_line), TEXTS).distinct()
    collided = materialize(texts.groupBy("hash", "length").agg(F.count("*").alias("n")).filter("n > 1"), "collided")
    if collided.isEmpty():
        placed = placed.withColumn("told", F.lit(None).cast(TOLD))
    else:
        placed = placed.join(materialize(by_their_bytes(with_places, collided, divisor, long_line), "told"), ["k1", "k2"], "left")
    columns = [f"c{i}" for i in range(width)]
    schema = T.StructType([*df.toDF(*columns).schema.fields, *T.StructType.fromDDL(", ".join(f"{x} int" for x in ADDED)).fields])
    return placed.select(*columns, "repeats", "told").mapInArrow(without_copies(at, width, divisor, long_line), schema).toDF(*names, *ADDED)


def query(spark, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return cleaned.select("doc_id", F.sha2(F.col("text"), 256).alias("text_sha256"), F.length("text").alias("chars"), "lines", "removed_lines", "removed_chunks")
