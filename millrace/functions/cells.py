"""An inverted file of vectors: cells of k-means, residuals of a byte per dimension by cell, full vectors read for a short list.

A vector of length one is its cell's centre and a residual, which is kept in bytes together with the length of what rounding
took from it. So a code gives a score and how far it can be off. A search scores the codes of the cells that a query probes and
reads full vectors only where a code's best case reaches the k-th best worst case: of the cells probed, no hit is lost. All
cells probed is the exact search; fewer are chosen by the recall that sampled vectors have with them."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from millrace.functions.vectors import best_of, query_blocks, ranked, unit
from millrace.sources.scratch import stored

#: Vectors that k-means learns from, at most about; vectors of a file; cells at most.
SAMPLE, FILE_ROWS, MOST_CELLS = 20_000, 1 << 18, 4096
#: Scores that a task computes at once, and candidates that it holds before it drops those that have been outdone.
SCORES, HELD = 1 << 20, 1 << 20
#: What single precision and sums in another order may add to an error.
SLACK = 2e-6


@dataclass
class Cells:
    """codes: (cell, id, code, scale, error), vectors: (cell, id, vector), both stored by cell; centres: a row per cell, of length
    one or zero; sizes: vectors by cell."""

    codes: DataFrame
    vectors: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    seen: dict = field(default_factory=dict)


def centres_of(vectors: DataFrame, n: int, cells: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1, SAMPLE / max(n, 1))))
    rows = rows.withColumn("v", F.transform("vector", lambda x: x.cast("double"))).filter(F.exists("v", lambda x: x != 0))
    if rows.isEmpty():
        return np.zeros((1, 1))
    model = KMeans(k=cells, seed=1, maxIter=8, distanceMeasure="cosine").fit(rows.select(array_to_vector("v").alias("features")))
    return unit(model.clusterCenters())


def coded(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for batch in batches:
            if len(batch):
                u = unit(batch["vector"])
                cell = np.argmax(u @ centres.T, axis=1) if centres.shape[1] == u.shape[1] else np.zeros(len(u), int)
                rest = u - (centres[cell] if centres.shape[1] == u.shape[1] else 0)
                scale = np.maximum(np.abs(rest).max(1), 1e-30).astype(np.float32).astype(float) / 127
                code = np.clip(np.rint(rest / scale[:, None]), -127, 127).astype(np.int8)
                error = np.linalg.norm(rest - code * scale[:, None], axis=1) + SLACK
                yield pd.DataFrame({"cell": cell.astype(np.int32), "id": batch["id"], "vector": batch["vector"], "code": [x.tobytes() for x in code], "scale": scale, "error": error})

    return run


def build(vectors: DataFrame, path: str, cells: int | None = None) -> Cells:
    """vectors: (id, vector). Every vector that isn't null is indexed; cells and their centres come from a sample, by default a
    cell for four of its vectors and MOST_CELLS at most. A cell is dealt out to as many files as its size asks for."""
    spark = vectors.sparkSession
    rows = vectors.filter("vector is not null").select(F.col("id").cast("long").alias("id"), "vector")
    n = rows.count()
    centres = centres_of(rows, n, cells or int(np.clip(min(n, SAMPLE) // 4, 1, MOST_CELLS)))
    kind = rows.schema["vector"].dataType.simpleString()
    made = stored(rows.mapInPandas(coded(spark.sparkContext.broadcast(centres)), f"cell int, id bigint, vector {kind}, code binary, scale double, error double"), "coded")
    sizes = np.zeros(len(centres), np.int64)
    for r in made.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row per cell
        sizes[r.cell] = r.n
    files = spark.createDataFrame([(c, int(-(-s // FILE_ROWS))) for c, s in enumerate(sizes.tolist()) if s] or [(0, 1)], "cell int, files int")
    dealt = made.join(F.broadcast(files), "cell").repartition("cell", F.pmod(F.xxhash64("id"), F.col("files")))
    dealt.select("cell", "id", "code", "scale", "error").write.partitionBy("cell").parquet(f"{path}/codes")
    dealt.select("cell", "id", "vector").write.partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(c, s, x) for c, (s, x) in enumerate(zip(sizes.tolist(), centres.tolist(), strict=True))], "cell int, size bigint, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    spark.createDataFrame([], f"id bigint, vector {kind}").coalesce(1).write.parquet(f"{path}/kind")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Cells:
    rows = sorted(spark.read.parquet(f"{path}/centres").collect())
    kind = spark.read.parquet(f"{path}/kind").schema["vector"].dataType.simpleString()
    codes = spark.read.schema("id bigint, code binary, scale double, error double, cell int").parquet(f"{path}/codes")
    vectors = spark.read.schema(f"id bigint, vector {kind}, cell int").parquet(f"{path}/vectors")
    return Cells(codes, vectors, np.array([r.centre for r in rows]), np.array([r.size for r in rows]))


def scan(shared, k: int):
    """Rows of codes to (query_id, id, cell, low, high): those that can be among the k best by what the task has seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, centres, probed = shared.value
        near, best, held, n, most = q @ centres.T, np.full((len(ids), 0), -np.inf), [], 0, HELD
        step = min(4096, max(1, SCORES // max(len(ids), 1)))
        for batch in batches:
            for cell, part in batch.groupby("cell"):
                own = probed[cell]
                for at in range(0, len(part), step):
                    rows = part.iloc[at : at + step]
                    code = np.frombuffer(b"".join(rows["code"]), np.int8).reshape(len(rows), -1).astype(np.float32)
                    score = near[own, cell][:, None] + (q[own].astype(np.float32) @ code.T).astype(float) * rows["scale"].to_numpy()
                    error, key = rows["error"].to_numpy(), rows["id"].to_numpy()
                    low = np.full((len(ids), len(rows)), -np.inf)
                    low[own] = score - error
                    best, _ = best_of(np.hstack([best, low]), np.zeros((len(ids), best.shape[1] + len(rows)), np.int64), k)
                    least = best.min(1) if best.shape[1] == k else np.full(len(ids), -np.inf)
                    i, j = np.nonzero(score + error >= least[own][:, None])
                    held.append((own[i], key[j], np.full(len(i), cell), low[own[i], j], (score + error)[i, j]))
                    n += len(i)
                    if n > most:  # what is left may be as many again
                        held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                        left = held[0][4] >= least[held[0][0]]
                        held = [tuple(x[left] for x in held[0])]
                        n, most = int(left.sum()), max(HELD, 2 * int(left.sum()))
        if held:
            least = best.min(1) if best.shape[1] == k else np.full(len(ids), -np.inf)
            i, key, cell, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            left = high >= least[i]
            yield pd.DataFrame({"query_id": ids[i[left]], "id": key[left], "cell": cell[left].astype(np.int32), "low": low[left], "high": high[left]})

    return run


def rescore(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value[:2]
        place = {x: i for i, x in enumerate(ids.tolist())}
        for batch in batches:
            if len(batch):
                own = q[[place[x] for x in batch["query_id"]]]
                yield pd.DataFrame({"query_id": batch["query_id"], "id": batch["id"], "score": np.round((own * unit(batch["vector"])).sum(1), 9) + 0.0, "cell": batch["cell"]})

    return run


def search(cells: Cells, queries: DataFrame, k: int, probes: int | None = None, most_queries: int = 4096) -> DataFrame:
    """(query_id, id, score, rank, cell): the k best by cosine, ties by id. queries: (query_id, vector). ``probes`` cells nearest
    to a query are searched, all if None, and these exactly. Only the folders of cells that are probed are listed and read, and
    of the full vectors those cells and rows that a code leaves in question. How many codes and vectors came up is added to
    ``cells.seen``."""
    spark, out = cells.codes.sparkSession, []
    schema = "query_id bigint, id bigint, score double, cell int"
    for own in query_blocks(queries.select("query_id", "vector"), most_queries):
        ids, q = np.array([r.query_id for r in own]), unit(r.vector for r in own)
        same = q.shape[1] == cells.centres.shape[1]
        centres = cells.centres if same else np.zeros((len(cells.centres), q.shape[1]))
        mask = np.ones((len(q), len(centres)), bool)
        if probes is not None and probes < len(centres):
            mask[:] = False
            np.put_along_axis(mask, np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes], True, 1)
        asked = [int(c) for c in np.flatnonzero(mask.any(0) & (cells.sizes > 0))]
        shared = spark.sparkContext.broadcast((ids, q, centres, {c: np.flatnonzero(mask[:, c]) for c in asked}))
        found = cells.codes.filter(F.col("cell").isin(asked)).select("id", "code", "scale", "error", "cell").mapInPandas(scan(shared, k), "query_id bigint, id bigint, cell int, low double, high double")
        found = stored(found, "short-list")
        order = Window.partitionBy("query_id").orderBy(F.desc("low"))
        least = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).select("query_id", F.col("low").alias("least"))
        short = stored(found.join(F.broadcast(least), "query_id", "left").filter("least is null or high >= least").select("query_id", "id", "cell"), "short-list")  # least: a row per query of the block
        where = [r.cell for r in short.select("cell").distinct().collect()]
        full = cells.vectors.filter(F.col("cell").isin(where)).join(short, ["cell", "id"]).select("query_id", "id", "vector", "cell")
        out.append(ranked(full.mapInPandas(rescore(shared), schema), k))
        for name, n in (("queries", len(ids)), ("codes", int((mask * cells.sizes).sum())), ("vectors", short.count())):
            cells.seen[name] = cells.seen.get(name, 0) + n
    return functools.reduce(DataFrame.unionByName, out) if out else ranked(spark.createDataFrame([], schema), k)


def probes_for(cells: Cells, k: int, recall: float = 0.93, sample: int = 256) -> int:
    """The least number of probes with which sampled vectors find that share of their k nearest others."""
    n, seen = int(cells.sizes.sum()), dict(cells.seen)
    rows = cells.vectors.filter(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) < int((1 << 30) * min(1, sample / max(n, 1))))
    own = [(r.id, r.vector) for r in rows.select("id", "vector").collect()]  # about ``sample`` rows
    if not own:
        return len(cells.centres)
    asked = cells.codes.sparkSession.createDataFrame(own, rows.select(F.col("id").alias("query_id"), "vector").schema)
    hits = search(cells, asked, k + 1).filter("query_id <> id").select("query_id", "cell").collect()  # k + 1 rows a query
    cells.seen.clear()
    cells.seen.update(seen)
    away = -(unit(v for _, v in own) @ cells.centres.T)
    place = dict(zip((i for i, _ in own), np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1), strict=True))
    ranks = sorted(int(place[r.query_id][r.cell]) for r in hits)
    return ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] + 1 if ranks else len(cells.centres)
