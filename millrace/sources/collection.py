"""A collection of documents with everything that hangs on them, changed as a whole.

Tables lie in buckets of the column by which they change: documents, chunks and vectors by document, evidence by chunk, support
counts by key; postings are a store of segments. A change writes the buckets it touches under its own number and then one
manifest, which says for every table and bucket where it is and which version of the index belongs to it. Readers follow a
manifest, so a job that dies between two tables leaves the collection as it was, and can simply be run again."""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from millrace.operators import evidence as E
from millrace.operators import segments as S
from millrace.sources.scratch import children, stored

#: What the tables are dealt out by.
BY = {"documents": "doc_id", "chunks": "doc_id", "vectors": "doc_id", "evidence": "chunk_hash", "support": "affected_key"}
KEY = ["affected_type", "affected_key"]


@dataclass
class Collection:
    spark: SparkSession
    path: str
    version: int
    places: dict[str, dict[int, int]]
    schemas: dict[str, str]
    buckets: int
    index_version: int

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        own = [f"{self.path}/{name}/v={v}/bucket={b}" for b, v in sorted(self.places[name].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schemas[name]).parquet(*own) if own else self.spark.createDataFrame([], self.schemas[name])

    def index(self) -> S.Store:
        return S.open_store(self.spark, f"{self.path}/index", self.index_version)

    def bucket(self, name: str):
        """Of a row of a table, after a cast to its kind, for numbers of another width lie elsewhere."""
        kind = self.spark.createDataFrame([], self.schemas[name]).schema[BY[name]].dataType
        return F.pmod(F.xxhash64(F.col(BY[name]).cast(kind)), F.lit(self.buckets)).cast("int")

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        return [r.bucket for r in rows.select(self.bucket(name).alias("bucket")).distinct().collect()]


def _write(at: Collection, name: str, rows: DataFrame, version: int, touched: list[int] | None) -> dict[int, int]:
    """The table's places after rows replaced the touched buckets (all, if None)."""
    path = f"{at.path}/{name}/v={version}"
    columns = at.spark.createDataFrame([], at.schemas[name]).columns
    rows.select(*columns, at.bucket(name).alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    left = {int(x.removeprefix("bucket=")): version for x in children(at.spark, path) if x.startswith("bucket=")}
    kept = {} if touched is None else {b: v for b, v in at.places[name].items() if b not in touched}
    return kept | left


def _commit(at: Collection) -> Collection:
    rows = [("bucket", name, b, v) for name, own in at.places.items() for b, v in own.items()] + [("schema", f"{name} {schema}", 0, 0) for name, schema in at.schemas.items()]
    rows += [("buckets", "", at.buckets, 0), ("index", "", at.index_version, 0)]
    at.spark.createDataFrame(rows, "what string, name string, a int, b int").coalesce(1).write.mode("overwrite").parquet(f"{at.path}/manifests/{at.version:09d}")
    return at


def create(path: str, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, evidence: DataFrame, buckets: int = 64) -> Collection:
    """documents: (doc_id, ...); chunks: (chunk_id, doc_id, chunk_hash, text, ...); vectors: (doc_id, ...); evidence: as the
    evidence operators take it. Support counts and the index are made from them."""
    spark = documents.sparkSession
    tables = {"documents": documents, "chunks": chunks, "vectors": vectors, "evidence": evidence, "support": E.support(evidence)}
    at = Collection(spark, path, 1, {}, {k: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) for k, df in tables.items()}, buckets, 1)
    for name, df in tables.items():
        at.places[name] = _write(at, name, df, 1, None)
    S.create(at.read("chunks").select("chunk_id", "doc_id", "text"), f"{path}/index")
    return _commit(at)


def open_collection(spark: SparkSession, path: str) -> Collection:
    """The newest version whose manifest is whole."""
    whole = [x for x in children(spark, f"{path}/manifests") if "_SUCCESS" in children(spark, f"{path}/manifests/{x}")]
    if not whole:
        raise ValueError(f"no collection in {path}")
    rows = spark.read.parquet(f"{path}/manifests/{max(whole)}").collect()  # a row per table and bucket
    schemas = dict(r["name"].split(" ", 1) for r in rows if r.what == "schema")
    places: dict[str, dict[int, int]] = {name: {} for name in schemas}
    for r in rows:
        if r.what == "bucket":
            places[r["name"]][r.a] = r.b
    one = {r.what: r.a for r in rows if r.what in ("buckets", "index")}
    return Collection(spark, path, int(max(whole)), places, schemas, one["buckets"], one["index"])


def delete_documents(at: Collection, doc_ids: DataFrame) -> tuple[Collection, DataFrame]:
    """The collection without these documents (doc_id), and the keys (affected_type, affected_key) whose support that changes.

    Their chunks, vectors and postings go with them; their evidence becomes inactive, and keys lose as much support as was
    active, those without any go. Unknown and null ids change nothing."""
    ids = stored(doc_ids.select("doc_id").filter("doc_id is not null").distinct(), "gone-documents")
    version, places = at.version + 1, dict(at.places)
    touched = at.touched("chunks", ids)
    hashes = stored(at.read("chunks", touched).join(ids, "doc_id", "left_semi").select("chunk_hash").distinct(), "gone-chunks")
    for name in ("documents", "chunks", "vectors"):
        own = at.touched(name, ids)
        places[name] = _write(at, name, at.read(name, own).join(ids, "doc_id", "left_anti"), version, own)
    return _without(at, places, version, hashes, S.remove(at.index(), ids).version)


def _without(at: Collection, places: dict, version: int, hashes: DataFrame, index_version: int) -> tuple[Collection, DataFrame]:
    """The version in which evidence of these chunks (chunk_hash) is inactive, and the keys that this changes."""
    own = at.touched("evidence", hashes)
    before = at.read("evidence", own)
    after, _ = E.deactivate(before, hashes)
    live = before.filter("active").join(hashes, "chunk_hash", "left_semi")
    lost = stored(E.support(live).withColumnRenamed("support_count", "lost"), "lost-support")
    places["evidence"] = _write(at, "evidence", after, version, own)
    own = at.touched("support", lost)
    counted = at.read("support", own).join(lost, KEY, "left").withColumn("support_count", F.col("support_count") - F.coalesce("lost", F.lit(0))).filter("support_count > 0")
    places["support"] = _write(at, "support", counted, version, own)
    made = Collection(at.spark, at.path, version, places, at.schemas, at.buckets, index_version)
    return _commit(made), lost.select(*KEY)


def delete_orphans(at: Collection) -> tuple[Collection, DataFrame]:
    """The collection without chunks, vectors and postings whose document is not there (or null), without the support of
    evidence whose chunk is not there, and the keys that this changes. All buckets are looked through, those of orphans are
    written."""
    documents = at.read("documents").select("doc_id").distinct()
    version, places = at.version + 1, dict(at.places)
    for name in ("chunks", "vectors"):
        own = at.touched(name, stored(at.read(name).join(documents, "doc_id", "left_anti").select("doc_id").distinct(), "orphans"))
        places[name] = _write(at, name, at.read(name, own).join(documents, "doc_id", "left_semi"), version, own)
    index = at.index()
    lost = index.chunks().select("doc_id").join(documents, "doc_id", "left_anti").distinct()
    left = Collection(at.spark, at.path, version, places, at.schemas, at.buckets, at.index_version)
    hashes = at.read("evidence").select("chunk_hash").distinct().join(left.read("chunks").select("chunk_hash"), "chunk_hash", "left_anti")
    return _without(at, places, version, stored(hashes, "orphaned-chunks"), S.remove(index, lost).version)
