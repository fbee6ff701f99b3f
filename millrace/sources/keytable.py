"""A table of one row per key that batches change: rows lie in buckets of their key, and a batch rewrites the buckets it touches.

What a batch reads and writes depends on its keys' buckets and not on how many batches came before. A version's manifest, which
is written last, says for every bucket which batch wrote it; a job that ends before its manifest leaves the state before it, and
a batch that is run again starts from that state and gives the same version anew."""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from millrace.sources.scratch import children, delete_folder, stored


@dataclass
class KeyTable:
    """keys: columns of schema that make a key. The number of buckets is fixed once there is a version."""

    spark: SparkSession
    path: str
    schema: str
    keys: list[str]
    buckets: int = 64

    def versions(self) -> list[int]:
        found = (x for x in children(self.spark, f"{self.path}/manifests") if x.startswith("v="))
        return sorted(int(x.removeprefix("v=")) for x in found if "_SUCCESS" in children(self.spark, f"{self.path}/manifests/{x}"))

    def state(self, before: int | None = None) -> dict[int, int]:
        """By bucket the batch that wrote it, as of the newest version (below ``before``)."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return {}
        rows = self.spark.read.schema("bucket int, version bigint").parquet(f"{self.path}/manifests/v={known[-1]}").collect()  # a row per bucket
        return {r.bucket: r.version for r in rows}

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the newest version, or of the one below a batch, of all buckets or some."""
        folders = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(self.state(before).items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def replace(self, batch_id: int, rows: DataFrame) -> None:
        """rows: the schema's columns and ``deleted``, one row per key. Their keys' rows give way to them, deleted keys go."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = stored(rows.withColumn("bucket", bucket), "batch")
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
        if not touched:
            return
        state = self.state(batch_id)
        columns = self.spark.createDataFrame([], self.schema).columns
        old = self.read(batch_id, touched).join(rows.select(*self.keys), self.keys, "left_anti").select(*columns).withColumn("bucket", bucket)
        new = old.unionByName(rows.filter("not deleted").select(*columns, "bucket"))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={batch_id}")
        left = {int(x.removeprefix("bucket=")) for x in children(self.spark, f"{self.path}/data/v={batch_id}") if x.startswith("bucket=")}
        state = {b: v for b, v in state.items() if b not in touched} | {b: batch_id for b in touched if b in left}
        self.spark.createDataFrame(sorted(state.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/v={batch_id}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete what none of the newest ``keep`` versions needs."""
        known = self.versions()
        if len(known) <= keep:
            return
        needed = {v for k in known[-keep:] for v in self.state(k + 1).values()}
        for v in known[:-keep]:
            delete_folder(self.spark, f"{self.path}/manifests/v={v}")
            if v not in needed:
                delete_folder(self.spark, f"{self.path}/data/v={v}")
