"""Structured Streaming twins of the incremental jobs. Each takes a streaming (or batch) DataFrame; state that could grow for
ever is bounded by a watermark."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from millrace.operators import text as T
from millrace.operators.evidence import apply_counts
from millrace.sources.keytable import KeyTable
from millrace.sources.scratch import children


def usage(events: DataFrame) -> DataFrame:
    """Running totals per caller; update mode. The state is one row per caller."""
    return events.groupBy("caller").agg(F.count("*").alias("calls"), F.count_if("cache_hit").alias("cache_hits"), F.sum("input_tokens").alias("input_tokens"))


def daily_uploads(uploads: DataFrame, late: str = "1 hour") -> DataFrame:
    """Uploads per user and day; append mode gives a day once the watermark has passed its end, and drops what comes later."""
    counted = uploads.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("uploads"))
    return counted.select(F.col("window.start").alias("day"), "user_id", "uploads")


def first_of_key(entries: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: what has to be computed for a cache."""
    return entries.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def support(changes: DataFrame) -> DataFrame:
    """changes: (affected_type, affected_key, delta). Current counts, and whether the key is to be stored or deleted; update mode."""
    counts = changes.groupBy("affected_type", "affected_key").agg(F.sum("delta").alias("support_count"))
    return counts.withColumn("operation", F.when(F.col("support_count") > 0, "UPSERT").otherwise("DELETE"))


def sync_batches(path: str):
    """For foreachBatch over ``support``: replaces the keys of a batch in the stored counts. Versions are by batch id, and a batch
    starts from the newest version below its own, so one that is run again writes the same version anew. A store that can't be
    read is an error, not an empty table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in (int(x.removeprefix("v=")) for x in children(spark, path) if x.startswith("v=")) if v < batch_id]
        counts = "affected_type string, affected_key string, support_count bigint"
        stored = spark.read.schema(counts).parquet(f"{path}/v={max(before)}") if before else spark.createDataFrame([], counts)
        keys = batch.select("affected_type", "affected_key")
        apply_counts(stored, batch.filter("support_count > 0").drop("operation"), keys).write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return write


SUPPORT = "affected_type string, affected_key string, support_count bigint"


def support_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyTable:
    return KeyTable(spark, path, SUPPORT, ["affected_type", "affected_key"], buckets)


def sync_keys(path: str, buckets: int = 64):
    """For foreachBatch over ``support``: the stored counts as a table of keys, of which a batch rewrites the buckets of its keys
    and nothing else. Read it by ``support_table(spark, path).read()``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("affected_type", "affected_key", "support_count", (F.col("support_count") <= 0).alias("deleted"))
        support_table(batch.sparkSession, path, buckets).replace(batch_id, rows)

    return write


def with_rocks(spark: SparkSession, start):
    """What ``start()`` gives, a streaming query whose state is in RocksDB: a batch writes its changes to the state, not all of it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return start()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def ingest(docs: DataFrame, path: str) -> str:
    """docs: a stream of (doc_id, markdown). Cuts what has come into chunks and takes in those whose hash is new; gives the
    folder of chunks, by batch. Call it again with the same path, and a stream of the same source, to go on.

    Two streams with checkpoints of their own: the first writes the chunks of each batch of documents to a log; the second reads
    the log and passes each hash once, by keyed state. So a batch costs what it brings, however much came before. A batch of
    either that is run again replaces its own folder, and hashes that the log then holds twice pass once."""
    spark = docs.sparkSession

    def log(batch: DataFrame, batch_id: int) -> None:
        T.chunks(batch).write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/chunks/batch={batch_id}")

    docs.writeStream.option("checkpointLocation", f"{path}/log-state").foreachBatch(log).trigger(availableNow=True).start().awaitTermination()
    schema = T.chunks(spark.createDataFrame([], docs.schema)).schema
    new = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/log").dropDuplicates(["chunk_hash"])
    sink = new.writeStream.option("checkpointLocation", f"{path}/chunk-state").foreachBatch(keep).trigger(availableNow=True)
    with_rocks(spark, sink.start).awaitTermination()
    return f"{path}/chunks"


def ingest_batches(path: str):
    """For foreachBatch over (doc_id, markdown) of new files: their chunks, each hash once whatever batches it comes in. Folders
    are by batch id, so a batch that is run again replaces its own. It looks through the hashes of all batches; ``ingest`` keeps
    them as state instead."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = T.chunks(batch).dropDuplicates(["chunk_hash"])
        others = [f"{path}/{x}" for x in children(spark, path) if x.startswith("batch=") and x != f"batch={batch_id}"]
        if others:
            new = new.join(spark.read.parquet(*others).select("chunk_hash"), "chunk_hash", "left_anti").select(*new.columns)
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
