"""Model usage, quotas, cache entries and the task queue, in batch."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


def by_caller(events: DataFrame) -> DataFrame:
    """events: (caller, input_chars, output_chars, input_tokens, output_tokens, cache_hit). Totals per caller and over all (null)."""
    hits = F.count_if("cache_hit")
    sums = [F.sum(c).alias(c) for c in ("input_chars", "output_chars", "input_tokens", "output_tokens")]
    out = events.rollup("caller").agg(F.count("*").alias("calls"), hits.alias("cache_hits"), *sums)
    return out.withColumn("real_calls", F.col("calls") - F.col("cache_hits")).withColumn("hit_rate", F.round(100 * F.col("cache_hits") / F.col("calls"), 2))


def tokens_used(metadata: Column) -> tuple[Column, Column]:
    """Input and output tokens under either of their names in a response's JSON; 0 when absent."""
    number = lambda *paths: F.coalesce(*(F.nullif(F.get_json_object(metadata, p).try_cast("bigint"), F.lit(0).cast("bigint")) for p in paths), F.lit(0).cast("bigint"))
    return number("$.prompt_tokens", "$.input_tokens"), number("$.completion_tokens", "$.output_tokens")


def quota(uploads: DataFrame, limit: int = 10) -> DataFrame:
    """uploads: (user_id, upload_id, ts). Each with its place on the user's day and whether it is past the limit."""
    day = F.to_date("ts")
    order = Window.partitionBy("user_id", day).orderBy("ts", "upload_id")
    return uploads.withColumn("day", day).withColumn("place", F.row_number().over(order)).withColumn("over", F.col("place") > limit)


def live_entries(entries: DataFrame, now: Column, prefix: str = "") -> DataFrame:
    """Entries not expired at ``now``, newest first, with the seconds that remain (null: for ever)."""
    live = entries.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).filter(F.col("key").startswith(prefix))
    return live.withColumn("remaining", F.col("expires_at") - now).orderBy(F.desc("created_at"), "key")


def namespaces(entries: DataFrame) -> DataFrame:
    name = F.when(F.col("key").contains(":"), F.substring_index("key", ":", 1)).otherwise("(no-ns)")
    return entries.groupBy(name.alias("namespace")).agg(F.count("*").alias("entries"))


def cache_key(namespace: str, *parts: Column) -> Column:
    return F.concat(F.lit(namespace + ":"), F.substring(F.sha2(F.concat_ws("␟", *parts), 256), 1, 32))


def latest(entries: DataFrame, now: Column, default_ttl: float = 3600.0) -> DataFrame:
    """entries: (key, value, created_at, ttl). The last value of each key that still lives: a ttl of 0 stores nothing, null is
    the default, a negative one never ends."""
    stored = entries.filter("ttl is null or ttl <> 0").withColumn("ttl", F.coalesce("ttl", F.lit(default_ttl)))
    last = stored.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("created_at"), F.desc("value")))).filter("rn = 1")
    return last.filter((F.col("ttl") < 0) | (F.col("created_at") + F.col("ttl") > now)).select("key", "value", "created_at")


def drain(tasks: DataFrame, failed: Column, batch: int = 50, retries: int = 3) -> DataFrame:
    """Tasks after the oldest ``batch`` pending ones have run: SUCCESS, or back to PENDING until ``retries``, then FAILED."""
    chosen = tasks.filter("status = 'PENDING'").orderBy("created_at", "task_id").limit(batch).select("task_id", F.lit(True).alias("ran"))
    ran = tasks.join(F.broadcast(chosen), "task_id", "left").withColumn("ran", F.coalesce("ran", F.lit(False)))
    count = F.col("retry_count") + (F.col("ran") & failed).cast("int")
    status = F.when(~F.col("ran"), F.col("status")).when(~failed, "SUCCESS").when(count < retries, "PENDING").otherwise("FAILED")
    return ran.select("task_id", status.alias("status"), count.alias("retry_count"), "created_at")


def without_old(tasks: DataFrame, now: Column, days: int = 7) -> DataFrame:
    old = (F.col("status") == "SUCCESS") & (F.col("updated_at") < now - F.expr(f"interval {days} days"))
    return tasks.filter(~F.coalesce(old, F.lit(False)))
