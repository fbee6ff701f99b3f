"""Materialised intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Bound the bytes of an Arrow batch for the session, unless its user has chosen a bound: texts are long, and the default of
    64 MB, held on both sides and by two tasks of an executor, is much of a small executor's memory. The setting stays, for a
    plan that runs later reads it then."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, most)


def tidied(run):
    """A function for mapInArrow that gives unused memory back when its task ends: workers live on, and what they keep counts
    against their executor while others run."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # no glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def plain(x: object) -> dict:
    """The attributes of an object, for a broadcast: workers need not have its class on their path."""
    return {k: plain(v) if hasattr(v, "__dict__") and not callable(v) else v for k, v in vars(x).items()}


def restored(kind: type, state: dict) -> object:
    x = object.__new__(kind)
    x.__dict__.update(state)
    return x


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset and everything runs in one process (tests)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("millrace.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("millrace.scratch.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors, and, unlike an eager
    checkpoint, runs the plan a single time."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table made here; call it once the results have been written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/millrace")
    path.getFileSystem(conf).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which users size to their data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
