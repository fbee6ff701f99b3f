"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    shared, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    shared = shared or tempfile.mkdtemp(prefix="millrace-")
    return f"{shared.rstrip('/')}/millrace-tables/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back, for what a plan uses more than once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sendable(df: DataFrame, most: int = 500_000, most_bytes: int = 16 << 20) -> bool:
    """Whether a stored table of one column of text or numbers is small enough to be sent to every task."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(df.columns[0]).cast("string"))), F.lit(0)).alias("bytes")).first()
    return size.n <= most and size.bytes <= most_bytes


def among(rows: DataFrame, keys: DataFrame, on: str, most: int = 500_000) -> DataFrame:
    """The rows whose ``on`` is one of the keys (on): few keys go to the tasks, so that only the rows found are ever shuffled."""
    own = stored(keys.select(on).distinct(), "among")
    return rows.join(F.broadcast(own) if sendable(own, most) else own, on, "left_semi")


def kept_folder(table: DataFrame, name: str, make) -> str:
    """The folder that ``make(path)`` filled from a table of files, made anew when these files are others or have changed."""
    spark = table.sparkSession
    at = table.select("_metadata.file_path", "_metadata.file_modification_time").agg(F.count("*"), F.max("file_modification_time"), F.min("file_path"), F.max("file_path")).first()
    key = (spark.sparkContext.applicationId, name, *map(str, at))
    if key not in _KEPT:
        path = new_folder(spark, name)
        make(path)
        _KEPT[key] = path
    return _KEPT[key]


def spread(df: DataFrame) -> DataFrame:
    """df itself if its files make enough tasks, else dealt out over the cores: a table in a single row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder. Errors of the store are raised."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(conf)
    return sorted(x.getPath().getName() for x in store.listStatus(folder)) if store.exists(folder) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete every table that ``stored`` and ``new_folder`` made in the shared folder; call it once the results have been
    written."""
    _KEPT.clear()
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        delete_folder(spark, f"{shared.rstrip('/')}/millrace-tables")
