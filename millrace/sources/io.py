"""Reading and writing corpora, evidence, evaluation sets and tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from millrace.sources.scratch import stored

#: File extensions that may be uploaded.
EXTENSIONS = ["pdf", "docx", "pptx", "xlsx", "png", "jpg", "jpeg", "txt", "md"]
SAMPLE = "id string, query string, query_type string, ground_truth_answer string, ground_truth_sources array<string>, ground_truth_ids array<string>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, markdown) of text files: the id is the file name without its extension."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("markdown"))


def extension(filename: Column) -> Column:
    return F.when(filename.contains("."), F.lower(F.substring_index(filename, ".", -1))).otherwise(F.lit(""))


def accepted(files: DataFrame, name: str = "filename") -> DataFrame:
    return files.filter(extension(F.col(name)).isin(EXTENSIONS))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of equal keys; of several new rows the one of the largest version stays."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc("version"))
    return both.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn", "__new")


def read_samples(spark: SparkSession, *paths: str) -> DataFrame:
    """Evaluation samples of JSON array files, concatenated."""
    return spark.read.schema(SAMPLE).json(list(paths), multiLine=True)


def write_samples(samples: DataFrame, path: str, most: int = 1000) -> None:
    """JSON array files of at most ``most`` samples each, which read_samples reads."""
    rows = samples.select(F.to_json(F.struct(*samples.columns)).alias("value"))

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), most):
                yield pd.DataFrame({"value": ["[" + ",".join(batch["value"].iloc[at : at + most]) + "]"]})

    rows.mapInPandas(arrays, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def import_samples(old: DataFrame, new: DataFrame, mode: str = "merge") -> DataFrame:
    """new replaces old, or is added with ids counting on from the largest integer id, of three digits at least, in the order of
    the queries. Places come from a sort by ranges and the numbers of rows in them, so no task orders all rows."""
    if mode == "replace":
        return new
    last = old.agg(F.coalesce(F.max(F.expr("try_cast(id as int)")), F.lit(0)).alias("last")).first().last
    part = stored(new.repartitionByRange("query").sortWithinPartitions("query").withColumn("__part", F.spark_partition_id()), "samples")
    held = part.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    placed = part.withColumn("__place", F.row_number().over(Window.partitionBy("__part").orderBy("query"))).join(held.select("__part", before.alias("__before")), "__part")
    numbered = placed.withColumn("id", F.format_string("%03d", (F.col("__place") + F.col("__before") + last).cast("int")))
    return old.unionByName(numbered.select(*new.columns))


def upsert_evidence(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """old with the batch's rows in place of those of equal evidence_id; they are active and dated now, and what they lack is
    empty (texts of evidence and extractor) or 0.5 (confidence). Of rows that repeat an id in the batch, that of the largest
    columns stays."""
    names = [c for c in old.columns if c not in ("evidence_id", "active", "created_at", "updated_at")]
    given = {"evidence_text": F.lit(""), "extractor_version": F.lit(""), "confidence": F.lit(0.5)}
    value = lambda c: F.coalesce(*([F.col(c)] if c in new.columns else []), *([given[c]] if c in given else []), F.lit(None)).cast(old.schema[c].dataType).alias(c)
    rows = new.select("evidence_id", *map(value, names)).groupBy("evidence_id").agg(F.max(F.struct(*names)).alias("x")).select("evidence_id", "x.*")
    rows = rows.withColumns({"active": F.lit(True), "created_at": now, "updated_at": now}).select(*old.columns)
    return old.join(rows.select("evidence_id"), "evidence_id", "left_anti").select(*old.columns).unionByName(rows)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per report file, newest name first: its summary, 0 for some missing metrics and null for others."""
    rows = spark.read.schema("summary struct<total:bigint,recall_at_5:double,ndcg_at_5:double,mrr:double,hallucination_rate:double>").json(path, multiLine=True)
    named = rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), "summary.*")
    return named.fillna(0, ["total"]).fillna(0.0, ["recall_at_5", "mrr"]).orderBy(F.desc("filename"))


def load_tables(spark: SparkSession, path: str, names: list[str], depth: int = 4) -> dict[str, DataFrame]:
    """Parquet tables found below a directory by name: of several, the one of the shallowest and first path. A missing one is an
    error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = {}
    for name in names:
        for level in range(depth):
            pattern = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{'*/' * level}{name}.parquet")
            found = sorted(x.getPath().toString() for x in pattern.getFileSystem(conf).globStatus(pattern) or [])
            if found:
                out[name] = spark.read.parquet(found[0])
                break
        else:
            raise FileNotFoundError(f"{name}.parquet below {path}")
    return out
