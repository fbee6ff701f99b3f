"""A training corpus from the documents table: five stages, each a DataFrame to DataFrame function over whole texts.

Between stages the documents are written as Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from millrace.llm.scratch import materialize

#: Columns of documents that stages read or set; all others may have any names and come through as they are.
OWN = ("doc_id", "text", "lang", "n_chars")

#: A text in which no language holds this share of the letters has no language to train on.
LEAST_SCORE = 0.2


def apart(docs: DataFrame) -> DataFrame:
    """docs with the columns that no stage knows under names by their places, which no operator uses."""
    return docs.toDF(*(c if c in OWN else f"column_{i}" for i, c in enumerate(docs.columns)))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: those without letters go, those in which none stands out, and those that no learned
    language explains (most letters in another script, or n-grams nearer to chance than to labelled text). The model learns
    from the labelled documents themselves; lang stays as it was."""
    rows = apart(docs)
    found = language_id.annotate(rows, language_id.fit(rows), evidence=True)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & F.col("supported")).select(*rows.columns).toDF(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the repeated chunks of lines; a document of which nothing is left goes. n_chars, if there is such a column, is
    that of the new text."""
    rows = apart(docs)
    kept = line_dedup.line_dedup(rows).filter((F.col("removed_chunks") == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in rows.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("removed_chunks") > 0, F.length("text").cast(rows.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*rows.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id. Documents without words are in no group. Rows
    of one id and different texts are judged apart; of rows that repeat id and text one stays, as of copies with a null id."""
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Language models and tokenizers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
