"""Profiles of tables, guarded SQL on them, and results as documents."""

from __future__ import annotations

import contextlib
import re
import threading
import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from millrace.params import DEFAULT
from millrace.sources.scratch import stored

#: Words that a read-only query may not hold.
FORBIDDEN = "INSERT UPDATE DELETE DROP ALTER CREATE ATTACH DETACH PRAGMA REPLACE MERGE TRUNCATE VACUUM REINDEX".split()


class UnsafeQuery(ValueError):
    """The text is not a single read-only query."""


def long_form(df: DataFrame) -> DataFrame:
    """(column, value) with every cell as text."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns))).alias("x")).select("x.*")


def profile(df: DataFrame, most_values: int = 20) -> DataFrame:
    """column, data_type (INTEGER, REAL or TEXT), min, max, mean of numbers, the values if at most ``most_values``, else their
    number. One pass over the cells; a column of nulls is TEXT."""
    cells = long_form(df).withColumn("number", F.col("value").try_cast("double"))
    counts = cells.groupBy("column", "value", "number").agg(F.count("*").alias("n"))
    filled = F.col("value").isNotNull()
    stats = counts.groupBy("column").agg(
        F.bool_and(F.when(filled, F.col("number").isNotNull())).alias("numeric"),
        F.bool_and(F.when(filled, F.coalesce(F.col("number") == F.floor("number"), F.lit(False)))).alias("whole"),
        F.min("number").alias("least"), F.max("number").alias("largest"), (F.sum(F.col("number") * F.col("n")) / F.sum(F.when(F.col("number").isNotNull(), F.col("n")))).alias("mean"),
        F.count("value").alias("n_values"),
    )
    ranked = counts.filter(filled).withColumn("rn", F.row_number().over(Window.partitionBy("column").orderBy("value"))).filter(F.col("rn") <= most_values + 1)
    listed = ranked.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values"))
    kind = F.when(F.coalesce("numeric", F.lit(False)) & F.col("whole"), "INTEGER").when(F.coalesce("numeric", F.lit(False)), "REAL").otherwise("TEXT")
    number = lambda c: F.when(F.col("numeric"), F.col(c))
    out = stats.join(listed, "column", "left")
    return out.select("column", kind.alias("data_type"), number("least").alias("min"), number("largest").alias("max"), number("mean").alias("mean"), F.when(F.col("n_values") <= most_values, F.col("values")).alias("enum"), "n_values")


def clean_headers(names: list[str]) -> list[str]:
    """Identifiers for column names: blank or nan becomes 列i, other signs become _, a leading digit gives col_i; repeats are numbered."""
    out: list[str] = []
    for i, name in enumerate(names):
        name = (name or "").strip()
        if not name or name.lower() == "nan":
            name = f"列{i}"
        name = re.sub(r"\W+", "_", name).strip("_") or f"col_{i}"
        name = f"col_{i}" if name[0].isdigit() else name
        out.append(name if name not in out else f"{name}_{i}")
    return out


def load_typed(df: DataFrame, mapping: dict[str, str], types: dict[str, str]) -> DataFrame:
    """Columns by display name cast to their types under their new names; what can't be cast, and NaN, is null."""
    spark_type = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string"}
    value = lambda c: F.when(F.lower(F.col(f"`{c}`").cast("string")) != "nan", F.col(f"`{c}`").cast("string"))
    return df.dropna(how="all").select(*(value(c).try_cast(spark_type.get(types.get(c), "string")).alias(new) for c, new in mapping.items()))


def filled_rows(cells: DataFrame) -> DataFrame:
    """cells: (sheet_id, row_no, cells array<string>). Without rows of nulls alone; a sheet of which nothing is left is gone."""
    return cells.filter(F.exists("cells", lambda c: c.isNotNull()))


def sample_rows(cells: DataFrame, most: int = 5) -> DataFrame:
    """(sheet_id, sample): the first filled rows of each sheet in order."""
    order = Window.partitionBy("sheet_id").orderBy("row_no", "cells")
    first = filled_rows(cells).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
    return first.groupBy("sheet_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "cells"))), lambda x: x["cells"]).alias("sample"))


def list_sheets(sheets: DataFrame, doc_ids: DataFrame | None = None) -> DataFrame:
    """sheets: (doc_id, sheet_index, created_at, ...). Those of the documents (doc_id) by index with their place, or all of them,
    the newest first."""
    if doc_ids is None:
        return sheets.orderBy(F.desc("created_at"), "doc_id", "sheet_index")
    own = sheets.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return own.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet_index")))


def delete_sheets(sheets: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sheets that stay, and how many of each document go."""
    ids = doc_ids.select("doc_id").distinct()
    return sheets.join(ids, "doc_id", "left_anti"), sheets.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("deleted"))


def describe(profiles: DataFrame) -> DataFrame:
    """One row: a Markdown list of the columns."""
    line = F.concat(F.lit("- "), "column", F.lit(" ("), "data_type", F.lit(")"), F.coalesce(F.concat(F.lit(": "), F.array_join("enum", ", ")), F.lit("")))
    return profiles.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("column", line.alias("line")))), lambda x: x["line"]), "\n").alias("columns"))


def checked(sql: str) -> str:
    """The query without fences and final semicolons; UnsafeQuery unless it is one SELECT or WITH without forbidden words."""
    text = sql.strip()
    if text.startswith("```"):
        text = text.partition("\n")[2].rpartition("```")[0] if text.endswith("```") else text.partition("\n")[2]
    text = text.strip().rstrip(";").strip()
    first = text.split(None, 1)[0].upper() if text else ""
    if first not in ("SELECT", "WITH"):
        raise UnsafeQuery(f"not a query: {first or 'empty'}")
    if found := re.search(rf"\b({'|'.join(FORBIDDEN)})\b", text, re.IGNORECASE):
        raise UnsafeQuery(f"forbidden: {found[0]}")
    return text


class DeadlineExceeded(RuntimeError):
    """The query ran longer than it may."""


@contextlib.contextmanager
def deadline(spark: SparkSession, seconds: float):
    """Spark jobs that the caller's thread starts inside are cancelled after so many seconds, their tasks
    interrupted, and DeadlineExceeded is raised."""
    context, tag, done, late = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
            while not done.is_set():  # a query may go on with another job
                context.cancelJobsWithTag(tag)
                done.wait(0.2)

    watcher = threading.Thread(target=watch, daemon=True)
    interrupts = context.getLocalProperty("spark.job.interruptOnCancel")
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    watcher.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise DeadlineExceeded(f"stopped after {seconds:g} seconds") from e
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
        context.setLocalProperty("spark.job.interruptOnCancel", interrupts)
    if late.is_set():
        raise DeadlineExceeded(f"took more than {seconds:g} seconds")


def run_guarded(spark: SparkSession, sql: str, most: int = DEFAULT.sql_rows, seconds: float = DEFAULT.sql_seconds) -> DataFrame:
    """The first ``most`` rows of a read-only query, which has run when this returns: they are written, and read back. A query
    that isn't done after ``seconds`` is cancelled, which raises DeadlineExceeded."""
    text = checked(sql)
    with deadline(spark, seconds):
        return stored(spark.sql(text).limit(most), "sql-rows")


def run_first(spark: SparkSession, candidates: list[str], most: int = DEFAULT.sql_rows, seconds: float = DEFAULT.sql_seconds) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The rows of the first candidate that is safe and runs to its end in time, and the log of attempts: (sql, ok or the kind
    of error). An error while rows are made leads to the next candidate like one of analysis."""
    log = []
    for sql in candidates:
        try:
            out = run_guarded(spark, sql, most, seconds)
            return out, [*log, (sql, "ok")]
        except Exception as e:  # a bad candidate of any kind leads to the next
            log.append((sql, type(e).__name__))
    return None, log


def as_document(df: DataFrame, order: list[str], most: int = 50) -> DataFrame:
    """One row: numbered lines of col=value for the first rows. The number of rows is a feature of the document."""
    cells = F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NULL"))) for c in df.columns))
    rows = df.orderBy(*order).limit(most).select(F.struct(*order, cells.alias("line")).alias("x"))
    lines = F.transform(F.sort_array(F.collect_list("x")), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"]))
    return rows.agg(F.array_join(lines, "\n").alias("document"), F.count("*").alias("shown"))


def normal_columns(columns):
    """Column records of the old form (cn, en, type) as (display_name, column_name, data_type)."""
    return F.transform(columns, lambda c: F.struct(F.coalesce(c["display_name"], c["cn"]).alias("display_name"), F.coalesce(c["column_name"], c["en"]).alias("column_name"), F.coalesce(c["data_type"], c["type"], F.lit("TEXT")).alias("data_type")))


def chosen_sheet(recalled: DataFrame, answers: DataFrame) -> DataFrame:
    """recalled: (query_id, sheet_id, score); answers: (query_id, choice). The answer if it was recalled, else the best sheet."""
    ranked = recalled.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "sheet_id")))
    named = ranked.join(answers, "query_id", "left").withColumn("asked", F.coalesce(F.col("choice") == F.col("sheet_id"), F.lit(False)))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("asked"), "rank"))
    return named.withColumn("rn", best).filter("rn = 1").select("query_id", "sheet_id", "asked")
