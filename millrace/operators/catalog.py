"""The document catalog: folders, tags, scopes, moves, deletions, orphans."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame


def normal_folder(path: Column) -> Column:
    return F.concat(F.lit("/"), F.regexp_replace(F.coalesce(path, F.lit("")), "^/+|/+$", ""))


def below(folder: Column, root: str) -> Column:
    return F.lit(True) if root == "/" else (folder == root) | folder.startswith(root + "/")


def listing(docs: DataFrame, folder: str | None = None, tags: list[str] | None = None, status: str | None = None, kind: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first. The root folder means itself alone, any other its subtree; tags filter before the limit."""
    if folder:
        docs = docs.filter(F.col("folder") == "/" if folder == "/" else below(F.col("folder"), folder))
    if tags:
        docs = docs.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if status:
        docs = docs.filter(F.col("status") == status)
    if kind:
        docs = docs.filter(F.lower("filename").endswith("." + kind.lower()))
    return docs.orderBy(F.desc("created_at"), "doc_id").offset(offset).limit(limit)


def folders(docs: DataFrame, markers: DataFrame) -> DataFrame:
    counts = docs.groupBy(F.col("folder").alias("path")).agg(F.count("*").alias("documents"))
    return counts.join(markers.select("path").distinct(), "path", "full_outer").fillna(0, ["documents"])


def tag_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("documents"))


def scope(docs: DataFrame, folder: str | None = None, tags: list[str] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Document ids to search in; explicit ids win over folder and tags."""
    if ids is not None:
        return ids.select("doc_id").distinct()
    if folder:
        docs = docs.filter(below(F.col("folder"), folder))
    if tags:
        docs = docs.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return docs.select("doc_id")


def move(rows: DataFrame, source: str, target: str, column: str = "folder") -> DataFrame:
    inside = below(F.col(column), source)
    return rows.withColumn(column, F.when(inside, F.concat(F.lit(target), F.substr(F.col(column), F.lit(len(source) + 1)))).otherwise(F.col(column)))


def delete_folder(rows: DataFrame, path: str, column: str = "folder") -> DataFrame:
    return rows.filter(~below(F.col(column), path))


def add_tag(tags: Column, tag: str) -> Column:
    return F.when(F.array_contains(tags, tag), tags).otherwise(F.concat(tags, F.array(F.lit(tag))))


def remove_tag(tags: Column, tag: str) -> Column:
    return F.array_remove(tags, tag)


def cascade(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents."""
    return {name: df.join(doc_ids, "doc_id", "left_anti") for name, df in tables.items()}


def reindex(chunks: DataFrame, new: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with those of new's documents replaced, and the catalog with their versions raised by one."""
    ids = new.select("doc_id").distinct()
    kept = chunks.join(ids, "doc_id", "left_anti").unionByName(new)
    raised = docs.join(ids.withColumn("__new", F.lit(1)), "doc_id", "left")
    return kept, raised.withColumn("doc_version", F.col("doc_version") + F.coalesce("__new", F.lit(0))).drop("__new")


def orphans(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows whose document is gone; a null doc_id is an orphan."""
    return rows.join(docs.select("doc_id"), "doc_id", "left_anti")
