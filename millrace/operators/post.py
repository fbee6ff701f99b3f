"""From hits to a context: duplicates, neighbours, packing, citations and the predicates of routing."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from millrace.params import DEFAULT

#: Phrases by which an answer says that it lacks information.
INSUFFICIENT = ["没有足够的信息", "无法回答", "无法找到", "信息不足", "不足以回答", "缺乏相关信息", "未提供足够", "insufficient information", "cannot answer", "no information", "not enough information"]
#: Query types that a router may name.
QUERY_TYPES = ["chitchat", "simple_fact", "multi_hop", "comparison", "definition"]


def dedup(hits: DataFrame) -> DataFrame:
    """hits: (query_id, rank, chunk_id, text). First of each chunk id (blank ids all stay), then first of each trimmed text."""
    by_id = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    once = hits.withColumn("rn", F.row_number().over(by_id)).filter((F.col("rn") == 1) | (F.coalesce(F.col("chunk_id").cast("string"), F.lit("")) == ""))
    by_text = Window.partitionBy("query_id", F.trim("text")).orderBy("rank")
    return once.withColumn("rn", F.row_number().over(by_text)).filter("rn = 1").drop("rn")


def chunk_index(metadata_index: Column, chunk_id: Column) -> Column:
    suffix = F.nullif(F.regexp_extract(chunk_id, r"_chunk_(\d+)$", 1), F.lit(""))
    return F.coalesce(metadata_index.cast("int"), suffix.try_cast("int"))


def merge_adjacent(hits: DataFrame, most: int = DEFAULT.merge_chars) -> DataFrame:
    """hits: (query_id, doc_id, chunk_id, idx, text, score). Runs of neighbouring chunks become one while the joined text has at
    most ``most`` characters; ids are joined by +, the best score stands for all."""
    run = Window.partitionBy("query_id", "doc_id").orderBy("idx", "chunk_id")
    rows = hits.withColumn("island", F.when(F.col("idx").isNull(), F.concat(F.lit("n"), "chunk_id")).otherwise((F.col("idx") - F.row_number().over(run)).cast("string")))
    items = F.sort_array(F.collect_list(F.struct("idx", "chunk_id", "text", "score")))
    kind = "array<struct<ids:array<string>,text:string,score:double>>"

    def fold(acc, x):
        last = F.element_at(acc, -1)
        one = F.struct(F.array(x["chunk_id"]).alias("ids"), x["text"].alias("text"), x["score"].alias("score"))
        both = F.struct(F.concat(last["ids"], F.array(x["chunk_id"])).alias("ids"), F.concat(last["text"], F.lit("\n\n"), x["text"]).alias("text"), F.greatest(last["score"], x["score"]).alias("score"))
        fits = (F.size(acc) > 0) & (F.length(last["text"]) + 2 + F.length(x["text"]) <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(one)))

    merged = rows.groupBy("query_id", "doc_id", "island").agg(F.aggregate(items, F.array().cast(kind), fold).alias("m"))
    out = merged.select("query_id", "doc_id", F.explode("m").alias("x")).select("query_id", "doc_id", F.array_join("x.ids", "+").alias("chunk_id"), "x.text", "x.score")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def pack_context(hits: DataFrame, most: int = DEFAULT.context_chars) -> DataFrame:
    """hits: (query_id, rank, text). Numbered blocks within ``most`` characters, cut between blocks, or inside the first one."""
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = hits.withColumn("n", F.row_number().over(order)).withColumn("block", F.concat(F.lit("["), "n", F.lit("]\n"), "text"))
    ends = F.sum(F.length("block") + 7).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 7
    total = F.sum(F.length("block") + 7).over(Window.partitionBy("query_id")) - 7
    kept = rows.withColumn("end", ends).withColumn("total", total).filter((F.col("total") <= most) | (F.col("end") + 7 <= most) | (F.col("n") == 1))
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda x: x["block"])
    return kept.groupBy("query_id").agg(F.substring(F.array_join(blocks, "\n\n---\n\n"), 1, most).alias("context"), F.count("*").alias("blocks"))


def citations(hits: DataFrame, most: int = 10) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    line = F.concat(F.lit("["), "n", F.lit("] "), F.col("doc_id").cast("string"), F.lit("/"), "chunk_id")
    return rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("c")))), lambda x: x["c"]).alias("citations"))


def insufficient(answer: Column, phrases: list[str] = INSUFFICIENT) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    found = F.lit(False)
    for phrase in phrases:
        found = found | low.contains(phrase)
    return found


def is_data_table(source: Column, source_type: Column, chunk_id: Column) -> Column:
    return F.coalesce(source == "excel_sheet", F.lit(False)) | F.coalesce(source_type.isin("sheet_summary", "sql_result"), F.lit(False)) | chunk_id.startswith("excel:") | (chunk_id == "__sql_result")


def route_hits(hits: DataFrame) -> DataFrame:
    """hits: (query_id, is_table, sheet_id). All of one sheet: sql_agent; else answer_generator."""
    seen = hits.groupBy("query_id").agg(F.bool_and("is_table").alias("tables"), F.count_distinct("sheet_id").alias("sheets"))
    return seen.select("query_id", F.when(F.col("tables") & (F.col("sheets") == 1), "sql_agent").otherwise("answer_generator").alias("route"))


def route_answer(rerouted: Column, has_sheet: Column, lacking: Column, iteration: Column, most: int) -> Column:
    return F.when(~rerouted & has_sheet & lacking & (iteration < most), "sql_agent").otherwise("end")


def route_query(query_type: Column, graph_eligible: Column) -> Column:
    graph = query_type.isin("multi_hop", "comparison") | (query_type.isin("simple_fact", "definition") & graph_eligible)
    return F.when(query_type == "chitchat", "chitchat").when(graph, "graph").otherwise("plain")


def parse_router(response: Column) -> Column:
    """struct(query_type, confidence, graph_eligible): an unknown type is simple_fact; no JSON at all gives confidence 0.3."""
    body = F.from_json(F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit("")), "struct<query_type:string,confidence:double,graph_eligible:boolean,bad:string>", {"columnNameOfCorruptRecord": "bad"})
    fine = body.isNotNull() & body["bad"].isNull()
    known = fine & body["query_type"].isin(QUERY_TYPES)
    return F.struct(
        F.when(known, body["query_type"]).otherwise("simple_fact").alias("query_type"),
        F.when(fine, F.coalesce(body["confidence"], F.lit(0.5))).otherwise(0.3).alias("confidence"),
        F.when(fine, F.coalesce(body["graph_eligible"], F.lit(False))).otherwise(False).alias("graph_eligible"),
    )


def parse_validator(response: Column) -> Column:
    body = F.from_json(F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit("")), "struct<is_valid:boolean,hallucination_score:double,citation_accuracy:double,bad:string>", {"columnNameOfCorruptRecord": "bad"})
    fine = body.isNotNull() & body["bad"].isNull()
    return F.struct(
        F.coalesce(F.when(fine, body["is_valid"]), F.lit(True)).alias("is_valid"),
        F.coalesce(F.when(fine, body["hallucination_score"]), F.lit(0.0)).alias("hallucination_score"),
        F.when(fine, F.coalesce(body["citation_accuracy"], F.lit(0.0))).otherwise(1.0).alias("citation_accuracy"),
    )
