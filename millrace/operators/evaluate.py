"""Retrieval and answer metrics over tables of samples and results; null stands for "no ground truth"."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from millrace.operators.post import insufficient

#: Phrases of a refusal.
REFUSALS = ["no information", "not provided", "not found", "cannot answer", "没有足够", "无法回答", "无依据", "information provided"]


def matched(retrieved: Column, truth: Column, k: int) -> Column:
    """How many distinct ground-truth ids are among the first k."""
    return F.size(F.array_intersect(F.slice(retrieved, 1, k), truth))


def recall(retrieved: Column, truth: Column, k: int) -> Column:
    return F.when(F.size(truth) > 0, matched(retrieved, truth, k) / F.size(F.array_distinct(truth)))


def precision(retrieved: Column, truth: Column, k: int) -> Column:
    first = F.slice(retrieved, 1, k)
    return F.when(F.size(truth) > 0, F.when(F.size(first) > 0, F.size(F.filter(first, lambda x: F.array_contains(truth, x))) / F.size(first)).otherwise(0.0))


def ndcg(retrieved: Column, truth: Column, k: int) -> Column:
    gains = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(truth, x), 1 / F.log2(i + F.lit(2.0))).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.size(truth))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    return F.when(F.size(truth) > 0, F.aggregate(gains, F.lit(0.0), lambda s, g: s + g) / ideal)


def reciprocal_rank(retrieved: Column, truth: Column) -> Column:
    first = F.array_min(F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(truth, x), i + 1)), lambda p: p.isNotNull()))
    return F.when(F.size(truth) > 0, F.coalesce(1 / first, F.lit(0.0)))


def citation_accuracy(cited: Column, sources: Column) -> Column:
    """Share of cited sources that hold a true source's name."""
    good = F.filter(cited, lambda c: F.exists(sources, lambda s: F.contains(c, s)))
    return F.when((F.size(sources) > 0) & (F.size(cited) > 0), F.size(good) / F.size(cited))


def drop_rate(before: Column, after: Column) -> Column:
    return F.when(before > 0, 1 - after / before).otherwise(0.0)


def redundancy(vectors: DataFrame, threshold: float = 0.8) -> DataFrame:
    """vectors: (query_id, id, vector) of one result list each. Share of pairs whose cosine is above the threshold; 0 for lists of one."""
    from millrace.functions.vectors import cosine

    a, b = vectors.alias("a"), vectors.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.id") < F.col("b.id")))
    close = pairs.groupBy("a.query_id").agg(F.avg((cosine(F.col("a.vector"), F.col("b.vector")) > threshold).cast("double")).alias("redundancy"))
    return vectors.select("query_id").distinct().join(close, "query_id", "left").fillna(0.0, ["redundancy"])


def refusal_rate(results: DataFrame) -> Column:
    """Share of negative samples whose answer is a refusal."""
    return F.avg(F.when(F.col("is_negative_sample"), insufficient(F.col("predicted_answer"), REFUSALS).cast("double")))


def timing(column: str) -> list[Column]:
    ends = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return [F.avg(column).alias("mean"), ends[0].alias("p50"), ends[1].alias("p95"), ends[2].alias("p99")]


def scored(samples: DataFrame, k: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """samples: (sample_id, query_type, retrieved, truth). A column of each metric and size."""
    r, t = F.col("retrieved"), F.col("truth")
    columns = [f(r, t, n).alias(f"{name}_{n}") for name, f in (("recall", recall), ("precision", precision), ("ndcg", ndcg)) for n in k]
    return samples.select("sample_id", "query_type", *columns, reciprocal_rank(r, t).alias("mrr"))


def report(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Means of all metrics, per value of ``by`` and overall (null)."""
    metrics = [c for c in scores.columns if c not in ("sample_id", "query_type")]
    grouped = scores.rollup(by) if by else scores.groupBy()
    return grouped.agg(F.count("*").alias("samples"), *(F.avg(c).alias(c) for c in metrics))


def evaluation_report(rows: DataFrame) -> DataFrame:
    """rows: scored samples with recall_5, recall_10, precision_5, precision_10, ndcg_5 and mrr (null without a truth), and
    predicted, has_texts, delta_ndcg, pre_count, post_count, redundancy, citation, claims, intrinsic, extrinsic and
    processing_time_ms, each null or -1 where it wasn't measured.

    One row: means that leave those out, 0 or null where nothing is left; hallucination over answers that are no errors and
    have texts, rates over all samples and scores over all claims; times above 0."""
    valid = lambda c: F.avg(F.when(F.col(c) >= 0, F.col(c)))
    judged = (F.coalesce("predicted", F.lit("")) != "") & F.col("has_texts") & ~F.contains(F.lower("predicted"), F.lit("error"))
    claims = F.coalesce(F.sum(F.when(judged, F.col("claims"))), F.lit(0))
    share = lambda part, whole: F.when(claims > 0, part / whole).otherwise(0.0)
    timed = F.when(F.col("processing_time_ms") > 0, F.col("processing_time_ms").cast("double"))
    zero, null = ["recall_5", "recall_10", "citation", "redundancy"], ["precision_5", "precision_10", "ndcg_5", "mrr", "delta_ndcg"]
    # a change for the worse counts like what wasn't measured
    return rows.agg(
        F.count("*").alias("samples"), *(F.coalesce(valid(c), F.lit(0.0)).alias(c) for c in zero), *(valid(c).alias(c) for c in null),
        F.coalesce(F.avg(F.when(F.col("pre_count") > 0, 1 - F.col("post_count") / F.col("pre_count"))), F.lit(0.0)).alias("filter_drop_rate"),
        *(share(F.count_if(judged & (F.col(c) > 0)), F.count("*")).alias(f"{c}_rate") for c in ("intrinsic", "extrinsic")),
        *(share(F.sum(F.when(judged, F.col(c))), claims).alias(f"{c}_score") for c in ("intrinsic", "extrinsic")),
        F.coalesce(F.avg(timed), F.lit(0.0)).alias("timing_mean"), *(F.coalesce(F.percentile(timed, F.lit(q)), F.lit(0.0)).alias(f"timing_p{round(100 * q)}") for q in (0.5, 0.95, 0.99)),
    )


def sql_equal(predicted: Column, truth: Column) -> Column:
    """1.0 for the same text but for case and white space; null leaves the case to a judge."""
    fold = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    return F.when(fold(predicted) == fold(truth), 1.0)


def execution_accuracy(columns: Column, rows: Column, true_columns: Column, true_rows: Column) -> Column:
    """0.3 for the number of rows, 0.2 for the set of columns, 0.5 times the Jaccard similarity of the cells as text."""
    cells, true_cells = F.array_distinct(F.flatten(rows)), F.array_distinct(F.flatten(true_rows))
    union = F.size(F.array_union(cells, true_cells))
    return (
        F.when(F.size(rows) == F.size(true_rows), 0.3).otherwise(0.0)
        + F.when(F.sort_array(F.array_distinct(columns)) == F.sort_array(F.array_distinct(true_columns)), 0.2).otherwise(0.0)
        + 0.5 * F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(cells, true_cells)) / union)
    )


def hallucination(results: DataFrame) -> DataFrame:
    """results: (claims, hallucinated, unverifiable) of each judged answer (null: not judged). Rates over answers and over claims."""
    n, claims = F.count("claims"), F.sum("claims")
    return results.agg(
        n.alias("judged"), F.when(n > 0, F.count_if(F.col("hallucinated") > 0) / n).alias("hallucination_rate"),
        F.when(claims > 0, F.sum("hallucinated") / claims).alias("hallucination_score"), F.when(claims > 0, F.sum("unverifiable") / claims).alias("unverifiable_score"),
    )


def sql_report(rows: DataFrame) -> DataFrame:
    """Samples with their results, a row each: query_type, recalled_sheet_ids, true_sheet_ids, selected_sheet_id, true_sheet_id,
    predicted_sql, true_sql, predicted_result and true_result (columns, rows), processing_time_ms, sql_error. One row over those
    of type sql_query: counts, errors, means over the samples that have a truth, and timings; no row without such samples."""
    own = rows.filter("query_type = 'sql_query'")
    given = lambda truth, score: F.avg(F.when(truth, score))
    sheets = F.coalesce(F.size("true_sheet_ids"), F.lit(0)) > 0
    recalls = [given(sheets, recall(F.col("recalled_sheet_ids"), F.col("true_sheet_ids"), k)).alias(f"sheet_recall_at_{k}") for k in (1, 3, 5)]
    chosen = F.coalesce(F.col("selected_sheet_id") == F.col("true_sheet_id"), F.lit(False)).cast("double")
    result = execution_accuracy(F.col("predicted_result.columns"), F.col("predicted_result.rows"), F.col("true_result.columns"), F.col("true_result.rows"))
    took = F.when(F.col("processing_time_ms") > 0, F.col("processing_time_ms"))
    ends = F.percentile(took, F.array(F.lit(0.5), F.lit(0.95)))
    return own.agg(
        F.count("*").alias("sql_num_samples"), F.count_if("sql_error").alias("sql_error_count"), *recalls,
        given(F.coalesce(F.col("true_sheet_id"), F.lit("")) != "", chosen).alias("table_selection_accuracy"),
        given(F.coalesce(F.col("true_sql"), F.lit("")) != "", sql_equal(F.col("predicted_sql"), F.col("true_sql"))).alias("sql_correctness"),
        given(F.col("true_result").isNotNull(), F.coalesce(result, F.lit(0.0))).alias("execution_accuracy"),
        F.avg(took).alias("sql_timing_mean_ms"), ends[0].alias("sql_timing_p50_ms"), ends[1].alias("sql_timing_p95_ms"),
    ).filter("sql_num_samples > 0")


def seeds_of_samples(chunks: DataFrame, docs: int = 10, catalog: DataFrame | None = None) -> DataFrame:
    """chunks: (doc_id, idx, chunk_id, text); catalog: (doc_id, status). Material for new samples of the first documents, of the
    first that are completed if there is a catalog: the first five chunk ids, and the first 20 texts that are not blank among
    the first 50, joined and cut at 6000 characters."""
    from pyspark.sql import Window

    known = chunks.select("doc_id").distinct()
    known = known if catalog is None else known.join(catalog.filter("status = 'completed'").select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy("doc_id").limit(docs)
    rows = chunks.join(F.broadcast(chosen), "doc_id").withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))).filter("rn <= 50")
    ids = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("rn", "chunk_id"))), 1, 5), lambda x: x["chunk_id"])
    texts = F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.trim("text") != "", F.struct("rn", "text")))), 1, 20), lambda x: x["text"])
    return rows.groupBy("doc_id").agg(ids.alias("ground_truth_ids"), F.substring(F.array_join(texts, "\n"), 1, 6000).alias("prompt"))
