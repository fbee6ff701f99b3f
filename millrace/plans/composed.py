"""Queries that put several operators together."""

import pyspark.sql.functions as F

from millrace.operators import evaluate as L
from millrace.operators import evidence as E
from millrace.operators import fusion as U
from millrace.operators import lexical as X
from millrace.operators import navigate as N
from millrace.operators import post as P
from millrace.operators import tabular as K
from millrace.params import DEFAULT
from millrace.plans import graph as G
from millrace.plans import retrieval as R
from millrace.plans.text import table


def f11_hybrid(spark, sf_dir):
    """Over-fetch from both sides, fuse, rerank by vectors, thresholds, then a packed context with citations."""
    fused = R.fused(spark, sf_dir, DEFAULT.top_k).filter(F.col("rank") <= DEFAULT.top_k)
    kept = U.cut(U.rerank_by_vector(R.with_vectors(spark, sf_dir, fused), DEFAULT.rerank_k), DEFAULT.rerank_k, DEFAULT.rerank_threshold)
    texts = R.chunks(spark, sf_dir)
    hits = R.stored(P.dedup(kept.select("query_id", "rank", "chunk_id").join(texts, "chunk_id")), "hits")
    packed = P.pack_context(hits.select("query_id", "rank", "text"))
    return packed.select("query_id", "blocks", F.md5("context").alias("context_md5")).join(P.citations(hits).select("query_id", F.array_join("citations", "; ").alias("citations")), "query_id")


def g15_overview(spark, sf_dir):
    return E.overview(G.evidence(spark, sf_dir)).select("fact_key", "subject", "object", "support_count")


def g13_records(spark, sf_dir):
    ev = G.evidence(spark, sf_dir)
    index = E.entity_records(ev)
    new = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 = 0").select(F.concat(F.lit("supplier:S"), "s_suppkey").alias("entity_key"), F.lit("renamed").alias("text"))
    gone = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("part:P"), "p_partkey").alias("entity_key"))
    return E.upsert_records(index, new, gone, "entity_key")


def g21_extraction(spark, sf_dir):
    return E.extraction_report(G.responses(spark, sf_dir))


def h6_detail(spark, sf_dir):
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chunk_id"), (F.col("s_suppkey") % 7).alias("doc_id"), F.concat(F.lit("lives in NATION_"), "s_nationkey", F.lit(".")).alias("text"))
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    out = N.detail(G.edges(spark, sf_dir), docs, names)
    return out.select("name", F.array_join("neighbours", ",").alias("neighbours"), *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("chunks", "documents")))


def notes_index(spark, sf_dir):
    notes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chunk_id"), F.col("s_nationkey").alias("doc_id"), F.concat(F.lit("NATION_"), "s_nationkey", F.lit(" supplier s"), "s_suppkey").alias("text"))
    return X.save_index(notes, R.new_folder(spark, "notes"))


def i6_fallback(spark, sf_dir):
    """With no entity record, nations whose number is even come with seeds, which are expanded first; the others are searched as
    they are."""
    empty = spark.createDataFrame([], "id bigint, vector array<float>")
    n = table(spark, sf_dir, "nation")
    queries = n.select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("query"))
    seeds = n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("seed"))
    asked = N.with_fallback(empty, queries, G.edges(spark, sf_dir), seeds)
    hits = X.search(notes_index(spark, sf_dir), asked.select("query_id", "query"), 20).groupBy("query_id").agg(F.count("*").alias("chunks"))
    return asked.join(hits, "query_id", "left").select("query_id", "path", F.md5("query").alias("query_md5"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def k7_recall(spark, sf_dir):
    """Vectors as sheets: those asked for have an id divisible by 100, and all of them are searched."""
    return R.dense(spark, sf_dir, 5).select("query_id", F.col("chunk_id").alias("sheet_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def k8_choice(spark, sf_dir):
    recalled = k7_recall(spark, sf_dir)
    answers = recalled.groupBy("query_id").agg(F.when(F.col("query_id") % 2 == 0, F.max("sheet_id")).otherwise(F.lit(7)).alias("choice"))
    return K.chosen_sheet(recalled.select("query_id", "sheet_id", "score"), answers)


def k12_columns(spark, sf_dir):
    old = F.struct(F.col("p_name").alias("cn"), F.col("p_brand").alias("en"), F.lit(None).cast("string").alias("type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("display_name"), F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("string").alias("data_type"))
    made = table(spark, sf_dir, "part").select("p_partkey", F.element_at(K.normal_columns(F.array(old)), 1).alias("c"))
    return made.select("p_partkey", "c.*")


def l12_hallucination(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    out = L.hallucination(e.select(F.when(F.col("event_id") % 5 != 0, F.lit(10)).alias("claims"), F.when(F.col("event_id") % 5 != 0, k % 3).alias("hallucinated"), F.when(F.col("event_id") % 5 != 0, k % 2).alias("unverifiable")))
    return out.select("judged", *(F.round(c, 6).alias(c) for c in out.columns if c != "judged"))


def sheet_results(spark, sf_dir):
    """Recalled sheets of every query; the truth is its own sheet and another that its number gives."""
    lists = k7_recall(spark, sf_dir).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "sheet_id"))), lambda x: x["sheet_id"]).alias("recalled"))
    return lists.withColumn("truth", F.array(100 * F.col("query_id"), (37 * F.col("query_id") + 5) % 500))


def l13_sheets(spark, sf_dir):
    lists = sheet_results(spark, sf_dir)
    return lists.select("query_id", *(L.recall(F.col("recalled"), F.col("truth"), k).alias(f"recall_{k}") for k in (1, 3, 5)))


def l16_sql_report(spark, sf_dir):
    """Suppliers as evaluated questions, two of three of them about SQL."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    cell = lambda *c: F.array(*(x.cast("string") for x in c))
    result = lambda names, row: F.struct(F.array(*map(F.lit, names)).alias("columns"), F.array(row).alias("rows"))
    return L.sql_report(s.select(
        F.when(k % 3 == 0, "simple_fact").otherwise("sql_query").alias("query_type"), cell(k, k + 1, k + 2, k + 3, k + 4).alias("recalled_sheet_ids"), F.when(k % 5 > 0, cell(k + k % 4, k + 7)).alias("true_sheet_ids"),
        F.when(k % 7 > 0, k.cast("string")).alias("selected_sheet_id"), F.when(k % 4 > 0, (k - k % 2).cast("string")).alias("true_sheet_id"),
        F.concat(F.lit("SELECT * FROM t"), k % 2).alias("predicted_sql"), F.when(k % 6 > 0, F.lit("select *  from t1")).alias("true_sql"),
        F.when(k % 8 > 0, result(["a", "b"], cell(k, F.col("s_nationkey")))).alias("predicted_result"), F.when(k % 9 > 0, result(["a", "b"], cell(k, F.col("s_nationkey")))).alias("true_result"),
        (k - 5).cast("double").alias("processing_time_ms"), (k % 10 == 0).alias("sql_error"),
    ))


def l18_seeds(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    out = L.seeds_of_samples(t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), "text"), catalog=t.select(F.col("conv_id").alias("doc_id"), F.when(F.col("conv_id") % 3 > 0, "completed").otherwise("failed").alias("status")))
    return out.select("doc_id", F.array_join("ground_truth_ids", ",").alias("ids"), F.md5("prompt").alias("prompt_md5"))


QUERIES = {f.__name__: f for f in (f11_hybrid, g13_records, g15_overview, g21_extraction, h6_detail, i6_fallback, k7_recall, k8_choice, k12_columns, l12_hallucination, l13_sheets, l16_sql_report, l18_seeds)}

RECALLED = R.dense_sql(5, name="re").replace(" as chunk_id,", " as sheet_id,").replace(" as score,", " as s,")

SQL = {
    "f11_hybrid": f"""with {R.FUSED}, {R.RERANKED}, k as (select query_id, rank, chunk_id, text from r2 join documents on doc_id = chunk_id where score >= 0.3 qualify row_number() over (partition by query_id, trim(text, ' ') order by rank) = 1),
b as (select *, row_number() over (partition by query_id order by rank) as n from k), c as (select *, '[' || n || ']' || chr(10) || text as block from b), d as (select *, sum(length(block) + 7) over (partition by query_id order by n) as e, sum(length(block) + 7) over (partition by query_id) - 7 as t from c),
p as (select query_id, count(*) as blocks, md5(left(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by n), 8000)) as context_md5 from d where t <= 8000 or e <= 8000 or n = 1 group by 1)
select query_id, blocks, context_md5, (select string_agg('[' || n || '] ' || chunk_id || '/' || chunk_id, '; ' order by n) from b where b.query_id = p.query_id and n <= 10) as citations from p""",
    "g13_records": f"with {G.ENTITIES} select entity_key, name || ': ' || type as text from en where not (type = 'Part' and substr(name, 2)::int % 2 = 0) and not (type = 'Supplier' and substr(name, 2)::int % 10 = 0) union all select 'supplier:S' || s_suppkey, 'renamed' from supplier where s_suppkey % 10 = 0",
    "g15_overview": "select 'supplier:S' || l_suppkey || '|SUPPLIES_PART|part:P' || l_partkey as fact_key, 'S' || l_suppkey as subject, 'P' || l_partkey as object, count(*) as support_count from lineitem where l_returnflag <> 'R' group by 1, 2, 3 order by 1 limit 500",
    "g21_extraction": "select count(*) as chunks, sum(case when s_suppkey % 6 in (0, 3) then 2 when s_suppkey % 6 < 4 then 1 else 0 end)::bigint as evidence, sum(case when s_suppkey % 6 in (0, 3) then 2 when s_suppkey % 6 < 4 then 1 else 0 end)::bigint as keys, count(*) filter (s_suppkey % 6 >= 4) as without from supplier",
    "h6_detail": f"with {G.EDGES}, n as (select n_name as name, n_nationkey as k from nation), a as (select a as name, string_agg(b, ',' order by b) as neighbours from (select distinct a, b from bi) group by 1), m as (select name, s_suppkey from n join supplier on contains('lives in NATION_' || s_nationkey || '.', name) qualify row_number() over (partition by name order by s_suppkey) <= 10), c as (select name, string_agg(s_suppkey, ',' order by s_suppkey) as chunks, array_to_string(list_sort(list(distinct s_suppkey % 7)), ',') as documents from m group by 1) select n.name, neighbours, chunks, documents from n left join a on a.name = n.name left join c on c.name = n.name",
    "k7_recall": f"with {RECALLED} select query_id, sheet_id, round(s, 6) as score, rank from re",
    "k8_choice": f"with {RECALLED} select query_id, case when query_id % 2 = 0 then max(sheet_id) else min_by(sheet_id, rank) end as sheet_id, query_id % 2 = 0 as asked from re group by 1",
    "l16_sql_report": """with s as (select s_suppkey as k from supplier where s_suppkey % 3 <> 0) select count(*) as sql_num_samples, count(*) filter (k % 10 = 0) as sql_error_count, avg(case when k % 5 > 0 then (k % 4 < 1)::int / 2 end) as sheet_recall_at_1, avg(case when k % 5 > 0 then (k % 4 < 3)::int / 2 end) as sheet_recall_at_3, avg(case when k % 5 > 0 then 0.5 end)::double as sheet_recall_at_5,
avg(case when k % 4 > 0 then (k % 7 > 0 and k % 2 = 0)::int end) as table_selection_accuracy, max(case when k % 6 > 0 and k % 2 = 1 then 1.0 end)::double as sql_correctness, avg(case when k % 9 > 0 then (k % 8 > 0)::int end) as execution_accuracy,
avg(k - 5) filter (k > 5) as sql_timing_mean_ms, quantile_cont((k - 5)::double, 0.5) filter (k > 5) as sql_timing_p50_ms, quantile_cont((k - 5)::double, 0.95) filter (k > 5) as sql_timing_p95_ms from s""",
    "k12_columns": "select p_partkey, case when p_partkey % 2 = 0 then p_type else p_name end as display_name, p_brand as column_name, 'TEXT' as data_type from part",
    "l12_hallucination": "with e as (select (props->>'$.k')::bigint as k from events where event_id % 5 <> 0) select count(*) as judged, round(avg((k % 3 > 0)::int), 6) as hallucination_rate, round(sum(k % 3) / (10 * count(*)), 6) as hallucination_score, round(sum(k % 2) / (10 * count(*)), 6) as unverifiable_score from e",
    "l13_sheets": f"with {RECALLED}, r as (select query_id, list(sheet_id order by rank) as r, [100 * query_id, (37 * query_id + 5) % 500] as t from re group by 1) select query_id, {', '.join(f'len(list_filter(t, lambda x: list_contains(r[1:{k}], x))) / 2 as recall_{k}' for k in (1, 3, 5))} from r",
    "l18_seeds": "with d as (select distinct conv_id from conversations where conv_id % 3 > 0 order by 1 limit 10), r as (select *, row_number() over (partition by conv_id order by turn) as n from conversations where conv_id in (select conv_id from d)) select conv_id as doc_id, string_agg(case when n <= 5 then conv_id || '_' || turn end, ',' order by n) as ids, md5(left(string_agg(case when n <= 20 then text end, chr(10) order by n), 6000)) as prompt_md5 from r where n <= 50 group by 1",
}
