"""Queries of evaluation, usage and streaming."""

import pyspark.sql.functions as F

from millrace.operators import evaluate as L
from millrace.operators import navigate as N
from millrace.operators import usage as M
from millrace.plans import retrieval as R
from millrace.plans.text import table
from millrace.sources.scratch import children
from millrace.streaming import jobs


def samples(spark, sf_dir):
    """Benchmark items with what BM25 finds and the documents that hold them as the truth."""
    found = R.bm25(spark, sf_dir, 10).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    said = N.contained(R.spread(docs.select(F.col("doc_id").alias("key"), "text")), items.select(F.col("text").alias("needle")))
    held = said.join(items.select("item_id", F.col("text").alias("needle")), "needle").groupBy("item_id").agg(F.sort_array(F.collect_list("key")).alias("truth"))
    whole = items.join(found, items["item_id"] == found["query_id"], "left").join(held, "item_id", "left")
    none = F.array().cast("array<bigint>")
    return R.stored(whole.select(F.col("item_id").alias("sample_id"), F.when(F.col("item_id") % 2 == 0, "simple_fact").otherwise("multi_hop").alias("query_type"), F.coalesce("retrieved", none).alias("retrieved"), F.coalesce("truth", none).alias("truth")), "samples")


def rounded(df, *keep):
    return df.select(*keep, *(F.round(c, 6).alias(c) for c in df.columns if c not in keep))


def l1_scores(spark, sf_dir):
    return rounded(L.scored(samples(spark, sf_dir), (1, 5, 10)), "sample_id", "query_type")


def lists(spark, sf_dir):
    """Orders as result lists: their parts in line order, and those returned as the truth."""
    items = table(spark, sf_dir, "lineitem")
    order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", c))), lambda x: x["l_partkey"])
    rows = items.groupBy("l_orderkey").agg(order(F.lit(0)).alias("retrieved"), F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))).alias("truth"), F.max("l_quantity").alias("quantity"))
    return rows


def l5_citations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cited = F.array(F.concat("source", F.lit("/a.md")), F.concat(F.lit("x/"), "lang"), F.lit("none"))
    return d.select("doc_id", F.round(L.citation_accuracy(cited, F.array("source", "lang")), 6).alias("accuracy"))


def l6_delta(spark, sf_dir):
    s = samples(spark, sf_dir)
    return s.select("sample_id", F.round(L.ndcg(F.col("retrieved"), F.col("truth"), 5) - L.ndcg(F.reverse("retrieved"), F.col("truth"), 5), 6).alias("delta"))


def l7_drop_rate(spark, sf_dir):
    s = lists(spark, sf_dir)
    return s.select("l_orderkey", F.round(L.drop_rate(F.size("retrieved"), F.size("truth")), 6).alias("rate"))


def l8_redundancy(spark, sf_dir):
    hits = R.dense(spark, sf_dir, 10).join(R.embedded(spark, sf_dir).select(F.col("id").alias("chunk_id"), "vector"), "chunk_id")
    return rounded(L.redundancy(hits.select("query_id", F.col("chunk_id").alias("id"), "vector"), 0.3), "query_id")


def l9_refusals(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("is_negative_sample", F.col("turn") % 2 == 0).withColumn("predicted_answer", F.when(F.col("turn") % 4 == 0, F.concat("text", F.lit(" Not Found "))).otherwise(F.col("text")))
    return t.groupBy("role").agg(F.round(L.refusal_rate(t), 6).alias("rate"))


def l10_timing(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(*L.timing("value")), "event_type")


def l11_report(spark, sf_dir):
    return rounded(L.report(L.scored(samples(spark, sf_dir), (5,))).drop("query_type"), "samples")


def l11_totals(spark, sf_dir):
    """The whole report; what models and clocks would say is made from the items' numbers, a fifth of the answers are errors."""
    i = F.col("sample_id")
    rows = samples(spark, sf_dir).withColumn("before", F.when(i % 2 == 0, F.reverse("retrieved")))
    made = L.scored(rows, (5, 10)).join(rows.select("sample_id", F.size("retrieved").alias("post_count"), L.ndcg(F.col("before"), F.col("truth"), 5).alias("first_ndcg")), "sample_id")
    made = made.select(
        *(c for c in made.columns if c != "first_ndcg"), (F.col("ndcg_5") - F.col("first_ndcg")).alias("delta_ndcg"), F.when(i % 5 == 0, "ERROR: no answer").otherwise("an answer").alias("predicted"), (i % 11 > 0).alias("has_texts"),
        F.lit(10).alias("pre_count"), F.when(i % 4 > 0, (i % 4) / 8).alias("redundancy"), F.when(i % 7 == 0, -1.0).otherwise((i % 3) / 2).alias("citation"), (i % 4 + 1).alias("claims"), (i % 3).alias("intrinsic"), (i % 2).alias("extrinsic"), (i - 3).alias("processing_time_ms"),
    )
    out = L.evaluation_report(made)
    return out.select("samples", *(F.round(c, 6).alias(c) for c in out.columns if c != "samples"))


def l14_sql(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = F.concat(F.lit("SELECT  *\n FROM "), "p_brand")
    b = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" select * from "), F.lower("p_brand"), F.lit(" "))).otherwise(F.lit("select 1"))
    return p.select("p_partkey", L.sql_equal(a, b).alias("score"))


def l15_execution(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cell = lambda *c: F.array(*(F.col(x).cast("string") for x in c))
    names = lambda *c: F.array(*map(F.lit, c))
    return p.select("p_partkey", F.round(L.execution_accuracy(names("a", "b"), F.array(cell("p_brand", "p_size")), F.when(F.col("p_partkey") % 2 == 0, names("b", "a")).otherwise(names("c")), F.array(cell("p_brand", "p_type"))), 6).alias("score"))


def l17_by_type(spark, sf_dir):
    out = L.report(L.scored(samples(spark, sf_dir), (5,)), "query_type")
    return rounded(out.withColumn("query_type", F.coalesce("query_type", F.lit("all"))), "query_type", "samples")


def usage_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("event_type").alias("caller"), F.length("props").cast("bigint").alias("input_chars"), F.lit(1).cast("bigint").alias("output_chars"), k.alias("input_tokens"), F.lit(2).cast("bigint").alias("output_tokens"), (k % 2 == 0).alias("cache_hit"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id")


def m1_usage(spark, sf_dir):
    out = M.by_caller(usage_events(spark, sf_dir))
    return out.withColumn("caller", F.coalesce("caller", F.lit("all")))


def run_stream(spark, stream, mode="update", name="out", batch=None):
    """Run a stream to the end of its input and give its output table."""
    from millrace.sources.scratch import new_folder

    folder = new_folder(spark, name)

    def keep(df, batch_id):
        df.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(batch or keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{folder}/rows"


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parque[t]"  # as a pattern it may be a file or a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(path)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return rows.select("event_id", "user_id", F.col("event_type").alias("caller"), F.col("ts").cast("timestamp").alias("ts"), k.alias("input_tokens"), (k % 2 == 0).alias("cache_hit"))


def m2_usage_stream(spark, sf_dir):
    rows = run_stream(spark, jobs.usage(event_stream(spark, sf_dir)))
    from pyspark.sql import Window

    out = spark.read.parquet(rows)
    return out.withColumn("rn", F.row_number().over(Window.partitionBy("caller").orderBy(F.desc("batch")))).filter("rn = 1").select("caller", "calls", "cache_hits", "input_tokens")


def m3_tokens(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    meta = F.when(F.col("event_id") % 2 == 0, F.replace("props", F.lit('"k"'), F.lit('"prompt_tokens"'))).otherwise(F.replace("props", F.lit('"k"'), F.lit('"output_tokens"')))
    a, b = M.tokens_used(meta)
    return e.select("event_id", a.alias("input_tokens"), b.alias("output_tokens"))


def uploads(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("upload_id"), F.col("ts").cast("timestamp").alias("ts"))


def m4_quota(spark, sf_dir):
    return M.quota(uploads(spark, sf_dir), 2).groupBy("user_id", "day").agg(F.count("*").alias("uploads"), F.count_if("over").alias("over"))


def m5_daily_stream(spark, sf_dir):
    """Days that the watermark has closed: all but the last."""
    rows = run_stream(spark, jobs.daily_uploads(event_stream(spark, sf_dir).filter("caller = 'purchase'")), "append")
    out = spark.read.parquet(rows)
    return out.groupBy("user_id").agg(F.count("*").alias("days"), F.sum("uploads").alias("uploads"))


def entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.concat_ws(":", "event_type", "user_id").alias("key"), F.col("event_id").cast("string").alias("value"), at.alias("created_at"), k.alias("ttl"), (at + 3600 * k).alias("expires_at"))


def m6_live(spark, sf_dir):
    return M.live_entries(entries(spark, sf_dir), F.lit(1704844800.0), "click").select("key", "value", "remaining")


def m7_namespaces(spark, sf_dir):
    return M.namespaces(entries(spark, sf_dir).withColumn("key", F.when(F.col("ttl") < 10, "bare").otherwise(F.col("key"))))


def m8_keys(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", M.cache_key("emb", F.col("item_id").cast("string"), F.col("text")).alias("key"))


def m9_latest(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("ttl", F.when(F.col("ttl") == 0, 0.0).when(F.col("ttl") < 20, F.lit(None)).otherwise(F.col("ttl") * 3600))
    return M.latest(e, F.lit(1704844800.0 + 86400 * 20), 86400.0).select("key", "value")


def tasks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("task_id"), F.when(F.col("event_id") % 3 == 0, "SUCCESS").otherwise("PENDING").alias("status"), (F.col("event_id") % 4).cast("int").alias("retry_count"), F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("updated_at"))


def m10_drain(spark, sf_dir):
    return M.drain(tasks(spark, sf_dir), F.col("task_id") % 5 == 0).select("task_id", "status", "retry_count")


def m11_support_stream(spark, sf_dir):
    stream = event_stream(spark, sf_dir).select(F.col("caller").alias("affected_type"), F.col("user_id").cast("string").alias("affected_key"), F.when(F.col("cache_hit"), 1).otherwise(-1).alias("delta"))
    from pyspark.sql import Window

    out = spark.read.parquet(run_stream(spark, jobs.support(stream)))
    last = out.withColumn("rn", F.row_number().over(Window.partitionBy("affected_type", "affected_key").orderBy(F.desc("batch")))).filter("rn = 1")
    return last.select("affected_type", F.col("affected_key").cast("string").alias("affected_key"), "support_count", "operation")


def m11_key_table(spark, sf_dir):
    """The changes in five batches, the third of them written twice, kept as a table of keys."""
    folder = R.new_folder(spark, "support")
    parts = table(spark, sf_dir, "events").withColumn("part", F.pmod("event_id", F.lit(5)).cast("int"))
    parts.repartition(5, "part").write.partitionBy("part").parquet(f"{folder}/events")
    write = jobs.sync_keys(f"{folder}/store")
    k = F.get_json_object("props", "$.k").cast("bigint")
    counts = None

    def once_or_twice(batch, batch_id):
        for _ in range(2 if batch_id == 2 else 1):
            write(batch, batch_id)

    for part in range(5):  # a folder of events comes in at a time
        changes = spark.read.schema(parts.drop("part").schema).parquet(f"{folder}/events/part={part}").select(F.col("event_type").alias("affected_type"), F.col("user_id").cast("string").alias("affected_key"), F.when(k % 2 == 0, 1).otherwise(-1).alias("delta"))
        changes.write.parquet(f"{folder}/changes/part={part}")
        stream = spark.readStream.schema("affected_type string, affected_key string, delta int").option("recursiveFileLookup", "true").parquet(f"{folder}/changes")
        counts = jobs.support(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(once_or_twice).trigger(availableNow=True)
        jobs.with_rocks(spark, counts.start).awaitTermination()
    return jobs.support_table(spark, f"{folder}/store").read()


def m13_ingest(spark, sf_dir):
    """The documents as a stream of files that comes in two parts, the second with all documents of the first again."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("markdown"))
    folder = R.new_folder(spark, "ingest")
    for part, rows in enumerate((docs.filter("doc_id % 2 = 0"), docs)):
        rows.write.parquet(f"{folder}/in/part={part}")
        chunks = jobs.ingest(spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in"), folder)
    return spark.read.parquet(chunks).select("doc_id", "chunk_hash", F.length("text").alias("chars"))


def m12_cleanup(spark, sf_dir):
    left = M.without_old(tasks(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return left.select("task_id", "status")


QUERIES = {f.__name__: f for f in (l1_scores, l5_citations, l6_delta, l7_drop_rate, l8_redundancy, l9_refusals, l10_timing, l11_report, l11_totals, l14_sql, l15_execution, l17_by_type, m1_usage, m2_usage_stream, m3_tokens, m4_quota, m5_daily_stream, m6_live, m7_namespaces, m8_keys, m9_latest, m10_drain, m11_support_stream, m11_key_table, m12_cleanup, m13_ingest)}

SCORED = f"""{R.search_sql(10)},
sa as (select item_id as sample_id, case when item_id % 2 = 0 then 'simple_fact' else 'multi_hop' end as query_type, coalesce((select list(chunk_id order by rank) from bm where query_id = item_id), []) as retrieved,
 coalesce((select list(doc_id order by doc_id) from documents d where contains(d.text, b.text)), []) as truth from benchmark b)"""


def ndcg_sql(r: str, k: int) -> str:
    return f"(case when len(truth) > 0 then (select coalesce(sum(1 / log2(i + 1)), 0) from (select unnest(range(1, 1 + least({k}, len({r})))) as i) where list_contains(truth, {r}[i])) / (select sum(1 / log2(i + 1)) from (select unnest(range(1, 1 + least({k}, len(truth)))) as i)) end)"


def metrics_sql(ks) -> str:
    parts = []
    for k in ks:
        hit = f"len(list_filter(retrieved[1:{k}], lambda x: list_contains(truth, x)))"
        parts += [f"case when len(truth) > 0 then {hit} / len(truth) end as recall_{k}", f"case when len(truth) > 0 then case when len(retrieved) > 0 then {hit} / least({k}, len(retrieved)) else 0 end end as precision_{k}", f"{ndcg_sql('retrieved', k)} as ndcg_{k}"]
    first = "list_min(list_filter(list_transform(retrieved, lambda x, i: case when list_contains(truth, x) then i end), lambda p: p is not null))"
    return ", ".join(parts) + f", case when len(truth) > 0 then coalesce(1 / {first}, 0) end as mrr"


def report_sql(group: str) -> str:
    names = ["recall_5", "precision_5", "ndcg_5", "mrr"]
    return f"count(*) as samples, {', '.join(f'round(avg({n}), 6) as {n}' for n in names)} from (select query_type, {metrics_sql([5])} from sa) {group}"


EVENTS = "e as (select *, (props->>'$.k')::bigint as k, floor(epoch(ts))::double as sec from events)"
ENTRIES = EVENTS + ", n as (select event_type || ':' || user_id as key, event_id::varchar as value, sec as created_at, k::double as ttl, sec + 3600 * k as expires_at from e)"

SQL = {
    "l1_scores": f"with {SCORED}, m as (select sample_id, query_type, {metrics_sql([1, 5, 10])} from sa) select sample_id, query_type, round(columns(* exclude (sample_id, query_type)), 6) from m",
    "l5_citations": "select doc_id, round(2 / 3, 6) as accuracy from documents",
    "l6_delta": f"with {SCORED} select sample_id, round({ndcg_sql('retrieved', 5)} - {ndcg_sql('list_reverse(retrieved)', 5)}, 6) as delta from sa",
    "l7_drop_rate": "select l_orderkey, round(1 - count(distinct case when l_returnflag = 'R' then l_partkey end) / count(*), 6) as rate from lineitem group by 1",
    "l8_redundancy": f"with {R.dense_sql(10)}, p as (select a.query_id, list_cosine_similarity(x.embedding::double[], y.embedding::double[]) > 0.3 as c from de a join de b on a.query_id = b.query_id and a.chunk_id < b.chunk_id join embeddings x on x.vec_id = a.chunk_id join embeddings y on y.vec_id = b.chunk_id) select query_id, round(avg(c::int), 6) as redundancy from p group by 1",
    "l9_refusals": "select role, round(avg(case when turn % 2 = 0 then (turn % 4 = 0)::int end), 6) as rate from conversations group by 1",
    "l10_timing": "select event_type, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by 1",
    "l11_report": f"with {SCORED} select {report_sql('')}",
    "l11_totals": f"""with {SCORED}, b as (select *, case when sample_id % 2 = 0 then list_reverse(retrieved) end as before from sa),
m as (select sample_id as i, {metrics_sql([5, 10])}, {ndcg_sql('retrieved', 5)} - case when before is not null then {ndcg_sql('before', 5)} end as delta, len(retrieved) as post, sample_id % 5 > 0 and sample_id % 11 > 0 as judged from b),
c as (select coalesce(sum(i % 4 + 1) filter (judged), 0) as claims from m)
select count(*) as samples, round(coalesce(avg(recall_5), 0), 6) as recall_5, round(coalesce(avg(recall_10), 0), 6) as recall_10, round(avg(case when i % 7 > 0 then (i % 3) / 2 end), 6) as citation, round(avg(case when i % 4 > 0 then (i % 4) / 8 end), 6) as redundancy,
  round(avg(precision_5), 6) as precision_5, round(avg(precision_10), 6) as precision_10, round(avg(ndcg_5), 6) as ndcg_5, round(avg(mrr), 6) as mrr, round(avg(delta) filter (delta >= 0), 6) as delta_ndcg, round(avg(1 - post / 10), 6) as filter_drop_rate,
  round(count(*) filter (judged and i % 3 > 0) / count(*), 6) as intrinsic_rate, round(count(*) filter (judged and i % 2 > 0) / count(*), 6) as extrinsic_rate, round(sum(i % 3) filter (judged) / any_value(claims), 6) as intrinsic_score, round(sum(i % 2) filter (judged) / any_value(claims), 6) as extrinsic_score,
  round(avg(i - 3) filter (i > 3), 6) as timing_mean, {', '.join(f'round(quantile_cont((i - 3)::double, {q / 100}) filter (i > 3), 6) as timing_p{q}' for q in (50, 95, 99))} from m, c""",
    "l14_sql": "select p_partkey, case when p_partkey % 2 = 0 then 1.0::double end as score from part",
    "l15_execution": "select p_partkey, round(0.3::double + case when p_partkey % 2 = 0 then 0.2 else 0 end + 0.5 / 3, 6) as score from part",
    "l17_by_type": f"with {SCORED} select coalesce(query_type, 'all') as query_type, {report_sql('group by rollup (query_type)')}",
    "m1_usage": f"with {EVENTS} select coalesce(event_type, 'all') as caller, count(*) as calls, count(*) filter (k % 2 = 0) as cache_hits, sum(length(props))::bigint as input_chars, count(*) as output_chars, sum(k)::bigint as input_tokens, 2 * count(*) as output_tokens, count(*) filter (k % 2 <> 0) as real_calls, round(100 * count(*) filter (k % 2 = 0) / count(*), 2) as hit_rate from e group by rollup (event_type)",
    "m2_usage_stream": f"with {EVENTS} select event_type as caller, count(*) as calls, count(*) filter (k % 2 = 0) as cache_hits, sum(k)::bigint as input_tokens from e group by 1",
    "m3_tokens": f"with {EVENTS} select event_id, case when event_id % 2 = 0 then k else 0 end as input_tokens, case when event_id % 2 = 0 then 0 else k end as output_tokens from e",
    "m4_quota": "select user_id, ts::date as day, count(*) as uploads, greatest(count(*) - 2, 0) as over from events where event_type = 'purchase' group by 1, 2",
    "m5_daily_stream": "with d as (select user_id, ts::date as day, count(*) as n from events where event_type = 'purchase' group by 1, 2), m as (select max(ts) - interval 1 hour as w from events where event_type = 'purchase') select user_id, count(*) as days, sum(n)::bigint as uploads from d, m where day + interval 1 day <= w group by 1",
    "m6_live": f"with {ENTRIES} select key, value, expires_at - 1704844800 as remaining from n where expires_at > 1704844800 and key like 'click%'",
    "m7_namespaces": f"with {ENTRIES} select case when ttl < 10 then '(no-ns)' else split_part(key, ':', 1) end as namespace, count(*) as entries from n group by 1",
    "m8_keys": "select item_id, 'emb:' || left(sha256(item_id || '␟' || text), 32) as key from benchmark",
    "m9_latest": f"with {ENTRIES}, s as (select *, case when ttl < 20 then 86400 else ttl * 3600 end as t from n where ttl <> 0), l as (select * from s qualify row_number() over (partition by key order by created_at desc, value desc) = 1) select key, value from l where created_at + t > 1704844800 + 86400 * 20",
    "m10_drain": "with p as (select event_id from events where event_id % 3 <> 0 order by ts, event_id limit 50), t as (select e.event_id, case when e.event_id % 3 = 0 then 'SUCCESS' else 'PENDING' end as s, (e.event_id % 4)::int as r, p.event_id is not null as ran, e.event_id % 5 = 0 as bad from events e left join p on p.event_id = e.event_id), u as (select event_id, case when not ran then s when not bad then 'SUCCESS' when r + 1 < 3 then 'PENDING' else 'FAILED' end as status, r + (ran and bad)::int as retry_count from t) select event_id as task_id, status, retry_count from u",
    "m11_support_stream": f"with {EVENTS}, c as (select event_type as affected_type, user_id::varchar as affected_key, sum(case when k % 2 = 0 then 1 else -1 end)::bigint as support_count from e group by 1, 2) select *, case when support_count > 0 then 'UPSERT' else 'DELETE' end as operation from c",
    "m11_key_table": f"with {EVENTS}, c as (select event_type as affected_type, user_id::varchar as affected_key, sum(case when k % 2 = 0 then 1 else -1 end)::bigint as support_count from e group by 1, 2) select * from c where support_count > 0",
    "m12_cleanup": "select event_id as task_id, case when event_id % 3 = 0 then 'SUCCESS' else 'PENDING' end as status from events where not (event_id % 3 = 0 and ts < timestamp '2024-01-13')",
}
