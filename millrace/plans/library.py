"""Queries of sources, catalog, hits and tables."""

import functools

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from millrace.operators import catalog as C
from millrace.operators import lexical as L
from millrace.operators import post as P
from millrace.operators import tabular as K
from millrace.plans.text import table
from millrace.sources import collection as O
from millrace.sources import io as A
from millrace.sources.scratch import new_folder, spread


def catalog(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.concat(F.lit("doc"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".MD").otherwise(".txt")).alias("filename"), F.concat_ws("/", F.lit(""), "lang", "source").alias("folder"),
        F.array("lang", "source").alias("tags"), F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("done").alias("status"), F.timestamp_seconds(1_700_000_000 + F.col("doc_id") % 1000).alias("created_at"), F.lit(1).alias("doc_version"), "text",
    )


CAT = "ca as (select doc_id, 'doc' || doc_id || case when doc_id % 3 = 0 then '.MD' else '.txt' end as filename, '/' || lang || '/' || source as folder, [lang, source] as tags, case when doc_id % 5 = 0 then 'failed' else 'done' end as status, doc_id % 1000 as age, text from documents)"


def a1_corpus(spark, sf_dir):
    """The documents' lines, written as text files and read back file by file."""
    path = new_folder(spark, "corpus")
    table(spark, sf_dir, "documents").select("source", F.col("text").alias("value")).write.option("maxRecordsPerFile", 500).partitionBy("source").text(path)
    lines = A.read_corpus(spark, path).select(F.explode(F.split("markdown", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy(F.md5("line").alias("line_md5")).agg(F.count("*").alias("lines"))


def a2_accepted(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("u"))
    named = p.select("page_id", F.concat("u", F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, "").otherwise(".exe")).alias("filename"))
    return A.accepted(named.withColumn("filename", F.element_at(F.split("filename", "/"), -1))).select("page_id", A.extension(F.col("filename")).alias("extension"))


def a3_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 3 <> 0").select(F.sha2("text", 256).alias("chunk_hash"), "doc_id", F.lit(1).alias("version")).groupBy("chunk_hash").agg(F.min("doc_id").alias("doc_id"), F.min("version").alias("version"))
    new = docs.filter("doc_id % 2 = 0").select(F.sha2("text", 256).alias("chunk_hash"), "doc_id", F.col("doc_id").cast("int").alias("version"))
    return A.upsert(old, new, ["chunk_hash"]).select("chunk_hash", "doc_id")


def a4_evidence(spark, sf_dir):
    """Suppliers as stored evidence; every third comes again in a batch, with new ones behind."""
    s = table(spark, sf_dir, "supplier")
    at = F.lit("2024-01-02 00:00:00").cast("timestamp")
    old = s.selectExpr(
        "concat('e', s_suppkey) as evidence_id", "'c' as chunk_hash", "'ENTITY' as evidence_type", "concat('supplier:', s_name) as entity_key", "'said' as evidence_text", "cast(0.9 as double) as confidence", "'v1' as extractor_version",
        "s_suppkey % 2 = 0 as active", "timestamp '2024-01-01 00:00:00' as created_at", "timestamp '2024-01-01 00:00:00' as updated_at",
    )
    new = s.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("e"), F.col("s_suppkey") + F.when(F.col("s_suppkey") % 2 == 0, 0).otherwise(1_000_000)).alias("evidence_id"), F.lit("d").alias("chunk_hash"), F.lit("ENTITY").alias("evidence_type"), F.when(F.col("s_suppkey") % 4 == 0, 0.7).alias("confidence"))
    return A.upsert_evidence(old, new, at).select("evidence_id", "chunk_hash", "entity_key", "evidence_text", "confidence", "extractor_version", "active", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


def a5_samples(spark, sf_dir):
    """Items as evaluation samples, written in two sets and read back together."""
    b = table(spark, sf_dir, "benchmark")
    none = F.lit(None).cast("string")
    made = b.select(F.format_string("%03d", "item_id").alias("id"), F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, "sql_query").otherwise("simple_fact").alias("query_type"), none.alias("ground_truth_answer"), F.array(F.lit("a.md")).alias("ground_truth_sources"), F.array(F.col("item_id").cast("string")).alias("ground_truth_ids"))
    paths = [new_folder(spark, "samples") for _ in range(2)]
    for kind, path in zip(("simple_fact", "sql_query"), paths, strict=True):
        A.write_samples(made.filter(F.col("query_type") == kind), path, 7)
    return A.read_samples(spark, *paths).select("id", F.md5("query").alias("query_md5"), "query_type", "ground_truth_answer", F.array_join("ground_truth_ids", ",").alias("ids"))


def a6_import(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    old = b.filter("item_id % 4 = 0").select(F.when(F.col("item_id") % 8 == 0, F.format_string("%03d", F.col("item_id"))).otherwise("x").alias("id"), F.col("text").alias("query"))
    new = b.filter("item_id % 4 = 1").select(F.lit("").alias("id"), F.col("text").alias("query"))
    return A.import_samples(old, new).select("id", F.md5("query").alias("query_md5"))


def a7_reports(spark, sf_dir):
    """A report file for every source, with metrics that some of them lack, as summary rows."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("most"))
    even = F.col("n") % 2 == 0
    summary = F.struct(F.col("n").alias("total"), F.when(even, F.col("n") / 8).alias("recall_at_5"), F.when(~even, F.col("most") / 4).alias("ndcg_at_5"), F.when(even, F.col("most") / 2).alias("mrr"))
    path = new_folder(spark, "reports")
    d.select(F.to_json(F.struct(summary.alias("summary"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return A.read_reports(spark, path).drop("filename")


def a8_snapshot(spark, sf_dir):
    """An index written by bucket and read back, with what speaks against using it."""
    docs = table(spark, sf_dir, "documents")
    path = new_folder(spark, "index")
    L.save_index(spread(docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")), path)
    index, n = L.load_index(spark, path), docs.count()
    now, later = (L.index_errors(index, k).select(F.lit(kind).alias("against"), "reason") for kind, k in (("these documents", n), ("one more", n + 1)))
    return now.unionByName(later)


def a9_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("chunks"), F.bool_or(F.col("n_chars") > 5000).alias("has_long"))


def a10_tables(spark, sf_dir):
    """Tables by name, from the folder or whatever is below it."""
    found = A.load_tables(spark, sf_dir, ["nation", "region"])
    return found["nation"].join(found["region"], F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("nations"))


def c1_listing(spark, sf_dir):
    return C.listing(catalog(spark, sf_dir), folder="/en", status="done", kind="md", limit=20, offset=5).select("doc_id", "filename", "folder")


def c2_tagged(spark, sf_dir):
    return C.scope(catalog(spark, sf_dir), tags=["src1", "de"])


def c3_folders(spark, sf_dir):
    return C.folders(catalog(spark, sf_dir), table(spark, sf_dir, "nation").select(F.concat(F.lit("/en/src"), "n_nationkey").alias("path")))


def c4_tags(spark, sf_dir):
    return C.tag_counts(catalog(spark, sf_dir))


def c5_scope(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return chunks.join(C.scope(catalog(spark, sf_dir), folder="/fr"), "doc_id", "left_semi").groupBy("label").agg(F.count("*").alias("chunks"))


def c6_normal(spark, sf_dir):
    return catalog(spark, sf_dir).select("doc_id", C.normal_folder(F.concat(F.expr("substr(folder, 2)"), F.lit("//"))).alias("folder"))


def c7_move(spark, sf_dir):
    return C.move(catalog(spark, sf_dir), "/en", "/old/en").select("doc_id", "folder")


def c8_delete(spark, sf_dir):
    return C.delete_folder(catalog(spark, sf_dir), "/en/src1").select("doc_id")


def c9_tags(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    return rows.select("doc_id", F.array_join(C.remove_tag(C.add_tag(F.col("tags"), "src0"), "en"), ",").alias("tags"))


def collection(spark, sf_dir, documents):
    """Every document is one chunk, whose language and source are entities; vectors are those of the embeddings table."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.concat(F.lit("c"), "doc_id").alias("chunk_hash"), F.substring("text", 1, 60).alias("text"))
    none = [F.lit(None).cast("string").alias(c) for c in ("subject_key", "predicate", "object_key", "attr_key", "attr_value")]
    keys = F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("size:"), F.length("text") % 50)))
    evidence = docs.select(F.concat(F.lit("c"), "doc_id").alias("chunk_hash"), F.lit("ENTITY").alias("evidence_type"), keys.alias("entity_key"), (F.col("doc_id") % 7 > 0).alias("active"), *none).filter("entity_key is not null")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return O.create(new_folder(spark, "collection"), documents, spread(chunks), vectors, evidence, buckets=8)


def shown_collection(at, keys):
    row = lambda df, name, key, n: df.select(F.lit(name).alias("name"), F.col(key).cast("string").alias("key"), n.alias("n"))
    one = F.lit(1).cast("bigint")
    rows = [row(at.read(name), name, "doc_id", one) for name in ("documents", "chunks", "vectors")] + [row(at.read("support"), "support", "affected_key", F.col("support_count")), row(keys, "affected", "affected_key", one)]
    rows.append(row(at.index().chunks(), "index", "chunk_id", F.col("length").cast("bigint")))
    rows.append(row(at.read("evidence").filter("active").groupBy("chunk_hash").agg(F.count("*").alias("n")), "evidence", "chunk_hash", F.col("n")))
    return functools.reduce(DataFrame.unionByName, rows)


def c10_cascade(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return shown_collection(*O.delete_documents(collection(spark, sf_dir, docs), table(spark, sf_dir, "labels").filter("quality = 0")))


def c11_reindex(spark, sf_dir):
    docs = catalog(spark, sf_dir)
    chunks = docs.select("doc_id", F.lit("old").alias("state"))
    kept, raised = C.reindex(chunks, chunks.filter("doc_id % 4 = 0").withColumn("state", F.lit("new")), docs)
    return kept.join(raised.select("doc_id", "doc_version"), "doc_id").select("doc_id", "state", "doc_version")


def c12_orphans(spark, sf_dir):
    """Every third document is missing from the catalog."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 3 > 0").select("doc_id")
    return shown_collection(*O.delete_orphans(collection(spark, sf_dir, docs)))


def c13_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
    return d.crossJoin(table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"))).crossJoin(table(spark, sf_dir, "nation").agg(F.count("*").alias("entities")))


def hits(spark, sf_dir):
    """Turns of conversations as hits: the conversation is the query, halves of it are documents."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.floor(F.col("turn") / 3).alias("doc_id"), F.concat(F.lit("d_chunk_"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("chunk_id"), "text", "role", (1 / (F.col("turn") + 1)).alias("score"))


def j1_dedup(spark, sf_dir):
    h = hits(spark, sf_dir)
    again = h.unionByName(h.withColumn("rank", F.col("rank") + 100)).unionByName(h.withColumn("rank", F.col("rank") + 200).withColumn("chunk_id", F.lit("")))
    return P.dedup(again).select("query_id", "rank", "chunk_id")


def j2_adjacent(spark, sf_dir):
    h = hits(spark, sf_dir)
    merged = P.merge_adjacent(h.withColumn("idx", P.chunk_index(F.lit(None), F.col("chunk_id"))))
    return merged.select("query_id", "doc_id", "chunk_id", F.length("text").alias("chars"), F.round("score", 6).alias("score"))


def j3_index(spark, sf_dir):
    return hits(spark, sf_dir).select("query_id", "chunk_id", P.chunk_index(F.when(F.col("rank") % 2 == 0, F.col("rank")), F.col("chunk_id")).alias("idx"))


def j4_context(spark, sf_dir):
    packed = P.pack_context(hits(spark, sf_dir).select("query_id", "rank", "text"), 900)
    return packed.select("query_id", F.md5("context").alias("context_md5"), "blocks")


def j5_citations(spark, sf_dir):
    return P.citations(hits(spark, sf_dir), 2).select("query_id", F.array_join("citations", "; ").alias("citations"))


def j6_insufficient(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    answer = F.concat("text", F.when(F.col("turn") % 3 == 1, " There is Not Enough Information.").otherwise(""))
    return t.select("conv_id", "turn", P.insufficient(answer).alias("insufficient"))


def j8_routes(spark, sf_dir):
    h = hits(spark, sf_dir).withColumn("chunk_id", F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("excel:"), "chunk_id")).otherwise(F.col("chunk_id")))
    return P.route_hits(h.select("query_id", P.is_data_table(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("chunk_id")).alias("is_table"), F.when(F.col("query_id") % 2 == 0, F.lit(1)).otherwise(F.col("rank")).alias("sheet_id")))


def j8_reroutes(spark, sf_dir):
    """After an answer: what lacks something goes to the sheets once, while there are rounds left."""
    t = table(spark, sf_dir, "conversations")
    lacking = P.insufficient(F.when(F.col("turn") % 3 == 1, F.lit("There is insufficient information.")).otherwise(F.lit("Yes.")))
    return t.select("conv_id", "turn", P.route_answer(F.col("turn") % 5 == 0, F.col("conv_id") % 2 == 0, lacking, F.col("turn"), 6).alias("route"))


def j9_query_routes(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["chitchat", "simple_fact", "multi_hop", "holistic"]))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(kinds, (F.col("turn") % 4 + 1).cast("int")).alias("t"))
    return t.select("conv_id", "turn", P.route_query(F.col("t"), F.col("conv_id") % 2 == 0).alias("route"))


def j10_parsed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    shape = F.col("c_custkey") % 4
    text = F.when(shape == 0, 'ok {"query_type": "multi_hop", "confidence": 0.9, "graph_eligible": true} end').when(shape == 1, '{"query_type": "poem"}').when(shape == 2, "no json").otherwise("{broken")
    parsed = c.select("c_custkey", P.parse_router(text).alias("r"), P.parse_validator(text).alias("v"))
    return parsed.select("c_custkey", "r.query_type", "r.confidence", "r.graph_eligible", "v.is_valid", "v.citation_accuracy")


def k1_profile(spark, sf_dir):
    return K.profile(table(spark, sf_dir, "part")).select("column", "data_type", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), F.round("mean", 4).alias("mean"), F.array_join("enum", ",").alias("enum"), "n_values")


def sheets(spark, sf_dir):
    """Suppliers as sheets of their nation's document."""
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("sheet_index"), (F.col("s_suppkey") % 7).alias("created_at"))


def k4_samples(spark, sf_dir):
    """Orders as sheets of their lines, of which returned ones are blank rows."""
    items = table(spark, sf_dir, "lineitem").withColumn("blank", F.col("l_returnflag") == "R")
    cells = items.select(F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("row_no"), F.when(F.col("blank"), F.array(F.lit(None).cast("string"), F.lit(None).cast("string"))).otherwise(F.array(F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("cells"))
    return K.sample_rows(cells, 2).select("sheet_id", F.array_join(F.transform("sample", lambda r: F.array_join(r, ",")), ";").alias("sample"))


def k13_sheets(spark, sf_dir):
    """Sheets of the first region's nations are listed by index, those of the second's are deleted."""
    n = table(spark, sf_dir, "nation")
    own = lambda region: n.filter(F.col("n_regionkey") == region).select(F.col("n_nationkey").alias("doc_id"))
    left, _ = K.delete_sheets(sheets(spark, sf_dir), own(1))
    return K.list_sheets(left, own(0)).select("doc_id", "sheet_index", F.col("place").cast("long").alias("place")).unionByName(K.delete_sheets(sheets(spark, sf_dir), own(1))[1].select("doc_id", F.lit(None).cast("bigint").alias("sheet_index"), F.col("deleted").alias("place")))


def k5_typed(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("Part Key"), F.when(F.col("p_size") > 40, "nan").otherwise(F.col("p_size").cast("string")).alias("Größe"), F.when(F.col("p_partkey") % 2 == 0, "12x").otherwise(F.col("p_retailprice").cast("string")).alias("3 price"))
    loaded = K.load_typed(p, dict(zip(p.columns, K.clean_headers(p.columns), strict=True)), {"Part Key": "INTEGER", "Größe": "INTEGER", "3 price": "REAL"})
    return loaded.select(F.col("Part_Key").alias("part_key"), F.col("Größe").alias("size"), F.round("col_2", 4).alias("price"))


def k6_described(spark, sf_dir):
    return K.describe(K.profile(table(spark, sf_dir, "nation")))


def k9_guarded(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("millrace_lineitem")
    return K.run_guarded(spark, "```sql\nSELECT l_returnflag, count(*) AS n FROM millrace_lineitem GROUP BY l_returnflag;\n```", seconds=600)


def k10_retries(spark, sf_dir):
    """An unsafe candidate, one that can't be analysed, two that fail when they run, then a good one; with the log."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("millrace_orders")
    bad = ["DROP TABLE x", "SELECT nothing FROM millrace_orders", "SELECT o_orderkey / (o_orderkey - o_orderkey) FROM millrace_orders", "SELECT CAST(o_orderstatus AS INT) FROM millrace_orders"]
    out, log = K.run_first(spark, [*bad, "SELECT o_orderstatus, count(*) AS n FROM millrace_orders GROUP BY o_orderstatus"], seconds=600)
    return out.withColumn("log", F.lit(", ".join(outcome for _, outcome in log)))


def k11_document(spark, sf_dir):
    top = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return K.as_document(top, ["s_nationkey"], 10)


QUERIES = {f.__name__: f for f in (a1_corpus, a2_accepted, a3_upsert, a4_evidence, a5_samples, a6_import, a7_reports, a8_snapshot, a9_scan, a10_tables, c1_listing, c2_tagged, c3_folders, c4_tags, c5_scope, c6_normal, c7_move, c8_delete, c9_tags, c10_cascade, c11_reindex, c12_orphans, c13_stats, j1_dedup, j2_adjacent, j3_index, j4_context, j5_citations, j6_insufficient, j8_routes, j8_reroutes, j9_query_routes, j10_parsed, k1_profile, k4_samples, k5_typed, k6_described, k9_guarded, k10_retries, k11_document, k13_sheets)}

HITS = "hi as (select conv_id as query_id, turn + 1 as rank, turn // 3 as doc_id, 'd_chunk_' || printf('%04d', turn) as chunk_id, text, turn, 1 / (turn + 1) as score from conversations)"


def profile_sql(columns: list[tuple[str, str]], name: str) -> str:
    parts = []
    for c, kind in columns:
        number = kind != "TEXT"
        agg = lambda f: f"round({f}({c})::double, 4)" if number else "null::double"  # noqa: E731, B023
        parts.append(f"select '{c}' as \"column\", '{kind}' as data_type, {agg('min')} as min, {agg('max')} as max, {agg('avg')} as mean, case when count(distinct {c}) <= 20 then (select string_agg(v, ',' order by v) from (select distinct {c}::varchar as v from {name})) end as enum, count(distinct {c}) as n_values from {name}")
    return " union all ".join(parts)



def collection_sql(gone: str, orphans: str | None = None) -> str:
    """gone: of documents; orphans: of vectors, if they may lack a document."""
    from millrace.plans.text import TOKENS

    return f"""with e as (select doc_id, unnest(['lang:' || lang, 'size:' || length(text) % 50]) as k, {gone} as gone from documents where doc_id % 7 > 0), k as (select doc_id, k, gone from e where k is not null)
select 'documents' as name, doc_id::varchar as key, 1::bigint as n from documents where not ({gone}) union all select 'chunks', doc_id::varchar, 1 from documents where not ({gone})
union all select 'vectors', doc_id::varchar, 1 from (select vec_id as doc_id from embeddings) where not ({orphans or gone})
union all select 'support', k, count(*) from k where not gone group by k union all select distinct 'affected', k, 1 from k where gone
union all select 'index', doc_id::varchar, len({TOKENS}) from (select doc_id, left(text, 60) as text from documents) where not ({gone}) union all select 'evidence', 'c' || doc_id, count(*) from k where not gone group by doc_id"""


SQL = {
    "a1_corpus": "select md5(line) as line_md5, count(*) as lines from (select unnest(string_split(text, chr(10))) as line from documents) where line <> '' group by 1",
    "a4_evidence": "with o as (select 'e' || s_suppkey as evidence_id, 'c' as chunk_hash, 'supplier:' || s_name as entity_key, 'said' as evidence_text, 0.9::double as confidence, 'v1' as extractor_version, s_suppkey % 2 = 0 as active, '2024-01-01' as created from supplier), n as (select 'e' || (s_suppkey + case when s_suppkey % 2 = 0 then 0 else 1000000 end) as evidence_id, 'd' as chunk_hash, null::varchar as entity_key, '' as evidence_text, case when s_suppkey % 4 = 0 then 0.7 else 0.5 end::double as confidence, '' as extractor_version, true as active, '2024-01-02' as created from supplier where s_suppkey % 3 = 0) select * from n union all select * from o where evidence_id not in (select evidence_id from n)",
    "a5_samples": "select printf('%03d', item_id) as id, md5(text) as query_md5, case when item_id % 2 = 0 then 'sql_query' else 'simple_fact' end as query_type, null::varchar as ground_truth_answer, item_id::varchar as ids from benchmark",
    "a7_reports": "with d as (select count(*) as n, max(n_chars) as m from documents group by source) select n as total, case when n % 2 = 0 then n / 8 else 0 end::double as recall_at_5, case when n % 2 <> 0 then m / 4 end::double as ndcg_at_5, case when n % 2 = 0 then m / 2 else 0 end::double as mrr, null::double as hallucination_rate from d",
    "a10_tables": "select r_name, count(*) as nations from nation join region on n_regionkey = r_regionkey group by 1",
    "k4_samples": "select l_orderkey as sheet_id, string_agg(l_partkey || ',' || l_linenumber, ';' order by l_linenumber, l_partkey::varchar) as sample from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey::varchar) as rn from lineitem where l_returnflag <> 'R') where rn <= 2 group by 1",
    "k13_sheets": "select s_nationkey as doc_id, s_suppkey as sheet_index, row_number() over (partition by s_nationkey order by s_suppkey) as place from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 0 union all select s_nationkey, null, count(*) from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1 group by 1",
    "a2_accepted": "select page_id, 'pdf' as extension from pages where page_id % 3 = 0",
    "a3_upsert": "with o as (select sha256(text) as h, min(doc_id) as d from documents where doc_id % 3 <> 0 group by 1), n as (select sha256(text) as h, max(doc_id) as d from documents where doc_id % 2 = 0 group by 1) select coalesce(n.h, o.h) as chunk_hash, coalesce(n.d, o.d) as doc_id from o full join n on o.h = n.h",
    "a6_import": "with o as (select case when item_id % 8 = 0 then printf('%03d', item_id) else 'x' end as id, text from benchmark where item_id % 4 = 0), m as (select max(try_cast(id as int)) as m from o) select id, md5(text) as query_md5 from o union all select printf('%03d', m + row_number() over (order by text)), md5(text) from benchmark, m where item_id % 4 = 1",
    "a8_snapshot": "select 'one more' as against, 'chunks differ' as reason",
    "a9_scan": "select source, count(*) as chunks, bool_or(n_chars > 5000) as has_long from documents group by 1",
    "c1_listing": f"with {CAT} select doc_id, filename, folder from ca where folder like '/en/%' and status = 'done' and filename like '%.MD' order by age desc, doc_id limit 20 offset 5",
    "c2_tagged": "select doc_id from documents where lang = 'de' or source = 'src1'",
    "c3_folders": f"with {CAT}, c as (select folder, count(*) as n from ca group by 1), m as (select '/en/src' || n_nationkey as path from nation) select coalesce(folder, path) as path, coalesce(n, 0) as documents from c full join m on folder = path",
    "c4_tags": f"with {CAT} select unnest(tags) as tag, count(*) as documents from ca group by 1",
    "c5_scope": "select label, count(*) as chunks from embeddings where vec_id in (select doc_id from documents where lang = 'fr') group by 1",
    "c6_normal": f"with {CAT} select doc_id, folder from ca",
    "c7_move": f"with {CAT} select case when folder like '/en/%' then '/old' || folder else folder end as folder, doc_id from ca",
    "c8_delete": "select doc_id from documents where not (lang = 'en' and source = 'src1')",
    "c9_tags": "select doc_id, array_to_string(list_filter(case when source = 'src0' then [lang, source] else [lang, source, 'src0'] end, lambda x: x <> 'en'), ',') as tags from documents",
    "c10_cascade": collection_sql("doc_id in (select doc_id from labels where quality = 0)"),
    "c11_reindex": "select case when doc_id % 4 = 0 then 'new' else 'old' end as state, case when doc_id % 4 = 0 then 2 else 1 end as doc_version, doc_id from documents",
    "c12_orphans": collection_sql("doc_id % 3 = 0", "doc_id not in (select doc_id from documents where doc_id % 3 > 0)"),
    "c13_stats": "select (select count(*) from documents) as documents, (select sum(n_chars)::bigint from documents) as chars, (select count(*) from embeddings) as vectors, (select count(*) from nation) as entities",
    "j1_dedup": f"with {HITS}, a as (select query_id, rank, chunk_id, text from hi union all select query_id, rank + 200, '', text from hi) select query_id, rank, chunk_id from a qualify row_number() over (partition by query_id, trim(text, ' ') order by rank) = 1",
    "j2_adjacent": f"""with recursive {HITS}, r as (select *, turn - row_number() over (partition by query_id, doc_id order by turn) as island from hi), o as (select *, row_number() over (partition by query_id, doc_id, island order by turn) as n from r),
g as (select query_id, doc_id, island, n, 1 as part, length(text) as chars from o where n = 1 union all
  select o.query_id, o.doc_id, o.island, o.n, case when g.chars + 2 + length(o.text) <= 2000 then g.part else g.part + 1 end, case when g.chars + 2 + length(o.text) <= 2000 then g.chars + 2 + length(o.text) else length(o.text) end from g join o on o.query_id = g.query_id and o.doc_id = g.doc_id and o.island = g.island and o.n = g.n + 1)
select query_id, doc_id, string_agg(chunk_id, '+' order by turn) as chunk_id, (sum(length(text)) + 2 * (count(*) - 1))::int as chars, round(max(score), 6) as score from o join g using (query_id, doc_id, island, n) group by query_id, doc_id, island, part""",
    "j3_index": f"with {HITS} select query_id, chunk_id, case when rank % 2 = 0 then rank else turn end::int as idx from hi",
    "j4_context": f"with {HITS}, b as (select query_id, row_number() over (partition by query_id order by rank) as n, text from hi), c as (select query_id, n, '[' || n || ']' || chr(10) || text as block from b), d as (select *, sum(length(block) + 7) over (partition by query_id order by n) as e, sum(length(block) + 7) over (partition by query_id) - 7 as t from c) select query_id, md5(left(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by n), 900)) as context_md5, count(*) as blocks from d where t <= 900 or e <= 900 or n = 1 group by 1",
    "j5_citations": f"with {HITS}, b as (select *, row_number() over (partition by query_id order by rank) as n from hi) select query_id, string_agg('[' || n || '] ' || doc_id || '/' || chunk_id, '; ' order by n) as citations from b where n <= 2 group by 1",
    "j6_insufficient": "select conv_id, turn, turn % 3 = 1 as insufficient from conversations",
    "j8_routes": f"with {HITS} select query_id, case when query_id % 3 = 0 and (query_id % 2 = 0 or count(*) = 1) then 'sql_agent' else 'answer_generator' end as route from hi group by 1",
    "j8_reroutes": "select conv_id, turn, case when turn % 5 > 0 and conv_id % 2 = 0 and turn % 3 = 1 and turn < 6 then 'sql_agent' else 'end' end as route from conversations",
    "j9_query_routes": "select conv_id, turn, case when turn % 4 = 0 then 'chitchat' when turn % 4 = 2 or (turn % 4 = 1 and conv_id % 2 = 0) then 'graph' else 'plain' end as route from conversations",
    "j10_parsed": "select c_custkey, case when c_custkey % 4 = 0 then 'multi_hop' else 'simple_fact' end as query_type, case c_custkey % 4 when 0 then 0.9 when 1 then 0.5 else 0.3 end::double as confidence, c_custkey % 4 = 0 as graph_eligible, true as is_valid, case when c_custkey % 4 < 2 then 0 else 1 end::double as citation_accuracy from customer",
    "k1_profile": profile_sql([("p_partkey", "INTEGER"), ("p_name", "TEXT"), ("p_brand", "TEXT"), ("p_type", "TEXT"), ("p_size", "INTEGER"), ("p_retailprice", "REAL")], "part"),
    "k5_typed": "select p_partkey as part_key, case when p_size <= 40 then p_size end::bigint as size, case when p_partkey % 2 = 1 then round(p_retailprice, 4) end::double as price from part",
    "k6_described": "select '- n_name (TEXT)' || chr(10) || '- n_nationkey (INTEGER)' || chr(10) || '- n_regionkey (INTEGER): 0, 1, 2, 3, 4' as columns",
    "k9_guarded": "select l_returnflag, count(*) as n from lineitem group by 1",
    "k10_retries": "select o_orderstatus, count(*) as n, 'UnsafeQuery, AnalysisException, ArithmeticException, NumberFormatException, ok' as log from orders group by 1",
    "k11_document": "with s as (select s_nationkey as k, count(*) as n, row_number() over (order by s_nationkey) as i from supplier group by 1) select string_agg(i || '. s_nationkey=' || k || ', n=' || n, chr(10) order by i) as document, count(*) as shown from s where i <= 10",
}
