"""Queries of lexical and dense retrieval and fusion: documents are chunks, benchmark items are queries, and every vector whose
id is divisible by 100 is a query of the dense side, against all vectors; its number divided by 100 is that of its item."""

import pyspark.sql.functions as F

from millrace.functions import cells as C
from millrace.functions import vectors as V
from millrace.operators import fusion as R
from millrace.operators import lexical as L
from millrace.operators import segments as S
from millrace.params import DEFAULT
from millrace.sources.scratch import kept_folder, new_folder, spread, stored
from millrace.plans.text import STOP, TOKENS, table


def chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def index(spark, sf_dir):
    """The stored index of all documents; it is built once per session and state of the table."""
    docs = table(spark, sf_dir, "documents")
    return S.open_store(spark, kept_folder(docs, "index", lambda path: S.create(spread(chunks(spark, sf_dir)), path)))


def bm25(spark, sf_dir, k, doc_ids=None, rewritten=False):
    return stored(S.search(index(spark, sf_dir), asked(spark, sf_dir), k, doc_ids=doc_ids, rewritten=rewritten), "bm25")


def shown(hits):
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def terms_of(index):
    return index.terms().select("term", "df", F.round("idf", 6).alias("idf"))


def d1_index(spark, sf_dir):
    return terms_of(index(spark, sf_dir))


def d2_merge(spark, sf_dir):
    """Odd thirds are stored, even chunks are added in three parts; those stored already are not read again."""
    rows = chunks(spark, sf_dir)
    made = S.create(spread(rows.filter("chunk_id % 3 <> 0")), new_folder(spark, "index"))
    for part in range(3):
        made = S.add(made, spread(rows.filter(f"chunk_id % 2 = 0 and chunk_id % 5 in ({part}, {part + 2})")))
    return terms_of(made)


def d3_remove(spark, sf_dir):
    """Documents of low quality go in two steps, after the others with a label were added again, which changes nothing."""
    gone = table(spark, sf_dir, "labels").filter("quality = 0")
    made = S.create(spread(chunks(spark, sf_dir)), new_folder(spark, "index"))
    made = S.remove(made, gone.filter("doc_id % 2 = 0"))
    made = S.add(made, chunks(spark, sf_dir).join(gone, "doc_id", "left_anti"))
    return terms_of(S.remove(made, gone))


def d4_search(spark, sf_dir):
    return shown(bm25(spark, sf_dir, DEFAULT.top_k))


def d4_filtered(spark, sf_dir):
    return shown(bm25(spark, sf_dir, 5, table(spark, sf_dir, "labels").filter("quality = 1")))


def d5_normalised(spark, sf_dir):
    return shown(L.normalised(bm25(spark, sf_dir, 10)))


def d6_whitespace(spark, sf_dir):
    return shown(bm25(spark, sf_dir, 5, rewritten=True))


def embedded(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def dense_queries(spark, sf_dir):
    return embedded(spark, sf_dir).filter("id % 100 = 0").select((F.col("id") / 100).cast("long").alias("query_id"), "vector")


def dense(spark, sf_dir, k, rows=None):
    rows = embedded(spark, sf_dir) if rows is None else rows
    return stored(V.top_k(rows, dense_queries(spark, sf_dir), k), "dense").withColumnRenamed("id", "chunk_id")


def e1_encode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    empty = spark.createDataFrame([], "key string, vector array<float>")
    encoder = V.hashed_encoder(whole=True)
    _, cache = V.encode_with_cache(docs.filter("id % 2 = 0"), empty, encoder)
    found, _ = V.encode_with_cache(docs, cache, encoder)
    return found.select("id", "key", F.size("vector").alias("dim"), F.round(F.expr("aggregate(vector, 0D, (s, x) -> s + x * x)"), 4).alias("norm"))


def e2_search(spark, sf_dir):
    return shown(dense(spark, sf_dir, DEFAULT.top_k))


def e2_filtered(spark, sf_dir):
    return shown(dense(spark, sf_dir, 5, embedded(spark, sf_dir).filter("label in (1, 2)")))


def cells(spark, sf_dir):
    """The stored inverted file of all vectors; it is built once per session and state of the table."""
    rows = table(spark, sf_dir, "embeddings")
    return C.load(spark, kept_folder(rows, "cells", lambda path: C.build(embedded(spark, sf_dir), path)))


def e3_inverted_file(spark, sf_dir):
    """All cells probed: codes leave a short list, so the hits are those of the exact search."""
    return shown(C.search(cells(spark, sf_dir), dense_queries(spark, sf_dir), 10).withColumnRenamed("id", "chunk_id"))


def e3_probed(spark, sf_dir):
    """As many cells probed as sampled vectors need for a recall of 0.93."""
    own = cells(spark, sf_dir)
    return shown(C.search(own, dense_queries(spark, sf_dir), 10, C.probes_for(own, 10)).withColumnRenamed("id", "chunk_id"))


def e4_threshold(spark, sf_dir):
    hits = dense(spark, sf_dir, 50).filter(F.col("score") >= 0.3)
    return shown(hits)


def e5_scope(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    return shown(dense(spark, sf_dir, 5, embedded(spark, sf_dir).join(ids, "id", "left_semi")))


def e6_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    return embedded(spark, sf_dir).join(gone, "id", "left_anti").select("id", "label")


def fused(spark, sf_dir, top=20):
    fetch = R.fetch_size(top)
    return stored(R.fuse(dense(spark, sf_dir, fetch), bm25(spark, sf_dir, fetch)), "fused")


def with_vectors(spark, sf_dir, hits):
    """Hits of dense queries with the vectors of both sides."""
    own = dense_queries(spark, sf_dir).withColumnRenamed("vector", "query_vector")
    return hits.select("query_id", "chunk_id").join(embedded(spark, sf_dir).select(F.col("id").alias("chunk_id"), "vector"), "chunk_id").join(own, "query_id")


def f2_fusion(spark, sf_dir):
    out = fused(spark, sf_dir).filter("rank <= 20")
    return shown(out).join(out.select("query_id", "chunk_id", F.round("dense_score", 6).alias("dense_score"), F.round("bm25_score", 6).alias("bm25_score")), ["query_id", "chunk_id"])


def f3_multi_query(spark, sf_dir):
    both = dense(spark, sf_dir, 20).withColumn("rewrite", F.pmod("query_id", F.lit(2)).cast("int")).withColumn("query_id", F.floor(F.col("query_id") / 2).cast("long"))
    out = R.fuse(both, bm25(spark, sf_dir, 20)).filter("rank <= 20")
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.array_join(F.transform("source_queries", lambda x: x.cast("string")), ",").alias("sources"))


def f4_rewrites(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").filter("role = 'user'")
    made = talk.select("conv_id", "turn", F.posexplode(R.rewrites(F.col("text"), F.filter(F.split("text", r"\. "), lambda x: F.length(x) > 12), 3)).alias("place", "query"))
    return made.select("conv_id", "turn", "place", F.md5("query").alias("query_md5"))


def f5_vector_rerank(spark, sf_dir):
    pairs = with_vectors(spark, sf_dir, fused(spark, sf_dir).filter("rank <= 20"))
    return shown(R.rerank_by_vector(pairs, 10).withColumn("score", F.col("rerank_score")))


def f6_tfidf_rerank(spark, sf_dir):
    hits = bm25(spark, sf_dir, 10).select("query_id", "chunk_id").join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    return shown(R.rerank_by_tfidf(stored(hits, "candidates"), asked(spark, sf_dir), 5).withColumn("score", F.col("rerank_score")))


ANSWERS = [[3, 9, 0, 5, -1, 2], [1, 0], [5, 4, 3, 2, 1, 0]]


def answers(hits):
    """Three kinds of responses, by the query's number."""
    said = F.element_at(F.array(*(F.lit(f"Order: {x}") for x in ANSWERS)), (F.pmod("query_id", F.lit(3)) + 1).cast("int"))
    return hits.select("query_id").distinct().select("query_id", said.alias("response"))


def f7_answer_rerank(spark, sf_dir):
    hits = dense(spark, sf_dir, 6)
    return shown(R.rerank_by_answer(hits, answers(hits), 3).withColumn("score", F.col("rerank_score")))


def f8_two_stage(spark, sf_dir):
    first = R.rerank_by_vector(with_vectors(spark, sf_dir, fused(spark, sf_dir).filter("rank <= 20")), 10)
    first = stored(first, "first-stage")
    return shown(R.rerank_by_answer(first, answers(first), 2).withColumn("score", F.col("rerank_score")))


def f9_cut(spark, sf_dir):
    pairs = with_vectors(spark, sf_dir, fused(spark, sf_dir).filter("rank <= 20"))
    return shown(R.cut(R.rerank_by_vector(pairs, DEFAULT.rerank_k), DEFAULT.rerank_k, DEFAULT.rerank_threshold).withColumn("score", F.col("rerank_score")))


def f10_trace(spark, sf_dir):
    catalog = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("filename"))
    return R.trace(fused(spark, sf_dir).withColumn("doc_id", F.col("chunk_id")), catalog, DEFAULT.dense_threshold, 20).withColumn("rank", F.col("rank").cast("long"))


QUERIES = {f.__name__: f for f in (d1_index, d2_merge, d3_remove, d4_search, d4_filtered, d5_normalised, d6_whitespace, e1_encode, e2_search, e2_filtered, e3_inverted_file, e3_probed, e4_threshold, e5_scope, e6_delete, f2_fusion, f3_multi_query, f4_rewrites, f5_vector_rerank, f6_tfidf_rerank, f7_answer_rerank, f8_two_stage, f9_cut, f10_trace)}


def index_sql(where: str = "", source: str = "documents") -> str:
    return f"""
tok as materialized (select doc_id, {TOKENS} as t from {source} {where}),
st as (select count(*) as n, avg(len(t)) as al from tok),
po as materialized (select doc_id, len, term, count(*) as tf from (select doc_id, len(t) as len, unnest(t) as term from tok) group by all),
ra as (select term, count(*) as df, ln(((select n from st) - count(*) + 0.5) / (count(*) + 0.5)) as raw from po group by term),
te as materialized (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from ra) else raw end as idf from ra)"""


def search_sql(k: int, filter_: str = "true", words: str | None = None, source: str = "documents", asked: str = "benchmark") -> str:
    words = words or TOKENS
    return index_sql(source=source) + f""",
qt as (select item_id as query_id, term, count(*) as times from (select item_id, unnest({words}) as term from {asked}) group by all),
sc as (select query_id, doc_id as chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (select al from st)))) as score from po join te using (term) join qt using (term) where {filter_} group by all),
bm as materialized (select query_id, chunk_id, score, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from sc where score > 0 qualify rank <= {k})"""


def dense_sql(k: int, filter_: str = "true", name: str = "de") -> str:
    return f"""{name} as materialized (select q.vec_id // 100 as query_id, v.vec_id as chunk_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as score,
row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) desc, v.vec_id) as rank
from (select * from embeddings where vec_id % 100 = 0) q, (select *, vec_id as doc_id from embeddings) v where {filter_} qualify rank <= {k})"""


FUSED = f"""{search_sql(60)}, {dense_sql(60)},
al as (select query_id, chunk_id, rank, score as d, null::double as b, 0.6 as w from de union all select query_id, chunk_id, rank, null, score, 0.4 from bm),
fu as (select query_id, chunk_id, sum(w::double / (60 + rank)) as score, coalesce(max(d), 0) as dense_score, coalesce(max(b), 0) as bm25_score, max(d) is not null as has_dense from al group by 1, 2),
fr as materialized (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from fu)"""
RERANKED = """rr as (select fr.query_id, fr.chunk_id, greatest(0, list_cosine_similarity(q.embedding::double[], v.embedding::double[])) as score from fr join embeddings q on q.vec_id = 100 * fr.query_id join embeddings v on v.vec_id = fr.chunk_id where fr.rank <= 20),
r2 as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from rr qualify rank <= 10)"""
def answers_sql(hits: str) -> str:
    """an: the hits by the places that the responses list; places that a query's hits lack are left out."""
    said = ", ".join(f"({kind}, {place}, {i})" for kind, places in enumerate(ANSWERS) for i, place in enumerate(places))
    return f"""cn as (select query_id, count(*) as c from {hits} group by 1),
ap as (select query_id, place, row_number() over (partition by query_id order by i) - 1 as i, count(*) over (partition by query_id) as m from cn join (values {said}) v(kind, place, i) on v.kind = query_id % 3 where place between 0 and c - 1),
ax as (select h.query_id, chunk_id, 1 - ap.i / m as score from {hits} h join ap on ap.query_id = h.query_id and place = h.rank - 1),
an as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from ax)"""


SHOWN = "select query_id, chunk_id, round(score, 6) as score, rank from"

SQL = {
    "d1_index": f"with {index_sql()} select term, df, round(idf, 6) as idf from te",
    "d2_merge": f"with {index_sql('where doc_id % 3 <> 0 or doc_id % 2 = 0')} select term, df, round(idf, 6) as idf from te",
    "d3_remove": f"with {index_sql('where doc_id not in (select doc_id from labels where quality = 0)')} select term, df, round(idf, 6) as idf from te",
    "d4_search": f"with {search_sql(20)} {SHOWN} bm",
    "d4_filtered": f"with {search_sql(5, 'doc_id in (select doc_id from labels where quality = 1)')} {SHOWN} bm",
    "d5_normalised": f"with {search_sql(10)} select query_id, chunk_id, round(score / max(score) over (partition by query_id), 6) as score, rank from bm",
    "d6_whitespace": "with " + search_sql(5, words=r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')") + f" {SHOWN} bm",
    "e1_encode": r"select doc_id as id, sha256(concat_ws(chr(31), 'hashed-64', '', text)) as key, 64 as dim, case when regexp_matches(text, '\S') then 1.0 else 0.0 end::double as norm from documents",
    "e2_search": f"with {dense_sql(20)} {SHOWN} de",
    "e2_filtered": f"with {dense_sql(5, 'v.label in (1, 2)')} {SHOWN} de",
    "e4_threshold": f"with {dense_sql(50)} {SHOWN} de where score >= 0.3",
    "e5_scope": f"""with {dense_sql(5, "v.vec_id in (select doc_id from documents where lang = 'en')")} {SHOWN} de""",
    "e3_inverted_file": f"with {dense_sql(10)} {SHOWN} de",
    "e6_delete": "select vec_id as id, label from embeddings where vec_id not in (select doc_id from documents where lang = 'en')",
    "f2_fusion": f"with {FUSED} select query_id, chunk_id, round(score, 6) as score, rank, round(dense_score, 6) as dense_score, round(bm25_score, 6) as bm25_score from fr where rank <= 20",
    "f3_multi_query": f"""with {search_sql(20)}, {dense_sql(20)},
al as (select query_id // 2 as query_id, chunk_id, rank, query_id % 2 as rw, 0.6 as w from de union all select query_id, chunk_id, rank, null, 0.4 from bm),
fu as (select query_id, chunk_id, sum(w::double / (60 + rank)) as score, coalesce(string_agg(distinct rw::varchar, ',' order by rw::varchar), '') as sources from al group by 1, 2)
select query_id, chunk_id, round(score, 6) as score, sources from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from fu) where rank <= 20""",
    "f5_vector_rerank": f"with {FUSED}, {RERANKED} {SHOWN} r2",
    "f6_tfidf_rerank": f"""with {search_sql(10)},
tx as (select query_id, chunk_id, text from bm join documents on doc_id = chunk_id union all select item_id, null, text from benchmark where item_id in (select query_id from bm)),
tf as (select query_id, chunk_id, term, count(*) as tf from (select query_id, chunk_id, unnest({TOKENS}) as term from tx) where length(term) > 1 group by all),
nn as (select query_id, count(*) as n from tx group by 1), dd as (select query_id, term, count(*) as df from tf group by 1, 2),
ww as (select tf.*, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join dd using (query_id, term) join nn using (query_id)),
uu as materialized (select *, w / sqrt(sum(w * w) over (partition by query_id, chunk_id)) as u from ww),
ss as (select c.query_id, c.chunk_id, sum(c.u * q.u) as score from uu c join uu q on q.query_id = c.query_id and q.term = c.term and q.chunk_id is null where c.chunk_id is not null group by 1, 2),
rr as (select bm.query_id, bm.chunk_id, coalesce(ss.score, 0) as score from bm left join ss on ss.query_id = bm.query_id and ss.chunk_id = bm.chunk_id)
select query_id, chunk_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from rr qualify rank <= 5""",
    "f4_rewrites": """with t as (select conv_id, turn, text as o, list_filter(list_distinct(list_filter(string_split(text, '. '), lambda x: length(x) > 12)), lambda x: x <> text and trim(x, ' ') <> '') as g from conversations where role = 'user'),
g as (select conv_id, turn, o, list_filter(string_split(o, '. '), lambda x: length(x) > 12) as every from t),
u as (select g.conv_id, g.turn, o, coalesce((select list(x order by i) from (select x, min(i) as i from (select unnest(every) as x, generate_subscripts(every, 1) as i) where x <> o and trim(x, ' ') <> '' group by x)), []) as others from g),
w as (select conv_id, turn, o, list_concat([o], others)[1:4] as w from u),
f as (select conv_id, turn, case when len(w) < 2 then list_concat(w, [o]) else w end as w from w)
select conv_id, turn, (i - 1)::int as place, md5(q) as query_md5 from (select conv_id, turn, unnest(w) as q, generate_subscripts(w, 1) as i from f)""",
    "f7_answer_rerank": f"with {dense_sql(6)}, {answers_sql('de')} {SHOWN} an where rank <= 3",
    "f8_two_stage": f"with {FUSED}, {RERANKED}, {answers_sql('r2')} {SHOWN} an where rank <= 2",
    "f9_cut": f"with {FUSED}, {RERANKED} {SHOWN} r2 where score >= 0.3",
    "f10_trace": f"""with {FUSED} select query_id, rank, chunk_id, case when chunk_id % 2 = 0 then 'doc-' || chunk_id || '.md' else chunk_id::varchar end as file, round(score / max(score) over (partition by query_id), 4) as normalised,
round(dense_score, 4) as dense_score, dense_score >= 0.6 as above_threshold, case when has_dense then '0' else '' end as source_queries from fr qualify rank <= 20""",
}
