"""Queries of graph navigation: context for hits, searches of the entity and relation indexes, and retrieval that they guide.

Words of at least twelve letters of the benchmark items are entities, linked to the next one of their item; hits are BM25's.
For the index searches, parts whose number is divisible by 100 ask about themselves on the evidence of the star schema."""

import pyspark.sql.functions as F
from pyspark.sql import Window

from millrace.functions import vectors as V
from millrace.operators import evidence as E
from millrace.operators import fusion as U
from millrace.operators import lexical as X
from millrace.operators import navigate as N
from millrace.params import DEFAULT
from millrace.plans import graph as G
from millrace.plans import retrieval as R
from millrace.plans.text import table
from millrace.sources.scratch import among, spread


def item_words(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("place", "name")).filter(F.length("name") >= 12)
    return words.withColumn("next", F.lead("name").over(Window.partitionBy("item_id").orderBy("place")))


def word_edges(words):
    rows = words.filter("next is not null").select(F.col("name").alias("subject"), F.lit("BEFORE").alias("predicate"), F.col("next").alias("object")).distinct()
    return rows.select(F.concat_ws("|", "subject", "predicate", "object").alias("fact_key"), "*")


def h8_enriched_hits(spark, sf_dir):
    words = R.stored(item_words(spark, sf_dir), "item-words")
    hits = R.bm25(spark, sf_dir, 5).select("query_id", "chunk_id").join(R.chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    out = N.enriched_hits(R.stored(hits, "hits"), words.select("name").distinct(), word_edges(words))
    return out.select("query_id", "chunk_id", F.md5("graph_context").alias("context_md5"), F.regexp_count("graph_context", F.lit(r"\[Graph\] ")).alias("lines"))


def questions(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_partkey % 100 = 0")
    text = F.concat(F.lit("P"), "p_partkey", F.lit(": Part P"), "p_partkey")
    return R.stored(p.select(F.col("p_partkey").cast("long").alias("query_id"), text.alias("query"), V.hashed_encoder()(text).alias("vector")), "questions")


def found(spark, sf_dir, asked, evidence):
    """The ten best entities (query_id, entity_key, name, score, rank) and relations (query_id, text, subject, object, score, rank),
    and all relations."""
    names = R.stored(E.spelled(evidence), "spelled")
    relations = R.stored(E.relation_records(evidence, names), "relations")
    near = V.top_k_keyed(E.entity_records(evidence, names), asked, 10, "entity_key").withColumn("name", F.substring_index("entity_key", ":", -1))
    links = R.stored(V.top_k_keyed(relations.select("text"), asked, 10, "text"), "found-texts")
    ends = among(relations.select("text", "subject", "object"), links, "text")
    return R.stored(near, "found-entities"), R.stored(links.join(ends, "text"), "found-relations"), relations


def i1_index_search(spark, sf_dir):
    near, links, _ = found(spark, sf_dir, questions(spark, sf_dir), G.evidence(spark, sf_dir))
    shown = lambda df, kind, key: df.select("query_id", F.lit(kind).alias("kind"), F.col(key).alias("record"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))
    return shown(near, "entity", "entity_key").unionByName(shown(links, "relation", "text"))


def walked(spark, sf_dir, asked, mode="hybrid"):
    evidence = G.evidence(spark, sf_dir)
    near, links, relations = found(spark, sf_dir, asked, evidence)
    edges = relations.select(F.concat_ws("|", "subject", "predicate", "object").alias("fact_key"), "subject", "predicate", "object")
    paths, names = N.navigate(edges, near, links, mode)
    return near, links, R.stored(paths, "paths"), R.stored(names, "related")


def i2_related(spark, sf_dir):
    return walked(spark, sf_dir, questions(spark, sf_dir))[3]


def notes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_partkey").alias("doc_id"), F.concat(F.lit("P"), "p_partkey", F.lit(" "), "p_name", F.lit(" by "), "p_brand").alias("text"))


def i4_navigated(spark, sf_dir):
    """Both indexes, the walk, then retrieval that asks by meaning with the question and by words with the related names behind
    it; the counts of every step, each of which runs once, and the chunks."""
    asked = questions(spark, sf_dir)
    near, links, paths, names = walked(spark, sf_dir, asked)
    queries = N.enriched_query(asked, names).withColumnRenamed("query", "lexical").join(asked.select("query_id", "vector"), "query_id")
    texts = R.stored(spread(notes(spark, sf_dir)), "notes")
    vectors = R.stored(texts.select("chunk_id", V.hashed_encoder()(F.col("text")).alias("vector")), "note-vectors")
    hits = U.hybrid(X.save_index(texts, R.new_folder(spark, "notes")), vectors, R.stored(queries, "queries"), DEFAULT.top_k)
    counted = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    listed = hits.groupBy("query_id").agg(F.count("*").alias("chunks"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"].cast("string")), ",").alias("chunk_ids"))
    out = asked.select("query_id")
    for part in (counted(near, "entities"), counted(links, "relations"), counted(paths, "paths"), listed):
        out = out.join(part, "query_id", "left")
    return out.fillna(0, ["entities", "relations", "paths", "chunks"]).fillna("", ["chunk_ids"])


QUERIES = {f.__name__: f for f in (h8_enriched_hits, i1_index_search, i2_related, i4_navigated)}


def hops_sql(starts: str, name: str, hops: int) -> str:
    """name as the paths from (query_id, seed) of ``starts`` along bi (f, a, p, b), at most 50 for each seed."""
    two = f" union all select query_id, seed, x.b, 2, path || ' -[' || p || ']-> ' || x.b from {name}1 join bi x on x.a = target where x.f <> used" if hops == 2 else ""
    return f"""
{name}1 as materialized (select query_id, seed, b as target, 1 as distance, seed || ' -[' || p || ']-> ' || b as path, f as used from (select distinct query_id, seed from {starts}) join bi on a = seed),
{name} as materialized (select *, row_number() over (partition by query_id, seed order by distance, target, path) as place from (select query_id, seed, target, distance, path from {name}1{two}) where seed <> target qualify place <= 50)"""


BI = "bi as materialized (select s || '|' || p || '|' || o as f, s as a, p, o as b from ed union all select s || '|' || p || '|' || o, o, p, s from ed)"
H8 = f"""with {R.search_sql(5)},
iw as (select item_id, i, w, lead(w) over (partition by item_id order by i) as o from (select item_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as i from benchmark) where length(w) >= 12),
ed as (select distinct w as s, 'BEFORE' as p, o from iw where o is not null), {BI},
hs as materialized (select query_id, w as seed from (select distinct query_id, w from bm join documents on doc_id = chunk_id join (select distinct w from iw) on contains(text, w)) qualify row_number() over (partition by query_id order by w) <= 10),
{hops_sql("hs", "hp", 2)},
cx as (select query_id, string_agg('[Graph] ' || path, chr(10) order by seed, place) as c, count(*)::int as n from (select query_id, seed, path, min(place) as place from hp group by all) group by 1)
select bm.query_id, chunk_id, md5(coalesce(c, '')) as context_md5, coalesce(n, 0)::int as lines from bm left join cx on cx.query_id = bm.query_id"""
#: Hashed encodings of (kind, key, text) rows of tx, as u by key and number of the dimension; the sums are as the encoder's.
HASHED = r"""wd as (select kind, key, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) as w from tx),
cr as materialized (select w, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(w, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)) as h from (select distinct w from wd)),
cn as (select kind, key, h % 64 as d, sum(case when h >= 2147483648 then 1 else -1 end)::double as x from wd join cr using (w) group by all having x <> 0),
un as (select kind, key, d, (x / sqrt(sum(x * x) over (partition by kind, key)))::float::double as u from cn),
hv as materialized (select *, sqrt(sum(u * u) over (partition by kind, key)) as n from un)"""
SEARCHED = f"""ed as materialized (select distinct 'S' || l_suppkey as s, 'SUPPLIES_PART' as p, 'P' || l_partkey as o from lineitem where l_returnflag <> 'R'), {BI},
qs as (select p_partkey::bigint as query_id, 'P' || p_partkey || ': Part P' || p_partkey as query from part where p_partkey % 100 = 0),
nt as materialized (select p_partkey as doc_id, 'P' || p_partkey || ' ' || p_name || ' by ' || p_brand as text from part),
tx as materialized (select 'query' as kind, query_id::varchar as key, query as text from qs union all select distinct 'entity', 'supplier:' || s, s || ': Supplier' from ed union all select distinct 'entity', 'part:' || o, o || ': Part' from ed
  union all select 'relation', s || ' ' || p || ' ' || o, s || ' ' || p || ' ' || o from ed union all select 'note', doc_id::varchar, text from nt), {HASHED},
sx as materialized (select v.kind, q.key::bigint as query_id, v.key, sum(q.u * v.u) / (any_value(q.n) * any_value(v.n)) as score from hv q join hv v on v.d = q.d and v.kind <> 'query' where q.kind = 'query' group by v.kind, q.key, v.key),
ix as materialized (select *, row_number() over (partition by kind, query_id order by round(score, 9) desc, key) as rank from sx where kind <> 'note' qualify rank <= 10)"""
WALKED = f"""{SEARCHED},
s2 as (select query_id, split_part(key, ':', 2) as seed from ix where kind = 'entity' and rank <= 5), s1 as (select query_id, split_part(key, ' ', 1) as seed from ix where kind = 'relation' and rank <= 5),
{hops_sql("s2", "pe", 2)}, {hops_sql("s1", "pr", 1)},
rl as materialized (select query_id, split_part(key, ':', 2) as name from ix where kind = 'entity' union select query_id, seed from s1 union select query_id, split_part(key, ' ', 3) from ix where kind = 'relation' and rank <= 5 union select query_id, seed from pe union select query_id, target from pe)"""
I4 = f"""with {WALKED},
en as (select query_id as item_id, query || ' ' || array_to_string((select list(distinct name order by name) from rl where rl.query_id = qs.query_id)[1:15], ' ') as text from qs),
{R.search_sql(60, source='nt', asked='en')},
nq as materialized (select q.query_id, nt.doc_id as chunk_id, coalesce(sx.score, 0) as score from qs q cross join nt left join sx on sx.kind = 'note' and sx.query_id = q.query_id and sx.key = nt.doc_id::varchar),
de as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from nq qualify rank <= 60),
fu as (select query_id, chunk_id, sum(w::double / (60 + rank)) as score from (select query_id, chunk_id, rank, 0.6 as w from de union all select query_id, chunk_id, rank, 0.4 from bm) group by 1, 2),
fr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from fu qualify rank <= 20),
r2 as (select fr.query_id, fr.chunk_id, greatest(0, nq.score) as s, row_number() over (partition by fr.query_id order by round(greatest(0, nq.score), 9) desc, fr.chunk_id) as rk from fr join nq on nq.query_id = fr.query_id and nq.chunk_id = fr.chunk_id qualify rk <= 10),
ch as (select query_id, count(*) as chunks, string_agg(chunk_id::varchar, ',' order by rk) as chunk_ids from r2 where s >= 0.3 group by 1)
select qs.query_id, (select count(*) from ix where kind = 'entity' and ix.query_id = qs.query_id) as entities, (select count(*) from ix where kind = 'relation' and ix.query_id = qs.query_id) as relations,
  (select count(*) from pe where pe.query_id = qs.query_id) + (select count(*) from pr where pr.query_id = qs.query_id) as paths, coalesce(chunks, 0) as chunks, coalesce(chunk_ids, '') as chunk_ids from qs left join ch on ch.query_id = qs.query_id"""
#: Of the query in ``composed``: even nations are seeds; their relevant paths' targets go behind the query.
I6 = f"""with {G.EDGES}, qs as (select n_nationkey::bigint as query_id, n_name as query from nation), hs as (select query_id, query as seed from qs where query_id % 2 = 0),
{hops_sql("hs", "hp", 2)}, fl as (select *, bool_or(contains(path, '-[PART_OF]->')) over (partition by query_id) as anyone from hp),
nm as (select query_id, target as name from fl where contains(path, '-[PART_OF]->') or not anyone union select query_id, seed from hs),
en as (select query_id as item_id, trim(query || ' ' || coalesce(array_to_string((select list(name order by name) from nm where nm.query_id = qs.query_id)[1:15], ' '), '')) as text from qs),
nt as (select s_suppkey as doc_id, 'NATION_' || s_nationkey || ' supplier s' || s_suppkey as text from supplier), {R.search_sql(20, source='nt', asked='en')}
select item_id as query_id, case when item_id % 2 = 0 then 'fallback_graph' else 'fallback_plain' end as path, md5(text) as query_md5, (select count(*) from bm where query_id = item_id) as chunks from en"""

SQL = {
    "i6_fallback": I6,
    "h8_enriched_hits": H8,
    "i1_index_search": f"with {SEARCHED} select query_id, kind, key as record, rank, round(score, 6) as score from ix",
    "i2_related": f"with {WALKED} select query_id, name from rl",
    "i4_navigated": I4,
}
