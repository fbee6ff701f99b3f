"""Queries of the text operators. Documents have no headings, so every fifth line is made one, alike in Spark and SQL."""

from dataclasses import replace

import pyspark.sql.functions as F

from millrace.functions import words as W
from millrace.functions.encoding import repair
from millrace.functions.splitter import splitter
from millrace.operators import text as T
from millrace.params import DEFAULT
from millrace.sources.scratch import spread


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def markdown(spark, sf_dir):
    made = F.transform(F.split("text", "\n"), lambda line, i: F.when(i % 5 == 2, F.concat(F.repeat(F.lit("#"), (F.floor(i / 5) % 3 + 1).cast("int")), F.lit(" "), F.substring(line, 1, 20))).otherwise(line))
    return documents(spark, sf_dir).select("doc_id", F.array_join(made, "\n").alias("markdown"))


LINES = r"""
l as (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'n': i - 1, 'x': case when (i - 1) % 5 = 2 then repeat('#', (((i - 1) // 5) % 3 + 1)::int) || ' ' || left(x, 20) else x end})) as s from documents),
h as (select doc_id, s.n as n, s.x as line, length(regexp_extract(s.x, '^(#{1,6})\s+(.+)$', 1)) as lv, regexp_extract(s.x, '^(#{1,6})\s+(.+)$', 2) as head from l),
g as (select *, (sum((lv > 0)::int) over (partition by doc_id order by n))::int as sec_no from h),
s0 as (select doc_id, sec_no, max(lv)::int as level, max(case when lv > 0 then head end) as heading, coalesce(string_agg(case when lv = 0 then line end, chr(10) order by n), '') as text from g group by 1, 2),
s1 as (select *, max(case when level = 1 then sec_no end) over w as a1, max(case when level = 2 then sec_no end) over w as a2, max(case when level = 3 then sec_no end) over w as a3 from s0 window w as (partition by doc_id order by sec_no)),
secs as (select s1.doc_id, s1.sec_no, s1.level, s1.heading, s1.text,
  list_filter([case when s1.level >= 1 then x.heading end, case when s1.level >= 2 and a2 > coalesce(a1, -1) then y.heading end, case when s1.level >= 3 and a3 > greatest(coalesce(a1, -1), coalesce(a2, -1)) then z.heading end], lambda v: v is not null) as heading_path
  from s1 left join s0 x on x.doc_id = s1.doc_id and x.sec_no = a1 left join s0 y on y.doc_id = s1.doc_id and y.sec_no = a2 left join s0 z on z.doc_id = s1.doc_id and z.sec_no = a3
  where s1.sec_no > 0 or trim(s1.text, ' ') <> '')
"""
STOP = ", ".join(f"'{w}'" for w in DEFAULT.stop_words)
TOKENS = rf"list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda w: w not in ({STOP}))"


def b1_sections(spark, sf_dir):
    return T.sections(markdown(spark, sf_dir)).select("doc_id", "sec_no", "level", "heading", F.array_join("heading_path", " > ").alias("path"), F.md5("text").alias("text_md5"))


def b2_split(spark, sf_dir):
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(splitter()(F.col("text"))).alias("piece_no", "piece"))
    return pieces.select("doc_id", "piece_no", F.length("piece").alias("chars"), F.md5("piece").alias("piece_md5"))


def b3_prefixed(spark, sf_dir):
    rows = T.label(T.sections(markdown(spark, sf_dir)).withColumn("pieces", F.array("text")))
    return rows.select("doc_id", "sec_no", F.md5("text").alias("text_md5"))


def b4_chapters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    made = docs.select("doc_id", F.concat(F.lit("# Part "), F.col("source"), F.lit("\n## 第"), F.col("doc_id"), F.lit("条\n"), F.col("text"), F.lit("\n# End\n第七条 x")).alias("markdown"))
    rows = T.label(T.sections(made).withColumn("pieces", F.array("text")))
    return rows.select("doc_id", "sec_no", "heading", "chapter", "article_num")


def b5_chunk_ids(spark, sf_dir):
    rows = T.number(T.label(T.sections(markdown(spark, sf_dir)).withColumn("pieces", F.array("text"))))
    return rows.select("doc_id", "chunk_index", "chunk_id", F.concat_ws("_", F.col("doc_id"), F.format_string("%04d", "chunk_index"), F.substring("chunk_hash", 1, 8)).alias("api_id"))


def thousand(name, key):
    return F.concat_ws("-", name, F.floor(F.col(key) / 1000))


def part_tables(spark, sf_dir):
    """Markdown with one table for each brand and thousand of part keys, so that tables stay small however many parts there are."""
    row = F.concat(F.lit("| "), F.col("p_partkey"), F.lit(" | "), F.col("p_name"), F.lit(" |  | "), F.col("p_size"), F.lit(" |"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"]), "\n")
    head = F.lit("intro\n| key | name | none | size |\n| --- | --- | --- | --- |\n")
    return table(spark, sf_dir, "part").groupBy(thousand("p_brand", "p_partkey").alias("doc_id")).agg(F.concat(head, rows, F.lit("\nafter it")).alias("markdown"))


def b6_markdown_tables(spark, sf_dir):
    found = T.markdown_tables(part_tables(spark, sf_dir))
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";")
    return found.select("doc_id", "ord", F.array_join("headers", "|").alias("headers"), "num_rows", "num_cols", F.md5(cells).alias("cells_md5"))


def b7_html_tables(spark, sf_dir):
    row = F.concat(F.lit("<tr><td>"), F.col("s_suppkey"), F.lit("</td><td> <b>"), F.col("s_name"), F.lit("</b> &amp; co</td></tr>"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]), "")
    made = table(spark, sf_dir, "supplier").groupBy(thousand("s_nationkey", "s_suppkey").alias("doc_id")).agg(F.concat(F.lit("<table><caption>Nation</caption><tr><th>Key</th><th>Name</th></tr>"), rows, F.lit("</table>")).alias("html"))
    t = made.select("doc_id", T.html_table(F.col("html")).alias("t"))
    return t.select("doc_id", F.col("t.caption").alias("caption"), F.array_join("t.headers", "|").alias("headers"), F.size("t.rows").alias("num_rows"), T.unescape(F.array_join(F.transform("t.rows", lambda r: F.array_join(r, "|")), ";")).alias("cells"))


def order_tables(spark, sf_dir):
    """A table for every order and line status, in order of the status."""
    items = table(spark, sf_dir, "lineitem")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.array(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    made = items.groupBy("l_orderkey", "l_linestatus", "l_returnflag").agg(rows.alias("rows"))
    return made.select(
        F.col("l_orderkey").alias("doc_id"), F.concat("l_linestatus", "l_returnflag").alias("ord"), F.col("l_linestatus").alias("caption"),
        F.array(F.lit("line"), F.lit("part")).alias("headers"), "rows", F.lit(2).alias("num_cols"),
    )


def b8_merged_tables(spark, sf_dir):
    merged = T.merge_tables(order_tables(spark, sf_dir))
    return merged.select("doc_id", "ord", "caption", "num_rows", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("cells"))


def b9_table_chunks(spark, sf_dir):
    rows = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: F.array(x["p_partkey"].cast("string"), x["p_name"]))
    made = table(spark, sf_dir, "part").groupBy(thousand("p_brand", "p_partkey").alias("doc_id")).agg(rows.alias("rows")).select("doc_id", F.lit(0).alias("ord"), F.col("doc_id").alias("caption"), F.array(F.lit("key"), F.lit("name")).alias("headers"), "rows", F.lit(2).alias("num_cols"))
    return T.table_chunks(made).select("doc_id", "part_index", "row_start", "num_rows", F.md5("text").alias("text_md5"))


def b10_filled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.concat_ws("/", F.lit(""), "lang", "source").alias("folder"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(F.length(F.trim("line")) > 0).groupBy("doc_id", "folder").agg(F.count("*").alias("chunks"))


def b11_clean(spark, sf_dir):
    """Every third text was read as Latin-1 before, every ninth twice, and comes back as it was."""
    misread = lambda text: F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    damaged = F.when(F.col("doc_id") % 9 == 0, misread(misread(F.col("text")))).when(F.col("doc_id") % 3 == 0, misread(F.col("text"))).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", repair(damaged).alias("text"))
    cleaned = T.clean(F.concat(F.lit("  ​X\t y\n\n\n"), T.nfc(F.col("text")), F.lit("﻿ \n")))
    return docs.select("doc_id", F.md5(cleaned).alias("clean_md5"), F.length(cleaned).alias("chars"))


def b12_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.chunk_hash(F.col("text"), F.col("doc_id").cast("string")).alias("chunk_hash"), T.chunk_hash(F.col("text"), F.lit("")).alias("doc_hash"))


def b13_merge(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    rows = talk.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), F.when(F.col("turn") % 3 == 0, F.col("role")).alias("heading"), "text", F.when(F.col("role") == "user", "text").otherwise("table").alias("type"))
    return T.merge_neighbours(rows).select("doc_id", "ord", "chunk_id", F.array_join("merged", ",").alias("merged"), F.length("text").alias("chars"))


def b14_dedup(spark, sf_dir):
    return T.first_by_prefix(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id")


def b15_tokens(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("t", T.tokens(F.col("text")))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"), F.size(T.bigrams(F.col("text"))).alias("n_bigrams"))


def b15_segmented(spark, sf_dir):
    """The documents in a script without spaces: a letter of theirs is a sign, and what stands between words is left out. The
    dictionary is learned from all of them."""
    signs = "".join(chr(0x4E00 + 37 * i) for i in range(26))
    text = F.regexp_replace(F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", signs), r"[^\p{L}\p{N}\n]+", "")
    docs = documents(spark, sf_dir).select("doc_id", text.alias("text"))
    params = replace(DEFAULT, segment=W.segmenter(W.learned(docs, 20)))
    words = docs.select("doc_id", T.tokens(F.col("text"), params).alias("t"))
    return words.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def b16_tags(spark, sf_dir):
    return T.keywords(documents(spark, sf_dir)).select("doc_id", F.array_join("tags", ",").alias("tags"))


QUERIES = {f.__name__: f for f in (b1_sections, b2_split, b3_prefixed, b4_chapters, b5_chunk_ids, b6_markdown_tables, b7_html_tables, b8_merged_tables, b9_table_chunks, b10_filled, b11_clean, b12_hashes, b13_merge, b14_dedup, b15_tokens, b15_segmented, b16_tags)}

SQL = {
    "b1_sections": f"with {LINES} select doc_id, sec_no, level, heading, array_to_string(heading_path, ' > ') as path, md5(text) as text_md5 from secs",
    "b3_prefixed": f"with {LINES} select doc_id, sec_no, md5(case when len(heading_path) > 0 then array_to_string(heading_path, ' > ') || chr(10) || text else text end) as text_md5 from secs",
    "b4_chapters": "select doc_id, 1 as sec_no, 'Part ' || source as heading, null::varchar as chapter, null::varchar as article_num from documents union all select doc_id, 2, 'Part ' || source || ' > 第' || doc_id || '条', 'Part ' || source, '第' || doc_id || '条' from documents union all select doc_id, 3, 'End', null, '第七条' from documents",
    "b5_chunk_ids": f"with {LINES}, p as (select *, case when len(heading_path) > 0 then array_to_string(heading_path, ' > ') || chr(10) || text else text end as t from secs), q as (select *, row_number() over (partition by doc_id order by sec_no) - 1 as i from p where trim(t, ' ') <> '') select doc_id, i::int as chunk_index, doc_id || '_chunk_' || printf('%04d', i) as chunk_id, doc_id || '_' || printf('%04d', i) || '_' || left(sha256(doc_id || chr(31) || t), 8) as api_id from q",
    "b6_markdown_tables": "select p_brand || '-' || p_partkey // 1000 as doc_id, 1 as ord, 'key|name|none|size' as headers, count(*)::int as num_rows, 4 as num_cols, md5(string_agg(p_partkey || '|' || p_name || '|' || p_size, ';' order by p_partkey)) as cells_md5 from part group by 1",
    "b7_html_tables": "select s_nationkey || '-' || s_suppkey // 1000 as doc_id, 'Nation' as caption, 'Key|Name' as headers, count(*)::int as num_rows, string_agg(s_suppkey || '|' || s_name || ' & co', ';' order by s_suppkey) as cells from supplier group by 1",
    "b8_merged_tables": "select l_orderkey as doc_id, min(l_linestatus || l_returnflag) as ord, l_linestatus as caption, count(*)::int as num_rows, string_agg(l_linenumber || ',' || l_partkey, ';' order by l_returnflag, l_linenumber, l_partkey) as cells from lineitem group by l_orderkey, l_linestatus",
    "b9_table_chunks": "with r as (select p_brand || '-' || p_partkey // 1000 as d, p_partkey, p_name, row_number() over (partition by p_brand, p_partkey // 1000 order by p_partkey) - 1 as i from part) select d as doc_id, (i // 30)::int as part_index, ((i // 30) * 30)::int as row_start, count(*)::int as num_rows, md5('[Table] ' || d || chr(10) || 'key | name' || chr(10) || '--- | ---' || chr(10) || string_agg(p_partkey || ' | ' || p_name, chr(10) order by i)) as text_md5 from r group by d, i // 30",
    "b10_filled": "select doc_id, '/' || lang || '/' || source as folder, count(*) as chunks from (select doc_id, lang, source, unnest(string_split(text, chr(10))) as line from documents) where length(trim(line, ' ')) > 0 group by all",
    "b11_clean": r"with c as (select doc_id, trim(lower(regexp_replace(regexp_replace(regexp_replace('  ' || chr(8203) || 'X' || chr(9) || ' y' || chr(10) || chr(10) || chr(10) || nfc_normalize(text) || chr(65279) || ' ' || chr(10), '[\x{2000}-\x{200d}\x{feff}]', '', 'g'), '[ \t\r\f\v]+', ' ', 'g'), '\n{2,}', chr(10), 'g')), ' ') as c from documents) select doc_id, md5(c) as clean_md5, length(c)::int as chars from c",
    "b12_hashes": "select doc_id, left(sha256(doc_id || chr(31) || text), 32) as chunk_hash, left(sha256(text), 32) as doc_hash from documents",
    "b13_merge": """with recursive r as (select conv_id as doc_id, row_number() over (partition by conv_id order by turn) as n, conv_id || '_' || turn as chunk_id, case when turn % 3 = 0 then role end as heading, length(text) as len, case when role = 'user' then 'text' else 'table' end as type from conversations),
g as (select doc_id, n, 0 as ord, chunk_id, heading, len, type, chunk_id as merged from r where n = 1 union all
  select doc_id, n, case when j then o else o + 1 end, case when j then c || '+' else chunk_id end, case when j then h else heading end, case when j then l + 2 + len else len end, case when j then t else type end, case when j then m || ',' || chunk_id else chunk_id end
  from (select r.*, g.ord as o, g.chunk_id as c, g.heading as h, g.len as l, g.type as t, g.merged as m, coalesce((g.type <> r.type or coalesce(r.heading, '') = '' or g.heading = r.heading) and g.len + r.len <= 512, false) as j from g join r on r.doc_id = g.doc_id and r.n = g.n + 1))
select doc_id, ord::int as ord, chunk_id, merged, len::int as chars from g qualify row_number() over (partition by doc_id, ord order by n desc) = 1""",
    "b14_dedup": "select min(doc_id) as doc_id from documents group by left(text, 500)",
    "b15_tokens": f"with t as (select doc_id, text, {TOKENS} as t from documents) select doc_id, len(t)::int as n_tokens, md5(array_to_string(t, ' ')) as tokens_md5, greatest(length(text) - 1, 1)::int as n_bigrams from t",
    "b16_tags": f"with d as (select doc_id, text from documents where length(trim(text, ' ')) >= 20), t as (select doc_id, term, count(*) as tf from (select doc_id, unnest({TOKENS}) as term from d) group by all), i as (select term, count(*) as df from t group by 1), s as (select doc_id, term, round(tf * ln((select count(*) from d) / df), 6) as score from t join i using (term)), r as (select *, row_number() over (partition by doc_id order by score desc, term) as rn from s) select doc_id, string_agg(term, ',' order by rn) as tags from r where rn <= 5 group by 1",
}
