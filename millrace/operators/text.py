"""Markdown to sections, chunks and tables; cleaning, hashing and tokenising."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.types import StringType

from millrace.functions.splitter import splitter
from millrace.functions.words import parts
from millrace.params import DEFAULT, Params
from millrace.sources.scratch import stored

#: Markdown headings, and the form of article numbers.
HEADING = r"^(#{1,6})\s+(.+)$"
ARTICLE = "第[零一二三四五六七八九十百千万0-9]+条"


def sections(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, markdown). One row per section: doc_id, sec_no, level (0 before the first heading), heading,
    heading_path, text (its lines, without those of deeper sections). A preamble without text gives no row."""
    lines = docs.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("marks", F.regexp_extract("line", HEADING, 1)).withColumn("is_heading", F.length("marks") > 0)
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("sec_no", F.sum(F.col("is_heading").cast("int")).over(order).cast("int"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    secs = lines.groupBy("doc_id", "sec_no").agg(
        F.max(F.length("marks")).alias("level"),
        F.max(F.when(F.col("is_heading"), F.regexp_extract("line", HEADING, 2))).alias("heading"),
        whole.alias("text"),
    )
    seen = Window.partitionBy("doc_id").orderBy("sec_no").rowsBetween(Window.unboundedPreceding, 0)
    path = []
    for k in range(1, 7):
        at = F.max(F.when(F.col("level") == k, F.struct("sec_no", "heading"))).over(seen)
        shallower = F.coalesce(F.max(F.when(F.col("level").between(1, k - 1), F.col("sec_no"))).over(seen), F.lit(-1))
        path.append(F.when((k <= F.col("level")) & (at["sec_no"] > shallower), at["heading"]))
    out = secs.withColumn("heading_path", F.filter(F.array(*path), lambda x: x.isNotNull()))
    return out.filter((F.col("sec_no") > 0) | (F.trim("text") != "")).select("doc_id", "sec_no", "level", "heading", "heading_path", "text")


def chunks(docs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """docs: (doc_id, markdown). Pieces of sections with the heading path in front, chapter, article number, index and id."""
    return number(label(sections(docs).withColumn("pieces", splitter(params.chunk_size, params.chunk_overlap)(F.col("text")))))


def label(secs: DataFrame) -> DataFrame:
    """secs with ``pieces``: one row per piece, its text prefixed by the heading path, its chapter and article number."""
    found = lambda c: F.nullif(F.regexp_extract(c, f"({ARTICLE})", 1), F.lit(""))
    path = F.array_join("heading_path", " > ")
    rows = secs.select("*", F.posexplode("pieces").alias("piece_no", "piece"))
    return rows.select(
        "doc_id", "sec_no", "piece_no", path.alias("heading"),
        F.when(F.size("heading_path") > 0, F.concat(path, F.lit("\n"), F.col("piece"))).otherwise(F.col("piece")).alias("text"),
        F.when(F.size("heading_path") > 1, F.element_at("heading_path", 1)).alias("chapter"),
        F.coalesce(found(path), found(F.substring("text", 1, 128)), found(F.substring("piece", 1, 256))).alias("article_num"),
    )


def number(pieces: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("sec_no", "piece_no")
    rows = pieces.filter(F.trim("text") != "").withColumn("chunk_index", F.row_number().over(order) - 1)
    rows = rows.withColumn("chunk_id", F.format_string("%s_chunk_%04d", F.col("doc_id").cast("string"), F.col("chunk_index")))
    return rows.withColumn("chunk_hash", chunk_hash(F.col("text"), F.col("doc_id").cast("string")))


def chunk_hash(text: Column, doc_id: Column) -> Column:
    return F.substring(F.sha2(F.when(F.coalesce(doc_id, F.lit("")) == "", text).otherwise(F.concat(doc_id, F.lit("\x1f"), text)), 256), 1, 32)


def clean(text: Column, lower: bool = True) -> Column:
    """White space folded to single spaces and newlines, zero-width and odd-width spaces removed, lower case if asked for."""
    text = F.regexp_replace(text, "[ -‍﻿]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[^\S\n]+", " "), r"\n{2,}", "\n")
    return F.trim(F.lower(text) if lower else text)


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def tokens(text: Column, params: Params = DEFAULT) -> Column:
    """Lower-case words without stop words; repeats stay. With ``params.segment``, runs of letters of scripts without spaces are
    cut into words; else they are words themselves."""
    words = params.segment(parts(text)) if params.segment else F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"))
    return F.filter(words, lambda w: ~w.isin(list(params.stop_words)))


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters; a text of fewer than two is itself."""
    low = F.lower(text)
    chars = F.split(low, "")
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.when(F.length(low) < 2, F.array(low)).otherwise(F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(a, b)))


def markdown_tables(docs: DataFrame, keep_empty: bool = False) -> DataFrame:
    """docs: (doc_id, markdown). Tables: a line with a pipe, a rule line with ---, then lines with pipes. Gives doc_id, ord,
    headers, rows, num_rows, num_cols; empty cells vanish unless kept."""
    lines = docs.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("n", "line"))
    order = Window.partitionBy("doc_id").orderBy("n")
    piped = F.col("line").contains("|")
    rule = piped & F.col("line").contains("---")
    lines = lines.withColumn("starts", piped & ~rule & F.coalesce(F.lead(rule).over(order), F.lit(False)))
    lines = lines.withColumn("break", (F.col("starts") | ~piped).cast("int")).withColumn("run", F.sum("break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    cells = cells if keep_empty else F.filter(cells, lambda c: c != "")
    body = F.sort_array(F.collect_list(F.when(piped & ~rule, F.struct("n", cells.alias("cells")))))
    runs = lines.groupBy("doc_id", "run").agg(F.max("starts").alias("table"), F.min("n").alias("ord"), body.alias("body")).filter("table")
    headers, rows = F.col("body")[0]["cells"], F.transform(F.slice("body", F.lit(2), F.size("body")), lambda x: x["cells"])
    return runs.select("doc_id", "ord", headers.alias("headers"), rows.alias("rows"), F.size(rows).alias("num_rows"), F.size(headers).alias("num_cols"))


def html_table(markup: Column) -> Column:
    """struct(caption, headers, rows) of a table's markup; tags are stripped, entities are left for ``unescape``."""
    plain = lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))
    every = lambda c, tag: F.transform(F.regexp_extract_all(c, F.lit(f"(?is)<{tag}[^>]*>(.*?)</{tag}>")), plain)
    rows = F.transform(F.regexp_extract_all(markup, F.lit("(?is)<tr[^>]*>(.*?)</tr>")), lambda r: every(r, "td"))
    caption = F.nullif(plain(F.regexp_extract(markup, "(?is)<caption[^>]*>(.*?)</caption>", 1)), F.lit(""))
    return F.struct(caption.alias("caption"), every(markup, "th").alias("headers"), F.filter(rows, lambda r: F.size(r) > 0).alias("rows"))


def merge_tables(tables: DataFrame) -> DataFrame:
    """tables: (doc_id, ord, caption, headers, rows, num_cols). Neighbours of equal headers, width and caption become one."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    same = [F.col(c).eqNullSafe(F.lag(c).over(order)) for c in ("headers", "num_cols", "caption")]
    new = F.when(same[0] & same[1] & same[2] & (F.row_number().over(order) > 1), 0).otherwise(1)
    runs = tables.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "rows"))), lambda x: x["rows"]))
    return runs.groupBy("doc_id", "island").agg(F.min("ord").alias("ord"), F.first("caption").alias("caption"), F.first("headers").alias("headers"), rows.alias("rows"), F.first("num_cols").alias("num_cols")).withColumn("num_rows", F.size("rows")).drop("island")


def table_chunks(tables: DataFrame, most: int = DEFAULT.table_rows) -> DataFrame:
    """Parts of at most ``most`` rows, rendered with caption, header and rule."""
    parts = tables.select("*", F.posexplode(F.sequence(F.lit(0), F.greatest(F.size("rows") - 1, F.lit(0)), F.lit(most))).alias("part_index", "row_start"))
    line = lambda cells: F.array_join(cells, " | ")
    body = F.slice("rows", F.col("row_start") + 1, most)
    top = F.concat(F.lit("[Table] "), F.coalesce("caption", F.lit("")))
    rule = F.array_join(F.transform("headers", lambda h: F.lit("---")), " | ")
    text = F.concat_ws("\n", top, line(F.col("headers")), rule, F.array_join(F.transform(body, line), "\n"))
    return parts.select("doc_id", "ord", "part_index", "row_start", F.size(body).alias("num_rows"), "num_cols", text.alias("text"))


def merge_neighbours(rows: DataFrame, most: int = DEFAULT.chunk_size) -> DataFrame:
    """rows: (doc_id, ord, chunk_id, heading, text, type). A greedy fold along each document; see ``fold`` for the rule."""
    items = F.sort_array(F.collect_list(F.struct("ord", "chunk_id", "heading", "text", "type")))
    kind = "array<struct<chunk_id:string,heading:string,text:string,type:string,merged:array<string>>>"

    def fold(acc, x):
        last = F.element_at(acc, -1)
        table_text = last["type"].isin("table", "text") & x["type"].isin("table", "text") & (last["type"] != x["type"])
        blank = F.coalesce(x["heading"], F.lit("")) == ""
        joins = (F.size(acc) > 0) & (table_text | blank | (last["heading"] == x["heading"])) & (F.length(last["text"]) + F.length(x["text"]) <= most)
        one = F.struct(x["chunk_id"].alias("chunk_id"), x["heading"].alias("heading"), x["text"].alias("text"), x["type"].alias("type"), F.array(x["chunk_id"]).alias("merged"))
        both = F.struct(F.concat(last["chunk_id"], F.lit("+")).alias("chunk_id"), last["heading"].alias("heading"), F.concat(last["text"], F.lit("\n\n"), x["text"]).alias("text"), last["type"].alias("type"), F.concat(last["merged"], F.array(x["chunk_id"])).alias("merged"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(one)))

    folded = rows.groupBy("doc_id").agg(F.aggregate(items, F.array().cast(kind), fold).alias("m"))
    return folded.select("doc_id", F.posexplode("m").alias("ord", "x")).select("doc_id", "ord", "x.*")


def first_by_prefix(rows: DataFrame, order: list[str], chars: int = 500) -> DataFrame:
    """The first row of those whose texts begin with the same characters."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(F.md5(F.substring("text", 1, chars))).orderBy(*order))).filter("rn = 1").drop("rn")


def keywords(docs: DataFrame, most: int = 5, params: Params = DEFAULT) -> DataFrame:
    """(doc_id, tags): the words of the largest tf * idf of each document with 20 characters or more, ties by word."""
    docs = docs.filter(F.length(F.trim("text")) >= 20)
    tf = stored(docs.select("doc_id", F.explode(tokens(F.col("text"), params)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")), "term-counts")
    idf = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    scored = tf.join(idf, "term").crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 6))
    best = scored.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "term"))).filter(F.col("rn") <= most)
    return best.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "term"))), lambda x: x["term"]).alias("tags"))
