import json

import pyspark.sql.functions as F
import pytest

from millrace.operators import evaluate as L
from millrace.operators import lexical
from millrace.operators import post as P
from millrace.operators import tabular as K
from millrace.operators import usage as M
from millrace.sources import io as A
from millrace.streaming import jobs


def test_sources(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "one.two.md").write_text("# T\nbody")
    assert [tuple(r) for r in A.read_corpus(spark, str(tmp_path / "c")).collect()] == [("one.two", "# T\nbody")]
    files = spark.createDataFrame([("a.PDF",), ("b",), ("c.exe",), (".md",)], "filename string")
    assert {r.filename for r in A.accepted(files).collect()} == {"a.PDF", ".md"}
    (tmp_path / "s.json").write_text(json.dumps([{"id": "007", "query": "q"}]))
    old = A.read_samples(spark, str(tmp_path / "s.json"))
    assert [r.id for r in A.import_samples(old, old).orderBy("id").collect()] == ["007", "008"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "b.json").write_text(json.dumps({"summary": {"total": 3}}))
    row = A.read_reports(spark, str(tmp_path / "r")).first()
    assert (row.total, row.mrr, row.ndcg_at_5) == (3, 0.0, None)
    A.write_samples(old.unionByName(old), str(tmp_path / "w"), 1)
    assert [r.id for r in A.read_samples(spark, str(tmp_path / "w")).collect()] == ["007", "007"]
    many = spark.createDataFrame([("", f"q{i:03d}") for i in range(300)], "id string, query string").repartition(7)
    numbered = A.import_samples(spark.createDataFrame([("900", "z")], "id string, query string"), many).filter("query <> 'z'").collect()
    assert {r.query: r.id for r in numbered} == {f"q{i:03d}": f"{901 + i}" for i in range(300)}
    for where in ("x/deep", "b", "a"):
        spark.range(len(where)).write.parquet(str(tmp_path / "tables" / where / "t.parquet"))
    assert A.load_tables(spark, str(tmp_path / "tables"), ["t"])["t"].count() == 1
    with pytest.raises(FileNotFoundError):
        A.load_tables(spark, str(tmp_path / "tables"), ["u"])


def test_guarded_sql(spark):
    spark.range(5).createOrReplaceTempView("t5")
    assert K.run_guarded(spark, "```sql\nselect * from t5;\n```", 3).count() == 3
    for bad in ("", "drop table t5", "select 1; delete from t5", "show tables"):
        with pytest.raises(K.UnsafeQuery):
            K.checked(bad)
    out, log = K.run_first(spark, ["select x from t5", "select id from t5"])
    assert out.count() == 5 and [x[1] for x in log] == ["AnalysisException", "ok"]
    assert K.clean_headers(["", "a b", "3x", "nan", "a b"]) == ["列0", "a_b", "col_2", "列3", "a_b_4"]


def test_candidates_that_fail_while_they_run_or_never_end(spark):
    import time

    spark.range(1000).createOrReplaceTempView("t1000")
    endless = "select count(*) from range(2000000000) a, t1000 b where a.id * b.id = -1"
    began = time.time()
    with pytest.raises(K.DeadlineExceeded):
        K.run_guarded(spark, endless, seconds=2)
    assert time.time() - began < 20
    out, log = K.run_first(spark, ["select id / (id - id) as x from t1000", endless, "select cast('x' as int) from t1000", "select max(id) as m from t1000"], seconds=2)
    assert [x[1] for x in log][1::2] == ["DeadlineExceeded", "ok"] and log[0][1] != "ok" and log[2][1] != "ok" and out.first().m == 999
    assert K.run_first(spark, ["select nothing"])[0] is None and spark.range(10).count() == 10


def test_profile_types(spark):
    df = spark.createDataFrame([("1", "x", None, "1.5"), ("2", "y", None, "2"), (None, "x", None, "3")], "a string, b string, c string, d string")
    got = {r.column: (r.data_type, r.mean, r.enum and list(r.enum)) for r in K.profile(df).collect()}
    assert got["a"][:2] == ("INTEGER", 1.5) and got["b"] == ("TEXT", None, ["x", "y"]) and got["c"][0] == "TEXT" and got["d"][0] == "REAL"


def test_packing_a_context(spark):
    hits = spark.createDataFrame([(1, 1, "a" * 50), (1, 2, "b" * 50), (2, 1, "c" * 500)], "query_id long, rank int, text string")
    rows = {r.query_id: r for r in P.pack_context(hits, 100).collect()}
    assert rows[1].context == "[1]\n" + "a" * 50 and rows[2].context == ("[1]\n" + "c" * 500)[:100]
    assert P.pack_context(hits.filter("query_id = 1"), 200).first().context.count("---") == 1


def test_metrics(spark):
    row = spark.range(1).select(
        L.recall(F.array(*map(F.lit, [1, 2, 3])), F.array(*map(F.lit, [3, 9])), 3).alias("r"), L.precision(F.array(*map(F.lit, [1, 3])), F.array(F.lit(3)), 5).alias("p"),
        L.ndcg(F.array(*map(F.lit, [1, 3])), F.array(F.lit(3)), 5).alias("n"), L.reciprocal_rank(F.array(*map(F.lit, [1, 3])), F.array(F.lit(3))).alias("m"), L.recall(F.array(F.lit(1)), F.array().cast("array<int>"), 3).alias("none"),
    ).first()
    assert (row.r, row.p, round(row.n, 6), row.m, row.none) == (0.5, 0.5, 0.63093, 0.5, None)


def test_cache_and_tasks(spark):
    e = spark.createDataFrame([("a", "1", 0.0, None), ("a", "2", 5.0, 10.0), ("b", "x", 0.0, 0.0), ("c", "y", 0.0, -1.0)], "key string, value string, created_at double, ttl double")
    assert {(r.key, r.value) for r in M.latest(e, F.lit(12.0)).collect()} == {("a", "2"), ("c", "y")}
    assert {r.key for r in M.latest(e, F.lit(20.0)).collect()} == {"c"}
    t = spark.createDataFrame([(i, "PENDING", i % 3, i) for i in range(6)], "task_id long, status string, retry_count int, created_at long")
    got = {r.task_id: (r.status, r.retry_count) for r in M.drain(t, F.col("task_id") != 0, 4).collect()}
    assert got == {0: ("SUCCESS", 0), 1: ("PENDING", 2), 2: ("FAILED", 3), 3: ("PENDING", 1), 4: ("PENDING", 1), 5: ("PENDING", 2)}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("ENTITY", "a", 1), ("ENTITY", "a", 1), ("FACT", "f", 1), ("FACT", "f", -1)], "affected_type string, affected_key string, delta int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.support(stream).writeStream.outputMode("update").foreachBatch(jobs.sync_batches(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out/v=0")).collect()] == [("ENTITY", "a", 2)]
    write = jobs.sync_batches(str(tmp_path / "out"))
    counts = lambda *rows: spark.createDataFrame(rows, "affected_type string, affected_key string, support_count long, operation string")
    write(counts(("FACT", "g", 3, "UPSERT")), 5)  # after batches that wrote nothing
    write(counts(("FACT", "g", 4, "UPSERT"), ("ENTITY", "a", 0, "DELETE")), 7)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out/v=5")).collect()} == {("ENTITY", "a", 2), ("FACT", "g", 3)}
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out/v=7")).collect()] == [("FACT", "g", 4)]
    (tmp_path / "out/v=8").mkdir()
    (tmp_path / "out/v=8/part-0.parquet").write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017  an unreadable version is no empty one
        write(counts(("FACT", "g", 5, "UPSERT")), 9)


def test_a_chunk_is_ingested_once(spark, tmp_path):
    docs = spark.createDataFrame([("d", "# A\nx"), ("e", "# A\nx")], "doc_id string, markdown string")
    write = jobs.ingest_batches(str(tmp_path / "chunks"))
    write(docs, 0)
    write(docs.unionByName(docs.withColumn("markdown", F.lit("# B\ny"))), 1)
    write(docs, 0)  # run again
    rows = spark.read.parquet(str(tmp_path / "chunks"))
    assert rows.count() == rows.select("chunk_hash").distinct().count() == 4 and rows.filter("batch = 0").count() == 2


def test_a_batch_touches_its_own_buckets(spark, tmp_path):
    write, table = jobs.sync_keys(str(tmp_path), 16), jobs.support_table(spark, str(tmp_path), 16)
    counts = lambda rows: spark.createDataFrame(rows, "affected_type string, affected_key string, support_count long, operation string")
    write(counts([("E", f"k{i}", i, "UPSERT") for i in range(200)]), 0)
    before = table.state()
    for k in range(1, 6):
        write(counts([("E", f"k{k}", 1000 + k, "UPSERT"), ("F", "new", k, "UPSERT"), ("E", "k100", 0, "DELETE")]), k)
        if k == 3:
            write(counts([("E", "k3", 1003, "UPSERT"), ("F", "new", 3, "UPSERT"), ("E", "k100", 0, "DELETE")]), 3)  # run again
    got = {(r.affected_type, r.affected_key): r.support_count for r in table.read().collect()}
    want = {("E", f"k{i}"): i for i in range(1, 200) if i != 100} | {("E", f"k{k}"): 1000 + k for k in range(1, 6)} | {("F", "new"): 5}
    assert got == want
    assert all(sum(1 for b in (tmp_path / f"data/v={k}").iterdir() if b.name.startswith("bucket=")) <= 3 for k in range(1, 6)) and len(before) == 16
    (tmp_path / "manifests/v=5/_SUCCESS").unlink()  # that batch's job ended before its manifest was whole
    assert {(r.affected_type, r.affected_key): r.support_count for r in table.read().collect()} == want | {("F", "new"): 4, ("E", "k5"): 5}
    write(counts([("E", "k5", 1005, "UPSERT"), ("F", "new", 5, "UPSERT")]), 5)
    table.vacuum()
    assert {(r.affected_type, r.affected_key): r.support_count for r in table.read().collect()} == want and table.versions() == [4, 5]


def test_stream_takes_a_chunk_in_once(spark, tmp_path):
    rows = [("d", "# A\nx"), ("e", "# A\nx"), ("f", "# A\nx\n# B\ny")]
    want, seen = set(), 0
    for k in range(5):
        part = [rows[k % 3], rows[(k + 1) % 3], (f"g{k}", "# Z\nz"), (None, None)]
        spark.createDataFrame(part, "doc_id string, markdown string").write.parquet(str(tmp_path / f"in/part={k}"))
        chunks = jobs.ingest(spark.readStream.schema("doc_id string, markdown string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), str(tmp_path / "out"))
        want |= {r.chunk_hash for r in jobs.T.chunks(spark.createDataFrame(part, "doc_id string, markdown string")).collect()}
        got = [r.chunk_hash for r in spark.read.parquet(chunks).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(got) > seen
        seen = len(got)


def test_sheets(spark):
    cells = spark.createDataFrame([(1, i, [None, None] if i % 2 else [str(i), None]) for i in range(20)] + [(2, 0, [None])], "sheet_id int, row_no int, cells array<string>")
    assert [(r.sheet_id, [list(c) for c in r.sample]) for r in K.sample_rows(cells, 3).collect()] == [(1, [["0", None], ["2", None], ["4", None]])]
    sheets = spark.createDataFrame([("a", 2, 1), ("a", 1, 3), ("b", 1, 2)], "doc_id string, sheet_index int, created_at int")
    ids = spark.createDataFrame([("a",), ("a",)], "doc_id string")
    assert [(r.sheet_index, r.place) for r in K.list_sheets(sheets, ids).orderBy("place").collect()] == [(1, 1), (2, 2)]
    assert [r.created_at for r in K.list_sheets(sheets).collect()] == [3, 2, 1]
    left, gone = K.delete_sheets(sheets, ids)
    assert [r.doc_id for r in left.collect()] == ["b"] and [tuple(r) for r in gone.collect()] == [("a", 2)]


def test_evidence_batches(spark):
    schema = "evidence_id string, entity_key string, evidence_text string, confidence double, extractor_version string, active boolean, created_at timestamp, updated_at timestamp"
    old = spark.createDataFrame([("1", "k", "t", 0.9, "v", False, None, None), ("2", "k", "t", 0.9, "v", False, None, None)], schema)
    new = spark.createDataFrame([("2", "n", None), ("3", None, 0.7), ("3", None, 0.7)], "evidence_id string, entity_key string, confidence double")
    got = {r.evidence_id: tuple(r)[1:6] for r in A.upsert_evidence(old, new, F.current_timestamp()).collect()}
    assert got == {"1": ("k", "t", 0.9, "v", False), "2": ("n", "", 0.5, "", True), "3": (None, "", 0.7, "", True)}


def test_sql_report_without_samples(spark):
    kind = "query_type string, recalled_sheet_ids array<string>, true_sheet_ids array<string>, selected_sheet_id string, true_sheet_id string, predicted_sql string, true_sql string, predicted_result struct<columns:array<string>,rows:array<array<string>>>, true_result struct<columns:array<string>,rows:array<array<string>>>, processing_time_ms double, sql_error boolean"
    row = ("sql_query", ["a", "b"], ["b"], "b", "b", "select 1", "SELECT  1", None, (["x"], [["1"]]), 4.0, True)
    out = L.sql_report(spark.createDataFrame([row, ("other", *row[1:])], kind)).first()
    assert (out.sql_num_samples, out.sql_error_count, out.sheet_recall_at_1, out.sheet_recall_at_3, out.table_selection_accuracy, out.sql_correctness, out.execution_accuracy, out.sql_timing_p95_ms) == (1, 1, 0.0, 1.0, 1.0, 1.0, 0.0, 4.0)
    assert L.sql_report(spark.createDataFrame([], kind)).count() == 0


def test_snapshot_is_written_and_read_back(spark, tmp_path, monkeypatch):
    from millrace.plans.library import a8_snapshot

    spark.createDataFrame([(1, "some words"), (2, "more words")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in a8_snapshot(spark, str(tmp_path)).collect()] == [("one more", "chunks differ")]
    load, read = lexical.load_index, []

    def emptied(spark, path):
        index = load(spark, path)
        read.append(path)
        index.postings = index.postings.limit(0)
        return index

    monkeypatch.setattr(lexical, "load_index", emptied)
    assert sorted(r.reason for r in a8_snapshot(spark, str(tmp_path)).collect()) == ["chunks differ", "empty", "empty"] and read


def test_kept_folders_follow_their_table(spark, tmp_path):
    from millrace.sources.scratch import children, kept_folder, spread

    made, path = [], str(tmp_path / "t.parquet")

    def make(folder):
        made.append(folder)

    spark.range(3).write.parquet(path)
    first = kept_folder(spark.read.parquet(path), "kept", make)
    assert kept_folder(spark.read.parquet(path), "kept", make) == first and len(made) == 1
    spark.range(4).write.mode("overwrite").parquet(path)
    assert kept_folder(spark.read.parquet(path), "kept", make) != first and len(made) == 2
    assert children(spark, str(tmp_path / "no such folder")) == [] and "_SUCCESS" in children(spark, path)
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == 8 and spread(spark.range(100).repartition(40)).rdd.getNumPartitions() == 40
