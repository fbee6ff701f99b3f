import pytest

from millrace.operators import evidence as E
from millrace.sources import collection as O


def made(spark, path, orphaned=False):
    docs = spark.createDataFrame([(i, f"n{i}") for i in range(20) if not (orphaned and i % 4 == 0)], "doc_id long, name string")
    chunks = spark.createDataFrame([(10 * i + k, i, f"c{i}-{k}", f"word{i} word{k}") for i in range(20) for k in range(3)], "chunk_id long, doc_id long, chunk_hash string, text string")
    vectors = spark.createDataFrame([(10 * i, i, [1.0]) for i in range(20)] + [(999, None, [0.0])], "chunk_id long, doc_id long, vector array<double>")
    rows = [(f"c{i}-{k}", "ENTITY", key, i % 5 > 0, None, None, None, None, None) for i in range(20) for k in range(3) for key in (f"k{k}", f"d{i}")]
    evidence = spark.createDataFrame(rows, "chunk_hash string, evidence_type string, entity_key string, active boolean, subject_key string, predicate string, object_key string, attr_key string, attr_value string")
    return O.create(path, docs, chunks, vectors, evidence, buckets=5)


def contents(at):
    rows = {name: sorted((tuple(r) for r in at.read(name).collect()), key=str) for name in at.schemas}
    return rows | {"index": sorted(r.chunk_id for r in at.index().chunks().collect()), "df": sorted((r.term, r.df) for r in at.index().terms().collect())}


def test_documents_go_with_all_that_hangs_on_them(spark, tmp_path):
    at = made(spark, str(tmp_path / "a"))
    gone = spark.createDataFrame([(3,), (5,), (7,), (7,), (500,), (None,)], "doc_id int")
    after, keys = O.delete_documents(at, gone)
    got = contents(O.open_collection(spark, str(tmp_path / "a")))
    assert got == contents(after)
    left = [i for i in range(20) if i not in (3, 5, 7)]
    assert [r[0] for r in got["documents"]] == sorted(left, key=lambda i: str((i, f"n{i}"))) and got["index"] == sorted(10 * i + k for i in left for k in range(3))
    assert {r[1] for r in got["vectors"]} == {*left, None} and {r[1] for r in got["chunks"]} == {*left}
    assert {tuple(r) for r in keys.collect()} == {("ENTITY", k) for k in ("k0", "k1", "k2", "d3", "d7")}  # evidence of 5 was inactive
    assert got["support"] == sorted((tuple(r) for r in E.support(after.read("evidence")).collect()), key=str)
    assert len(got["evidence"]) == 120 and dict(got["df"])["word8"] == 3 and "word7" not in dict(got["df"])
    again, none = O.delete_documents(after, gone)
    assert contents(again) == got and none.count() == 0


def test_a_job_that_dies_between_tables_changes_nothing(spark, tmp_path, monkeypatch):
    at = made(spark, str(tmp_path / "a"))
    before = contents(at)
    gone = spark.createDataFrame([(1,), (2,)], "doc_id long")
    whole = O._write
    for dies_at in ("documents", "chunks", "vectors", "evidence", "support"):
        def write(at, name, *more, dies_at=dies_at):
            if name == dies_at:
                raise RuntimeError("lost")
            return whole(at, name, *more)

        monkeypatch.setattr(O, "_write", write)
        with pytest.raises(RuntimeError):
            O.delete_documents(at, gone)
        assert contents(O.open_collection(spark, str(tmp_path / "a"))) == before
    monkeypatch.setattr(O, "_write", whole)
    after, _ = O.delete_documents(O.open_collection(spark, str(tmp_path / "a")), gone)
    assert {r[1] for r in contents(after)["chunks"]} == {i for i in range(20) if i not in (1, 2)}


def test_orphans_go(spark, tmp_path):
    after, keys = O.delete_orphans(made(spark, str(tmp_path / "a"), orphaned=True))
    got, left = contents(after), {i for i in range(20) if i % 4}
    assert {r[1] for r in got["chunks"]} == {r[1] for r in got["vectors"]} == left and got["index"] == sorted(10 * i + k for i in left for k in range(3))
    assert {r.affected_key for r in keys.collect()} == {"k0", "k1", "k2"} | {f"d{i}" for i in range(20) if i % 4 == 0 and i % 5}
    assert got["support"] == sorted((tuple(r) for r in E.support(after.read("evidence")).collect()), key=str)
    with pytest.raises(ValueError):
        O.open_collection(spark, str(tmp_path / "none"))
