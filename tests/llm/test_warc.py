import base64
import gzip
import hashlib

from millrace.llm import warc as W
from millrace.llm.scratch import new_path


def records(data):
    return [x for x in W.parse_arc(data) if "error" not in x], [x["error"] for x in W.parse_arc(data) if "error" in x]


V1 = b"1 0 own\nURL IP-address Archive-date Content-type Archive-length\n"
V2 = b"2 0 own\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"


def test_arc_versions_and_lengths():
    v1 = b"filedesc://a.arc 0.0.0.0 20040101000000 text/plain %d\n%s\nhttp://a/ 1.2.3.4 20040102030405 text/html 9\nab\n\ncd\nef\n\n" % (len(V1), V1)
    [r], errors = records(v1)
    assert r["body"] == b"ab\n\ncd\nef" and r["URL"] == "http://a/" and r["Archive-length"] == "9" and not errors and r["date"] == "2004-01-02T03:04:05Z"
    v2 = b"filedesc://b.arc 0.0.0.0 20040101000000 text/plain 200 - - 0 b.arc %d\n%s\nhttp://b/ 1.2.3.4 20040102030405 text/html 404 - - 12 b.arc 3\nxyz" % (len(V2), V2)
    [r], errors = records(gzip.compress(v2[:40]) + gzip.compress(v2[40:]))
    assert r["body"] == b"xyz" and r["Result-code"] == "404" and not errors and r["source"].startswith("b.arc:")
    assert records(v2[:-1]) == ([], ["3 bytes declared, 2 are there"])


def test_headers_of_real_archives():
    head = b"filedesc://a.arc 0.0.0.0 20040101000000 text/plain %d\n%s\n" % (len(V1), V1)
    body = [
        (b"http://a/x y z 1.2.3.4 20040102030405 text/html; charset=utf-8 2\nab\n", ("http://a/x y z", "text/html; charset=utf-8", "2004-01-02T03:04:05Z", b"ab")),
        (b"http://b/ 2001:db8::1 20040102 no-type 0\n\n", ("http://b/", "no-type", "2004-01-02T00:00:00Z", b"")),
        (b"http://c/ - 200401020304 a b c 1\nq\n", ("http://c/", "a b c", "2004-01-02T03:04:00Z", b"q")),
        (b"not a header at all\nwith more lines\n", None),
        (b"http://d/ 1.2.3.4 20041399000000 text/html 1\nq\n", None),
        (b"http://e/ 1.2.3.4 2004 text/html 4\r\nlast\n", ("http://e/", "text/html", "2004-01-01T00:00:00Z", b"last")),
    ]
    found, errors = records(head + b"".join(x for x, _ in body))
    assert [(r["URL"], r["Content-type"], r["date"], r["body"]) for r in found] == [x for _, x in body if x]
    assert errors == ["no header: not a header at all", "no date: 20041399000000"]


def test_members_end_with_zero_and_bundles_are_whole():
    for record in (b"", b"x", b"y" * (1 << 24), b"z" * ((1 << 24) - 1)):
        m = W.member(record)
        assert m[-1] == 0 and b"".join(W.unzipped(m)) == record
    rows = [x["value"] + b"\0" for x in W.bundles([bytes([i]) * 50 for i in range(20)], lambda made: b"head", 2, 100)]
    assert b"".join(b"".join(W.unzipped(x)) for x in rows).replace(b"head", b"") == b"".join(bytes([i]) * 50 for i in range(20))
    assert [b"".join(W.unzipped(x)).startswith(b"head") for x in rows] == [i % 2 == 0 for i in range(len(rows))] and len(rows) > 3


def test_round_trip(spark):
    pages = [(i, f"http://h/{i} a", f"<p>{i % 4}</p>\r\n\r\nWARC/1.1\r\n") for i in range(30)] + [(40, None, None), (41, "", ""), (42, "u", "é中\x00" + "z" * 200_000), (5, "again", "<p>1</p>\r\n\r\nWARC/1.1\r\n"), (None, "n", "only")]
    df = spark.createDataFrame([(k, u, h, "v") for k, u, h in pages], "page_id long, url string, html string, value string").repartition(3)
    rows = W.through_archives(df).collect()
    text = lambda h: (h or "").encode()
    owner = {text(h): max((k for k, _, x in pages if text(x) == text(h) and k is not None), default=None) for _, _, h in pages}
    want = sorted((str(k), len(text(h)), base64.b32encode(hashlib.sha1(text(h)).digest()).decode()) for k, _, h in pages)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in rows) == want
    for r in rows:
        payload = next(text(h) for k, _, h in pages if k == r.page_id)
        assert r.record_type == ("response" if owner[payload] == r.page_id else "revisit") and r.refers_to == (None if r.record_type == "response" else owner[payload])
        assert r.record_type == "revisit" or bytes(r.payload) == payload
    assert len({r.record_id for r in rows}) == len(rows)
    assert W.through_archives(df.limit(0)).count() == 0


def test_files_are_bounded_by_bytes_and_ids_do_not_depend_on_the_folder(spark):
    df = spark.range(200).selectExpr("id as page_id", "'u' as url", "repeat(sha2(cast(id as string), 512), 4) as html").coalesce(1)
    ids = []
    for version in (1, 2, 1):
        arc, out = new_path(spark, "a"), new_path(spark, "w")
        W.write_arc(df, arc, per_file=4, version=version, bundle=4000)
        assert W.convert_arc(spark, arc, out, per_file=4, bundle=4000).count() == 0
        assert W.files(spark, arc).count() >= 3 and W.files(spark, arc).selectExpr("max(length(content))").first()[0] < 4 * 5000
        rows = W.read_warc(spark, out).collect()
        assert sorted(r.page_id for r in rows) == list(range(200))
        ids.append(sorted(r.record_id for r in rows))
        first = W.files(spark, out).first().content
        members = list(W.unzipped(first))
        assert members[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and all(m.startswith(b"WARC/1.1\r\nWARC-Type: response") and m.endswith(b"\r\n\r\n") for m in members[1:])
    assert ids[0] == ids[2] != ids[1]


def test_foreign_archives(spark, tmp_path):
    head = b"filedesc://a.arc 0.0.0.0 20040101000000 text/plain %d\n%s\n" % (len(V1), V1)
    page = b"HTTP/1.0 200 OK\nServer: x\n\nbody"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "one.arc").write_bytes(head + b"http://a/ 1.2.3.4 20040102030405 text/html %d\n%s\nbroken\nhttp://b/ 0.0.0.0 20050102030405 text/plain 4\nsame\n" % (len(page), page))
    (tmp_path / "arc" / "two.arc.gz").write_bytes(gzip.compress(head.replace(b"a.arc", b"b.arc")) + gzip.compress(b"http://c/ 5.6.7.8 20060102030405 text/plain 4\nsame\n"))
    errors = W.convert_arc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    assert [r.error for r in errors.collect()] == ["no header: broken"]
    rows = {r.url: r for r in W.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert bytes(rows["http://a/"].payload) == b"body" and rows["http://a/"].ip == "1.2.3.4" and rows["http://b/"].ip is None
    assert sorted(rows[u].record_type for u in ("http://b/", "http://c/")) == ["response", "revisit"] and {r.page_id for r in rows.values()} == {None}


def test_copies_of_an_archive_are_records_of_their_own(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i // 2}</p>") for i in range(4)], "page_id long, url string, html string").coalesce(1)
    for copy in ("a", "b"):
        (tmp_path / "arc" / copy).mkdir(parents=True)
    W.write_arc(pages, str(tmp_path / "made"), version=1)
    [made] = [x for x in (tmp_path / "made").iterdir() if x.name.startswith("part")]
    for copy in ("a", "b"):
        (tmp_path / "arc" / copy / "same.arc.gz").write_bytes(made.read_bytes())
    assert W.convert_arc(spark, str(tmp_path / "arc"), str(tmp_path / "warc")).count() == 0
    rows = W.read_warc(spark, str(tmp_path / "warc")).collect()
    assert len(rows) == len({r.record_id for r in rows}) == 8
    assert sorted(bytes(r.payload) for r in rows if r.record_type == "response") == [b"<p>0</p>", b"<p>1</p>"]
    assert sorted((r.page_id, r.refers_to) for r in rows if r.record_type == "revisit") == [(0, 1), (0, 1), (1, 1), (2, 3), (2, 3), (3, 3)]


def test_a_damaged_member_is_one_error(spark, tmp_path):
    head = b"filedesc://a.arc 0.0.0.0 20040101000000 text/plain %d\n%s\n" % (len(V1), V1)
    member = lambda i: gzip.compress(b"http://h/%d 1.2.3.4 20040102030405 text/plain 400\n%s\n" % (i, bytes(97 + (i * k) % 26 for k in range(400))))
    broken = bytearray(member(2))
    broken[20:40] = b"\xff" * 20
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc.gz").write_bytes(gzip.compress(head) + member(0) + member(1) + bytes(broken) + member(3) + member(4)[:-30])
    errors = W.convert_arc(spark, str(tmp_path / "arc"), str(tmp_path / "warc")).collect()
    at = len(gzip.compress(head) + member(0) + member(1))
    assert ("a.arc:%d" % at, "damaged gzip member") in [tuple(e) for e in errors]
    assert sorted(r.url for r in W.read_warc(spark, str(tmp_path / "warc")).collect()) == ["http://h/0", "http://h/1", "http://h/3"]
