"""Legacy ARC archives, their conversion to WARC, and reading WARC back.

Archives are written with Spark's text sink and read with its binary file source, so they may live in any store that Spark
reaches. Every record is a gzip member of its own, as readers that seek expect; a row of the sink is a bundle of members of
about ``BUNDLE`` bytes, and a file holds at most ``per_file`` bundles behind its version block or warcinfo record, which bounds
what a task holds at once by bytes. (The sink ends a row with its line separator; that is the last byte of a member, which is
zero.) ARC header lines are read by the fields that the file's version block declares. Records that can't be read (a header that
does not match, a date that is none, a body that ends early) go to a table of errors, and reading goes on at the next header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window

from millrace.llm.scratch import materialize, new_path, tidied

#: The field lists of the two versions of the ARC format, and what a field may hold.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
HOLDS = {"URL": ".*?", "IP-address": "[0-9A-Fa-f.:]+|-", "Archive-date": r"\d{4,17}", "Content-type": ".*?", "Result-code": r"\d+|-", "Location": ".*?", "Archive-length": r"\d+"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SOFTWARE = "millrace"
FIRST_DATE = datetime(2004, 1, 1, tzinfo=timezone.utc)
MARK = "#page-id="
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BUNDLE = 1 << 20
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
RECORDS = "record_id string, page_id bigint, url string, date string, ip string, content_type string, http binary, packed binary, payload_sha256 string, row string, source string, error string"
READ = "record_id string, record_type string, page_id bigint, url string, date string, ip string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x) for x in row.values() if isinstance(x, bytes))
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


_LINE = pa.schema([("value", pa.binary())])


def member(record: bytes) -> bytes:
    """A gzip member that ends with a zero byte: its last is the highest of the record's size, and where that isn't zero an
    empty member follows."""
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def bundles(records: Iterable[bytes], head: Callable[[int], bytes], per_file: int, bundle: int) -> Iterator[dict]:
    """Rows of members without their last byte. Every per_file-th begins a file, with the record that ``head`` gives for it."""
    made, held = 0, bytearray()
    for record in records:
        if not held and made % per_file == 0:
            held += member(head(made))
        held += member(record)
        if len(held) >= bundle:
            yield {"value": bytes(held[:-1])}
            made, held = made + 1, bytearray()
    if held:
        yield {"value": bytes(held[:-1])}


def write_rows(df: DataFrame, path: str, per_file: int) -> None:
    df.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).option("compression", "none").text(path)


def arc_rows(per_file: int, bundle: int, version: int | None):
    """Rows of ARC files from (page_id, url, payload)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        v = version or 1 + part % 2

        def header(url: str, date: str, kind: str, length: int) -> bytes:
            middle = " 200 - - 0 -" if v == 2 else ""
            return f"{url} 0.0.0.0 {date} {kind}{middle} {length}\n".encode()

        def head(made: int) -> bytes:
            block = f"{v} 0 {SOFTWARE}\n{FIELDS[v]}\n".encode()
            return header(f"filedesc://part-{part}-{made}.arc", f"{FIRST_DATE:%Y%m%d%H%M%S}", "text/plain", len(block)) + block + b"\n"

        def records() -> Iterator[bytes]:
            for batch in batches:
                for key, url, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    target = re.sub(r"[\s\x00-\x20]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")
                    date = FIRST_DATE + timedelta(seconds=(key or 0) % (1 << 28))
                    body = HTTP + (payload or b"")
                    yield header(f"{target}{MARK}{'' if key is None else key}", f"{date:%Y%m%d%H%M%S}", "text/html", len(body)) + body + b"\n"

        yield from _batches(bundles(records(), head, per_file, bundle), _LINE)

    return run


def write_arc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", per_file: int = 32, version: int | None = None, bundle: int = BUNDLE) -> None:
    """Write (id, url, payload) rows as ARC files of version 1 or 2 (None: both in turn by partition)."""
    rows = df.select(F.col(id_col).cast("long"), F.col(url_col), F.col(payload_col).cast("binary").alias("payload"))
    write_rows(rows.mapInArrow(arc_rows(per_file, bundle, version), "value binary"), path, per_file)


MAGIC = b"\x1f\x8b\x08"


def unzipped(data: bytes, window: int = 1 << 14) -> Iterator[bytes]:
    """Contents of the members of a gzip file one after another, or a plain file as it is. A damaged member raises zlib.error."""
    for chunks, damage in streams(data, window):
        yield from chunks
        if damage:
            raise zlib.error(f"damaged member at byte {damage[0]}")


def streams(data: bytes, window: int = 1 << 14) -> Iterator[tuple[Iterator[bytes], list[int]]]:
    """Stretches of a file between damaged gzip members: contents, as in ``unzipped``, and a list that holds the byte of the
    damaged member behind them once they have been read. What such a member gave before its damage is the last of a stretch;
    the next begins at the first place from which a member can be unpacked again."""
    if data[:2] != MAGIC[:2]:
        yield iter([data]), []
        return
    view, at = memoryview(data), 0

    def members(damage: list[int]) -> Iterator[bytes]:
        nonlocal at
        while view[at : at + 2] == MAGIC[:2]:
            begin, part, out = at, zlib.decompressobj(31), []
            try:
                while not part.eof and at < len(view):
                    own = view[at : at + window]
                    out.append(part.decompress(own))
                    at += len(own) - len(part.unused_data)
            except zlib.error:
                damage.append(begin)
                yield b"".join(out)
                at = data.find(MAGIC, begin + 1)
                while at >= 0 and not sound(at):
                    at = data.find(MAGIC, at + 1)
                return
            yield b"".join(out)

    def sound(place: int) -> bool:
        try:
            return bool(zlib.decompressobj(31).decompress(view[place : place + window])) or place + window < len(view)
        except zlib.error:
            return False

    damage: list[int] = []
    yield members(damage), damage
    while damage and 0 <= at < len(view):
        damage = []
        yield members(damage), damage


class Reader:
    """Lines and blocks of a stream of chunks."""

    def __init__(self, chunks: Iterable[bytes]) -> None:
        self.chunks, self.held, self.at, self.before = iter(chunks), b"", 0, 0

    def place(self) -> int:
        return self.before + self.at

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.before += self.at
        self.held, self.at = self.held[self.at :] + chunk, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which is passed; the rest if there is no mark, None if there is nothing."""
        end = self.held.find(mark, self.at)
        while end < 0 and self.more():
            end = self.held.find(mark, self.at)
        if end < 0:
            return self.take(len(self.held) - self.at) or None
        out, self.at = self.held[self.at : end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self.more():
            pass
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out


def header_pattern(names: list[str]) -> re.Pattern:
    return re.compile(" ".join(f"({HOLDS.get(name, '[^ ]+')})" for name in names))


def full_date(digits: str) -> str:
    """WARC's form of a date of four to seventeen digits; what is missing is the first month, day or hour. Raises ValueError."""
    digits = (digits + "00000101000000"[len(digits) :])[:14]
    return f"{datetime.strptime(digits, '%Y%m%d%H%M%S'):%Y-%m-%dT%H:%M:%SZ}"


def parse_arc(data: bytes, name: str = "") -> Iterator[dict]:
    """Records of one ARC file: header lines by the fields that the latest version block declared, bodies by declared length.
    A record that can't be read gives a dictionary of source and error, and so does a damaged gzip member."""
    declared = [name, FIELDS[1].split()]
    for k, (chunks, damage) in enumerate(streams(data)):
        yield from (x | {"stretch": k} for x in parse_stretch(Reader(chunks), declared))
        if damage:
            yield {"source": f"{declared[0]}:{damage[0]}", "error": "damaged gzip member"}


def parse_stretch(reader: Reader, latest: list) -> Iterator[dict]:
    """Records of a stretch. latest: the archive's name and the fields that were declared last, which are set anew."""
    origin, names = latest
    pattern, lost = header_pattern(names), False
    while True:
        at = reader.place()
        line = reader.until(b"\n")
        if line is None:
            return
        text = line.decode("utf-8", "replace").rstrip("\r")
        if not text:
            continue
        source = f"{origin}:{at}"
        version_block = text.startswith("filedesc://")
        found = (header_pattern(FIELDS[2].split()).fullmatch(text) or header_pattern(FIELDS[1].split()).fullmatch(text)) if version_block else pattern.fullmatch(text)
        if not found:
            if not lost:  # what follows up to the next header belongs to it
                yield {"source": source, "error": f"no header: {text[:200]}"}
            lost = True
            continue
        lost, length = False, int(found[found.lastindex])
        body = reader.take(length)
        if len(body) < length:
            yield {"source": source, "error": f"{length} bytes declared, {len(body)} are there"}
        elif version_block:
            origin = text.split(" ")[0].removeprefix("filedesc://") or name
            first, *rest = body.decode("utf-8", "replace").split("\n")
            declared = rest[0].split() if rest and "URL" in rest[0] else FIELDS.get(int(first[:1]) if first[:1].isdigit() else 1, FIELDS[1]).split()
            names, pattern = declared, header_pattern(declared)
            latest[:] = origin, names
        else:
            fields = dict(zip(names, found.groups(), strict=True))
            try:
                yield fields | {"date": full_date(fields["Archive-date"]), "source": source, "place": at, "body": body}
            except ValueError:
                yield {"source": source, "error": f"no date: {fields['Archive-date']}"}


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """The header with the empty line behind it, and the payload; line ends may be of either kind."""
    ends = [at + len(mark) for mark in (b"\r\n\r\n", b"\n\n") if (at := body.find(mark)) >= 0]
    end = min(ends, default=len(body))
    return body[:end], body[end:]


def arc_records(with_payload: bool):
    """Rows of RECORDS; the payload is packed by zlib, or left out where only its digest is asked for. row is the place that no
    other record has, of file, stretch and byte."""
    names = [x.split() for x in RECORDS.split(", ")]
    kinds = pa.schema([(name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in names])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for x in parse_arc(content.as_py(), path.rsplit("/", 1)[-1]):
                        if "error" in x:
                            yield x
                            continue
                        http, payload = http_parts(x["body"]) if x["body"].startswith(b"HTTP/") else (b"", x["body"])
                        url, _, key = x["URL"].rpartition(MARK)
                        digest = hashlib.sha256(payload).hexdigest()
                        row = {"record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((x['source'], x['URL'], x['date'], digest)))}", "row": f"{path}:{x['stretch']}:{x['place']}", "page_id": int(key) if url and key.lstrip("-").isdigit() else None, "payload_sha256": digest}
                        if with_payload:
                            row |= {"url": url or x["URL"], "date": x["date"], "ip": x.get("IP-address"), "content_type": x.get("Content-type"), "http": http, "packed": zlib.compress(payload, 1)}
                        yield row

        yield from _batches(rows(), kinds)

    return run


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files of any name below a folder, gzipped or not."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def warc_rows(per_file: int, bundle: int):
    """Rows of WARC files from records with record_type and refers_to_record."""

    def record(kind: str, name: str, date: str, more: list[str], block: bytes) -> bytes:
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def head(made: int) -> bytes:
            info = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\nisPartOf: part-{part}\r\n".encode()
            return record("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'warcinfo {part} {made}')}", f"{FIRST_DATE:%Y-%m-%dT%H:%M:%SZ}", ["Content-Type: application/warc-fields"], info)

        def records() -> Iterator[bytes]:
            for batch in batches:
                for x in batch.to_pylist():
                    payload = zlib.decompress(x["packed"])
                    more = [f"WARC-Target-URI: {x['url']}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"X-Page-ID: {'' if x['page_id'] is None else x['page_id']}"]
                    if x["ip"] not in (None, "-", "0.0.0.0"):
                        more.append(f"WARC-IP-Address: {x['ip']}")
                    more.append("Content-Type: application/http;msgtype=response" if x["http"] else f"Content-Type: {x['content_type']}")
                    if x["record_type"] == "revisit":
                        more += [f"X-Payload-Length: {len(payload)}", f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{x['refers_to_record']}>", f"X-Refers-To-Page-ID: {'' if x['refers_to'] is None else x['refers_to']}"]
                    yield record(x["record_type"], x["record_id"], x["date"], more, x["http"] + (b"" if x["record_type"] == "revisit" else payload))

        yield from _batches(bundles(records(), head, per_file, bundle), _LINE)

    return run


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, per_file: int = 32, bundle: int = BUNDLE) -> DataFrame:
    """ARC files to WARC files; gives (source, error) of the records that can't be read, source being file and byte. Of records
    with equal payloads the one with the largest page id (then record id; null ids are smallest) becomes the response, the
    others revisit records that refer to it. The owner of a payload is found on digests alone and joined back by the record's
    unique id, so no payload shared by many pages gathers their bytes in one task. Record ids come from the archive's own name,
    the record's place in it and its content, and so are the same in every run and folder. An archive that is there twice gives
    records of their own; the second of equal ids is made from the first. A damaged gzip member is one error, and what follows
    it is read on. An archive is read as one row, so it must be smaller than 2 GB."""
    archives = files(spark, arc_path)
    digests = archives.mapInArrow(arc_records(False), RECORDS).select("row", "record_id", "page_id", "payload_sha256", "source", "error")
    digests = materialize(digests, "arc-digests")
    errors, digests = digests.filter("error is not null").select("source", "error"), digests.filter("error is null")
    copy = F.row_number().over(Window.partitionBy("record_id").orderBy("row"))
    again = F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.md5(F.concat("record_id", F.lit(" "), F.col("copy").cast("string"))), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))
    digests = materialize(digests.withColumn("copy", copy).withColumn("record_id", F.when(F.col("copy") > 1, again).otherwise(F.col("record_id"))), "arc-records")
    best = F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 62))).alias("order"), "record_id", "page_id"))
    shared = materialize(digests.groupBy("payload_sha256").agg(best.alias("best"), F.count("*").alias("n")).filter("n > 1").drop("n"), "arc-owners")
    revisits = digests.join(shared, "payload_sha256").filter("record_id != best.record_id").select("row", F.col("best.record_id").alias("refers_to_record"), F.col("best.page_id").alias("refers_to"))
    copies = digests.filter("copy > 1").select("row", F.col("record_id").alias("copy_id"))
    kind = F.when(F.col("refers_to_record").isNull(), "response").otherwise("revisit")
    records = archives.mapInArrow(arc_records(True), RECORDS).filter("error is null").drop("source", "error", "payload_sha256").join(revisits, "row", "left").withColumn("record_type", kind)
    if not copies.isEmpty():
        records = records.join(copies, "row", "left").withColumn("record_id", F.coalesce("copy_id", "record_id"))
    write_rows(records.mapInArrow(warc_rows(per_file, bundle), "value binary"), warc_path, per_file)
    return errors


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and blocks of one WARC file, by declared lengths."""
    reader = Reader(unzipped(data))
    while (head := reader.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record before byte {reader.place()}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields["content-length"])
        block = reader.take(length)
        if len(block) < length:
            raise ValueError(f"the WARC record before byte {reader.place()} declares {length} bytes, {len(block)} are there")
        yield fields, block


@tidied
def warc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split() for x in READ.split(", ")]
    kinds = pa.schema([(name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in names])

    def rows() -> Iterator[dict]:
        for batch in batches:
            for content in batch.column(1):
                for fields, block in parse_warc(content.as_py()):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    payload = http_parts(block)[1] if fields["content-type"].startswith("application/http") else block
                    revisit = fields["warc-type"] == "revisit"
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and sha1_base32(payload) != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    yield {
                        "record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"], "page_id": int(fields["x-page-id"]) if fields["x-page-id"] else None, "ip": fields.get("warc-ip-address"),
                        "url": fields["warc-target-uri"], "date": fields["warc-date"], "payload_bytes": int(fields["x-payload-length"]) if revisit else len(payload), "payload_digest": digest,
                        "refers_to": int(fields["x-refers-to-page-id"]) if fields.get("x-refers-to-page-id") else None, "payload": None if revisit else payload,
                    }

    yield from _batches(rows(), kinds)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).mapInArrow(warc_records, READ)


def through_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: one row per page with the READ columns.

    A null payload is empty, and all empty payloads are equal. A null url becomes about:blank. Rows that repeat an id are
    records of their own; of such copies one is the response. A null id comes back null. An empty table gives no rows. Other
    columns, whatever their names, are not read."""
    spark = df.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(df, arc, id_col, url_col, payload_col)
    convert_arc(spark, arc, warc)
    return read_warc(spark, warc)


def query(spark, sf_dir: str) -> DataFrame:
    read = through_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, coalesce(html, '') as h, max(page_id) over (partition by coalesce(html, '')) as best from pages),
     d as (select *, sha1(h) as hex from p)
select page_id, octet_length(encode(h)) as payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), 'string_agg', '') as payload_digest,
       case when page_id = best then 'response' else 'revisit' end as record_type,
       case when page_id = best then null else best end as refers_to
from d
"""
