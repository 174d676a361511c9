"""Legacy ARC archives to WARC.

An ARC file opens with a version block whose last line names the fields of every later header line, so the parser
reads each record's fields by that line (version 1 has five, version 2 ten) and takes as many bytes as the header
declares. Each record becomes a WARC record with a record id derived from its content, a WARC-Date from the ARC
date, a type, and block and payload digests. Of equal payloads of at least ``min_bytes`` one is kept as a
response; the others become revisits that refer to it and carry no payload.

Files are written by Spark's own text writer (a record per row, its last newline being the separator), so they go
to any store that Spark knows, and are read back with the binaryFile source. ``records_per_file`` bounds what a
task holds at once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.store import scratch_dir

# Field names of ARC header lines, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:doclens:arc")
SMALL = 500_000  # rows of (page_id, digest, refers_to) that may be broadcast: about 60 MB


# -- ARC ---------------------------------------------------------------------------------------------------------


def arc_version_block(version: int, date: str) -> bytes:
    body = f"{version} 0 doclens\n{ARC_FIELDS[version]}\n".encode()
    values = {"URL": "filedesc://doclens.arc", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "doclens.arc"}
    head = " ".join(values.get(f, str(len(body))) for f in ARC_FIELDS[version].split())
    return head.encode() + b"\n" + body


def arc_record(version: int, url: str | None, date: str, block: bytes, ip: str = "0.0.0.0", mime: str = "text/html") -> bytes:
    values = {"URL": quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "-", "IP-address": ip, "Archive-date": date, "Content-type": mime, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "doclens.arc"}
    head = " ".join(values.get(f, str(len(block))) for f in ARC_FIELDS[version].split())
    return head.encode() + b"\n" + block


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record. A version block changes the fields from there on; a file without
    one is read as version 1. Blank lines between records are skipped. A header that doesn't fit its version or
    declares more bytes than there are raises ValueError: a damaged archive is never taken for a shorter one."""
    names, at = ARC_FIELDS[1].split(), 0
    while at < len(data):
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        line = data[at:stop].rstrip(b"\r")
        if not line:
            at = stop + 1
            continue
        values = line.decode("utf-8", "replace").split(" ")
        if values[0].startswith("filedesc:"):
            length = int(values[-1])
            block = data[stop + 1 : stop + 1 + length]
            lines = block.decode("utf-8", "replace").splitlines()
            if len(lines) < 2 or lines[0].split(" ")[0] not in ("1", "2"):
                raise ValueError(f"no ARC version block at byte {at}")
            names = lines[1].split()
        else:
            if len(values) != len(names):
                raise ValueError(f"ARC header at byte {at} has {len(values)} fields, its version {len(names)}")
            fields = dict(zip(names, values))
            length = int(fields["Archive-length"])
            block = data[stop + 1 : stop + 1 + length]
            if len(block) < length:
                raise ValueError(f"ARC record at byte {at} is cut off")
            yield fields, block
        at = stop + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header and payload of an HTTP response; a block without a header is all payload."""
    if block.startswith(b"HTTP/"):
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            return block[: end + 4], block[end + 4 :]
    return b"", block


def _named(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, sep, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")) if sep}


def _inflate(data: bytes) -> bytes:
    """Of all gzip members; other bytes as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out += [member.decompress(data), member.flush()]
        data = member.unused_data
    return b"".join([*out, data])


# -- WARC --------------------------------------------------------------------------------------------------------


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def sha1_hex(label: str) -> str:
    return base64.b32decode(label.partition(":")[2]).hex()


def warc_date(arc_date: str) -> str:
    """14 digits, or fewer with the rest taken as the earliest, as an ISO 8601 instant."""
    d = arc_date + "00000101000000"[len(arc_date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, page_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join((url, date, digest, page_id)))}>"


def warc_record(fields: dict[str, str], block: bytes, refers_to: int | None) -> bytes:
    """The WARC record of an ARC record; a revisit of page refers_to if that is not None."""
    head, payload = split_http(block)
    digest, page = sha1_label(payload), _named(head).get("x-page-id", "")
    date = warc_date(fields["Archive-date"])
    kind = "response" if refers_to is None else "revisit"
    kept = block if refers_to is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(fields['URL'], date, digest, page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {fields['URL']}",
        f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: {sha1_label(kept)}",
        f"WARC-Identified-Payload-Type: {fields['Content-type']}",
        f"X-Page-Id: {page}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(kept)}", "", ""]
    return "\r\n".join(lines).encode() + kept + b"\r\n\r\n"


def warcinfo(date: str) -> bytes:
    body = b"software: doclens\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, date)}>", f"WARC-Date: {warc_date(date)}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header (lower-cased names) and block of each record, by declared lengths; ValueError where they don't fit."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = _named(data[at:end])
        length = int(fields["content-length"])
        if end + 4 + length > len(data):
            raise ValueError(f"WARC record at byte {at} is cut off")
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length


# -- over Spark --------------------------------------------------------------------------------------------------


def _write(records: DataFrame, path: str, per_file: int) -> None:
    value = F.col("record").cast("string").alias("value")
    records.select(value).write.option("maxRecordsPerFile", per_file).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _emit(records: Iterator[bytes], opening: bytes, per_file: int):
    """Batches of records without their last newline, the opening before each file's records."""
    import pyarrow as pa

    rows: list[bytes] = []
    n = size = 0
    for record in records:
        for r in (opening, record) if n % per_file == 0 else (record,):
            rows.append(r)
            size += len(r)
            n += 1
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20240101000000", records_per_file: int = 4096) -> None:
    """An ARC record for every row of pages(page_id, url, html): a null html has an empty payload, a null url is
    written as "-", a null page_id as an empty X-Page-Id. Other columns are not read."""

    def run(batches):
        def records():
            for batch in batches:
                for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    payload = (html or "").encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(payload)}\r\n\r\n"
                    yield arc_record(version, url, date, head.encode() + payload)

        yield from _emit(records(), arc_version_block(version, date)[:-1], records_per_file)

    _write(pages.select("page_id", "url", "html").mapInArrow(run, "record binary"), path, records_per_file)


def read_arc(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, digest of each ARC record under path."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0):
                rows = []
                for _, block in parse_arc(_inflate(data.as_py())):
                    head, payload = split_http(block)
                    page = _named(head).get("x-page-id")
                    rows.append((int(page) if page else None, len(payload), hashlib.sha1(payload).digest()))
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["page_id", "payload_bytes", "digest"])

    return _files(spark, path).mapInArrow(run, "page_id bigint, payload_bytes bigint, digest binary")


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def revisits(records: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, digest, refers_to of every record that repeats a payload of min_bytes or more: all but those with
    the largest page_id of their payload. A row with a null page_id never is the largest; if there is no other, none
    is a revisit."""
    large = records.where(F.col("payload_bytes") >= min_bytes)
    firsts = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return large.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull()).select("page_id", "digest", "refers_to").distinct()


def convert(spark, arc_path: str, warc_path: str, min_bytes: int = 1000, records_per_file: int = 4096, date: str = "20240101000000") -> None:
    """Write a WARC record to warc_path for every ARC record under arc_path."""
    from doclens.llm.store import materialise

    again = materialise(revisits(read_arc(spark, arc_path), min_bytes), "revisits")

    def blocks(batches):
        import pyarrow as pa

        def out(rows):
            c = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], names=["page_id", "digest", "head", "block"])

        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for fields, block in parse_arc(_inflate(data.as_py())):
                    head, payload = split_http(block)
                    page = _named(head).get("x-page-id")
                    rows.append((int(page) if page else None, hashlib.sha1(payload).digest(), "\n".join(f"{k} {v}" for k, v in fields.items()).encode(), block))
                    size += len(block)
                    if size > 4_000_000:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    def records(batches):
        def each():
            for batch in batches:
                heads, kept, refers = (batch.column(i).to_pylist() for i in range(3))
                for head, block, page in zip(heads, kept, refers):
                    yield warc_record(dict(line.split(" ", 1) for line in head.decode().split("\n")), block, page)[:-1]

        yield from _emit(each(), warcinfo(date)[:-1], records_per_file)

    every = _files(spark, arc_path).mapInArrow(blocks, "page_id bigint, digest binary, head binary, block binary").alias("r")
    small = again.count() <= SMALL
    a = (F.broadcast(again) if small else again).alias("a")
    on = F.col("r.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("r.digest") == F.col("a.digest"))
    joined = every.join(a, on, "left").select("head", "block", "refers_to")
    _write(joined.mapInArrow(records, "record binary"), warc_path, records_per_file)


def read_warc(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each response and revisit under path. A
    response whose payload doesn't have its recorded digest raises ValueError."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0):
                rows = []
                for fields, block in parse_warc(_inflate(data.as_py())):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    digest = sha1_hex(fields["warc-payload-digest"])
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{fields['warc-record-id']}: the payload's digest differs")
                    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    rows.append((int(page) if page else None, int(_named(head)["content-length"]) if kind == "revisit" else len(payload), digest, kind, int(refers) if refers else None))
                c = list(zip(*rows)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _files(spark, path).mapInArrow(run, schema)


def pages_through_archives(pages: DataFrame, min_bytes: int = 1000, version: int = 1) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC files then hold: a row for every row of pages, also for repeated
    ones (two rows with the same page_id and payload are both responses). An empty table gives no rows."""
    spark = pages.sparkSession
    arc, warc = scratch_dir(spark, "arc"), scratch_dir(spark, "warc")
    write_arc(pages, arc, version)
    convert(spark, arc, warc, min_bytes)
    return read_warc(spark, warc)
