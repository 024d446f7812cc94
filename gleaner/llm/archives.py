"""Legacy ARC archives: packing, conversion to WARC, and reading WARC files back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import ipaddress
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from gleaner.llm.common import pieces, with_row_id
from gleaner.operators.skew import annotate_by_key
from gleaner.session import LONG_ROWS, cut

#: The field names in the second line of an ARC file's own record, by version.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

#: Bytes of an ARC segment that :func:`pack` makes, and of a WARC file before it is compressed; a longer record stands alone.
SEGMENT_BYTES, FILE_BYTES = 4 << 20, 64 << 20

_DATE = re.compile(r"\d{8,17}")
_ID = re.compile(rb"(?im)^X-Page-Id: (-?\d+)\r?$")
#: What marks an entry that could not be read, in column ``kind``.
UNREAD = "unread"

RECORDS = pa.schema([
    ("segment", pa.int64()), ("number", pa.int64()),
    ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("kind", pa.string()),
    ("head", pa.binary()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("record_id", pa.string()),
    ("truncated", pa.bool_()),
])
READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
])


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _plain(url: str | None) -> str:
    """A URL that fits in a header line: blanks and control characters escaped, ``-`` for none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "") or "-"


def arc_segment(rows: list[tuple[int | None, str | None, str | None]], version: str, date: str, name: str) -> bytes:
    """An ARC file of ``(page_id, url, html)`` rows; each is kept as the HTTP response it came in."""
    def line(url: str, mime: str, body: bytes, offset: int) -> bytes:
        fields = [url, "0.0.0.0", date, mime]
        if version == "2":
            fields += ["200", digest(body), "-", str(offset), name]
        return (" ".join([*fields, str(len(body))]) + "\n").encode()

    about = f"{version} 0 gleaner\n{ARC_FIELDS[version]}\n".encode()
    out = bytearray(line(f"filedesc://{name}", "text/plain", about, 0) + about + b"\n")
    for page_id, url, html in rows:
        payload = (html or "").encode()
        key = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}Content-Length: {len(payload)}\r\n\r\n"
        body = head.encode() + payload
        out += line(_plain(url), "text/html", body, len(out)) + body + b"\n"
    return bytes(out)


def _is_address(token: str) -> bool:
    if token == "-":
        return True
    try:
        ipaddress.ip_address(token.partition("%")[0].strip("[]"))
    except ValueError:
        return False
    return True


def _declared(line: bytes, fields: Sequence[str]) -> int | None:
    """The length a header line declares: its last field, if it has as many fields as its version asks for."""
    tokens = line.split(b" ")
    return int(tokens[-1]) if len(tokens) >= len(fields) and tokens[-1].isdigit() else None


def arc_header(line: bytes, fields: Sequence[str]) -> tuple[str, str, str] | None:
    """URL, date and type of a header line; none if it does not follow the field list.

    Fields are read from the right: those behind the type are single words. A URL and a type may hold blanks, so the
    date is the last word of digits that an address stands before and a type behind.
    """
    names = [f.lower() for f in fields]
    kind = names.index("content-type")
    tokens = line.decode("utf-8", "replace").split(" ")
    inner = tokens[: len(tokens) - (len(names) - kind - 1)]
    for i in range(len(inner) - 2, 1, -1):
        if _DATE.fullmatch(inner[i]) and _is_address(inner[i - 1]):
            return " ".join(inner[: i - 1]), inner[i], " ".join(inner[i + 1 :])
    return None


def arc_records(data: bytes, segment: int = 0) -> Iterator[dict]:
    """The records of an ARC file, as the fields of WARC records (``RECORDS``).

    The file's own record names the version and the fields of a header line; without one, version 1 holds. A header line
    says how many bytes follow it, and these are never searched for headers. One that does not follow the fields, but
    declares a length, is passed over with its content; after one without a length nothing is certain, so all up to the
    next file record is passed over. Both give an entry of kind ``unread`` with the line. Content that ends before its
    declared length is kept and marked as truncated.
    """
    stream, fields, number = io.BytesIO(data), ARC_FIELDS["1"].split(), 0
    lost = False

    def entry(record: dict) -> dict:
        nonlocal number
        number += 1
        name = f"{segment}/{number} {record['url']} {record['date']} {record['payload_digest']}"
        return {**record, "segment": segment, "number": number, "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"}

    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if line.startswith(b"filedesc://"):
            length = line.rpartition(b" ")[2]
            body = stream.read(int(length)) if length.isdigit() else b""
            about = body.decode("utf-8", "replace").splitlines()
            named = ARC_FIELDS.get(about[0].split(" ")[0]) if about else None
            if len(about) > 1 and "content-type" in about[1].lower().split():
                named = about[1]
            fields, lost = (named or ARC_FIELDS["1"]).split(), False
            url, date = line.split(b" ")[0].decode("utf-8", "replace"), next((t for t in line.decode("utf-8", "replace").split(" ")[1:] if _DATE.fullmatch(t)), "")
            yield entry(warc_fields(url, date, "text/plain", body, not length.isdigit() or len(body) < int(length)))
            continue
        if lost or not line:
            continue
        length = _declared(line, fields)
        lost = length is None
        body = b"" if lost else stream.read(length)
        header = None if lost else arc_header(line, fields)
        if header:
            yield entry(warc_fields(*header, body, len(body) < length))
        else:
            yield entry({**warc_fields("", "", "", b"", False), "kind": UNREAD, "head": line})


def warc_fields(url: str, date: str, mime: str, body: bytes, truncated: bool) -> dict:
    """Timestamp, type and digest of the WARC record that stands for an ARC record."""
    head, payload, kind = b"", body, "resource"
    if url.startswith("filedesc://"):
        kind = "warcinfo"
    elif body.startswith(b"HTTP/"):
        end = body.find(b"\r\n\r\n")
        split = len(body) if end < 0 else end + 4
        head, payload, kind = body[:split], body[split:], "response"
    key = _ID.search(head)
    d = date.ljust(14, "0")
    return {
        "page_id": int(key.group(1)) if key else None, "url": url, "kind": kind,
        "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", "mime": mime, "head": head, "payload": payload,
        "payload_digest": digest(payload), "truncated": truncated,
    }


def pack(pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """``(arc binary)``: the pages in ARC segments of bounded size, of version 1 and 2 in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, part in enumerate(pieces(batches, "html", SEGMENT_BYTES)):
            rows = list(zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True))
            segment = arc_segment(rows, "12"[i % 2], date, f"segment-{i}.arc")
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.binary())], ["arc"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "arc binary")


def convert(archives: DataFrame) -> DataFrame:
    """The ARC files of column ``arc`` as WARC fields, one row per record (``RECORDS``).

    Record ids are made of the file's ``row`` and the record's number in it; files without a
    ``row`` are written with one first, so that the ids are the same whenever they are read.
    """
    numbered = archives if "row" in archives.columns else with_row_id(archives.select("arc"), "arc", **LONG_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, segment in zip(batch.column("row").to_pylist(), batch.column("arc"), strict=True):
                yield pa.RecordBatch.from_pylist(list(arc_records(segment.as_py() or b"", row)), schema=RECORDS)

    return numbered.select("row", "arc").mapInArrow(run, from_arrow_schema(RECORDS))


def mark_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``refers_to`` and ``refers_to_id``: the first of the records with an equal payload, null for the first itself.

    Payloads under ``least_bytes`` are never revisits. The first is the record with the smallest
    page_id; records that share it are all first, and a null id is first only if all are null.
    Verdicts are settled on digests alone, with the minimum taken before the shuffle, and go
    back to the records by segment and number, so no join meets a hot key.
    """
    eligible = (F.col("kind") == "response") & (F.octet_length("payload") >= least_bytes)
    narrow = cut(records.filter(eligible).select("segment", "number", "payload_digest", "page_id", "record_id"), "warc-digests")
    verdict = annotate_by_key(narrow, ["payload_digest"], ["segment", "number"], first=(F.min, F.struct(
        F.col("page_id").isNull().alias("none"), "page_id", "record_id")))
    later = verdict.filter(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    found = later.select("segment", "number", F.col("first.page_id").alias("refers_to"), F.col("first.record_id").alias("refers_to_id"))
    return records.join(cut(found, "warc-revisits"), ["segment", "number"], "left")


def warc_record(refers: str = "refers_to_id") -> Column:
    """A marked record as the bytes of a WARC record, without the blank lines that end it."""
    revisit = F.col(refers).isNotNull()
    is_http = F.col("kind") == "response"
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    lines = [
        ("WARC-Type: ", F.when(revisit, "revisit").otherwise(F.col("kind"))), ("WARC-Record-ID: ", F.col("record_id")),
        ("WARC-Date: ", F.col("date")), ("WARC-Target-URI: ", F.when(F.col("kind") != "warcinfo", F.col("url"))),
        ("WARC-Filename: ", F.when(F.col("kind") == "warcinfo", F.regexp_replace("url", "^filedesc://", ""))),
        ("WARC-Payload-Digest: sha1:", F.when(is_http, F.col("payload_digest"))),
        ("X-Payload-Length: ", F.when(is_http, F.octet_length("payload").cast("string"))),
        ("X-Page-Id: ", F.col("page_id").cast("string")),
        ("WARC-Profile: ", F.when(revisit, PROFILE)), ("WARC-Refers-To: ", F.col(refers)),
        ("X-Refers-To-Page: ", F.col("refers_to").cast("string")), ("WARC-Truncated: ", F.when(F.col("truncated"), "length")),
        ("Content-Type: ", F.when(is_http, "application/http; msgtype=response").otherwise(F.col("mime"))),
        ("Content-Length: ", F.octet_length(block).cast("string")),
    ]
    header = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(name), value) for name, value in lines])
    return F.concat(F.encode(header, "UTF-8"), F.lit(END.encode()), block)


def write_warc(marked: DataFrame, path: str, compression: str = "gzip", file_bytes: int = FILE_BYTES) -> None:
    """WARC files below ``path``, each of at most ``file_bytes`` before compression or one record.

    With gzip every record is a member of its own, so that it can be read from its offset alone.
    Entries that could not be read are left out. The text sink writes the bytes of a file as they are; the
    byte it adds at the end is one that readers of gzip pass over, or the blank lines after a record.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for cell in batch.column("record"):
                record = cell.as_py()
                if held and size + len(record) > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([between.join(held)], pa.binary())], ["file"])
                    held, size = [], 0
                held.append(gzip.compress(record + END.encode(), 6, mtime=0) if packs else record)
                size += len(record)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([between.join(held)], pa.binary())], ["file"])

    packs = compression == "gzip"
    between = b"" if packs else END.encode()
    files = marked.filter(F.col("kind") != UNREAD).select(warc_record().alias("record")).mapInArrow(run, "file binary")
    (
        files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\x00" if packs else END)
        .option("maxRecordsPerFile", 1).text(path)
    )


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, compressed or not: header fields in lower case, and ``block``."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        fields["block"] = stream.read(int(fields["content-length"]))
        yield fields


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of the WARC files below ``path``; a response's size and digest are taken anew."""
    def row(r: dict) -> dict:
        number = lambda k: int(r[k]) if k in r else None
        out = {"page_id": number("x-page-id"), "url": r.get("warc-target-uri"), "record_type": r["warc-type"],
               "refers_to": number("x-refers-to-page"), "record_id": r["warc-record-id"]}
        if r["warc-type"] == "response":
            payload = r["block"].partition(b"\r\n\r\n")[2]
            return {**out, "payload_bytes": len(payload), "payload_digest": digest(payload)}
        return {**out, "payload_bytes": number("x-payload-length"), "payload_digest": r["warc-payload-digest"].removeprefix("sha1:")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = [row(r) for r in parse_warc(content.as_py()) if r["warc-type"] in ("response", "revisit")]
                yield pa.RecordBatch.from_pylist(rows, schema=READ)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, from_arrow_schema(READ))


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Pages through ARC segments into WARC files at ``path``, and those read back.

    One record per row. A null html is an empty payload, a null page_id stays null, a null or
    empty url is ``-``; repeated rows are records of their own, with ids of their own. An empty
    table gives no rows.
    """
    write_warc(mark_revisits(convert(pack(pages)), least_bytes), path)
    return read_warc(pages.sparkSession, path)
