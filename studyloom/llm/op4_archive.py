"""Legacy ARC archives converted to WARC.

An ARC file is a version block and then records, each one header line and as
many bytes as that line declares.  Version 1 lines have five fields, version
2 lines ten; the version block says which.  The converter takes records by
their declared length alone, so a payload may hold anything, and makes WARC
records of them: an identifier from the record's own bytes, a date with the
separators that WARC wants, a type, and SHA-1 digests in base32.

What has an HTTP header is a response; anything else (a dns: record, say) is a
resource under its own content type, and is never revisited.  Of responses
with equal payloads of at least `least_bytes` bytes the one with
the smallest key stays one and the others are revisits that refer to
it and keep the HTTP header but no payload.  Keys are ordered as their type
orders them; of equal keys the record's identifier decides, which its place
in the archive makes its own.  The least key by digest is a
partial aggregation and the join back handles a digest that a third of all
records share.

Archives are written and read by Spark, so any store that Spark reaches will
do: a record is a row of text whose line end is the record's own, and files
are compressed.  A file has as many records as make `file_bytes` on average,
which bounds what a task holds of an archive.

Null html is an empty payload; a null key stays null and counts as smallest;
keys of any type that casts to and from text keep their type.  A null or odd
url is percent-encoded, null as "-".  Repeated rows make a record each, one
of them the response.  Very long pages are single records.  Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, fresh_path, removed, written

ARC_SCHEMA = "version int, url string, ip string, stamp string, mime string, status string, block binary, place string"
WARC_SCHEMA = "headers map<string,string>, http binary, payload binary"

#: The version blocks of ARC 1 and 2, and the names of their header fields.
_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


def arc_version_block(version: int, name: str = "pages.arc", stamp: str = "20080101000000") -> bytes:
    body = f"{version} 0 Studyloom\n{_FIELDS[version]}\n".encode()
    tail = f" - - 0 {name}" if version == 2 else ""
    head = f"filedesc://{name} 0.0.0.0 {stamp} text/plain" + (f" 200{tail}" if version == 2 else "")
    return f"{head} {len(body)}\n".encode() + body + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple]:
    """(version, url, ip, stamp, mime, status, block, byte where it starts) of each record after the version block.

    A header line that does not have its version's number of fields, or a
    declared length beyond the end of the file, is an error: guessing where
    the next record starts would invent records.
    """
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n" and version:
            at += 1  # records are separated by line ends that no length declares
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        fields = line.split(" ")
        if end < 0 or not fields[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}: {line[:80]!r}")
        body = data[end + 1 : end + 1 + int(fields[-1])]
        if len(body) != int(fields[-1]):
            raise ValueError(f"the record at byte {at} declares {fields[-1]} bytes and has {len(body)}")
        start, at = at, end + 1 + len(body)
        if not version:
            if not line.startswith("filedesc:"):
                raise ValueError("an ARC file starts with a filedesc: block")
            version = int(body.split(b" ", 1)[0])
            continue
        want = len(_FIELDS[version].split())
        if len(fields) != want:
            raise ValueError(f"an ARC {version} header has {want} fields, not {len(fields)}: {line[:80]!r}")
        status = fields[4] if version == 2 else None
        yield version, fields[0], fields[1], fields[2], fields[3], status, body, start


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, HTTP header bytes, payload bytes) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}: {data[at : at + 40]!r}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        start = end + 4
        size = int(headers["content-length"])
        block = data[start : start + size]
        if len(block) != size or data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} does not end where it declares")
        at = start + size + 4
        http, payload = split_http(block)
        yield headers, http, payload


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with its blank line, and the body; a block without one is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def warc_date(stamp: str) -> str:
    """An ARC date with the separators that WARC wants.

    A short one is filled up to its first moment; of one that is no date the
    year is kept, and without a year it is the year 1.
    """
    digits = re.match(r"[0-9]*", stamp)[0][:14]
    for own in (digits, digits[:4]):
        whole = own + "00010101000000"[len(own) :]
        try:
            return datetime.strptime(whole, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
        except ValueError:
            continue
    return "0001-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_FILE = re.compile(r"part-(\d+)-.*-c(\d+)\.")


def _read(spark: SparkSession, path: str, parse: str, names: list[str], schema: str) -> DataFrame:
    """The records of all archive files below a path, one file at a time in a task."""
    parser = {"arc": parse_arc, "warc": parse_warc}[parse]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                # part and number of the file; the rest of its name is another in every run
                known = _FILE.match(name.rpartition("/")[2])
                file = "-".join(known.groups()) if known else name
                data = cell.as_buffer().to_pybytes()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                for row in parser(data):
                    if parse == "arc":
                        row = (*row[:-1], f"{file}-{row[-1]}")
                    rows.append(row)
                    size += sum(len(x) for x in row if isinstance(x, bytes)) + 500
                    if size > 4 << 20:
                        yield _batch(rows, names, parse)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names, parse)

    return spark.read.format("binaryFile").load(path).select("content", "path").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], parse: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    if parse == "arc":
        kinds = [pa.int32(), *[pa.string()] * 5, pa.binary(), pa.string()]
    else:
        columns[0] = [list(h.items()) for h in columns[0]]
        kinds = [pa.map_(pa.string(), pa.string()), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "arc", [x.split()[0] for x in ARC_SCHEMA.split(", ")], ARC_SCHEMA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "warc", ["headers", "http", "payload"], WARC_SCHEMA)


def _records_in_file(total: int, count: int, file_bytes: int) -> int:
    """How many records of the mean size make a file; tasks start a new file after so many."""
    return max(1, int(file_bytes * count / max(1, total)))


def _write(records: DataFrame, path: str, end: str, many: int) -> None:
    """A row's text and its line end as a record, in compressed files of `many` records at most, without a shuffle."""
    records.select("value").write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", many).text(path)


def percent_encoded(url: Column) -> Column:
    """A url with its blanks and control characters as %00 to %20 and %7F."""
    out = url
    for code in (*range(0x21), 0x7F):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), out).otherwise(url)


def write_arc(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 2, file_bytes: int = 16 << 20) -> None:
    """Pages as ARC files: each a version block and the HTTP responses, with the page's key, after a sign and encoded, as a header field.

    The version block is part of each file's first record, so that Spark's
    text writer makes whole archives.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    url = percent_encoded(F.coalesce(F.nullif(F.col(url_col), F.lit("")), F.lit("-")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Key: "), F.coalesce(F.url_encode(F.concat(F.lit("="), F.col(key_col).cast("string"))), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(html), F.lit("\r\n\r\n"), html)
    tail = F.lit(" 200 - - 0 pages.arc" if version == 2 else "")
    head = F.concat(url, F.lit(" 0.0.0.0 20080101000000 text/html"), tail, F.lit(" "), F.octet_length(http).cast("string"), F.lit("\n"))
    whole = pages.agg(F.sum(F.octet_length(html) + 300).alias("bytes"), F.count("*").alias("n")).first()
    many = _records_in_file(whole["bytes"] or 0, whole["n"], file_bytes)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in the task, which fills one file after the other
    block = F.lit(arc_version_block(version).decode())
    value = F.concat(F.when(place % many == 0, block).otherwise(F.lit("")), head, http)
    _write(pages.select(value.alias("value")), path, "\n", many)


def converted(records: DataFrame, key_field: str = "X-Key") -> DataFrame:
    """ARC records as the parts of WARC records: key, url, ip, date, http, payload, size, digest, block digest and id."""
    field = re.compile(rb"\r\n" + key_field.encode() + rb":[ \t]*([^\r\n]*)", re.I)
    names = ["key", "url", "ip", "date", "mime", "http", "payload", "payload_bytes", "payload_digest", "record_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                http, payload = split_http(r["block"])
                found = field.search(http)
                date = warc_date(r["stamp"])
                own = hashlib.sha256(b"\0".join([r["place"].encode(), r["url"].encode(), date.encode(), http, payload])).hexdigest()
                name = f"urn:uuid:{own[:8]}-{own[8:12]}-5{own[13:16]}-{'89ab'[int(own[16], 16) % 4]}{own[17:20]}-{own[20:32]}"
                rows.append((found[1].decode() if found else None, r["url"], r["ip"], date, r["mime"], http, payload, len(payload), digest(payload), name))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.string()] * 5 + [pa.binary()] * 2 + [pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return records.mapInArrow(run, "key string, url string, ip string, date string, mime string, http binary, payload binary, payload_bytes long, payload_digest string, record_id string")


def key_of(field: Column, kind: str) -> Column:
    """The key that write_arc() made a field of; null for an empty one."""
    return F.when(field != "", F.substring(F.url_decode(field), 2, 1 << 30)).try_cast(kind)


def write_warc(parts: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = 16 << 20, key_kind: str = "long") -> None:
    """Parts (as from converted(), written) as WARC files, with revisits for payloads seen under a smaller key."""
    key = key_of(F.col("key"), key_kind)
    ranked = parts.withColumn("rank", F.struct(key.isNotNull().alias("some"), key.alias("key"), F.col("record_id")))
    served, large = F.length("http") > 0, F.col("payload_bytes") >= least_bytes
    first = ranked.where(served & large).groupBy("payload_digest").agg(F.min_by(F.struct("record_id", "url", "date"), "rank").alias("first"))
    met = ranked.join(first, "payload_digest", "left")
    again = F.coalesce(served & large & (F.col("first.record_id") != F.col("record_id")), F.lit(False))
    block = F.when(again, F.col("http").cast("string")).otherwise(F.concat(F.col("http").cast("string"), F.col("payload").cast("string")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").when(served, "response").otherwise("resource")),
        F.concat(F.lit("WARC-Record-ID: <"), "record_id", F.lit(">")),
        F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Target-URI: "), "url"),
        F.concat(F.lit("WARC-IP-Address: "), "ip"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <"), F.col("first.record_id"), F.lit(">"))),
        F.when(again, F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("first.url"))),
        F.when(again, F.concat(F.lit("WARC-Refers-To-Date: "), F.col("first.date"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(served, "Content-Type: application/http; msgtype=response").otherwise(F.concat(F.lit("Content-Type: "), F.coalesce("mime", F.lit("application/octet-stream")))),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    rows = met.withColumn("block", block).select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.col("block")).alias("value"))
    whole = parts.agg(F.sum(F.col("payload_bytes") + 700).alias("bytes"), F.count("*").alias("n")).first()
    _write(rows, path, "\r\n\r\n", _records_in_file(whole["bytes"] or 0, whole["n"], file_bytes))


def op4_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages become ARC files, these WARC files, and these the result.

    A revisit's payload is not in its record: its digest is, and its length
    is that of the response it refers to.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType.simpleString()
    legacy, modern = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, legacy)
    parts = written(converted(read_arc(spark, legacy)), "warc-parts")
    dropped(spark, legacy)
    write_warc(parts, modern, key_kind=kind)
    removed(parts)
    h = F.col("headers")
    key = key_of(F.regexp_extract(F.col("http").cast("string"), r"(?i)\r\nX-Key:[ \t]*([^\r\n]*)", 1), kind)
    back = written(
        read_warc(spark, modern).select(
            key.alias("page_id"),
            h["warc-type"].alias("record_type"),
            h["warc-record-id"].alias("record_id"),
            h["warc-refers-to"].alias("refers"),
            F.regexp_replace(h["warc-payload-digest"], "^sha1:", "").alias("payload_digest"),
            F.octet_length("payload").cast("long").alias("own_bytes"),
        ),
        "warc-read",
    )
    dropped(spark, modern)
    # responses refer to nothing and stay out of the join, in which their nulls would be one key
    first = back.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("own_bytes").alias("payload_bytes"))
    again = back.where("record_type = 'revisit'").join(first, "refers")
    alone = back.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast(kind)).withColumn("payload_bytes", F.col("own_bytes"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return alone.select(*names).unionByName(again.select(*names))
