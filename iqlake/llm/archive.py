"""Legacy ARC archives to WARC: write, parse, convert, and read both formats.

Archives are written by Spark's text writer (one record a row, the record's end mark as line separator) and read with
``binaryFile``, so any file system that Spark reaches will do.
"""

from __future__ import annotations

import codecs
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps, stored

#: Bytes of payload in an archive file, and the least size of a payload that is worth a revisit record.
FILE_BYTES, REVISIT_BYTES = 32 << 20, 100
#: A payload that at least this share of all records has is joined by broadcast; there are at most its inverse of them.
HOT_SHARE = 1 / 1024
#: The record line's fields by ARC version, and the WARC profile of a revisit.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
_ARC = "record_url string, ip string, archived string, mime string, version int, http binary, source_id long, payload binary"
_WARC = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string, content_type string"


def _percent(error: UnicodeDecodeError) -> tuple[str, int]:
    return "".join(f"%{b:02X}" for b in error.object[error.start : error.end]), error.end


codecs.register_error("iqlake-percent", _percent)


def write_arc(pages: DataFrame, path: str, version: int = 1, archived: str = "20080430204825", id_col: str = "page_id", url: str = "url", body: str = "html") -> None:
    """Write pages as gzipped ARC files of version 1 or 2, each record an HTTP response. A null body is empty.

    Files hold about FILE_BYTES of payload. The row's id travels as an HTTP header, as ARC has no field for it.
    """
    text = F.coalesce(F.col(body).cast("string"), F.lit(""))
    total = pages.agg(F.sum(F.octet_length(text))).first()[0] or 0
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.when(F.col(id_col).isNotNull(), F.concat(F.lit("X-Source-Id: "), F.col(id_col).cast("string"), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"),
    )
    where = F.regexp_replace(F.coalesce(F.col(url), F.lit("unknown:")), r"[\x00-\x20]", "%20")
    length = (F.octet_length(http) + F.octet_length(text)).cast("string")
    middle = {1: F.lit(" text/html "), 2: F.concat(F.lit(" text/html 200 "), F.substring(F.md5(text), 1, 32), F.lit(" - 0 pages.arc "))}[version]
    record = F.concat(where, F.lit(f" 0.0.0.0 {archived}"), middle, length, F.lit("\n"), http, text)
    block = f"{version} 0 Archive\n{' '.join(ARC_FIELDS[version])}\n"
    line = {1: f"filedesc://pages.arc 0.0.0.0 {archived} text/plain {len(block)}\n{block}", 2: f"filedesc://pages.arc 0.0.0.0 {archived} text/plain 200 - - 0 pages.arc {len(block)}\n{block}"}[version]

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([line])], names=["value"])
                first = False
            yield batch

    rows = pages.repartition(max(1, -(-total // FILE_BYTES))).select(record.alias("value"))
    rows.mapInArrow(headed, "value string").write.option("compression", "gzip").option("lineSep", "\n").text(path)


def _content(raw: bytes) -> bytes:
    """A file's bytes, unpacked if it consists of gzip members."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        d = zlib.decompressobj(31)
        out.append(d.decompress(raw) + d.flush())
        raw = d.unused_data.lstrip(b"\0")
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(version, fields, block) of each record after the version block. Raises ValueError where a file breaks off.

    Bytes of a record line that aren't UTF-8 are written as ``%XX`` in the fields.
    """
    at, version, names = 0, 0, ARC_FIELDS[1]
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        values = data[at : end if end >= 0 else len(data)].decode("utf-8", "iqlake-percent").rstrip("\r").split(" ")
        if end < 0 or len(values) < len(ARC_FIELDS[1]) or not values[-1].isdigit():
            raise ValueError(f"no record line at byte {at}")
        start, at = end + 1, end + 1 + int(values[-1])
        block = data[start:at]
        if len(block) < int(values[-1]):
            raise ValueError(f"record at byte {start} breaks off")
        if values[0].startswith("filedesc:"):
            version = int(block.split(b" ", 1)[0])
            names = ARC_FIELDS[version]
            continue
        if len(values) != len(names):
            raise ValueError(f"version {version or 1} takes {len(names)} fields, found {len(values)}")
        yield version or 1, dict(zip(names, values, strict=True)), block


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files of either version: url, ip, date, type, version, HTTP headers as they are, source_id and payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_url", pa.string()), ("ip", pa.string()), ("archived", pa.string()), ("mime", pa.string()), ("version", pa.int32()), ("http", pa.binary()), ("source_id", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for raw in batch.column(0):
                rows, size = [], 0
                for version, f, block in arc_records(_content(raw.as_py())):
                    head, mark, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                    found = _headers(head.decode("latin-1")).get("x-source-id")
                    rows.append((f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], version, head + mark, int(found) if found else None, body))
                    size += len(body)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, _ARC)


def _headers(text: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in text.split("\r\n")[1:] if ":" in line)}


def _iso(date: str) -> str:
    """A 14-digit date as WARC writes it; short dates of old archives are filled up."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(url: str, date: str, source_id: int | None, digest: str) -> str:
    """The same record gets the same id in every attempt."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{url} {date} {source_id} {digest}')}>"


def _firsts(digested: DataFrame, least: int) -> tuple[DataFrame, int, int]:
    """(digest, n, f) of payloads that several records have, f being the first of these; and the records' number and bytes."""
    place = F.when(F.col("source_id").isNotNull(), F.struct("source_id", "record_url", "archived"))
    size = F.octet_length("payload").cast("long")
    key = F.when(size >= least, F.col("digest"))
    found = stored(digested.groupBy(key.alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.min(place).alias("f")), "firsts")
    total = found.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    return found.where("digest is not null and n > 1 and f is not null").select("digest", "n", "f"), total.n or 0, total.bytes or 0


def convert(records: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Write ARC records as gzipped WARC 1.1 files of about FILE_BYTES of payload.

    Identifier, date, type and SHA-256 digests are synthesised from each record. Of records with equal payloads of at least
    ``least`` bytes, that with the smallest source_id is ``response`` and the others are ``revisit`` records that name it and
    keep HTTP headers only. Rows tied on that smallest id are all responses; a record without source_id never is the first
    unless none has one, and then all are responses. Records that aren't HTTP become ``resource``.

    Payloads travel once, to the task of their digest if another record has the same. Those of very common payloads and of
    unshared ones are spread instead, so no task gets more than HOT_SHARE of all records for one payload.
    """
    digested = records.withColumn("digest", F.sha2("payload", 256))
    firsts, n, size = _firsts(digested, least)
    files = max(1, math.ceil(size / FILE_BYTES))
    many = max(2, math.ceil(n * HOT_SHARE))
    common = F.broadcast(firsts.where(F.col("n") >= many).select(F.col("digest").alias("common"), F.col("f").alias("cf")))
    rows = digested.join(common, F.col("digest") == F.col("common"), "left")
    spread = F.concat_ws(" ", F.xxhash64("source_id", "record_url", "archived").cast("string"), "record_url")
    meets = (F.octet_length("payload") >= least) & F.col("common").isNull()
    rows = rows.withColumn("key", F.when(meets, F.col("digest")).otherwise(spread)).repartition(files, "key")
    joined = rows.join(firsts.where(F.col("n") < many).select(F.col("digest").alias("key"), "f").repartition(files, "key"), "key", "left").withColumn("f", F.coalesce("cf", "f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for step in (step for batch in batches for step in steps(batch, "payload", 1 << 22)):
            out = []
            for r in step.to_pylist():
                if first:
                    info = b"software: iqlake\r\nformat: WARC File Format 1.1\r\n"
                    out.append(_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_SPACE, r['record_url'] + r['digest'])}>", "WARC-Date": _iso(r["archived"]), "Content-Type": "application/warc-fields"}, info))
                    first = False
                head = {"WARC-Record-ID": record_id(r["record_url"], r["archived"], r["source_id"], r["digest"]), "WARC-Date": _iso(r["archived"]), "WARC-Target-URI": r["record_url"], "WARC-IP-Address": r["ip"], "WARC-Payload-Digest": f"sha256:{r['digest']}", "X-Source-Id": "" if r["source_id"] is None else str(r["source_id"]), "X-Payload-Length": str(len(r["payload"]))}
                http = r["http"]
                f = r["f"]
                if f and r["source_id"] != f["source_id"]:
                    head |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(f["record_url"], f["archived"], f["source_id"], r["digest"]), "WARC-Refers-To-Target-URI": f["record_url"], "WARC-Refers-To-Date": _iso(f["archived"]), "X-Refers-To-Source-Id": str(f["source_id"])}
                    block = http
                else:
                    head["WARC-Type"] = "response" if http else "resource"
                    block = http + r["payload"]
                head |= {"Content-Type": "application/http; msgtype=response" if http else r["mime"], "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
                out.append(_record(head, block))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    cols = ["record_url", "ip", "archived", "mime", "http", "source_id", "payload", "digest", "f"]
    joined.select(*cols).mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def _record(head: dict[str, str], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in head.items() if v != ""]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each WARC record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/" or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        head = _headers(data[at:end].decode("utf-8", "replace"))
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} breaks off")
        at = end + 8 + n
        yield head, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response, resource and revisit records of WARC files. Digests of stored payloads are computed anew from the bytes
    read; a mismatch with the header raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(0):
                for h, block in warc_records(_content(raw.as_py())):
                    kind = h["warc-type"]
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    digest, n = h["warc-payload-digest"].removeprefix("sha256:"), int(h["x-payload-length"])
                    if kind != "revisit":
                        payload = block.partition(b"\r\n\r\n")[2] if h["content-type"].startswith("application/http") else block
                        n = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload digest of {h['warc-record-id']} doesn't match")
                    number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                    rows.append((number("x-source-id"), n, digest, kind, number("x-refers-to-source-id"), h["warc-record-id"], h["warc-target-uri"], h["warc-date"], h["content-type"]))
            names = [c.split()[0] for c in _WARC.split(", ")]
            types = [pa.int64() if c.endswith("long") else pa.string() for c in _WARC.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, _WARC)
