"""WARC archives: deduplicating writer and salvage reader.

Writer: records with equal payloads are found by digest and length; the one of the least page_id is a
``response``, the others are ``revisit`` records that refer to it. Each record is a gzip member of its
own, each task writes one file.

Salvage reader: reads record by record and checks each (gzip checksum, version line, length, payload
digest). After a failed check it looks for the next gzip member or version line, whichever comes first,
goes on from there, and reports the bytes in between as a quarantined gap. A member may hold several
records; they are read by the same search. What a broken member gave before its fault is searched too,
but a record is believed only with a digest of its own and another record after it; the last one before
the fault stays quarantined, as the member's checksum failed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.files import write_file
from lakewright.operators.skew import lookup
from lakewright.session import scratch_path

# Fixed values of the formats.
VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 64 << 20
STEP = 1 << 14
_LINE = re.compile(rb"WARC/\d{1,3}\.\d{1,3}\r\n")
_START = re.compile(re.escape(GZIP) + b"|" + _LINE.pattern)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One uncompressed record; a revisit has the head of the response only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, file, number = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, size, file
            write_file(f"{folder}/part-{number:06d}-{file:04d}.warc.gz", b"".join(parts))
            done = pa.RecordBatch.from_pydict({"records": [len(parts)]})
            parts, size, file = [], 0, file + 1
            return done

        for batch in batches:
            number = batch.column("part")[0].as_py() if batch.num_rows else number
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")))
            for page_id, url, html, refers_to in rows:
                payload = (html or "").encode()
                parts.append(_member(record(page_id, url, payload, refers_to, base32_sha1(payload))))
                size += len(parts[-1])
                if size >= FILE_BYTES:
                    yield flush()
        if parts:
            yield flush()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> str:
    """Write a record per row; returns the folder.

    Payloads of fewer than ``min_bytes`` bytes are always responses. A null html is an empty payload.
    Rows with a null page_id are responses and are never referred to; rows that repeat the least page_id
    of a payload are responses too. Only digests are grouped; a digest shared by a third of all rows is
    counted before the shuffle.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    shared = (
        rows.where(F.col("size") >= min_bytes)
        .groupBy("sha", "size")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("sha", "size", "first")
    )
    joined = lookup(rows, shared, ["sha", "size"], "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to")
    out = joined.select("page_id", "url", "html", refers, F.spark_partition_id().alias("part"))
    out.mapInArrow(_write(folder), "records long").write.format("noop").mode("overwrite").save()
    return folder


def _head(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Fields of the record that begins at ``at`` and the place of its block."""
    version = _LINE.match(data, at)
    end = data.find(b"\r\n\r\n", at) if version else -1
    if end < 0:
        return None
    fields = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


def _parse(data: bytes, at: int, proof: bool = False) -> tuple[dict, int] | str:
    """The record at ``at`` and the place after it, or why it fails; with ``proof`` it must name a digest."""
    head = _head(data, at)
    if head is None:
        return "no valid record head"
    fields, start = head
    end = start + int(fields["content-length"])
    if end > len(data) or data[end : end + 4] != b"\r\n\r\n":
        return "length does not lead to a record end"
    block = data[start:end]
    if fields.get("warc-block-digest", f"sha1:{base32_sha1(block)}") != f"sha1:{base32_sha1(block)}":
        return "block digest differs"
    if proof and "warc-block-digest" not in fields:
        return "no block digest"
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest and digest != base32_sha1(payload):
        return "payload digest differs"
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http) if kind == "revisit" else None
    return {
        "record_type": kind,
        "record_id": fields.get("warc-record-id", ""),
        "url": fields.get("warc-target-uri"),
        "payload_digest": digest or base32_sha1(payload),
        "payload_bytes": int(length[1]) if length else len(payload),
        "refers_to": fields.get("warc-refers-to"),
        "payload": payload if kind == "response" else None,
    }, end + 4


def _inflate(data: bytes, at: int, stop: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` holds up to ``stop``, the place after it, why it fails (empty if whole)."""
    unpack, parts = zlib.decompressobj(31), []
    try:
        while not unpack.eof and at < stop:
            step = data[at : min(at + STEP, stop)]
            parts.append(unpack.decompress(step))
            at += len(step)
    except zlib.error as error:
        # The step with the fault once more in small bits, for what comes before the fault.
        unpack = zlib.decompressobj(31)
        for part in range(at - len(parts) * STEP, at, STEP):
            unpack.decompress(data[part : part + STEP])
        try:
            for i in range(at, at + len(step)):
                parts.append(unpack.decompress(data[i : i + 1]))
        except zlib.error:
            pass
        return b"".join(parts), at, f"gzip: {error}"
    return b"".join(parts), at - len(unpack.unused_data), "" if unpack.eof else "gzip: the member is cut off"


def _records(data: bytes, proof: bool) -> tuple[list[dict], str]:
    """Every valid record of unpacked bytes, and why others fail (empty if there is nothing else)."""
    records, why, at = [], "", 0
    while at < len(data):
        found = _parse(data, at, proof)
        if isinstance(found, tuple) and (not proof or _LINE.match(data, found[1])):
            records.append(found[0])
            at = found[1]
            continue
        why = why or (found if isinstance(found, str) else "nothing after the record")
        later = _LINE.search(data, at + 1)
        at = later.start() if later else len(data)
    return records, why or ("" if records else "no valid record head")


def _quarantine(data: bytes, bad: int, stop: int, why: str, broken: list[int]) -> Iterator[tuple]:
    """The records in the heads of the broken members of a gap, once each, and the gap."""
    seen = []
    for at in broken:
        for fields in _records(_inflate(data, at, stop)[0], proof=True)[0]:
            if fields not in seen:  # an unpacked block of one member may hold the next one
                seen.append(fields)
                yield "record", at, 0, fields
    yield "gap", bad, stop - bad, why


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", offset, length, fields) and ("gap", offset, length, reason) in file order.

    Records of one gzip member have its offset and length; a whole member that holds bytes besides its
    records is a gap of its own after them. A broken member is part of a gap, which ends at the next valid
    record; the records of its head come before that gap, with length 0. Every place is tried as packed or
    plain by itself, so both kinds may stand in one file.
    """
    at, bad, why, broken = 0, None, "", []
    while at < len(data):
        records, end, fault = [], at, "no gzip member or version line"
        if data.startswith(GZIP, at):
            content, end, fault = _inflate(data, at, len(data))
            if not fault:
                records, fault = _records(content, proof=False)
            elif content:
                broken.append(at)
        elif _LINE.match(data, at):
            found = _parse(data, at)
            records, end, fault = ([found[0]], found[1], "") if isinstance(found, tuple) else ([], at, found)
        if records:
            if bad is not None:
                yield from _quarantine(data, bad, at, why, broken)
                bad, broken = None, []
            for fields in records:
                yield "record", at, end - at, fields
            if fault:
                yield "gap", at, end - at, fault
            at = end
            continue
        if bad is None:
            bad, why = at, fault
        later = _START.search(data, at + 1)
        at = later.start() if later else len(data)
    if bad is not None:
        yield from _quarantine(data, bad, len(data), why, broken)


_SCHEMA = (
    "kind string, file string, offset long, length long, reason string, record_type string, record_id string, "
    "url string, payload_digest string, payload_bytes long, refers_to string, payload binary"
)
_FIELDS = ["record_type", "record_id", "url", "payload_digest", "payload_bytes", "refers_to", "payload"]
_ARROW = pa.schema(
    [("kind", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    + [("reason", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string())]
    + [("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string())]
    + [("payload", pa.binary())]
)


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for kind, offset, length, what in salvage(content.as_py()):
                    row = {"kind": kind, "file": file.as_py(), "offset": offset, "length": length}
                    row |= {k: what[k] for k in _FIELDS} if kind == "record" else {"reason": what}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row.get("payload") or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def read_archives(spark, folder: str, payloads: bool = True) -> DataFrame:
    """Records (kind ``record``) and quarantined byte gaps (kind ``gap``) of all archives below a folder.

    An empty file has neither. Repeated records come back as often as they stand there.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # no row, no file
        return spark.createDataFrame([], _SCHEMA)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    return files.select("path", "content").mapInArrow(_read(payloads), _SCHEMA)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read back."""

    def page(name: str):
        return F.expr(f"try_cast(regexp_extract({name}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")

    return records.where("kind = 'record'").select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )
