"""WARC archives: a writer of one gzip member per record and a salvage reader.

The writer makes revisit records of equal payloads. The reader checks every record (gzip
checksum, version line, header lengths, payload digest). Where a check fails it looks for the
next member or version line that leads to a valid record, goes on there, and logs the bytes
in between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sarani.llm.common import as_bytes
from sarani.session import scratch_path

ARCHIVE_BYTES = 8 << 20  # an archive is closed once it has so many bytes
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_VERSION_LINE = re.compile(rb"WARC/1\.\d+[ \t]*\r\n")
RECORD_SCHEMA = (
    "file string, start long, end long, gap string, record_id string, record_type string, target_uri string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(record_id: str, kind: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has no block but names the length and digest it stands for."""
    block = b"" if kind == "revisit" else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {re.sub('[\r\n]+', ' ', uri)}"] if uri else []),
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Identified-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_revisits(pages: DataFrame, key: str, payload: str, uri: str, least: int) -> DataFrame:
    """page_id, uri, payload (null: empty) and refers_to, the largest key with an equal payload.

    Ids and payload hashes find the revisits; payloads are moved once. A row is judged by its id
    and its payload together, so rows that repeat an id with other payloads are records of their own.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(uri).cast("string").alias("uri"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("h", F.sha2("payload", 256))
    hashed = rows.select("page_id", "h", F.octet_length("payload").alias("size"))
    copies = (
        hashed.where(F.col("size") >= least).groupBy("h").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND refers_to IS NOT NULL").drop("n")
    )
    revisits = hashed.select("page_id", "h").join(copies, "h").where("page_id <> refers_to").distinct()
    return rows.join(revisits, ["page_id", "h"], "left").select("page_id", "uri", "payload", "refers_to")


def write_warc(
    pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", uri: str = "url",
    least: int = 0, compress: bool = True, archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Writes a record per row under `path` (any file system that Spark reaches).

    Of records with equal payloads of at least `least` bytes, the one with the largest key is
    a response and the others revisit it; smaller payloads are all responses. A row with a
    null key is a response. Rows that repeat the largest key of a payload are responses each. Each
    archive holds about `archive_bytes` bytes.
    """
    # The text writer passes bytes on as they are and ends a row, here a file, with one byte. So
    # an archive leaves its last byte to the writer: the line end of a plain record, or the
    # highest byte of a member's length.
    last = b"\0" if compress else b"\n"

    def whole(held: list[bytes]) -> pa.RecordBatch:
        data = b"".join(held)
        if not data.endswith(last):  # a record of 16 MB or more: an empty member follows it
            data += gzip_member(b"")
        return pa.RecordBatch.from_pydict({"archive": [data[:-1]]})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "uri", "refers_to")]
            for page_id, address, target, data in zip(*columns, as_bytes(batch.column("payload"))):
                record = record_bytes(
                    "null" if page_id is None else str(page_id), "response" if target is None else "revisit", address, data,
                    None if target is None else str(target),
                )
                held.append(gzip_member(record) if compress else record)
                size += len(held[-1])
                if size >= archive_bytes:
                    yield whole(held)
                    held, size = [], 0
        if held:
            yield whole(held)

    archives = with_revisits(pages, key, payload, uri, least).mapInArrow(pack, "archive binary")
    lines = archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    lines.option("lineSep", last.decode()).text(path)


def _parse(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record at `at` of plain WARC bytes and its end, or why it is not valid."""
    if not _VERSION_LINE.match(data, at):
        return "no version line"
    head_end = data.find(b"\r\n\r\n", at)  # a header is as long as its url
    if head_end < 0 or data.find(b"\n" + VERSION, at, head_end) >= 0:
        return "header without end"
    head = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        head[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    try:
        length = int(head["content-length"])
        size = int(head.get("warc-identified-payload-length", length))
    except (KeyError, ValueError):
        return "no length"
    start, end = head_end + 4, head_end + 4 + length
    if length < 0 or data[end : end + 4] != b"\r\n\r\n":
        return "wrong length"
    block, kind = data[start:end], head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "").rpartition(":")[2]
    if kind != "revisit" and digest and digest != sha1_base32(block):
        return "wrong digest"
    found = {
        "record_id": _bare(head.get("warc-record-id")), "record_type": kind, "target_uri": head.get("warc-target-uri"),
        "refers_to": _bare(head.get("warc-refers-to")), "payload_bytes": size if kind == "revisit" else length,
        "payload_digest": digest or sha1_base32(block), "payload": None if kind == "revisit" else block,
    }
    return found, end + 4


def _bare(value: str | None) -> str | None:
    return None if value is None else value.strip("<>").removeprefix("urn:page:")


def _member(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record of the gzip member at `at` and the member's end, or why it is not valid."""
    if not data.startswith(MEMBER, at):
        return "no member"
    unpacker = zlib.decompressobj(31)
    out, pos, step = [], at, 1 << 16
    try:
        while not unpacker.eof and pos < len(data):
            out.append(unpacker.decompress(data[pos : pos + step]))
            pos += step
            step = min(step * 2, 1 << 22)
    except zlib.error:
        return "broken member"
    if not unpacker.eof:
        return "cut member"
    plain = b"".join(out)
    if not plain:
        return {}, min(pos, len(data)) - len(unpacker.unused_data)
    found = _parse(plain, 0)
    if isinstance(found, str):
        return found
    if found[1] != len(plain):
        return "bytes after the record"
    return found[0], min(pos, len(data)) - len(unpacker.unused_data)


def salvage(data: bytes) -> Iterator[dict]:
    """All valid records of an archive, plain or in members, and the gaps between them in order."""
    at, gap, why = 0, None, ""
    while at < len(data):
        found = _member(data, at) if data.startswith(MEMBER, at) else _parse(data, at)
        if isinstance(found, str):
            if gap is None:
                gap, why = at, found
            after = [i for m in (MEMBER, VERSION) if (i := data.find(m, at + 1)) >= 0]
            at = min(after, default=len(data))
            continue
        if gap is not None and data[gap:at].strip(b"\0\r\n"):
            yield {"start": gap, "end": at, "gap": why}
        gap = None
        record, end = found
        if record:  # not an empty member
            yield {"start": at, "end": end, **record}
        at = end
    if gap is not None and data[gap:].strip(b"\0\r\n"):
        yield {"start": gap, "end": len(data), "gap": why}


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of RECORD_SCHEMA: valid records (gap null) and quarantined gaps (gap: the reason).

    A gap has the byte range [start, end) that was passed over. Blank or zero bytes between
    records are padding, not gaps. An empty archive gives no rows. Without `payloads` the
    payload column is null; lengths and digests are those checked while reading. An archive is read
    as one value, so it may have 2 GB at most; `write_warc` makes far smaller ones.
    """
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (f.split() for f in RECORD_SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, file in enumerate(batch.column("path").to_pylist()):
                rows, held = [], 0
                for row in salvage(batch.column("content")[i].as_py() or b""):
                    row["file"] = file
                    if payloads:
                        held += len(row.get("payload") or b"")
                    else:
                        row["payload"] = None
                    rows.append(row)
                    if held > 4 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    assert names[0] == "file"
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def warc_round_trip(
    pages: DataFrame, key: str = "page_id", payload: str = "html", uri: str = "url", least: int = 0,
) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archives written and read back.

    Null payloads are empty ones. Repeated ids are records each, judged by their own payload; those
    with the id that others revisit are all responses. A null id is a response with a null
    page_id. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, key, payload, uri, least)
    return read_warc(spark, path, payloads=False).where("gap IS NULL").select(
        F.expr("try_cast(record_id AS long)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(refers_to AS long)").alias("refers_to"),
    )
