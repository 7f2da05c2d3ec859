"""WARC archives: a writer that stores repeated payloads once, and a sequential reader.

Writing. Every page becomes one record in a gzip member of its own. Pages with
the same payload (by SHA-1, and at least ``revisit_bytes`` long) are stored
once: the page with the largest id is the response, the others are revisit
records that refer to it and hold no payload. Records are made in tasks, joined
to archives of bounded records and bytes, so that any archive fits a reader, and written by Spark's own text sink, byte for byte, so archives can lie in any store
that Spark writes to. The sink ends each row with a separator, for which an
empty gzip member is used: it adds nothing to the unpacked stream.

Reading. Archives are read as whole binary files and walked once from front to
back: zlib unpacks one member at a time in small steps, the header block ends
at an empty line, Content-Length frames the block, and the payload's SHA-1 is
compared with the header. ``problem`` names what is wrong with a record; after a
broken member the reader goes on at the next gzip header.

Null html is an empty payload. A null id is written as empty and read back as
null; nulls lose against any id, and if all ids of a payload are null, all its
pages are responses. Rows with equal payload and equal largest id are all
responses. Empty tables give no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doseframe.llm.common import slices

#: Records and packed bytes in one archive file, at most; a larger record has a file of its own.
ARCHIVE_RECORDS = 4000
ARCHIVE_BYTES = 32 << 20
STEP = 64 << 10

# Fixed values of the format.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
MAGIC = b"\x1f\x8b\x08"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("problem", T.StringType()),
    ]
)


def record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def record_bytes(page: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record, unpacked. A revisit keeps the HTTP header, which tells the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = [
        VERSION,
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def with_responses(pages: DataFrame, page_id: str, html: str, revisit_bytes: int) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the response's id for a revisit, else null."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        payload.alias("html"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    # Only digests and ids are combined; groups of one page need no join partner.
    largest = rows.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    matched = rows.join(largest.drop("n"), "digest", "left")
    long_enough = F.octet_length("html") >= revisit_bytes
    return matched.select(
        "page_id", "url", "html",
        F.when(long_enough & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"),
    )


def write_warc(
    pages: DataFrame, path: str, *, page_id: str = "page_id", html: str = "html", revisit_bytes: int = 0,
    archive_records: int = ARCHIVE_RECORDS, archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write archives below ``path`` (a new folder)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(archive)], pa.binary())], names=["value"])

        for batch in slices(batches, "html"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")))
            for p, u, h, r in rows:
                packed = member(record_bytes(p, u, h.encode(), r))
                if archive and (len(archive) >= archive_records or size + len(packed) > archive_bytes):
                    yield row()
                    archive, size = [], 0
                archive.append(packed)
                size += len(packed)
        if archive:
            yield row()

    if "url" not in pages.columns:
        pages = pages.withColumn("url", F.lit(""))
    packed = with_responses(pages, page_id, html, revisit_bytes).mapInArrow(run, "value binary")
    # A row is an archive. The sink writes a string's bytes as they are; the cast does not look at them.
    packed.select(F.col("value").cast("string")).write.options(
        encoding="ISO-8859-1", lineSep=EMPTY_MEMBER.decode("latin-1"), maxRecordsPerFile=1, compression="none"
    ).text(path)


def members(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """Unpacked gzip members that hold something, and what is wrong with each."""
    at = 0
    while at < len(data):
        if data[at : at + 3] != MAGIC:
            start = at
            at = data.find(MAGIC, at)
            yield b"", f"no gzip header at {start}"
            if at < 0:
                return
        unpack, out, problem, begun = zlib.decompressobj(31), [], None, at
        try:
            while not unpack.eof and at < len(data):
                out.append(unpack.decompress(data[at : at + STEP]))
                at += STEP
            at = min(at, len(data)) - len(unpack.unused_data)
            if not unpack.eof:
                problem = "truncated gzip member"
        except zlib.error as error:
            problem, at = f"broken gzip member: {error}", data.find(MAGIC, begun + 1)
            at = len(data) if at < 0 else at
        if (content := b"".join(out)) or problem:
            yield content, problem


def parsed(content: bytes, problem: str | None) -> dict:
    """One record from its unpacked bytes."""
    out: dict = {"problem": problem}
    head, end, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not end or not lines[0].startswith("WARC/"):
        return out | {"problem": problem or "no record header"}
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    out |= {"page_id": page_of(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type")}
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) != int(size) + 4 or not rest.endswith(b"\r\n\r\n"):
        return out | {"problem": problem or "length does not match"}
    http, _, payload = rest[: int(size)].partition(b"\r\n\r\n")
    length = [v.strip() for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.strip().lower() == b"content-length"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    out |= {"payload_digest": digest, "payload_bytes": int(length[0]) if length and length[0].isdigit() else None}
    if out["record_type"] == "revisit":
        return out | {"refers_to": page_of(fields.get("warc-refers-to"))}
    out["payload"] = payload
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        out["problem"] = problem or "digest does not match"
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = RECORD.fieldNames()
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, size = [], 0
                for content_of, problem in members(content.as_py()):
                    rows.append({"archive": archive} | parsed(content_of, problem))
                    size += len(content_of)
                    if size > STEP << 6:
                        yield records(rows, names)
                        rows, size = [], 0
                yield records(rows, names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD)


def records(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)
