"""WARC archives: one gzip member a record, written and read sequentially.

Writing: payload digests are computed first; of records with equal payloads of
at least ``least`` bytes, the one with the largest id becomes a response and
the others revisits of it, whose block holds the HTTP header alone. Each record
is compressed as a gzip member of its own in an Arrow batch, and Spark's own
text sink lays the members end to end, so that commits, retries and the choice
of file system are Spark's. The sink ends each row with a separator; a gzip
member ends in the length of its content, whose highest byte is zero below
16 MiB, so that separator is that zero byte and a member is handed over without
it. Larger members are handed over whole, followed by one zero byte, which gzip
allows as padding between members.

Reading: a file is read as a stream: zlib inflates a member step by step, the
header is framed by its blank line, the block by Content-Length, and the block
and payload digests are computed as the bytes pass. A record that fails raises
``WarcError`` or, if asked, is returned with its error.

Null payloads count as empty. Repeated rows (equal ids) each get a record. Ids
are any type that casts to text and back.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import scratch_path

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"
_STEP = 1 << 16
#: Records of an archive at most; a reader holds one compressed archive.
FILE_RECORDS = 10_000
_FULL = 1 << 24

READ_SCHEMA = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, error string"


class WarcError(ValueError):
    """A record that breaks the format or fails its digest."""


def digest_name(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record(page_id: str, url: str, payload: bytes, digest: bytes, refers_to: str | None) -> bytes:
    """One record, not compressed. A revisit's block is the HTTP header, which tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", RECORD_DATE),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", digest_name(hashlib.sha1(block).digest())),
        ("WARC-Payload-Digest", digest_name(digest)),
        ("X-Page-ID", page_id),
    ]
    if refers_to is not None:
        head[3:3] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"), ("X-Refers-To-Page-ID", refers_to)]
    head.append(("Content-Length", str(len(block))))
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head), b"", block, b"", b""])


def member(content: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def assign(pages: DataFrame, least: int, id_column: str, payload_column: str, url_column: str) -> DataFrame:
    """page_id, url, payload, digest, refers_to. Only digests that occur twice are joined back."""
    payload = F.encode(F.coalesce(F.col(payload_column), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_column).alias("page_id"), F.coalesce(F.col(url_column), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= least
    again = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.withColumn("probe", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), "digest")))
    joined = rows.join(again.withColumnRenamed("digest", "probe"), "probe", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("keeper") != F.col("page_id"), F.col("keeper")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least: int = 1000, id_column: str = "page_id", payload_column: str = "html", url_column: str = "url", level: int = 6) -> None:
    """Write a record for each row of pages to a folder of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                out = []
                for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    content = record(page or "", url, payload, bytes.fromhex(digest), refers)
                    packed = member(content, level)
                    out.append(packed[:-1] if len(content) < _FULL else packed)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    rows = assign(pages, least, id_column, payload_column, url_column)
    rows = rows.select(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))
    members = rows.mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class Reader:
    """Records of one archive, front to back; at most _STEP inflated bytes beyond a block are held."""

    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def members(self) -> Iterator[Iterator[bytes]]:
        while self.at < len(self.data):
            if self.data[self.at] == 0:  # padding
                self.at += 1
                continue
            yield self._inflate()

    def _inflate(self) -> Iterator[bytes]:
        stream = zlib.decompressobj(31)
        waiting = b""
        while not stream.eof:
            if not waiting:
                waiting = bytes(self.data[self.at : self.at + _STEP])
                if not waiting:
                    raise WarcError("the archive ends inside a member")
                self.at += len(waiting)
            try:
                out = stream.decompress(waiting, _STEP)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            waiting = stream.unconsumed_tail
            if out:
                yield out
        self.at -= len(stream.unused_data)  # at the end, unconsumed_tail may repeat it


def _until(mark: bytes, held: bytearray, source: Iterator[bytes]) -> bytes:
    while (end := held.find(mark)) < 0:
        more = next(source, None)
        if more is None:
            raise WarcError("a header has no end")
        held += more
    head = bytes(held[:end])
    del held[: end + len(mark)]
    return head


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower().decode(): v.strip().decode() for k, v in (x.split(b":", 1) for x in lines if b":" in x)}


def read_record(source: Iterator[bytes]) -> dict:
    """Frame one record by its lengths and verify both digests."""
    held = bytearray()
    first, *rest = _until(b"\r\n\r\n", held, source).split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise WarcError("no WARC version")
    head = _fields(rest)
    left = int(head["content-length"])
    block, http, payload, body = hashlib.sha1(), None, hashlib.sha1(), 0
    opening = bytearray()
    while left:
        if not held:
            more = next(source, None)
            if more is None:
                raise WarcError("the block is shorter than Content-Length")
            held += more
        part = bytes(held[:left])
        del held[: len(part)]
        left -= len(part)
        block.update(part)
        if http is None:
            opening += part
            end = opening.find(b"\r\n\r\n")
            if end < 0:
                continue
            http, part = _fields(bytes(opening[:end]).split(b"\r\n")[1:]), bytes(opening[end + 4 :])
        payload.update(part)
        body += len(part)
    for more in source:
        held += more
    if bytes(held) != b"\r\n\r\n":
        raise WarcError("a record doesn't end in two line ends")
    if head.get("warc-block-digest") != digest_name(block.digest()):
        raise WarcError("the block digest differs")
    kind, error = head["warc-type"], None
    stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    length = int((http or {}).get("content-length", 0))
    if kind == "response" and (payload.hexdigest() != stated or body != length):
        raise WarcError("the payload digest differs")
    return {"page_id": head.get("x-page-id") or None, "url": head.get("warc-target-uri", ""), "record_type": kind, "refers_to": head.get("x-refers-to-page-id"), "payload_bytes": length, "payload_digest": stated, "error": error}


def read_archive(data: bytes, strict: bool = True) -> Iterator[dict]:
    reader = Reader(data)
    for stream in reader.members():
        try:
            yield read_record(stream)
        except WarcError as e:
            if strict:
                raise
            yield {"page_id": None, "url": None, "record_type": None, "refers_to": None, "payload_bytes": None, "payload_digest": None, "error": str(e)}
            return  # what follows can't be framed


def read_warc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """READ_SCHEMA, a row for each record of the archives in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.string()) for f in READ_SCHEMA.split(", ")])
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for x in read_archive(data.as_buffer(), strict):
                    rows.append(x)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: one row a page."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path, least)
    kind = dict(pages.dtypes)["page_id"]
    back = read_warc(pages.sparkSession, path)
    return back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind), "url")
