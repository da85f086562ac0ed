"""WARC archives: a writer through Spark's text sink and a splittable reader of byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range that one task scans, and bytes read at once.
RANGE, READ, SLICE = 16 << 20, 1 << 20, 1 << 16
URN = "urn:page:"
#: The type of a row that stands for a damaged member.
DAMAGED = "damaged"
_SCHEMA = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
                        T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType())])


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, _digest (hex SHA-1) and _refers: null for a response, else the page_id that it revisits.

    Null html is an empty payload. Of equal payloads of min_bytes or more, rows with the largest page_id are
    responses (all of them, if rows repeat); in a group without any page_id all are. The largest page_id of a digest
    is a grouped maximum, joined back on the digest, where a payload shared by very many pages can be split.
    """
    rows = pages.select("page_id", "url", common.text_or_empty("html").alias("html"))
    rows = rows.withColumn("_digest", F.sha1(F.encode("html", "UTF-8")))
    large = F.octet_length("html") >= min_bytes
    last = rows.where(large).groupBy("_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").select("_digest", "_last")
    refers = F.when(large & F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    return rows.join(last, "_digest", "left").select("page_id", "url", "html", "_digest", refers.alias("_refers"))


def _member(page_id: int | None, url: str | None, html: str, digest: str, refers: int | None) -> bytes:
    payload = html.encode("utf-8", "surrogatepass")
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    uri = "".join(c for c in url or "" if c not in "\r\n")
    name = lambda i: f"<{URN}{'' if i is None else i}:{b32}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        *([f"WARC-Target-URI: {uri}"] if url is not None else []),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{b32}",
        *([] if refers is None else [f"WARC-Refers-To: {name(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """One gzip member a record, by Spark's text sink, whose commit protocol keeps files whole if tasks are retried.

    A member's bytes pass as a string, which Spark writes as they are; the line separator is an empty gzip member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_member(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)], pa.binary())], names=["value"])

    out = roles(pages, min_bytes).mapInArrow(run, "value binary")
    out.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", gzip.compress(b"", 4, mtime=0).decode("latin-1")).text(path)


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, first, last) byte ranges of the archive files; their contents aren't read here."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    cut = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("first"))
    cut = cut.select("path", "first", (F.col("first") + size).alias("last"))
    return cut.repartition(max(1, min(cut.count(), 10_000)), "path", "first")


class Damaged(ValueError):
    """A member that begins as a WARC record but can't be decoded, or bytes between members that belong to none."""


class _Source:
    """A file's bytes from a position on, read in blocks; ``at`` is the position of the next byte that isn't used yet."""

    def __init__(self, file, at: int):
        self.file, self.at, self.buf, self.pos = file, at, b"", 0
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(READ)
        self.buf, self.pos = (self.buf[self.pos :] + got if self.pos < len(self.buf) else got), 0
        return bool(got)

    def skip(self, n: int) -> None:
        self.pos, self.at = self.pos + n, self.at + n

    def find(self, last: int) -> bool:
        """Move to the next gzip magic that starts before ``last``."""
        while self.at < last:
            k = self.buf.find(MAGIC, self.pos)
            if k >= 0:
                self.skip(k - self.pos)
                return self.at < last
            self.skip(max(0, len(self.buf) - self.pos - 2))
            if not self.more():
                return False
        return False

    def stands_at_member(self) -> bool:
        """Whether a gzip magic or the file's end stands here."""
        while len(self.buf) - self.pos < len(MAGIC) and self.more():
            pass
        return self.buf[self.pos : self.pos + len(MAGIC)] in (MAGIC, b"")

    def member(self) -> bytes | None:
        """The member that starts here, decoded, after which this stands; None if these bytes aren't one of a WARC file.

        Bytes are kept for another try only until the record's first bytes are known, so a large record costs its size.
        """
        z, out, ours, used = zlib.decompressobj(31), [], False, 0
        while True:
            data = self.buf[self.pos + used : self.pos + used + SLICE]
            if not data:
                if ours:
                    self.skip(used)
                    used = 0
                if self.more():
                    continue
                if ours:
                    raise Damaged(f"the record before byte {self.at} is cut off")
                return None
            try:
                got = z.decompress(data)
            except zlib.error as e:
                if ours:
                    self.skip(used + 1)
                    raise Damaged(f"the record before byte {self.at} can't be decoded: {e}") from e
                return None
            used += len(data) - len(z.unused_data)
            out.append(got)
            if not ours:
                head = b"".join(out)
                if head and not head.startswith(b"WARC/"[: len(head)]):
                    return None
                ours = len(head) >= 5
            if z.eof:
                self.skip(used)
                return b"".join(out)


def _page(name: str) -> int | None:
    own = name.strip("<>").removeprefix(URN).partition(":")[0] if name.strip("<>").startswith(URN) else ""
    return int(own) if re.fullmatch(r"-?[0-9]{1,19}", own) else None


def parse(record: bytes) -> tuple:
    """record_id, page_id, url, type, refers_to, digest, size and payload; the ids are null unless this writer named the record.

    The payload of an HTTP message is what follows its headers, of any other record the block.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    own = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = own.get("content-length", "")
    block = rest[: int(size)] if size.isascii() and size.isdigit() else rest.removesuffix(b"\r\n\r\n")
    http, _, body = block.partition(b"\r\n\r\n") if own.get("content-type", "").startswith("application/http") else (b"", b"", block)
    kind = own.get("warc-type", "unknown")
    if kind == "revisit":
        sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        digest, length, body = own.get("warc-payload-digest", "").removeprefix("sha1:"), int(sizes[0]) if sizes and sizes[0].isdigit() else 0, None
    else:
        digest, length = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
    name = own.get("warc-record-id", "").strip("<>")
    clean = lambda x: x if x is None else x.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return clean(name) or None, _page(name), clean(own.get("warc-target-uri")), clean(kind), _page(own.get("warc-refers-to", "")), clean(digest), length, body


def records(path: str, first: int, last: int) -> Iterator[tuple]:
    """The records whose member starts in [first, last). A candidate that doesn't decode to a WARC header is passed over.

    Damage gives a row of type DAMAGED: a record that breaks off or can't be decoded, or bytes after a record that are no member.
    """
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        src = _Source(file, first)
        while src.find(last):
            try:
                got = src.member()
                if got is None:
                    src.skip(1)
                    continue
                if got:
                    yield parse(got)
                if not src.stands_at_member():
                    raise Damaged(f"bytes from {src.at} on belong to no member")
            except Damaged as e:
                yield None, None, f"{path}: {e}", DAMAGED, None, None, 0, None


def read(spark: SparkSession, path: str, size: int = RANGE, payload: bool = True, damaged: str = "fail") -> DataFrame:
    """Records of all archives under a path: record_id, page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    Archives of other writers may hold records of any type and name; page_id and refers_to are null for these. Digest and
    length are taken from the payload itself, of a revisit from its headers. Damaged members fail the job unless
    ``damaged`` is "keep": then each is a row of type DAMAGED whose url says where. The path must be one that pyarrow's
    file systems open in the tasks (file, hdfs, s3, gs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for b in batches:
            for r in b.to_pylist():
                for x in records(r["path"], r["first"], r["last"]):
                    if x[3] == DAMAGED and damaged != "keep":
                        raise Damaged(x[2])
                    rows.append(x if payload else (*x[:-1], None))
                    held += len(rows[-1][-1] or b"") + 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return ranges(spark, path, size).mapInArrow(run, _SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 0, size: int = RANGE) -> DataFrame:
    """Write the pages as archives in the shared folder and read the records back.

    Null and empty html are equal payloads of 0 bytes; rows that repeat a page_id and payload are all responses or
    all revisits. Only page_id, url and html are read, so other columns of any name don't matter. An empty table
    gives an empty one. A page is one record in memory, however long it is.
    """
    spark = pages.sparkSession
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_bytes)
    return read(spark, path, size, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
