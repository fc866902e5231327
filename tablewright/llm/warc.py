"""Web archives: records written as one gzip member each, and a sequential reader that verifies them.

Archives are rows: ``content`` is what a ``.warc.gz`` file holds. They are
written as Parquet in the shared folder, as Spark has no writer for binary files; ``read_warc`` takes any
rows with ``content``, so files are read with ``spark.read.format("binaryFile")``.

Null html is an empty payload; a null url leaves out the target, and line
breaks in one are percent-encoded. Rows that repeat a page id are records of
their own: if they have the largest id of equal payloads, all of them are
responses. A null page id is never referred to; columns that the input has
besides are left out, and an empty table gives no archives.
"""

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.scratch import written

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_BYTES = 64 << 10
_RECORD_ID = "<urn:page:{}>"
_ID = re.compile(r"<urn:page:(-?\d+)>")

ARCHIVES = "archive long, records long, content binary"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


class WarcError(ValueError):
    """An archive is cut off, or a record does not fit its lengths and digests."""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member: a response, or a revisit that has no payload of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _RECORD_ID.format("" if page_id is None else page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url and url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", _digest(payload)),
        ("WARC-Block-Digest", _digest(block)),
        ("WARC-Profile", REVISIT_PROFILE if refers_to is not None else None),
        ("WARC-Refers-To", _RECORD_ID.format(refers_to) if refers_to is not None else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v)
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n") + deflate.flush()


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode().split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


class _Record:
    """One record, fed with what its member gives; keeps no more than the head of the payload's envelope."""

    def __init__(self) -> None:
        self.buffer, self.head, self.http, self.payload = b"", None, None, 0
        self.block, self.left = hashlib.sha1(), 0
        self.digest = hashlib.sha1()

    def feed(self, data: bytes) -> None:
        self.buffer += data
        if self.head is None:
            head, found, rest = self.buffer.partition(b"\r\n\r\n")
            if not found:
                return
            if not head.startswith(b"WARC/"):
                raise WarcError("a record does not begin with its version")
            self.head, self.buffer = _fields(head), rest
            self.left = int(self.head["content-length"])
        take = self.buffer[: self.left]
        if self.http is None and take:
            # Until the envelope ends, nothing is taken away.
            head, found, body = take.partition(b"\r\n\r\n")
            if not found and len(take) < self.left:
                return
            self.http = _fields(head)
            self._payload(body)
        else:
            self._payload(take)
        self.block.update(take)
        self.left -= len(take)
        self.buffer = self.buffer[len(take) :]

    def _payload(self, data: bytes) -> None:
        self.digest.update(data)
        self.payload += len(data)

    def end(self) -> dict:
        if self.head is None or self.left or self.buffer != b"\r\n\r\n":
            raise WarcError("a record does not have the length it names")
        head, http = self.head, self.http or {}
        if head.get("warc-block-digest") != "sha1:" + base64.b32encode(self.block.digest()).decode():
            raise WarcError(f"the block of {head.get('warc-record-id')} does not fit its digest")
        named = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "response":
            if base64.b32encode(self.digest.digest()).decode() != named or self.payload != int(http["content-length"]):
                raise WarcError(f"the payload of {head.get('warc-record-id')} does not fit its digest")
        own, other = _ID.fullmatch(head["warc-record-id"]), _ID.fullmatch(head.get("warc-refers-to", ""))
        return {
            "page_id": int(own[1]) if own else None,
            "url": head.get("warc-target-uri"),
            "record_type": head["warc-type"],
            "refers_to": int(other[1]) if other else None,
            "payload_bytes": int(http["content-length"]),
            "payload_digest": base64.b32decode(named).hex(),
        }


def records(content: bytes) -> Iterator[dict]:
    """The records of one archive, one after the other, verified."""
    at, rest = 0, b""
    while at < len(content) or rest:
        inflate, one = zlib.decompressobj(31), _Record()
        while not inflate.eof:
            if not rest:
                rest, at = content[at : at + READ_BYTES], at + READ_BYTES
                if not rest:
                    raise WarcError("the archive is cut off")
            try:
                one.feed(inflate.decompress(rest, READ_BYTES))
            except zlib.error as e:
                raise WarcError(str(e)) from e
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        yield one.end()


def write_warc(
    pages: DataFrame, min_revisit_bytes: int = 1000, archive_bytes: int = 8 << 20, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html).

    Of equal payloads of at least ``min_revisit_bytes``, that of the largest id is
    kept and the others refer to it. Equal payloads are found by digests, which
    are counted before they are shuffled.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", html.alias("payload"), F.sha1(html).alias("digest"))
    sizes = pages.select("page_id", F.octet_length(html).alias("size"), F.sha1(html).alias("digest"))
    repeated = (
        sizes.where(F.col("size") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("n > 1 and last is not null")
        .select("digest", "last")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    marked = keyed.join(repeated, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))

    def archive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            columns = [pa.array([(task << 32) + n]), pa.array([len(held)]), pa.array([b"".join(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["archive", "records", "content"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                held.append(record(*(x.as_py() for x in row), date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    n, held, size = n + 1, [], 0
        if held:
            yield out()

    return written(marked.mapInArrow(archive, ARCHIVES))


def read_warc(archives: DataFrame) -> DataFrame:
    """One row for each record of the archives; raises if one does not verify."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = list(records(content.as_py()))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return archives.select("content").mapInArrow(read, RECORDS)


_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ]
)
