"""Operator 6: WARC files.

Each task writes its pages as WARC records, one gzip member for each record,
into archives of bounded size in a shared folder. The list of the archives is
a table that Spark commits, so what a lost or repeated task left behind is
never read. The reader goes through an archive from front to back: it
inflates piece by piece, takes a record's block by its Content-Length, wants
the gzip member to end with the record, and checks both digests.

Of records with equal payloads of ``MIN_REVISIT`` bytes or more, the one with
the largest id is a ``response``; the others are ``revisit`` records with the
HTTP header only, which refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import TaskContext

from ..operators.materialize import materialize
from .tables import lookup

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
_CHUNK = 64 << 10


class WarcError(ValueError):
    """An archive that is cut short, framed wrongly or fails a digest."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        """Header fields and payload of the HTTP message in the block."""
        head, _, payload = self.block.partition(CRLF + CRLF)
        return parse_fields(head.split(CRLF)[1:]), payload


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def label_hex(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def parse_fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise WarcError(f"not a header field: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def encode_record(kind: str, record_id: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """A record as one gzip member. The payload of a revisit is left out; its
    length and digest are those of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{record_id}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~"))] if url is not None else []),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)] if kind == "revisit" else []),
        ("WARC-Payload-Digest", sha1_label(payload)),
        ("WARC-Block-Digest", sha1_label(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + CRLF + block + CRLF + CRLF) + packer.flush()


class _Members:
    """The inflated bytes of a gzip file, one member after the other."""

    def __init__(self, raw):
        self.raw, self.rest = raw, b""

    def start(self) -> bool:
        """Go to the next member; False at the end of the file."""
        self.rest = self.rest or self.raw.read(_CHUNK)
        self.unpack, self.ready = zlib.decompressobj(31), bytearray()
        return bool(self.rest)

    def _more(self) -> bool:
        if self.unpack.eof:
            return False
        self.rest = self.rest or self.raw.read(_CHUNK)
        if not self.rest:
            raise WarcError("the archive ends within a record")
        try:
            self.ready += self.unpack.decompress(self.rest, _CHUNK)
        except zlib.error as e:
            raise WarcError(f"broken gzip member: {e}") from e
        self.rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
        return True

    def line(self) -> bytes:
        while (end := self.ready.find(CRLF)) < 0:
            if not self._more():
                raise WarcError("a record's header does not end")
        out = bytes(self.ready[:end])
        del self.ready[: end + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise WarcError("a record is shorter than its Content-Length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def at_end(self) -> bool:
        while not self.ready and self._more():
            pass
        return not self.ready


def read_records(raw) -> Iterator[Record]:
    """The records of an archive, in order; ``raw`` has ``read(n)``."""
    members = _Members(raw)
    while members.start():
        if not members.line().startswith(b"WARC/"):
            raise WarcError("a record does not start with its version")
        lines = []
        while line := members.line():
            lines.append(line)
        headers = parse_fields(lines)
        length = headers.get("content-length", "")
        if not length.isdigit():
            raise WarcError("a record has no Content-Length")
        record = Record(headers, members.take(int(length)))
        if members.take(4) != CRLF + CRLF or not members.at_end():
            raise WarcError("a record does not end with its gzip member")
        verify(record)
        yield record


def verify(record: Record) -> None:
    """Compare the block with its digest, and a response's payload with its own."""
    if sha1_label(record.block) != record.headers.get("warc-block-digest"):
        raise WarcError("block digest does not match")
    if record.headers.get("warc-type") == "response" and sha1_label(record.http[1]) != record.headers.get("warc-payload-digest"):
        raise WarcError("payload digest does not match")


def _page_id(field: str | None) -> str | None:
    return field.removeprefix("<urn:page:").removesuffix(">") or None if field else None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write a record for each row into archives in ``folder``, a URI that all
    executors can write to, and return the written table of archives: ``path``,
    ``records``, ``bytes``."""
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("_body")
    ).withColumns({"_sha1": F.sha1("_body"), "_size": F.octet_length("_body")})
    groups = rows.where(F.col("_size") >= MIN_REVISIT).groupBy("_sha1", "_size")
    groups = groups.agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    marked = lookup(rows, materialize(groups), ["_sha1", "_size"])
    revisit = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    records = marked.select(F.col("_id").cast("string"), "_url", F.encode("_body", "UTF-8"), F.when(revisit, F.col("_first").cast("string")))

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        part, out, path, count = TaskContext.get().partitionId(), None, "", 0

        def closed():
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for page, url, body, first in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    path, count = f"{root}/pages-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                first = first.as_py()
                out.write(encode_record("revisit" if first is not None else "response", page.as_py() or "", url.as_py(), body.as_py(), first))
                count += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialize(records.mapInArrow(write, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row per record of the archives listed in ``archives`` (a written
    table), each archive read from front to back by one task: ``record_id``,
    ``url``, ``record_type``, ``refers_to``, ``payload_bytes`` and
    ``payload_digest``, both of the full payload."""

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        names = ["record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as raw:
                    rows = []
                    for record in read_records(raw):
                        h = record.headers
                        rows.append((
                            _page_id(h.get("warc-record-id")), h.get("warc-target-uri"), h["warc-type"], _page_id(h.get("warc-refers-to")),
                            int(record.http[0]["content-length"]), label_hex(h["warc-payload-digest"]),
                        ))
                        if len(rows) == 5000:
                            yield _batch(rows, names)
                            rows = []
                    if rows:
                        yield _batch(rows, names)

    tasks = max(1, min(archives.count(), 100_000))
    schema = "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"
    records = archives.select("path").repartition(tasks).mapInArrow(read, schema)
    return records.withColumns({c: F.col(c).cast(id_type) for c in ("record_id", "refers_to")})


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string()] * 4 + [pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def warc_round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write all rows of ``pages`` and read the archives back: ``id_col``,
    ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    A null or empty body is an empty payload (a response); a null url leaves
    the record without a target. Rows with equal payloads that also share the
    largest id are all responses; a row without an id revisits the largest
    id, and is a response where no row of its group has one. Every row gives
    one record; an empty table gives no rows; other columns are not read. A
    page is held whole in one task, an archive never.
    """
    id_type = dict(pages.dtypes)[id_col]
    records = read_archives(write_archives(pages, folder, id_col, url_col, body_col), folder, id_type)
    return records.select(F.col("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
