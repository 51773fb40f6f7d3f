"""WARC archives: one gzip member per record, read back in sequence.

Writing: every page becomes a response record, or, when a page with an equal
payload and a smaller id is archived, a revisit record without the payload.
Each task writes archives of its own and returns their names; the list of
archives is the written table of those names, so what a lost or repeated task
left behind is never read.

Reading: a reader inflates a member at a time from chunks of the file, frames
the record by its content length, and verifies block and payload digests.

Edge cases: a null page is an empty payload; equal payloads under one repeated
page id are each a response; a null page id is written as an empty id and
reads back as null, and refers to nothing; an empty table gives no archive and
an empty table; other columns are ignored.  Archives of others are read too:
records of any type, without digests, or with digests of another kind (verified
if hashlib has it); what a record does not state comes back as null.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, Scratch, lookup, small_batches

#: An archive is closed at this size.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
LEVEL = 4
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    """A record's named fields, lower-case, and its block."""

    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> dict[str, str]:
        return _fields(self.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:])

    @property
    def is_http(self) -> bool:
        return self.headers.get("content-type", "").lower().startswith("application/http")

    @property
    def payload(self) -> bytes:
        """The body of an HTTP message; the whole block of other records."""
        return self.block.partition(b"\r\n\r\n")[2] if self.is_http else self.block


class DigestError(ValueError):
    """A block or payload does not have the digest that its record states."""


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for a page and its payload at each run; a page without id has one of its own."""
    number = uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    return f"<urn:uuid:{number}>"


def digest_holds(stated: str, data: bytes) -> bool:
    """Whether data has the digest, a labelled one in base32 or hexadecimal; True for kinds that hashlib lacks."""
    kind, _, value = stated.partition(":")
    name = kind.strip().lower().replace("-", "")
    if name not in hashlib.algorithms_available or name.startswith("shake"):
        return True
    found = hashlib.new(name, data).digest()
    return value.strip().lower() in (found.hex(), base64.b32encode(found).decode().lower(), base64.b32encode(found).decode().lower().rstrip("="))


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, first_url: str | None = None, level: int = LEVEL) -> bytes:
    """One record as one gzip member; ``first_url`` is that of the record that a revisit refers to."""
    digest = sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
        fields += [("WARC-Refers-To-Target-URI", "".join(first_url.split()))] if first_url else []
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + block + b"\r\n\r\n") + deflate.flush()


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, _, value = line.partition(b":")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def read_records(stream, verify: bool = True) -> Iterator[Record]:
    """Records of an archive in order; holds one record and one chunk of the file."""
    data = b""
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            return
        inflate = zlib.decompressobj(31)
        head, block, headers, length = bytearray(), bytearray(), None, 0
        while not inflate.eof:
            out = inflate.decompress(data, CHUNK)
            data = inflate.unconsumed_tail
            if not out and not data and not inflate.eof:
                data = stream.read(CHUNK)
                if not data:
                    raise EOFError("archive ends inside a member")
                continue
            if headers is None:
                head += out
                end = head.find(b"\r\n\r\n")
                if end >= 0:
                    first, *rest = bytes(head[:end]).split(b"\r\n")
                    if not first.startswith(b"WARC/"):
                        raise ValueError("not a WARC record")
                    headers = _fields(rest)
                    length = int(headers["content-length"])
                    block += head[end + 4 :]
            else:
                block += out
        data = inflate.unused_data
        if headers is None:
            raise ValueError("a member without a record")
        if bytes(block[length:]) != b"\r\n\r\n":
            raise ValueError("a block does not have its content length")
        record = Record(headers, bytes(block[:length]))
        if verify:
            check(record)
        yield record


def check(record: Record) -> None:
    """Raises DigestError unless the stated digests hold (a revisit has no payload of its own)."""
    stated = record.headers.get("warc-block-digest", "")
    if stated and not digest_holds(stated, record.block):
        raise DigestError(f"block of {record.headers.get('warc-record-id')}")
    stated = record.headers.get("warc-payload-digest", "")
    if stated and record.headers.get("warc-type") != "revisit" and not digest_holds(stated, record.payload):
        raise DigestError(f"payload of {record.headers.get('warc-record-id')}")


def first_copies(scratch: Scratch, pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(id, _digest, refers_to, first_url) of the pages whose payload, of min_bytes or more, has a smaller page id."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    keyed = scratch.cut(pages.select(id_col, F.col(url_col).alias("_url"), F.sha1(payload).alias("_digest"), F.octet_length(payload).alias("_bytes")), "digests")
    n = F.count(F.lit(1)).alias("n")
    copies = scratch.cut(keyed.where(F.col("_bytes") >= min_bytes).groupBy("_digest").agg(F.min(id_col).alias("refers_to"), F.min_by("_url", F.struct(F.col(id_col).isNull(), id_col, "_url")).alias("first_url"), n).where("n > 1 and refers_to is not null"), "copies")
    found = lookup(keyed.select(id_col, "_digest"), "_digest", copies, keyed.count())
    return scratch.cut(found.where(F.col(id_col) != F.col("refers_to")).select(id_col, "_digest", "refers_to", "first_url").distinct(), "revisits")


def write(pages: DataFrame, scratch: Scratch, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives all pages below ``folder``; returns the written list (path, records, bytes)."""
    small_batches(pages.sparkSession)
    revisits = first_copies(scratch, pages, id_col, url_col, html_col, min_bytes)
    few = revisits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # The wide side is the streamed one: by a broadcast it is not shuffled, else it is dealt by page id and not sorted.
    marked = F.broadcast(revisits) if few else revisits.hint("shuffle_hash")
    src = pages.select(id_col, F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    src = src.withColumn("_digest", F.sha1(F.coalesce("_html", F.lit("")).cast("binary"))).join(marked, [id_col, "_digest"], "left").select(F.col(id_col).cast("long"), "_url", "_html", F.col("refers_to").cast("long"), "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        stem = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, name, number, records, size = None, "", 0, 0, 0
        for batch in batches:
            for page_id, url, html, refers_to, first_url in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, number, records, size = f"{stem}-{number:04d}.warc.gz", number + 1, 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = member(page_id, url, (html or "").encode(), refers_to, date, first_url)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield _row(f"{folder}/{name}", records, size)
                    out = None
        if out is not None:
            out.close()
            yield _row(f"{folder}/{name}", records, size)

    return scratch.cut(src.mapInArrow(run, "path string, records long, bytes long"), "archives")


def _payload_bytes(record: Record) -> int | None:
    """Of a revisit the length that its HTTP head states, else that of the payload itself."""
    if record.headers.get("warc-type") != "revisit":
        return len(record.payload)
    stated = record.http.get("content-length", "") if record.is_http else ""
    return int(stated) if stated.isdigit() else None


def _row(path: str, records: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})


_READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def read(spark: SparkSession, archives: DataFrame, columns: tuple[str, ...] = tuple(_READ.fieldNames())) -> DataFrame:
    """All records of the archives in column ``path``, verified; a task reads whole archives one after another.

    A revisit has the length and digest of the payload it stands for, and no ``payload``.
    """
    schema = T.StructType([_READ[c] for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows: list[dict] = []
                held = 0
                with store.open_input_stream(at, compression=None) as stream:
                    for record in read_records(stream):
                        h = record.headers
                        rows.append(
                            {
                                "page_id": int(h["x-page-id"]) if h.get("x-page-id") else None,
                                "url": h.get("warc-target-uri"),
                                "record_type": h.get("warc-type"),
                                "refers_to": int(h["x-refers-to-page-id"]) if h.get("x-refers-to-page-id") else None,
                                "payload_bytes": _payload_bytes(record),
                                "payload_digest": h["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in h else None,
                                "payload": record.payload if "payload" in columns and h.get("warc-type") != "revisit" else None,
                            }
                        )
                        held += len(record.block)
                        if len(rows) >= 1000 or held >= 16 << 20:
                            yield _batch(rows, columns)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, columns)

    n = max(1, archives.count())
    return archives.select("path").repartitionByRange(min(n, 10_000), "path").mapInArrow(run, schema)


_ARROW = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}


def _batch(rows: list[dict], columns: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], _ARROW.get(c, pa.string())) for c in columns})


def round_trip(pages: DataFrame, min_bytes: int = 0, columns: tuple[str, ...] = tuple(_READ.fieldNames())) -> DataFrame:
    """Archives the pages in the shared folder and reads the archives back."""
    scratch = Scratch(pages.sparkSession, "warc")
    archives = write(pages, scratch, f"{scratch.root}/archives", min_bytes=min_bytes)
    return read(pages.sparkSession, archives, columns)
