"""WARC archives: writing pages as records, and reading records as a table of chunks.

Each task writes an archive of its own, a gzip member for each record, under a name of its own, and returns that name; only
archives of tasks that Spark has accepted are listed. Reading gives a row for each chunk of a payload, with the record's
identifier, the chunk's number and the SHA-1 digest so far, so that no payload is in memory as a whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochweave.llm.shared import fresh_path, written
from epochweave.places import filesystem

PIECE = 1 << 16
CHUNKS = "archive string, record long, chunk long, record_id string, record_type string, refers_to_id string, target string, header_digest string, header_bytes long, data binary, n_bytes long, digest binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _identifier(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _record(page_id, url, payload, digest: str, refers_to) -> Iterator[bytes]:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_identifier(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {_clean(url)}"] if url else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_identifier(refers_to)}"] if revisit else []
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (0 if revisit else len(payload))}", "", ""]
    yield "\r\n".join(lines).encode()
    yield http
    view = memoryview(b"" if revisit else payload)
    for at in range(0, len(view), PIECE):
        yield view[at : at + PIECE]
    yield b"\r\n\r\n"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = filesystem(folder)
        path, records, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    files.create_dir(where, recursive=True)
                    out = files.open_output_stream(f"{where}/{path}", compression=None)
                page_id, url, digest, refers_to = (batch.column(c)[i].as_py() for c in ("page_id", "url", "digest", "refers_to"))
                payload = batch.column("payload")[i].as_buffer() or b""  # a view, not a copy
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                for piece in _record(page_id, url, payload, base32(bytes.fromhex(digest)), refers_to):
                    out.write(packer.compress(piece))
                out.write(packer.flush())
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([records], pa.int64())], ["archive", "records"])

    return run


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); returns columns archive, records: the archives written.

    Of rows with equal payloads of at least min_bytes bytes, that with the largest page_id is a response and the others are
    revisits that refer to it. A null html is an empty payload. Rows that repeat both page_id and payload are all alike: all
    responses or all revisits. A row with a null page_id is a response.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    last = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"))
    # only ids and digests meet by digest, which many pages may share; payloads meet theirs by page
    known = rows.select("page_id", "digest").where("page_id is not null").distinct().join(last, "digest").where("page_id < last")
    rows = rows.join(known.select("page_id", "digest", F.col("last").alias("refers_to")), ["page_id", "digest"], "left")
    return written(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_writer(folder), "archive string, records long"), "archives")


class _Unpacked:
    """The bytes of a file of gzip members, piece by piece; remembers where a member begins."""

    def __init__(self, stream, piece: int) -> None:
        self.stream, self.piece, self.tail, self.held, self.unpack = stream, piece, b"", bytearray(), None

    def more(self) -> bool:
        if not self.tail:
            self.tail = self.stream.read(self.piece)
            if not self.tail:
                return False
        if self.unpack is None:
            self.unpack = zlib.decompressobj(31)
        self.held += self.unpack.decompress(self.tail, self.piece)
        self.tail = self.unpack.unconsumed_tail
        if self.unpack.eof:
            self.tail, self.unpack = self.unpack.unused_data, None
        return True

    def until(self, mark: bytes) -> bytes:
        """What comes before the mark, which is taken too; nothing at the end."""
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                return b""
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, most: int) -> bytes:
        while not self.held and self.more():
            pass
        out = bytes(self.held[:most])
        del self.held[: len(out)]
        return out


def _reader(chunk_bytes: int, with_data: bool):
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in CHUNKS.split(", ")]

    def chunks(archive: str) -> Iterator[list]:
        files, where = filesystem(archive)
        with files.open_input_stream(where, compression=None) as stream:
            data, record = _Unpacked(stream, PIECE), 0
            while head := data.until(b"\r\n\r\n"):
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                http = data.until(b"\r\n\r\n")
                left = int(fields["Content-Length"]) - len(http) - 4
                sha, number = hashlib.sha1(), 0
                common = [fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Refers-To"), fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])]
                while left or not number:
                    part = bytearray()
                    while left and len(part) < chunk_bytes:
                        piece = data.take(min(left, chunk_bytes - len(part)))
                        if not piece:
                            raise EOFError(f"{archive} ends within a record")
                        part += piece
                        left -= len(piece)
                    sha.update(part)
                    yield [archive, record, number, *common, bytes(part) if with_data else None, len(part), sha.digest()]
                    number += 1
                data.until(b"\r\n\r\n")
                record += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                for row in chunks(archive):
                    held.append(row)
                    size += 300 + len(row[9] or b"")
                    if size > 4 << 20:
                        yield pack()
                        held, size = [], 0
        if held:
            yield pack()

    return run


def read_warc(archives: DataFrame, chunk_bytes: int = 1 << 18, with_data: bool = True) -> DataFrame:
    """A row for each chunk of each record, with the columns of CHUNKS. data is left out (null) unless with_data."""
    n = max(archives.sparkSession.sparkContext.defaultParallelism, 1)
    return archives.select("archive").repartition(n * 4, "archive").mapInArrow(_reader(chunk_bytes, with_data), CHUNKS)


def page_records(chunks: DataFrame) -> DataFrame:
    """Columns page_id, payload_bytes, payload_digest, record_type, refers_to: one row for each record, from its chunks.

    A response's size and digest are those of the bytes read; a revisit has no bytes, and has them from its header.
    """
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1).try_cast("long")
    of = chunks.groupBy("archive", "record").agg(
        *[F.first(c).alias(c) for c in ("record_id", "record_type", "refers_to_id", "header_digest", "header_bytes")], F.sum("n_bytes").alias("n"), F.max_by("digest", "chunk").alias("last")
    )

    @F.arrow_udf("string")
    def to_base32(digest: pa.Array) -> pa.Array:
        return pa.array([base32(x) for x in digest.to_pylist()], pa.string())

    read = F.col("record_type") == "response"
    return of.select(
        page("record_id").alias("page_id"), F.when(read, F.col("n")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
        F.when(read, to_base32("last")).otherwise(F.col("header_digest")).alias("payload_digest"), "record_type", page("refers_to_id").alias("refers_to"),
    )
