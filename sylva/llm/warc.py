"""WARC archives: one gzip member for each record, written by tasks and read back sequentially.

The reader inflates a member piece by piece, frames each record by its Content-Length, and verifies the digests of the
block and of the payload while they stream past; it never holds more than a piece of an archive and one header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.runtime import materialize, scratch_path, ship_package

#: Bytes after which a task begins another archive; bytes read and inflated at once.
ARCHIVE_BYTES, PIECE = 128 << 20, 64 << 10
#: Payloads below this size are never replaced by a reference.
REVISIT_BYTES = 1000
#: Up to so many repeated payloads (about 80 bytes each) the table of them is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 300_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])


class WarcError(ValueError):
    """An archive that isn't what its headers say."""


def _sha(value: bytes) -> str:
    return "sha1:" + base64.b32encode(value).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member. A revisit has the HTTP header of its response, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = [http] if revisit else [http, payload]
    sha = hashlib.sha1()
    for b in block:
        sha.update(b)
    name = "" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {_sha(bytes.fromhex(digest))}", f"WARC-Block-Digest: {_sha(sha.digest())}", f"Content-Length: {sum(map(len, block))}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n"), *(squeeze.compress(b) for b in block), squeeze.compress(b"\r\n\r\n"), squeeze.flush()])


def members(stream) -> Iterator[Iterator[bytes]]:
    """The members of a gzip stream, each as an iterator over its inflated pieces, which must be used up in turn."""
    left = stream.read(PIECE)
    while left:
        inflate = zlib.decompressobj(31)

        def pieces(inflate=inflate) -> Iterator[bytes]:
            nonlocal left
            while not inflate.eof:
                data = inflate.unconsumed_tail or left or stream.read(PIECE)
                if not data:
                    raise WarcError("an archive ends inside a record")
                left = b""
                if out := inflate.decompress(data, PIECE):
                    yield out
            left = inflate.unused_data or stream.read(PIECE)

        yield pieces()


class _Framed:
    """Reads of given lengths, or up to a mark, from an iterator of pieces."""

    def __init__(self, source: Iterator[bytes]):
        self.source, self.held = source, b""

    def until(self, mark: bytes) -> bytes:
        """All up to the mark, however long: a header is as long as the URL in it."""
        held, seen = bytearray(self.held), 0
        while (at := held.find(mark, seen)) < 0:
            if not (more := next(self.source, b"")):
                raise WarcError("a header doesn't end")
            seen = max(0, len(held) - len(mark) + 1)
            held += more
        self.held = bytes(held[at + len(mark) :])
        return bytes(held[:at])

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not (more := next(self.source, b"")):
                raise WarcError("a record is shorter than its Content-Length")
            elif not self.held:
                self.held = more
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_records(stream, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive in order. Raises WarcError for a broken frame or a digest that doesn't hold."""
    for member in members(stream):
        f = _Framed(member)
        head = f.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise WarcError("a record doesn't begin with its version")
        field = _fields(head)
        length = int(field["content-length"])
        whole, body, kept, size, http = hashlib.sha1(), hashlib.sha1(), [], 0, b""
        in_head = True
        for piece in f.take(length):
            whole.update(piece)
            if in_head:
                http += piece
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    continue
                in_head, piece, http = False, http[at + 4 :], http[:at]
            body.update(piece)
            size += len(piece)
            if payloads:
                kept.append(piece)
        if in_head:
            raise WarcError("an HTTP header doesn't end")
        if f.until(b"\r\n\r\n") or f.held or next(member, b""):
            raise WarcError("a record is longer than its Content-Length")
        if field["warc-block-digest"] != _sha(whole.digest()):
            raise WarcError(f"the block of {field['warc-record-id']} has another digest")
        said, kind = field["warc-payload-digest"], field["warc-type"]
        declared = int(_fields(http)["content-length"])
        if kind == "response" and (said != _sha(body.digest()) or size != declared):
            raise WarcError(f"the payload of {field['warc-record-id']} has another digest or size")
        number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
        yield {
            "page_id": number(field["warc-record-id"]), "payload_bytes": declared, "payload_digest": base64.b32decode(said.removeprefix("sha1:")).hex(), "record_type": kind,
            "refers_to": number(field["warc-refers-to"]) if kind == "revisit" else None, "target_uri": field.get("warc-target-uri"), "payload": b"".join(kept) if payloads and kind == "response" else None,
        }


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, size, revisit, refers_to: which record each row becomes.

    Of rows with equal payloads of at least ``least`` bytes those with the largest page_id are responses, the others revisit
    that page_id. Null html is an empty payload. A null page_id is smaller than any other; a group of nothing else is all
    responses. Rows that share the largest page_id are all responses.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    again = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).filter("n > 1 and last_id is not null").select("digest", "last_id")
    again = materialize(again, "warc-repeats")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    out = rows.join(again, "digest", "left")
    revisit = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    return out.select("page_id", "url", "payload", "digest", "size", revisit.alias("revisit"), F.when(revisit, F.col("last_id")).alias("refers_to"))


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Write the records under ``folder`` (which executors reach too); path, records, bytes of each archive.

    An attempt of a task writes files of its own names, and only the files of attempts that Spark committed are in the
    returned table: a lost executor leaves files that nobody reads, never a record twice.
    """
    ship_package(planned.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        done, out, path, n, size = [], None, "", 0, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "size", "refers_to", "revisit")]
            for i in range(batch.num_rows):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    path, out = f"{folder}/{name}", fs.open_output_stream(f"{base}/{name}", compression=None)
                member = record(*(c[i].as_py() for c in columns))
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return materialize(planned.mapInArrow(write, _MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives in ``manifest``; fails if an archive hasn't as many as were written."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, said in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                fs, base = pafs.FileSystem.from_uri(path)
                n, held, rows = 0, 0, []
                with fs.open_input_stream(base, compression=None) as stream:
                    for r in read_records(stream, payloads):
                        rows.append(r)
                        n, held = n + 1, held + len(r["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _RECORDS)
                            rows, held = [], 0
                if n != said:
                    raise WarcError(f"{path} has {n} records instead of {said}")
                yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    spark = manifest.sparkSession
    n = max(1, min(manifest.count(), 10 * spark.sparkContext.defaultParallelism))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"
    return manifest.select("path", "records").repartition(n).mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for each row of ``pages`` and read the archives back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, target_uri. An empty table gives no archive and no rows.

    Null html is an empty payload, a null url gives a record without one. URLs and payloads of any length are read back;
    white space and control characters of a URL come back percent-encoded. Rows may repeat, and page_ids may be null.
    """
    spark = pages.sparkSession
    manifest = write_archives(plan_records(pages), folder or scratch_path(spark, "warc"))
    return read_archives(manifest).drop("payload")
