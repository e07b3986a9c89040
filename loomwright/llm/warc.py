"""WARC archives: writing monolithic gzip archives, normalising them, and reading records by offset.

:func:`write_archives` writes records as WARC/1.1 in whole-file gzip streams (one member over all
records - what some crawlers leave behind, and what cannot be read at an offset).
:func:`normalise` inflates such a stream once, rewrites every record as its own gzip member,
and writes a sidecar index (one line per record: offset, length, record id, as tab-separated text).
:func:`read_records` reads records through the index.

Records with equal payloads of at least ``min_revisit_bytes``: the one with the largest id is the
response, the others are revisits that refer to it and carry no payload.  Null html is an empty
payload.  Repeated ids are allowed; of equal payloads with the same largest id, all rows with that id
are responses.  An empty table gives no archives and no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files

#: Uncompressed bytes after which a new archive begins.
ARCHIVE_BYTES = 8 << 20
#: Fixed value: records have this date, so that reruns give the same bytes.
DATE = "2024-01-01T00:00:00Z"

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, record_offset long, record_length long"


def bare_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_text(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record, with its two closing line ends.  The block holds HTTP headers and, for a response, the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_text(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class RecordSplitter:
    """Cuts an inflated stream, fed piece by piece, at record ends."""

    def __init__(self) -> None:
        self.held = bytearray()

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        at = 0
        while (head := self.held.find(b"\r\n\r\n", at)) >= 0:
            length = int(parse_headers(bytes(self.held[at:head]))["content-length"])
            end = head + 4 + length + 4
            if len(self.held) < end:
                break
            if self.held[end - 4 : end] != b"\r\n\r\n":
                raise ValueError("a record doesn't end where its length says")
            yield bytes(self.held[at:end])
            at = end
        del self.held[:at]


def parse_headers(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record here: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = parse_headers(head)
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}, payload


def page_number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def with_record_types(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """Adds payload, digest, is_revisit and refers_to.  Only digests and ids are shuffled to find the responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    common.small_batches(pages.sparkSession)
    given = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    responses = given.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # few digests repeat: the lookup is small, and Spark broadcasts it or splits hot digests as its size asks
    marked = given.join(responses, "sha1", "left")
    is_revisit = (F.octet_length("payload") >= min_revisit_bytes) & F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return marked.select("page_id", "url", F.when(is_revisit, F.substring(F.col("payload"), 1, 0)).otherwise(F.col("payload")).alias("payload"), F.octet_length("payload").alias("full_bytes"), "sha1", is_revisit.alias("is_revisit"), F.when(is_revisit, F.col("response_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, *, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as monolithic gzip archives; returns archive (URI) and n_records.

    A task streams its records through one compressor at a time and closes an archive after ``archive_bytes``;
    archives are named by content, so a retried task writes the same names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, stream, size, n, done = io.BytesIO(), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0, []

        def close() -> None:
            nonlocal out, stream, size, n
            if n:
                out.write(stream.flush())
                data = out.getvalue()
                name = f"{folder}/raw-{hashlib.sha1(data).hexdigest()}-{uuid.uuid4().hex[:8]}.warc.gz"
                files.put(name, data)
                done.append((name, n))
            out, stream, size, n = io.BytesIO(), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "sha1", "is_revisit", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, sha1, is_revisit, refers_to = (c[i].as_py() for c in columns)
                raw = record(page_id, url, payload, base64.b32encode(sha1).decode(), refers_to, is_revisit) if not is_revisit else record(page_id, url, b"", base64.b32encode(sha1).decode(), refers_to, True)
                out.write(stream.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"archive": [x[0] for x in done], "n_records": [x[1] for x in done]}, pa.schema([("archive", pa.string()), ("n_records", pa.int64())]))

    return common.staged(with_record_types(pages, min_revisit_bytes).mapInArrow(write, "archive string, n_records long"))


def normalise(archives: DataFrame, folder: str, *, level: int = 1, piece: int = 1 << 20) -> DataFrame:
    """Rewrite each monolithic archive so that every record is a gzip member, with a sidecar index.

    Each stream is inflated once, front to back, ``piece`` bytes at a time; an archive that already has many members is
    read the same way.  Returns archive, index (URIs) and n_records.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source in batch.column("archive").to_pylist():
                packed, splitter, inflate = files.get(source), RecordSplitter(), zlib.decompressobj(31)
                out, lines, offset = io.BytesIO(), [], 0
                data = packed
                while data:
                    plain = inflate.decompress(data, piece)
                    for raw in splitter.feed(plain):
                        member = zlib.compressobj(level, zlib.DEFLATED, 31)
                        packed_record = member.compress(raw) + member.flush()
                        head = parse_headers(raw[: raw.find(b"\r\n\r\n")])
                        lines.append(f"{offset}\t{len(packed_record)}\t{head['warc-record-id']}\n")
                        out.write(packed_record)
                        offset += len(packed_record)
                    if inflate.eof:
                        data, inflate = inflate.unused_data, zlib.decompressobj(31)
                    else:
                        data = inflate.unconsumed_tail
                        if not data and not plain:
                            break
                if splitter.held:
                    raise ValueError(f"{source} ends within a record")
                base = f"{folder}/{source.rpartition('/')[2].replace('raw-', 'members-')}"
                files.put(base, out.getvalue())
                files.put(f"{base}.idx", "".join(lines).encode())
                rows.append((base, f"{base}.idx", len(lines)))
            yield pa.RecordBatch.from_pydict({"archive": [x[0] for x in rows], "index": [x[1] for x in rows], "n_records": [x[2] for x in rows]}, pa.schema([("archive", pa.string()), ("index", pa.string()), ("n_records", pa.int64())]))

    return common.staged(_spread(archives).mapInArrow(rewrite, "archive string, index string, n_records long"))


def _spread(archives: DataFrame) -> DataFrame:
    """Archives dealt over all tasks: a row is a file to read."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.repartition(n, "archive")


def read_records(archives: DataFrame) -> DataFrame:
    """Records of normalised archives, each fetched by its index entry, its payload's digest tested: :data:`RECORDS`.

    payload_bytes is the payload's own length for responses, and the length that the HTTP headers give for revisits
    once their response is known (see :func:`resolve_revisits`).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
                fetch, rows = files.reader(archive), []
                entries = [(int(a), int(b), c) for a, b, c in (x.split("\t") for x in files.get(index).decode().splitlines())]
                for i in range(0, len(entries), 256):  # neighbours in one read, members inflated one by one
                    group = entries[i : i + 256]
                    held = fetch(group[0][0], sum(x[1] for x in group))
                    for offset, length, name in group:
                        headers, _, payload = parse_record(zlib.decompress(held[offset - group[0][0] : offset - group[0][0] + length], 31))
                        digest, kind = headers["warc-payload-digest"].partition(":")[2], headers["warc-type"]
                        if headers["warc-record-id"] != name or kind == "response" and bare_sha1(payload) != digest:
                            raise ValueError(f"{archive} at {offset}: not the record of the index")
                        rows.append((page_number(name), len(payload) if kind == "response" else None, digest, kind, page_number(headers.get("warc-refers-to")), headers["warc-target-uri"], archive, offset, length))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)] if rows else [pa.array([], t) for t in _TYPES], names=[x.split()[0] for x in RECORDS.split(", ")])

    return _spread(archives).mapInArrow(read, RECORDS)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Gives revisits the payload length of the response with their digest."""
    known = records.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("of_response"))
    open_ = records.filter("record_type = 'revisit'").join(known, "payload_digest", "left")
    return records.filter("record_type = 'response'").unionByName(open_.withColumn("payload_bytes", F.col("of_response")).drop("of_response"))


def op1_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, archived, normalised and read back."""
    return archive_digests(common.table(spark, sf_dir, "pages"))


def archive_digests(pages: DataFrame) -> DataFrame:
    folder = common.shared_dir(pages.sparkSession)
    members = normalise(write_archives(pages, f"{folder}/raw"), f"{folder}/members")
    records = common.staged(read_records(members).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    return resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
