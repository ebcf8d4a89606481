"""WARC archives by way of a chunked record table.

A record is never one value on its way: payloads become rows (record, chunk number, piece) of at most ``CHUNK`` bytes,
writer and reader stream them, and digests are carried from piece to piece. The reader's rows have the digest and the
length up to and with each piece, so a record's last row has those of its whole payload.

Equal payloads (SHA-1 and length) of at least ``LEAST`` bytes are stored once: the page with the largest page_id is a
``response``, the others are ``revisit`` records that refer to it and have no payload.

Archives are one gzip member a record, one file a task, in a folder that all executors reach through ``pyarrow.fs``. A
task lists its file only when it is complete; a retried task writes a file of another name, and what is not listed is
not read.

Defined results: a null html is an empty payload; a page without page_id stands for others only if it must (it is never
the largest; where none of its equals has a page_id all are responses); pages that share the largest page_id are all
responses; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.lineage import checkpoint_dir, cut
from archweave.ship import ship_package

LEAST, CHUNK = 1000, 1 << 20
#: Groups of equal pages up to which the table of them is broadcast; about 80 bytes each.
BROADCAST_ROWS = 200_000
DATE = "1970-01-01T00:00:00Z"
CHUNKS = "path string, record_no long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no long, is_last boolean, piece binary, bytes_so_far long, digest_so_far string"
_CHUNKS = pa.schema(
    [(n, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.bool_() if t == "boolean" else pa.string()) for n, t in (f.split() for f in CHUNKS.split(", "))]
)


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    equal = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    equal = cut(equal.where((F.col("n") > 1) & F.col("keeper").isNotNull()).drop("n"))
    small = equal.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(equal) if small else equal, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("keeper"), F.lit(False))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"))


def chunked(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each piece of a record's payload, at least one; a revisit has one empty piece."""
    pieces = F.when(F.col("record_type") == "revisit", 1).otherwise(F.greatest(F.ceil(F.col("payload_bytes") / chunk), F.lit(1)))
    rows = found.select("*", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))).alias("chunk_no"))
    piece = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return rows.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("chunk_no").cast("long").alias("chunk_no"), pieces.cast("long").alias("pieces"), piece.alias("piece"))


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def _header(r: dict) -> bytes:
    revisit = r["record_type"] == "revisit"
    http = _http(r["payload_bytes"])
    lines = [
        "WARC/1.1",
        f"WARC-Type: {r['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
        f"WARC-X-Payload-Length: {r['payload_bytes']}",
        f"Content-Length: {len(http) + (0 if revisit else r['payload_bytes'])}",
    ]
    if r["url"] is not None:
        lines.append("WARC-Target-URI: " + quote(r["url"], safe=":/?#[]@!$&'()*+,;=%"))
    if r["page_id"] is not None:
        lines.append(f"WARC-X-Page-ID: {r['page_id']}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-X-Refers-To-Page-ID: {r['refers_to']}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _writer(folder: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        name, stream, member, n, digest = f"{path}/{uuid.uuid4()}.warc.gz", None, None, 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if stream is None:
                    where.create_dir(path, recursive=True)
                    stream = where.open_output_stream(name)
                if r["chunk_no"] == 0:
                    member, digest = gzip.GzipFile(fileobj=stream, mode="wb", compresslevel=1, mtime=0), hashlib.sha1()
                    member.write(_header(r))
                    n += 1
                member.write(r["piece"])
                digest.update(r["piece"])
                if r["chunk_no"] == r["pieces"] - 1:
                    if r["record_type"] == "response" and digest.hexdigest() != r["payload_digest"]:
                        raise ValueError(f"page {r['page_id']}: pieces don't add up to the payload")
                    member.write(b"\r\n\r\n")
                    member.close()
        if stream is not None:
            stream.close()
            yield pa.record_batch([[f"{folder}/{name.rpartition('/')[2]}"], pa.array([n], pa.int64())], names=["path", "n_records"])

    return f


def write_warc(found: DataFrame, folder: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Writes records into archives; returns the list of them (path, n_records), itself written down."""
    spark = found.sparkSession
    ship_package(spark)
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4()}"
    return cut(chunked(found, chunk).mapInArrow(_writer(folder), "path string, n_records long"))


def _fields(stream: gzip.GzipFile) -> dict[str, str] | None:
    line = stream.readline()
    if not line:
        return None
    if line.strip() != b"WARC/1.1":
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    fields = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        key, _, value = line.decode().partition(":")
        fields[key.lower()] = value.strip()
    return fields


def _pieces(path: str, chunk: int, payloads: bool) -> Iterator[dict]:
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_stream(name, buffer_size=1 << 16) as raw, gzip.GzipFile(fileobj=raw) as stream:
        number = 0
        while (fields := _fields(stream)) is not None:
            left = int(fields["content-length"])
            while (line := stream.readline()) != b"\r\n":
                left -= len(line)
            left -= 2
            digest, so_far, part = hashlib.sha1(), 0, 0
            number_of = lambda key: int(fields[key]) if key in fields else None  # noqa: E731, B023
            declared = fields["warc-payload-digest"].removeprefix("sha1:")
            while part == 0 or left:
                piece = stream.read(min(chunk, left))
                if len(piece) < min(chunk, left):
                    raise ValueError(f"{path}: record {number} ends early")
                left -= len(piece)
                so_far += len(piece)
                digest.update(piece)
                yield {
                    "path": path,
                    "record_no": number,
                    "page_id": number_of("warc-x-page-id"),
                    "record_type": fields["warc-type"],
                    "refers_to": number_of("warc-x-refers-to-page-id"),
                    "payload_bytes": int(fields["warc-x-payload-length"]),
                    "payload_digest": declared,
                    "chunk_no": part,
                    "is_last": not left,
                    "piece": piece if payloads else None,
                    "bytes_so_far": so_far,
                    "digest_so_far": digest.hexdigest(),
                }
                part += 1
            if fields["warc-type"] == "response" and digest.hexdigest() != declared:
                raise ValueError(f"{path}: record {number} has another digest than it declares")
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: record {number} isn't closed")
            number += 1


def read_warc(archives: DataFrame, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """archives (path) -> the chunked record table, one row a piece; without ``payloads`` its pieces are null."""
    ship_package(archives.sparkSession)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in _pieces(path, chunk, payloads):
                    rows.append(row)
                    held += len(row["piece"] or b"") + 200
                    if held > chunk:
                        yield pa.RecordBatch.from_pylist(rows, _CHUNKS)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _CHUNKS)

    n = archives.count()
    # One archive a task, as far as dealing by number goes.
    return archives.select("path").repartition(max(1, n)).mapInArrow(f, CHUNKS)


def record_table(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record; of responses as they were read."""
    own = F.col("record_type") == "response"
    return chunks.where("is_last").select(
        "page_id",
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
