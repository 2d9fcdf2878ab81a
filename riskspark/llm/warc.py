"""WARC archives through a chunked record table.

Writing: every page becomes (record, chunk_no, chunk) rows of at most
``chunk_bytes`` bytes; each Spark task appends its rows to one ``.warc.gz``
file (one gzip member per record) while it carries the record's SHA-1 forward
from chunk to chunk. Reading: each task streams whole archives in small blocks
and emits (record, chunk_no, ...) rows with the digest of the payload so far.
Neither side ever holds a whole record besides the source row itself.

Archives live in the shared checkpoint folder (or any folder pyarrow can open:
file, hdfs, s3, gs). A task writes under a name of its own attempt and reports
it in the manifest, which Spark commits, so a repeated or lost task leaves at
most an unlisted file behind.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import shared_path, stage

CHUNK_BYTES = 1 << 20
MIN_DEDUP_BYTES = 0
WARC_DATE = "1970-01-01T00:00:00Z"
_BLOCK = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column (built-in functions only)."""
    hex40 = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_dedup_bytes: int = MIN_DEDUP_BYTES,
                  id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The chunked record table of ``pages``: record header columns, chunk_no, chunk.

    Of records with equal payloads of at least ``min_dedup_bytes`` bytes the one
    with the smallest page_id is the response and the others revisit it; smaller
    ones are all responses. NULL payloads are empty. Repeated rows of a
    response's page are responses too; NULL page_ids never become the response
    of a page that has an id. Copies are found by a map-side combined count of
    digests; only digests that occur more than once are joined back.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.select("*", base32_sha1(F.col("payload")).alias("digest"),
                       F.octet_length("payload").cast("long").alias("payload_bytes"), F.xxhash64("payload").alias("check"))
    key = ["digest", "payload_bytes", "check"]
    copies = stage(rows.select("page_id", *key).where(F.col("payload_bytes") >= min_dedup_bytes)
                   .groupBy(*key).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"),
                   "warc_copies")
    named = rows.join(copies.withColumn("copied", F.lit(True)), key, "left")
    revisit = F.col("copied") & ~F.col("page_id").eqNullSafe(F.col("first"))
    n_chunks = F.greatest(F.ceil(F.col("stored_bytes") / chunk_bytes), F.lit(1)).cast("int")
    return (named.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col("first")))
            .withColumn("stored_bytes", F.when(revisit, 0).otherwise(F.col("payload_bytes")))
            .withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
            .select("page_id", "url", "record_type", "refers_to", "digest", "payload_bytes", "chunk_no",
                    F.when(F.col("record_type") == "response", F.expr(f"substring(payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})"))
                    .otherwise(F.lit(b"")).alias("chunk")))


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _head(row: dict) -> bytes:
    from urllib.parse import quote

    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {row['payload_bytes']}\r\n\r\n").encode()
    revisit = row["record_type"] == "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_record_id(row['page_id'])}",
             f"WARC-Date: {WARC_DATE}", f"WARC-Payload-Digest: sha1:{row['digest']}",
             "Content-Type: application/http;msgtype=response",
             f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(row['refers_to'])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(pages: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES,
                   min_dedup_bytes: int = MIN_DEDUP_BYTES, **columns: str) -> DataFrame:
    """Write one archive per task; the manifest (archive, records, payload_bytes)."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    heads = ("page_id", "url", "record_type", "refers_to", "digest", "payload_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = gz = sha = row = None
        name, records, stored = "", 0, 0

        def close_record() -> None:
            if row["record_type"] == "response" and base64.b32encode(sha.digest()).decode() != row["digest"]:
                raise ValueError(f"chunks of page {row['page_id']} do not add up to its payload")
            out.write(gz.compress(b"\r\n\r\n") + gz.flush())

        for b in batches:
            cols, chunks = {h: b.column(h) for h in heads}, b.column("chunk")
            for i, chunk_no in enumerate(b.column("chunk_no").to_pylist()):
                if chunk_no == 0:
                    if row is not None:
                        close_record()
                    if out is None:
                        files, path = _filesystem(folder)
                        files.create_dir(path, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                    row = {h: cols[h][i].as_py() for h in heads}
                    gz, sha = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1()
                    out.write(gz.compress(_head(row)))
                    records, stored = records + 1, stored + row["payload_bytes"] * (row["record_type"] == "response")
                chunk = chunks[i].as_buffer()
                sha.update(chunk)
                out.write(gz.compress(chunk))
        if row is not None:
            close_record()
            out.close()
            yield pa.RecordBatch.from_pylist([{"archive": f"{folder}/{name}", "records": records, "payload_bytes": stored}])

    table = record_chunks(pages, chunk_bytes, min_dedup_bytes, **columns)
    return stage(table.mapInArrow(run, "archive string, records long, payload_bytes long"), "warc_manifest")


class _Stream:
    """Bytes of a multi-member gzip file, in blocks of bounded size."""

    def __init__(self, raw):
        self.blocks, self.buffer, self.at = self._inflate(raw), b"", 0

    @staticmethod
    def _inflate(raw) -> Iterator[bytes]:
        data, d, started = b"", zlib.decompressobj(31), False
        while True:
            if not data:
                data = raw.read(_BLOCK)
                if not data:
                    while started and not d.eof:
                        if not (rest := d.decompress(b"", _BLOCK)):
                            raise EOFError("archive ends inside a record")
                        yield rest
                    return
            started = True
            if out := d.decompress(data, _BLOCK):
                yield out
            data = d.unconsumed_tail
            if d.eof:
                data, d, started = d.unused_data, zlib.decompressobj(31), False

    def some(self, most: int) -> bytes:
        """1 to ``most`` bytes; empty at the end of the file."""
        if self.at >= len(self.buffer):
            self.buffer, self.at = next(self.blocks, b""), 0
        out = self.buffer[self.at:self.at + most]
        self.at += len(out)
        return out

    def head(self) -> bytes:
        """Up to and without the next empty line; empty at the end of the file."""
        while (end := self.buffer.find(b"\r\n\r\n", self.at)) < 0:
            more = next(self.blocks, b"")
            if not more:
                if self.buffer[self.at:].strip():
                    raise EOFError("archive ends inside a header")
                return b""
            self.buffer, self.at = self.buffer[self.at:] + more, 0
        out, self.at = self.buffer[self.at:end], end + 4
        return out


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _chunks(stream: _Stream, chunk_bytes: int, with_payload: bool) -> Iterator[dict]:
    """Chunk rows of all response and revisit records of one archive."""
    from urllib.parse import unquote

    def page(urn: str | None) -> int | None:
        n = (urn or "").strip("<>").rpartition(":")[2]
        return int(n) if n.lstrip("-").isdigit() else None

    while head := stream.head().lstrip(b"\r\n"):
        warc = _fields(head)
        left = int(warc["content-length"])
        kind = warc["warc-type"]
        base = {"record_id": warc["warc-record-id"], "page_id": page(warc["warc-record-id"]), "record_type": kind,
                "refers_to": page(warc.get("warc-refers-to")), "url": unquote(warc["warc-target-uri"]) if "warc-target-uri" in warc else None}
        digest = warc.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind in ("response", "revisit"):
            http = stream.head()
            left -= len(http) + 4
            declared = int(_fields(http)["content-length"])
        if kind == "revisit":
            yield base | {"chunk_no": 0, "chunk_offset": 0, "chunk_bytes": 0, "chunk": b"", "payload_bytes": declared,
                          "running_digest": digest, "is_last": True}
        sha, parts, held, at, no = hashlib.sha1(), [], 0, 0, 0
        empty = left == 0
        while left or (empty and kind == "response"):
            part = stream.some(min(left, chunk_bytes - held)) if left else b""
            if left and not part:
                raise EOFError("archive ends inside a record")
            left, held = left - len(part), held + len(part)
            if kind == "response":
                sha.update(part)
                if with_payload:
                    parts.append(part)
                if held == chunk_bytes or not left:
                    yield base | {"chunk_no": no, "chunk_offset": at, "chunk_bytes": held, "chunk": b"".join(parts), "payload_bytes": at + held,
                                  "running_digest": base64.b32encode(sha.digest()).decode(), "is_last": not left}
                    parts, at, held, no = [], at + held, 0, no + 1
            else:
                held = 0
            empty = False
        if kind == "response" and (at != declared or base64.b32encode(sha.digest()).decode() != digest):
            raise ValueError(f"record {base['record_id']}: payload does not match its digest")
        stream.head()  # the empty lines that end a record


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_payload: bool = True) -> DataFrame:
    """The chunked record table of the archives that ``manifest`` lists.

    One row per chunk: record_id, page_id, url, record_type, refers_to, chunk_no,
    chunk_offset, chunk_bytes, chunk (empty without ``with_payload``),
    payload_bytes and running_digest (of the payload up to and including this
    chunk; of the full payload for revisits) and is_last. Digests and lengths
    are checked against the record headers; a mismatch raises.
    """
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("chunk_offset", pa.int64()), ("chunk_bytes", pa.int64()),
                        ("chunk", pa.binary()), ("payload_bytes", pa.int64()), ("running_digest", pa.string()), ("is_last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for archive in b.column(0).to_pylist():
                folder, _, name = archive.rpartition("/")
                files, path = _filesystem(folder)
                with files.open_input_stream(f"{path}/{name}", compression=None) as raw:
                    for row in _chunks(_Stream(raw), chunk_bytes, with_payload):
                        held.append(row)
                        size += 200 + len(row["chunk"])
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    n = max(1, min(manifest.count(), 100_000))
    return manifest.select("archive").repartition(n).mapInArrow(
        run, "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no long, chunk_offset long, "
             "chunk_bytes long, chunk binary, payload_bytes long, running_digest string, is_last boolean")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages``, read the archives back, one row per record."""
    chunks = read_archives(write_archives(pages), with_payload=False)
    return chunks.where("is_last").select("page_id", "payload_bytes", F.col("running_digest").alias("payload_digest"),
                                          "record_type", "refers_to", (F.col("chunk_no") + 1).alias("n_chunks"))
