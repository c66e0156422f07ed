"""WARC archives as chunked record tables.

Payloads move as rows (record, chunk number, bytes), CHUNK bytes at most each, so that neither writer nor reader ever
holds a record: the writer appends chunks to a gzip member per record, the reader inflates them piece by piece and
emits each with the digest and the length of all the payload so far. The last chunk of a record carries its digest,
which is checked against the record's header.

Records with equal payloads of at least `least` bytes: the one with the largest id is the response, others revisit it.
Rows: a null payload is empty. A null id is archived under urn:page:null, is always a response and is read back with a
null id. Rows repeated under one id are one record each; of those with the largest id all are responses.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh_path, map_arrow, written
from quire.llm.store import new_file, open_range

CHUNK = 1 << 16
#: Compressed bytes of one reading task, and of one archive file, at least.
SPLIT, FILE = 16 << 20, 256 << 20
CRLF = b"\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: each 20 bits of the digest are four base-32 digits."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _plan(pages: DataFrame, least: int) -> DataFrame:
    """Each page with its payload's digest and length and, for a revisit, the response's id."""
    keyed = pages.select(F.col("page_id").cast("bigint").alias("id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = keyed.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload").cast("bigint"))
    twins = keyed.where("id is not null").groupBy("digest", "size").agg(F.max("id").alias("response"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("size") >= least))
    joined = keyed.join(twins.drop("n"), ["digest", "size"], "left")
    return joined.withColumn("refers_to", F.when(F.col("id") < F.col("response"), F.col("response"))).drop("response")


def _chunked(plan: DataFrame, chunk: int) -> DataFrame:
    """(id, url, digest, size, refers_to, no, data): a revisit has one empty chunk."""
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(body) - 1) / chunk)).cast("int")), lambda i: F.substring(body, i * chunk + 1, F.lit(chunk)))
    return plan.select("id", "url", "digest", "size", "refers_to", F.posexplode(cut).alias("no", "data"))


def _head(record_id, url: str, digest: str, size: int, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), f"WARC-Record-ID: <urn:page:{'null' if record_id is None else record_id}>".encode(), b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + " ".join(url.split()).encode(), b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(b"Content-Length: %d" % (len(http) + (size if refers_to is None else 0)))
    return CRLF.join(lines) + CRLF * 2 + http


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = out = member = None
        at = began = records = 0
        done: list[tuple] = []

        def put(data: bytes) -> None:
            nonlocal at
            if data:
                out.write(data)
                at += len(data)

        def close_record() -> None:
            nonlocal member, began, records, uri, out, at
            put(member.compress(CRLF * 2) + member.flush())
            member, records = None, records + 1
            if at - began >= SPLIT:
                done.append((uri, began, at - began, records))
                began, records = at, 0
            if at >= FILE:
                close_file()

        def close_file() -> None:
            nonlocal uri, out, at, began, records
            if records:
                done.append((uri, began, at - began, records))
            out.close()
            uri, out, at, began, records = None, None, 0, 0, 0

        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                record_id, url, digest, size, refers_to, no, data = (c[i].as_py() for c in columns)
                if no == 0:
                    if member is not None:
                        close_record()
                    if out is None:
                        uri, out = new_file(folder, ".warc.gz")
                    member = zlib.compressobj(3, zlib.DEFLATED, 31)
                    put(member.compress(_head(record_id, url, digest, size, refers_to)))
                put(member.compress(data))
            if done:
                yield _rows(done)
                done = []
        if member is not None:
            close_record()
        if out is not None:
            close_file()
        if done:
            yield _rows(done)

    return run


def _rows(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["uri", "offset", "bytes", "records"])


def write_warc(pages: DataFrame, folder: str | None = None, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Archive pages(page_id, url, html, ...) as gzipped WARC records; the manifest (uri, offset, bytes, records)."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return written(map_arrow(_chunked(_plan(pages, least), chunk), _writer(folder), "uri string, offset bigint, bytes bigint, records bigint"), "warc-manifest")


class _Inflater:
    """Reads lines and counted bytes from the gzip members of a range of a file, a piece at a time."""

    def __init__(self, f, left: int):
        self.f, self.left, self.z, self.rest, self.buffer = f, left, None, b"", b""

    def more(self) -> bool:
        """Append inflated bytes of the current member to the buffer; False at the end of it."""
        while True:
            if self.z is None or self.z.eof:
                return False
            if self.z.unconsumed_tail:
                got = self.z.decompress(self.z.unconsumed_tail, CHUNK)
            else:
                raw = self.f.read(min(CHUNK, self.left))
                self.left -= len(raw)
                got = self.z.decompress(raw, CHUNK)
                if not raw and not got and not self.z.eof:
                    raise ValueError("a WARC member ends early")
            if self.z.eof:
                self.rest = self.z.unused_data
            if got:
                self.buffer += got
                return True

    def next_member(self) -> bool:
        self.buffer = b""
        raw, self.rest = self.rest, b""
        if not raw:
            raw = self.f.read(min(CHUNK, self.left))
            self.left -= len(raw)
        if not raw:
            return False
        self.z = zlib.decompressobj(31)
        self.buffer = self.z.decompress(raw, CHUNK)
        if self.z.eof:
            self.rest = self.z.unused_data
        return True

    def headers(self) -> dict[str, str]:
        while CRLF * 2 not in self.buffer:
            if not self.more():
                raise ValueError("a WARC header has no end")
        head, self.buffer = self.buffer.split(CRLF * 2, 1)
        first, *lines = head.decode().split("\r\n")
        return {"": first} | {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        got, self.buffer = self.buffer[:n], self.buffer[n:]
        return got

    def skip_member(self) -> None:
        self.buffer = b""
        while self.more():
            self.buffer = b""


CHUNKS = "page_id bigint, url string, record_type string, refers_to bigint, chunk int, data binary, payload_bytes bigint, payload_digest string, last boolean"


def _page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").removeprefix("urn:page:")
    return None if value in ("", "null") else int(value)


def _reader(chunk: int):
    fields = list(zip(("page_id", "url", "record_type", "refers_to", "chunk", "data", "payload_bytes", "payload_digest", "last"), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()), strict=True))

    def records(f, size: int) -> Iterator[tuple]:
        z = _Inflater(f, size)
        while z.next_member():
            warc = z.headers()
            if not warc[""].startswith("WARC/"):
                raise ValueError("not a WARC record")
            http = z.headers()
            full = int(http["content-length"])
            kind = warc["warc-type"]
            left = full if kind == "response" else 0
            stated = warc["warc-payload-digest"].removeprefix("sha1:")
            common = (_page(warc["warc-record-id"]), warc.get("warc-target-uri", ""), kind, _page(warc.get("warc-refers-to")))
            digest, so_far, no = hashlib.sha1(), 0, 0
            while True:
                data = z.take(min(chunk, left))
                if left and not data:
                    raise ValueError("a WARC payload ends early")
                left -= len(data)
                so_far += len(data)
                digest.update(data)
                now = base64.b32encode(digest.digest()).decode()
                if kind == "revisit":
                    yield (*common, no, data, full, stated, True)
                else:
                    if not left and now != stated:
                        raise ValueError(f"the payload of record {common[0]} does not have its digest")
                    yield (*common, no, data, so_far, now, not left)
                no += 1
                if not left:
                    break
            z.skip_member()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields, strict=True)], [n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for m in b.to_pylist():
                with open_range(m["uri"], m["offset"]) as f:
                    for r in records(f, m["bytes"]):
                        rows.append(r)
                        held += len(r[5]) + 200
                        if held >= 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def read_warc(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives that a manifest lists; a task reads about SPLIT compressed bytes."""
    total = manifest.agg(F.count("*")).first()[0]
    spread = manifest.repartition(max(1, total))
    return map_arrow(spread, _reader(chunk), CHUNKS)


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, n_chunks) of each record, as read from the archives."""
    chunks = read_warc(write_warc(pages, least=least))
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("chunk") + 1).alias("n_chunks"))
