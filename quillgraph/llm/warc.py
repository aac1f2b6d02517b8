"""WARC archives: a writer of one gzip member per record and a sequential reader.

The reader takes a byte stream, inflates it step by step, frames each record by its content length,
demands that every record ends with its gzip member, and verifies block and payload digests.
Neither side ever holds more than one record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import fresh_dir, open_fs, parts_of, table, written

#: Compressed bytes after which a writer starts its next archive.
ROLL = 64 << 20
_READ = 64 << 10
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Shards of a digest's pages in the join with the digest's response.
SALTS = 16


class WarcError(ValueError):
    """A record that breaks framing or a digest."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: object) -> str:
    return f"<{uuid.uuid5(_NAMES, f'page:{page}').urn}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: int | None, is_response: bool) -> bytes:
    """A response with an HTTP head and the payload, or a revisit that refers to the response and has no payload."""
    headers = [
        ("WARC-Type", "response" if is_response else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join((url or "urn:none").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if is_response else http
    if not is_response:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(response)), ("X-Refers-To-Page", str(response))]
    return record([*headers, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", "application/http;msgtype=response")], block)


def _members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """Each gzip member as an iterator of inflated pieces; input is read and inflated step by step."""
    held = b""
    while held or (held := stream.read(_READ)):
        z = zlib.decompressobj(31)
        rest = [held]

        def inflate(z=z, rest=rest) -> Iterator[bytes]:
            data = rest[0]
            while not z.eof:
                if not data and not (data := stream.read(_READ)):
                    raise WarcError("archive ends inside a gzip member")
                try:
                    piece = z.decompress(data, _READ)
                except zlib.error as e:
                    raise WarcError(f"not a gzip member: {e}") from e
                data = z.unconsumed_tail
                if piece:
                    yield piece
            rest[0] = z.unused_data

        body = inflate()
        yield body
        for _ in body:  # what the caller left
            pass
        held = rest[0]


def read_records(stream: BinaryIO, verify: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record; WarcError where framing or a digest is wrong."""
    for member in _members(stream):
        buffer = bytearray()
        while (cut := buffer.find(b"\r\n\r\n")) < 0:
            piece = next(member, None)
            if piece is None:
                raise WarcError("record without the end of its header")
            buffer += piece
        first, *lines = bytes(buffer[:cut]).decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise WarcError(f"not a WARC record: {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not headers.get("content-length", "").isdigit():
            raise WarcError("record without a content length")
        size = int(headers["content-length"])
        del buffer[: cut + 4]
        for piece in member:
            buffer += piece
            if len(buffer) > size + 4:
                break
        if len(buffer) != size + 4 or buffer[size:] != b"\r\n\r\n":
            raise WarcError("content length and gzip member disagree")
        block = bytes(buffer[:size])
        if verify and (digest := headers.get("warc-block-digest")) and digest != f"sha1:{sha1_base32(block)}":
            raise WarcError("block digest does not match")
        if verify and headers.get("warc-type") == "response" and (digest := headers.get("warc-payload-digest")) and digest != f"sha1:{sha1_base32(payload_of(block))}":
            raise WarcError("payload digest does not match")
        yield headers, block


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP head."""
    return block.partition(b"\r\n\r\n")[2]


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html of every row, and refers_to, the largest page_id of the same payload, and n_same, the pages with that payload.

    Only pages whose digest occurs twice find a partner; the digests are combined before their
    shuffle, and both sides of the join are salted, so a payload on a third of all pages is dealt to
    SALTS tasks. Null html is an empty payload.
    """
    pages = pages.select("page_id", "url", "html")
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    keyed = pages.withColumn("_digest", digest).withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    twice = pages.select("page_id", digest.alias("_digest")).groupBy("_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n_same")).filter(F.col("n_same") > 1)
    spread = twice.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.join(spread, ["_digest", "_salt"], "left").drop("_digest", "_salt")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, roll: int = ROLL) -> DataFrame:
    """Writes a record for each row of (page_id, url, html), other columns aside; returns (path, n_records) of the archives.

    A null or blank url is written as `urn:none`.

    Of records with equal payloads of at least least_bytes, the one with the largest page_id is the
    response and the others revisit it (rows that repeat that page_id are responses as well). A null
    page_id revisits a response if its payload has one. An archive appears under its name only when
    it is whole; a task that runs again writes its own archives, and only those that its committed
    result names are ever read.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_fs(folder)
        store.create_dir(top, recursive=True)
        out, path, n, size = None, "", 0, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            out.close()
            store.move(f"{path}.part", path)
            done.append((path, n))

        for batch in it:
            ids, urls, htmls, refers = (batch.column(i) for i in range(4))
            for k in range(batch.num_rows):
                page, to = ids[k].as_py(), refers[k].as_py()
                payload = (htmls[k].as_py() or "").encode()
                if out is None:
                    path, n, size = f"{top}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}.part", compression=None)
                made = page_record(page, urls[k].as_py(), payload, sha1_base32(payload), to, to is None or to == page or len(payload) < least_bytes)
                out.write(made)
                n, size = n + 1, size + len(made)
                if size >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["path", "n_records"])

    return plan_records(pages).select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, n_records long")


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives (path, n_records): page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Raises WarcError on broken framing, a wrong digest or a missing record. The payload of a revisit
    is null; its bytes and digest are those of the full payload.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_fs(folder)
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in it:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, n = [], 0, 0
                with store.open_input_stream(path, compression=None) as stream:
                    for head, block in read_records(stream):
                        kind = head["warc-type"]
                        payload = payload_of(block) if kind == "response" else None
                        size = len(payload) if payload is not None else int(head["x-payload-length"])
                        if size != int(head["x-payload-length"]):
                            raise WarcError("payload length does not match")
                        page, to = head.get("x-page-id"), head.get("x-refers-to-page")
                        rows.append((int(page) if page else None, head["warc-target-uri"], kind, size, head["warc-payload-digest"].removeprefix("sha1:"), int(to) if to else None, payload if with_payload else None))
                        n, held = n + 1, held + (len(payload or b"") if with_payload else 0)
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if n != expected:
                    raise WarcError(f"{path} has {n} records, not {expected}")
                if rows:
                    yield packed(rows)

    return archives.repartition(parts_of(archives.sparkSession)).mapInArrow(run, RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    archives = written(write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder), "warc-list")
    return read_archives(archives, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
