"""WARC archives with revisit records, and a reader that splits gzip files by byte ranges.

Every record is a gzip member of its own.  A reading task looks through its byte range for the gzip
magic, takes a place as a member only if it decodes to a whole record that ends at the next member
or the end of the file, and owns the records that start inside its range, whose ends may lie beyond.
"""
from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from secframe.llm.common import Scratch, spark_partitions, table, text_of
from secframe.llm.storage import PartFile, open_store

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive before a new one begins, of a reading task's range, and read at a time.
FILE_BYTES, SPLIT_BYTES, READ_BYTES = 256 << 20, 16 << 20, 1 << 20
DATE = "1970-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP header only."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="/:=&?~#+!$,;'@()*[]"))     # '%' too, so that reading gives the same text
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _headers(data: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in data.split(b"\r\n")[1:] if b":" in line)
    return {k.decode().lower(): v.strip().decode() for k, v in pairs}


def parse_record(data: bytes) -> dict | None:
    """Fields of a decoded member; None unless it is one whole record."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.") or not mark:
        return None
    try:
        h = _headers(head)
        n = int(h["content-length"])
        block = rest[:n]
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            return None
        http, _, payload = block.partition(b"\r\n\r\n")
        bare = lambda v: v.strip("<>").removeprefix("urn:page:")
        number = lambda v: int(v) if v else None
        revisit = h["warc-type"] == "revisit"
        return {
            "page_id": number(bare(h["warc-record-id"])),
            "url": unquote(h["warc-target-uri"]) if "warc-target-uri" in h else None,
            "payload": None if revisit else payload,
            "payload_bytes": int(_headers(http)["content-length"]) if revisit else len(payload),
            "payload_digest": h["warc-payload-digest"].removeprefix("sha1:") if revisit else digest_of(payload),
            "record_type": h["warc-type"],
            "refers_to": number(bare(h["warc-refers-to"])) if revisit else None,
        }
    except (KeyError, ValueError, UnicodeDecodeError):
        return None


class _Bytes:
    """A window over a file that is read on as far as a member needs it."""

    def __init__(self, source, size: int, at: int, step: int):
        self.source, self.size, self.base, self.step, self.data = source, size, at, step, b""

    def more(self) -> bool:
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.source.seek(at)
        # as much again as is held, so that a long member is copied a few times only
        got = self.source.read(min(max(self.step, len(self.data)), self.size - at))
        if not got:
            raise EOFError(f"archive ends at {at}, not at {self.size}")
        self.data += got
        return True

    def at(self, offset: int, n: int) -> bytes:
        """Up to n bytes from a file offset."""
        while self.base + len(self.data) < offset + n and self.more():
            pass
        return self.data[offset - self.base:offset - self.base + n]

    def forget(self, offset: int) -> None:
        self.data, self.base = self.data[offset - self.base:], offset

    def find(self, offset: int, end: int) -> int:
        """First place of the magic in [offset, end), or -1."""
        while True:
            self.at(offset, len(MAGIC))
            hit = self.data.find(MAGIC, offset - self.base, min(len(self.data), end + len(MAGIC) - 1 - self.base))
            if hit >= 0:
                return self.base + hit
            if self.base + len(self.data) >= min(end + len(MAGIC) - 1, self.size):
                return -1
            offset = max(offset, self.base + len(self.data) - len(MAGIC) + 1)
            self.forget(offset)
            self.more()

    def member(self, offset: int) -> tuple[bytes, int] | None:
        """Decoded member at an offset and the offset behind it; None if no record begins here."""
        unpack, out, n, checked = zlib.decompressobj(31), [], 0, False
        at = offset
        try:
            while not unpack.eof:
                part = self.at(at, self.step)
                if not part:
                    return None
                out.append(unpack.decompress(part))
                n += len(out[-1])
                at += len(part)
                if not checked and n >= 7:
                    if not b"".join(out).startswith(b"WARC/1."):
                        return None
                    checked = True
        except zlib.error:
            return None
        return b"".join(out), at - len(unpack.unused_data)


def read_range(source, size: int, start: int, end: int, step: int = READ_BYTES) -> Iterator[dict]:
    """Records that start in [start, end)."""
    window = _Bytes(source, size, start, step)
    at = start
    while at < end and (at := window.find(at, end)) >= 0:
        window.forget(at)
        got = window.member(at)
        record = got and parse_record(got[0])
        if record and (got[1] == size or window.at(got[1], len(MAGIC)) == MAGIC):
            yield record
            at = got[1]
            window.forget(at)
        else:
            at += 1


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row to ``folder``; (path, size, records) per archive.

    Rows with equal payloads of at least ``min_bytes`` revisit the one with the smallest id; rows
    that repeat that id are responses too.  A null payload is empty, a null url has no target, and
    a null id is named empty: it is a response only where its payload has no row with an id.
    """
    base = pages.select(F.col(id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), text_of(html).alias("html"))
    base = base.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    firsts = base.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    named = base.join(firsts.select("digest", "first"), "digest", "left").select(
        "page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def write(batches):
        part, n = None, 0
        for batch in batches:
            for page, target, text, first in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if part is None:
                    part, n = PartFile(folder, ".warc.gz"), 0
                part.write(record_bytes(page, target, text.encode(), first))
                n += 1
                if part.size >= file_bytes:
                    part.close()
                    yield pa.RecordBatch.from_pylist([{"path": part.uri, "size": part.size, "records": n}])
                    part = None
        if part is not None:
            part.close()
            yield pa.RecordBatch.from_pylist([{"path": part.uri, "size": part.size, "records": n}])

    return named.mapInArrow(write, "path string, size bigint, records bigint")


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Records of archives (path, size); payloads as binary, null for revisits or when not asked for."""
    spark = archives.sparkSession
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))
    ranges = archives.filter("size > 0").select("path", "size", F.explode(starts).alias("start"))
    ranges = ranges.repartition(spark_partitions(spark), "path", "start")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload)

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                store, path = open_store(r["path"])
                with store.open_input_file(path) as source:
                    rows, held = [], 0
                    for record in read_range(source, r["size"], r["start"], min(r["start"] + split_bytes, r["size"])):
                        rows.append(record)
                        held += record["payload_bytes"] if payload else 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return ranges.mapInArrow(read, ddl + (", payload binary" if payload else ""))


def op9_warc(spark, sf_dir):
    scratch = Scratch(spark, "warc")
    written = scratch.keep(write_archives(table(spark, sf_dir, "pages"), scratch.place("archives")), "manifest")
    return read_archives(written, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
