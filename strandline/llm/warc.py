"""WARC archives: one gzip member per record, written by Spark and read back in sequence.

Writing: of pages with equal payloads (by SHA-256; records carry SHA-1) of at least ``least`` bytes, that with the largest id is
a ``response`` and the others ``revisit`` records that refer to it and carry no payload; smaller pages are all
responses, as are rows that share the largest id. Records are compressed one by one and written by Spark's own
text writer, whose line separator is set to the byte 0 with which every gzip member ends (its length's high byte; where
a record is so long that it isn't, an empty member follows), so files are plain concatenated members in any store that Spark writes to,
through its commit protocol. A task begins a new file after ``file_bytes`` (folders ``roll=n``), and ``per_file`` records go to a file at most; so a file holds that
many bytes and one record at most, however long pages are.

Reading: members are decompressed step by step, the record header is read to its empty line, the block is framed
by Content-Length, and block and payload digests are checked. A broken frame or digest raises an error that
names the file and the offset.

The reader gets a file as one value, so archives from elsewhere must be under 2 GiB each (those written here are far smaller); it
inflates them step by step, a record at a time.

A null html is an empty payload, a null url ``about:blank``; a null id is smallest and kept. Repeated rows are
records of their own; among rows that share the largest id all are responses. Very long pages are read and written whole. An empty table gives no
record. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST, PER_FILE, STEP, FILE_BYTES = 1000, 5000, 1 << 16, 1 << 27
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: bytes) -> bytes:
    """The bytes of one record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else "about:blank")]
    fields += [] if refers_to is None else [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", _b32(digest)), ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest())), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    if out[-1]:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += z.compress(b"") + z.flush()
    return out


def _members(file_bytes: int):
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = batch.slice(lo, 64)
                out = [member(record(i, u, h, r, d))[:-1] for i, u, h, r, d in zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "digest")), strict=True)]
                rolls = []
                for one in out:
                    rolls.append(written // file_bytes)
                    written += len(one) + 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(rolls, pa.int32())], ["value", "roll"])

    return members


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, per_file: int = PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Writes the pages to archives under ``path``."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumns({"sha": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    long = rows.filter(F.col("bytes") >= least).groupBy("sha", "page_id").agg(F.lit(1).alias("one"))
    groups = long.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # payloads meet what they refer to by their own id, which isn't hot, rather than by their digest
    refers = long.join(groups, "sha").filter(~F.col("page_id").eqNullSafe(F.col("last"))).select("page_id", "sha", F.col("last").alias("refers_to"))
    refers = refers.select(F.col("page_id").alias("of"), F.col("sha").alias("digest_of"), "refers_to")
    marked = rows.join(refers, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("digest_of")), "left")
    marked = marked.select("page_id", "url", "payload", "refers_to", F.unhex(F.sha1("payload")).alias("digest"))
    out = marked.mapInArrow(_members(file_bytes), "value binary, roll int")
    out.select(F.col("value").cast("string").alias("value"), "roll").write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).partitionBy("roll").text(path)


def records(data: bytes, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive, in sequence."""
    view, at = memoryview(data), 0
    while at < len(view):
        begin, z, head, fields, block, need = at, zlib.decompressobj(31), b"", None, bytearray(), 0
        while not z.eof:
            if at >= len(view):
                raise ValueError(f"{name}: truncated member at {begin}")
            chunk = z.decompress(view[at : at + STEP])
            at += min(STEP, len(view) - at) - len(z.unused_data)
            if fields is None:
                head += chunk
                cut = head.find(b"\r\n\r\n")
                if cut < 0:
                    continue
                lines = head[:cut].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"{name}: no record at {begin}")
                fields = dict(line.split(": ", 1) for line in lines[1:])
                need, chunk = int(fields["Content-Length"]), head[cut + 4 :]
            block += chunk
        if fields is None:
            if head:
                raise ValueError(f"{name}: no whole header at {begin}")
            continue  # an empty member
        if len(block) != need + 4 or block[need:] != b"\r\n\r\n":
            raise ValueError(f"{name}: {len(block)} bytes where {need} and an end were due, at {begin}")
        del block[need:]
        if _b32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
            raise ValueError(f"{name}: wrong block digest at {begin}")
        yield fields, bytes(block)


def parse(fields: dict[str, str], block: bytes, ids=int) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload); a revisit's payload is null."""
    cut = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:cut].decode().split("\r\n")[1:])
    ident = lambda s: ids(s[10:-1]) if s and s != "<urn:page:>" else None
    digest, payload = base64.b32decode(fields["WARC-Payload-Digest"][5:]), None
    if fields["WARC-Type"] == "response":
        payload = block[cut + 4 :]
        if hashlib.sha1(payload).digest() != digest or len(payload) != int(http["Content-Length"]):
            raise ValueError(f"wrong payload digest of {fields['WARC-Record-ID']}")
    return ident(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], ident(fields.get("WARC-Refers-To")), int(http["Content-Length"]), digest.hex(), payload


SCHEMA = "page_id {0}, url string, record_type string, refers_to {0}, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, path: str, ids: str = "long") -> DataFrame:
    """Every record of the archives under ``path``, with page ids as ``long`` or, where they aren't whole numbers, ``string``; no archive gives no rows."""
    if ids not in ("long", "string"):
        raise ValueError("ids are long or string")
    kind, of = (pa.int64(), int) if ids == "long" else (pa.string(), str)
    types = pa.schema([("page_id", kind), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", kind), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out, held = [], 0
                for fields, block in records(data.as_buffer(), name):
                    out.append(parse(fields, block, of))
                    held += len(block)
                    if held > 1 << 22 or len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=types)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=types)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(rows, SCHEMA.format(ids))
