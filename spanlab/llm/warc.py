"""WARC archives in Zstandard frames with a dictionary (operator 7).

Layout of an archive (``.warc.zst``): a leading skippable frame holds the dictionary, then
each record is one frame of its own, compressed with that dictionary. The reader loads the
dictionary from the skippable frame, walks over the frames, decodes one record at a time
and validates the version line, the mandatory headers, the block length, the record's end,
the HTTP length and both digests. A fault raises ``ValueError`` with the archive and offset.

Records of equal payload are written once: that with the largest page_id is the
``response``, the others are ``revisit`` records that carry the HTTP header only and refer
to it. Equal payloads are found by their digest, counted before the exchange.

Archives are written by the executors to a shared folder through Arrow's file systems and
read back by Spark's ``binaryFile`` source. An archive is finished under a temporary name
and then moved, so a task that runs again replaces its own archives with the same bytes.

Defined results: null html is an empty payload; a null url leaves the target header out;
a null page_id counts as smaller than all others (if all of a payload are null, all are
responses); rows that repeat the largest page_id are all responses; empty tables give no
records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.arrays import bytes_column
from spanlab.llm.common import table, written
from spanlab.session import scratch_path, ship_package

# Fixed values of the format.
VERSION = b"WARC/1.1"
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 16 << 20  # uncompressed records of one archive
DICTIONARY_BYTES = 32 << 10
SAMPLES, SAMPLE_BYTES = 64, 8 << 10
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record: a response, or a revisit of the page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        # what may not stand in a header line is percent-encoded
        head.insert(2, ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def trained_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from a bounded, evenly spaced sample of an archive's records."""
    step = max(1, len(records) // SAMPLES)
    samples = [r[:SAMPLE_BYTES] for r in records[::step][:SAMPLES]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too equal samples: their bytes are the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


def archive(records: list[bytes]) -> bytes:
    """A whole archive: the dictionary frame and one frame per record."""
    raw = trained_dictionary(records)
    context = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)
    head = struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    return head + b"".join(context.compress(r) for r in records)


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at ``at`` ends (from its header and block sizes)."""
    head = data[at : at + 18]
    if len(head) < 6 or struct.unpack_from("<I", head)[0] != FRAME_MAGIC:
        raise ValueError("no frame")
    checksum = zstandard.get_frame_parameters(head).has_checksum
    pos, last = at + zstandard.frame_header_size(head), False
    while not last:
        if pos + 3 > len(data):
            raise ValueError("frame is cut off")
        b = int.from_bytes(data[pos : pos + 3], "little")
        last, kind, size = bool(b & 1), b >> 1 & 3, b >> 3
        pos += 3 + (1 if kind == 1 else size)
    pos += 4 if checksum else 0
    if pos > len(data):
        raise ValueError("frame is cut off")
    return pos


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every frame, decoded with the archive's own dictionary."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    size = struct.unpack_from("<I", data, 4)[0]
    raw = data[8 : 8 + size]
    if len(raw) < size:
        raise ValueError("dictionary is cut off")
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    at = 8 + size
    while at < len(data):
        end = frame_end(data, at)
        yield at, context.decompress(data[at:end])
        at = end


def parsed(raw: bytes) -> dict:
    """The validated parts of a record: page, type, payload length and digest, page it refers to."""
    top, found, rest = raw.partition(b"\r\n\r\n")
    lines = top.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError("no WARC header")
    head = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(": ")
        if not colon or name.lower() in head:
            raise ValueError(f"header line {name!r}")
        head[name.lower()] = value
    for name in MANDATORY:
        if name not in head:
            raise ValueError(f"header {name} is missing")
    size = int(head["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("block length differs from Content-Length")
    block = rest[:size]
    if head.get("warc-block-digest") != "sha1:" + base32_sha1(block):
        raise ValueError("block digest")
    http, found, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)(?:\r\n|$)", http)
    if not found or not http.startswith(b"HTTP/") or not length:
        raise ValueError("no HTTP header")
    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
    refers = None
    if kind == "response":
        if len(payload) != int(length[1]) or base32_sha1(payload) != digest:
            raise ValueError("payload length or digest")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in head:
            raise ValueError("revisit record")
        refers = int(head["warc-refers-to"][len("<urn:page:") : -1])
    else:
        raise ValueError(f"record type {kind!r}")
    page = head["warc-record-id"][len("<urn:page:") : -1]
    return {
        "page_id": None if page == "none" else int(page),
        "payload_bytes": int(length[1]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": refers,
        "payload": payload,
    }


def store_of(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow file system and path of a folder given as path or uri (``file:/x`` too)."""
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = folder.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(folder)


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, key, refers_to of every payload that a page with a larger id holds too."""
    keyed = pages.select("page_id", F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)).alias("key"))
    keyed = written(keyed, "warc-keys")
    groups = keyed.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    several = groups.filter("n > 1 AND refers_to IS NOT NULL").select("key", "refers_to")
    return keyed.join(several, "key").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "key", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns archive, records, bytes."""
    ship_package(pages.sparkSession)
    again = revisits(pages).select(F.col("page_id").alias("again"), "key", "refers_to")
    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)).alias("hash"))
    same = src["page_id"].eqNullSafe(again["again"]) & (src["hash"] == again["key"])
    known = src.join(again, same, "left").select("page_id", "url", "html", "refers_to")

    def one(batches):
        store, root = store_of(folder)
        context, number = TaskContext.get(), 0
        name = f"part-{context.partitionId():05d}"
        held, size = [], 0

        def flush():
            path = f"{root}/{name}-{number:04d}.warc.zst"
            data = archive(held)
            draft = f"{root}/_{name}-{number:04d}-{context.taskAttemptId()}"
            with store.open_output_stream(draft) as f:
                f.write(data)
            store.move(draft, path)
            return pa.RecordBatch.from_pydict({"archive": [path], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        for b in batches:
            for page, url, html, refers in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), bytes_column(b, "html"), b.column("refers_to").to_pylist()):
                held.append(record(page, url, html or b"", refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return written(known.mapInArrow(one, "archive string, records long, bytes long"), "warc-manifest")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long"


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """Validated records of all archives in a folder (``RECORDS``; with ``payload`` also its bytes)."""
    ship_package(spark)
    schema = RECORDS + (", payload binary" if payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def one(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows = []
                try:
                    for at, raw in frames(data):
                        r = parsed(raw) | {"archive": path, "at": at}
                        rows.append([r[n] for n in names])
                        if len(rows) == 1024:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)
                            rows = []
                except (ValueError, zstandard.ZstdError) as e:
                    raise ValueError(f"{path}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(one, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written to archives and read back."""
    folder = scratch_path(spark, "warc")
    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    # where a record lies differs from run to run
    return read_archives(spark, folder).drop("archive", "at")


# Digests in hex would need base32 in SQL: base 32 digits are taken from the 160 bits.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
g AS (SELECT h, max(page_id) last FROM p GROUP BY h),
b AS (SELECT p.page_id, strlen(p.h) n, sha1(p.h) d, g.last FROM p JOIN g USING (h)),
x AS (SELECT *, list_transform(range(0, 32), lambda i: (CAST('0x' || substr(d, 1 + 5 * (i // 4) , 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) v FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(v, lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(k AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM x
"""
