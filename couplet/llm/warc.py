"""WARC archives with a shared Zstandard dictionary.

Every archive is a sequence of Zstandard frames: first a skippable frame (magic 0x184D2A5D) that holds
the dictionary, then one frame per record, so records stay separately readable. The dictionary is
built from a bounded sample of the records; every record is written. Of records with equal payloads
the one with the smallest id is stored, the others refer to it.

Archives are written by the tasks under names of their own attempt, and a manifest (Parquet, written
by Spark's committer) lists the archives of the successful attempts: a lost executor leaves at most
files that no manifest names. Archives are closed at ``ARCHIVE_BYTES`` of payload.

Nulls and edges: a null payload is empty, a null url is left out, control characters and spaces of a
url are percent-encoded, a null id is written as ``null``. Rows that repeat an id are separate
records; rows of equal id and payload refer to the same id. An empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from couplet.operators.shared import materialise, stage_folder

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
# The dictionary is built from about so many records of at most so many bytes each.
SAMPLE_RECORDS, SAMPLE_RECORD_BYTES, DICTIONARY_BYTES = 400, 16 << 10, 64 << 10
TRAINING_SAMPLES = 16                # fewer are cut into smaller ones
MIN_REFERRED = 100                   # shorter payloads are stored again rather than referred to
LEVEL = 3
READ_BYTES = 8 << 10                 # compressed bytes fed at a time; frames don't state their length
# Fixed by the archive format, which requires a date; the tables have none.
DATE = "2024-01-01T00:00:00Z"


def payload_roles(pages: DataFrame, id: str, payload: str, shortest: int = MIN_REFERRED) -> DataFrame:
    """``(id, digest, refers_to)`` of every row; ``refers_to`` is null for stored records."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    narrow = materialise(pages.select(F.col(f"`{id}`").alias("id"), F.sha2(body, 256).alias("digest"),
                                      F.octet_length(body).cast("long").alias("size")))
    first = narrow.where(F.col("size") >= shortest).groupBy("digest") \
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first")
    return narrow.join(first, "digest", "left").select(
        "id", "digest", F.when(F.col("id") != F.col("first"), F.col("first")).alias("refers_to"))


def build_dictionary(pages: DataFrame, roles: DataFrame, payload: str) -> bytes:
    """A dictionary from about ``SAMPLE_RECORDS`` records; empty only if no payload has a byte.

    The sample is the distinct payloads whose digest falls below a bound set by their number, so it
    stays the same size however many records and copies there are. Of a longer payload it takes a stretch of
    ``SAMPLE_RECORD_BYTES`` characters that begins where the digest says. Few samples are cut into smaller ones for
    training; where training refuses them all the same, their own bytes are the dictionary.
    """
    distinct = roles.select("digest").distinct().count()
    share = min(1.0, SAMPLE_RECORDS / max(distinct, 1))
    body, digest = F.col(f"`{payload}`"), F.sha2(F.col(f"`{payload}`"), 256)
    number = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")                 # noqa: E731
    spare = F.greatest(F.length(body) - SAMPLE_RECORD_BYTES, F.lit(0)).cast("long")
    start = (F.pmod(number(9), spare + 1) + 1).cast("int")
    fit = pages.where(F.octet_length(body) > 0).where(number(1) <= int(share * 0xFFFFFFFF)) \
        .select(digest.alias("digest"), body.substr(start, F.lit(SAMPLE_RECORD_BYTES)).alias("b")) \
        .groupBy("digest").agg(F.min("b").alias("b"))
    sample = [r[0].encode() for r in fit.orderBy("digest").limit(2 * SAMPLE_RECORDS).select("b").collect()]
    if len(sample) < TRAINING_SAMPLES:
        size = max(64, sum(map(len, sample)) // (4 * TRAINING_SAMPLES))
        sample = [s[i:i + size] for s in sample for i in range(0, len(s), size)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY_BYTES:]


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the stored one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
             f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url",
                   payload: str = "html") -> DataFrame:
    """Write all records under ``folder`` and return the manifest ``(path, records, bytes)``."""
    roles = materialise(payload_roles(pages, id, payload))
    words = build_dictionary(pages, roles, payload)
    rows = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("url"),
                        F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("payload"))
    # The digest joins too: rows that repeat an id keep their own payload's role.
    named = rows.withColumn("digest", F.sha2("payload", 256))
    same = named["id"].eqNullSafe(roles["id"]) & (named["digest"] == roles["digest"])
    joined = named.join(roles.dropDuplicates(["id", "digest"]), same, "left") \
        .select(named["id"], "url", "payload", named["digest"], "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        files.create_dir(root, recursive=True)
        known = zstandard.ZstdCompressionDict(words) if words else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
        out, count, size = None, 0, 0

        def close():
            name = f"{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{root}/{name}", compression=None) as f:   # the frames are it
                f.write(out.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([count]),
                                               pa.array([out.tell()])], ["path", "records", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    out, count, size = io.BytesIO(), 0, 0
                    if words:
                        out.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
                page_id, address, body, digest, refers = (batch.column(c)[i].as_py() for c in range(5))
                body = body.encode()
                out.write(press.compress(record_bytes(page_id, address, body, digest, refers)))
                count, size = count + 1, size + len(body)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialise(joined.mapInArrow(run, "path string, records long, bytes long"))


def frames(blob: bytes) -> Iterator[bytes]:
    """The records of an archive, decompressed one by one."""
    known, view, at = None, memoryview(blob), 0
    while at < len(blob):
        magic, length = struct.unpack_from("<II", blob, at)
        if magic == SKIPPABLE:
            known = zstandard.ZstdCompressionDict(bytes(view[at + 8:at + 8 + length]))
            at += 8 + length
            continue
        reader, record = zstandard.ZstdDecompressor(dict_data=known).decompressobj(), []
        while not reader.eof:
            if at >= len(blob):
                raise ValueError("the archive ends within a record")
            record.append(reader.decompress(view[at:at + READ_BYTES]))
            at = min(len(blob), at + READ_BYTES)
        at -= len(reader.unused_data)
        yield b"".join(record)


_ID = re.compile(rb"<urn:page:(.*)>")


def parse_record(record: bytes) -> tuple:
    """``(id, type, url, payload, digest, size, refers_to)``; the size and digest are of the full payload."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = block[:int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    name = lambda field: None if (x := _ID.fullmatch(fields[field])[1]) == b"null" else x.decode()
    kind = fields[b"WARC-Type"].decode()
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields[b'WARC-Record-ID'].decode()} is damaged")
    url = fields.get(b"WARC-Target-URI")
    return (name(b"WARC-Record-ID"), kind, url and url.decode(), payload if kind == "response" else None, digest, size,
            name(b"WARC-Refers-To") if kind == "revisit" else None)


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives that the manifest names; ids come back as text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder) \
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    named = files.join(manifest.select(F.element_at(F.split("path", "/"), -1).alias("name")), "name", "left_semi")
    extra = ", payload binary" if payloads else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for record in frames(batch.column("content")[i].as_py()):
                    rows.append(parse_record(record))
                    held += len(record) if payloads else 0
                    if len(rows) >= 5000 or held > (8 << 20):
                        yield _batch(rows, payloads)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, payloads)

    return named.select("content").mapInArrow(
        run, f"id string, record_type string, url string, digest string, size long, refers_to string{extra}")


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    ids, kinds, urls, bodies, digests, sizes, refers = zip(*rows)
    arrays = [pa.array(ids, pa.string()), pa.array(kinds, pa.string()), pa.array(urls, pa.string()),
              pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(refers, pa.string())]
    names = ["id", "record_type", "url", "digest", "size", "refers_to"]
    return pa.RecordBatch.from_arrays(arrays + ([pa.array(bodies, pa.binary())] if payloads else []),
                                      names + (["payload"] if payloads else []))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives beside the stage tables."""
    return f"{stage_folder(spark)}/warc-{uuid.uuid4().hex}"
