"""WARC archives whose records are compressed one by one with a dictionary of their own (.warc.zst).

Every page becomes a record: ``response`` for the smallest page_id of equal payloads, ``revisit`` with a reference to it for
the others (payloads smaller than ``SMALLEST`` bytes are all responses). A task writes archives of about ``ARCHIVE_BYTES``: a
Zstandard dictionary is trained on records of the archive, embedded in a leading skippable frame, and every record
is a frame of its own, so that a reader can start at any record. Without enough records to train on, the sample itself
is the dictionary.

Archives go to a folder that all executors reach, under names of their own; the list of finished archives is stored, so
what a lost task left behind is never read. Readers verify each response against its digest.

Null html is an empty payload. A null page_id comes after all others and is written as an empty number; rows with the
smallest page_id of their payload are responses, repeated rows too. Null or unprintable URLs are replaced or escaped.
Extra columns do not matter. An empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackside.llm.common import batch, fresh_path, prepare, stored

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 512 << 10
SAMPLE_RECORD = 8 << 10
LEVEL = 3
SMALLEST = 0
DATE = "2000-01-01T00:00:00Z"
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")  # fixed value: skippable frame that holds a dictionary
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Target-URI", quote(url or "urn:none", safe="!#$%&'()*+,/:;=?@[]~|")),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def warcinfo(date: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    fields = f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\n"
    fields += f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return b"WARC/1.1\r\n" + fields.encode() + body + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    step = max(1, len(records) * SAMPLE_RECORD // SAMPLE_BYTES)
    sample = [r[:SAMPLE_RECORD] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], date: str) -> bytes:
    trained = dictionary(records)
    embedded = trained.as_bytes()
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    frames = [compressor.compress(r) for r in (warcinfo(date), *records)]
    return b"".join([DICTIONARY_MAGIC, len(embedded).to_bytes(4, "little"), embedded, *frames])


def frames(data: memoryview) -> Iterator[memoryview]:
    """The frames one after the other, found by their block headers."""
    at = 0
    while at < len(data):
        start = at
        checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
        at += zstandard.frame_header_size(data[at : at + 18])
        last = False
        while not last:
            head = int.from_bytes(data[at : at + 3], "little")
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            at += 3 + (1 if kind == 1 else size)
        at += 4 if checksum else 0
        yield data[start:at]


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive."""
    if data[:4] != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    size = int.from_bytes(data[4:8], "little")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    for frame in frames(memoryview(data)[8 + size :]):
        text = reader.decompress(frame)
        end = text.index(b"\r\n\r\n")
        lines = text[:end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        body = text[end + 4 : end + 4 + int(fields["Content-Length"])]
        if lines[0] != "WARC/1.1" or text[end + 4 + len(body) :] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield fields, body


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def write_archives(
    pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, smallest: int = SMALLEST, date: str = DATE
) -> DataFrame:
    """Write all pages; (path, records) of the archives."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("same", F.sha2(F.col("html").cast("binary"), 256))
    # Hot payloads are pre-aggregated here, and their rows split by adaptive skew handling in the join.
    firsts = pages.groupBy("same").agg(F.min("page_id").alias("first"))
    known = pages.join(firsts, "same").select("page_id", "url", "html", "first")

    def run(batches):
        fs, root = FileSystem.from_uri(folder)
        held, size = [], 0

        def write():
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(path, compression=None) as out:
                out.write(archive(held, date))
            return batch(path=[path], records=pa.array([len(held)], pa.int64()))

        for b in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in b.columns)):
                payload = html.encode("utf-8", "surrogatepass")
                revisit = page_id != first and len(payload) >= smallest
                held.append(record(page_id, url, payload, first, revisit, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield write()
                    held, size = [], 0
        if held:
            yield write()

    FileSystem.from_uri(folder)[0].create_dir(FileSystem.from_uri(folder)[1], recursive=True)
    return stored(known.mapInArrow(run, "path string, records long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, from the files."""

    def run(batches):
        fs, _ = FileSystem.from_uri(folder)
        for b in batches:
            for path, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_stream(path, compression=None) as stream:
                    data = stream.read()
                rows = []
                for fields, body in read_records(data):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, payload = body.split(b"\r\n\r\n", 1)
                    length = int(http.decode().rsplit("Content-Length: ", 1)[1])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != length or digest_of(payload) != digest):
                        raise ValueError(f"{path}: payload of {fields['WARC-Record-ID']} does not match its digest")
                    refers = page_of(fields["WARC-Refers-To"]) if revisit else None
                    rows.append((page_of(fields["WARC-Record-ID"]), length, digest, fields["WARC-Type"], refers))
                if len(rows) != records:
                    raise ValueError(f"{path}: {len(rows)} of {records} records")
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
                yield batch(**{n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)})

    # A fixed number: a row is small and stands for an archive, so partitions must not be merged by their size.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.repartition(parts, "path").mapInArrow(run, RESULT)


def archived(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` to archives and read them back."""
    spark = prepare(pages.sparkSession)
    folder = folder or fresh_path(spark, "warc")
    return read_archives(spark, write_archives(pages, folder, **options), folder)
