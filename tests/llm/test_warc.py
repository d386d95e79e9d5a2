"""Archives: round trips, dictionaries, frames."""

import base64
import hashlib
import io

import pytest
import zstandard

from trackside.llm import warc

SCHEMA = "page_id long, url string, html string, first long, same string, records int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def expected(rows, smallest=0):
    first = {}
    for i, _, html in rows:
        key = html or ""
        known = [x for x in (first.get(key), i) if x is not None]
        first[key] = min(known) if known else None
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        revisit = i != first[html or ""] and len(payload) >= smallest
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), digest, "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("archive_bytes", "smallest"), [(16 << 20, 0), (2000, 0), (16 << 20, 5)])
def test_odd_rows(spark, archive_bytes, smallest):
    rows = [(i, f"http://a.example/{i}", f"<html>page {i % 7} {'text ' * (i % 7) * 30}</html>") for i in range(60)]
    rows += [(100, None, None), (101, "http://x\r\nWARC-Type: forged", ""), (102, "ü", "é日本"), (103, "u", "a\r\n\r\nb"), (104, "u", "x" * 400_000)]
    rows += [(0, "again", rows[0][2]), (None, "n", rows[1][2]), (None, "m", "alone"), (105, "u", "abc"), (106, "u", "abc")]
    df = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], SCHEMA).repartition(3)
    assert rows_of(warc.archived(df, archive_bytes=archive_bytes, smallest=smallest)) == expected(rows, smallest)


def test_nothing(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).collect() == []


def test_files(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    listed = warc.write_archives(pages, str(tmp_path / "out"))
    archives = [r.path for r in listed.collect()]
    assert archives
    seen = 0
    for path in archives:
        data = open(path, "rb").read()
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        size = int.from_bytes(data[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        # any reader that knows the dictionary sees one stream of records
        reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True)
        whole = reader.read()
        assert whole.count(b"WARC/1.1\r\n") >= len(list(warc.frames(memoryview(data)[8 + size :])))
        seen += sum(f["WARC-Type"] != "warcinfo" for f, _ in warc.read_records(data))
        assert len(data) < len(whole)
    assert seen == pages.count() == sum(r.records for r in listed.collect())


def test_damage_is_found(spark, tmp_path):
    made = bytearray(warc.archive([warc.record(1, "u", b"payload " * 50, None, False, warc.DATE)] * 3, warc.DATE))
    made[-6] ^= 1
    with pytest.raises((zstandard.ZstdError, ValueError)):
        list(warc.read_records(bytes(made)))
    with pytest.raises(ValueError, match="dictionary"):
        list(warc.read_records(b"\x28\xb5\x2f\xfd" + b"\0" * 20))
