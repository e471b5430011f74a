import base64
import gzip
import hashlib
import io
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.common import file_system
from tidemark.session import scratch_path


def slow(rows):
    first = {}
    for i, h in rows:
        h = (h or "").encode()
        first[h] = min((x for x in (i, first.get(h)) if x is not None), default=None)
    out = []
    for i, h in rows:
        h = (h or "").encode()
        again = first[h] is not None and first[h] != i
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


def back(df):
    rows = df.collect()
    number = lambda v: None if v is None else int(v)
    return sorted([(number(r.id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in rows], key=str)


PAYLOADS = [None, "", "x", "é" * 10, "z", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"]


def rows(n=80):
    rng = random.Random(3)
    out = [(k, rng.choice(PAYLOADS)) for k in range(n)]
    return [*out, (n, "y" * 3_000_000), (n + 1, "y" * 3_000_000), out[5], out[5], (None, "z"), (None, "only here")]


def frame_of(frame, data):
    return frame([(k, f"http://a b/\n{k}é" if (k or 0) % 3 else None, h, "clash") for k, h in data], "page_id long, url string, html string, sha string")


@pytest.mark.parametrize("file_bytes", [warc.FILE_BYTES, 2_000])
def test_round_trip_equals_brute_force(frame, file_bytes):
    assert back(warc.round_trip(frame_of(frame, rows()), file_bytes=file_bytes)) == slow(rows())


def test_empty_table(frame):
    assert warc.round_trip(frame_of(frame, rows()).where("false")).count() == 0


def test_each_record_is_a_member_at_its_offset(spark, frame):
    whole = warc.write_archives(frame_of(frame, rows()), scratch_path(spark, "t"))
    new = warc.normalise(whole, scratch_path(spark, "t"))
    assert {r.records for r in whole.collect()} <= {r.records for r in new.collect()}
    plain = []
    for manifest in (whole, new):
        found = []
        for r in manifest.collect():
            store, path = file_system(r.path)
            data = store.open_input_file(path).read()
            found.append(gzip.decompress(data))
            if manifest is new:
                lines = store.open_input_file(path + ".idx").read().decode().splitlines()
                assert len(lines) == r.records
                at = 0
                for line in lines:
                    offset, length = map(int, line.split("\t")[:2])
                    member = zlib.decompressobj(31)
                    record = member.decompress(data[offset : offset + length])
                    assert offset == at and member.eof and not member.unused_data and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
                    at += length
                assert at == len(data)
        plain.append(sorted(found))
    assert plain[0] == plain[1]


def test_small_runs_read_the_same(spark, frame):
    members = warc.normalise(warc.write_archives(frame_of(frame, rows()), scratch_path(spark, "t")), scratch_path(spark, "t"))
    assert back(warc.resolved(warc.read_archives(members, run_records=3))) == slow(rows())


def test_streams_and_runs_have_a_task_each(spark, frame):
    whole = warc.write_archives(frame_of(frame, rows()), scratch_path(spark, "t"), file_bytes=2_000)
    streams = whole.count()
    spread = warc._one_task_each(whole, "path")
    assert streams > 8 and spread.rdd.getNumPartitions() == streams
    assert spread.groupBy(F.spark_partition_id()).count().where("count > 1").count() == 0
    members = warc.normalise(whole, scratch_path(spark, "t"))
    runs = sum(-(-r.records // 3) for r in members.collect())
    read = warc.read_archives(members, run_records=3)
    assert read.rdd.getNumPartitions() == runs and read.select(F.spark_partition_id()).distinct().count() == runs


def test_index_lines_are_found_by_place():
    record = [b"".join(warc.record_bytes(str(k), "http://é/" * k, b"p" * k, None, False)) for k in range(30)]
    target, index, places = io.BytesIO(), io.BytesIO(), io.BytesIO()
    assert warc.rewrite(io.BytesIO(gzip.compress(b"".join(record))), target, index, places) == 30
    lines = index.getvalue().splitlines()
    files = [pa.BufferReader(f.getvalue()) for f in (index, places)]
    for begin, end in ((0, 30), (0, 1), (29, 30), (7, 19), (5, 5)):
        assert warc._index_lines(*files, begin, end) == lines[begin:end]


def test_broken_streams_are_errors():
    record = b"".join(warc.record_bytes("1", "http://a/", b"payload", None, False))
    whole = gzip.compress(record * 3)
    for broken in (whole[:-20], gzip.compress(record[:-3]), gzip.compress(b"nonsense\r\n\r\n")):
        with pytest.raises((ValueError, KeyError, zlib.error)):
            warc.rewrite(io.BytesIO(broken), io.BytesIO(), io.BytesIO())
    target, index = io.BytesIO(), io.BytesIO()
    assert warc.rewrite(io.BytesIO(gzip.compress(record) + gzip.compress(record)), target, index) == 2


def test_query_equals_brute_force(spark):
    from tidemark.llm.queries import op3_warc

    sf = "/root/testdata/sf0.001"
    data = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, op3_warc(spark, sf).collect()), key=str) == slow(data)
