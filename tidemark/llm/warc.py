"""WARC archives: writing, normalising whole-file gzip streams, and reading back by offset.

1. ``write_archives`` writes every row as a WARC/1.1 record.  Of rows with equal payloads the one with the
   smallest id is a response, the others are revisits of it (they carry no payload).  Each task writes whole
   files as a single gzip stream: compact, but nothing in them can be reached without inflating all before.
2. ``normalise`` inflates each such file once, as a stream, and rewrites every record as a gzip member of
   its own, with a sidecar index (offset, length and identity of each record, tab-separated lines).
   A second sidecar holds the place of every index line in eight bytes, so a run of records is found by seeking.
3. ``read_archives`` cuts the archives into runs of records by their indexes and reads the runs in parallel.

Archives lie in the folder all executors share.  Tasks name files after their attempt, and only the files
that finished tasks report are read on, so a lost executor or a repeated task leaves nothing behind that
counts.  No step holds more than one record's piece at a time, save for the row that Spark hands over.

Defined results: a null payload is empty, and empty payloads count as equal; a null id sorts after all
others and stays null; rows that repeat the smallest id and payload are all responses; a null url is left
out; control characters of a url are percent-encoded; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import file_system
from tidemark.session import scratch_path, stage

CHUNK = 1 << 20
FILE_BYTES = 1 << 30
RUN_RECORDS = 2_000
MOST_TASKS = 20_000
HEADER_LIMIT = 1 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-row:"
FILES = "path string, records long"
RECORDS = "id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, declared_digest string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_bytes(row_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> tuple[bytes, bytes]:
    """Header and block of one record, with the separators that end them."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{row_id or ''}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to or ''}>"]
    else:
        block += payload
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), block + b"\r\n\r\n"


def parse_header(head: bytes) -> dict[str, str]:
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record begins here: {version[:40]!r}")
    fields = (line.partition(":") for line in lines if line)
    return {name.strip().lower(): value.strip() for name, _, value in fields}


class RecordStream:
    """Splits a plain WARC byte stream into records without holding one whole."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def _more(self) -> bool:
        piece = next(self.chunks, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def __iter__(self):
        """(fields, pieces of the record as stored); the pieces must be read before the next record."""
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if len(self.held) > HEADER_LIMIT:
                    raise ValueError("a WARC header has no end")
                if not self._more():
                    if self.held:
                        raise ValueError("the WARC stream ends within a header")
                    return
            head = bytes(self.held[: end + 4])
            del self.held[: end + 4]
            fields = parse_header(head[:-4])
            yield fields, self._pieces(head, int(fields["content-length"]) + 4)

    def _pieces(self, head: bytes, left: int):
        yield head
        while left:
            if not self.held and not self._more():
                raise ValueError("the WARC stream ends within a record")
            piece = bytes(self.held[:left])
            del self.held[: len(piece)]
            left -= len(piece)
            yield piece


def inflate(source, size: int | None = None) -> Iterator[bytes]:
    """The plain bytes of a gzip stream of one or more members, in bounded pieces."""
    unpack, fresh = zlib.decompressobj(31), True
    while data := source.read(CHUNK if size is None else min(CHUNK, size)):
        size = None if size is None else size - len(data)
        while data:
            if unpack.eof:
                unpack, fresh = zlib.decompressobj(31), True
            piece = unpack.decompress(data, CHUNK)
            fresh = False
            if piece:
                yield piece
            data = unpack.unconsumed_tail or unpack.unused_data
        if size == 0:
            break
    if not fresh and not unpack.eof:
        raise ValueError("the gzip stream is cut off")


def _attempt_name() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}-{os.urandom(4).hex()}"


def _packed(kind: str, names: list[str], columns: list[list]) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64()}
    fields = dict(part.split() for part in kind.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(c, types[fields[n]]) for n, c in zip(names, columns)], names)


def _writer(folder: str, file_bytes: int):
    def write(batches):
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        name, out, pack, plain, records, part = _attempt_name(), None, None, 0, 0, 0
        done: tuple[list[str], list[int]] = ([], [])

        def close():
            out.write(pack.flush())
            out.close()
            done[0].append(f"{folder}/{name}-{part}.warc.gz")
            done[1].append(records)

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "first", "revisit"))):
                row_id, url, payload, first, revisit = (v.as_py() for v in row)
                if out is None:
                    out, pack, plain, records = store.open_output_stream(f"{base}/{name}-{part}.warc.gz", compression=None), zlib.compressobj(1, wbits=31), 0, 0
                for piece in record_bytes(row_id, url, payload or b"", first, revisit):
                    out.write(pack.compress(piece))
                    plain += len(piece)
                records += 1
                if plain >= file_bytes:
                    close()
                    out, part = None, part + 1
        if out is not None:
            close()
        yield _packed(FILES, ["path", "records"], list(done))

    return write


def write_archives(pages: DataFrame, folder: str, row_id: str = "page_id", payload: str = "html", url: str = "url", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes every row as a record; returns the manifest (path, records) of the whole-file streams."""
    rows = pages.select(
        F.col(f"`{row_id}`").alias("number"), F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    repeated = rows.groupBy("sha").agg(F.min("number").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    marked = rows.join(repeated, "sha", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("number").eqNullSafe(F.col("first")))
    out = marked.select(F.col("number").cast("string").alias("id"), "url", "payload", F.col("first").cast("string").alias("first"), "revisit")
    return stage(out.mapInArrow(_writer(folder, file_bytes), FILES))


def rewrite(source, target, index, places=None) -> int:
    """One whole-file stream to members of their own and an index; returns the number of records.

    ``places`` takes the start of every index line, and the end of the last, as little-endian 64-bit numbers.
    """
    at = count = line_at = 0
    for fields, pieces in RecordStream(inflate(source)):
        pack, length = zlib.compressobj(6, wbits=31), 0
        for piece in pieces:
            length += target.write(data) if (data := pack.compress(piece)) else 0
        length += target.write(pack.flush())
        entry = (at, length, fields.get("warc-type", ""), fields.get("warc-record-id", ""), fields.get("warc-target-uri", ""), fields.get("warc-payload-digest", ""))
        line = ("\t".join(map(str, entry)) + "\n").encode()
        index.write(line)
        if places is not None:
            places.write(struct.pack("<q", line_at))
        at, count, line_at = at + length, count + 1, line_at + len(line)
    if places is not None:
        places.write(struct.pack("<q", line_at))
    return count


def _one_task_each(rows: DataFrame, *keys: str) -> DataFrame:
    """The few rows of a manifest, each distinct key in a task of its own as far as ``MOST_TASKS`` allows.

    Rows are small but stand for large files, so what sizes shuffles by bytes would put them all into one task;
    an explicit number of ranges is left as it is.
    """
    return rows.repartitionByRange(max(1, min(rows.count(), MOST_TASKS)), *keys)


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites the listed archives into ``folder``; returns the manifest of the new ones.

    Each has two sidecars beside it: ``<path>.idx``, its index, and ``<path>.idx.at``, the places of the index lines.
    """

    def run(batches):
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        done: tuple[list[str], list[int]] = ([], [])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                origin, place = file_system(path)
                name = f"{_attempt_name()}.warc.gz"
                with (
                    origin.open_input_stream(place, compression=None) as source,
                    store.open_output_stream(f"{base}/{name}", compression=None) as target,
                    store.open_output_stream(f"{base}/{name}.idx", compression=None) as index,
                    store.open_output_stream(f"{base}/{name}.idx.at", compression=None) as places,
                ):
                    count = rewrite(source, target, index, places)
                done[0].append(f"{folder}/{name}")
                done[1].append(count)
        yield _packed(FILES, ["path", "records"], list(done))

    return stage(_one_task_each(archives, "path").mapInArrow(run, FILES))


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one member."""
    plain = zlib.decompress(member, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = parse_header(head)
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _named(value: str | None) -> str | None:
    return (value or "").strip("<>").removeprefix(ID) or None


def _reader(batches):
    names = [part.split()[0] for part in RECORDS.split(", ")]
    for batch in batches:
        for path, begin, end in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "stop"))):
            store, place = file_system(path)
            with store.open_input_file(f"{place}.idx") as index, store.open_input_file(f"{place}.idx.at") as places:
                lines = _index_lines(index, places, begin, end)
            rows: list[list] = [[] for _ in names]
            with store.open_input_file(place) as archive:
                for line in lines:
                    offset, length = map(int, line.split(b"\t", 2)[:2])
                    archive.seek(offset)
                    fields, payload = read_record(archive.read(length))
                    revisit = fields["warc-type"] == "revisit"
                    values = (
                        _named(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields["warc-type"], _named(fields.get("warc-refers-to")),
                        None if revisit else len(payload), None if revisit else digest_of(payload),
                        fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                    )
                    for column, value in zip(rows, values):
                        column.append(value)
            yield _packed(RECORDS, names, rows)


def _index_lines(index, places, begin: int, end: int) -> list[bytes]:
    """Lines begin to end of a sidecar, found by the places of the first and of the one after the last."""
    first, last = (struct.unpack("<q", places.read_at(8, 8 * k))[0] for k in (begin, end))
    return index.read_at(last - first, first).split(b"\n")[:-1]


def read_archives(archives: DataFrame, run_records: int = RUN_RECORDS) -> DataFrame:
    """One row for each record of the listed, normalised archives; revisits have no payload of their own."""
    runs = archives.where("records > 0").selectExpr("path", f"explode(sequence(0L, records - 1, {run_records}L)) AS begin", "records")
    runs = runs.select("path", "begin", F.least(F.col("begin") + run_records, "records").alias("stop"))
    return _one_task_each(runs, "path", "begin").mapInArrow(_reader, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the full payload's size and digest: those of the response that a revisit refers to."""
    responses = (
        records.where("record_type = 'response'").groupBy(F.col("id").alias("refers_to"), F.col("payload_digest").alias("declared_digest"))
        .agg(F.max("payload_bytes").alias("__bytes"))
    )
    own = records.where("record_type <> 'revisit'").select("id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("string").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'").join(responses, ["refers_to", "declared_digest"], "left")
    return own.unionByName(revisits.select("id", F.col("__bytes").alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), "record_type", "refers_to"))


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes, normalises and reads back ``pages``: id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    whole = write_archives(pages, scratch_path(spark, "warc-streams"), **columns)
    members = normalise(whole, scratch_path(spark, "warc-members"))
    return resolved(stage(read_archives(members)))
