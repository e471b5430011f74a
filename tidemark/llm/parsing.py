"""Document fingerprints by locally consistent parsing.

A text is parsed level by level.  Runs of one symbol become one symbol; deterministic coin tossing then
replaces every symbol by the lowest bit in which its name differs from the name before it (and that bit's
value), three times, until labels are under eight and neighbours still differ; phrases begin where a label
is larger than both neighbours; a phrase's name is a hash of its symbols and is a symbol of the next level.
Where a phrase begins depends on a few neighbours only, so equal substrings get equal names in their
interior wherever they stand.

The fingerprint keeps, for each of three levels (phrases of about 3, 10 and 30 bytes), the smallest name hash
in each of 64 bins.  The likeness of two fingerprints is the share of filled bins that agree, over the two
upper levels, and over the lowest too where texts are so short that the second level is nearly empty.

Defined results: equal texts have equal fingerprints and likeness 1; null and empty texts have an empty
fingerprint, like each other and unlike all others; repeated rows are each other's next documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, utf8

LEVELS, BINS = 3, 64
FEW = 12  # filled bins of the second level below which the first level counts
SLICE_BYTES = 2 << 20
ROWS_AT_ONCE = 1_000
START = np.uint64(0x9E3779B97F4A7C15)  # stands before the first symbol of a text
ODD = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


SYMBOLS = _mix(np.arange(1, 257, dtype=np.uint64))
POWERS = np.cumprod(np.full(64, 0x2545F4914F6CDD1D, np.uint64))


def _toss_table(size: int) -> np.ndarray:
    """Labels of (before, own) for names under ``size``; the row ``size`` stands before the first."""
    before, own = np.arange(size + 1, dtype=np.uint64)[:, None], np.arange(size, dtype=np.uint64)[None, :]
    differ = before ^ own
    place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    place[before == own] = 0  # neighbours differ, so this is never read
    return (2 * place + ((own >> place) & np.uint64(1))).astype(np.uint8)


SECOND, THIRD = _toss_table(128), _toss_table(16)


def _before(x: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = first
    return out


def coin_tosses(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels under eight of a symbol sequence whose neighbours differ; ``starts`` begin new texts."""
    differ = names ^ _before(names, starts, START)
    place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    labels = (2 * place + ((names >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    labels = SECOND[_before(labels, starts, 128), labels]
    return THIRD[_before(labels, starts, 16), labels]


def _collapsed(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one name as one symbol, named by symbol and length."""
    fresh = np.empty(len(names), bool)
    fresh[0] = True
    np.not_equal(names[1:], names[:-1], out=fresh[1:])
    fresh[starts] = True
    if fresh.all():
        return names, starts
    at = np.flatnonzero(fresh)
    length = np.diff(np.append(at, len(names)))
    out = names[at]
    long = length > 1
    out[long] = _mix(out[long] + length[long].astype(np.uint64) * ODD)
    return out, np.searchsorted(at, starts)


def next_level(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of a level, and where texts start among them.  Every text has at least one symbol."""
    names, starts = _collapsed(names, starts)
    labels = coin_tosses(names, starts).astype(np.int8)
    after = np.empty_like(labels)
    after[:-1] = labels[1:]
    after[-1] = -1
    after[starts[1:] - 1] = -1
    begin = (labels > _before(labels, starts, np.int8(127))) & (labels > after)
    begin[starts] = True
    at = np.flatnonzero(begin)
    inside = np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))
    phrases = np.add.reduceat(_mix(names) * POWERS[inside], at)
    return _mix(phrases), np.searchsorted(at, starts)


def sketches(texts: pa.Array) -> np.ndarray:
    """Fingerprints as numbers: (texts, levels, bins), 0 where a bin is empty."""
    data, offsets = utf8(texts)
    out = np.zeros((len(texts), LEVELS, BINS), np.uint16)
    for a, b in slices(offsets, SLICE_BYTES):
        full = a + np.flatnonzero(np.diff(offsets[a : b + 1]))
        if not len(full):
            continue
        names = SYMBOLS[data[offsets[a] : offsets[b]]]
        starts = offsets[full] - offsets[a]
        for level in range(LEVELS):
            names, starts = next_level(names, starts)
            owner = np.repeat(full.astype(np.uint64), np.diff(np.append(starts, len(names))))
            # by text, bin and hash: the first of each (text, bin) is the smallest
            ordered = np.sort(((owner * np.uint64(BINS)) + (names >> np.uint64(58))) << np.uint64(32) | (names & np.uint64(0xFFFFFFFF)))
            place = (ordered >> np.uint64(32)).astype(np.int64)
            least = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            out[place[least] // BINS, level, place[least] % BINS] = (ordered[least] & np.uint64(0xFFFF)) % np.uint64(0xFFFF) + np.uint64(1)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of two arrays of fingerprints, row by row: 0 to 1."""
    same = ((x == y) & (x > 0)).sum(axis=2)
    filled = ((x > 0) | (y > 0)).sum(axis=2)
    short = (filled[:, 1] < FEW).astype(int)
    agree = same[:, 1] + same[:, 2] + short * same[:, 0]
    among = filled[:, 1] + filled[:, 2] + short * filled[:, 0]
    return np.where(among == 0, 1.0, agree / np.maximum(among, 1))


def as_text(fingerprints: np.ndarray) -> list[str]:
    """Hexadecimal, four digits for each bin."""
    return [row.astype(">u2").tobytes().hex() for row in fingerprints]


def from_text(fingerprints: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(fingerprints)), ">u2").astype(np.uint16).reshape(-1, LEVELS, BINS)


def add_fingerprints(docs: DataFrame, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of every whole text; nothing is shuffled."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(as_text(sketches(texts)))

    return docs.withColumn(fingerprint, of.asNondeterministic()(F.col(f"`{text}`")))


def add_likeness(rows: DataFrame, one: str, other: str, name: str = "likeness") -> DataFrame:
    """Adds the likeness of two fingerprint columns."""

    @F.arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(likeness(from_text(x.to_pylist()), from_text(y.to_pylist())))

    return rows.withColumn(name, of(F.col(f"`{one}`"), F.col(f"`{other}`")))


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_rows(ids: list, texts: list[str], marks: np.ndarray, own: np.ndarray | None = None):
    """The result of every row but the last; ``marks`` are 0 for rows that only stand ahead."""
    own = sketches(pa.array(texts, pa.string())) if own is None else own
    edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for t, after in zip(texts[:-1], texts[1:])]
    changed = sketches(pa.array(edited, pa.string()))
    keep = np.flatnonzero(marks[:-1])
    near_edited, near_next = likeness(own[:-1], changed), likeness(own[:-1], own[1:])
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([ids[k] for k in keep], pa.int64()),
        "n_chars": pa.array([len(texts[k]) for k in keep], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(edited[k].encode()).hexdigest() for k in keep], pa.string()),
        "fingerprint": pa.array(as_text(own[:-1][keep]), pa.string()),
        "edited_fingerprint": pa.array(as_text(changed[keep]), pa.string()),
        "near_edited": pa.array(near_edited[keep]),
        "near_next": pa.array(near_next[keep]),
    })


def _edits(batches):
    """Rows in order (bucket, rows before the one ahead, id); each is edited with the row behind it."""
    ids, texts, marks, own = [], [], np.zeros(0, bool), None
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            fresh = batch.column("text").fill_null("")
            found = sketches(fresh)
            ids += batch.column("doc_id").to_pylist()
            texts += fresh.to_pylist()
            marks = np.concatenate((marks, batch.column("ahead").to_numpy(zero_copy_only=False) == 0))
            own = found if own is None else np.concatenate((own, found))
            yield edit_rows(ids, texts, marks, own)
            ids, texts, marks, own = ids[-1:], texts[-1:], marks[-1:], own[-1:]


def beside_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(bucket, ahead, doc_id, text), partitioned and sorted so that each row's next document stands behind it.

    Ids are cut into ranges; each range also gets the first document of the next one (the last range that of
    the first), marked ``ahead``.  Texts are shuffled once.  To the driver come one boundary and one first id
    for each range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(100 * n))).first()[0] if n > 1 else None
    edges = np.unique(np.array(cuts or [], np.int64))

    @F.arrow_udf("int")
    def bucket_of(ids: pa.Array) -> pa.Array:
        known = ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(edges, known, side="left").astype(np.int32))

    placed = rows.select("doc_id").withColumn("bucket", bucket_of("doc_id"))
    found = sorted(placed.groupBy("bucket").agg(F.min("doc_id"), F.count("*") > F.count("doc_id")).collect())
    first = {b: None if with_null else low for b, low, with_null in found}
    order = [b for b, *_ in found]
    ahead_of = {b: order[k - 1] for k, b in enumerate(order)}

    @F.arrow_udf("array<struct<bucket:int, ahead:int>>")
    def places(ids: pa.Array) -> pa.Array:
        known = ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        out = []
        for i, b in zip(ids.to_pylist(), np.searchsorted(edges, known, side="left").tolist()):
            mine = [{"bucket": b, "ahead": 0}]
            out.append([*mine, {"bucket": ahead_of[b], "ahead": 1}] if i == first[b] else mine)
        return pa.array(out, pa.list_(pa.struct([("bucket", pa.int32()), ("ahead", pa.int32())])))

    spread = rows.withColumn("place", F.explode(places("doc_id"))).select("place.bucket", "place.ahead", "doc_id", "text")
    return spread.repartition(n, "bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), "text")


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Every document against its edited text (last quarter from the next document) and its next document."""
    return beside_next(docs, doc_id, text, buckets).mapInArrow(_edits, EDITS)
