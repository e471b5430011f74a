"""SimHash near-duplicates, compared through pivot distance tables.

A fingerprint bit is set where more than half of the shingle hashes set it.  Two fingerprints link when
they differ in at most ``radius`` bits.  The work after hashing is on distinct fingerprints:

1. Meeting.  Pivot distances alone would compare all pairs, so fingerprints first meet by pigeonhole:
   of ``radius + 3`` bit blocks, linked fingerprints agree on three at least, and each choice of three
   blocks is a key (35 keys for a radius of 4).  Keys that more than ``CHUNK`` fingerprints share are cut
   into chunks, and every pair of chunks is one group, so no group exceeds two chunks and none is missed.
2. Pivot tables.  Within a group the Hamming distances to ``PIVOTS`` reference fingerprints are tabled
   once; by the triangle inequality a pair whose largest coordinate difference exceeds the radius cannot
   link and is discarded; survivors are verified by counting differing bits.
3. Links.  A group is explored breadth first, each fingerprint against those not yet reached, so it yields
   a spanning forest (linear in its size) and a dense group costs about as much as its size.
4. Components of the forests' edges by stars.

Defined results: words are runs without ASCII white space, A-Z folded; a text of fewer words than a shingle
is one shingle; null, empty and blank texts have fingerprint zero and link like any other.  A null id gets
the smallest id of its component (null if there is none).  Repeated rows stay repeated.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_strings
from tidemark.llm.components import components
from tidemark.session import stage

SEED = 42
PIVOTS = 16
CHUNK = 16_384
HASHES_AT_ONCE = 65_536


def fingerprint(text: bytes, shingle: int) -> int:
    """The unsigned 64-bit SimHash of one text."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = slice(at, min(n, at + HASHES_AT_ONCE))
        hashes = np.array([digest(joined[b:e], SEED) for b, e in zip(begins[part], stops[part])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """Adds ``fp``: the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t, shingle) for t in byte_strings(texts)], np.uint64)
        return pa.array(found.view(np.int64))

    return docs.withColumn("fp", simhash.asNondeterministic()(F.col(f"`{text}`")))


def block_keys(fp: F.Column, radius: int) -> F.Column:
    """One key for each choice of three of ``radius + 3`` blocks: the choice's number and the blocks' bits."""
    blocks = radius + 3
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    keys = []
    for number, choice in enumerate(combinations(range(blocks), 3)):
        mask = sum(masks[k] for k in choice)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).cast("short").alias("table"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return F.array(*keys)


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of every fingerprint to fixed pseudo-random reference fingerprints."""
    references = np.random.default_rng(SEED).integers(0, 1 << 64, pivots, np.uint64)
    return np.stack([np.bitwise_count(fps ^ r) for r in references], axis=1).astype(np.int8)


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions (from, to) of a spanning forest of the links among different fingerprints."""
    table = pivot_table(fps)
    left = np.arange(len(fps))
    edges: list[tuple[int, int]] = []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.abs(table[left, 0] - table[x, 0]) <= radius
            at = np.flatnonzero(near)
            at = at[(np.abs(table[left[at]] - table[x]).max(axis=1) <= radius)]
            at = at[np.bitwise_count(fps[left[at]] ^ fps[x]) <= radius]
            if len(at):
                found = left[at].tolist()
                edges += [(x, y) for y in found]
                frontier += found
                left = np.delete(left, at)
    return edges


def _link_groups(radius: int):
    """Batches sorted by (table, bits, i, j) to edges; a group may run over batches."""

    def edges(keys: np.ndarray, fps: np.ndarray):
        cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fps)]))
        many = ends - begins
        pairs = begins[many == 2]
        linked = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= radius]
        out = [np.stack((fps[linked], fps[linked + 1]), axis=1)]
        for b, e in zip(begins[many > 2].tolist(), ends[many > 2].tolist()):
            part = fps[b:e]
            tree = forest(part, radius)
            if tree:
                out.append(part[np.array(tree)])
        found = np.concatenate(out).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    def run(batches):
        held_keys, held_fps = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("table", "bits", "i", "j")], axis=1)
            held_keys = np.concatenate((held_keys, keys))
            held_fps = np.concatenate((held_fps, batch.column("fp").to_numpy().view(np.uint64)))
            whole = np.flatnonzero(np.any(held_keys != held_keys[-1], axis=1)) if len(held_fps) else []
            if len(whole):
                cut = int(whole[-1]) + 1
                yield edges(held_keys[:cut], held_fps[:cut])
                held_keys, held_fps = held_keys[cut:], held_fps[cut:]
        if len(held_fps):
            yield edges(held_keys, held_fps)

    return run


def link_fingerprints(distinct: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) whose components are those of all links among the distinct ``fp``."""
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("key")).select("fp", "key.table", "key.bits")
    crowded = stage(
        keyed.groupBy("table", "bits").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
        .select("table", "bits", F.ceil(F.col("n") / (chunk // 2)).cast("int").alias("chunks"))
    )
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    placed = (
        keyed.join(crowded, ["table", "bits"], "left")
        .withColumn("mine", F.coalesce(mine, F.lit(0)))
        .withColumn("other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
        .select("fp", "table", "bits", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )
    group = ["table", "bits", "i", "j"]
    dealt = placed.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(_link_groups(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, digest, fp, fingerprint, root, component_id) for every row of ``docs``.

    ``digest`` is XXH64 of the text, ``root`` the smallest fingerprint of the component.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("digest"), F.col(f"`{text}`").alias("text"))
    rows = stage(fingerprints(narrow, shingle=shingle).drop("text"))
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = stage(components(link_fingerprints(distinct, radius)))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(smallest, "root").select("fp", "root", "component_id")
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(labels, "fp").select("doc_id", "digest", "fp", fingerprint, "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (a null id only where there is no other), then text digest.

    Columns are as they were.  Texts are shuffled once, by id and digest.
    """
    found = near_duplicates(docs, doc_id, text, **options)
    leader = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("leader")
    leaders = found.groupBy("root").agg(leader).select(F.col("leader.doc_id").alias("__id"), F.col("leader.digest").alias("__leader"))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__leader"))
    kept = docs.withColumn("__digest", F.xxhash64(f"`{text}`")).join(leaders, same, "left_semi")
    return kept.dropDuplicates([doc_id, "__digest"]).drop("__digest")
