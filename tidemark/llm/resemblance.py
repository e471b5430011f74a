"""Near-duplicates by SimHash, completed to exact Jaccard similarity: every linked pair is found, every link is checked.

Two texts link when the Jaccard similarity of their sets of five-word shingles is 0.8 or more.  SimHash
fingerprints of the same shingles, compared by their pivot tables (``simhash.py``), bring close copies
together.  No radius of bits follows from a similarity, so what they miss comes from the sets themselves
and no link is lost:

1. Fingerprints.  Different fingerprints within ``simhash``'s radius of four bits, and sets of one fingerprint,
   are candidates of the first round.
2. Meeting.  Of sets A and B that link, A shares at least 0.8 |A| shingles with B.  In an order common to all
   sets (that of the hashes) the first |A| - ceil(0.8 |A|) + 1 shingles of A therefore hold one that is also
   among the first ones of B.  Each of these is a key.  Keys that more than ``CHUNK`` sets share are cut into
   chunks, and every pair of chunks is one group.
3. Sketches.  A sketch is the parity of the shingles in each of so many cells as the set has shingles, or more,
   so two sketches differ in no more cells than the sets do in shingles; linked sets differ in at most
   (|A| + |B|) / 9.  The wider of two sketches is folded to the width of the other.
4. Close copies first.  Fingerprints and the first ``EARLY`` keys bring nearly all close copies together.  A group
   of keys yields a spanning forest of what sketches allow; each candidate of both is verified on the whole sets, and
   components of the links merge.  Nothing is decided by what this misses.
5. The rest, exactly.  Of all keys only those that different components share are left, which is few.  There a
   group yields every pair of different components that sketches allow, one row a pair, to be verified.

A pair is verified once, by joining both whole sets to it.  Components of all links by stars.

Defined results: words are runs without ASCII white space, A-Z folded; a text of fewer words than a shingle is
one shingle; null, empty and blank texts are the empty set and link like any other equal sets.  Sets are those
of 64-bit hashes.  Repeated rows of equal id and text leave one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import byte_strings
from tidemark.llm.components import components
from tidemark.session import discard, stage, stage_at

SHINGLE = 5
BITS = 1024  # the narrowest sketch
CHUNK = 2048
EARLY = 4


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted different 64-bit hashes of a text's shingles."""
    words = text.lower().split()
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    width = min(shingle, len(h))
    if not width:
        return h
    n = len(h) - width + 1
    v = h[:n].copy()
    for k in range(1, width):
        v = v * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(32)
    return np.unique(v)


def prefix_length(size: int) -> int:
    """So many of the first shingles of a set meet those of every set that links with it."""
    return size - -(-4 * size // 5) + 1 if size else 0


def sketch(shingled: np.ndarray) -> bytes:
    bits = max(BITS, 1 << (len(shingled) - 1).bit_length()) if len(shingled) else BITS
    cells = np.bincount((shingled & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(cells & 1 == 1).tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of as many or more 64-bit words at a width of ``words``: parities of cells that fall together."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


_DESCRIBED = pa.struct([("node", pa.int64()), ("fp", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def _described(text: F.Column) -> F.Column:
    @F.arrow_udf("struct<node:bigint,fp:bigint,size:bigint,sketch:binary,prefix:array<bigint>>")
    def described(texts: pa.Array) -> pa.Array:
        out = []
        for t in byte_strings(texts):
            s = shingles(t)
            node = int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))
            fp = int(np.uint64(simhash.fingerprint(t, SHINGLE)).view(np.int64))
            out.append({"node": node, "fp": fp, "size": len(s), "sketch": sketch(s), "prefix": s[: prefix_length(len(s))].view(np.int64).tolist()})
        return pa.array(out, _DESCRIBED)

    return described.asNondeterministic()(text)


def _sets(text: F.Column) -> F.Column:
    @F.arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t).tobytes() for t in byte_strings(texts)], pa.binary())

    return sets.asNondeterministic()(text)


def _explore(n: int, near) -> list[tuple[int, int]]:
    """Positions (from, to) of a spanning forest; ``near(x, left)`` are the places in ``left`` that link with x."""
    left = np.arange(n)
    edges: list[tuple[int, int]] = []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            at = near(x, left)
            if len(at):
                found = left[at].tolist()
                edges += [(x, y) for y in found]
                frontier += found
                left = np.delete(left, at)
    return edges


class _Sketched:
    """Sizes and sketches of a group; which of its sets may link with one of them."""

    def __init__(self, rows: list) -> None:
        self.sizes = np.array([r["size"] for r in rows])
        packed = [np.frombuffer(r["sketch"], np.uint64) for r in rows]
        self.words = np.array([len(p) for p in packed])
        self.place = np.zeros(len(rows), np.int64)
        self.of_width = {}
        for w in np.unique(self.words).tolist():
            mine = np.flatnonzero(self.words == w)
            self.place[mine] = np.arange(len(mine))
            self.of_width[w] = np.stack([packed[k] for k in mine])

    def near(self, x: int, left: np.ndarray) -> np.ndarray:
        """Places in ``left`` of the sets that sizes and sketches do not rule out."""
        sizes, own = self.sizes, int(self.words[x])
        at = np.flatnonzero((4 * sizes[left] <= 5 * sizes[x]) & (4 * sizes[x] <= 5 * sizes[left]))
        differ = np.zeros(len(at), np.int64)
        for w in np.unique(self.words[left[at]]).tolist():
            same = np.flatnonzero(self.words[left[at]] == w)
            width = min(w, own)
            others = folded(self.of_width[w][self.place[left[at[same]]]], width)
            mine = folded(self.of_width[own][self.place[x] : self.place[x] + 1], width)
            differ[same] = np.bitwise_count(others ^ mine).sum(axis=1, dtype=np.int64)
        return at[9 * differ <= sizes[left[at]] + sizes[x]]


def candidate_forest(rows: list) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and sketches do not rule out."""
    return _explore(len(rows), _Sketched(rows).near)


def candidate_pairs(rows: list) -> list[tuple[int, int]]:
    """All pairs of different components (``root``) that sizes and sketches do not rule out."""
    group, roots = _Sketched(rows), np.array([r["root"] for r in rows])
    out = []
    for x in range(len(rows)):
        others = x + 1 + np.flatnonzero(roots[x + 1 :] != roots[x])
        out += [(x, y) for y in others[group.near(x, others)].tolist()]
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more of two sorted sets without repeats."""
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
    return 9 * common >= 4 * (len(a) + len(b))


def _by_group(keys: tuple[str, ...], forest):
    """Batches sorted by ``keys`` to edges (a, b) of every group's forest; a group may run over batches."""

    def edges(nodes: list, rows: list):
        return [(nodes[i], nodes[j]) for i, j in forest(rows)] if len(nodes) > 1 else []

    def run(batches):
        at, nodes, rows, out = None, [], [], []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["a", "b"])
            out.clear()
            return batch

        for batch in batches:
            groups = zip(*(batch.column(k).to_pylist() for k in keys))
            for group, node, row in zip(groups, batch.column("node").to_pylist(), batch.column("row").to_pylist()):
                if group != at:
                    out += edges(nodes, rows)
                    at, nodes, rows = group, [], []
                nodes.append(node)
                rows.append(row)
            yield flush()
        out += edges(nodes, rows)
        yield flush()

    return run


def _in_chunks(members: DataFrame, key: str, chunk: int) -> DataFrame:
    """(key, node, i, j) so that every two members of a key share a group; keys of one member go."""
    sizes = members.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    chunks = stage(sizes.select(key, F.when(F.col("n") <= chunk, 1).otherwise(F.ceil(F.col("n") / (chunk // 2))).cast("int").alias("chunks")))
    return (
        members.join(chunks, key)
        .withColumn("mine", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(key, "node", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )


def _pairs(keyed: DataFrame, described: DataFrame, chunk: int, find) -> DataFrame:
    """(a, b), a < b: what ``find`` yields within the sets that share a key."""
    group = ["key", "i", "j"]
    met = _in_chunks(keyed, "key", chunk).join(described, "node")
    dealt = met.repartition(*group).sortWithinPartitions(*group, "node")
    edges = dealt.mapInArrow(_by_group(tuple(group), find), "a long, b long")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: candidates by SimHash of the sets ``node`` with fingerprint ``fp``.

    Sets of one fingerprint meet its smallest set; the smallest sets of different fingerprints meet along the
    spanning forests that ``simhash`` finds by pivot tables.
    """
    leads = nodes.groupBy("fp").agg(F.min("node").alias("lead"))
    same = nodes.join(leads, "fp").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    lead = lambda k: leads.select(F.col("fp").alias(k), F.col("lead").alias(f"lead_{k}"))
    near = simhash.link_fingerprints(leads.select("fp")).join(lead("a"), "a").join(lead("b"), "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    met = same.unionByName(near).where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, first: DataFrame, narrow: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar; each text is shingled once, each pair meets both sets once."""
    spark = pairs.sparkSession
    pairs, asked = stage_at(pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(first, "node").select("node", F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest"))
    same = narrow["doc_id"].eqNullSafe(F.col("__id")) & (narrow["digest"] == F.col("__digest"))
    texts = narrow.join(wanted, same).groupBy("node").agg(F.first("text").alias("text"))
    sets, written = stage_at(texts.select("node", _sets(F.col("text")).alias("row")))

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    one, other = (sets.select(F.col("node").alias(k), F.col("row").alias(f"set_{k}")) for k in "ab")
    checked = pairs.join(one, "a").join(other, "b").where(alike("set_a", "set_b")).select("a", "b")
    links = stage(checked)
    discard(spark, asked)
    discard(spark, written)
    return links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, early: int = EARLY) -> DataFrame:
    """(doc_id, digest, root) for every row of ``docs``: ``root`` is a set of the component, ``digest`` XXH64 of the text."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("digest"), F.col(f"`{text}`").alias("text"))
    rows, path = stage_at(narrow.select("doc_id", "digest", _described(F.col("text")).alias("d")).select("doc_id", "digest", "d.*"))
    first = F.min(F.struct("doc_id", "digest")).alias("first")
    distinct = stage(rows.groupBy("node").agg(first, F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix")))
    rows, described = stage(rows.select("doc_id", "digest", "node")), path
    discard(docs.sparkSession, described)

    soon = distinct.select("node", F.explode(F.slice("prefix", 1, early)).alias("key"))
    sketched = distinct.select("node", F.struct("size", "sketch").alias("row"))
    candidates = fingerprint_pairs(distinct.select("node", "fp")).unionByName(_pairs(soon, sketched, chunk, candidate_forest)).distinct()
    close = _verified(candidates, distinct.select("node", "first"), narrow)
    merged = stage(components(close))

    rooted = distinct.join(merged, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keyed = rooted.select("node", "root", F.explode("prefix").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    apart, kept = stage_at(keyed.join(shared, "key", "left_semi").select("node", "key"))
    sketched = rooted.select("node", F.struct("size", "sketch", "root").alias("row"))
    rest = _verified(_pairs(apart, sketched, chunk, candidate_pairs), distinct.select("node", "first"), narrow)
    discard(docs.sparkSession, kept)
    found = stage(components(close.unionByName(rest)))
    return rows.join(found, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (a null id only where there is no other), then text digest.

    Columns are as they were.
    """
    leader = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("leader")
    leaders = near_duplicates(docs, doc_id, text, **options).groupBy("root").agg(leader)
    leaders = leaders.select(F.col("leader.doc_id").alias("__id"), F.col("leader.digest").alias("__leader"))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__leader"))
    kept = docs.withColumn("__digest", F.xxhash64(f"`{text}`")).join(leaders, same, "left_semi")
    return kept.dropDuplicates([doc_id, "__digest"]).drop("__digest")
