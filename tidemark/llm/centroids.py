"""Exact centroid clustering with an incremental table of dot products.

A component x becomes the integer floor(scale * x), so every product, sum and distance is exact and no result
depends on the order of rows.  The state keeps, per vector, its components, its squared norm and its dot product
with each centroid.  A centroid that moves changes few components by whole numbers; a round adds
``x[i] * change[i]`` for these components alone and takes the argmin anew.  The first dot products are the same
step from centroids of zero.  Sums of clusters are kept up to date the same way, from vectors that changed place.

Each round is one pass without a shuffle of vectors: a task adds up its own movers and hands on one row a
cluster.  States are Parquet tables in the shared folder; a state that its successor has read is deleted.
What the driver holds is centroids and sums, k x dimension numbers.  Rounds in which no centroid moved
change nothing and end the loop early.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are left
out; equal rows are vectors of their own with equal results; starts are the vectors whose SHA-256 of
``salt:id`` is smallest (ties: smaller components; null ids last), fewer than k vectors give fewer centroids;
clusters that lose all vectors keep their centroid; an empty table gives an empty table.  Components, products
or sums that need more than 64 bits raise an error, as no long could hold the distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, stage_at

_STATE = "x binary, norm bigint, dots binary, cluster int, before int, distance bigint"
_SIGN = np.int64(-1 << 63)


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact x @ y of whole numbers: in doubles or longs where these are wide enough, else in Python's integers."""
    if not x.size or not y.size:
        return np.zeros((x.shape[0], y.shape[1]), np.int64)
    bound = max(int(x.max()), -int(x.min())) * max(int(y.max()), -int(y.min())) * x.shape[1]
    if bound < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
    if bound < 1 << 62:
        return x @ y
    return (x.astype(object) @ y.astype(object)).astype(np.int64)  # raises where a long is too narrow


def _packed(values: np.ndarray) -> pa.Array:
    """Rows of whole numbers as bytes that sort as the numbers do."""
    data = (values ^ _SIGN).astype(">i8").tobytes()
    at = np.arange(len(values) + 1, dtype=np.int32) * np.int32(8 * values.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(at), pa.py_buffer(data)])


def _rows(column: pa.Array, width: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, ">i8").astype(np.int64).reshape(len(column), width) ^ _SIGN


def _numbers(width: int, scale: int):
    """Batches (id, v) of vectors of the right length to (id, x) of those without a null or non-finite component."""

    def run(batches):
        for b in batches:
            v = b.column("v").flatten().cast(pa.float64())
            v = v.to_numpy(zero_copy_only=False).reshape(len(b), width)  # null components become NaN
            finite = np.isfinite(v).all(axis=1)
            x = np.floor(v[finite] * float(scale))
            if x.size and np.abs(x).max() >= 1 << 62:
                raise OverflowError("a component needs more than 64 bits")
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(finite)), _packed(x.astype(np.int64))], ["id", "x"])

    return run


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, dimension: int, scale: int) -> DataFrame:
    """(id, x): the usable vectors in whole numbers, packed."""
    named = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").alias("v")).where(F.size("v") == dimension)
    return named.mapInArrow(_numbers(dimension, scale), f"id {named.schema['id'].dataType.simpleString()}, x binary")


def _advance(width: int, k: int, changes: list[tuple[int, list[int], list[int]]], norms: list[int]):
    """Batches (id, x[, norm, dots, cluster]) to states: dot products moved by the changes, then the nearest centroid.

    ``changes``: (centroid, its components that changed, by how much).
    """
    square = np.array([norms], np.int64)
    steps = [(c, np.array(at), np.array(by, np.int64)[:, None]) for c, at, by in changes]

    def run(batches):
        for b in batches:
            n, names = len(b), b.schema.names
            x = _rows(b.column("x"), width)
            if "dots" in names:
                norm, dots, before = b.column("norm"), _rows(b.column("dots"), k).copy(), b.column("cluster")
            else:
                wide = x.astype(object) if x.size and max(int(x.max()), -int(x.min())) >= 1 << 28 else x
                norm = pa.array((wide * wide).sum(axis=1).astype(np.int64) if n else [], pa.int64())
                dots, before = np.zeros((n, k), np.int64), pa.nulls(n, pa.int32())
            for c, at, by in steps:
                dots[:, c] += _product(x[:, at], by)[:, 0]
            near = square - 2 * dots
            cluster = near.argmin(axis=1).astype(np.int32)  # the first of equal ones
            distance = norm.to_numpy(zero_copy_only=False) + near[np.arange(n), cluster]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("x"), norm, _packed(dots), pa.array(cluster), before, pa.array(distance)],
                ["id", "x", "norm", "dots", "cluster", "before", "distance"],
            )

    return run


def _moves(width: int, k: int):
    """Batches (x, cluster, before) of movers to one row per cluster and task: change of its count and of its sums."""

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, width), object)
        for b in batches:
            x = _rows(b.column("x"), width)
            small = not x.size or max(int(x.max()), -int(x.min())) * len(x) < 1 << 62
            x = x if small else x.astype(object)
            for name, sign in (("cluster", 1), ("before", -1)):
                at = b.column(name).fill_null(-1).to_numpy(zero_copy_only=False)
                for c in np.unique(at[at >= 0]):
                    mine = at == c
                    count[c] += sign * int(mine.sum())
                    total[c] += sign * x[mine].sum(axis=0).astype(object)
        seen = np.flatnonzero(count.astype(bool) | (total != 0).any(axis=1))
        sums = pa.array([str(v) for c in seen for v in total[c]], pa.string())
        at = pa.array(np.tile(np.arange(width, dtype=np.int32), len(seen)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(seen, width).astype(np.int32)), at, pa.array(np.repeat(count[seen], width)), sums], ["c", "at", "n", "s"])

    return run


def _centroid_changes(old: list[list[int]], new: list[list[int]]) -> list[tuple[int, list[int], list[int]]]:
    out = []
    for c, (a, b) in enumerate(zip(old, new)):
        at = [i for i, (u, v) in enumerate(zip(a, b)) if u != v]
        if at:
            out.append((c, at, [b[i] - a[i] for i in at]))
    return out


def cluster_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10,
    dimension: int = 64, scale: int = 1024, salt: str = "3",
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every usable vector, and the final centroids in whole numbers."""
    spark = vectors.sparkSession
    state, path = stage_at(whole_vectors(vectors, vec_id, vector, dimension, scale))
    kind = state.schema["id"].dataType.simpleString()
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).alias("h")
    starts = state.select(order, "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    centroids = _rows(pa.array([r.x for r in starts], pa.binary()), dimension).tolist()
    if not centroids:
        return state.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    k = len(centroids)
    counts, sums = [0] * k, [[0] * dimension for _ in range(k)]
    changes = _centroid_changes([[0] * dimension for _ in range(k)], centroids)
    for last in range(rounds + 1):
        norms = [sum(v * v for v in c) for c in centroids]
        kept = state.select("id", "x", "norm", "dots", "cluster") if last else state.select("id", "x")
        after, into = stage_at(kept.mapInArrow(_advance(dimension, k, changes, norms), f"id {kind}, {_STATE}"))
        discard(spark, path)
        state, path = after, into
        if last == rounds:
            break
        movers = state.where("NOT (cluster <=> before)").select("x", "cluster", "before")
        moved = movers.mapInArrow(_moves(dimension, k), "c int, at int, n bigint, s string").groupBy("c", "at")
        # k x dimension rows, whatever the number of vectors
        for r in moved.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
            sums[r.c][r.at] += int(r.s)
            counts[r.c] += int(r.n) if r.at == 0 else 0
        new = [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, centroids)]
        changes = _centroid_changes(centroids, new)
        centroids = new
        if not changes:
            break
    return state.select("id", "cluster", "distance"), centroids


def clusters(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    found, centroids = cluster_vectors(vectors, vec_id, vector, **options)
    spark = vectors.sparkSession
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    own = {r.cluster: int(r.own) for r in found.groupBy("cluster").agg(total.alias("own")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centroids]
    per = spark.createDataFrame(
        [(c, n, sum(own.values()), digests[c]) for c, n in own.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return found.join(F.broadcast(per), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
