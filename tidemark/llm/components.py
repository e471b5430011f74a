"""Connected components of an edge table by alternating large and small stars.

Every round keeps an edge table of linear size in the shared folder and deletes the one before; no neighbour list is ever
gathered, so a node of any degree is only a key of partial aggregates and of a join that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, stage_at


def _minimum(edges: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours; edges hold both directions."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    linked = both.join(_minimum(both), "u").where("v > u")
    return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    linked = down.join(_minimum(down), "u")
    pairs = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(linked.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return pairs.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of an edge and the smallest node of its component.

    Ends when a round leaves the edge table as it was; that takes about log(n) rounds.
    """
    now, path = stage_at(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    state = _state(now)
    while state[0]:
        large, between = stage_at(_large_star(now))
        now, after = stage_at(_small_star(large))
        discard(edges.sparkSession, between)
        discard(edges.sparkSession, path)
        path, before, state = after, state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
