"""Digests of partitions folded level by level, so that one hash binds a table and a change is traced to its partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.recon import row_digest
from tidemark.session import stage

DEPTH = 4


def leaves(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(part, rows, digest) of every partition of ``df`` by the columns ``by``; staged, since all levels read it.

    ``part`` is ``column=value`` joined by ``/``, with ``\\N`` for null.  A digest covers all columns, the number of rows
    and the partition's name, in any order of rows; rows are summed before they are shuffled.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\\N"))
    part = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), value(c)) for c in by])
    sums = df.select(part.alias("part"), row_digest(sorted(df.columns)).alias("_n")).groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_n").cast("string").alias("_s")
    )
    return stage(sums.select("part", "rows", F.sha2(F.concat_ws(":", "part", F.col("rows").cast("string"), "_s"), 256).alias("digest")))


def _bucket(depth: int) -> Column:
    return F.substring(F.sha2("part", 256), 1, depth)


def fold(parts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, node, rows, digest): level ``depth`` has a node for each prefix of that many hex digits of a part's hash,
    level 0 is the root, one row even for an empty table.

    A node's digest covers the sorted names and digests of its children, of which there are at most 16, on the last
    level as many as parts share a prefix: choose a ``depth`` such that 16 ** depth is near the number of parts.
    """
    children = parts.select(_bucket(depth).alias("node"), F.col("part").alias("child"), "rows", "digest")
    text = F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", "child", "digest"))))
    folded = [F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sha2(text, 256).alias("digest")]
    levels = []
    for level in range(depth, -1, -1):
        nodes = children.groupBy("node").agg(*folded) if level else children.agg(*folded).withColumn("node", F.lit(""))
        levels.append(nodes.select(F.lit(level).alias("level"), "node", "rows", "digest"))
        children = nodes.select(F.substring("node", 1, level - 1).alias("node"), F.col("node").alias("child"), "rows", "digest") if level else None
    tree = levels[0]
    for nodes in levels[1:]:
        tree = tree.unionByName(nodes)
    return stage(tree)


def changed_parts(old: DataFrame, old_tree: DataFrame, new: DataFrame, new_tree: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(part, problem): the partitions in which two versions differ, ``changed``, ``missing`` from the new or ``extra`` in it.

    Only parts under nodes that differ are compared.
    """
    at = lambda tree, name: tree.where(F.col("level") == depth).select("node", F.col("digest").alias(name))
    differ = at(old_tree, "_a").join(at(new_tree, "_b"), "node", "outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")
    under = lambda parts, name: parts.select("part", F.col("digest").alias(name), _bucket(depth).alias("node")).join(differ, "node", "left_semi").drop("node")
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("changed")
    both = under(old, "_a").join(under(new, "_b"), "part", "outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select("part", problem.alias("problem"))
