"""Exact duplicates by a 128-bit hash of the whole text, in DataFrame operators only.

1. Rows are grouped by (digest, text): grouping compares bytes, so texts that collide in the digest are groups
   of their own.  Copies meet already inside the tasks that read them, so a text in a third of all rows reaches
   the shuffle once a task.  What is kept of a group is narrow: digest, the id that stays, its size.
2. Rows take their group by digest alone, without their texts.  A digest with several texts would be a
   collision; only then are the texts of such rows read once more and joined by (digest, text).
3. A group of more than 1 / ``HOT_SHARE`` of all rows is hot; at most ``HOT_SHARE`` groups can be.  Their few
   narrow rows are broadcast, so no task receives the rows of a hot group; the others meet by a shuffle.

Defined results: a null text is the empty text; the smallest or largest id of a group stays, a null id only
where there is no other; of several rows with the id that stays one is kept; every row is returned once; an
empty table gives an empty table.  Other columns of the input take no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

HOT_SHARE = 10_000


def leading_128_bits(text_sha256: F.Column, text: F.Column) -> F.Column:
    """The first 128 bits of the SHA-256, which the result carries anyway."""
    return F.unhex(F.substring(text_sha256, 1, 32))


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest",
    digest: Callable[[F.Column, F.Column], F.Column] = leading_128_bits, hot_share: int = HOT_SHARE,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    rows = rows.withColumn("digest", digest(F.col("text_sha256"), F.col("text")))
    groups = stage(rows.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size")).drop("text"))
    # Rows of equal id and text are counted, not carried: one of them may stay.
    narrow = rows.groupBy("doc_id", "digest", "text_sha256").agg(F.count("*").alias("repeats"))

    collided = groups.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") * hot_share > total
    found = None
    if not collided.isEmpty():
        groups = groups.join(collided, "digest", "left_anti")
        apart = rows.join(collided, "digest", "left_semi")
        exact = apart.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        repeats = apart.groupBy("doc_id", "digest", "text_sha256", "text").agg(F.count("*").alias("repeats"))
        found = repeats.join(exact, ["digest", "text"]).drop("text", "digest")
        narrow = narrow.join(collided, "digest", "left_anti")
    large = groups.where(hot).withColumnsRenamed({"keep_id": "hot_id", "group_size": "hot_size"})
    marked = narrow.join(F.broadcast(large), "digest", "left")  # at most hot_share rows
    plain = marked.where("hot_size IS NULL").drop("hot_id", "hot_size").join(groups.where(~hot), "digest").drop("digest")
    many = marked.where("hot_size IS NOT NULL").withColumnsRenamed({"hot_id": "keep_id", "hot_size": "group_size"}).drop("digest")
    found = plain.unionByName(many) if found is None else found.unionByName(plain).unionByName(many)
    return found.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256"
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they had."""
    stays = exact_groups(docs, doc_id, text, keep).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.col("__text_sha") == F.col("__sha"))
    return docs.withColumn("__text_sha", sha).join(stays, same, "left_semi").dropDuplicates([doc_id, "__text_sha"]).drop("__text_sha")
