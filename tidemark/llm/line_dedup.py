"""Removal of passages that repeat: overlapping windows of three lines, in DataFrame operations only.

Every run of three consecutive lines is hashed (128 bits of two differently seeded XXH64 chains).  Of a
window that occurs more than once in the corpus the first occurrence, by (doc_id, text digest, line), stays
and the lines of all later ones are removed; overlapping occurrences merge into ranges first, so every
document is cut once.  First occurrences come from a partial aggregate, later ones from a join whose other
side is unique, so a window in a third of all rows is split like any other.

Defined results: texts of fewer than three lines have no window and stay as they are; windows of blank
lines only are no passage; null texts stay null; rows equal in id and text share their fate (neither is the
other's later copy); a null id sorts first; an empty table gives an empty table.  Lines end at ``\\n`` alone; on request sentences are units as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

LINES = 3
#: Behind a line end and behind the blanks that follow the end of a sentence; ideographic full stops need no blank.
SENTENCE_ENDS = r"(?<=\n)|(?<=[ \t])(?=\S)(?<=[.!?][\"'”’)\]]{0,2}[ \t]{1,8})|(?<=[。！？])(?=\S)"


def _lines(text: str) -> F.Column:
    return F.split(F.col(text), "\n", -1)


def _sentences(text: str) -> F.Column:
    """Lines and the sentences in them, each with the separator behind it, so that joined they are the text."""
    return F.split(F.col(text), SENTENCE_ENDS, -1)


def _wording(unit: F.Column) -> F.Column:
    """A sentence without the separator behind it: copies may end in another one."""
    return F.rtrim(unit, F.lit(" \t\r\n"))


def line_windows(docs: DataFrame, sentences: bool = False) -> DataFrame:
    """(doc_id, digest, at, h1, h2) of every window of ``(doc_id, text)``; ``at`` is its first line, from 0."""
    units = F.transform(_sentences("text"), _wording) if sentences else _lines("text")
    lines = docs.select("doc_id", F.xxhash64("text").alias("digest"), units.alias("lines")).where(F.size("lines") >= LINES)

    def hashed(at: F.Column) -> F.Column:
        three = [F.get("lines", at + k) for k in range(LINES)]
        blank = F.trim(F.concat(*three)) == ""
        return F.when(~blank, F.struct(F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit("second"), *three).alias("h2")))

    windows = lines.select("doc_id", "digest", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - LINES), hashed)).alias("at", "h"))
    return windows.where("h IS NOT NULL").select("doc_id", "digest", "at", "h.h1", "h.h2")


def repeated_ranges(windows: DataFrame) -> DataFrame:
    """(doc_id, digest, ranges): ascending line ranges [b, e) that later occurrences cover."""
    place = F.struct("doc_id", "digest", "at")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "digest", "at").distinct()
    order = "PARTITION BY doc_id, digest ORDER BY at"
    islands = (
        later.withColumn("new", F.expr(f"CASE WHEN at <= lag(at) OVER ({order}) + {LINES} THEN 0 ELSE 1 END"))
        .withColumn("island", F.expr(f"sum(new) OVER ({order})"))
        .groupBy("doc_id", "digest", "island").agg(F.min("at").alias("b"), (F.max("at") + LINES).alias("e"))
    )
    return islands.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("b", "e"))).alias("ranges"))


def _joined(pieces: F.Column) -> F.Column:
    """Kept sentences end to end; where the last one went, the separator before it goes too."""
    whole = F.array_join(pieces, "")
    return F.when(F.expr("element_at(__ranges, -1).e = size(__lines)"), F.regexp_replace(whole, r"(\n|[ \t]+)$", "")).otherwise(whole)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: bool = False) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text``, plus ``n_lines`` and ``n_removed``.

    With ``sentences`` the sentences of lines are units too: a passage may then begin and end inside a line.
    """
    windows = stage(line_windows(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), sentences))
    ranges = repeated_ranges(windows).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("ranges").alias("__ranges"))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__digest"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    found = docs.select(*kept).join(ranges, same, "left").withColumn("__lines", _sentences(f"`{text}`") if sentences else _lines(f"`{text}`"))
    pieces = F.expr(
        "flatten(transform(sequence(0, size(__ranges)), k -> slice(__lines, "
        "coalesce(get(__ranges, k - 1).e, 0) + 1, coalesce(get(__ranges, k).b, size(__lines)) - coalesce(get(__ranges, k - 1).e, 0))))"
    )
    removed = F.expr("coalesce(aggregate(__ranges, 0L, (n, r) -> n + r.e - r.b), 0L)")
    cut = F.when(F.col("__ranges").isNull(), F.col(f"`{text}`")).otherwise(_joined(pieces) if sentences else F.array_join(pieces, "\n"))
    columns = [cut.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return found.select(*columns, F.size("__lines").cast("long").alias("n_lines"), removed.alias("n_removed"))
