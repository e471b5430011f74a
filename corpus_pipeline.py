"""The corpus pipeline: quality, repeated passages, near duplicates, benchmark items, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; ``run`` writes
every stage's rows as Parquet in the shared folder and reads them again for the next.  All stages but the
last return the columns of ``documents``; the last gives the packed token ids, decoded again and compared.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, line_dedup, quality, resemblance
from tidemark.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, learnt from this corpus, scores at 0.3 or more."""
    _, model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(quality.score_texts(docs, model, score="__score").where(F.col("__score") >= quality.KEEP_FROM))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines and sentences of passages that stand earlier in the corpus; texts of which nothing is left go."""
    cut = line_dedup.dedup_lines(docs, sentences=True)
    left = cut.where("n_lines IS NULL OR n_removed < n_lines")
    return _columns(left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles are 0.8 alike or more one document, that with the smallest id."""
    return _columns(resemblance.one_of_each(docs))


def without_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return _columns(decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256, exact): packed token ids of every text that is left, decoded again.

    ``exact``: the decoded bytes are those of the text (none for a null text).
    """
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    exact = F.col("decoded") == F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), exact.alias("exact"))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_passages),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark_items),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs


#: A discriminant, components of similar texts and byte-pair merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None
