"""Regularised quadratic discriminant for document quality.

A text becomes a vector of transformed statistics (logarithms of rates: case, digits, punctuation, symbols,
lengths, lines, how far it compresses).  Each class keeps its mean and a covariance shrunk twice, towards the
pooled one and towards a multiple of the identity, so few rows of a class still give a proper density.  The
score is the logistic of the prior and the two Mahalanobis log-densities, each computed with the inverse of a
Cholesky factor that is kept with the model.

Training reads the moments (count, sum, sum of products) of every labelled row outside the held-out fold:
partial sums in the executors, one row of 2 x (1 + p + p^2) numbers to the driver, whatever the input.

Defined results: null and empty texts have the statistics of an empty text and so a score; scores depend on
the text only; a label row with a null label or id is no label; repeated equal labels count once, and an id
with contradicting labels is not learnt from; without labels of both classes every score is the prior (0.5
without any label); an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, utf8
from tidemark.session import stage

UPPER, LOWER, DIGIT, BLANK, NEWLINE, WIDE, STOP, CALL, BAR, SYMBOL = range(10)
STATISTICS = (
    "length", "word_length", "upper", "digit", "wide", "stop", "call", "bar", "symbol", "lines", "short_word", "echo", "compressed",
)
SLICE_BYTES = 4 << 20
#: Scores from here on are taken as good.
KEEP_FROM = 0.3


def _classes() -> np.ndarray:
    kind = np.full(256, SYMBOL, np.uint8)
    for codes, k in (
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"0123456789", DIGIT),
        (b" \t\r\x0b\x0c", BLANK), (b"\n", NEWLINE), (b".,;:'\"()-", STOP), (b"!?", CALL), (b"|", BAR),
    ):
        kind[list(codes)] = k
    kind[128:] = WIDE
    return kind


CLASSES = _classes()
#: Values of bytes that add up to a word's signature; white space adds nothing.
WEIGHTS = np.where((CLASSES == BLANK) | (CLASSES == NEWLINE), 0, np.random.default_rng(1).integers(1, 1 << 40, 256))


def _counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    kind = CLASSES[data]

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), offsets)).astype(float)

    space = (kind == BLANK) | (kind == NEWLINE)
    upper = kind == UPPER
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)  # capitals of Latin-1 in UTF-8
    begins = ~space
    begins[1:] &= space[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = ~space[first]
    # a word of at most two bytes: a space or another text follows one of the two places behind its first byte
    at = np.flatnonzero(begins)
    gap = np.concatenate((space, [True, True]))
    gap[first] = True
    found = {name: per_text(kind == k) for name, k in (("digit", DIGIT), ("wide", WIDE), ("stop", STOP), ("call", CALL), ("bar", BAR), ("symbol", SYMBOL), ("newline", NEWLINE))}
    found["upper"], found["space"] = per_text(upper), per_text(space)
    found["words"] = np.diff(np.searchsorted(at, offsets)).astype(float)
    found["short"] = np.diff(np.searchsorted(at[gap[at + 1] | gap[at + 2]], offsets)).astype(float)
    # words whose bytes add up to what the word before in the same text adds up to
    signature = np.add.reduceat(WEIGHTS[data], at) if len(at) else at
    owner = np.searchsorted(offsets, at, side="right")
    echo = (signature[1:] == signature[:-1]) & (owner[1:] == owner[:-1])
    found["echo"] = np.diff(np.searchsorted(at[1:][echo], offsets)).astype(float)
    return found


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    data, offsets = utf8(texts)
    out = np.zeros((len(texts), len(STATISTICS)))
    for a, b in slices(offsets, SLICE_BYTES):
        at = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        c, n = _counts(part, at), np.diff(at).astype(float)
        view = memoryview(np.ascontiguousarray(part))
        packed = np.array([len(zlib.compress(view[i:j], 1)) for i, j in zip(at[:-1].tolist(), at[1:].tolist())], float)
        words, letters = c["words"] + 1, n - c["space"] + 1

        def rate(x: np.ndarray, of: np.ndarray) -> np.ndarray:
            return np.log((x + 0.3) / of)

        out[a:b] = np.stack((
            np.log(n + 1), np.log(letters / words), rate(c["upper"], letters), rate(c["digit"], letters), rate(c["wide"], letters),
            rate(c["stop"], words), rate(c["call"], words), rate(c["bar"], words), rate(c["symbol"], words),
            rate(c["newline"], words), rate(c["short"], words), rate(c["echo"], words), np.log((packed + 8) / (n + 8)),
        ), axis=1)
    return out


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of both classes, and the prior log-odds."""

    means: np.ndarray
    factors: np.ndarray
    log_determinants: np.ndarray
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_determinants)]
        return 1 / (1 + np.exp(-np.clip(self.log_odds + density[1] - density[0], -700, 700)))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.2, ridge: float = 0.01) -> Discriminant:
    """Fits from (count, sums, products) by class; ``pooled`` and ``ridge`` are the two shrinkages."""
    p = len(STATISTICS)
    counts = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
    if not all(counts.values()):
        odds = np.log((counts[1] + 1) / (counts[0] + 1))
        return Discriminant(np.zeros((2, p)), np.zeros((2, p, p)), np.zeros(2), float(odds))
    means = {k: moments[k][1] / counts[k] for k in (0, 1)}
    scatter = {k: moments[k][2] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)}
    total = sum(counts.values())
    common = sum(scatter[k] * counts[k] / total for k in (0, 1))
    factors, determinants = [], []
    for k in (0, 1):
        cov = (1 - pooled) * scatter[k] + pooled * common
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / p, 1e-6) * np.eye(p)
        root = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(root))
        determinants.append(2 * np.log(np.diag(root)).sum())
    return Discriminant(np.stack([means[0], means[1]]), np.stack(factors), np.array(determinants), float(np.log(counts[1] / counts[0])))


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``stats``: the vector of transformed statistics."""

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        rows = statistics(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.reshape(-1)))

    return docs.withColumn("stats", of.asNondeterministic()(F.col(f"`{text}`")))


def held_out(doc_id: F.Column) -> F.Column:
    """The fold kept for testing: remainder 0 of crc32(doc_id as text) by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", pooled: float = 0.2, ridge: float = 0.01) -> Discriminant:
    """Learns from ``stats`` (doc_id, stats) joined with ``labels`` outside the held-out fold."""
    clean = (
        labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    )
    p = len(STATISTICS)

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            y = batch.column("label").to_numpy()
            x = batch.column("stats").flatten().to_numpy().reshape(len(y), p)
            for k in np.unique(y).tolist():
                mine = x[y == k]
                sums[k] = sums.get(k, 0) + np.concatenate(([len(mine)], mine.sum(axis=0), (mine.T @ mine).ravel()))
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"label": pa.array([k] * len(v), pa.int32()), "place": pa.array(np.arange(len(v), dtype=np.int32)), "value": pa.array(v)})

    rows = stats.join(clean, "doc_id").select("label", "stats").mapInArrow(partial, "label int, place int, value double")
    moments: dict[int, np.ndarray] = {}
    # bounded: two classes of 1 + p + p * p numbers
    for label_, place, value in rows.groupBy("label", "place").agg(F.sum("value")).collect():
        moments.setdefault(label_, np.zeros(1 + p + p * p))[place] = value
    return discriminant({k: (v[0], v[1 : 1 + p], v[1 + p :].reshape(p, p)) for k, v in moments.items()}, pooled, ridge)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> tuple[DataFrame, Discriminant]:
    """The staged statistics (doc_id, stats) of all documents and the model learnt from the labelled ones."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    stats = stage(add_statistics(narrow).drop("text"))
    return stats, fit(stats, labels, **options)


def score_statistics(stats: DataFrame, model: Discriminant) -> DataFrame:
    """Adds ``score`` (0 to 1) to rows that have ``stats``."""

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        return pa.array(model.scores(vectors.flatten().to_numpy().reshape(len(vectors), len(STATISTICS))))

    return stats.withColumn("score", score.asNondeterministic()(F.col("stats")))


def score_texts(docs: DataFrame, model: Discriminant, text: str = "text", score: str = "score") -> DataFrame:
    """Adds the score of every whole text; nothing is shuffled."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(statistics(texts)))

    return docs.withColumn(score, of.asNondeterministic()(F.col(f"`{text}`")))
