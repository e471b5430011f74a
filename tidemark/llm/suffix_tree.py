"""Language-model scores from a probabilistic suffix tree.

A text is a sequence of words (runs without ASCII white space, A-Z folded) and one end.  The tree reads it
as bytes: a blank behind every word, then a newline for the end, so tokens are spelled one after the other.

Contexts are up to ``DEPTH`` preceding bytes.  All training texts are counted, every (DEPTH + 1)-byte window:
per task first, then in one shuffle together with the word counts.  A context stays in the tree if it occurs
``LEAST_COUNT`` times or more, a fixed number, and its next-byte distribution diverges from its suffix's (the one
byte shorter context's) by more than a BIC penalty, n KL >= k ln(n) / 2; suffixes of contexts that stay, stay.
So the tree grows with the corpus; it is a table that Spark grows by joins of windows with their suffixes.
Distributions are smoothed towards the suffix's (Witten-Bell), and the root's is add-one over 256 bytes.
A byte is scored in the longest suffix state of what precedes it.

Tasks hold the crown of the tree: the contexts above a count (a power of two) so chosen that they and the fringe,
the first contexts below them, have at most ``HELD_STATES`` rows, counted before they are fetched.  A byte whose context
is below the fringe leaves its window; the different windows of all texts meet the whole tree by joins.

The base score is that of add-one unigrams, in which all unseen tokens are one symbol.  A spelling model alone
has to share that symbol's probability among all spellings, so a token's probability is a mixture: ``TREE_SHARE``
of what the tree spells it with, and the rest of its unigram.  The score is the sum of the tokens' logarithms.

Counts of tokens that make up at least ``frequent_share`` of all (at most 1 / frequent_share of them) are
looked up in the task; the others are joined by a 64-bit hash.  So no hot word is ever a join key.

Defined results: a null or empty text has one token, the end; without training texts every count is zero
and the tree alone (uniform bytes) scores; a null id trains; repeated rows count and are scored each.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_strings
from tidemark.session import discard, stage, stage_at

DEPTH = 6  # windows of DEPTH + 1 bytes are whole numbers of a long, so 6 is the most
LEAST_COUNT = 8
HELD_STATES = 4_000_000  # at most 16 bytes a row in every task
FREQUENT_SHARE = 1e-6
TREE_SHARE = 0.7
END = b"\n"
SLICE_BYTES = 2 << 20
HELD_ENTRIES = 2_500_000  # different windows a counting task holds, 16 bytes each, and as much again while a slice is added
LOOKED_UP = 1 << 17
WORD, GRAM = 0, 1
BYTE = np.uint64(8)
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # odd, so windows keep their differences


word_hash = xxhash.xxh64_intdigest


def held_out(doc_id: F.Column) -> F.Column:
    """The fold that is not learnt from: remainder 2 of crc32(doc_id as text) by 7."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def windows(sequences: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the sequences, the last depth + 1 bytes up to it as a number; and the sequences' offsets.

    Before a sequence stand ends.
    """
    # a number of eight bytes begins at every byte, and its last depth + 1 bytes are a window
    pad = END * 7
    data = b"".join([part for s in sequences for part in (pad, s)])
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sequences], dtype=np.int64)))
    packed = np.ndarray(max(len(data) - 7, 0), ">u8", data, strides=(1,))
    own = [packed[a + 7 * k : b + 7 * k] for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))]
    found = np.concatenate(own, dtype=np.uint64) if own else np.zeros(0, np.uint64)
    found &= np.uint64((1 << 8 * (depth + 1)) - 1)
    return found, offsets


def different(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different windows; an order of all windows; which of the different ones each window in that order is).

    Hash bits with the place below them are one number, and numbers sort several times faster than places by a key.
    Windows whose hash bits agree may stand mixed, so that one is listed more than once; none is taken for another.
    """
    places = np.uint64((1 << max(len(grams) - 1, 1).bit_length()) - 1)
    keyed = grams * SPREAD
    keyed &= ~places
    keyed |= np.arange(len(grams), dtype=np.uint64)
    keyed.sort()
    keyed &= places
    order = keyed.view(np.int64)
    grouped = grams[order]
    first = np.append(True, grouped[1:] != grouped[:-1])[: len(grouped)]
    which = np.cumsum(first, dtype=np.int32)
    which -= 1
    return grouped[first], order, which


def turned(contexts: np.ndarray) -> np.ndarray:
    """Contexts with their last byte first, at the top of the number: those of one suffix stand together, at every length."""
    return contexts.astype(np.uint64, copy=False).byteswap()


def turned_windows(windows_: np.ndarray) -> np.ndarray:
    """The turned contexts of windows, with the byte after them as the lowest byte."""
    found = windows_.astype(np.uint64, copy=False)
    return turned(found >> BYTE) | found & np.uint64(255)


def spelled(words: list[bytes]) -> bytes:
    """A blank behind every word, then the end."""
    return b" ".join((*words, END))


def runs(texts, limit: int = SLICE_BYTES):
    """Lists of word lists, each of about ``limit`` bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text.lower().split())
        size += len(text) + 1
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and how often each occurs; sorts ``keys`` itself."""
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.diff(first, append=len(keys))


def _added(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of sorted keys with those of more sorted keys added; rows that are there already are not sorted again."""
    at, known = _find(keys, more)
    counts[at[known]] += n[known]
    new = ~known
    return np.insert(keys, at[new], more[new]), np.insert(counts, at[new], n[new])


def _counting(depth: int):
    def rows(kind: int, keys: np.ndarray, counts: np.ndarray):
        for a in range(0, len(keys), 200_000):
            part = slice(a, a + 200_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys[part]), kind, np.int8)), pa.array(keys[part].view(np.int64)), pa.array(counts[part].astype(np.int64))],
                ["kind", "key", "n"],
            )

    def words_out(words: Counter):
        hashes = np.array([word_hash(w) for w in words], np.uint64)
        yield from rows(WORD, hashes, np.fromiter(words.values(), np.int64, len(words)))

    def run(batches):
        words: Counter = Counter()
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in runs(byte_strings(batch.column("text"))):
                for w in part:
                    words.update(w)
                words[END] += len(part)
                keys, counts = _added(keys, counts, *_counted(windows([spelled(w) for w in part], depth)[0]))
                if len(keys) > HELD_ENTRIES:
                    yield from rows(GRAM, keys, counts)
                    keys, counts = keys[:0].copy(), counts[:0].copy()
                if len(words) > HELD_ENTRIES // 4:
                    yield from words_out(words)
                    words.clear()
        if words:
            yield from words_out(words)
        yield from rows(GRAM, keys, counts)

    return run


def corpus_counts(train: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n): counts of word hashes and of byte windows over the training rows' ``text``."""
    partial = train.select("text").mapInArrow(_counting(depth), "kind byte, key long, n long")
    # tasks have counted already, in order of the keys: rows move as they are and are added up where they arrive
    return stage(partial.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n")))


@dataclass
class Crown:
    """What a task holds of a tree, by context length, all turned and sorted.

    Contexts with the log10 weight of their suffix, (context, byte) with log10 probability, and the fringe:
    contexts of the tree that are not held although their suffix is.
    """

    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    entries: list[np.ndarray]
    logs: list[np.ndarray]
    fringe: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.entries) - 1

    def window_logs(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of the last byte of each window after the bytes before it; whether that is below the fringe (0 then).

        Windows are looked up in the order of the tables, ``LOOKED_UP`` at a time.
        """
        grams = turned_windows(grams)
        order = np.argsort(grams)
        logs, below = np.empty(len(grams)), np.empty(len(grams), bool)
        for a in range(0, len(grams), LOOKED_UP):
            part = order[a : a + LOOKED_UP]
            logs[part], below[part] = self._sorted_logs(grams[part])
        return logs, below

    def _sorted_logs(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``window_logs`` of sorted turned windows; those that share a context are looked up in the fringe once."""
        next_byte = grams & np.uint64(255)
        out, context = np.zeros(len(grams)), grams ^ next_byte
        upto = [np.uint64((1 << 64) - (1 << 64 - 8 * d)) for d in range(self.depth + 1)]
        first = np.append(True, context[1:] != context[:-1])[: len(context)]
        own = context[first]
        under = np.zeros(len(own), bool)
        for d in range(1, self.depth + 1):
            if len(self.fringe[d]):
                left = np.flatnonzero(~under)
                under[left] = _find(self.fringe[d], own[left] & upto[d])[1]
        below = under[np.cumsum(first) - 1]
        open_ = np.flatnonzero(~below)
        for d in range(self.depth, -1, -1):
            at, hit = _find(self.entries[d], context[open_] & upto[d] | next_byte[open_])
            out[open_[hit]] += self.logs[d][at[hit]]
            open_ = open_[~hit]
            at, kept = _find(self.contexts[d], context[open_] & upto[d])
            out[open_[kept]] += self.backoff[d][at[kept]]
        return out, below


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, key)
    return at, (table[np.minimum(at, len(table) - 1)] == key) if len(table) else np.zeros(len(key), bool)


@dataclass
class SuffixTree:
    """The whole tree as two tables.

    ``entries`` (d, key, total, log): a context of d bytes and the byte after it as one number, the context's count,
    the byte's log10 probability.  ``states`` (d, context, total, above, backoff): a context, its count, that of its
    suffix, and the log10 weight with which bytes not seen after it fall to the suffix.
    """

    depth: int
    entries: DataFrame
    states: DataFrame

    def crown(self, held_states: int = HELD_STATES) -> Crown:
        """The contexts of the highest counts, with their fringe at most ``held_states`` rows (and the root)."""

        def size(count: str) -> F.Column:
            return F.length(F.bin(count))

        # a row is held at a power of two if its count reaches it, a state also (as fringe) if its suffix's does
        entries = self.entries.where("d > 0").select(size("total").alias("most"), F.lit(0).alias("above"))
        states = self.states.select(size("total").alias("most"), F.when(F.col("d") == 1, 64).otherwise(size("above")).alias("above"))
        rows = entries.union(states).groupBy("most", "above").count().collect()
        held = (b for b in range(1, 64) if sum(r["count"] for r in rows if r.most >= b or r.above >= b) <= held_states)
        least = F.lit(1 << next(held, 63) - 1)
        own = self.entries.where((F.col("d") == 0) | (F.col("total") >= least)).select("d", "key", "log").toArrow()
        states = self.states.where((F.col("d") == 1) | (F.col("above") >= least)).select("d", "context", "backoff", (F.col("total") >= least).alias("held")).toArrow()

        def by_length(d, held, key, *more) -> list:
            found = []
            for k in range(self.depth + 1):
                mine = np.flatnonzero((d == k) & held)
                mine = mine[np.argsort(key[mine])]
                found.append([key[mine], *(m[mine] for m in more)])
            return [list(column) for column in zip(*found, strict=True)]

        e = [own[c].to_numpy() for c in ("d", "key", "log")]
        s = [states[c].to_numpy() for c in ("d", "context", "backoff", "held")]
        above = s[3].astype(bool)
        own_contexts = turned(s[1])
        contexts, backoff = by_length(s[0], above, own_contexts, s[2])
        (fringe,) = by_length(s[0], ~above, own_contexts)
        return Crown(contexts, backoff, *by_length(e[0], np.ones(len(e[0]), bool), turned_windows(e[1]), e[2]), fringe)

    def window_logs(self, windows_: DataFrame) -> DataFrame:
        """(window, log): of different windows the log10 probability of their last byte, by joins with the whole tree.

        From the longest context down: weights of the tree's contexts after which the byte was not seen, then its probability.
        """
        keyed = (
            windows_.select("window", F.explode(F.sequence(F.lit(0), F.lit(self.depth))).alias("d"))
            .withColumn("key", F.expr("window & (shiftleft(1L, 8 * (d + 1)) - 1L)")).withColumn("context", F.shiftright("key", 8))
        )
        met = keyed.join(self.states.select("d", "context", "backoff"), ["d", "context"], "left").join(self.entries.select("d", "key", "log"), ["d", "key"], "left")
        steps = F.sort_array(F.collect_list(F.struct(F.negative("d").alias("order"), "log", "backoff")))

        def descend(at, step):
            more = F.coalesce(step["log"], step["backoff"], F.lit(0.0))
            return F.when(at["found"], at).otherwise(F.struct((at["log"] + more).alias("log"), step["log"].isNotNull().alias("found")))

        start = F.struct(F.lit(0.0).alias("log"), F.lit(False).alias("found"))
        return met.groupBy("window").agg(steps.alias("steps")).select("window", F.aggregate("steps", start, descend)["log"].alias("log"))


SUFFIX = "key & (shiftleft(1L, 8 * d) - 1L)"


def _all_windows(counts: DataFrame, depth: int, least_count: int) -> DataFrame:
    """(d, key, context, n, total, kinds): the windows of every context length with the count and next bytes of their context.

    Contexts of fewer occurrences than ``least_count`` are left out (but the root): none is in the tree, and so none is a suffix of one that is.
    """
    spark = counts.sparkSession
    level, paths, levels = counts.where(F.col("kind") == GRAM).select("key", "n"), [], []
    for d in range(depth, -1, -1):
        if d < depth:
            level, path = stage_at(level.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n")))
            paths.append(path)
        levels.append(level.withColumn("d", F.lit(d)))
    # at most 256 rows share a context
    of_context = Window.partitionBy("d", "context")
    every = reduce(DataFrame.unionByName, levels).withColumn("context", F.shiftright("key", 8))
    whole = every.withColumn("total", F.sum("n").over(of_context)).withColumn("kinds", F.count("*").over(of_context))
    found = stage(whole.where((F.col("d") == 0) | (F.col("total") >= least_count)))
    for path in paths:
        discard(spark, path)
    return found


def learn_tree(counts: DataFrame, depth: int = DEPTH, least_count: int = LEAST_COUNT) -> SuffixTree:
    """The contexts that occur ``least_count`` times, diverge from their suffix, or are suffixes of such; smoothed.

    Every step joins windows with the windows one byte shorter, of which at most 256 meet one.
    """
    if depth > 6:
        raise ValueError("windows of more than 7 bytes are not numbers of a long")
    spark = counts.sparkSession
    all_windows = _all_windows(counts, depth, least_count)
    shorter = all_windows.select((F.col("d") + 1).alias("d"), F.col("key").alias("suffix"), F.col("n").alias("n_above"), F.col("total").alias("above"))
    divergence = F.sum(F.expr("n * ln((n / total) / (n_above / above))")).alias("gain")
    tested = (
        all_windows.where((F.col("d") > 0) & (F.col("total") >= least_count)).withColumn("suffix", F.expr(SUFFIX)).join(shorter, ["d", "suffix"])
        .groupBy("d", "context").agg(divergence, F.max("kinds").alias("kinds"), F.max("total").alias("total"))
        .where("gain >= 0.5 * kinds * ln(greatest(total, 2))")
    )
    kept = tested.select("context", F.explode(F.sequence(F.lit(1), "d")).alias("d")).select("d", F.expr("context & (shiftleft(1L, 8 * d) - 1L)").alias("context")).distinct()
    mine = stage(all_windows.join(kept, ["d", "context"], "left_semi"))
    root = all_windows.where("d = 0").select("key", "n")
    positions = F.lit(root.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    level = spark.range(256).withColumnRenamed("id", "key").join(root, "key", "left").select(
        F.lit(0).alias("d"), "key", F.lit(0).cast("long").alias("context"), positions.alias("total"), F.lit(0).cast("long").alias("kinds"),
        F.lit(0).cast("long").alias("above"), ((F.coalesce("n", F.lit(0)) + 1) / (positions + 256)).alias("p"),
    )
    levels = [stage(level)]
    for d in range(1, depth + 1):
        below = levels[-1].select(F.col("key").alias("suffix"), F.col("p").alias("p_above"), F.col("total").alias("above"))
        smoothed = F.expr("(n + kinds * p_above) / (total + kinds)")
        longer = mine.where(F.col("d") == d).withColumn("suffix", F.expr(SUFFIX)).join(below, "suffix")
        levels.append(stage(longer.select("d", "key", "context", "total", "kinds", "above", smoothed.alias("p"))))
    entries = reduce(DataFrame.unionByName, levels)
    states = entries.where("d > 0").groupBy("d", "context").agg(F.max("total").alias("total"), F.max("kinds").alias("kinds"), F.max("above").alias("above"))
    weighed = states.select("d", "context", "total", "above", F.expr("log10(kinds / (total + kinds))").alias("backoff"))
    return SuffixTree(depth, entries.select("d", "key", "total", F.log10("p").alias("log")), stage(weighed))


@dataclass
class Unigrams:
    """Training totals and the frequent words (sorted hashes)."""

    tokens: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray


def learn_unigrams(counts: DataFrame, frequent_share: float = FREQUENT_SHARE) -> Unigrams:
    words = counts.where(F.col("kind") == WORD)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = words.where(F.col("n") >= max(1, math.ceil(tokens * frequent_share))).select("key", "n").toArrow()
    hashes = frequent["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Unigrams(tokens, distinct, hashes[order], frequent["n"].to_numpy().astype(np.int64)[order])


SCORED = (
    "row_id struct<doc_id:{kind}, held_out:boolean>, n_tokens long, n_known long, base double, score double, "
    "open array<struct<key:long, count:long, spelling:double, windows:array<long>>>"
)


def token_logs(spelling: np.ndarray, counts: np.ndarray, norm: int) -> np.ndarray:
    """log10 of the mixture for tokens with training counts and log10 spelling probabilities."""
    return np.log10((1 - TREE_SHARE) * (counts + 1.0) / norm + TREE_SHARE * 10.0**spelling)


def spellings(model: Crown, part: list[list[bytes]], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens that begin at ``first``: what their bytes sum to and how many are below the fringe; all windows below it.

    Arrays of a number a byte live no longer than this call, the windows themselves no longer than it takes to group them.
    """
    once, order, which = different(windows([spelled(w) for w in part], model.depth)[0])
    logs_once, below_once = model.window_logs(once)

    def of_bytes(values: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), values.dtype)
        out[order] = values[which]
        return out

    below, spelling = of_bytes(below_once), np.add.reduceat(of_bytes(logs_once), first)
    return spelling, np.add.reduceat(below, first, dtype=np.int64), of_bytes(once)[below] if below.any() else once[:0]


def _scoring(crown, unigrams):
    """Per text: tokens, and the sums of those that are settled; the others with what is known of them.

    A token is open if its word is not a frequent one (``key`` is its hash then, else ``count`` its count) or if some of
    its bytes are below the fringe (``windows``; ``spelling`` sums the others).
    """

    def run(batches):
        model, common = crown.value, unigrams.value
        norm = common.tokens + common.distinct + 1
        for batch in batches:
            at = 0
            for part in runs(byte_strings(batch.column("text"))):
                n = len(part)
                tokens = [t for w in part for t in (*w, END)]
                number: defaultdict = defaultdict(count().__next__)
                of_word = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
                # a word takes its blank along, the end is one byte
                width = np.fromiter(map(len, number), np.int64, len(number)) + 1
                width[number[END]] = 1
                first = np.append(0, np.cumsum(width[of_word])[:-1])
                spelling, n_below, windows_below = spellings(model, part, first)
                starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in part])))
                word_hashes = np.fromiter(map(word_hash, number), np.uint64, len(number))
                place, found = _find(common.hashes, word_hashes)
                word_counts, word_base = np.zeros(len(number), np.int64), np.zeros(len(number))
                word_counts[found] = common.counts[place[found]]
                word_base[found] = np.log10((word_counts[found] + 1.0) / norm)
                hashes, known, counts, base = word_hashes[of_word], found[of_word], word_counts[of_word], word_base[of_word]
                score = np.zeros(len(tokens))
                settled = known & (n_below == 0)
                score[settled] = token_logs(spelling[settled], counts[settled], norm)
                left = ~settled
                upto = np.concatenate(([0], np.cumsum(left)))[starts].astype(np.int32)
                of_token = np.concatenate(([0], np.cumsum(n_below[left]))).astype(np.int32)
                open_tokens = pa.StructArray.from_arrays([
                    pa.array(hashes[left].view(np.int64), mask=known[left]), pa.array(counts[left], mask=~known[left]), pa.array(spelling[left]),
                    pa.ListArray.from_arrays(pa.array(of_token), pa.array(windows_below.view(np.int64))),
                ], ["key", "count", "spelling", "windows"])
                yield pa.RecordBatch.from_arrays([
                    batch.column("row_id").slice(at, n), pa.array(np.diff(starts)), pa.array(np.add.reduceat(known.astype(np.int64), starts[:-1])),
                    pa.array(np.add.reduceat(base, starts[:-1])), pa.array(np.add.reduceat(score, starts[:-1])),
                    pa.ListArray.from_arrays(pa.array(upto), open_tokens),
                ], ["row_id", "n_tokens", "n_known", "base", "score", "open"])
                at += n

    return run


def score_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, least_count: int = LEAST_COUNT, held_states: int = HELD_STATES,
    frequent_share: float = FREQUENT_SHARE,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, scores in log10."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counts = corpus_counts(rows.where(~held_out(F.col("doc_id"))), depth)
    tree, unigrams = learn_tree(counts, depth, least_count), learn_unigrams(counts, frequent_share)
    norm = F.lit(float(unigrams.tokens + unigrams.distinct + 1))
    keyed = rows.select(F.struct("doc_id", held_out(F.col("doc_id")).alias("held_out")).alias("row_id"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = keyed.mapInArrow(_scoring(context.broadcast(tree.crown(held_states)), context.broadcast(unigrams)), SCORED.format(kind=kind))
    scored = stage(scored.withColumn("place", F.monotonically_increasing_id()))
    tokens = scored.select("place", F.posexplode("open").alias("no", "w")).select("place", "no", "w.*")
    below = tokens.select("place", "no", F.explode("windows").alias("window"))
    logs = tree.window_logs(below.select("window").distinct())
    spelt = below.join(logs, "window").groupBy("place", "no").agg(F.sum("log").alias("log"))
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    unigram = (F.coalesce("count", "n", F.lit(0)) + 1.0) / norm
    mixture = (1 - TREE_SHARE) * unigram + TREE_SHARE * F.pow(F.lit(10.0), F.col("spelling") + F.coalesce("log", F.lit(0.0)))
    rare = F.col("key").isNotNull()
    spelt_tokens = tokens.where(F.size("windows") > 0).drop("windows").join(spelt, ["place", "no"])
    whole_tokens = tokens.where(F.size("windows") == 0).drop("windows").withColumn("log", F.lit(0.0))
    more = (
        spelt_tokens.unionByName(whole_tokens).join(words, "key", "left").groupBy("place")
        .agg(F.count("n").alias("known"), F.sum(F.when(rare, F.log10(unigram))).alias("bases"), F.sum(F.log10(mixture)).alias("scores"))
    )

    def total(own: str, others: str) -> F.Column:
        return F.col(own) + F.coalesce(others, F.lit(0))

    whole = scored.drop("open").join(more, "place", "left")
    return whole.select(
        "row_id.doc_id", "row_id.held_out", "n_tokens", total("n_known", "known").cast("long").alias("n_known"),
        F.lit(unigrams.tokens).cast("long").alias("train_tokens"), total("base", "bases").alias("base_score"), total("score", "scores").alias("score"),
    )
