"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised (lower case, runs of word characters joined by single spaces).  An item may
occur with up to ``errors`` edits, one for every ``chars_per_error`` of its characters.  It is cut into
errors + 1 pieces: an occurrence within the budget leaves one piece untouched, so exact piece hits (one
Aho-Corasick pass over each text) place every possible occurrence, and Myers' bit-parallel distance verifies
the stretch around each place.  An item that is shorter than ``least_chars`` must occur exactly.

Items are read in blocks of bounded size, each block one pass over all documents; what a block sends to the
executors is bounded by ``BLOCK_CHARS`` whatever the benchmark holds.

Defined results: null and empty texts and items match nothing; equal items are reported each by its own id;
equal documents each; an item found several times in a text is reported once, by the fewest edits and then
the earliest end; an empty table on either side gives an empty table; no row is dropped for its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 8_000_000
CHARS_PER_ERROR = 16
LEAST_CHARS = 32
SCHEMA = "item_id string, edits int, begin long, stop long"
WORDS = re.compile(r"\w+")


def normalise(text: str | None) -> str:
    return " ".join(WORDS.findall(text.lower())) if text else ""


def places(text: str) -> list[tuple[int, int]]:
    """Begin and end in the text of each word of its normal form (for spans of a hit)."""
    return [m.span() for m in WORDS.finditer(text)]


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in errors + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def symbol_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def best_end(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Fewest edits of the item against any stretch of ``text``, and where the first such stretch ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        vertical = eq | minus
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if score < best:
            best, end = score, at
    return best, end


def edit_begin(item: str, text: str, end: int, edits: int) -> int:
    """Where the stretch that ends at ``end`` begins: the same search from the back."""
    back = text[max(0, end - len(item) - edits) : end][::-1]
    return end - best_end_anchored(item[::-1], back, edits)


def best_end_anchored(item: str, text: str, edits: int) -> int:
    """Length of the shortest prefix of ``text`` within ``edits`` of ``item`` (there is one)."""
    row = list(range(len(item) + 1))
    for at in range(1, len(text) + 1):
        left, row_before = at, row
        row = [at]
        for k, c in enumerate(item, 1):
            left = min(row_before[k - 1] + (c != text[at - 1]), row_before[k] + 1, left + 1)
            row.append(left)
        if row[-1] <= edits:
            return at
    return len(text)


class Matcher:
    """A block of items ready to be looked for."""

    def __init__(self, items: Sequence[tuple[str, str]], chars_per_error: int = CHARS_PER_ERROR, least_chars: int = LEAST_CHARS):
        self.items: list[tuple[str, str, int, dict[str, int]]] = []
        self.words = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = normalise(text)
            if not item:
                continue
            errors = len(item) // chars_per_error if len(item) >= least_chars else 0
            number = len(self.items)
            self.items.append((item_id, item, errors, symbol_masks(item)))
            for offset, piece in pieces(item, errors):
                found.setdefault(piece, []).append((number, offset))
        for piece, where in found.items():
            self.words.add_word(piece, (len(piece), where))
        self.words.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each item the merged stretches of a normal text that can hold an occurrence."""
        out: dict[int, list[tuple[int, int]]] = {}
        for last, (length, where) in self.words.iter(text):
            for number, offset in where:
                _, item, errors, _ = self.items[number]
                begin = last + 1 - length - offset - errors
                end = begin + len(item) + 2 * errors
                out.setdefault(number, []).append((max(0, begin), min(len(text), end)))
        for number, spans in out.items():
            spans.sort()
            merged = [spans[0]]
            for b, e in spans[1:]:
                if b <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                else:
                    merged.append((b, e))
            out[number] = merged
        return out

    def hits(self, text: str | None) -> Iterator[tuple[str, int, int, int]]:
        """(item_id, edits, begin, stop) in characters of the original text."""
        normal = normalise(text)
        if not normal or not self.items:
            return
        for number, spans in sorted(self.windows(normal).items()):
            item_id, item, errors, masks = self.items[number]
            best = None
            for b, e in spans:
                edits, end = best_end(masks, len(item), normal[b:e])
                if edits <= errors and (best is None or edits < best[0]):
                    best = (edits, b + end)
            if best:
                edits, end = best
                begin = edit_begin(item, normal, end, edits)
                yield item_id, edits, *original_span(text, normal, begin, end)


def original_span(text: str, normal: str, begin: int, end: int) -> tuple[int, int]:
    """From positions of the normal form to the words of the text they lie in."""
    spans = places(text)
    first = min(normal.count(" ", 0, begin + (begin < len(normal) and normal[begin] == " ")), len(spans) - 1)
    final = min(normal.count(" ", 0, max(begin, end - 1)), len(spans) - 1)
    return spans[first][0], spans[max(first, final)][1]


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[tuple[str, int], str]]]:
    """((id, number of equal rows), text) of the different items in blocks of about ``block_chars``, one at a time on the driver."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").alias("text"))
    items = rows.where("text IS NOT NULL AND text <> ''").groupBy("id", "text").agg(F.count("*").alias("times"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    place = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, blocks)))
    for k in range(blocks):
        yield sorted(((r.id, r.times), r.text) for r in items.where(place == k).collect())


def find_items(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    chars_per_error: int = CHARS_PER_ERROR, least_chars: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, edits, begin, stop): every item that a document holds, at its best place."""
    out = None
    hit = F.explode("__hits").alias("__hit")
    for block in item_blocks(benchmark, item_id, item_text, block_chars):
        narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _hits(block, chars_per_error, least_chars)(F.col(f"`{text}`")).alias("__hits"))
        each = F.explode(F.sequence(F.lit(1), F.col("__hit.times")))  # a row for every equal row of the benchmark
        found = narrow.select("doc_id", hit).select("doc_id", "__hit", each).select("doc_id", "__hit.*").drop("times")
        out = found if out is None else out.unionByName(found)
    if out is None:
        empty = docs.select(F.col(f"`{doc_id}`").alias("doc_id")).where("false")
        return empty.selectExpr("doc_id", *[f"CAST(NULL AS {kind}) AS {name}" for name, kind in map(str.split, SCHEMA.split(", "))])
    return out


def _hits(block, chars_per_error: int, least_chars: int):
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("edits", pa.int32()), ("begin", pa.int64()), ("stop", pa.int64()), ("times", pa.int64())]))
    state: list[Matcher] = []

    @F.arrow_udf(f"array<struct<{', '.join(':'.join(part.split()) for part in SCHEMA.split(', '))}, times:long>>")
    def find(texts: pa.Array) -> pa.Array:
        if not state:
            state.append(Matcher(block, chars_per_error, least_chars))
        names = ("item_id", "times", "edits", "begin", "stop")
        return pa.array([[dict(zip(names, (*item, *at))) for item, *at in state[0].hits(t)] for t in texts.to_pylist()], kind)

    return find.asNondeterministic()


def without_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no item; columns as they were, nothing is shuffled."""
    item_id, item_text = options.pop("item_id", "item_id"), options.pop("item_text", "text")
    limits = {"chars_per_error": CHARS_PER_ERROR, "least_chars": LEAST_CHARS, "block_chars": BLOCK_CHARS} | options
    block_chars = limits.pop("block_chars")
    for block in item_blocks(benchmark, item_id, item_text, block_chars):
        docs = docs.where(F.size(_hits(block, **limits)(F.col(f"`{text}`"))) == 0)
    return docs
