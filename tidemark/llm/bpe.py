"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that can be the last of its encoding.  An
Aho-Corasick pass names the tokens that end at each byte, and ``PrefixTable`` stores the one that fits for each byte, so an append continues from the end and an edit
re-encodes from the edit on; the whole encoding is read by walking back.  A token may follow another
only if the two, merged from bytes, come out as themselves.  Texts are first cut by a pattern and each
match is encoded separately; pieces already seen are answered from a bounded cache.

The ranks must hold all 256 bytes and encode every token's bytes as that token (byte-level rank files
of public tokenizers do).  Ids are packed as little-endian unsigned 32-bit integers.

Defined results: a null or empty text has no tokens; any other text round-trips byte by byte; repeated
rows encode alike; an empty table gives an empty table; columns named like the results are replaced.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_PIECES = 150_000
CACHED_PAIRS = 400_000


class Ranks:
    """A rank file: token bytes to id and back, and which tokens may stand side by side."""

    def __init__(self, ids: dict[bytes, int]):
        self.ids = ids
        self.tokens = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.tokens[i] = token
        self.longest = max(map(len, ids))
        self.endings = ahocorasick.Automaton()
        for token, i in ids.items():
            self.endings.add_word(token.decode("latin-1"), (i, len(token)))
        self.endings.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}

    def merged(self, piece: bytes, below: int | None = None) -> list[int]:
        """Plain merging, lowest rank first (the definition), with ranks under ``below`` only if given."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = self.ids.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None or (below is not None and best >= below):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def last_merge(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one (of at least two bytes)."""
        known = self.parts.get(token)
        if known is None:
            whole = self.tokens[token]
            known = self.parts[token] = tuple(self.merged(whole, below=token))
        return known

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether the two, merged from bytes, come out as themselves.

        Merges run in rank order, so the boundary between the two is gone through backwards: while the
        pieces a and b touch it, a merge across it must not come before the merge that made them grow.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(left, right)
        return known

    def _apart(self, a: int, b: int) -> bool:
        tokens, until = self.tokens, len(self.tokens)
        while True:
            across = self.ids.get(tokens[a] + tokens[b])
            if across is not None and across < until:
                return False
            if len(tokens[a]) > 1 and (a > b or len(tokens[b]) == 1):
                until, a = a, self.last_merge(a)[1]
            elif len(tokens[b]) > 1:
                # of equal merges the left one comes first, and across is left of b's
                until, b = b + 1, self.last_merge(b)[0]
            else:
                return True


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    with open(path, "rb") as lines:
        return Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, ranks: Ranks, piece: bytes = b""):
        self.ranks, self.piece, self.last = ranks, bytearray(), []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Continues the table: of the part already there only the last few bytes are read again."""
        last, begin, fits = self.last, len(self.piece), self.ranks.side_by_side
        self.piece += more
        text = self.piece.decode("latin-1")
        for end, (token, length) in self.ranks.endings.iter(text, max(0, begin - self.ranks.longest)):
            if end == len(last) and (length > end or fits(last[end - length], token)):
                last.append(token)

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Re-encodes from ``begin`` on until the table agrees with the old one far enough, then reuses it."""
        old, tail, step = self.last, bytes(self.piece[end:]), self.ranks.longest
        del self.piece[begin:]
        self.last = old[:begin]
        self.append(new)
        for k in range(0, len(tail), step):
            self.append(tail[k : k + step])
            # an entry depends on the longest token's length of entries before it at most, so so many equal ones settle the rest
            if len(tail) > k + step and self.last[-step:] == old[end + k : end + k + step]:
                self.piece += tail[k + step :]
                self.last += old[end + k + step :]
                return

    def ids(self) -> list[int]:
        out, at = [], len(self.last)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.ranks.tokens[out[-1]])
        return out[::-1]


class Encoded:
    """A text with its pieces' tables: exact appends and edits that touch only the pieces around them."""

    def __init__(self, ranks: Ranks, pattern: str, text: str = ""):
        self.ranks, self.pattern, self.text = ranks, regex.compile(pattern), text
        self.pieces = [(m.start(), PrefixTable(ranks, m[0].encode())) for m in self.pattern.finditer(text)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, begin: int, end: int, new: str) -> None:
        """Pieces that end well before ``begin`` stay; behind the edit the old ones return at the first common start."""
        shift = len(new) - (end - begin)
        self.text = self.text[:begin] + new + self.text[end:]
        starts = [s for s, _ in self.pieces]
        # where a piece ends depends on the next two characters at most (white space before a word, contractions)
        stops = [*starts[1:], len(self.text) - shift][: len(starts)]
        keep = 0
        while keep < len(starts) and stops[keep] + 2 <= begin:
            keep += 1
        behind = {s + shift: k for k, s in enumerate(starts) if s >= end}
        fresh, at = [], starts[keep] if keep < len(starts) else (stops[-1] if stops else 0)
        rest: list = []
        for m in self.pattern.finditer(self.text, at):
            if m.start() in behind and m.start() >= begin + len(new):
                rest = [(s + shift, t) for s, t in self.pieces[behind[m.start()] :]]
                break
            fresh.append((m.start(), PrefixTable(self.ranks, m[0].encode())))
        self.pieces = self.pieces[:keep] + fresh + rest

    def ids(self) -> list[int]:
        return [i for _, table in self.pieces for i in table.ids()]


class PieceCache(dict):
    """Packed ids by piece; when full, the pieces not asked for since the last time make room.

    So memory is bounded whatever the vocabulary of the corpus, and frequent pieces stay.
    """

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks, self.before = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.before.get(piece)
        if packed is None:
            packed = np.array(PrefixTable(self.ranks, piece.encode()).ids(), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHED_PIECES:
                self.before = dict(self)
                self.clear()
            self[piece] = packed
        return packed


@lru_cache(maxsize=4)
def piece_cache(path: str) -> PieceCache:
    return PieceCache(load_ranks(path))


def _encoded(texts: pa.Array, ranks_path: str, pattern: str):
    lookup, pieces = piece_cache(ranks_path).__getitem__, regex.compile(pattern).findall
    for t in texts:
        yield b"".join(map(lookup, pieces(t.as_py()))) if t.is_valid else b""


def _decoded(packed, ranks_path: str):
    token = load_ranks(ranks_path).tokens.__getitem__
    for p in packed:
        yield b"".join(map(token, np.frombuffer(p, "<u4").tolist()))


def _with_count(coded: DataFrame) -> DataFrame:
    return coded.withColumn("n_tokens", F.expr("CAST(octet_length(ids) / 4 AS BIGINT)"))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (packed) and ``n_tokens``; special tokens are ordinary text."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(_encoded(texts, ranks_path, pattern), pa.binary())

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "n_tokens")]
    return _with_count(docs.select(*kept, encode.asNondeterministic()(F.col(f"`{text}`")).alias("ids")))


def decode_documents(coded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``: the bytes that the packed ids stand for."""

    @F.arrow_udf("binary")
    def decode(packed: pa.Array) -> pa.Array:
        return pa.array(_decoded((p.as_py() or b"" for p in packed), ranks_path), pa.binary())

    return coded.withColumn("decoded", decode.asNondeterministic()(F.col(f"`{ids}`")))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids``, ``n_tokens`` and ``decoded``: both directions by one Python worker for each task."""

    @F.arrow_udf("struct<ids:binary, decoded:binary>")
    def both(texts: pa.Array) -> pa.Array:
        ids = pa.array(_encoded(texts, ranks_path, pattern), pa.binary())
        return pa.StructArray.from_arrays([ids, pa.array(_decoded((p.as_py() for p in ids), ranks_path), pa.binary())], ["ids", "decoded"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "n_tokens", "decoded")]
    coded = docs.select(*kept, both.asNondeterministic()(F.col(f"`{text}`")).alias("__both"))
    return _with_count(coded.select("*", "__both.ids", "__both.decoded").drop("__both"))
