"""Repair of conversation structure: the cheapest edits after which role initials read ``(s?(ua)+)?``.

A row can be kept (K, 0), given the role user or assistant (R, 3) or deleted (D, 4; blank and duplicate rows
must be); rows of empty text may be inserted anywhere (I, 3); a truncated row that is not deleted adds 3.  Of
equally cheap edits those with the ASCII-least string of initials win.

The edits are a Viterbi path over four states (nothing yet, after the system row, after a user row, after an
assistant row).  A conversation is read once, in order: every row adds to a tree of backpointers one node per
surviving state.  Nodes carry the number of their children and of the states that end in them; a branch without
either is freed.  As soon as all states share an ancestor the edits up to it are final: they leave the tree and
the rows they decide are hashed and forgotten.  A state is dropped when another state can follow all its
continuations at a strictly smaller total (``_DETOUR``), otherwise "delete everything" would survive for ever.

Two paths that tie at a state are compared over their whole unresolved suffixes: equal cost and equal rows rule
out that one is a prefix of the other, so the letters below their last common node decide.  That node is found
by jump pointers in logarithmic time, so a run of thousands of undecided rows costs no more per row than a short one.

Spark does the damage of the test, the faults and the order: one shuffle by conversation, sorted with spilling;
windows for duplicates use the same distribution.  The digest of a conversation is a chain over its rows, so
they pass one task, as a stream of which only undecided rows are held.

Defined results: rows follow their turn (nulls first), then role, text and repetition; null roles and texts are
one space; a null id is a conversation of its own; a conversation without rows has zeros, an empty audit and the
hash of nothing; an empty table gives an empty table.  Columns other than the four named take no part.
"""

from __future__ import annotations

import hashlib
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RETITLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row of an initial leads; anything else is no place for it.
STEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
COMPLETE = (NOTHING, ASSISTANT)
#: (p, q, extra): whatever q can still become, p can for at most so much more.  From an assistant row all that an
#: untouched conversation may do is possible, but for its system row, which is then deleted instead.
_DETOUR = ((NOTHING, SYSTEM, 0), (NOTHING, ASSISTANT, 0), (NOTHING, USER, INSERT), (ASSISTANT, SYSTEM, 0), (ASSISTANT, NOTHING, DELETE))
_TURN = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_WHITE = " \t\n\x0b\f\r"


@lru_cache(1 << 16)
def _reach(depth: int) -> int:
    """The depth a jump pointer leads to: the last term of ``depth`` as a sum of largest numbers 2^k - 1 is skipped."""
    rest, term = depth, 0
    while rest:
        term = (1 << (rest + 1).bit_length() - 1) - 1
        rest -= term
    return depth - term


class Survivors:
    """Best paths of all states as one tree of backpointers; ``edits`` are letters that every survivor shares."""

    def __init__(self) -> None:
        self.parent, self.letter, self.depth, self.jump, self.reach = [0], [""], [0], [0], [0]
        self.held, self.kids = [1], [0]  # children and states of a node; the sum of its children
        self.free: list[int] = []
        self.root = 0
        self.ends: dict[int, tuple[int, int]] = {NOTHING: (0, 0)}  # state: (cost, node)
        self.edits: deque[str] = deque()
        self._insertions(self.ends)

    def _node(self, parent: int, letter: str) -> int:
        """A child of ``parent``; its jump pointer skips as a skew-binary number system does."""
        depth = self.depth
        reach = _reach(depth[parent] + 1)
        skip = parent if reach == depth[parent] else self._jump(self._jump(parent))
        values = (parent, letter, depth[parent] + 1, skip, reach, 0, 0)
        columns = (self.parent, self.letter, depth, self.jump, self.reach, self.held, self.kids)
        if self.free:
            n = self.free.pop()
            for column, value in zip(columns, values):
                column[n] = value
        else:
            n = len(self.parent)
            for column, value in zip(columns, values):
                column.append(value)
        self.held[parent] += 1
        self.kids[parent] += n
        return n

    def _jump(self, n: int) -> int:
        """Where the jump pointer of a node leads; the root, where that has left the tree."""
        return self.jump[n] if self.reach[n] >= self.depth[self.root] and n != self.root else self.root

    def _release(self, n: int) -> None:
        """One hold of a node less; branches that nothing holds are freed upwards."""
        held = self.held
        held[n] -= 1
        while not held[n] and n != self.root:
            up = self.parent[n]
            self.free.append(n)
            held[up] -= 1
            self.kids[up] -= n
            n = up

    def _lift(self, n: int, depth: int) -> int:
        """The ancestor of ``n`` at a depth, that of the root at least."""
        while self.depth[n] > depth:
            far = self._jump(n)
            n = far if self.depth[far] >= depth else self.parent[n]
        return n

    def _less(self, a: tuple[int, str], b: tuple[int, str]) -> bool:
        """Whether path ``a`` (a node and one more letter) is ASCII-less than ``b``; neither is a prefix of the other."""
        x, y = a[0], b[0]
        if x == y:
            return a[1] < b[1]
        level = min(self.depth[x], self.depth[y])
        above = self._lift(x, level), self._lift(y, level)
        if above[0] == above[1]:  # the shorter path ends at the other's ancestor, and its last letter decides
            if self.depth[x] == level:
                return a[1] < self.letter[self._lift(y, level + 1)]
            return self.letter[self._lift(x, level + 1)] < b[1]
        x, y = above
        while self.parent[x] != self.parent[y]:
            p, q = self._jump(x), self._jump(y)
            if p != q and self.depth[p] == self.depth[q]:
                x, y = p, q
            else:
                x, y = self.parent[x], self.parent[y]
        return self.letter[x] < self.letter[y]

    def _insertions(self, ends: dict[int, tuple[int, int]]) -> None:
        """Rows inserted behind what each state has; two passes reach every state."""
        for _ in range(2):
            for p in (NOTHING, SYSTEM, ASSISTANT, USER):
                if p not in ends:
                    continue
                cost, q = ends[p][0] + INSERT, _TURN[p]
                old = ends.get(q)
                if old is None or cost < old[0] or (cost == old[0] and self._less((ends[p][1], "I"), (self.parent[old[1]], self.letter[old[1]]))):
                    n = self._node(ends[p][1], "I")
                    self.held[n] += 1
                    ends[q] = (cost, n)
                    if old is not None:
                        self._release(old[1])

    def row(self, initial: str, faulty: bool, truncated: bool) -> None:
        """One more row: its edits from every state, then insertions behind it."""
        best: dict[int, tuple[int, int, str]] = {}
        extra = TRUNCATED if truncated else 0

        def offer(q: int, cost: int, node: int, letter: str) -> None:
            old = best.get(q)
            if old is None or cost < old[0] or (cost == old[0] and self._less((node, letter), old[1:])):
                best[q] = (cost, node, letter)

        for p, (cost, node) in self.ends.items():
            offer(p, cost + DELETE, node, "D")
            if not faulty:
                q = STEP.get((p, initial))
                if q is not None:
                    offer(q, cost + extra, node, "K")
                offer(_TURN[p], cost + RETITLE + extra, node, "R")
        ends = {}
        for q, (cost, node, letter) in best.items():
            n = self._node(node, letter)
            self.held[n] += 1
            ends[q] = (cost, n)
        for _, node in self.ends.values():
            self._release(node)
        self._insertions(ends)
        for p, q, detour in _DETOUR:
            if p in ends and q in ends and ends[q][0] > ends[p][0] + detour:
                self._release(ends.pop(q)[1])
        self.ends = ends
        self._settle()

    def _settle(self) -> None:
        """Edits that all survivors share leave the tree."""
        root = self.root
        resting = {node for _, node in self.ends.values()}
        while self.held[root] == 1 and root not in resting:
            child = self.kids[root]
            self.edits.append(self.letter[child])
            self.free.append(root)
            self.root = root = child

    def finish(self) -> int:
        """The cost of the best complete path; all its edits are then in ``edits``."""
        done = [q for q in COMPLETE if q in self.ends]
        q = done[0]
        for r in done[1:]:
            (cost, a), (other, b) = self.ends[r], self.ends[q]
            if cost < other or (cost == other and self._less((self.parent[a], self.letter[a]), (self.parent[b], self.letter[b]))):
                q = r
        cost, node = self.ends[q]
        rest = []
        while node != self.root:
            rest.append(self.letter[node])
            node = self.parent[node]
        self.edits.extend(reversed(rest))
        return cost


class Conversation:
    """Counts, edits and digest of one conversation, fed row by row."""

    def __init__(self) -> None:
        self.first = self.last = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.any = False
        self.tree = Survivors()
        self.waiting: deque[tuple[str, str]] = deque()
        self.audit: list[str] = []
        self.state, self.rows, self.sha = NOTHING, 0, hashlib.sha256()
        self.most_waiting = 0

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        initial = role[:1]
        if turn is not None and (self.last is None or turn != self.last):
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.any and (self.before + initial) not in ("su", "ua", "au"):
            self.illegal += 1
        self.any, self.before = True, initial
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.waiting.append((role, text))
        self.tree.row(initial, fault in ("blank", "duplicate"), fault == "truncated")
        self._write()
        self.most_waiting = max(self.most_waiting, len(self.waiting))

    def _write(self) -> None:
        edits = self.tree.edits
        while edits:
            letter = edits.popleft()
            self.audit.append(letter)
            role, text = ("", "") if letter == "I" else self.waiting.popleft()
            if letter == "D":
                continue
            if letter == "K":
                self.state = STEP[(self.state, role[:1])]
            else:
                self.state = _TURN[self.state]
                role = _ROLE[self.state]
            self.sha.update(f"{chr(10) if self.rows else ''}{role}:{text}".encode())
            self.rows += 1

    def result(self) -> tuple:
        cost = self.tree.finish()
        self._write()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.sha.hexdigest()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _stream(conv_type: pa.DataType):
    """Batches (conv_id, turn, role, text, fault), conversations one after the other, to one row each."""

    def run(batches):
        current, conversation, done = None, None, []

        def flush():
            columns = list(zip(*done)) if done else [()] * 9
            done.clear()
            kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])

        for b in batches:
            for conv, turn, role, text, fault in zip(*(b.column(i).to_pylist() for i in range(5))):
                if conversation is None or conv != current:
                    if conversation is not None:
                        done.append((current, *conversation.result()))
                    current, conversation = conv, Conversation()
                if fault != "dropped":
                    conversation.add(turn, role, text, fault)
            yield flush()
        if conversation is not None:
            done.append((current, *conversation.result()))
            yield flush()

    return run


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copy, dropped): the rows with the faults of the test, set by the CRC of ``conv_id:turn``.

    Dropped rows stay as marks without text, so that a conversation that loses all rows is still known.
    """
    named = conversations.select(*[F.col(f"`{c}`").alias(n) for c, n in ((conv_id, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))])
    or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(or_blank("conv_id"), F.lit(":"), or_blank("turn")).cast("binary")) % 20
    rows = named.select("conv_id", "turn", or_blank("role").alias("role"), or_blank("text").alias("text"), case.alias("case"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("case").isin(0, 1), "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (F.col("case") == 0).alias("dropped"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """``fault`` of each row: dropped, blank, duplicate, truncated or null; the first that applies."""
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    said = F.rtrim(F.col("text"), F.lit(_WHITE))
    return rows.withColumn("nth", F.row_number().over(same)).withColumn(
        "fault",
        F.when(F.col("dropped"), "dropped").when(said == "", "blank").when(F.col("nth") > 1, "duplicate")
        .when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``damaged`` rows."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    ready = with_faults(rows.repartition("conv_id")).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault")
    kind = rows.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"conv_id {kind.simpleString()}, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string, repaired_sha256 string"
    return ready.mapInArrow(_stream(to_arrow_type(kind)), schema)
