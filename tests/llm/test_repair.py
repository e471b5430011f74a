"""Conversation repair against an exhaustive search, a table of whole strings and a plain loop over rows."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm.repair import Conversation, Survivors, damaged, repair

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def exhaustive(rows):
    """(cost, audit) of the best of all edits; rows are (initial, faulty, truncated)."""
    n = len(rows)
    best = (4 * n, "D" * n)

    def go(i, last, cost, audit, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if i == n and last in ("", "a"):
            best = min(best, (cost, audit))
        new = "a" if last == "u" else "u"
        if inserts:
            go(i, new, cost + 3, audit + "I", inserts - 1)
        if i < n:
            initial, faulty, truncated = rows[i]
            extra = 3 if truncated else 0
            go(i + 1, last, cost + 4, audit + "D", inserts)
            if not faulty:
                if initial and initial in NEXT[last]:
                    go(i + 1, initial, cost + extra, audit + "K", inserts)
                go(i + 1, new, cost + 3 + extra, audit + "R", inserts)

    go(0, "", 0, "", n + 2)
    return best


def whole_strings(rows):
    """The same by a table of one (cost, audit) for each last initial."""

    def spread(table):
        for _ in range(3):
            for last, (cost, audit) in list(table.items()):
                new = "a" if last == "u" else "u"
                table[new] = min(table.get(new, (1 << 60, "")), (cost + 3, audit + "I"))
        return table

    table = spread({"": (0, "")})
    for initial, faulty, truncated in rows:
        extra, after = 3 if truncated else 0, {}
        for last, (cost, audit) in table.items():
            offers = [(last, cost + 4, audit + "D")]
            if not faulty:
                offers.append(("a" if last == "u" else "u", cost + 3 + extra, audit + "R"))
                if initial and initial in NEXT[last]:
                    offers.append((initial, cost + extra, audit + "K"))
            for new, c, a in offers:
                after[new] = min(after.get(new, (1 << 60, "")), (c, a))
        table = spread(after)
    return min(table[last] for last in ("", "a") if last in table)


def streamed(rows):
    tree, out = Survivors(), []
    for row in rows:
        tree.row(*row)
        out += tree.edits
        tree.edits.clear()
    cost = tree.finish()
    return (cost, "".join(out) + "".join(tree.edits)), len(tree.parent)


def test_paths_equal_an_exhaustive_search():
    r = random.Random(1)
    for _ in range(800):
        rows = [(r.choice("suuaa?"), r.random() < 0.2, r.random() < 0.2) for _ in range(r.randint(0, 5))]
        assert streamed(rows)[0] == exhaustive(rows) == whole_strings(rows)


@pytest.mark.parametrize("initials", ["suuaa?", "u", "a", "ua", "s", "su", "uuua", "?"])
def test_long_paths_equal_a_table_of_strings(initials):
    r = random.Random(initials)
    for faults in (0, 0.2, 1):
        for cut in (0, 0.2, 1):
            rows = [(r.choice(initials), r.random() < faults, r.random() < cut) for _ in range(150)]
            assert streamed(rows)[0] == whole_strings(rows)


def test_settled_edits_leave_the_tree():
    r = random.Random(3)
    rows = [(r.choice("uuuaaas?"), r.random() < 0.1, r.random() < 0.1) for _ in range(20_000)]
    assert streamed(rows)[1] < 200
    conversation = Conversation()
    for i in range(5000):
        conversation.add(i, "user" if i % 2 else "assistant", f"Text {i}.", None)
    assert conversation.most_waiting < 10


def test_a_run_that_stays_tied_is_quick_and_right():
    rows = [("u", False, False)] * 3000
    assert streamed(rows)[0] == whole_strings(rows)


SCHEMA = "conv_id long, turn long, role string, text string, copy int, fault string"


def slow(rows):
    """The contract row by row: damage, order, faults, edits, digest."""
    conversations = {}
    for conv, turn, role, text, *_ in rows:
        mine = conversations.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 1:
            text = ""
        elif case == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif case == 4:
            role = "user"
        if case:
            mine += [(turn, role, text)] * (2 if case == 3 else 1)
    out = []
    for conv, mine in conversations.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = []
        for i, (_, role, text) in enumerate(mine):
            said = text.rstrip(" \t\n\x0b\f\r")
            seen = (role, text) in [m[1:] for m in mine[:i]]
            faults.append("blank" if not said else "duplicate" if seen else "truncated" if said[-1] not in ".!?" else "")
        cost, audit = whole_strings([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(mine, faults)])
        left, written, last = iter(mine), [], ""
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(left)[1:]
            if letter == "D":
                continue
            last = role[0] if letter == "K" else "a" if last == "u" else "u"
            written.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[last]}:{text}")
        turns = {r[0] for r in mine if r[0] is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(written).encode()).hexdigest(),
        ))
    return out


def test_conversations_equal_a_plain_loop(frame):
    r = random.Random(6)
    texts = ["Yes.", "No!", "open", "", "  \n", None, "Ends here?  ", "söme wörds. and more", "x" * 50_000, " ", "漢字。"]
    rows = []
    for conv in [*range(60), None]:
        turn = -3
        for _ in range(r.randint(1, 14)):
            turn += r.choice([0, 1, 1, 1, 2])
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"])
            rows.append((conv, r.choice([turn] * 9 + [None]), role, r.choice(texts), 5, "blank"))
    rows += [(99, 0, "user", "Same.", 1, "")] * 4 + [(98, i, "user", "All the same.", 1, "") for i in range(300)]
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i + 200}:0".encode()) % 20 == 0) + 200
    rows.append((dropped, 0, "user", "Gone.", 1, ""))
    got = repair(damaged(frame(rows, SCHEMA)))
    key = lambda t: (t[0] is None, t[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(slow(rows), key=key)
    gone = [t for t in slow(rows) if t[0] == dropped]
    assert gone == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table_and_string_ids(frame):
    assert repair(damaged(frame([(1, 1, "user", "A.", 1, "")], SCHEMA).where("false"))).count() == 0
    named = frame([("a", 1, "user", "A.", 1, ""), ("a", 2, "assistant", "B.", 1, "")], SCHEMA.replace("conv_id long", "conv_id string"))
    assert [r.conv_id for r in repair(damaged(named)).collect()] == ["a"]
