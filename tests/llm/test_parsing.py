import hashlib
import random

import numpy as np
import pyarrow as pa

from tidemark.llm import parsing


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghinoprst") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_neighbouring_labels_differ_and_are_small():
    rng = np.random.default_rng(1)
    names = rng.integers(0, 1 << 64, 20_000, np.uint64)
    names[1000:1200] = np.arange(200)  # close names
    starts = np.array([0, 7, 500, 19_999])
    labels = parsing.coin_tosses(names, starts)
    inside = np.ones(len(names), bool)
    inside[starts] = False
    assert labels.max() < 8 and (labels[1:] != labels[:-1])[inside[1:]].all()


def test_phrases_are_bounded_and_shared_at_any_offset():
    rng = random.Random(2)
    common = sentence(rng, 400).encode()
    sets = []
    for before in (b"", b"x", sentence(rng, 31).encode(), b"aaaaaaaa"):
        names, starts = parsing.SYMBOLS[np.frombuffer(before + common, np.uint8)], np.array([0])
        for _ in range(2):
            longer = len(names)
            names, starts = parsing.next_level(names, starts)
            assert longer / 16 <= len(names) <= longer / 1.5
        sets.append(set(names.tolist()))
    for other in sets[1:]:
        assert len(sets[0] - other) <= 12  # all but the edge


def test_fingerprints_do_not_depend_on_the_batch():
    rng = random.Random(3)
    texts = [None, "", "a", "aa", "aaaaaaaaaaaaaaaa", "é漢😀", "ab" * 50_000, "a" * 100_000] + [sentence(rng, rng.randint(1, 300)) for _ in range(30)]
    whole = parsing.sketches(pa.array(texts, pa.string()))
    assert (np.concatenate([parsing.sketches(pa.array([t], pa.string())) for t in texts]) == whole).all()
    assert (parsing.from_text(parsing.as_text(whole)) == whole).all()
    assert (parsing.likeness(whole, whole) == 1).all()
    assert parsing.likeness(whole[:1], whole[1:2]) == 1 and parsing.likeness(whole[:1], whole[2:3]) == 0


def test_likeness_follows_the_shared_part():
    rng = random.Random(4)
    base = [sentence(rng, 300) for _ in range(40)]
    x = parsing.sketches(pa.array(base))
    shifted = parsing.likeness(x, parsing.sketches(pa.array(["odd start " + t for t in base])))
    halves = parsing.likeness(x, parsing.sketches(pa.array([t[: len(t) // 2] + u[: len(u) // 2] for t, u in zip(base, base[::-1])])))
    others = parsing.likeness(x, np.roll(x, 1, axis=0))
    assert shifted.mean() > 0.9 and 0.2 < halves.mean() < 0.5 and others.mean() < 0.05


def slow(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        e = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        a, b, c = (parsing.sketches(pa.array([s])) for s in (t, e, u))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), parsing.as_text(a)[0], parsing.as_text(b)[0], float(parsing.likeness(a, b)[0]), float(parsing.likeness(a, c)[0])))
    return sorted(out, key=str)


def test_edits_with_the_next_document(frame):
    rng = random.Random(5)
    rows = [(rng.randrange(-50, 5_000), sentence(rng, rng.randint(0, 40))) for _ in range(150)]
    rows += [(10_000, None), (10_001, ""), (rows[0][0], "same id"), (rows[1]), (None, "no id"), (None, None), (10_002, "漢字" * 4_000)]
    docs = frame(rows, "doc_id long, text string")
    for buckets in (1, 7, 64):
        assert sorted(map(tuple, parsing.edited_likeness(docs, buckets=buckets).collect()), key=str) == slow(rows)
    assert sorted(map(tuple, parsing.edited_likeness(docs.where("doc_id = 10002")).collect())) == slow(rows[-1:])
    assert parsing.edited_likeness(docs.where("false")).count() == 0


def test_columns(frame):
    docs = frame([(1, "some words", "x"), (2, None, "y")], "doc_id long, text string, fingerprint string")
    both = parsing.add_likeness(parsing.add_fingerprints(docs), "fingerprint", "fingerprint")
    assert [r.likeness for r in both.collect()] == [1, 1] and both.columns == ["doc_id", "text", "fingerprint", "likeness"]
