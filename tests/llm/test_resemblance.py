"""Near-duplicates by similarity against all pairs of sets of words."""

import random

import numpy as np

import corpus_pipeline
from tidemark.llm import resemblance


def slow_sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def slow_leaders(rows):
    """The smallest id of every component of the pairs with similarity 0.8 or more."""
    sets = [slow_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a | b and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    members = {}
    for k, (doc_id, _) in enumerate(rows):
        members.setdefault(find(k), []).append(doc_id)
    return sorted(min(v) for v in members.values())


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice(([], ["new%d" % rng.randrange(999)], [out[at], "more"]))
    return out


def corpus():
    rng = random.Random(5)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((3, 5, 9, 30, 80, 200, 500)))]
        for _ in range(rng.randint(1, 5)):
            rows.append(" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 30)))))
    rows += [None, "", " \n", "A b c d e f", "a B c d e f", "lone"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_stage_equals_all_pairs(frame):
    rows = corpus()
    want = slow_leaders(rows)
    docs = frame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_near_duplicates(docs.sparkSession, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) < len(rows) - 40
    small = resemblance.one_of_each(docs, chunk=4, early=1)
    assert sorted(r.doc_id for r in small.collect()) == want


def row(a, root=0):
    return {"size": len(a), "sketch": resemblance.sketch(a), "root": root}


def test_candidates_lose_no_link():
    rng = random.Random(6)
    for n in (1, 2, 4, 5, 6, 9, 10, 30, 144, 700, 1020, 2300, 5000):
        for _ in range(30 if n < 1000 else 8):
            a = rng.sample(range(1 << 60), n)
            b = a[rng.randint(0, n // 9) :] + rng.sample(range(1 << 60), rng.randint(0, n // 9))
            a, b = (np.unique(np.array(x, np.uint64)) for x in (a, b))
            linked = 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))
            assert resemblance.similar(a, b) == resemblance.similar(b, a) == linked
            if linked:
                assert np.intersect1d(a[: resemblance.prefix_length(len(a))], b[: resemblance.prefix_length(len(b))]).size
                assert resemblance.candidate_forest([row(a), row(b)]) == resemblance.candidate_pairs([row(a), row(b, 1)]) == [(0, 1)]
                assert not resemblance.candidate_pairs([row(a), row(b)])


def test_sketches_rule_out_unlike_sets_of_every_size():
    rng = random.Random(7)
    for n in (100, 1000, 1030, 2300, 4090, 8000, 20_000):
        sets = [np.unique(np.array(rng.sample(range(1 << 60), n + 40 * k), np.uint64)) for k in range(5)]
        assert not resemblance.candidate_forest([row(a) for a in sets])
        assert not resemblance.candidate_pairs([row(a, k) for k, a in enumerate(sets)])


def test_long_texts_with_a_common_header(frame):
    """Texts of over 2,500 shingles that share a header, some of them near copies of one another."""
    rng = random.Random(8)
    header = [f"h{k}" for k in range(300)]
    rows = []
    for base in range(24):
        words = [f"w{rng.randrange(10**6)}" for _ in range(2600 + 90 * base)]
        for _ in range(1 + base % 3):
            rows.append(" ".join(header + edited(rng, words, rng.choice((0, 20, 60, 130)))))
    rows = list(enumerate(rows))
    docs = frame(rows, "doc_id long, text string")
    for options in ({}, {"chunk": 4, "early": 1}):
        assert sorted(r.doc_id for r in resemblance.one_of_each(docs, **options).collect()) == slow_leaders(rows)


def test_close_copies_are_candidates_by_fingerprint(frame, monkeypatch):
    rng = random.Random(5)
    words = ["w%d" % rng.randrange(5000) for _ in range(900)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join("v%d" % rng.randrange(5000) for _ in range(900))]
    docs = frame(list(enumerate(texts)), "doc_id long, text string")
    described = docs.select("doc_id", resemblance._described(docs["text"]).alias("d")).select("doc_id", "d.node", "d.fp")
    found = {r["doc_id"]: r for r in described.collect()}
    assert [r["fp"] % (1 << 64) for _, r in sorted(found.items())] == [resemblance.simhash.fingerprint(t.encode(), 5) for t in texts]
    pairs = [tuple(r) for r in resemblance.fingerprint_pairs(described.select("node", "fp")).collect()]
    assert pairs == [tuple(sorted((found[0]["node"], found[1]["node"])))]
    # the stage asks the fingerprints, not the keys alone
    asked = []
    whole = resemblance.fingerprint_pairs
    monkeypatch.setattr(resemblance, "fingerprint_pairs", lambda nodes: asked.append(1) or whole(nodes))
    assert sorted(r["doc_id"] for r in resemblance.one_of_each(docs).collect()) == [0, 2] and asked
