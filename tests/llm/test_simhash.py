import random

import numpy as np
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(pairs, radius):
    """pairs: (id, fingerprint); returns root fingerprint by fingerprint and smallest id by root."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    smallest = {}
    for d, f in pairs:
        if d is not None:
            smallest[find(f)] = min(d, smallest.get(find(f), d))
    return {f: smallest.get(find(f)) for f in fps}


def test_fingerprints_and_components_equal_brute_force(spark, frame):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [t.upper() for t in texts[:10]] + texts[:5] + [None, "", " \t\n", "one", "One two", "é\x1cx y z", "w " * 30_000]
    for t in texts[20:50]:
        parts = t.split()
        if parts:
            parts[rng.randrange(len(parts))] = "changed"
            texts.append(" ".join(parts))
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, "only without an id a b c d")]
    expected = slow_components([(d, slow_fingerprint(t)) for d, t in rows], 4)
    got = simhash.near_duplicates(frame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=key) == sorted(
        [(d, f"{slow_fingerprint(t):016x}", expected[slow_fingerprint(t)]) for d, t in rows], key=key
    )


def planted(rng, groups=12, each=25):
    out = set()
    for _ in range(groups):
        x = rng.getrandbits(64)
        for _ in range(each):
            out.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    return sorted(out | {rng.getrandbits(64) for _ in range(200)} | {0, 1, 1 << 63, (1 << 64) - 1})


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_lose_nothing_at_any_chunk(spark):
    rng = random.Random(6)
    fps = planted(rng)
    # a crowded ball: 14 free bits, many fingerprints that share most blocks
    ball = sorted({(7 << 40) | rng.getrandbits(14) for _ in range(400)})
    for numbers, chunk in ((fps, simhash.CHUNK), (fps, 4), (ball, 16)):
        distinct = spark.createDataFrame([(signed(x),) for x in numbers], "fp long").repartition(5)
        edges = simhash.link_fingerprints(distinct, 4, chunk)
        roots = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in components(edges).collect()}
        smallest = {}
        for x in numbers:
            smallest.setdefault(roots.get(x, x), x)
        assert {x: smallest[roots.get(x, x)] for x in numbers} == slow_components([(x, x) for x in numbers], 4)


def test_pivot_tables_never_discard_a_link():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 500, np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    assert (np.abs(simhash.pivot_table(x) - simhash.pivot_table(y)).max(axis=1) <= np.bitwise_count(x ^ y)).all()


def test_a_dense_group_gives_a_forest():
    rng = random.Random(7)
    ball = np.array(sorted({rng.getrandbits(9) for _ in range(300)}), np.uint64)
    assert len(simhash.forest(ball, 4)) == len(ball) - 1


def test_components_of_paths_stars_and_loops(frame):
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(1000, 1100)]
    edges = path + star + [(5, 5), (2, 3), (3, 2), (2, 3)]
    got = {r.node: r.root for r in components(frame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {7: 7} | {k: 7 for k in range(1000, 1100)} | {2: 2, 3: 2}
    assert components(frame(edges, "a long, b long").where("false")).count() == 0


def test_one_row_of_each_component_stays(frame):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (1, "a b c d e f", "x"), (3, "q r s t u v", "z"), (None, "q r s t u v", "n"), (None, "m n o p k l", "n"), (4, "", "e"), (5, None, "e")]
    kept = simhash.one_of_each(frame(rows, "doc_id long, text string, digest string"))
    assert kept.columns == ["doc_id", "text", "digest"]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, "a b c d e f"), (3, "q r s t u v"), (None, "m n o p k l"), (4, "")]))
    assert simhash.one_of_each(frame(rows, "doc_id long, text string, digest string").where("false")).count() == 0
