"""Incremental exact clustering against a plain loop over Python integers."""

import hashlib
import math
import random

import pytest

from tidemark.llm.centroids import _product, cluster_vectors, clusters

SCHEMA = "vec_id long, embedding array<double>, label int, x int, norm int"


def usable(v, dimension):
    return v is not None and len(v) == dimension and all(e is not None and math.isfinite(e) for e in v)


def slow(rows, k, rounds, dimension):
    kept = [(i, [math.floor(1024 * e) for e in v]) for i, v in rows if usable(v, dimension)]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centroids = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m)), c) for c, m in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(near(x)[1], []).append(x)
        centroids = [[sum(v) // len(members[c]) for v in zip(*members[c])] if c in members else m for c, m in enumerate(centroids)]
    last = [(i, *near(x)) for i, x in kept]
    own = {}
    for _, d, c in last:
        own[c] = own.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centroids]
    return [(i, c, d, own[c], sum(own.values()), sha[c]) for i, d, c in last]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, *(v or 0 for v in r[:3])))


def cases():
    r = random.Random(4)
    middle = [[r.gauss(0, 2) for _ in range(4)] for _ in range(5)]
    rows = [(i, [m + r.gauss(0, 1) for m in middle[i % 5]]) for i in range(150)]
    rows += [(7, [0.5] * 4)] * 3 + [(None, [1.0, 2.0, 3.0, 4.0]), (None, [-1.0, 0.0, 0.0, 0.0])]
    rows += [(500, None), (501, [1.0] * 3), (502, [1.0, None, 1.0, 1.0]), (503, [1.0, math.nan, 1.0, 1.0]), (504, [math.inf, 0.0, 0.0, 0.0]), (505, [])]
    hot = [(1000 + i, [3.0, -3.0, 3.0, -3.0]) for i in range(80)]
    large = [(2000, [4e5, -4e5, 4e5, 4e5]), (2001, [4e5, -4e5, 4e5, 3.9e5])]
    return {"mixed": rows + hot, "large": rows + large, "few": rows[:3], "one": [(1, [1.0, 1.0, 1.0, 1.0])] * 12}


@pytest.mark.parametrize("name", list(cases()))
def test_rounds_equal_a_plain_loop(frame, name):
    rows = cases()[name]
    docs = frame([(i, v, 1, 9, 9) for i, v in rows], SCHEMA)
    got = clusters(docs, k=4, rounds=6, dimension=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert ordered(got.collect()) == ordered(slow(rows, 4, 6, 4))


def test_empty_tables_and_narrow_longs(frame):
    docs = frame([(1, [1.0, 2.0], 1, 1, 1)], SCHEMA)
    assert clusters(docs.where("false"), dimension=2).count() == 0
    assert clusters(docs, dimension=3).count() == 0
    assert cluster_vectors(docs, dimension=2, k=1, rounds=0)[1] == [[1024, 2048]]
    with pytest.raises(Exception, match="64 bits"):
        clusters(frame([(1, [1e30, 2.0], 1, 1, 1)], SCHEMA), dimension=2).collect()


def test_products_are_exact_at_every_width():
    import numpy as np

    for size in (10, 1 << 26, 1 << 30):
        x, y = np.array([[size, -size, 3]]), np.array([[size - 1], [1], [-7]])
        assert _product(x, y).tolist() == [[size * (size - 1) - size - 21]]
    with pytest.raises(OverflowError):
        _product(np.array([[1 << 40]]), np.array([[1 << 40]]))
