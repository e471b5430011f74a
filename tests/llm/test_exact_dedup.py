"""Exact groups against a dictionary of texts, with good and with colliding digests."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import deduplicated, exact_groups

SCHEMA = "doc_id long, text string, digest string, keep_id long"


def slow(rows, best):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = best(named) if named else None
        at = ids.index(keep)
        out += [(i, keep, len(ids), k == at, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return out


def rows():
    r = random.Random(2)
    some = [(i, r.choice(["", "a", "b", "A", "a ", "ä", "é" * 40, "x" * 200_000, None, "one\ntwo"]), "d", 1) for i in range(200)]
    return some + [(7, "again", "d", 1)] * 3 + [(None, "again", "d", 1), (None, "unnamed", "d", 1), (None, "unnamed", "d", 1), (900, "alone", None, None)]


def ordered(found):
    return sorted(map(tuple, found), key=lambda r: (r[4], r[0] is None, r[0] or 0, r[3]))


#: 128 bits, three values, one value: the last two must be told apart by their bytes
DIGESTS = {"whole": None, "three": lambda sha, text: F.length(text) % 3, "one": lambda sha, text: F.lit("same")}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("digest", list(DIGESTS))
@pytest.mark.parametrize("hot_share", [1, 10, 10_000])
def test_groups_equal_a_dictionary(frame, keep, digest, hot_share):
    options = {"digest": DIGESTS[digest]} if DIGESTS[digest] else {}
    got = exact_groups(frame(rows(), SCHEMA), keep=keep, hot_share=hot_share, **options)
    assert ordered(got.collect()) == ordered(slow(rows(), min if keep == "smallest" else max))


def test_rows_that_stay_keep_their_columns(frame):
    docs = frame(rows(), SCHEMA)
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "" for r in kept.collect())) == sorted({t or "" for _, t, *_ in rows()})


def test_empty_table_and_plan_without_python(frame):
    docs = frame(rows(), SCHEMA)
    assert exact_groups(docs.where("false")).count() == 0
    plan = exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        exact_groups(docs, keep="first")
