"""The pipeline against a plain composition of the operators' brute-force versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from test_decontaminate import slow_edits
from test_quality import slow_scores
from test_resemblance import edited, slow_leaders

import corpus_pipeline
from tidemark.llm import bpe, decontaminate, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]

    def lines(n):
        return ["This " + " ".join(rng.choice(words) for _ in range(rng.randint(4, 14))) + "." for _ in range(n)]

    items = [(k, " ".join(rng.choice(words) for _ in range(25))) for k in range(6)]
    passage, inside = lines(4), lines(5)
    common = [w for x in lines(18) for w in x.rstrip(".").split()]
    rows, labels = [], []
    for k in range(220):
        good = k % 4 != 0
        body = lines(rng.randint(1, 6))
        if not good:
            body = [x.upper().replace(" ", "!! ") for x in body]
        elif k % 7 == 1:
            body[1:1] = passage
        elif k % 11 == 2:
            body.append(items[k % 6][1].replace("w1", "x1", 1))
        elif k % 13 == 3 and k > 50:
            body = rows[k - 50][1].split("\n")
        elif k % 17 == 4:  # a passage inside a line
            body[0] = " ".join([body[0], *inside, *body[1:2]])
        elif k % 19 == 5:  # one to eight words of 150 changed: 0.8 or more alike, and many bits of a SimHash apart
            body = [" ".join(edited(rng, common, k % 8 + 1))]
        text = "\n".join(body)
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        if k % 3:
            labels.append((k, int(good), 0))
    rows += [(900, "", "en", "s", 0), (901, None, None, None, None), (902, "", None, "s", 0), (903, "漢字 " * 3000, "zh", "s", 9000)]
    return rows, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, items = corpus()
    base = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def units(text):
    """Lines and sentences, each with what separates it from the next."""
    return [u for line in re.split(r"(?<=\n)", text) for u in re.split(r"(?<=[.!?] )(?=\S)", line)]


def slow_passages(rows):
    """(text, units, units removed) of each row: later occurrences of three units in a row go."""
    seen, out = set(), []
    for _, text, *_ in sorted(rows, key=lambda r: r[0]):
        parts = units(text or "")
        said = [p.rstrip(" \t\r\n") for p in parts]
        gone = set()
        for k in range(len(parts) - 2):
            window = tuple(said[k : k + 3])
            if any(window):
                gone |= set(range(k, k + 3)) if window in seen else set()
                seen.add(window)
        left = "".join(p for k, p in enumerate(parts) if k not in gone)
        if len(parts) - 1 in gone:
            left = re.sub(r"(\n|[ \t]+)$", "", left)
        out.append((text if text is None else left, len(parts), len(gone)))
    return out


def slow_pipeline():
    rows, labels, items = corpus()
    label = {k: q for k, q, _ in labels}
    x = quality.statistics(pa.array([r[1] for r in rows], pa.string()))
    y = np.array([label.get(r[0], -1) for r in rows])
    train = np.array([r[0] in label and zlib.crc32(str(r[0]).encode()) % 5 != 0 for r in rows])
    kept = [[r for r, s in zip(rows, slow_scores(x, y, train)) if s >= 0.3]]
    cut, before = [], sorted(kept[-1], key=lambda r: r[0])
    for r, (text, n, gone) in zip(before, slow_passages(before)):
        if text is None or gone < n:
            cut.append((r[0], text, *r[2:4], len(text) if gone else r[4]))
    kept.append(cut)
    leaders = set(slow_leaders([(r[0], r[1]) for r in cut]))
    kept.append([r for r in cut if r[0] in leaders])
    norm = [decontaminate.normalise(t) for _, t in items]
    kept.append([r for r in kept[-1] if all(slow_edits(i, decontaminate.normalise(r[1])) > len(i) // 16 for i in norm)])
    return kept


def test_every_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = slow_pipeline()
    assert len({len(rows) for rows in expected}) == 4  # every stage drops something
    for (_, step), rows in zip(corpus_pipeline.STAGES, expected):
        docs = step(spark, docs, folder)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, rows))


def test_data_tell_the_rules_apart():
    """Whole lines alone, or equal texts alone, would keep other rows."""
    first, cut, apart, _ = slow_pipeline()
    old = {r[0]: r[1] for r in first}
    inside = [r for r in cut if r[1] != old[r[0]] and "\n" not in (old[r[0]] or "")]
    assert inside and len({r[1] for r in cut}) > len(apart)


def test_run_ends_in_tokens(spark, folder):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    texts = {r[0]: r[1] for r in slow_pipeline()[-1]}
    assert set(got) == set(texts)
    for k, r in got.items():
        assert np.frombuffer(r.ids, "<u4").tolist() == known.encode_ordinary(texts[k] or "") and r.n_tokens * 4 == len(r.ids)


def test_stages_take_empty_and_odd_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
        assert docs.count() == 0
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (5, "same text here", "en", "a", 14), (5, "same text here", "en", "a", 14), (6, "", None, None, None)], SCHEMA
    ).selectExpr("*", "1 AS score", "'x' AS text2", "2 AS stats", "3 AS n_lines", "4 AS digest", "5 AS ids", "6 AS fp")
    for _, step in corpus_pipeline.STAGES[1:-1]:
        assert step(spark, odd, folder).columns == list(corpus_pipeline.COLUMNS)
        assert step(spark, odd, folder).count() >= 2


def test_tokens_are_decoded_and_compared(spark):
    rows = [(1, "plain text,  twice\n", "en", "s", 19), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "漢字 é 🙂", "zh", "s", 6)]
    got = {r.doc_id: r for r in corpus_pipeline.tokens(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert all(got[r[0]].exact and got[r[0]].decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
