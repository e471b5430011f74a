import random
import zlib

import numpy as np
import pyarrow as pa

from tidemark.llm import quality


def slow_scores(x, y, train, pooled=0.2, ridge=0.01):
    """The discriminant by its textbook formula."""
    p = x.shape[1]
    means = [x[train & (y == k)].mean(axis=0) for k in (0, 1)]
    covs = [np.cov(x[train & (y == k)].T, bias=True) for k in (0, 1)]
    sizes = [(train & (y == k)).sum() for k in (0, 1)]
    common = sum(c * n for c, n in zip(covs, sizes)) / sum(sizes)
    logs = []
    for m, c, n in zip(means, covs, sizes):
        c = (1 - pooled) * c + pooled * common
        c = (1 - ridge) * c + ridge * np.trace(c) / p * np.eye(p)
        d = x - m
        logs.append(np.log(n) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def corpus(n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["alpha", "beta", "of", "gamma", "it"]) for _ in range(rng.randint(3, 80))]
        rows.append((k, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((k, int(good)))
    return rows, labels


def test_scores_equal_the_formula(frame):
    rows, labels = corpus()
    docs = frame(rows, "doc_id long, text string")
    stats, model = quality.train(docs, frame(labels + labels[:50], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.score_statistics(stats, model).collect()}
    x = quality.statistics(pa.array([t for _, t in rows]))
    train = np.array([zlib.crc32(str(k).encode()) % 5 != 0 for k, _ in rows])
    slow = slow_scores(x, np.array([y for _, y in labels]), train)
    assert np.allclose([got[k] for k, _ in rows], slow, atol=1e-6)
    again = {r.doc_id: r.score for r in quality.score_texts(docs, model).collect()}
    assert np.allclose([again[k] for k, _ in rows], slow, atol=1e-6)


def test_statistics_do_not_depend_on_the_batch():
    texts = [None, "", "a", "É! x|y\n\nzz zz zz", "w" * 200_000, "漢 字 " * 5_000, "end "] + [t for _, t in corpus(40)[0]]
    whole = quality.statistics(pa.array(texts, pa.string()))
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, alone) and np.isfinite(whole).all()


def test_odd_tables(frame):
    rows, labels = corpus(60)
    odd = rows + [(1000, None), (1001, ""), (None, "null id"), (3, rows[3][1])]
    docs = frame(odd, "doc_id long, text string")
    y = frame([(k, v) for k, v in labels] + [(3, 1 - labels[3][1]), (5, None), (None, 1)], "doc_id long, quality int")
    stats, model = quality.train(docs, y)
    got = quality.score_statistics(stats, model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1000] == by_id[1001]
    stats, model = quality.train(docs, y.where("false"))
    assert {r.score for r in quality.score_statistics(stats, model).collect()} == {0.5}
    stats, model = quality.train(docs.where("false"), y)
    assert quality.score_statistics(stats, model).count() == 0


def test_held_out_accuracy(spark):
    from tidemark.llm.queries import op1_quality

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op1_quality(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.97
