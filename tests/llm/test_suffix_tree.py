import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import suffix_tree as st


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def words_of(text):
    return (text or "").encode().lower().split()


class SlowTree:
    """The same tree by dictionaries of byte strings."""

    def __init__(self, sequences, depth, least):
        self.depth = depth
        self.counts = [Counter() for _ in range(depth + 1)]
        for s in sequences:
            padded = b"\n" * depth + s
            for j in range(depth, len(padded)):
                for d in range(depth + 1):
                    self.counts[d][padded[j - d : j + 1]] += 1
        self.total, self.kinds = [Counter() for _ in range(depth + 1)], [Counter() for _ in range(depth + 1)]
        for d in range(depth + 1):
            for k, n in self.counts[d].items():
                self.total[d][k[:-1]] += n
                self.kinds[d][k[:-1]] += 1
        self.kept = {b""}
        for d in range(1, depth + 1):
            for context, n in self.total[d].items():
                own = [(s, m) for s in range(256) if (m := self.counts[d][context + bytes([s])])]
                up = self.total[d - 1][context[1:]]
                gain = sum(m * math.log((m / n) / (self.counts[d - 1][context[1:] + bytes([s])] / up)) for s, m in own)
                if n >= least and gain >= 0.5 * len(own) * math.log(max(n, 2)):
                    self.kept |= {context[k:] for k in range(d + 1)}

    def p(self, context, s):
        d = len(context)
        n = self.counts[d][context + bytes([s])]
        if not d:
            return (n + 1) / (sum(self.counts[0].values()) + 256)
        t = self.kinds[d][context]
        return (n + t * self.p(context[1:], s)) / (self.total[d][context] + t)

    def log(self, before, token):
        padded, out = b"\n" * self.depth + before, 0.0
        for s in token:
            context = padded[len(padded) - self.depth :]
            while context not in self.kept:
                context = context[1:]
            out += math.log10(self.p(context, s))
            padded += bytes([s])
        return out


def slow(rows, depth, least):
    train = [words_of(t) for i, t in rows if not held(i)]
    counts = Counter(w for ws in train for w in (*ws, b"\n"))
    n, v = sum(counts.values()), len(counts)
    tree = SlowTree([st.spelled(ws) for ws in train], depth, least)
    out = []
    for i, t in rows:
        tokens, before, base, score = [*words_of(t), b"\n"], b"", 0.0, 0.0
        for w in tokens:
            spelled = w if w == b"\n" else w + b" "
            unigram = (counts[w] + 1) / (n + v + 1)
            base += math.log10(unigram)
            score += math.log10(0.3 * unigram + 0.7 * 10 ** tree.log(before, spelled))
            before += spelled
        out.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, base, score))
    return out


def test_scores_equal_brute_force(frame):
    rng = random.Random(1)
    words = ["the", "of", "thing", "er", "thinger", "é", "Of"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for k in range(90)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "unseen tokens here"), (104, "x" * 3_000), (None, "the null"), rows[4], rows[4]]
    docs = frame(rows, "doc_id long, text string")
    # a crown of the whole tree, of a part, and of the root alone
    for depth, least, held_states, frequent in ((3, 20, 10_000, 1e-2), (6, 2, 150, 0.5), (4, 8, 0, 1e-6)):
        got = st.score_documents(docs, depth=depth, least_count=least, held_states=held_states, frequent_share=frequent).collect()
        want = slow(rows, depth, least)
        assert len(got) == len(want)
        for g, w in zip(sorted(map(tuple, got), key=str), sorted(want, key=str)):
            assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], atol=1e-7), (g, w)


def test_distributions_sum_to_one_and_the_crown_is_bounded(frame):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice(("abca", "cb ", "bbca", "acab ")) for _ in range(60))) for k in range(40)]
    tree = st.learn_tree(st.corpus_counts(frame(rows, "doc_id long, text string"), 3), 3, 4)
    n_states = tree.states.count()
    whole, part, root = tree.crown(), tree.crown(40), tree.crown(0)
    assert sum(map(len, whole.contexts)) == n_states and not any(map(len, whole.fringe))
    held = sum(len(x) for f in (part.contexts, part.fringe, part.entries) for x in f)
    assert 0 < sum(map(len, part.contexts)) < n_states and any(map(len, part.fringe)) and held <= 40 + 256
    assert not any(map(len, root.contexts)) and len(root.fringe[1]) == len(whole.contexts[1])
    for context in (b"abc", b"zzz", b"  a", b"\n\n\n"):
        window = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        logs, below = whole.window_logs(window)
        assert not below.any() and abs((10**logs).sum() - 1) < 1e-9
        joined = {r.window: r.log for r in tree.window_logs(frame([(int(w),) for w in window], "window long")).collect()}
        assert np.allclose([joined[int(w)] for w in window], logs)


def test_the_tree_grows_with_the_corpus(frame):
    """A context with a fixed count stays, however many positions there are besides."""
    def kept(n):
        rows = [(k, "qxz qxz qxz") for k in range(6)] + [(100 + k, " ".join(f"w{k}a{j}b" for j in range(40))) for k in range(n)]
        states = st.learn_tree(st.corpus_counts(frame(rows, "doc_id long, text string"), 3), 3).states
        contexts = {(r.d, r.context) for r in states.select("d", "context").collect()}
        return (1, ord("q")) in contexts and (1, ord("x")) in contexts, len(contexts)

    small, large = kept(5), kept(150)
    assert small[0] and large[0] and large[1] > small[1]


def test_tables_without_training_rows(frame):
    rows = [(i, "some words") for i in range(200) if held(i)][:5]
    got = st.score_documents(frame(rows, "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)] * 5 and all(math.isfinite(r.score) and r.base_score == 0 for r in got)
    assert st.score_documents(frame(rows, "doc_id long, text string").where("false")).count() == 0


def test_the_tree_beats_unigrams_on_held_out_texts(spark):
    from tidemark.llm.queries import op9_suffix_tree

    rows = [r for r in op9_suffix_tree(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and np.mean([r.score > r.base_score for r in rows]) > 0.85


def test_windows_are_grouped_whatever_their_hash_bits():
    rng = np.random.default_rng(5)
    grams = rng.integers(0, 40, 5000).astype(np.uint64) << np.uint64(48)
    once, order, which = st.different(grams)
    assert sorted(order.tolist()) == list(range(5000)) and (once[which] == grams[order]).all()
    assert set(once.tolist()) == set(grams.tolist())


def test_rows_of_contexts_too_rare_for_the_tree_are_left_out_before_its_joins(frame):
    train = frame([("ab ab ab ab ab ab ab ab ab qz",)], "text string")
    found = st._all_windows(st.corpus_counts(train), 6, 8).where("d > 0")
    assert found.count() > 0 and found.where("total < 8").count() == 0


def test_counting_holds_windows_that_recur_once():
    rng = np.random.default_rng(7)
    letters = rng.integers(97, 103, 10_000_000).astype(np.uint8)
    letters[::8] = 32
    texts = [letters[a : a + 60_000].tobytes().decode() for a in range(0, len(letters), 60_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]
    tracemalloc.start()
    n = sum(int(b.column("n").to_numpy()[b.column("kind").to_numpy() == st.GRAM].sum()) for b in st._counting(6)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a blank before a text's first word is dropped; one behind its last and the end are added
    assert n == len(letters) + len(texts) and peak < 120e6


def test_counts_are_added_whatever_the_slices(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]

    def counted():
        found = Counter()
        for b in st._counting(6)(iter(batches)):
            for kind, key, n in zip(*(b.column(c).to_pylist() for c in ("kind", "key", "n")), strict=True):
                found[kind, key] += n
        return found

    whole = counted()
    for limit, held_entries in ((64, 10**6), (300, 500)):
        monkeypatch.setattr(st.runs, "__defaults__", (limit,))
        monkeypatch.setattr(st, "HELD_ENTRIES", held_entries)
        assert counted() == whole


def test_windows_are_looked_up_in_parts(frame, monkeypatch):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice(("abca", "cb ", "bbca", "acab ")) for _ in range(60))) for k in range(20)]
    crown = st.learn_tree(st.corpus_counts(frame(rows, "doc_id long, text string"), 3), 3, 4).crown(40)
    grams, _ = st.windows([text.encode() for _, text in rows], 3)
    logs, below = crown.window_logs(grams)
    monkeypatch.setattr(st, "LOOKED_UP", 7)
    again, under = crown.window_logs(grams)
    assert below.any() and not below.all() and (logs == again).all() and (below == under).all()
