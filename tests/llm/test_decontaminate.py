import random

from tidemark.llm import decontaminate as d


def slow_edits(item, text):
    """Fewest edits of the item against any stretch of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, x in enumerate(item, 1):
            new.append(min(row[k - 1] + (x != c), row[k] + 1, new[k - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        edits, end = d.best_end(d.symbol_masks(item), len(item), text)
        assert edits == slow_edits(item, text)
        assert edits == len(item) or slow_edits(item, text[:end]) == edits


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        k = rng.randrange(len(s))
        s[k : k + rng.choice((0, 1, 1))] = rng.choice(("", "x", "yz"))
    return "".join(s)


def test_hits_equal_brute_force(frame):
    rng = random.Random(2)
    items = [(k, sentence(rng, rng.randint(4, 40))) for k in range(12)] + [(12, "Short one"), (13, ""), (14, None), (15, "...")]
    items += [(16, items[0][1])]
    docs = []
    for k in range(120):
        text = sentence(rng, rng.randint(0, 60))
        if k % 2:
            item = items[rng.randrange(13)][1]
            text = text + "\n" + edited(rng, item, rng.randint(0, len(item) // 10 + 1)).upper() + ",\n" + sentence(rng, 20)
        docs.append((k, text))
    docs += [(200, None), (201, ""), (202, "short,  ONE"), (203, "z " * 50_000 + items[1][1]), (204, docs[1][1]), (None, items[2][1])]
    expected = {}
    for i, t in docs:
        for k, item in items:
            item = d.normalise(item)
            if item and (e := slow_edits(item, d.normalise(t)) if i != 203 or k in (1, 12) else 99) <= (len(item) // 16 if len(item) >= 32 else 0):
                expected[i, str(k)] = e
    docs_df, bench = frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")
    for block in (d.BLOCK_CHARS, 300):
        got = d.find_items(docs_df, bench, block_chars=block).collect()
        assert {(r.doc_id, r.item_id): r.edits for r in got} == expected and len(got) == len(expected)
    texts, norm = dict(docs), {str(k): d.normalise(t) for k, t in items}
    for r in got:
        assert 0 <= r.begin < r.stop <= len(texts[r.doc_id])
        assert slow_edits(norm[r.item_id], d.normalise(texts[r.doc_id][r.begin : r.stop])) <= r.edits
    kept = d.without_items(docs_df, bench, block_chars=300)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if not any(i == a for a, _ in expected))


def test_empty_tables(frame):
    docs, bench = frame([(1, "text of a document")], "doc_id long, text string"), frame([(1, "text of a document")], "item_id long, text string")
    assert d.find_items(docs, bench.where("false")).count() == 0
    assert d.find_items(docs.where("false"), bench).count() == 0
    assert d.without_items(docs, bench.where("false")).count() == 1


def test_equal_items_do_not_fill_a_block(frame):
    rng = random.Random(3)
    items = [(1, sentence(rng, 12))] * 200 + [(1, sentence(rng, 12))] * 2 + [(k, sentence(rng, 12)) for k in range(2, 8)]
    bench = frame(items, "item_id long, text string")
    blocks = list(d.item_blocks(bench, "item_id", "text", 200))
    assert sorted((int(i), text) for b in blocks for (i, _), text in b) == sorted(set(items)) and sum(n for b in blocks for (_, n), _ in b) == len(items)
    docs = frame([(5, items[0][1]), (6, items[201][1]), (7, items[-1][1])], "doc_id long, text string")
    got = [(r.doc_id, r.item_id) for r in d.find_items(docs, bench, block_chars=200).collect()]
    assert sorted(got) == [(5, "1")] * 200 + [(6, "1")] * 2 + [(7, "7")]
