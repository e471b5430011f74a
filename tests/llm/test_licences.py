import random

import zstandard

from tidemark.llm import licences as lic

FILL = [f"word{k}" for k in range(50)] + ["the", "of", "and"]


def slow_edits(template, words):
    """Fewest word edits of the template against any stretch, by trying every stretch."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    return min(distance(template, words[i:j]) for i in range(len(words) + 1) for j in range(i, len(words) + 1))


def test_word_differences_equal_brute_force():
    rng = random.Random(1)
    for _ in range(120):
        template = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 9))]
        edits, begin, end, changed = lic.differences(template, words)
        assert edits == len(changed) == slow_edits(template, words) and 0 <= begin <= end <= len(words)


def test_savings_are_those_of_raw_dictionaries():
    block = "Released under the MIT License."
    known = lic.templates()
    saved = lic.savings(block)
    alone = len(zstandard.ZstdCompressor(level=9, write_content_size=False).compress(block.lower().encode()))
    for t, s in zip(known[:4], saved):
        d = zstandard.ZstdCompressionDict(t.text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        assert s == alone - len(zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_dict_id=False).compress(block.lower().encode()))
    assert saved.index(max(saved)) == 0


def planted():
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(200):
        lines = [" ".join(rng.choice(FILL) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 5))]
        for _ in range(rng.randint(0, 2)):
            name, _, text = rng.choice(lic.TEMPLATES)
            lines.insert(rng.randint(0, len(lines)), rng.choice((str, str.upper, str.lower))(text).rstrip(".") + ".")
            want.setdefault(k, []).append(name)
        rows.append((k, "\n".join(lines)))
    return rows, want


def test_planted_wordings_are_found_and_nothing_else(frame):
    rows, want = planted()
    odd = [(500, None), (501, ""), (502, "the license office gave no permission for copyright"), (503, "x " * 100_000 + "Released under the MIT License."), (504, "Licensed under the Foo License."), (505, "released under the terms of the mit license"), rows[0]]
    got = {}
    for r in lic.find_licences(frame(rows + odd, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = dict(rows + odd)
    want = {k: sorted(v) for k, v in want.items()} | {503: ["MIT"], 505: ["MIT"]}
    if 0 in want:
        want[0] = sorted(want[0] * 2)
    assert {k: sorted(r.licence for r in v) for k, v in got.items()} == want
    for k, v in got.items():
        for r in v:
            words = lic.words_of(texts[k][r.begin : r.stop])
            assert r.saving >= lic.LEAST_SAVING and r.differences == min(slow_or_same(t, words) for t in lic.templates() if t.licence == r.licence)


def slow_or_same(template, words):
    return lic.differences(template.words, words)[0]


def test_ranking_loses_no_exact_wording():
    for name, _, text in lic.TEMPLATES:
        (hit,) = lic.scan("first line\n" + text + "\nlast line")
        assert (hit[0], hit[3]) == (name, 0)
        words = text.split()
        if len(words) > 20:
            del words[-5], words[-2]
            (hit,) = lic.scan("first line\n" + " ".join(words) + "\nlast line")
            assert hit[0] == name and hit[3] <= 2


def test_letters_that_change_length_keep_positions(frame):
    text = "İİİ ß\nReleased under the MIT License."
    (hit,) = lic.scan(text)
    assert text[hit[1] : hit[2]] == "Released under the MIT License"
    assert lic.find_licences(frame([(1, text)], "doc_id long, text string").where("false")).count() == 0


def wrapped(text, width, prefix):
    lines = [""]
    for w in text.split():
        if lines[-1] and len(lines[-1]) + 1 + len(w) > width:
            lines.append("")
        lines[-1] += (" " if lines[-1] else "") + w
    return "\n".join(prefix + x for x in lines)


def test_hard_wrapped_notices_are_found_whole():
    for name, _, text in lic.TEMPLATES:
        for prefix in ("", "# ", " * ", "// ", " " * 40, "-- ", "> "):
            for width in (15, 40, 72):
                notice = wrapped(text, width, prefix)
                hits = lic.scan(f"{prefix}first line\n{notice}\n{prefix}last line")
                assert [(h[0], h[3]) for h in hits] == [(name, 0)], (name, prefix, width, hits)
