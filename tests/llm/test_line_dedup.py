import random

from tidemark.llm.line_dedup import dedup_lines


def slow(rows):
    """doc_id, text -> text without later occurrences of three-line windows."""
    distinct = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is not None, r))
    order = {}
    places = []
    for d, t in distinct:
        lines = t.split("\n")
        for at in range(len(lines) - 2):
            w = tuple(lines[at : at + 3])
            if "".join(w).strip(" "):
                places.append((d, t, at, w))
    covered = {}
    for d, t, at, w in places:
        if w in order:
            covered.setdefault((d, t), set()).update(range(at, at + 3))
        order.setdefault(w, (d, t, at))
    out = []
    for d, t in rows:
        gone = covered.get((d, t), set())
        out.append((d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), None if t is None else len(t.split("\n")), len(gone)))
    return out


def test_windows_equal_brute_force(frame):
    rng = random.Random(1)
    lines = [f"line {k}" for k in range(12)] + ["", "", "é ñ"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 30)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "a\nb"), (63, "a\nb"), (64, "\n\n\n\n"), (65, "\n\n\n\n"), (66, "x\n" * 20_000), (67, "u\nv\nw\nx\n"), (68, "p\nu\nv\nw\nx\n")]
    rows += [rows[3], rows[3], (70, rows[5][1])]
    docs = frame([(d, t, "c") for d, t in rows], "doc_id long, text string, n_lines string")
    key = lambda r: str(r)
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs).collect()]
    assert sorted(got, key=key) == sorted(slow(rows), key=key)


def test_null_ids_come_first_and_empty_tables_stay_empty(frame):
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc\nd")]
    got = {r.doc_id: r.text for r in dedup_lines(frame(rows, "doc_id long, text string")).collect()}
    assert got == {None: "a\nb\nc", 1: "d"}
    assert dedup_lines(frame(rows, "doc_id long, text string").where("false")).count() == 0


def test_no_python_in_the_plan(frame):
    text = dedup_lines(frame([(1, "a\nb\nc")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text


def test_passages_inside_lines_are_cut_by_sentences(frame):
    passage = "One of them came first. Then there was another! Was it the last one? It was not."
    rows = [(1, f"Before it.\n{passage}\nAfter it."), (2, f"Own words here. {passage} Other words follow."), (3, passage), (4, f"Own end. {passage}"), (5, "a.b c.d\n\n  x. y"), (6, None), (7, ""), (10, f"{passage}\n")]
    rows += [(8, "漢字一。漢字二！漢字三？漢字四。"), (9, "前文。漢字一。漢字二！漢字三？後文。")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(frame(rows, "doc_id long, text string"), sentences=True).collect()}
    assert got == {
        1: (rows[0][1], 6, 0), 2: ("Own words here. Other words follow.", 6, 4), 3: ("", 4, 4), 4: ("Own end.", 5, 4), 5: (rows[4][1], 4, 0), 6: (None, None, 0), 7: ("", 1, 0),
        10: ("", 5, 4), 8: ("漢字一。漢字二！漢字三？漢字四。", 4, 0), 9: ("前文。後文。", 5, 3),
    }
