import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
import numpy as np  # noqa: E402
import public_tokenizers as P  # noqa: E402

from tidemark.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
ALPHABET = "ab c'\n\té漢😀12!s  t"


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})


def words(rng, n, alphabet=ALPHABET):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_every_token_encodes_as_itself(ranks):
    assert all(ranks.merged(token) == [i] for token, i in ranks.ids.items())


def test_side_by_side_is_plain_merging(ranks):
    rng = random.Random(1)
    ids = [ranks.ids[t] for t in (b"a", b"aa", b"aaaa", b" a", b"the", b" the", b"er", b"e")] + [rng.randrange(50_000) for _ in range(150)]
    for a in ids:
        for b in ids:
            assert ranks.side_by_side(a, b) == (ranks.merged(ranks.tokens[a] + ranks.tokens[b]) == [a, b])


def test_appends_and_edits_equal_a_fresh_encoding(ranks, known):
    rng = random.Random(2)
    for _ in range(150):
        text = bpe.Encoded(ranks, P.PATTERN, words(rng, rng.randint(0, 60)))
        assert text.ids() == known.encode_ordinary(text.text)
        for _ in range(4):
            a = rng.randint(0, len(text.text))
            text.replace(a, rng.randint(a, len(text.text)), words(rng, rng.randint(0, 6)))
            assert text.ids() == known.encode_ordinary(text.text)
        text.append("x y'")
        text.append("re")
        assert text.ids() == known.encode_ordinary(text.text)


def test_prefix_table_edits(ranks):
    rng = random.Random(3)
    for _ in range(150):
        piece = bytearray(words(rng, rng.randint(0, 40)).encode())
        table = bpe.PrefixTable(ranks, bytes(piece))
        a = rng.randint(0, len(piece))
        b = rng.randint(a, len(piece))
        piece[a:b] = b"the"
        table.replace(a, b, b"the")
        assert table.ids() == ranks.merged(bytes(piece))


def test_documents_round_trip(frame, known):
    long = "A" * 50_000 + " " * 3_000 + "漢字" * 2_000
    texts = [None, "", " ", long, "the cat\n\n sat", "the cat\n\n sat", "<|endoftext|>", "it's 'RE'"]
    docs = frame([(k, t, "old", 7) for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    rows = {r.doc_id: r for r in bpe.round_trip(docs, PATH, P.PATTERN).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        assert np.frombuffer(rows[k].ids, "<u4").tolist() == known.encode_ordinary(t or "")
        assert bytes(rows[k].decoded) == (t or "").encode() and rows[k].n_tokens == len(rows[k].ids) // 4
    two = bpe.decode_documents(bpe.encode_documents(docs, PATH, P.PATTERN), PATH)
    assert {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in two.collect()} == {k: (bytes(r.ids), bytes(r.decoded)) for k, r in rows.items()}
    assert bpe.round_trip(docs.where("false"), PATH, P.PATTERN).collect() == []


def test_query_equals_the_library(spark, documents, known):
    from tidemark.llm.queries import op4_bpe

    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in op4_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = np.array(known.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
