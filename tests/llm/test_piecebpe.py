import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from postloom.llm import piecebpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return piecebpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def theirs(ranks):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_same_ids_as_the_vocabularys_library(ranks, theirs):
    rng = random.Random(3)
    codec = piecebpe.Codec(ranks, public_tokenizers.PATTERN)
    texts = ["", " ", "\n\n x", "it's  we'LL\t  done", "naïve Straße 漢字かな 😀👩‍👩‍👧 12345 1a2b", "a" * 5000]
    texts += ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x11000, 64)]
    texts += ["".join(rng.choice("abcé .,'ß\n\t\x1c\x1f\x85  X9!#") for _ in range(200)) for _ in range(300)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == theirs.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_pieces_alone_find_the_merges(ranks, theirs):
    codec = piecebpe.Codec(ranks, public_tokenizers.PATTERN)
    words = [" international", "Wissenschaft", " répétition", "ción", "ing" * 40]
    ids = codec.model.encode([piecebpe.as_characters(w.encode()) for w in words], out_type=int)
    assert [[codec.rank_of[i] for i in x] for x in ids] == [theirs.encode_ordinary(w) for w in words]


def test_rows(spark, docs, theirs, monkeypatch):
    monkeypatch.setattr(piecebpe, "ROWS", 2)
    rows = [(1, "Hello there, wörld"), (1, "Hello there, wörld"), (2, None), (3, ""), (None, "x"), ((1 << 60) + 1, "y z" * 40000)]
    got = queries.tokens(docs(rows), PATH, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    expected = []
    for i, t in rows:
        ids = theirs.encode_ordinary(t or "")
        text = ",".join(map(str, ids)).encode()
        expected.append((i, len(ids), hashlib.sha256(text).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert queries.tokens(docs([]), PATH, public_tokenizers.PATTERN).collect() == []
