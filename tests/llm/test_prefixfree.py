import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from postloom.llm import prefixfree


def slow(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def run(frame, length):
    found = prefixfree.remove_repeats(frame, length).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found), key=str)


def words(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


@pytest.mark.parametrize(("length", "chunk"), [(400, 2048), (150, 2)])
def test_equals_brute_force(docs, monkeypatch, length, chunk):
    monkeypatch.setattr(prefixfree, "CHUNK", chunk)
    monkeypatch.setattr(prefixfree, "MOST_BITS", 1 << 15)
    rng = random.Random(length)
    stock = ["the", "of", "cat", "sät", "river", "日本", "and\n", "x1", "longerword"]
    shared = [words(rng, rng.randrange(length // 8, length), stock) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randrange(5, 120), stock)]
        for s in rng.sample(shared, rng.randrange(3)):
            cut = rng.randrange(len(s) // 4) if rng.random() < 0.5 else 0
            parts += [s[cut:], words(rng, rng.randrange(1, 60), stock)]
        rows.append((i, " ".join(parts)))
    for i in range(12):  # near copies: a character changed here and there
        t = list(rows[1][1])
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice("abcdé")
        rows.append((100 + i, "".join(t)))
    rows += [(200, None), (201, ""), (202, "short"), (203, "a" * 1500), (204, "ab" * 700), (205, "b" * (length - 1))]
    rows += [(206, "c" * length), (207, "c" * length), (208, "d" * (length + 1)), (209, "".join(chr(97 + i % 23) for i in range(1300)))]
    rows += [(210, rows[2][1]), (210, rows[3][1]), (2, rows[2][1]), (None, rows[4][1] + "z"), (None, "zz" + shared[0])]
    assert run(docs(rows), length) == slow(rows, length)


def test_every_start_is_in_one_context_that_its_string_decides(monkeypatch):
    rng = random.Random(2)
    text = words(rng, 900, ["alpha", "be", "gamma", "de"]).encode() + b"a" * 900 + bytes(rng.randrange(97, 123) for _ in range(2000))
    def contexts(*texts, at=0):
        raw, edges = prefixfree.bytes_of(pa.array(list(texts), pa.binary()))
        return [(c, s, n) for c, _, t, s, n in zip(*prefixfree.parse(raw, edges, 400), strict=True) if t == at]

    starts = sorted(s + k for _, s, n in contexts(text) for k in range(n))
    assert starts == list(range(len(text) - 399))
    where = {s + k: core for core, s, n in contexts(text) for k in range(n)}
    moved = b"other text before it" + text[300:1400] + b"and after"
    # other texts of the run make no difference
    there = {s + k: core for core, s, n in contexts(text[:500], b"short", moved, text, at=2) for k in range(n)}
    monkeypatch.setattr(prefixfree, "PART", 1024)
    prefixfree._tables.cache_clear()
    assert sorted(contexts(text)) == sorted((where[s], s, n) for _, s, n in contexts(text))
    prefixfree._tables.cache_clear()
    assert all(there[20 + i] == where[300 + i] for i in range(1100 - 399))


def test_bitmap_never_misses(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS k")
    known = prefixfree.bitmap(keys, "k")
    values = np.array([r.k for r in keys.collect()])
    assert known.holds(values).all()
    assert known.holds(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, size=5000)).mean() < 0.2


def test_empty_table(docs):
    assert prefixfree.remove_repeats(docs([])).collect() == []
