import random
import re
from collections import Counter

import numpy as np
import pytest

from postloom.llm import collocations

COLUMNS = "doc_id long, text string, lang string, key string, a long, word string, n int"


def slow(rows, least=30, keep=2000, share=80):
    """Every phrase counted one by one."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        held = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for k in range(1, 5):
                held.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                gone |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= share * found[p[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p in gone:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:keep], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -s))
    return sorted(out)


def corpus(seed=3, texts=300):
    rng = random.Random(seed)
    stock = ["the", "The", "of", "a", "été", "ÉTÉ", "x\xa0y", "new", "york", "city", "#1", "über"] + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(texts):
        body = []
        for _ in range(rng.randrange(3, 40)):
            body.append(rng.choice(["New York City", "in the end of", "a b a b a", rng.choice(stock), rng.choice(stock)]))
            body.append(rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]))
        rows.append(("".join(body), [None, "en", "de", "en"][i % 4]))
    passage = "this very common passage stands in a third of all the texts"
    rows += [(passage, "en")] * (texts // 2)
    return rows + [(None, "en"), ("", "fr"), (" .,; ", None), ("the " * 5000, "de"), ("x" * 3000, "en")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "k", 1, "w", 2) for i, (t, g) in enumerate(rows)], COLUMNS)


@pytest.mark.parametrize(("common", "bucket"), [(1024, 1 << 20), (10, 500), (2, 100)])
def test_equals_brute_force(spark, monkeypatch, common, bucket):
    monkeypatch.setattr(collocations, "SMALL", 16)
    rows = corpus()
    found = collocations.collocations(frame(spark, rows).repartition(5), common=common, bucket=bucket)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == slow(rows)


def test_keep_and_share(spark):
    rows = corpus(5)
    found = collocations.collocations(frame(spark, rows), least=10, keep=7, share=50)
    assert sorted(map(tuple, found.collect())) == slow(rows, 10, 7, 50)


def test_empty(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(None, None), ("", "en")])).collect() == []


def test_words_cross_pieces_of_hashing(monkeypatch):
    data = ("one two  three. " * 50 + "y" * 400 + " end").encode()
    whole = collocations.words(data, "en")
    monkeypatch.setattr(collocations, "PIECE", 16)
    small = collocations.words(data, "en")
    assert all((a == b).all() for a, b in zip(whole, small, strict=True))
    assert len(whole[0]) == 152 and (whole[0] != collocations.words(data, "fr")[0]).all()


def test_quicksort_equals_counting(monkeypatch):
    monkeypatch.setattr(collocations, "SMALL", 8)
    rng = np.random.default_rng(2)
    rows = rng.integers(1, 4, (2000, 4)).astype(np.uint64)
    rows[rng.random(2000) < 0.2, 3] = 0
    rows[rng.random(2000) < 0.1, 2:] = 0
    times = rng.integers(1, 4, 2000)
    counts = Counter()
    for row, n in zip(rows.tolist(), times.tolist(), strict=True):
        for k in range(2, 5):
            if row[k - 1]:
                counts[tuple(row[:k])] += n
    at, size, count = collocations.frequent(list(rows.T.copy()), times, {2: 400, 3: 100, 4: 30})
    found = {tuple(rows[i, :k].tolist()): c for i, k, c in zip(at, size, count, strict=True)}
    assert found == {p: n for p, n in counts.items() if n >= {2: 400, 3: 100, 4: 30}[len(p)]} and len(found) == len(at)


def test_clash_draws_another_hash(spark, monkeypatch):
    real = collocations.words
    monkeypatch.setattr(collocations, "_vocabulary", _clashing(collocations._vocabulary))
    rows = [("a b " * 40, "en")]
    found = collocations.collocations(frame(spark, rows))
    assert sorted(map(tuple, found.collect())) == slow(rows)
    assert real is collocations.words


def _clashing(real):
    def run(docs, seed):
        from pyspark.sql import functions as F

        out = real(docs, seed)
        return out.withColumn("id", F.lit(1).cast("long")) if seed == 0 else out

    return run
