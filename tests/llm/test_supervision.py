import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import supervision


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed)


def texts():
    rng = random.Random(1)
    words = ["the", "cat", "sät", "on", "ä", "mat.", "日本語", "#tag", "A|B", "x>y"]
    out = [None, "", " \n\t\x0b", "a", "a\n\na\n a", "one two " * 40, "\x1fodd\x85blank\xa0here " * 9, "é" * 100_000]
    for _ in range(60):
        line = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 12))]
        out.append("\n".join(rng.choice(line) for _ in range(rng.randrange(1, 20))))
    out.append(" ".join(str(i) for i in range(60_000)))
    return out


def test_counts_equal_brute_force(docs):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b"), (3, "a"), (3, "a")]
    got = supervision.label(docs(rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    expected = [(i, *slow(t)) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_colliding_windows_are_told_apart(monkeypatch):
    ids = np.arange(40, dtype=np.int64)
    assert supervision.repeat_words(ids) == 0
    assert supervision.repeat_words(np.concatenate((ids[:9], ids))) == 18


def test_estimation_finds_reliable_rules():
    rng = random.Random(2)
    accuracy = [0.95, 0.9, 0.8, 0.6]
    patterns, truth = Counter(), {}
    for _ in range(20000):
        good = rng.random() < 0.7
        votes = tuple(
            0 if rng.random() < 0.2 else (1 if good else -1) * (1 if rng.random() < a else -1) for a in accuracy
        )
        patterns[votes] += 1
        truth.setdefault(votes, Counter())[good] += 1
    model = supervision.estimate(patterns, 4)
    gains = [v[2] - v[0] for v in model.votes]
    assert gains == sorted(gains, reverse=True)
    right = sum(
        n for votes, seen in truth.items() for good, n in seen.items()
        if good == (model.prior + sum(m[v + 1] for v, m in zip(votes, model.votes, strict=True)) > 0)
    )
    assert right / 20000 > 0.93


@pytest.mark.parametrize("size", ["sf0.01"])
def test_labels_held_out(spark, size):
    folder = f"/root/testdata/{size}"
    judged = supervision.label(spark.read.parquet(f"{folder}/documents.parquet")).drop("quality")
    # texts whose base holds: the method alone decides
    seen = judged.where("NOT base_failed").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = {(r.quality, r.kept): r.n for r in seen.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert rows.get((1, False), 0) <= 0.01 * rows[(1, True)]
    assert rows.get((0, True), 0) <= 0.1 * rows[(0, False)]


def test_keep_good_judges_rows(docs):
    prose = "The quick brown fox jumps over the lazy dog near the old river bank, and then some more. " * 1
    many = [(i, f"{prose} {i} " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(120)) + ".") for i in range(80)]
    junk = [(1, "|" * 5 + " %%%" * 100), (None, None), (2, "")]
    kept = supervision.keep_good(docs(many + junk))
    assert kept.columns == docs([]).columns
    assert sorted(r.text for r in kept.collect()) == sorted(t for _, t in many)
    assert supervision.keep_good(docs([])).collect() == []
    assert supervision.label(docs([])).collect() == []
