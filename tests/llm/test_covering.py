import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from postloom.llm import covering


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow(rows, radius=3):
    prints = [slow_print(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(
        ((d, f"{p:016x}", least.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str
    )


def test_masks_cover_every_difference_within_the_radius():
    masks = covering.masks(3)
    assert len(masks) == 15
    for k in range(4):
        for bits in itertools.combinations(range(64), k):
            diff = sum(1 << b for b in bits)
            assert any(not diff & m for m in masks)


def test_equals_brute_force(docs, monkeypatch):
    monkeypatch.setattr(covering, "CHUNK", 8)
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    base = [[rng.choice(words) for _ in range(rng.choice([40, 120]))] for _ in range(8)]
    texts = []
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    texts += [None, "", " \n\t", "one", "one two", "ONE two", "a\x0bb\x0cc d", "x y z w", base[0][0] * 9, texts[0]]
    texts += [" ".join(rng.choice(words) for _ in range(30000))]
    rows = list(enumerate(texts, start=100)) + [(None, "no id"), (None, texts[0]), (100, texts[0])]
    rng.shuffle(rows)
    got = covering.near_duplicates(docs(rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow(rows)


def test_empty_table(docs):
    assert covering.near_duplicates(docs([])).collect() == []


def test_keeps_one_of_each_group(docs):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "other words stand here now"), (None, "a b c d e f")]
    rows += [(None, "nobody knows this text at all"), (7, None), (6, ""), (3, "a second text of id three, unlike all")]
    kept = covering.keep_one(docs(rows))
    assert kept.columns == docs([]).columns
    expected = [(3, rows[1][1]), (3, rows[-1][1]), (6, ""), (9, rows[3][1]), (None, rows[5][1])]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(expected, key=str)


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_keeps_one_of_near_copies_that_differ_in_many_bits(docs):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    rows, far = [], 0
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([60, 150, 400]))]
        rows.append((10 * g, " ".join(base)))
        for k in (1, 2):
            w, edits = list(base), max(1, len(base) // rng.choice([60, 90, 200]))
            for at in rng.sample(range(len(w)), edits):
                w[at] = "changed"
            rows.append((10 * g + k, " ".join(w)))
        far += sum((covering.fingerprint(rows[-3][1]) ^ covering.fingerprint(t)).bit_count() > 3 for _, t in rows[-2:])
    rows.append((999, " ".join(rows[0][1].upper().split()[:30])))
    assert far > 10
    group = {i: i for i, _ in rows}

    def root(i):
        return i if group[i] == i else root(group[i])

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        x, y = grams(a), grams(b)
        if len(x & y) >= 0.8 * len(x | y):
            group[max(root(i), root(j))] = min(root(i), root(j))
    kept = {r.doc_id for r in covering.keep_one(docs(rows)).collect()}
    assert kept == {i for i in group if root(i) == i}


def test_near_copies_are_found_by_the_covering_tables(docs, monkeypatch):
    """With tables that hide no difference, pairs that differ in many bits stay apart: nothing beside the tables finds them."""
    rng = random.Random(3)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(60)]
        rows.append((2 * g, " ".join(base)))
        base[30] = "changed"
        rows.append((2 * g + 1, " ".join(base)))
    assert sorted(r.doc_id for r in covering.keep_one(docs(rows)).collect()) == list(range(0, 60, 2))
    monkeypatch.setattr(covering, "masks", lambda radius, bits=64: [(1 << bits) - 1])
    assert covering.keep_one(docs(rows)).count() > 30


@pytest.mark.parametrize(("common", "one", "two"), [(4, 0, 1), (8, 1, 1), (12, 0, 3), (32, 4, 4), (400, 50, 50), (400, 0, 100)])
@pytest.mark.parametrize("rows", [100, 250_000])
def test_pairs_at_the_threshold_meet_in_a_table(rows, common, one, two):
    parts, bits = covering.tune(rows, 0.8, 0.999, 3)
    masks = np.array(covering.masks(3, bits), dtype=np.uint64)
    rng = np.random.default_rng(common + two)
    met = 0
    for _ in range(400):
        hashes = rng.integers(0, 1 << 64, size=common + one + two, dtype=np.uint64)
        a, near_a = covering.wide(hashes[: common + one], parts, bits, 0.8)
        b, near_b = covering.wide(np.concatenate([hashes[:common], hashes[common + one :]]), parts, bits, 0.8)
        met += bool(((a ^ b).view(np.uint64)[:, None] & masks == 0).any())
        assert np.bitwise_count((near_a ^ near_b).view(np.uint64)).sum() <= covering.far(0.8)
    assert met >= 397


def test_sets_that_can_link_with_none_but_their_equals():
    hashes = np.array([5, 7, 9], dtype=np.uint64)
    one, two = (covering.wide(h, 16, 32, 0.8)[1] for h in (hashes, hashes[:2]))
    assert np.bitwise_count((one ^ two).view(np.uint64)).sum() > covering.far(0.8)
    assert covering.wide(hashes, 16, 32, 0.8)[1].tolist() == one.tolist()


def test_rows_beside_a_stranger_are_kept():
    close, other = 0b1011, -1
    rows = pd.DataFrame(
        [(1, 0, 0, 10, 1, close), (1, 0, 0, 11, 1, close), (2, 0, 0, 10, 1, close), (2, 0, 0, 12, 2, 0), (2, 0, 0, 13, 3, other), (3, 0, 0, 14, 4, 0), (3, 0, 0, 15, 5, other)],
        columns=["bucket", "cell_a", "cell_b", "cid", "root", "near1"],
    ).assign(near2=lambda f: f["near1"] // 2)
    found = covering._strangers(40)(rows)
    assert list(zip(found["bucket"], found["cid"], strict=True)) == [(2, 10), (2, 12)]
