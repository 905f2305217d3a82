import itertools
import math

import numpy as np
import pytest

from postloom.llm import capfilters

KIND = "vec_id long, embedding array<float>, label int, cap int, part string"


def slow(rows, threshold=0.93):
    def good(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [good(v, label) for _, v, label in rows]
    links, group = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    wide = [np.array(v, dtype=np.float32).astype(float) if g else None for (_, v, _), g in zip(rows, ok, strict=True)]
    wide = [None if v is None else v / np.abs(v).max() for v in wide]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(wide[i]) == len(wide[j]):
            a, b = wide[i], wide[j]
            if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                group[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(
        ((d, links[i], least.get(root(i)), d == least.get(root(i))) for i, (d, _, _) in enumerate(rows)), key=str
    )


def run(spark, rows):
    frame = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], KIND)
    return sorted(map(tuple, capfilters.near_duplicates(frame).collect()), key=str)


def clusters(seed, sizes, noise=0.25, dims=64):
    rng = np.random.default_rng(seed)
    out = []
    for k in sizes:
        centre = rng.normal(size=dims)
        for _ in range(k):
            out.append((centre + noise * rng.normal(size=dims) * rng.random()).astype(np.float32).tolist())
    return out


@pytest.mark.parametrize("chunk", [1024, 8])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(capfilters, "CHUNK", chunk)
    vectors = clusters(4, [40, 9, 5, 3, 2] + [1] * 30)
    rows = [(1000 + i, v, i % 2) for i, v in enumerate(vectors)]
    rows += [(i, vectors[0], 0) for i in range(5)] + [(7, vectors[0], 1), (8, vectors[3], None)]
    zero = [0.0] * 64
    rows += [(50, None, 0), (51, [], 0), (52, zero, 0), (53, zero, 0), (54, [None, *zero[1:]], 0)]
    rows += [(55, [float("nan"), *vectors[1][1:]], 0), (56, [float("inf"), *zero[1:]], 0)]
    rows += [(57, [x * 1e-30 for x in vectors[0]], 0), (58, [x * 1e30 for x in vectors[0]], 0)]
    rows += [(59, [1.0, 2.0], 0), (60, [1.0, 2.1], 0), (61, [3.0], 0), (62, [5.0], 0), (63, [-5.0], 0), (None, vectors[2], 0)]
    assert run(spark, rows) == slow(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * z
    meet = [bool(set(x) & set(y)) for x, y in zip(capfilters.list_decode(a), capfilters.list_decode(b), strict=True)]
    assert np.mean(meet) > 0.995


def test_list_decoding_finds_every_direction_above_the_height():
    rng = np.random.default_rng(1)
    v = capfilters.unit(rng.normal(size=(5, 12)))
    got = capfilters.list_decode(v)
    for row, caps in zip(v, got, strict=True):
        expected = []
        for r in range(capfilters.ROTATIONS):
            a, b, c = (row @ w for w in capfilters._codes(12, r))
            total = a[:, None, None] + b[None, :, None] + c[None, None, :]
            hit = np.flatnonzero(total.ravel() >= total.max() - capfilters.MARGIN / math.sqrt(12) - 1e-12)
            expected += (r * capfilters.CODEWORDS**3 + hit).tolist()
        assert sorted(expected) == caps.tolist()


def test_empty_table(spark):
    assert run(spark, []) == []
