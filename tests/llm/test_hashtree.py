import math
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from postloom.llm import hashtree
from postloom.llm.hashtree import Leaf


def spark_hash(key, level, node):
    h = 42
    if key is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=h)
    h = xxhash.xxh64_intdigest(level.encode(), seed=h)
    return xxhash.xxh64_intdigest(struct.pack("<i", node), seed=h)


def slow_place(key, leaves):
    among = leaves
    for level in ("region", "rack", "shard"):
        nodes = {getattr(leaf, level) for leaf in among}
        weight = {n: sum(leaf.weight for leaf in among if getattr(leaf, level) == n) for n in nodes}
        draw = {n: -math.log(((spark_hash(key, level, n) >> 12) + 0.5) / 2**52) / weight[n] for n in nodes}
        best = min(nodes, key=lambda n: (draw[n], n))
        among = [leaf for leaf in among if getattr(leaf, level) == best]
    return among[0].shard


def test_equals_brute_force(docs, monkeypatch):
    monkeypatch.setattr(hashtree, "CELLS", 16)
    rows = [(i, f"text é {i}") for i in range(400)] + [(5, "text é 5"), (5, "other"), (None, "x"), (None, None), (7, ""), (8, None)]
    rows += [(-3, "z" * 200_000)]
    got = hashtree.shard(docs(rows), hashtree.tree(8), hashtree.tree(9))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = got.collect()
    for r in found:
        assert r.law == "key" and r.shard == slow_place(r.doc_id, hashtree.tree(8))
        assert r.grown_shard == slow_place(r.doc_id, hashtree.tree(9))
        assert r.grown_shard in (r.shard, 8)
    facts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == facts
    for s in range(8):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))


def test_weights_move_rows_only_where_they_change(spark):
    before = [Leaf(0, 0, 0, 1), Leaf(0, 0, 1, 2), Leaf(0, 1, 2, 1), Leaf(1, 2, 3, 3), Leaf(1, 3, 4, 1)]
    # the two shards of a rack trade weight: nothing outside that rack may move
    after = [Leaf(0, 0, 0, 2), Leaf(0, 0, 1, 1), *before[2:]]
    ids = spark.range(20000)
    moved = ids.select(
        hashtree.place(F.col("id"), before).alias("a"), hashtree.place(F.col("id"), after).alias("b")
    ).collect()
    assert {(r.a, r.b) for r in moved if r.a != r.b} == {(1, 0)}
    share = Counter(r.a for r in moved)
    for leaf in before:
        assert abs(share[leaf.shard] / 20000 - leaf.weight / 8) < 0.02


def test_empty_table(docs):
    assert hashtree.shard(docs([]), hashtree.tree(8), None).collect() == []


def test_one_more_shard_takes_rows_only_into_itself_at_every_count(spark):
    ids = spark.range(20_000).select("id")
    counts = range(8, 16)
    placed = ids.select(*[hashtree.place(F.col("id"), hashtree.tree(n)).alias(f"s{n}") for n in counts]).collect()
    for n in list(counts)[:-1]:
        moved = [(r[f"s{n}"], r[f"s{n + 1}"]) for r in placed if r[f"s{n}"] != r[f"s{n + 1}"]]
        assert {b for _, b in moved} == {n}
        # from all others alike
        assert abs(len(moved) / len(placed) - 1 / (n + 1)) < 0.01 and len({a for a, _ in moved}) == n
