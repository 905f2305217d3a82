"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint of its word shingles. Masks are built from a linear map (Pagh,
2016): bit i carries a vector of r + 1 bits, and the mask of a vector v keeps the bits whose vectors
have an odd product with v. Up to r differing bits span at most r dimensions, so some v is orthogonal
to all of them and its mask hides every difference: each pair within the radius collides in a table,
without chance.

Texts that share four fifths of their shingles differ in some 15 % of the bits. ``keep_one`` therefore takes a wide
fingerprint in parts and searches each part by such masks: two texts meet where a part of theirs lies within the
radius (or where a mask hides all of more differences), and there are as many parts as a wanted recall asks for.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import paragraphs
from postloom.llm.groups import by_run, cells, changes, components, forest
from postloom.llm.prefixfree import bitmap
from postloom.session import cut_lineage

SEED = 42
CHUNK = 2048
#: Distinct texts that are compared by their shingles in one piece.
DOCUMENTS = 256
#: Parts of wide fingerprints that are searched at a time, which bounds what is shuffled at once.
PARTS = 4
#: Bits that tell apart what shares a bucket by chance.
CLOSE = 128
#: Shingles whose votes are counted at a time, such that a byte holds the count.
VOTERS = 127


def masks(radius: int, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks that cover all pairs within the radius."""
    vectors = [1 + i % ((1 << radius + 1) - 1) for i in range(bits)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        for v in range(1, 1 << radius + 1)
    ]


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text; zero for a text without words, or null."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text) and ``bits`` (the fingerprint as a signed long) of every row."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
        return pd.Series(found.view(np.int64))

    key = F.xxhash64("text").alias("text_key")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), key, of("text").alias("bits"))


def _links(radius: int):
    def work(run: pd.DataFrame) -> pd.DataFrame | None:
        bits = np.unique(run["bits"].to_numpy())
        wide = bits.view(np.uint64)
        heads, tails = forest(len(bits), lambda i, rest: np.bitwise_count(wide[rest] ^ wide[i]) <= radius)
        return pd.DataFrame({"a": bits[heads], "b": bits[tails]}) if len(heads) else None

    return work


def near_fingerprints(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links (``a``, ``b``) among distinct fingerprints ``bits`` that connect all pairs within the radius."""
    tables = F.explode(
        F.array(
            *[
                F.struct(F.lit(t).alias("table"), F.col("bits").bitwiseAND(F.lit(_signed(m))).alias("kept"))
                for t, m in enumerate(masks(radius))
            ]
        )
    )
    # a hash of table and kept bits is the bucket; two that fall together are only held against each other
    rows = distinct.select("bits", tables.alias("t")).select(F.xxhash64("t.table", "t.kept").alias("bucket"), "bits")
    dealt = cells(rows, ["bucket"], F.col("bits"), CHUNK)
    return by_run(dealt, ["bucket", "cell_a", "cell_b"], _links(radius), "a long, b long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _grouped(docs: DataFrame, radius: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and for each distinct one its ``root`` and ``component_id``."""
    prints = cut_lineage(fingerprints(docs, width), "prints")
    first = prints.groupBy("bits").agg(F.min("doc_id").alias("first_id"))
    roots = components(near_fingerprints(first.select("bits"), radius))
    nodes = first.join(roots.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "first_id", F.coalesce("root", "bits").alias("root")
    )
    nodes = cut_lineage(nodes, "nodes")
    named = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints, nodes.join(named, "root").select("bits", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest ``doc_id`` that links of at most ``radius`` differing bits reach.
    Texts that are null, empty or without words have fingerprint zero and link like any other. Equal
    texts are one node of the graph; repeated rows stay repeated. A null ``doc_id`` keeps its row and is
    never the smallest. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    prints, nodes = _grouped(docs, radius, width)
    return prints.join(nodes, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def meeting(differ: float, bits: int, radius: int) -> float:
    """Chance that some mask hides every difference of two fingerprints whose bits differ with chance ``differ``.

    The differing bits' vectors span a space, here the set of its vectors as a bitmap; all but the whole space is
    orthogonal to some mask's vector.
    """
    size = 1 << radius + 1
    spans = {1: 1.0}
    for i in range(bits):
        vector, after = 1 + i % (size - 1), {}
        for span, chance in spans.items():
            wider = span | sum(1 << (x ^ vector) for x in range(size) if span >> x & 1)
            after[span] = after.get(span, 0.0) + chance * (1 - differ)
            after[wider] = after.get(wider, 0.0) + chance * differ
        spans = after
    return 1 - spans.get((1 << size) - 1, 0.0)


def differing(threshold: float) -> float:
    """Chance that a bit differs in the wide fingerprints of two sets of Jaccard ``threshold``: the angle between them."""
    return math.acos(2 * threshold / (1 + threshold)) / math.pi


@lru_cache(maxsize=16)
def tune(rows: int, threshold: float, recall: float, radius: int) -> tuple[int, int]:
    """Parts of a wide fingerprint and bits of a part, for a recall at the threshold.

    A mask keeps half of a part's bits or a little more: three bits more than it takes to number the rows, so that few
    rows share a bucket by chance, however many there are.
    """
    kept = max(1, rows - 1).bit_length() + 3
    bits = min(64, math.ceil(kept * ((2 << radius) - 1) / (1 << radius)))
    parts = math.ceil(math.log(1 - recall) / math.log(1 - meeting(differing(threshold), bits, radius)))
    return max(parts, math.ceil(CLOSE / bits)), bits


@lru_cache(maxsize=16)
def far(threshold: float) -> int:
    """Of ``CLOSE`` bits as many as differ once in a million pairs at the threshold: more tell a pair apart unseen."""
    p, tail = differing(threshold), 0.0
    for k in range(CLOSE, 0, -1):
        tail += math.comb(CLOSE, k) * p**k * (1 - p) ** (CLOSE - k)
        if tail > 1e-6:
            return k
    return 0


def _hashed(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` further 64-bit hashes of each hash (splitmix64)."""
    z = hashes[:, None] + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def wide(hashes: np.ndarray, parts: int, bits: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """A SimHash of distinct shingle hashes: its parts, and ``CLOSE`` of its bits, as signed longs.

    Every shingle votes twice on a bit: with one vote small sets would differ in more bits than the angle says. Sets so
    small that one shingle more or less takes a pair below the threshold meet their equals only, and have one vote by a
    hash of all, as ties are many in them.
    """
    votes, size = 2, -(-bits // 8)
    if len(hashes) < threshold * (len(hashes) + 1):
        votes, hashes = 1, np.array([xxhash.xxh64_intdigest(hashes.tobytes(), SEED)], dtype=np.uint64)
    ones = np.zeros((parts, 8 * size), dtype=np.int64)
    for at in range(0, len(hashes), VOTERS):
        cast = _hashed(hashes[at : at + VOTERS], votes * parts).view(np.uint8).reshape(-1, parts, 8)[..., :size]
        ones += np.unpackbits(cast, axis=2, bitorder="little").sum(axis=0, dtype=np.uint8)
    flags = 2 * ones > votes * len(hashes)
    packed = np.zeros((parts, 8), dtype=np.uint8)
    packed[:, :size] = np.packbits(flags[:, :bits], axis=1, bitorder="little")
    return packed.view(np.int64).ravel(), np.packbits(flags[:, :bits].ravel()[:CLOSE]).view(np.int64)


def _sketches(docs: DataFrame, width: int, threshold: float, parts: int, bits: int) -> DataFrame:
    """``doc_id``, ``text_key``, the identity (``p1``, ``p2``) of the lower-case words, and the wide fingerprint of every row."""

    @F.pandas_udf("p1 long, p2 long, near1 long, near2 long, parts array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = []
        for text in texts:
            words = _words(text)
            own, close = wide(paragraphs.shingles(words, width), parts, bits, threshold)
            found.append((*paragraphs.identity(words), *close.tolist(), own))
        return pd.DataFrame(found, columns=["p1", "p2", "near1", "near2", "parts"])

    key = F.xxhash64("text").alias("text_key")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), key, of("text").alias("s")).select("doc_id", "text_key", "s.*")


def _dealt(nodes: DataFrame, parts: range, bits: int, radius: int) -> DataFrame:
    """Nodes (``cid``, ``root``, ``near1``, ``near2``) in the cells of the buckets that the covering tables of some parts give."""
    kept = masks(radius, bits)
    # a hash of table and kept bits is the bucket
    keys = [
        F.xxhash64(F.lit(t * len(kept) + m), F.get("parts", F.lit(t)).bitwiseAND(F.lit(_signed(mask))))
        for t in parts
        for m, mask in enumerate(kept)
    ]
    keyed = nodes.select("cid", "root", "near1", "near2", F.array(*keys).alias("buckets"))
    again, may = paragraphs._recur(keyed.select(F.explode("buckets").alias("bucket")), "bucket")
    marked = keyed.withColumn("may", may("buckets"))
    met = F.explode(F.filter("buckets", lambda _, k: F.get("may", k))).alias("bucket")
    rows = marked.select("cid", "root", "near1", "near2", met)
    return cells(rows, ["bucket"], F.col("cid"), CHUNK, again.withColumnRenamed("n", "_n"))


def _apart(rows: pd.DataFrame, i, j) -> np.ndarray:
    """Differing ones of the ``CLOSE`` bits."""
    one, two = (rows[c].to_numpy().view(np.uint64) for c in ("near1", "near2"))
    return np.bitwise_count(one[i] ^ one[j]).astype(np.int64) + np.bitwise_count(two[i] ^ two[j])


def _forest(most: int):
    """Links of a run that connect all pairs which may reach the threshold."""

    def work(run: pd.DataFrame) -> pd.DataFrame | None:
        ids = run["cid"].to_numpy()
        heads, tails = forest(len(ids), lambda i, rest: _apart(run, i, rest) <= most)
        return pd.DataFrame({"a": ids[heads], "b": ids[tails]}) if len(heads) else None

    return work


def _strangers(most: int):
    """Rows of many runs that share theirs with one that may reach the threshold and is not of their component yet."""

    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        run = np.concatenate(([0], np.cumsum(changes(rows, ["bucket", "cell_a", "cell_b"]))))
        left = np.bincount(run).cumsum()[run] - np.arange(len(rows))
        root, hit = rows["root"].to_numpy(), np.zeros(len(rows), dtype=bool)
        at, step = np.flatnonzero(left > 1), 1
        while len(at):
            new = at[root[at] != root[at + step]]
            new = new[_apart(rows, new, new + step) <= most]
            hit[new] = hit[new + step] = True
            step += 1
            at = at[left[at] > step]
        return rows.loc[hit, ["bucket", "cell_a", "cell_b", "cid"]] if hit.any() else None

    return work


def keep_one(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999, radius: int = 3
) -> DataFrame:
    """One document of each group of near copies, with all its columns: the one of smallest ``doc_id``.

    A group is what links of Jaccard ``threshold`` or more reach, on the sets of ``width``-word shingles of the
    lower-case words; each link is verified. Pairs are held against each other that meet in a covering table of
    ``radius`` over a part of their wide fingerprints; there are as many parts as find a pair at the threshold with
    ``recall``. Texts without words, null ones among them, are one group. Rows without an id come last; of rows
    repeated whole one stays. Columns of any name are carried. An empty table gives no rows.
    """
    parts, bits = tune(docs.count(), threshold, recall, radius)
    seen = cut_lineage(_sketches(docs, width, threshold, parts, bits), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    sketch = [F.first(c).alias(c) for c in ("near1", "near2", "parts")]
    classes = seen.groupBy("p1", "p2").agg(F.min(order).alias("first"), *sketch)
    nodes = cut_lineage(classes.drop("p1", "p2").withColumn("cid", F.monotonically_increasing_id()), "classes")

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([paragraphs.shingles(_words(t), width).view(np.int64) for t in texts])

    def shingled(met: DataFrame) -> DataFrame:
        wanted = nodes.join(met, "cid", "left_semi").select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"), "cid")
        wanted = cut_lineage(wanted, "wanted")
        held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "_key"))

        @F.pandas_udf("boolean")
        def may(keys: pd.Series) -> pd.Series:
            return pd.Series(held.value.holds(keys.to_numpy()))

        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
        texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
        # few texts meet another, so the others stay where they lie
        texts = texts.where(may("key")).join(wanted, same)
        return texts.select("cid", "text").dropDuplicates(["cid"]).select("cid", shingles("text").alias("shingles"))

    def links(banded: DataFrame) -> DataFrame:
        # shingles of whole texts are long, so cells are smaller than those of paragraphs
        return paragraphs.linked(cut_lineage(banded, "banded"), shingled, threshold, DOCUMENTS)

    # one part finds the large groups, by links that connect what may be alike; these are verified
    run, most = ["bucket", "cell_a", "cell_b"], far(threshold)
    first = _dealt(nodes.withColumn("root", F.col("cid")), range(1), bits, radius)
    pairs = by_run(first, run, _forest(most), "a long, b long").distinct()
    roots = components(links(pairs.select(F.xxhash64("a", "b").alias("bucket"), F.explode(F.array("a", "b")).alias("cid"))))
    # then all parts find what a group has with another, so that members of one are not compared again
    known = cut_lineage(nodes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")), "known")
    rounds = [
        by_run(_dealt(known, range(a, min(parts, a + PARTS)), bits, radius), run, _strangers(most), "bucket long, cell_a int, cell_b int, cid long", many=True)
        for a in range(0, parts, PARTS)
    ]
    met = [cut_lineage(r, "met").select(F.xxhash64(*run).alias("bucket"), "cid") for r in rounds]
    more = links(reduce(DataFrame.unionAll, met))
    roots = components(more.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    known = nodes.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    kept = known.groupBy(F.coalesce("root", "cid").alias("root")).agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    # rows are carried whole, so that no column of theirs meets a name used here
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("key"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "key"]).select("row.*")
