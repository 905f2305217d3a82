"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A filter direction is a product of one random codeword for each block of rotated coordinates (Becker,
Ducas, Gama, Laarhoven, 2016). The directions whose inner product with a vector exceeds its cap height
are found by list decoding: blocks are extended one by one, and partial sums that even the best rest
cannot lift over the height are dropped. Vectors are joined on their filters and every pair that meets
is verified in double precision.

The cap height follows the vector: a margin below the best direction of the code. A fixed height leaves
vectors that stand badly to a code without any filter; this one gives each vector the directions that a
close neighbour can prefer, so recall hardly depends on the vector. Several rotations make it near one:
with the defaults 0.999 of uniform pairs at a cosine of exactly 0.93 meet, and more of closer ones.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.groups import by_run, cells, components, forest
from postloom.session import cut_lineage

BLOCKS, CODEWORDS, ROTATIONS, SEED = 3, 64, 4, 20160110
#: Margin below the best direction, in units of 1 / sqrt(dimensions).
MARGIN = 0.2
#: Vectors of a filter that are compared in one piece; a cell has two pieces at most.
CHUNK = 1024


@lru_cache(maxsize=32)
def _codes(dims: int, rotation: int) -> list[np.ndarray]:
    """For each block the codewords as columns over all coordinates, rotated and scaled."""
    rng = np.random.default_rng((SEED, dims, rotation))
    turn, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
    blocks = np.array_split(np.arange(dims), min(BLOCKS, dims))
    out = []
    for block in blocks:
        words = rng.normal(size=(CODEWORDS, len(block)))
        words /= np.linalg.norm(words, axis=1, keepdims=True) * np.sqrt(len(blocks))
        out.append(turn[block].T @ words.T)
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither vanish nor overflow."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def list_decode(vectors: np.ndarray) -> list[np.ndarray]:
    """Filters (sorted ints over all rotations) of each row of unit vectors."""
    count, dims = vectors.shape
    rows_all, caps_all = [], []
    for rotation in range(ROTATIONS):
        scores = [vectors @ words for words in _codes(dims, rotation)]
        best_rest = [np.zeros(count)]
        for block in scores[:0:-1]:
            best_rest.insert(0, best_rest[0] + block.max(axis=1))
        height = best_rest[0] + scores[0].max(axis=1) - MARGIN / np.sqrt(dims)
        rows, sums, caps = np.arange(count), np.zeros(count), np.full(count, rotation)
        for block, rest in zip(scores, best_rest, strict=True):
            lifted = sums[:, None] + block[rows]
            at, word = np.nonzero(lifted + rest[rows, None] >= height[rows, None])
            sums, caps, rows = lifted[at, word], caps[at] * CODEWORDS + word, rows[at]
        rows_all.append(rows)
        caps_all.append(caps)
    rows, caps = np.concatenate(rows_all), np.concatenate(caps_all)
    order = np.lexsort((caps, rows))
    return np.split(caps[order].astype(np.int32), np.cumsum(np.bincount(rows, minlength=count))[:-1])


def _caps(series: pd.Series) -> pd.Series:
    out: list[np.ndarray | None] = [None] * len(series)
    sizes = series.map(len).to_numpy()
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        for start in range(0, len(at), 1024):
            part = at[start : start + 1024]
            for i, caps in zip(part, list_decode(unit(np.stack(series.iloc[part].tolist()))), strict=True):
                out[i] = caps
    return pd.Series(out)


def _compare(threshold: float):
    def work(run: pd.DataFrame) -> pd.DataFrame | None:
        vectors = unit(np.stack(run["embedding"].tolist()))
        ids, copies, part = run["cid"].to_numpy(), run["copies"].to_numpy(), run["part"].to_numpy()
        linked = vectors @ vectors.T >= threshold
        np.fill_diagonal(linked, False)
        if run["cell_a"].iat[0] != run["cell_b"].iat[0]:
            linked &= part[:, None] != part[None, :]
        if not linked.any():
            return None
        heads, tails = forest(len(ids), lambda i, rest: linked[i, rest])
        # a pair counts in the first filter that its vectors share
        caps = [np.asarray(c) for c in run["caps"]]
        member = np.repeat(np.arange(len(ids)), [len(c) for c in caps])
        flat = np.concatenate(caps)
        earlier = flat < run["cap"].iat[0]
        member, flat = member[earlier], flat[earlier]
        order = np.argsort(flat, kind="stable")
        member, flat = member[order], flat[order]
        for group in np.split(member, np.flatnonzero(flat[1:] != flat[:-1]) + 1):
            if len(group) > 1:
                linked[np.ix_(group, group)] = False
        links = linked.astype(np.float64) @ copies
        found = np.flatnonzero(links)
        return pd.DataFrame(
            {
                "a": np.concatenate((ids[heads], ids[found])),
                "b": np.concatenate((ids[tails], ids[found])),
                "n": np.concatenate((np.zeros(len(heads), dtype=np.int64), links[found].astype(np.int64))),
            }
        )

    return work


def near_duplicates(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Rows (``vec_id``, ``embedding``, integer ``label``) link when their labels are equal and their cosine
    reaches the threshold. Vectors that are null, empty or zero, or hold null or non-finite components,
    and rows with a null label link with nothing and are their own component; vectors of different
    length never link. Equal vectors of a label are one node; each of them links with the others and
    with all that they link with. ``kept`` flags the smallest ``vec_id`` of a component. An empty table
    gives no rows; other columns are ignored.
    """
    sound = (
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.exists("embedding", lambda x: x != 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    given = rows.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long")).withColumn(
        "sound", F.coalesce(sound, F.lit(False))
    )
    good = given.where("sound").drop("sound")
    classes = good.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    # ids are given once and kept: the table is written
    nodes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")

    decode = F.pandas_udf(_caps, "array<int>")
    caps = nodes.select("label", F.size("embedding").alias("dims"), "cid", F.explode(decode("embedding")).alias("cap"))
    keys = ["label", "dims", "cap"]
    met = cut_lineage(cells(caps, keys, F.col("cid"), CHUNK), "filters")
    shared = met.groupBy("cid").agg(F.collect_set("cap").alias("caps"))
    payload = nodes.join(shared, "cid").select("cid", "embedding", "copies", "caps")
    runs = met.join(payload, "cid")
    found = by_run(runs, [*keys, "cell_a", "cell_b"], _compare(threshold), "a long, b long, n long")
    found = cut_lineage(found, "links")

    counts = found.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    roots = components(found.select("a", "b")).withColumnRenamed("node", "cid")
    known = nodes.join(counts, "cid", "left").join(roots, "cid", "left")
    known = known.withColumn("root", F.coalesce("root", "cid"))
    named = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    facts = known.join(named, "root").select(
        "label",
        "embedding",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id",
    )
    linked = good.join(facts, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = given.where("NOT sound").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
