"""Work on buckets of rows and on the graphs of links that come out of it.

A bucket may hold a third of all rows. Buckets are therefore cut into cells of bounded size such that
every two members still meet in one cell, and the links of a cell are a spanning forest: enough to find
the components, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.session import cut_lineage


def cells(rows: DataFrame, keys: list[str], member: Column, chunk: int, sizes: DataFrame | None = None) -> DataFrame:
    """Rows of the buckets that have two members or more, dealt to cells of two chunks at most.

    Adds ``part`` (the member's chunk), ``cell_a`` and ``cell_b``: a row with part p is in the cells
    (min(p, o), max(p, o)) of all chunks o of its bucket. Members of one bucket with different parts
    meet in one cell; those of the same part meet in (p, p) and again beside every other part. ``sizes``
    has the keys and members (``_n``) of these buckets where they are known.
    """
    if sizes is None:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sized = rows.join(sizes, keys)
    parts = F.ceil(F.col("_n") / chunk).cast("int")
    dealt = sized.select(
        *rows.columns, parts.alias("_parts"), F.pmod(F.xxhash64(member, F.lit("part")), parts).cast("int").alias("part")
    )
    return dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(
        *rows.columns,
        "part",
        F.least("part", "_other").alias("cell_a"),
        F.greatest("part", "_other").alias("cell_b"),
    )


def by_run(
    rows: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, many: bool = False
) -> DataFrame:
    """Apply ``work`` to the rows of each value of ``keys`` (integers without nulls), a run at a time.

    Partitions are sorted by the keys and read as Arrow batches, so that millions of small runs need no
    group each; a task holds one batch and the run at its end. With ``many``, ``work`` gets several whole runs at once.
    """

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            if held and not _same(held[-1], batch, keys):
                yield from _done(pd.concat(held, ignore_index=True), [], work)
                held = []
            cuts = _cuts(batch, keys)
            if not len(cuts):
                held.append(batch)
                continue
            first = pd.concat([*held, batch.iloc[: cuts[0]]], ignore_index=True)
            yield from _done(first, [], work)
            inner = [] if many else cuts[1:-1] - cuts[0]
            yield from _done(batch.iloc[cuts[0] : cuts[-1]], inner, work)
            held = [batch.iloc[cuts[-1] :]]
        if held:
            yield from _done(pd.concat(held, ignore_index=True), [], work)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(runs, schema)


def _same(before: pd.DataFrame, after: pd.DataFrame, keys: list[str]) -> bool:
    return all(before[k].iloc[-1] == after[k].iloc[0] for k in keys)


def changes(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Whether a row has other keys than the row before, for all rows but the first."""
    change = np.zeros(len(rows) - 1, dtype=bool)
    for k in keys:
        values = rows[k].to_numpy()
        change |= values[1:] != values[:-1]
    return change


def _cuts(batch: pd.DataFrame, keys: list[str]) -> np.ndarray:
    return np.flatnonzero(changes(batch, keys)) + 1


def _done(rows: pd.DataFrame, cuts, work) -> Iterator[pd.DataFrame]:
    if not len(rows):
        return
    edges = [0, *cuts, len(rows)]
    found = [work(rows.iloc[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
    found = [f for f in found if f is not None and len(f)]
    if found:
        yield pd.concat(found, ignore_index=True)


def forest(size: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph on 0..size-1 in which ``near(i, rest)`` flags the neighbours of i in rest.

    Each node is held against the nodes that nothing has reached yet, which is all that the components
    depend on; a dense group costs one pass.
    """
    rest = np.arange(1, size)
    stack, heads, tails = [0], [], []
    while len(rest) or stack:
        if not stack:
            stack, rest = [int(rest[0])], rest[1:]
        node = stack.pop()
        if not len(rest):
            break
        hit = near(node, rest)
        got = rest[hit]
        if len(got):
            heads.append(np.full(len(got), node))
            tails.append(got)
            stack.extend(got.tolist())
            rest = rest[~hit]
    if not heads:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(heads), np.concatenate(tails)


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for every node of ``edges`` (``a``, ``b``: long) that is not itself the smallest.

    Alternating large and small stars (Kiveris et al., 2014). Each round is joins and minima over the
    edges, written to the shared folder; nothing but two counts comes to the driver. A star's centre may
    be hot: minima are combined before the exchange, and adaptive execution splits the join. Null ends
    and loops are left out. Returns ``node``, ``root``.
    """
    pairs = edges.where("a != b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    ).distinct()
    pairs, before = cut_lineage(pairs, "edges"), None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == before or state[0] == 0:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = state
        pairs = cut_lineage(_small_star(_large_star(pairs)), "edges")


def _large_star(pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
        pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = ends.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("lo"), F.least("u", "v").alias("m"))
    return pairs.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = pairs.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()
