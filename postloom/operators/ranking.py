"""Keep-first and first-n per key.

A rank filter of this shape is planned with a group limit before the exchange, so each task sends
at most ``n`` rows per key however many rows one key holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import cut_lineage


def first_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, offset: int = 0
) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + n`` of every key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window)).where(
        F.col("_rank") <= offset + n
    )
    if offset:
        ranked = ranked.where(F.col("_rank") > offset)
    return ranked.drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first in an order that must be stated in full."""
    return first_n(df, keys, order)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Rows with their number from 0 in the given order, without sorting them in one task."""
    return places(df.orderBy(*order), name)


def places(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Rows of a sorted frame with their number from 0.

    Ranges are written as they come; a row's number is the count of the ranges before, one number for each task, and its
    place in its own.
    """
    task = 33  # bits of the place within a task, in Spark's increasing ids
    rows = cut_lineage(ordered.withColumn(name, F.monotonically_increasing_id()), "ordered")
    of = F.shiftright(name, task).cast("int").alias("task")
    counts = {r["task"]: r["n"] for r in rows.groupBy(of).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for t in range(max(counts, default=-1) + 1):
        starts.append(before)
        before += counts.get(t, 0)
    start = F.get(F.split(F.lit(",".join(map(str, starts or [0]))), ",").cast("array<bigint>"), F.shiftright(name, task).cast("int"))
    return rows.withColumn(name, start + F.col(name).bitwiseAND(F.lit((1 << task) - 1)))


def board_slice(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], wanted: int, offset: int = 0
) -> DataFrame:
    """The wanted results of every board search after an offset."""
    return first_n(df, keys, order, wanted, offset)


def deep_slice(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], wanted: int, offset: int = 0
) -> DataFrame:
    """``board_slice`` for deep offsets and searches of very unequal size.

    Rows are numbered over all searches at once, in ranges of even size; a row's place in its search is its number less
    the search's first. No task holds a search, however many rows it has or however deep the slice is.
    """
    rows = numbered(df, [*[F.asc_nulls_first(k) for k in keys], *order], "_place")
    first = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_place").alias("_first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    rank = F.col("_place") - F.col("_first")
    return rows.join(first, same).where((rank >= offset) & (rank < offset + wanted)).select(*df.columns)
