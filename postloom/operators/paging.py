"""Pages of long sorted lists that cost what they hold, not what lies before them."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import fixed_values as fv
from postloom.operators import ranking
from postloom.session import shared_folder

#: Rows of a page that one task may put in order; a longer page is taken from a list sorted in ranges.
MOST_IN_TASK = 100_000


@dataclass(frozen=True)
class Key:
    """A column of a sort. The last key of a list must be unique and never null."""

    column: str
    descending: bool = False
    nulls_last: bool = False

    def order(self) -> Column:
        how = {
            (False, False): F.asc_nulls_first, (False, True): F.asc_nulls_last,
            (True, False): F.desc_nulls_first, (True, True): F.desc_nulls_last,
        }
        return how[self.descending, self.nulls_last](self.column)

    def behind(self, value: object) -> Column:
        """Whether a row's value comes later in the order than the given one."""
        column, null = F.col(self.column), F.col(self.column).isNull()
        if value is None:
            return F.lit(False) if self.nulls_last else ~null
        later = F.coalesce(column < F.lit(value) if self.descending else column > F.lit(value), F.lit(False))
        return (later | null) if self.nulls_last else later


def page_after(
    df: DataFrame, keys: Sequence[Key], last: Mapping[str, object] | None = None, size: int = fv.PAGE_SIZE
) -> DataFrame:
    """The page behind the row whose sort values are ``last``; the first page without it.

    Rows up to the last page are filtered where they lie, so a deep page costs a task no more than the first one. Rows
    that came or went since the last page shift nothing. A page of more than ``MOST_IN_TASK`` rows is written in ranges
    with what lies behind it, and no task holds it whole; its rows are in no order then.
    """
    if last is not None:
        behind, same = F.lit(False), F.lit(True)
        for key in keys:
            behind = behind | (same & key.behind(last[key.column]))
            same = same & F.col(key.column).eqNullSafe(F.lit(last[key.column]))
        df = df.where(behind)
    order = [k.order() for k in keys]
    if size > MOST_IN_TASK:
        return ranking.numbered(df, order, "_place").where(F.col("_place") < size).select(*df.columns)
    return df.orderBy(*order).limit(size)


class Ranged:
    """A sorted list written in ranges, of which any page reads the ranges that hold it.

    The sketch is the number of rows of each range, one number for each task that wrote.
    """

    def __init__(self, df: DataFrame, keys: Sequence[Key], path: str | None = None, ranges: int | None = None) -> None:
        self.spark, self.keys, self.columns = df.sparkSession, list(keys), df.columns
        self.path = path or f"{shared_folder(self.spark)}/ranged-{uuid.uuid4().hex}"
        order = [k.order() for k in keys]
        # the number is stated, as small ranges would else be put together
        ranges = ranges or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
        ordered.write.mode("overwrite").partitionBy("_range").parquet(self.path)
        counts = {r["_range"]: r["n"] for r in self._rows().groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.counts = [(r, counts[r]) for r in sorted(counts)]

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def holding(self, first: int, last: int) -> tuple[list[int], int]:
        """The ranges with the rows numbered ``first`` to ``last``, and the number of rows before them."""
        found, before, at = [], 0, 0
        for name, n in self.counts:
            if at + n > first and at <= last:
                before = before if found else at
                found.append(name)
            at += n
        return found, before

    def page(self, number: int, size: int = fv.PAGE_SIZE) -> DataFrame:
        """Page ``number`` from 1 on; a task keeps the rows of its range up to the end of the page."""
        first = (number - 1) * size
        ranges, before = self.holding(first, first + size - 1)
        rows = self._rows().where(F.col("_range").isin(ranges)) if ranges else self._rows().limit(0)
        ordered = rows.orderBy(*[k.order() for k in self.keys]).select(*self.columns)
        return ordered.offset(max(0, first - before)).limit(size)
