"""Aggregates kept up to date from changes, without reading the table again.

A change takes an old row out and puts a new row in. Rows with a sign are summed by group and added to what is stored.
Least and largest values cannot be taken out of a sum: where a removed row held one, that group alone is read again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGN = "_sign"


def signed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of a change: those that go with sign -1, those that come with +1; rows in both cancel out."""
    gone = before.select(*after.columns, F.lit(-1).alias(SIGN))
    return gone.unionByName(after.withColumn(SIGN, F.lit(1)))


def changed_rows(before: DataFrame, after: DataFrame, feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signed rows of the keys that a feed touches, before and after it."""
    touched = feed.select(*keys).distinct()
    return signed(before.join(touched, list(keys), "left_semi"), after.join(touched, list(keys), "left_semi"))


def folded(stored: DataFrame, changes: DataFrame, groups: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Stored sums after signed changes. A group whose ``sums`` are all zero is gone.

    ``sums`` gives what one row adds to each. Changes are summed by group before they meet the stored ones.
    """
    moved = changes.groupBy(*groups).agg(*[F.sum(F.col(SIGN) * c).cast("bigint").alias(n) for n, c in sums.items()])
    both = stored.select(*groups, *sums).unionByName(moved)
    out = both.groupBy(*groups).agg(*[F.sum(n).cast("bigint").alias(n) for n in sums])
    return out.where(F.greatest(*[F.abs(F.col(n)) for n in sums], F.lit(0)) > 0)


def extremes(
    stored: DataFrame, changes: DataFrame, table: DataFrame, groups: Sequence[str], columns: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Stored least and largest values after signed changes.

    ``columns`` gives for each result ``min`` or ``max`` and the column. Where a removed row held a group's value, the
    group is read again from ``table``, which is the table after the changes; all others take in the added values.
    """
    how = {"min": F.min, "max": F.max}
    gone, come = changes.where(F.col(SIGN) < 0), changes.where(F.col(SIGN) > 0)
    lost = [F.count_if(F.col(c).eqNullSafe(F.col(f"_{n}")) & F.col(c).isNotNull()) for n, (_, c) in columns.items()]
    held = stored.select(*groups, *[F.col(n).alias(f"_{n}") for n in columns])
    open_ = gone.join(held, list(groups)).groupBy(*groups).agg(sum(lost, F.lit(0)).alias("_lost")).where("_lost > 0")
    fresh = table.join(open_, list(groups), "left_semi").groupBy(*groups).agg(*[how[k](c).alias(n) for n, (k, c) in columns.items()])
    added = come.join(open_, list(groups), "left_anti").groupBy(*groups).agg(*[how[k](c).alias(n) for n, (k, c) in columns.items()])
    rest = stored.select(*groups, *columns).join(open_, list(groups), "left_anti")
    settled = rest.unionByName(added).groupBy(*groups).agg(*[how[k](n).alias(n) for n, (k, _) in columns.items()])
    return settled.unionByName(fresh)
