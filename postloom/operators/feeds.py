"""Change feeds that may come out of order, late, and more than once.

A change has a sequence number. The state of a table keeps for every cell the number of the change that set it, and for
every key the number of its last delete (a tombstone). A cell takes the change of the highest number, and a delete
takes away what is older than itself, so the state after a set of changes is the same in whatever batches and order they
come, and a batch that is applied again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Number of the last delete of a key; null where there was none.
GONE = "_gone_at"
#: Number of the last change that said the key is there.
SEEN = "_seen_at"


def _cell(name: str, seq: Column) -> Column:
    return F.when(F.col(name).isNotNull(), F.struct(seq.cast("long").alias("seq"), F.col(name).alias("value"))).alias(name)


def state_of(table: DataFrame, keys: Sequence[str], seq: int | Column = 0) -> DataFrame:
    """A plain table as state, all of it set by one number."""
    number = F.lit(seq) if isinstance(seq, int) else seq
    cells = [_cell(c, number) for c in table.columns if c not in keys]
    return table.select(*keys, number.cast("long").alias(SEEN), F.lit(None).cast("long").alias(GONE), *cells)


def merged(state: DataFrame, feed: DataFrame, keys: Sequence[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """The state after a batch of changes: ``op`` U sets the columns that are not null, D deletes the key.

    State and batch are combined by key before they move, so a key with very many changes sends one row a task.
    """
    columns = [c for c in state.columns if c not in (*keys, SEEN, GONE)]
    number, gone = F.col(seq).cast("long"), F.col(op) == "D"
    there = set(feed.columns)
    kinds = dict(state.dtypes)
    told = [
        F.when(~gone, _cell(c, number)).cast(kinds[c]).alias(c) if c in there else F.lit(None).cast(kinds[c]).alias(c)
        for c in columns
    ]
    changes = feed.select(*keys, F.when(~gone, number).alias(SEEN), F.when(gone, number).alias(GONE), *told)
    both = state.unionByName(changes)
    # the largest number first in the struct: its value is the cell's
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in (SEEN, GONE, *columns)]).select(*state.columns)


def current(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table that a state stands for."""
    columns = [c for c in state.columns if c not in (*keys, SEEN, GONE)]
    after = F.coalesce(F.col(GONE), F.lit(-(1 << 63)).cast("long"))
    there = state.where(F.col(SEEN) > after)
    return there.select(*keys, *[F.when(F.col(c)["seq"] > after, F.col(c)["value"]).alias(c) for c in columns])


def without_old_deletes(state: DataFrame, before: int) -> DataFrame:
    """The state without keys whose last word is a delete below ``before``: for feeds known to bring nothing older."""
    last = (F.col(GONE) < before) & (F.coalesce(F.col(SEEN), F.lit(-1)) <= F.col(GONE))
    return state.where(~F.coalesce(last, F.lit(False)))
