"""Looking a batch up in a much larger store.

The store is first narrowed to the keys the batch asks for. That semi join reads only key columns,
and while the batch is small enough for the planner to send it to all tasks, the store is scanned in
place and not shuffled, whatever its size. With a large batch the same plan becomes two key joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def known(store: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the store that the batch holds too."""
    return store.select(*keys).join(asked.select(*keys), list(keys), "left_semi")


def absent(batch: DataFrame, store: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key the store does not have."""
    return batch.join(known(store, batch, keys), list(keys), "left_anti")
