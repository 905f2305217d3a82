"""Running token usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postloom import fixed_values as fv
from postloom.operators.analytics import count_rows
from postloom.operators.ranking import keep_first
from postloom.streaming import parts

_COUNTS = ["call_count", *fv.USAGE_FIELDS, "duration_ms"]


def _sums() -> list[Column]:
    return [
        count_rows().alias("call_count"),
        *[F.sum(f).cast("bigint").alias(f) for f in [*fv.USAGE_FIELDS, "duration_ms"]],
    ]


def windowed_usage(calls: DataFrame, ts: str = "timestamp", delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Calls and sums per time window, run and call type; a window's state goes once the watermark has passed it."""
    windowed = calls.withWatermark(ts, delay).groupBy(F.window(ts, width), "run_id", "call_type")
    return windowed.agg(*_sums()).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "run_id", "call_type", *_COUNTS,
    )


def write_closed(windows: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Closed windows, each once: a window is written when no row on time can fall into it any more."""
    return (
        windows.writeStream.format("parquet").option("path", sink)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return keep_first(rows, list(keys), F.desc("part_to"))


_WINDOW = ("window_start", "run_id", "call_type")


def write_updates(totals: DataFrame, sink: str, checkpoint: str, keys: Sequence[str] = _WINDOW) -> StreamingQuery:
    """Changed totals of each batch as one part of the sink; a batch run again replaces its part.

    Earlier parts are merged to the newest total of each key, so what a reader goes through stays near the number of keys.
    """
    kind = totals.schema

    def save(rows: DataFrame, batch: int) -> None:
        parts.merge(rows.sparkSession, sink, kind, batch, fold=lambda x: _newest(x, keys))
        parts.write(rows, sink, batch)

    return (
        totals.writeStream.foreachBatch(save)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_totals(spark: SparkSession, sink: str, schema: T.StructType, keys: Sequence[str] = _WINDOW) -> DataFrame:
    """The newest total of every key."""
    return _newest(parts.read(spark, sink, schema), keys).drop("part_to")


def run_totals(windows: DataFrame) -> DataFrame:
    """Calls and sums of each run and call type over its windows."""
    return windows.groupBy("run_id", "call_type").agg(*[F.sum(c).cast("bigint").alias(c) for c in _COUNTS])
