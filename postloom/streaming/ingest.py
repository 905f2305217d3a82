"""Incremental posting ingest: landed files in, postings that are new out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from postloom.operators import ingest as ig
from postloom.operators import titles as ti
from postloom.session import cut_lineage
from postloom.streaming import parts

#: Buckets of the stored keys. It is a property of a sink: a sink with keys keeps the number it began with.
BUCKETS = 256
_KEYS = T.StructType([*(T.StructField(k, T.StringType()) for k in ig.POSTING_KEY), T.StructField("bucket", T.IntegerType())])


def landed(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


# --- the sink -----------------------------------------------------------------------------------


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*ig.POSTING_KEY), F.lit(buckets)).cast("int").alias("bucket")


def _keys(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.select(*[F.col(k).cast("string").alias(k) for k in ig.POSTING_KEY], _bucket(buckets))


def open_sink(spark: SparkSession, path: str, base: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Put the keys of a store from before the stream into the sink's buckets, once."""
    if base is not None and not parts.live(spark, f"{path}/keys"):
        parts.write(_keys(base, buckets).distinct(), f"{path}/keys", 0, by="bucket")


def held_keys(spark: SparkSession, path: str, asked: DataFrame, batch: int, buckets: int = BUCKETS) -> DataFrame:
    """Keys stored before a batch, from the buckets alone that the asked keys fall into.

    The asked keys' buckets, ``buckets`` numbers at most, are found first; the others' files are not read.
    """
    wanted = [r["bucket"] for r in _keys(asked, buckets).select("bucket").distinct().collect()]
    stored = parts.read(spark, f"{path}/keys", _KEYS, before=batch + 1)
    return stored.where(F.col("bucket").isin(wanted)).drop("part_to")


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The postings that a stream has saved."""
    return parts.read(spark, f"{path}/rows", schema).drop("part_to")


def ingest(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    order: Sequence[Column],
    reject_words: Sequence[str] = (),
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    base: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Save the new postings of every landed batch and stop when all files are done.

    A batch is compared with the keys of earlier batches, of the buckets only that its own keys fall into, and
    replaces its own parts of rows and keys: run again after a failure, it neither sees its first attempt nor adds to
    it. Parts of earlier batches are merged before a batch is written. ``base`` is a store from before the stream
    began; its keys are bucketed once, its rows stay where they are.
    """
    words = F.array(*[F.lit(w) for w in reject_words]) if reject_words else None
    kind = stream.schema if prepare is None else prepare(stream.sparkSession.createDataFrame([], stream.schema)).schema
    open_sink(stream.sparkSession, sink, base, buckets)

    def save(rows: DataFrame, batch: int) -> None:
        save_batch(rows if prepare is None else prepare(rows), sink, batch, order, words, kind, buckets)

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def save_batch(
    rows: DataFrame,
    sink: str,
    batch: int,
    order: Sequence[Column],
    words: Column | None = None,
    kind: T.StructType | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Save the new postings of one batch; see ``ingest``. Part 0 of the keys is the store from before."""
    spark, kind = rows.sparkSession, kind or rows.schema
    if words is not None:
        rows = ti.drop_rejected(rows, words)
    parts.merge(spark, f"{sink}/keys", _KEYS, batch + 1, by="bucket")
    parts.merge(spark, f"{sink}/rows", kind, batch)
    fresh = ig.new_postings(rows, held_keys(spark, sink, rows, batch, buckets), *order)
    parts.write(fresh, f"{sink}/rows", batch)
    written = spark.read.schema(kind).parquet(parts.path_of(f"{sink}/rows", (batch, batch)))
    parts.write(_keys(written, buckets), f"{sink}/keys", batch + 1, by="bucket")


# --- the stateful form ----------------------------------------------------------------------------


class KeepFirst(StatefulProcessor):
    """The posting of smallest arrival for each key, corrected when a smaller one comes later.

    A key's state is its smallest arrival and when it was last seen. A timer set ``keep`` after that, in event time,
    takes the state away; the key is new when it is seen again.
    """

    def __init__(self, columns: Sequence[str], arrival: str, ts: str, keep_ms: int) -> None:
        self.columns, self.arrival, self.ts, self.keep_ms = list(columns), arrival, ts, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "arrival bigint, seen_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first, seen = None, 0
        for row in rows:
            seen = max(seen, int(row[self.ts].timestamp() * 1000))
            if first is None or row[self.arrival] < first[self.arrival]:
                first = row
        before = self.held.get() if self.held.exists() else None
        least, last = (None, None) if before is None else (before[0], before[1])
        if last is None or seen > last:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(seen + self.keep_ms)
        smaller = least is None or first[self.arrival] < least
        self.held.update((first[self.arrival] if smaller else least, seen if last is None else max(seen, last)))
        if smaller:
            yield Row(**{c: first[c] for c in self.columns}, replaces=least)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_postings(stream: DataFrame, ts: str, keep_ms: int, delay: str, arrival: str = "arrival_id") -> DataFrame:
    """Changes that keep the first posting of every url and owner: the stream's columns and ``replaces``.

    ``replaces`` is the arrival that a row takes the place of, null for a key that was not known. State is one small
    row for each key seen within ``keep_ms`` of event time. Rows later than ``delay`` are dropped by Spark; put
    ``lateness.admit`` before, and they are counted. Needs the RocksDB state store (``use_rocksdb``).
    """
    kind = T.StructType([*stream.schema.fields, T.StructField("replaces", T.LongType())])
    processor = KeepFirst(stream.columns, arrival, ts, keep_ms)
    keyed = stream.withWatermark(ts, delay).groupBy(*ig.POSTING_KEY)
    return keyed.transformWithState(processor, kind, "append", "EventTime")


# --- the same changes with the state in a sink ----------------------------------------------------

_ROW, _SEEN = "_row", "_seen_ms"


def _held(rows: DataFrame) -> DataFrame:
    """The newest state of every key."""
    newest = F.max_by(F.struct("least", _SEEN), "part_to").alias("_held")
    return rows.groupBy(*ig.POSTING_KEY).agg(newest, F.max("part_to").alias("part_to")).select(*ig.POSTING_KEY, "_held.*", "part_to")


def _change_kind(kind: T.StructType) -> T.StructType:
    return T.StructType([*kind.fields, T.StructField("replaces", T.LongType())])


def _state_kind(kind: T.StructType) -> T.StructType:
    return T.StructType([*(kind[k] for k in ig.POSTING_KEY), T.StructField("least", T.LongType()), T.StructField(_SEEN, T.LongType())])


def save_firsts(rows: DataFrame, sink: str, batch: int, ts: str, keep_ms: int, delay_ms: int, arrival: str = "arrival_id") -> None:
    """Save the changes of one batch and the state of its keys; see ``keep_first_postings``."""
    spark, kind = rows.sparkSession, rows.schema
    state = _state_kind(kind)
    earlier = parts.read(spark, f"{sink}/state", state, before=batch)
    newest = earlier.agg(F.max(_SEEN)).first()[0]
    due = None if newest is None else newest - delay_ms - keep_ms

    def live(held: DataFrame) -> DataFrame:
        # an older state of a key that is gone was seen before that and is gone too
        return held if due is None else held.where(F.coalesce(F.col(_SEEN) > due, F.lit(True)))

    parts.merge(spark, f"{sink}/state", state, batch, fold=lambda held: live(_held(held)))
    parts.merge(spark, f"{sink}/changes", _change_kind(kind), batch)
    earlier = live(parts.read(spark, f"{sink}/state", state, before=batch))
    none = F.lit(None)
    # new rows and states meet in one shuffle, where equal keys may be null too
    met = rows.select(
        *ig.POSTING_KEY, F.struct(*kind.names).alias(_ROW), F.col(arrival).alias("least"), F.unix_millis(ts).alias(_SEEN), none.cast("long").alias("part_to")
    ).unionByName(earlier.withColumn(_ROW, none.cast(kind)))
    new = F.col("part_to").isNull()
    touched = met.groupBy(*ig.POSTING_KEY).agg(
        F.min_by(_ROW, F.when(new, F.col("least"))).alias(_ROW),
        F.max(F.when(new, F.col(_SEEN))).alias(_SEEN),
        F.max_by(F.struct("least", _SEEN), "part_to").alias("_held"),
    ).where(F.col(_ROW).isNotNull())
    written = cut_lineage(touched, "touched")
    first, before = F.col(_ROW)[arrival], F.col("_held.least")
    smaller = before.isNull() | (first < before)
    parts.write(written.where(smaller).select(f"{_ROW}.*", before.cast("long").alias("replaces")), f"{sink}/changes", batch)
    after = written.select(*ig.POSTING_KEY, F.least(first, before).cast("long").alias("least"), F.greatest(_SEEN, f"_held.{_SEEN}").alias(_SEEN))
    # last, as a batch is done when its state is there
    parts.write(after, f"{sink}/state", batch)


def keep_first_postings(
    stream: DataFrame, sink: str, checkpoint: str, ts: str, keep_ms: int, delay_ms: int, arrival: str = "arrival_id"
) -> StreamingQuery:
    """Write the changes of ``first_postings`` batch by batch to a sink of numbered parts, and stop when all files are done.

    The state is a sink too: smallest arrival and last time of every key, joined to a batch by one shuffle of Spark's own,
    so a batch of very many keys costs what its rows do and not a call for each key. A key whose last time lies ``keep_ms``
    behind the newest time of earlier batches less the delay is new when it is seen again. The stream's rows are to come from
    ``lateness.admit``; none is dropped here. A batch that runs again replaces its own parts.
    """

    def save(rows: DataFrame, batch: int) -> None:
        save_firsts(rows, sink, batch, ts, keep_ms, delay_ms, arrival)

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_changes(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """The changes that ``keep_first_postings`` has written: the stream's columns and ``replaces``."""
    return parts.read(spark, f"{sink}/changes", _change_kind(schema)).drop("part_to")


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers is kept in RocksDB; a setting of the session, read when a stream starts."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def distinct_stream(stream: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """The first to come of equal keys within the delay. A key seen longer ago passes again."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(ig.POSTING_KEY))
