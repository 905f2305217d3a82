"""Event time: which rows a stream still takes, and which come too late.

A row is late when its time lies a delay or more before the newest time of the batches before. Late rows go to a
side output, where they can be counted and looked at; the others go on and are on time for every operator with the
same delay behind this one, as no watermark of theirs can be further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postloom.streaming import parts

_MARK = T.StructType([T.StructField("newest", T.TimestampType())])


def _path(root: str, kind: str, batch: int) -> str:
    return f"{root.rstrip('/')}/{kind}/batch={batch}"


def _write_once(rows: DataFrame, path: str) -> None:
    """Write a folder unless it is there: what is handed on never changes, also when a batch runs again."""
    if not parts.committed(rows.sparkSession, path):
        rows.write.mode("overwrite").parquet(path)


def _newest(spark: SparkSession, root: str, batch: int):
    """Newest time of the batches before this one; each batch's mark holds it for all up to itself."""
    if batch == 0:
        return None
    return spark.read.schema(_MARK).parquet(_path(root, "marks", batch - 1)).agg(F.max("newest")).first()[0]


def admit_batch(rows: DataFrame, root: str, batch: int, ts: str, delay: str) -> None:
    """Part one batch into on-time and late rows. A row without a time is late."""
    spark = rows.sparkSession
    newest = _newest(spark, root, batch)
    due = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
    late = F.col(ts).isNull() | F.coalesce(F.col(ts) <= due, F.lit(False))
    _write_once(rows.where(~late), _path(root, "on_time", batch))
    _write_once(rows.where(late), _path(root, "late", batch))
    mark = rows.agg(F.greatest(F.max(ts), F.lit(newest).cast("timestamp")).alias("newest"))
    _write_once(mark, _path(root, "marks", batch))


def admit(stream: DataFrame, root: str, checkpoint: str, ts: str, delay: str) -> StreamingQuery:
    """Part every landed batch into ``root``/on_time and ``root``/late, and stop when all files are done."""

    def save(rows: DataFrame, batch: int) -> None:
        admit_batch(rows, root, batch, ts, delay)

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def on_time(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The on-time rows as a stream, a batch of theirs a file set."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root.rstrip('/')}/on_time")
    return rows.select(*schema.names)


def late(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The late rows of all batches, and the ``batch`` they came in."""
    wide = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(wide).parquet(f"{root.rstrip('/')}/late")
