"""Streaming queries: the supplied rows are landed as files, streamed, and the result is read back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.analytics import count_rows
from postloom.plans.registry import Source, query
from postloom.session import shared_folder
from postloom.streaming import ingest, lateness, usage

BATCHES = 4


def _land(s: Source, rows: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Write rows as files into a fresh folder and stream them in a few batches."""
    root = f"{shared_folder(s.spark)}/{name}-{uuid.uuid4().hex}"
    files = max(BATCHES, int(s.spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(files).write.parquet(f"{root}/landed")
    per_batch = -(-files // BATCHES)
    return root, ingest.landed(s.spark, f"{root}/landed", rows.schema, per_batch)


def _landings(s: Source, rows: DataFrame, root: str) -> Iterator[int]:
    """Land the rows one ``landing`` after the other; what happens in between is up to the caller."""
    # made once, in a folder for each landing
    rows.write.partitionBy("landing").parquet(f"{root}/made")
    made = s.spark.read.schema(rows.schema).parquet(f"{root}/made").select(*rows.columns)
    for landing in range(BATCHES):
        made.where(F.col("landing") == landing).drop("landing").write.mode("append").parquet(f"{root}/landed")
        yield landing


def _admitted(s: Source, rows: DataFrame, name: str, ts: str, delay: str) -> Iterator[tuple[str, DataFrame]]:
    """After every landing: the folder, and the stream of the rows that came in time."""
    root = f"{shared_folder(s.spark)}/{name}-{uuid.uuid4().hex}"
    kind = rows.drop("landing").schema
    for _ in _landings(s, rows, root):
        stream = ingest.landed(s.spark, f"{root}/landed", kind)
        lateness.admit(stream, root, f"{root}/admit-checkpoint", ts, delay).awaitTermination()
        yield root, lateness.on_time(s.spark, root, kind)


@query(
    "stream_ingest",
    """SELECT job_url, owning_user, count(*) AS stored FROM (
      SELECT DISTINCT job_url, owning_user FROM <<incoming_postings>> i
      WHERE NOT contains(lower(title), 'chef') AND NOT EXISTS (
        SELECT 1 FROM <<job_details>> j WHERE j.job_url = i.job_url AND j.owning_user = i.owning_user)) d
    GROUP BY ALL""",
)
def stream_ingest(s: Source) -> DataFrame:
    incoming = s.view("incoming_postings")
    root, stream = _land(s, incoming, "ingest")
    # few buckets, as each is a folder and the batches are small
    job = ingest.ingest(
        stream, f"{root}/store", f"{root}/checkpoint", [F.asc("arrival_id")], ["chef"],
        base=s.view("job_details"), buckets=8,
    )
    job.awaitTermination()
    stored = ingest.stored(s.spark, f"{root}/store", incoming.schema)
    return stored.groupBy("job_url", "owning_user").agg(count_rows().alias("stored"))


def _in_time(view: str, ts: str, delay: str) -> str:
    """The rows of a landed view, and whether they are late."""
    return f"""SELECT l.*, coalesce({ts} <= m.due, false) AS late FROM <<{view}>> l JOIN (
      SELECT landing, max(newest) OVER (ORDER BY landing ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {delay} AS due
      FROM (SELECT landing, max({ts}) AS newest FROM <<{view}>> GROUP BY landing) n) m ON l.landing = m.landing"""


_DELAY = "2 days"
_CALLS = _in_time("landed_usage", "log_ts", "2 DAY")
_SUMS = """count(*) AS call_count, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  CAST(sum(cache_hit_tokens) AS BIGINT) AS cache_hit_tokens, CAST(sum(cache_miss_tokens) AS BIGINT) AS cache_miss_tokens,
  CAST(sum(duration_ms) AS BIGINT) AS duration_ms"""


def _calls(s: Source) -> DataFrame:
    return s.view("landed_usage").withColumn("timestamp", F.col("log_ts").cast("timestamp"))


@query(
    "stream_usage",
    f"SELECT run_id, call_type, {_SUMS} FROM ({_CALLS}) c WHERE NOT late GROUP BY run_id, call_type",
)
def stream_usage(s: Source) -> DataFrame:
    """Running totals: updates of daily windows, whose state goes with the watermark."""
    for root, stream in _admitted(s, _calls(s), "usage", "timestamp", _DELAY):
        totals = usage.windowed_usage(stream, delay=_DELAY, width="1 day")
        usage.write_updates(totals, f"{root}/totals", f"{root}/checkpoint").awaitTermination()
    return usage.run_totals(usage.current_totals(s.spark, f"{root}/totals", totals.schema))


@query(
    "stream_hourly_usage",
    f"""SELECT date_trunc('hour', log_ts) AS window_start, run_id, call_type, {_SUMS} FROM ({_CALLS}) c
    WHERE NOT late AND date_trunc('hour', log_ts) + INTERVAL 1 HOUR <= (SELECT max(log_ts) FROM <<landed_usage>>) - INTERVAL 2 DAY
    GROUP BY ALL""",
)
def stream_hourly_usage(s: Source) -> DataFrame:
    """Windows that are closed, each written once."""
    for root, stream in _admitted(s, _calls(s), "hourly", "timestamp", _DELAY):
        windows = usage.windowed_usage(stream, delay=_DELAY)
        usage.write_closed(windows, f"{root}/closed", f"{root}/checkpoint").awaitTermination()
    return s.spark.read.schema(windows.schema).parquet(f"{root}/closed").drop("window_end")


@query(
    "stream_late_usage",
    f"""SELECT landing AS batch, run_id, count(*) AS late_calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
    FROM ({_CALLS}) c WHERE late GROUP BY landing, run_id""",
)
def stream_late_usage(s: Source) -> DataFrame:
    """What came too late, from the side output."""
    calls = _calls(s)
    for root, _ in _admitted(s, calls, "late", "timestamp", _DELAY):
        pass
    late = lateness.late(s.spark, root, calls.drop("landing").schema)
    return late.groupBy("batch", "run_id").agg(
        count_rows().alias("late_calls"), F.sum("total_tokens").cast("bigint").alias("total_tokens")
    )


_POSTS = _in_time("landed_postings", "CAST(date_posted AS TIMESTAMP)", "60 DAY")


@query(
    "stream_distinct",
    f"""WITH least AS (SELECT job_url, owning_user, landing, min(arrival_id) AS arrival_id FROM ({_POSTS}) p WHERE NOT late GROUP BY ALL),
    kept AS (SELECT *, coalesce(arrival_id < min(arrival_id) OVER (PARTITION BY job_url, owning_user ORDER BY landing
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS change FROM least)
    SELECT job_url, owning_user, min(arrival_id) AS arrival_id, count(*) FILTER (WHERE change) - 1 AS corrections
    FROM kept GROUP BY job_url, owning_user""",
)
def stream_distinct(s: Source) -> DataFrame:
    """The first posting of every url and owner; one that comes late with a smaller number corrects it."""
    posts = s.view("landed_postings").withColumn("landed_at", F.col("date_posted").cast("timestamp"))
    day = 86_400_000
    for root, stream in _admitted(s, posts, "distinct", "landed_at", "60 days"):
        job = ingest.keep_first_postings(stream, f"{root}/firsts", f"{root}/checkpoint", "landed_at", keep_ms=20 * 366 * day, delay_ms=60 * day)
        job.awaitTermination()
    return ingest.first_changes(s.spark, f"{root}/firsts", stream.schema).groupBy("job_url", "owning_user").agg(
        F.min("arrival_id").alias("arrival_id"), F.count("replaces").alias("corrections")
    )
