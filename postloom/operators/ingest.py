"""From scraped batches to the store: work list, duplicate checks, save, telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import fixed_values as fv
from postloom.functions.dates import date_or_today, day
from postloom.functions.expr import strip
from postloom.functions.text import clearance_flag
from postloom.operators.keys import absent, known
from postloom.operators.ranking import keep_first

POSTING_KEY = ["job_url", "owning_user"]
#: Parts that an owner's keywords are dealt over to meet the tenants of a board.
DEAL = 16


def work_list(profiles: DataFrame, configs: DataFrame, sites: Sequence[str] = tuple(fv.SITES)) -> DataFrame:
    """One row per owner, keyword and board, and per configured tenant for multi-tenant boards.

    Keyword and board lists are exploded inside a row; tenants come from an equi join. An owner's list is its keywords
    times its tenants, far more than either, so an owner's keywords are dealt over ``DEAL`` parts, which meet a copy of
    the tenants each, in as many tasks as a shuffle has whatever the size of what they read.
    """
    wanted = (
        profiles.where((F.col("is_default") == 1) & (F.size("keywords") > 0))
        .select("owning_user", "location", F.explode("keywords").alias("search_term"))
        .select("*", F.explode(F.array(*[F.lit(s) for s in sites])).alias("site"))
    )
    multi = F.col("site").isin(fv.MULTI_TENANT_SITES)
    tenants = configs.select(
        "owning_user", F.col("config_type").alias("site"), F.col("config_key").alias("site_config")
    )
    single = wanted.where(~multi).withColumn("site_config", F.lit(None).cast("string"))
    keys, tasks = ["owning_user", "site", "_deal"], int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows alike in all columns come from different profiles, so they are dealt by number
    dealt = wanted.where(multi).withColumn("_deal", F.pmod(F.monotonically_increasing_id(), F.lit(DEAL)).cast("int")).repartition(tasks, *keys)
    copies = tenants.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1)))).repartition(tasks, *keys)
    return single.unionByName(dealt.join(copies, keys).drop("_deal"))


def distinct_postings(incoming: DataFrame, *order: Column) -> DataFrame:
    """Keep the first arrival of every url and owner."""
    return keep_first(incoming, POSTING_KEY, *order)


def new_postings(incoming: DataFrame, stored: DataFrame, *order: Column) -> DataFrame:
    """First arrivals that the owner does not have yet. Only the key columns of the store are read."""
    taken = known(stored, incoming, POSTING_KEY)
    return distinct_postings(incoming, *order).join(taken, POSTING_KEY, "left_anti")


def unseen_anywhere(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Postings whose url nobody has: the boards' early skip."""
    return absent(incoming, stored, ["job_url"])


def key_totals(incoming: DataFrame, stored: DataFrame, arrival: str = "arrival_id") -> DataFrame:
    """One row for each incoming key: ``rows``, ``site`` and ``has_description`` of its first arrival, ``is_new``.

    The batch is combined by key before it moves, so a url that fills it is no large group, and the
    store is asked for those keys only.
    """
    described = F.coalesce(strip("description") != "", F.lit(False)).alias("has_description")
    keys = incoming.groupBy(*POSTING_KEY).agg(
        F.count(F.lit(1)).alias("rows"), F.min_by(F.struct("site", described), arrival).alias("_first")
    )
    taken = known(stored, keys, POSTING_KEY).distinct().withColumn("_taken", F.lit(True))
    return keys.join(taken, POSTING_KEY, "left").select(
        *POSTING_KEY, "rows", "_first.*", F.col("_taken").isNull().alias("is_new")
    )


def next_ids(first_id: int) -> Column:
    """Row ids from ``first_id`` on, unique over all tasks without a shared counter; gaps are left.

    They are given out while the rows are written, so a frame that carries them is written once and
    read back, not evaluated twice.
    """
    return F.lit(first_id) + F.monotonically_increasing_id()


def stored_rows(fresh: DataFrame, as_of: Column | str, first_id: int = 1) -> DataFrame:
    """New postings as rows of the store, with their defaults and the clearance flag of their text."""
    there = set(fresh.columns)

    def given(name: str, kind: str) -> Column:
        return (F.col(name) if name in there else F.lit(None)).cast(kind).alias(name)

    return fresh.select(
        next_ids(first_id).alias("id"),
        "job_url",
        given("site", "string"),
        "title",
        given("company", "string"),
        given("location", "string"),
        given("job_type", "string"),
        date_or_today(given("date_posted", "date"), as_of).alias("date_posted"),
        given("interval", "string"),
        given("min_amount", "double"),
        given("max_amount", "double"),
        given("currency", "string"),
        given("is_remote", "boolean"),
        given("num_urgent_words", "string"),
        given("benefits", "string"),
        given("emails", "string"),
        given("description", "string"),
        F.lit(0).alias("job_score"),
        F.lit("{}").alias("job_score_json"),
        clearance_flag(given("description", "string"), "title").alias("security_clearance_required"),
        F.lit("").alias("usage_metrics"),
        F.lit("not_reviewed").alias("review_status"),
        given("title_compatibility_score", "string"),
        day(as_of).alias("date_created"),
        "owning_user",
        given("search_term", "string"),
        F.lit(None).cast("date").alias("applied_at"),
        F.lit("").alias("job_notes"),
        F.lit(None).cast("binary").alias("resume"),
    )


# --- scrape telemetry ---------------------------------------------------------------------------


def reconcile_logs(logs: DataFrame, saved: DataFrame) -> DataFrame:
    """Net-new counts on scrape logs: the lowest id of a run, term and board gets the count.

    ``saved`` has ``run_id, search_term, scraper, saved``; runs and terms in it are reconciled. The
    counts go back by log id, which is unique, so a board with very many rows stays spread out.
    """
    keys = ["run_id", "search_term", "scraper"]
    done = F.col("success").cast("int") == 1
    first = logs.where(done).groupBy(*keys).agg(F.min("id").alias("id"))
    counts = first.join(saved, keys).select("id", F.col("saved").alias("_saved"))
    touched = saved.select("run_id", "search_term").distinct().withColumn("_touched", F.lit(True))
    return (
        logs.join(counts, "id", "left")
        .join(touched, ["run_id", "search_term"], "left")
        .withColumn(
            "jobs_found",
            F.when(done & F.col("_touched"), F.coalesce("_saved", F.lit(0)))
            .otherwise(F.col("jobs_found"))
            .cast(logs.schema["jobs_found"].dataType),
        )
        .select(*logs.columns)
    )


def mark_incomplete(
    logs: DataFrame, run_id: str, search_term: str, after_id: int | Column, reason: str
) -> DataFrame:
    """Rows of a run and term after a high-water id become failures that found nothing."""
    hit = (
        (F.col("id") > after_id)
        & (F.col("run_id") == run_id)
        & (F.col("search_term") == search_term)
        & (F.col("success").cast("int") == 1)
    )
    types = dict(logs.dtypes)
    out = logs.withColumn("jobs_found", F.when(hit, 0).otherwise(F.col("jobs_found")).cast(types["jobs_found"]))
    old = F.col("error_message") if "error_message" in types else F.lit(None).cast("string")
    out = out.withColumn("error_message", F.when(hit, F.lit(reason)).otherwise(old))
    return out.withColumn(
        "success", F.when(hit, F.lit(0).cast(types["success"])).otherwise(F.col("success"))
    )


def high_water(logs: DataFrame) -> DataFrame:
    return logs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_id"))


def scrape_log_rows(attempts: DataFrame, ts: Column) -> DataFrame:
    """Log rows of finished scrapes; a failed one found nothing and says why."""
    failed = F.col("error_message").isNotNull()
    return attempts.select(
        "run_id",
        "scraper",
        "site",
        F.coalesce("search_term", F.lit("N/A")).alias("search_term"),
        F.when(failed, 0).otherwise(F.col("jobs_found")).cast("int").alias("jobs_found"),
        "scrape_duration_seconds",
        ts.alias("timestamp"),
        (~failed).alias("success"),
        "error_message",
    )


def usage_log_rows(calls: DataFrame, ts: Column) -> DataFrame:
    """Log rows of model calls. ``usage`` is a map; a call without any is not logged."""
    return calls.where(F.size("usage") > 0).select(
        ts.alias("timestamp"),
        F.coalesce("run_id", F.lit("")).alias("run_id"),
        "provider",
        "model",
        "call_type",
        *[
            F.coalesce(F.try_element_at("usage", F.lit(f)), F.lit(0)).cast("bigint").alias(f)
            for f in fv.USAGE_FIELDS
        ],
        F.coalesce("duration_ms", F.lit(0)).cast("bigint").alias("duration_ms"),
    )
