"""Dashboard and telemetry aggregates. All are partial then final aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom import fixed_values as fv
from postloom.functions.expr import is_blank
from postloom.functions.results import list_text, map_text

# --- counting helpers ------------------------------------------------------------------------


def count_rows() -> Column:
    return F.count(F.lit(1)).cast("bigint")


def count_if(condition: Column) -> Column:
    """Number of rows that meet a condition; null, not 0, over no rows at all."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def _tier(name: str) -> Column:
    return count_if(F.col("title_compatibility_score") == name)


def _tiers() -> list[Column]:
    return [
        count_rows().alias("total"),
        _tier("high").alias("high_compat"),
        _tier("medium").alias("medium_compat"),
        _tier("low").alias("low_compat"),
    ]


def _best_first(df: DataFrame, *tie: str) -> DataFrame:
    return df.orderBy(F.desc("high_compat"), F.desc("total"), *tie)


def _of(postings: DataFrame, owner: str | None) -> DataFrame:
    return postings if owner is None else postings.where(F.col("owning_user") == owner)


# --- postings ----------------------------------------------------------------------------------


def keyword_quality(postings: DataFrame, owner: str | None = None) -> DataFrame:
    """Postings per search term with their title tiers; blank terms are left out.

    Without an owner every owner is reported, one group per owner and term.
    """
    keys = ["search_term"] if owner is not None else ["owning_user", "search_term"]
    out = _of(postings, owner).where(F.col("search_term") != "").groupBy(*keys).agg(*_tiers())
    return _best_first(out.withColumnRenamed("search_term", "keyword"), "keyword")


def share(part: Column | str, whole: Column | str) -> Column:
    """Percentage with one decimal, half to even; null when the whole is 0."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.when(whole != 0, F.bround(100 * part / whole, 1))


def share_text(part: Column | str, whole: Column | str) -> Column:
    return F.coalesce(F.concat(share(part, whole).cast("string"), F.lit("%")), F.lit(fv.DASH))


def bar_width(percent: Column) -> Column:
    return F.least(F.bround(percent, 0), F.lit(100)).cast("int")


def keyword_shares(quality: DataFrame) -> DataFrame:
    """Share texts and bar widths of the keyword summary."""
    out = quality
    for tier in ("high", "medium", "low"):
        out = out.withColumn(f"{tier}_share", share_text(f"{tier}_compat", "total"))
    percent = F.when(F.col("total") != 0, 100 * F.col("high_compat") / F.col("total")).otherwise(0.0)
    return out.withColumn("high_bar", bar_width(percent))


def site_breakdown(
    postings: DataFrame, owner: str, keyword: str, tier: str = "all"
) -> DataFrame:
    """Tiers per board for one keyword, ignoring case."""
    mine = postings.where(
        (F.col("owning_user") == owner) & (F.lower("search_term") == keyword.lower())
    )
    if tier != "all":
        mine = mine.where(F.lower("title_compatibility_score") == tier.lower())
    return _best_first(mine.groupBy(F.lower("site").alias("site")).agg(*_tiers()), "site")


def funnel(postings: DataFrame, owner: str | None = None) -> DataFrame:
    """Totals by review state: one row for an owner, or one row per owner."""
    status = F.col("review_status")
    sums = [
        count_rows().alias("total"),
        count_if(
            (F.col("title_compatibility_score") == "high") & (status == "not_reviewed")
        ).alias("high_unreviewed"),
        *[count_if(status == s).alias(s) for s in ("saved", "applied", "rejected")],
    ]
    if owner is None:
        return postings.groupBy("owning_user").agg(*sums)
    return _of(postings, owner).agg(*sums)


def source_effectiveness(postings: DataFrame) -> DataFrame:
    """High-tier postings per board over all owners; blank boards are left out."""
    out = postings.where(F.col("site") != "").groupBy(F.lower("site").alias("site")).agg(
        count_rows().alias("total"), _tier("high").alias("high_compat")
    )
    return _best_first(out, "site")


def applications_timeline(postings: DataFrame, owner: str | None = None) -> DataFrame:
    """Applications per month, newest month first."""
    keys = [] if owner is not None else ["owning_user"]
    return (
        _of(postings, owner)
        .where((F.col("review_status") == "applied") & F.col("applied_at").isNotNull())
        .groupBy(*keys, F.date_format("applied_at", "yyyy-MM").alias("month"))
        .agg(count_rows().alias("applied"))
        .orderBy(*keys, F.desc("month"))
    )


def timeline_bars(timeline: DataFrame) -> DataFrame:
    """Bar widths against the owner's best month.

    The window holds one row per month of an owner, after aggregation.
    """
    best = F.max("applied").over(Window.partitionBy("owning_user"))
    return timeline.withColumn("bar", bar_width(100 * F.col("applied") / best))


def search_terms(postings: DataFrame, owner: str | None = None) -> DataFrame:
    """Distinct search terms in order, blanks left out."""
    keys = ["search_term"] if owner is not None else ["owning_user", "search_term"]
    return (
        _of(postings, owner).where(F.col("search_term") != "").select(*keys).distinct().orderBy(*keys)
    )


# --- token usage ----------------------------------------------------------------------------------


def usage_by_run(usage: DataFrame, call_type: str, ts: str = "timestamp") -> DataFrame:
    """Token sums per run for one call type, oldest run first; blank run ids form one group."""
    return (
        usage.where(F.col("call_type") == call_type)
        .groupBy("run_id")
        .agg(
            F.min(ts).alias("started_at"),
            count_rows().alias("call_count"),
            *[F.sum(f).cast("bigint").alias(f) for f in fv.USAGE_FIELDS],
        )
        .orderBy("started_at", "run_id")
    )


def usage_series(by_run: DataFrame, mode: str = "total") -> DataFrame:
    """Chart points in long form: run totals, or averages per call with one decimal."""
    started = F.date_format("started_at", "yyyy-MM-dd HH:mm")
    label = F.when(is_blank("run_id"), F.concat(started, F.lit(fv.NO_RUN_SUFFIX))).otherwise(started)

    def value(name: str) -> Column:
        total = F.coalesce(name, F.lit(0))
        if mode == "avg":
            return F.bround(total / F.greatest("call_count", F.lit(1)), 1).cast("double")
        return total.cast("double")

    wide = by_run.select(
        "run_id", "started_at", label.alias("label"), *[value(n).alias(t) for n, t in fv.USAGE_SERIES]
    )
    return wide.unpivot(
        ["run_id", "started_at", "label"], [t for _, t in fv.USAGE_SERIES], "measure", "value"
    )


def usage_summary(usage: DataFrame) -> DataFrame:
    """Calls and sums per run: the grand total (null call type) and one row per call type."""
    calls = usage.select("run_id", F.coalesce("call_type", F.lit("")).alias("call_type"),
                         *fv.USAGE_FIELDS, "duration_ms")
    return calls.groupingSets(
        [["run_id"], ["run_id", "call_type"]], "run_id", "call_type"
    ).agg(
        F.grouping("call_type").cast("int").alias("is_total"),
        count_rows().alias("call_count"),
        *[F.sum(f).cast("bigint").alias(f) for f in [*fv.USAGE_FIELDS, "duration_ms"]],
    )


# --- pipeline counters ---------------------------------------------------------------------------


def save_counts(totals: DataFrame) -> DataFrame:
    """Saved, without description and already stored, in one row.

    ``totals`` has the keys of a batch (``ingest.key_totals``). A repeat inside the batch counts as
    already stored, as it would be when its turn came.
    """
    saved = count_if(F.col("is_new"))
    return totals.agg(
        saved.alias("saved"),
        count_if(F.col("is_new") & ~F.col("has_description")).alias("no_description"),
        (F.sum("rows") - saved).cast("bigint").alias("already_stored"),
    )


def saved_by_board(totals: DataFrame) -> DataFrame:
    return totals.where("is_new").groupBy("site").agg(count_rows().alias("saved"))


def cache_counts(resolved: DataFrame) -> DataFrame:
    """Titles looked up, found in the cache and left for the scorer."""
    return resolved.agg(
        count_rows().alias("total"),
        F.count("score").cast("bigint").alias("exact"),
        (count_rows() - F.count("score")).cast("bigint").alias("llm"),
    )


def owners_with_configs(configs: DataFrame) -> DataFrame:
    return configs.where(F.col("owning_user") != "").select("owning_user").distinct()


def owners_with_keywords(profiles: DataFrame) -> DataFrame:
    """Owners whose default profile lists at least one keyword (JSON text or array)."""
    words = F.col("keywords")
    if dict(profiles.dtypes)["keywords"] == "string":
        words = list_text(words)
    return (
        profiles.where((F.col("is_default") == 1) & (F.col("owning_user") != "") & (F.size(words) > 0))
        .select("owning_user")
        .distinct()
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    counts = [
        df.agg(count_rows().alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts)


def folded_configs(configs: DataFrame) -> DataFrame:
    """Configurations by parameter group: one row per key.

    usajobs holds a single configuration, the last by company name.
    """
    usajobs = F.col("config_type") == "usajobs"
    keyed = configs.select(
        "owning_user",
        F.concat("config_type", F.lit("_params")).alias("params_key"),
        F.when(~usajobs, F.col("config_key")).alias("config_key"),
        F.struct("company_name", F.col("config_key").alias("key"), "config_json").alias("_row"),
    )
    last = keyed.groupBy("owning_user", "params_key", "config_key").agg(F.max("_row").alias("_row"))
    return last.select(
        "owning_user", "params_key", "config_key", map_text("_row.config_json").alias("config")
    )


def candidates_by_owner(candidates: DataFrame) -> DataFrame:
    """Candidates per owner and those skipped, with the reason."""
    return candidates.groupBy("owning_user", "skip_reason").agg(count_rows().alias("postings"))
