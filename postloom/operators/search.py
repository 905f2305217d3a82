"""Searching postings and tracked applications."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import fixed_values as fv
from postloom.functions import pay, results
from postloom.functions.dates import day
from postloom.functions.text import truthy

# --- filters ----------------------------------------------------------------------------


def _wanted(value: str | None) -> bool:
    return bool(value) and value != "all"


def matches_keyword(keyword: str, *columns: str) -> Column:
    """The keyword inside any of the columns, ignoring case; ``%`` and ``_`` are wildcards."""
    out = F.lit(False)
    for name in columns or ("title", "company"):
        out = out | F.col(name).ilike(f"%{keyword}%")
    return out


def posted_since(date_range: str | None, as_of: dt.date | str | Column) -> Column | None:
    """Cutoff on the posting date; an unknown range word means no cutoff."""
    days = fv.DATE_RANGE_DAYS.get(date_range or "")
    return None if days is None else F.col("date_posted") >= F.date_sub(day(as_of), days)


def by_date_range(postings: DataFrame, as_of: dt.date | str | Column) -> DataFrame:
    """Postings once for each range word whose range they are in, as ``date_range``."""
    words = [F.when(posted_since(w, as_of), F.lit(w)) for w in fv.DATE_RANGE_DAYS]
    return postings.withColumn("date_range", F.explode(F.array_compact(F.array(*words))))


def search_postings(
    postings: DataFrame,
    owner: str,
    as_of: dt.date | str | Column,
    keyword: str = "",
    date_range: str = "all",
    compatibility: str = "",
    clearance: str = "",
    review_status: str = "",
) -> DataFrame:
    """Postings of an owner under the given filters; ``''`` and ``'all'`` mean no filter."""
    out = postings.where(F.col("owning_user") == owner)
    since = posted_since(date_range, as_of)
    if since is not None:
        out = out.where(since)
    if clearance in ("required", "not_required"):
        out = out.where(F.col("security_clearance_required") == int(clearance == "required"))
    if _wanted(review_status):
        out = out.where(F.col("review_status") == review_status)
    if _wanted(compatibility):
        out = out.where(F.col("title_compatibility_score") == compatibility)
    if keyword:
        out = out.where(matches_keyword(keyword))
    return out


def default_search(postings: DataFrame, owner: str, as_of: dt.date | str | Column) -> DataFrame:
    """The view a search starts with: last week, high, no clearance, not reviewed, by score."""
    found = search_postings(
        postings, owner, as_of, date_range="1week", compatibility="high",
        clearance="not_required", review_status="not_reviewed",
    )
    return found.orderBy(*posting_order("score"))


def saved_postings(
    postings: DataFrame, owner: str, as_of: dt.date | str | Column, keyword: str = ""
) -> DataFrame:
    return search_postings(postings, owner, as_of, keyword=keyword, review_status="saved")


def lookup(df: DataFrame, **keys: object) -> DataFrame:
    """Rows with exactly these key values; the equality reaches the file scan."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def rule_matches(
    date_posted: str, companies: Sequence[str], title: str, status: str = "rejected"
) -> Column:
    """Predicate of a bulk rule; a null status counts as different from the named one."""
    company = F.lit(False)
    for pattern in companies:
        company = company | F.col("company").ilike(pattern)
    return (
        (F.col("date_posted") == F.lit(date_posted).cast("date"))
        & company
        & F.col("title").ilike(title)
        & ~F.col("review_status").eqNullSafe(status)
    )


def without_blobs(df: DataFrame) -> DataFrame:
    """Every column that is not binary."""
    return df.select(*[name for name, kind in df.dtypes if kind != "binary"])


# --- status history -----------------------------------------------------------------------


def latest_status(history: DataFrame) -> DataFrame:
    """Newest status per posting: last date, then last id.

    An aggregate, not a ranking: the map side keeps one row per posting, so one posting with very
    many events costs no more than any other.
    """
    newest = F.max(F.struct("changed_at", "id", "status")).alias("newest")
    return history.groupBy("applied_job_id").agg(newest).select(
        "applied_job_id",
        F.col("newest.id").alias("history_id"),
        F.col("newest.status").alias("status"),
        F.col("newest.changed_at").alias("changed_at"),
    )


def applied_with_status(postings: DataFrame, history: DataFrame) -> DataFrame:
    """Applied postings with their newest status; without history they count as submitted."""
    applied = postings.where(F.col("review_status") == "applied")
    newest = latest_status(history).select(
        F.col("applied_job_id").alias("id"),
        F.col("status").alias("_status"),
        F.col("changed_at").alias("last_status_date"),
    )
    return applied.join(newest, "id", "left").withColumn(
        "current_status_latest", F.coalesce("_status", F.lit("submitted"))
    ).drop("_status")


def search_applied(
    postings: DataFrame,
    history: DataFrame,
    owner: str,
    keyword: str = "",
    status: str = "",
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Applied postings of an owner by keyword and newest status."""
    mine = postings.where((F.col("owning_user") == owner) & (F.col("review_status") == "applied"))
    if keyword:
        mine = mine.where(matches_keyword(keyword))
    # one owner's events are a small part of the history: leave the rest out before ranking it
    asked = mine.select(F.col("id").alias("applied_job_id"))
    out = applied_with_status(mine, history.join(asked, "applied_job_id", "left_semi"))
    if _wanted(status):
        out = out.where(F.col("current_status_latest") == status)
    if exclude:
        out = out.where(~F.col("current_status_latest").isin(list(exclude)))
    return out


def open_applications(
    postings: DataFrame, history: DataFrame, owner: str, keyword: str = ""
) -> DataFrame:
    return search_applied(postings, history, owner, keyword, exclude=fv.TERMINAL_STATUSES)


def status_timeline(history: DataFrame) -> DataFrame:
    """History per posting, newest first.

    A global sort on the full key: range partitions may split one posting's events, so a very
    long history is not held by one task.
    """
    return history.orderBy("applied_job_id", F.desc("changed_at"), F.desc("id"))


# --- orders and pages ------------------------------------------------------------------------

_POSTING_ORDERS = {
    "date_posted": [F.desc_nulls_last, "date_posted"],
    "score": [F.desc_nulls_last, "job_score"],
    "title": [F.asc_nulls_first, "title"],
    "company": [F.asc_nulls_first, "company"],
}
_APPLIED_ORDERS = {
    "recent_activity": [
        (F.desc_nulls_last, "last_status_date"), (F.desc_nulls_last, "applied_at"),
    ],
    "applied_at": [(F.desc_nulls_last, "applied_at")],
    "title": [(F.asc_nulls_first, "title")],
    "company": [(F.asc_nulls_first, "company")],
}


def posting_order(sort_by: str) -> list[Column]:
    """Sort of a posting list; an unknown word sorts by date. The id breaks ties."""
    how, name = _POSTING_ORDERS.get(sort_by, _POSTING_ORDERS["date_posted"])
    return [how(name), F.asc("id")]


def applied_order(sort_by: str) -> list[Column]:
    keys = _APPLIED_ORDERS.get(sort_by, _APPLIED_ORDERS["applied_at"])
    return [*[how(name) for how, name in keys], F.asc("id")]


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = fv.PAGE_SIZE) -> DataFrame:
    """One page of a sorted list. Each task keeps only the rows up to the end of the page."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_summary(df: DataFrame, size: int = fv.PAGE_SIZE) -> DataFrame:
    """Total, pages and count label of a filtered list as one row."""
    total = F.col("total")
    label = F.concat(
        total.cast("string"), F.when(total == 1, F.lit(" job")).otherwise(F.lit(" jobs")),
        F.when(total > size, F.lit(f" (showing first {size})")).otherwise(F.lit("")),
    )
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        total,
        F.ceil(total / size).cast("bigint").alias("pages"),
        (total > size).alias("has_more"),
        label.alias("count_label"),
    )


def cards(postings: DataFrame) -> DataFrame:
    """Display columns of a posting list."""
    score = F.coalesce("job_score", F.lit(0))
    return postings.select(
        "id",
        "title",
        "company",
        pay.salary_text("min_amount", "max_amount", "currency").alias("salary"),
        (F.coalesce("security_clearance_required", F.lit(0)) == 1).alias("needs_clearance"),
        score.alias("score"),
        results.score_band(score).alias("score_band"),
        F.coalesce("title_compatibility_score", F.lit("")).alias("compatibility"),
        F.coalesce("review_status", F.lit("not_reviewed")).alias("review_status"),
        F.date_format("date_posted", "yyyy-MM-dd").alias("date_posted"),
        truthy("is_remote").alias("is_remote"),
        results.decision("job_score_json").alias("decision"),
        results.travel("job_score_json").alias("travel"),
    )
