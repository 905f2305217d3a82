"""Rules for dates. The clock is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.expr import col, strip


def day(as_of: Column | str | dt.date) -> Column:
    """The run date as a date column, from a date, an ISO text or a column."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def epoch_ms_date(c: Column | str) -> Column:
    return F.timestamp_millis(col(c).cast("bigint")).cast("date")


def epoch_s_date(c: Column | str) -> Column:
    """Date of epoch seconds; zero and null have none."""
    return F.when(col(c) != 0, F.timestamp_seconds(col(c)).cast("date"))


def iso_date(c: Column | str) -> Column:
    """Date of an ISO date or date-time text, in the text's own offset."""
    text = strip(c)
    return F.coalesce(
        F.when(
            text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}){0,2}([.,]\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"),
            F.try_to_date(F.left(text, F.lit(10)), "yyyy-MM-dd"),
        ),
        F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")),
    )


def plain_date(c: Column | str) -> Column:
    """``yyyy-MM-dd`` or null."""
    return F.when(col(c).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(col(c), "yyyy-M-d"))


def first_token_date(c: Column | str) -> Column:
    """Date of the first blank-separated token, null when it is no date."""
    return plain_date(F.substring_index(strip(c), " ", 1))


def aged_date(days: Column | str, as_of: Column | str | dt.date) -> Column:
    """Date ``days`` before the run date; null when the age is unknown."""
    return F.date_sub(day(as_of), col(days).cast("int"))


def date_or_today(c: Column | str, as_of: Column | str | dt.date) -> Column:
    return F.coalesce(col(c), day(as_of))
