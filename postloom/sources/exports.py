"""JSON and CSV exports of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_rows(postings: DataFrame) -> DataFrame:
    """Postings as export objects; a row without title or url is left out."""
    has_pay = F.col("min_amount").isNotNull() | F.col("max_amount").isNotNull()
    return postings.where((F.col("title") != "") & (F.col("job_url") != "")).select(
        "title",
        "company",
        F.col("job_url").alias("url"),
        F.date_format("date_posted", "yyyy-MM-dd").alias("date_posted"),
        F.when(
            has_pay, F.struct(F.col("min_amount").alias("min"), F.col("max_amount").alias("max"))
        ).alias("compensation"),
        "location",
    )


def incomplete_rows(postings: DataFrame) -> DataFrame:
    """What the export leaves out, and why."""
    titled = F.coalesce(F.col("title") != "", F.lit(False))
    linked = F.coalesce(F.col("job_url") != "", F.lit(False))
    return postings.where(~(titled & linked)).select(
        "title", "job_url", F.when(~titled, "no title").otherwise("no url").alias("reason")
    )


def export_metadata(rows: DataFrame, site: str, search_term: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).cast("bigint").alias("total_jobs")).select(
        F.lit(site).alias("site"), F.lit(search_term).alias("search_term"), "total_jobs"
    )


def write_json(postings: DataFrame, path: str, site: str, search_term: str) -> None:
    """Objects under ``jobs`` and one metadata row under ``metadata``; files stay one per task."""
    rows = export_rows(postings)
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/jobs")
    export_metadata(rows, site, search_term).write.mode("errorifexists").json(f"{path}/metadata")


def write_csv(postings: DataFrame, path: str) -> None:
    """Every value quoted, backslash as the escape sign."""
    (
        postings.write.mode("errorifexists")
        .option("header", "true")
        .option("quoteAll", "true")
        .option("escape", "\\")
        .csv(path)
    )
