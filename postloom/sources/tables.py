"""Stored tables: typed reads, versioned snapshots, whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import schemas
from postloom.operators.analytics import count_rows


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A store table with its fixed schema; a column that older files lack gets its default."""
    df = spark.read.schema(schemas.STORE[name]).parquet(path)
    return fill_defaults(df, name)


def fill_defaults(df: DataFrame, name: str) -> DataFrame:
    defaults = schemas.DEFAULTS.get(name, {})
    return df.select(
        *[
            F.coalesce(F.col(c), F.lit(defaults[c]).cast(df.schema[c].dataType)).alias(c)
            if c in defaults
            else F.col(c)
            for c in df.columns
        ]
    )


def snapshot_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v={version:010d}"


def write_snapshot(
    df: DataFrame, root: str, version: int, partition_by: str | None = None
) -> str:
    """Write a new version of a table; an existing version is never replaced."""
    path = snapshot_path(root, version)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, version: int, name: str | None = None) -> DataFrame:
    path = snapshot_path(root, version)
    return read_table(spark, path, name) if name else spark.read.parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def table_report(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Row count of every store table in the catalog; a missing table has none."""
    out = None
    for name in names or list(schemas.STORE):
        there = spark.catalog.tableExists(name)
        rows = (
            spark.table(name).agg(count_rows().alias("rows"))
            if there
            else spark.sql("SELECT CAST(NULL AS BIGINT) AS rows")
        )
        one = rows.select(F.lit(name).alias("table_name"), F.lit(there).alias("present"), "rows")
        out = one if out is None else out.unionAll(one)
    return out


# --- documents ----------------------------------------------------------------------------------


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text and markdown files, one whole file per row."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def source_text(df: DataFrame, fetched: DataFrame, documents: DataFrame) -> DataFrame:
    """Text of each ``source``: a landed page for a url, a document for a path, else the text itself."""
    from postloom.functions.text import html_to_markdown

    pages = fetched.select(F.col("url").alias("source"), html_to_markdown("html").alias("_page"))
    files = documents.select(F.col("path").alias("source"), F.col("text").alias("_file"))
    return (
        df.join(pages, "source", "left")
        .join(files, "source", "left")
        .withColumn("text", F.coalesce("_file", "_page", "source"))
        .drop("_file", "_page")
    )


def files_newest_first(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .load(path)
        .select("path", "modificationTime", "length")
        .orderBy(F.desc("modificationTime"), F.asc("path"))
    )


RESUME_SUFFIXES = (".pdf", ".md", ".txt")


def newest_resume(spark: SparkSession, path: str) -> DataFrame:
    """The newest résumé file of a folder."""

    def wanted() -> Column:
        out = F.lit(False)
        for suffix in RESUME_SUFFIXES:
            out = out | F.col("path").endswith(suffix)
        return out

    files = spark.read.format("binaryFile").load(path).where(wanted())
    return files.agg(
        F.max_by("path", F.struct("modificationTime", "path")).alias("path"),
        F.max("modificationTime").alias("modified"),
    ).where(F.col("path").isNotNull())
