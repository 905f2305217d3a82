"""Small fixed dimension tables. Their size is set by code, never by data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postloom import fixed_values as fv


def countries(spark: SparkSession) -> DataFrame:
    rows = [
        (key, code, names[0])
        for code, names, iso in fv.COUNTRIES
        for key in dict.fromkeys([*names, iso])
    ]
    return spark.createDataFrame(rows, "country_key string, country string, name string")


def statuses(spark: SparkSession) -> DataFrame:
    rows = [
        (i, code, label, code in fv.TERMINAL_STATUSES)
        for i, (code, label) in enumerate(fv.APPLICATION_STATUSES)
    ]
    return spark.createDataFrame(
        rows, "position int, status string, label string, is_terminal boolean"
    )


def resume_sections(spark: SparkSession) -> DataFrame:
    rows = [
        (i, section, j, key, label)
        for i, (section, fields) in enumerate(fv.RESUME_SECTIONS)
        for j, (key, label) in enumerate(fields)
    ]
    return spark.createDataFrame(
        rows, "section_no int, section string, category_no int, category string, label string"
    )


def with_dimension(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Left join to one of the tables above; the planner sends it to all tasks by its own size check."""
    return df.join(dim, df[key] == dim[dim_key], "left").drop(dim[dim_key])
