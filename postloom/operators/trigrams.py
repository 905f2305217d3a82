"""Keyword search by an index of letter trigrams.

A keyword of three letters or more can only be in a text that has all its trigrams. The index lists for every trigram the
postings that have it in title or company; the lists of a keyword's rarest trigrams are intersected, and what is left
is verified by the search's own rule. Keywords without three letters in a row are searched by a scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.search import matches_keyword

#: Folders of the index: a lookup reads those of its trigrams.
BUCKETS = 64
#: Lists that are intersected; the others would leave little less to verify.
LISTS = 3
COLUMNS = ("title", "company")


def _grams(text: Column) -> Column:
    """Distinct trigrams of a text without case; none where it is shorter or null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    starts = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(3))))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(postings: DataFrame, path: str) -> None:
    """Write the index of ``postings`` (``id``, title, company), a folder for each bucket of trigrams."""
    grams = F.array_distinct(F.concat(*[_grams(F.col(c)) for c in COLUMNS]))
    rows = postings.select("id", F.explode(grams).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    # salted, so that a trigram of very many postings is not one task's work; sorted, so that its rows lie together
    salt = F.pmod(F.xxhash64("id"), F.lit(8))
    rows.repartition("bucket", salt).sortWithinPartitions("gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def keyword_grams(spark: SparkSession, keyword: str) -> list[str]:
    """Trigrams that every match of a keyword has: those of its parts between the wildcards."""
    parts = [p for p in re.split(r"[%_\\]", keyword) if len(p) >= 3]
    if not parts:
        return []
    # cut by the same rule as the texts
    made = spark.sql("SELECT 1").select(F.explode(F.array_distinct(F.concat(*[_grams(F.lit(p)) for p in parts]))).alias("gram"))
    return sorted(r["gram"] for r in made.collect())


def _listed(spark: SparkSession, path: str, grams: Sequence[str]) -> DataFrame:
    there = spark.read.schema("id long, gram string, bucket int").parquet(path)
    buckets = spark.sql("SELECT 1").select(F.explode(F.array(*[_bucket(F.lit(g)) for g in grams]))).distinct().collect()
    return there.where(F.col("bucket").isin([b[0] for b in buckets]) & F.col("gram").isin(list(grams)))


def candidates(spark: SparkSession, path: str, keyword: str) -> DataFrame | None:
    """Ids of the postings that may match, or None for a keyword that only a scan can search."""
    grams = keyword_grams(spark, keyword)
    if not grams:
        return None
    sizes = {r["gram"]: r["n"] for r in _listed(spark, path, grams).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    rarest = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:LISTS]
    met = _listed(spark, path, rarest).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return met.where(F.col("n") == len(rarest)).select("id")


def search(postings: DataFrame, path: str, keyword: str) -> DataFrame:
    """Postings with the keyword in title or company, as ``search_postings`` finds them."""
    found = candidates(postings.sparkSession, path, keyword)
    near = postings if found is None else postings.join(found, "id", "left_semi")
    return near.where(matches_keyword(keyword)) if keyword else near
