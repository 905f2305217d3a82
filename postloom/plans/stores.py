"""Queries that write rows of the supplied tables to the shared folder and read them back, and whole-page routes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators import ledger, ranking, scoring
from postloom.plans.registry import Source, query
from postloom.session import cut_lineage, shared_folder
from postloom.sources import exports, pages, tables


def _folder(s: Source, name: str) -> str:
    return f"{shared_folder(s.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "typed_table",
    """SELECT owning_user, role_normalized, title_normalized, score, 'llm' AS source, CAST(NULL AS VARCHAR) AS title_raw, CAST(date_updated AS TIMESTAMP) AS date_updated
    FROM <<title_score_cache>>""",
)
def typed_table(s: Source) -> DataFrame:
    """An older file without the later columns, read with the table's schema and defaults."""
    path = _folder(s, "cache")
    s.view("title_score_cache").withColumn("date_updated", F.col("date_updated").cast("timestamp")).write.parquet(path)
    return tables.read_table(s.spark, path, "title_score_cache").select(
        "owning_user", "role_normalized", "title_normalized", "score", "source", "title_raw", "date_updated"
    )


@query("whole_documents", "SELECT CAST(item_id AS VARCHAR) AS item, text || chr(10) AS text FROM <<benchmark>>")
def whole_documents(s: Source) -> DataFrame:
    path = _folder(s, "files")
    s.table("benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    found = tables.read_documents(s.spark, path)
    return found.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).alias("item"), "text")


@query(
    "json_export",
    """SELECT title, company, job_url AS url, strftime(date_posted, '%Y-%m-%d') AS date_posted, location,
    min_amount AS pay_min, max_amount AS pay_max FROM <<job_details>> WHERE title <> '' AND job_url <> ''""",
)
def json_export(s: Source) -> DataFrame:
    path = _folder(s, "json")
    jobs = s.view("job_details")
    exports.write_json(jobs, path, "all", "any")
    kind = exports.export_rows(jobs).schema
    return s.spark.read.schema(kind).json(f"{path}/jobs").select(
        "title", "company", "url", "date_posted", "location",
        F.col("compensation.min").alias("pay_min"), F.col("compensation.max").alias("pay_max"),
    )


_TITLE = "trim(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '\"', ''))"


@query(
    "routed_descriptions",
    f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN {_TITLE} WHEN 1 THEN '<div class="job__description">' || {_TITLE} || '</div>'
    WHEN 2 THEN {_TITLE} ELSE html END AS description FROM <<pages>>""",
)
def routed_descriptions(s: Source) -> DataFrame:
    title = F.trim(F.replace(F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit('"'), F.lit("")))
    kind = F.col("page_id") % 4
    url = (
        F.when(kind == 0, "https://www.linkedin.com/jobs/view/1")
        .when(kind == 1, "https://boards.greenhouse.io/x")
        .when(kind == 2, "https://www.dice.com/job-detail/1")
        .otherwise("https://jobs.example.com/1")
    )
    mark = (
        F.when(kind == 0, F.concat(F.lit('<div class="a description__text--rich">'), title, F.lit("</div>")))
        .when(kind == 1, F.concat(F.lit('<div class="job__description">'), title, F.lit("</div>")))
        .when(kind == 2, F.concat(F.lit('<script type="application/ld+json">{"description":"'), title, F.lit('"}</script>')))
        .otherwise("")
    )
    staged = s.table("pages").select("page_id", url.alias("url"), F.concat("html", mark).alias("html"))
    return pages.routed_description(staged).select("page_id", "description")


def _measure(prompt: str) -> tuple[str, dict[str, int]]:
    """A scorer that answers with the length of its prompt."""
    return f'{{"n":{len(prompt)}}}', {"total_tokens": len(prompt) % 97}


@query(
    "posting_scores",
    """SELECT doc_id AS id, '{"n":' || CAST(len(text) AS VARCHAR) || '}' AS answer, CAST(len(text) % 97 AS BIGINT) AS total_tokens
    FROM <<documents>>""",
)
def posting_scores(s: Source) -> DataFrame:
    prompts = s.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
    scored = scoring.score_postings(prompts, _measure)
    return scored.select("id", "answer", F.col("usage")["total_tokens"].alias("total_tokens"))


@query(
    "scores_resumed",
    """SELECT doc_id AS id, '{"n":' || CAST(len(text) AS VARCHAR) || '}' AS answer, CAST(1 AS BIGINT) AS asked FROM <<documents>>""",
)
def scores_resumed(s: Source) -> DataFrame:
    """Scoring that was broken off and began again: every text is asked about once, and the ledger says so."""
    folder = _folder(s, "ledger")
    prompts = s.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
    # the first attempt got as far as the texts of some languages
    scoring.score_postings(prompts.join(s.table("documents").where("lang <> 'en'").select(F.col("doc_id").alias("id")), "id"), _measure, folder).count()
    scored = cut_lineage(scoring.score_postings(prompts, _measure, folder), "scored")
    asked = ledger.entries(s.spark, folder).groupBy("key").agg(F.count(F.lit(1)).alias("asked"))
    keyed = prompts.select("id", ledger.content_key("prompt").alias("key")).join(asked, "key")
    return scored.select("id", "answer").join(keyed.select("id", "asked"), "id")


@query(
    "newest_documents",
    """SELECT CAST(item_id AS VARCHAR) AS item, item_id % 2 = 0 AS landed_last,
      count(*) FILTER (WHERE item_id % 2 = 0) OVER () AS landed FROM <<benchmark>>""",
)
def newest_documents(s: Source) -> DataFrame:
    """Files landed in two steps, newest first; the newest résumé is one of the second step."""
    path = _folder(s, "newest")
    items = s.table("benchmark").select("item_id", "text")
    for odd in (1, 0):
        items.where(F.col("item_id") % 2 == odd).write.mode("append").partitionBy("item_id").text(path)
    item = F.regexp_extract("path", "item_id=([0-9]+)", 1)
    listed = ranking.places(tables.files_newest_first(s.spark, path)).select(item.alias("item"), "place")
    last = items.where("item_id % 2 = 0").select(F.count(F.lit(1)).alias("landed"))
    newest = tables.newest_resume(s.spark, path).select((item.cast("long") % 2 == 0).alias("of_second"))
    # both are one row
    landed, of_second = last.first()[0], newest.first()[0]
    return listed.select(
        "item", ((F.col("place") < landed) & F.lit(of_second)).alias("landed_last"), F.lit(landed).cast("long").alias("landed")
    )
