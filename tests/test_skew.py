"""One key with a third of all rows: results stay whole and the key is split or combined early."""

import pytest
from pyspark.sql import functions as F

from postloom.operators import ingest as ig
from postloom.operators import search as se
from postloom.operators import titles as ti
from postloom.streaming import parts

ROWS = 120_000


@pytest.fixture
def forced(spark):
    """No broadcast, and skew thresholds low enough for a small fixture."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot_rows(spark):
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000)
    return spark.range(0, ROWS, 1, 8).withColumn("k", key)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_title_is_split(forced):
    postings = hot_rows(forced).select(
        "id", F.concat(F.lit("title "), F.col("k")).alias("title"), F.lit("o").alias("owning_user"),
        F.sha2(F.col("id").cast("string"), 256).alias("description"),
    )
    scores = ti.unique_titles(postings, "owning_user").withColumn("score", F.lit("high"))
    out = ti.attach_scores(postings, scores, ["owning_user", "title"])
    assert "skew=true" in final_plan(out)
    assert out.count() == ROWS
    assert out.where("title_compatibility_score = 'high'").count() == ROWS


def test_hot_url_is_limited_before_the_exchange(forced):
    incoming = hot_rows(forced).select(
        F.col("id").alias("arrival_id"), F.concat(F.lit("u"), F.col("k")).alias("job_url"),
        F.lit("o").alias("owning_user"),
    )
    stored = forced.range(10).select(
        F.concat(F.lit("u"), F.col("id")).alias("job_url"), F.lit("o").alias("owning_user")
    )
    fresh = ig.new_postings(incoming, stored, F.asc("arrival_id"))
    keys = incoming.select("job_url").distinct().count()
    assert fresh.count() == keys - 10
    assert "WindowGroupLimit" in final_plan(fresh)


def test_hot_posting_history(forced):
    history = hot_rows(forced).select(
        F.col("id"), F.col("k").alias("applied_job_id"), F.concat(F.lit("s"), F.col("id")).alias("status"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("changed_at"),
    )
    newest = se.latest_status(history)
    best = newest.where("applied_job_id = 0").first()
    want = history.where("applied_job_id = 0").orderBy(F.desc("changed_at"), F.desc("id")).first()
    assert best["history_id"] == want["id"]
    # the long history is sorted by several tasks
    parts = se.status_timeline(history).where("applied_job_id = 0").select(F.spark_partition_id().alias("p"))
    assert parts.distinct().count() > 1


def test_work_list_of_one_owner_is_made_in_many_tasks(spark):
    profiles = spark.range(0, 600, 1, 2).select(
        F.lit("ann").alias("owning_user"), F.lit("Reston").alias("location"), F.lit(1).alias("is_default"), F.array(F.lit("a"), F.lit("b")).alias("keywords")
    )
    configs = spark.range(30).select(F.lit("ann").alias("owning_user"), F.lit("workday").alias("config_type"), F.col("id").cast("string").alias("config_key"))
    made = ig.work_list(profiles, configs).where("site = 'workday'")
    assert made.count() == 600 * 2 * 30
    assert made.groupBy("search_term", "site_config").count().where("count <> 600").count() == 0
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 600 * 2 * 30 / 2


def test_a_large_bucket_is_written_by_many_tasks(forced, tmp_path):
    rows = forced.range(0, ROWS, 1, 8).select("id", F.lit(3).alias("bucket"))
    parts.write(rows, str(tmp_path), 0, by="bucket")
    assert len(list(tmp_path.rglob("bucket=3/part-*.parquet"))) >= 4
    assert forced.read.parquet(parts.path_of(str(tmp_path), (0, 0))).count() == ROWS


def test_reject_words_are_sent_as_one_text(spark, monkeypatch):
    sent = []
    context = type(spark.sparkContext)
    real = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(value) or real(self, value))
    words = spark.range(3000).select(F.concat(F.lit("ann"), (F.col("id") % 2).cast("string")).alias("owning_user"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("word"))
    jobs = spark.createDataFrame([(1, "ann1", "A WORD 77"), (2, "ann0", "a word 77"), (3, "ann0", None)], "id long, owning_user string, title string")
    assert sorted((r["id"], r["rejected"]) for r in ti.rejected_by_owner(jobs, words).collect()) == [(1, True), (2, False), (3, False)]
    text, _, _, owners = sent[0]
    assert isinstance(text, bytes) and len(text) < 3000 * 10 and len(owners) == 2
