"""A costly service is asked once for each content, also when a task dies half way."""

import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from postloom.operators import ledger, scoring
from postloom.operators import titles as ti
from postloom.session import shared_folder
from postloom.sources import files


def requests(spark, n):
    rows = spark.range(n).select(F.concat(F.lit("text "), (F.col("id") % (n // 2)).cast("string")).alias("text"))
    return rows.withColumn("key", ledger.content_key("text"))


def test_a_task_that_dies_goes_on_where_it_was(spark, tmp_path):
    calls, broken = tmp_path / "calls", tmp_path / "broken"

    def ask(rows):
        if len(calls.read_text().splitlines()) >= 20 and not broken.exists():
            broken.write_text("x")
            raise RuntimeError("the service is gone")
        with open(calls, "a") as log:
            log.writelines(f"{r['text']}\n" for r in rows)
        return [r["text"].upper() for r in rows]

    calls.write_text("")
    wanted = requests(spark, 120)
    with pytest.raises(Exception, match="the service is gone"):
        ledger.answers(wanted, ask, str(tmp_path / "ledger"), batch=4, buckets=3).collect()
    before = len(calls.read_text().splitlines())
    assert 20 <= before < 60
    found = ledger.answers(wanted, ask, str(tmp_path / "ledger"), batch=4, buckets=3).collect()
    assert len(found) == 60 and {r["answer"] for r in found} == {f"TEXT {i}" for i in range(60)}
    asked = calls.read_text().splitlines()
    assert len(asked) == len(set(asked)) == 60
    # and nothing is asked again
    assert ledger.answers(wanted, ask, str(tmp_path / "ledger"), batch=4, buckets=3).count() == 60
    assert calls.read_text().splitlines() == asked
    assert ledger.entries(spark, str(tmp_path / "ledger")).count() == 60


def test_half_written_entries_do_not_count_and_first_of_two_does(spark, tmp_path):
    wanted = requests(spark, 2)
    key = wanted.first()["key"]
    folder = tmp_path / "ledger" / "bucket=0"
    folder.mkdir(parents=True)
    (folder / "c.jsonl.writing").write_text('{"key": "')
    (folder / "b.jsonl").write_text(f'{{"key": "{key}", "answer": "second"}}\n')
    (folder / "a.jsonl").write_text(f'{{"key": "{key}", "answer": "first"}}\n')
    found = ledger.answers(wanted, lambda rows: [None for _ in rows], str(tmp_path / "ledger"), buckets=1).collect()
    assert [r["answer"] for r in found] == ["first"]


def test_what_has_no_answer_is_asked_again(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    assert ledger.answers(requests(spark, 8), lambda rows: [None for _ in rows], folder).count() == 0
    assert ledger.answers(requests(spark, 8), lambda rows: ["x" for _ in rows], folder).count() == 4


def test_title_scores_are_kept_over_runs(spark, tmp_path):
    missing = spark.createDataFrame(
        [("a", "R", "Cook", "r", "cook"), ("b", "R", "Cook", "r", "cook"), ("a", None, "Cook", None, "cook")],
        "owning_user string, desired_role string, title string, role_normalized string, title_normalized string",
    )
    log = tmp_path / "asked"
    log.write_text("")

    def scorer(titles, role):
        with open(log, "a") as out:
            out.writelines(f"{role}/{t}\n" for t in titles)
        return [{"job_title": t, "score": f"score {role}"} for t in titles]

    for _ in range(2):
        rows = ti.score_misses(missing, scorer, ledger=str(tmp_path / "ledger")).collect()
        assert sorted((r["owning_user"], r["desired_role"] or "", r["score"]) for r in rows) == [
            ("a", "", "score "), ("a", "R", "score R"), ("b", "R", "score R"),
        ]
    assert sorted(log.read_text().split("\n")[:-1]) == ["/Cook", "R/Cook"]


def test_posting_answers_keep_their_usage(spark, tmp_path):
    prompts = spark.createDataFrame([(1, 'say "x"\n'), (2, 'say "x"\n'), (3, None)], "id long, prompt string")
    found = scoring.score_postings(prompts, lambda p: (f"<{p}>", {"total_tokens": 3} if p else None)).collect()
    assert sorted((r["id"], r["answer"], r["usage"]) for r in found) == [
        (1, '<say "x"\n>', {"total_tokens": 3}), (2, '<say "x"\n>', {"total_tokens": 3}), (3, "<None>", {}),
    ]


def test_a_cluster_may_name_its_shared_folder_without_a_scheme(spark, tmp_path):
    """A stand-in for a session on a cluster; the store it asks is this machine's."""
    conf = SimpleNamespace(get=lambda name, default=None: str(tmp_path / "kept"))
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://head:7077"), _jvm=spark._jvm, _jsc=spark._jsc)
    assert files.qualified(cluster, f"{shared_folder(cluster)}/ledger") == f"file://{tmp_path}/kept/ledger"
    # a folder that nobody called shared is refused as before
    with pytest.raises(ValueError, match="folder of this machine"):
        files.qualified(cluster, str(tmp_path / "other"))


def test_a_written_table_leaves_no_shuffle_files(spark):
    from postloom.session import CLEANUP, cut_lineage

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in found.split("\n") if "/shuffle_" in f}

    before, setting = files(), spark.conf.get(CLEANUP, None)
    # the frame is held, so that no garbage collection frees its files
    rows = spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()
    assert len(cut_lineage(rows).collect()) == 10
    until = time.monotonic() + 20
    while files() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(CLEANUP, None) == setting
