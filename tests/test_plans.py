"""Plans: what is pushed down, what is combined before a shuffle, and what never happens."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from postloom.operators import search as se
from postloom.operators.ranking import keep_first


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_is_limited_before_the_exchange(source):
    text = plan(keep_first(source.view("incoming_postings"), ["job_url", "owning_user"], F.asc("arrival_id")))
    before = text.index("WindowGroupLimit", text.index("Exchange hashpartitioning(job_url"))
    assert "Partial" in text[before : before + 200]


def test_latest_status_combines_before_the_exchange(source):
    text = plan(se.latest_status(source.table("lineitem").selectExpr(
        "l_orderkey AS applied_job_id", "l_partkey AS id", "l_returnflag AS status", "l_shipdate AS changed_at"
    )))
    assert "partial_max" in text and "Window" not in text


def test_filters_and_columns_reach_the_scan(spark, folder, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    path = str(tmp_path / "jobs")
    entry.queries()["search_postings"](spark, folder).coalesce(1).write.parquet(path)
    jobs = spark.read.parquet(path)
    found = se.search_postings(jobs, "FURNITURE", "2001-08-01", date_range="1week", clearance="required")
    text = plan(found.select("id"))
    pushed = text[text.index("PushedFilters") :]
    for part in ("EqualTo(owning_user,FURNITURE)", "GreaterThanOrEqual(date_posted", "EqualTo(security_clearance_required,1)"):
        assert part in pushed
    schema = pushed[pushed.index("ReadSchema") :].split("\n")[0]
    assert "title" not in schema and "job_score" not in schema


def test_store_side_of_the_duplicate_check_is_narrow(source):
    from postloom.operators import ingest as ig

    text = ig.new_postings(
        source.view("incoming_postings"), source.view("described_jobs"), F.asc("arrival_id")
    )._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in text and "description" not in text


def test_page_keeps_only_its_rows(source):
    found = se.search_postings(source.view("job_details"), "FURNITURE", "2001-08-01")
    assert "TakeOrderedAndProject" in plan(se.page(found, se.posting_order("score"), 2))


def test_save_counts_take_few_exchanges(source):
    from postloom.plans.catalog import QUERIES

    frame = QUERIES["save_counts"](source)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") + final.count("Exchange SinglePartition") <= 6


def test_history_of_all_forms_is_not_broadcast(source):
    from postloom.plans.catalog import QUERIES

    text = plan(QUERIES["manual_history"](source))
    assert "SortMergeJoin" in text and "Broadcast" not in text


@pytest.mark.parametrize("board", ["eightfold", "oraclecloud", "workday"])
def test_details_of_all_cards_are_not_broadcast(source, board):
    from postloom.plans.catalog import QUERIES

    text = plan(QUERIES[f"board_{board}"](source))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_details_are_dealt_before_they_are_sorted(spark, source):
    from postloom.sources.payloads import one_detail

    rows = [("u1", 2, "late"), ("u1", 1, "b"), ("u1", 1, "a"), ("u2", None, "none"), ("u2", 7, "seven"), (None, 3, "x")]
    details = spark.createDataFrame(rows, "url string, payload_id long, payload string")
    first = one_detail(details, "url")
    text = plan(first)
    # read upwards: the rows are dealt by content, then sorted for the limit, then moved by key
    assert text.index("Exchange hashpartitioning(url") < text.index("WindowGroupLimit [url", text.index("Exchange hashpartitioning(url"))
    assert text.rindex("Sort [url") < text.index("Exchange hashpartitioning(payload_id")
    assert sorted(map(tuple, first.collect()), key=str) == sorted([("u1", 1, "a"), ("u2", None, "none"), (None, 3, "x")], key=str)
