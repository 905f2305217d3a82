"""Indexes, pages and automata give what a scan gives."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postloom.operators import paging, ranking, search, trigrams
from postloom.operators import titles as ti
from postloom.operators.paging import Key


@pytest.mark.parametrize("keyword", ["eng", "ENGINEER", "a_b", "100%", "ngi%eer", "é_ü", "ab", "", "%%%", "'quote", "data  eng", "straße", "\\"])
def test_trigrams_equal_the_scan(spark, tmp_path, keyword):
    rng = random.Random(5)
    words = ["Data", "engineer", "ENGINE", "éÜ", "aXb", "a_b", "100%", "'quote", "Straße", "x\\y", "", "ngineer", "İstanbul"]
    rows = [(i, rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randrange(4)))]), rng.choice(words)) for i in range(120)]
    jobs = spark.createDataFrame(rows, "id long, title string, company string")
    trigrams.write_index(jobs, str(tmp_path / "index"))
    expected = jobs.where(search.matches_keyword(keyword)) if keyword else jobs
    found = trigrams.search(jobs, str(tmp_path / "index"), keyword)
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in expected.collect())


def test_a_lookup_reads_its_buckets_only(spark, tmp_path):
    jobs = spark.range(500).select("id", F.concat(F.lit("role "), F.hex("id")).alias("title"), F.lit("company").alias("company"))
    trigrams.write_index(jobs, str(tmp_path / "index"))
    listed = trigrams._listed(spark, str(tmp_path / "index"), ["rol"])
    assert listed.select(F.input_file_name()).distinct().count() <= 8
    assert re.search(r"PartitionFilters: \[[^]]*bucket", listed._jdf.queryExecution().executedPlan().toString())


ORDERS = [
    [Key("a"), Key("id")],
    [Key("a", descending=True, nulls_last=True), Key("b", nulls_last=True), Key("id", descending=True)],
    [Key("a", nulls_last=True), Key("b", descending=True), Key("id")],
]


def listed(spark, n=157):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a int, b string").repartition(7)


@pytest.mark.parametrize("keys", ORDERS)
def test_pages_joined_equal_the_whole_order(spark, keys):
    rows = listed(spark)
    whole = [r["id"] for r in rows.orderBy(*[k.order() for k in keys]).collect()]
    found, last = [], None
    while page := paging.page_after(rows, keys, last, 20).collect():
        found += [r["id"] for r in page]
        last = page[-1].asDict()
    assert found == whole
    ranged = paging.Ranged(rows, keys)
    assert [r["id"] for n in range(1, 10) for r in ranged.page(n, 20).collect()] == whole


def test_a_deep_page_reads_its_ranges_and_keeps_a_page(spark):
    rows = spark.range(40_000).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("int").alias("a"))
    ranged = paging.Ranged(rows, [Key("a"), Key("id")])
    assert len(ranged.counts) > 3
    ranges, before = ranged.holding(30_000, 30_019)
    assert len(ranges) <= 2 and before > 20_000
    expected = [r["id"] for r in rows.orderBy("a", "id").offset(30_000).limit(20).collect()]
    assert [r["id"] for r in ranged.page(1501, 20).collect()] == expected
    assert ranged.page(99_999, 20).collect() == []
    deep = paging.page_after(rows, [Key("a"), Key("id")], {"a": 900, "id": 0}, 20)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=20" in plan and "offset" not in plan.lower()


@pytest.mark.parametrize("keys", ORDERS)
def test_a_long_page_is_in_no_single_task(spark, keys, monkeypatch):
    monkeypatch.setattr(paging, "MOST_IN_TASK", 50)
    # every row twice, so that a page may end between equal rows
    rows = listed(spark).union(listed(spark))
    whole = [r["id"] for r in rows.orderBy(*[k.order() for k in keys]).collect()]
    first = paging.page_after(rows, keys, None, 101)
    assert sorted(r["id"] for r in first.collect()) == sorted(whole[:101])
    text = first._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in text and "SinglePartition" not in text and "Limit" not in text
    last = next(r.asDict() for r in rows.collect() if r["id"] == whole[100])
    assert sorted(r["id"] for r in paging.page_after(rows, keys, last, 60).collect()) == sorted([i for i in whole if i not in whole[:101]][:60])


def test_numbered_equals_row_numbers(spark):
    rows = listed(spark, 400)
    found = ranking.numbered(rows, [F.asc("a"), F.desc("id")]).collect()
    assert {r["place"] for r in found} == set(range(400))
    whole = [r["id"] for r in rows.orderBy(F.asc("a"), F.desc("id")).collect()]
    assert [r["id"] for r in sorted(found, key=lambda r: r["place"])] == whole
    assert ranking.numbered(rows.limit(0), [F.asc("a")]).collect() == []


def test_deep_slice_equals_the_window_and_spreads_a_hot_search(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("search"), "id", F.pmod(F.xxhash64("id"), F.lit(99)).alias("score")
    )
    order = [F.desc("score"), F.asc("id")]
    window = ranking.board_slice(rows, ["search"], order, 30, 300)
    deep = ranking.deep_slice(rows, ["search"], order, 30, 300)
    assert sorted(map(str, deep.collect())) == sorted(map(str, window.collect()))
    numbered = ranking.numbered(rows, [F.asc_nulls_first("search"), *order])
    sizes = sorted(r["count"] for r in numbered.groupBy(F.input_file_name()).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("most", [ti.MOST_LETTERS, 10])
def test_owner_words_equal_the_plain_rule(spark, most):
    rng = random.Random(7)
    words = [(rng.choice("abc"), "".join(rng.choice("xyzé ") for _ in range(rng.randrange(0, 5)))) for _ in range(300)]
    words += [(None, "x"), ("a", None), ("a", "")]
    titles = [None, "", "XYZ", "É zy", "nothing here"] + ["".join(rng.choice("xyzÉ qw") for _ in range(12)) for _ in range(60)]
    rows = [(i, rng.choice(["a", "b", "c", "d", None]), t) for i, t in enumerate(titles * 2)]
    jobs = spark.createDataFrame(rows, "id long, owning_user string, title string")
    listed = spark.createDataFrame(words, "owning_user string, word string")
    found = {r["id"]: r["rejected"] for r in ti.rejected_by_owner(jobs, listed, most).collect()}
    for i, owner, title in rows:
        mine = [w.lower() for o, w in words if o is not None and o == owner and w]
        assert found[i] == any(w in (title or "").lower() for w in mine if title is not None)
    assert not any(r["rejected"] for r in ti.rejected_by_owner(jobs, listed.limit(0)).collect())
