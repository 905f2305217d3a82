"""Incremental jobs give the batch result, also when a batch runs twice."""

import shutil

from pyspark.sql import functions as F

from postloom.operators import ingest as ig
from postloom.plans.catalog import QUERIES
from postloom.streaming import ingest, lateness, parts, usage


def posts(spark, rows):
    return spark.createDataFrame(rows, "arrival_id long, job_url string, owning_user string, title string")


def run(spark, root, schema):
    stream = ingest.landed(spark, f"{root}/in", schema, files_per_batch=1)
    job = ingest.ingest(
        stream, f"{root}/store", f"{root}/check", [F.asc("arrival_id")], ["chef"],
        base=posts(spark, [(0, "u1", "a", "Old")]), buckets=16,
    )
    job.awaitTermination()
    return ingest.stored(spark, f"{root}/store", schema)


def test_ingest_equals_batch(spark, tmp_path):
    root = str(tmp_path)
    base = posts(spark, [(0, "u1", "a", "Old")])
    first = posts(spark, [(1, "u1", "a", "Again"), (2, "u2", "a", "New"), (3, "u2", "a", "Twice"),
                          (4, "u1", "b", "Other owner"), (5, "u3", "a", "Chef")])
    first.coalesce(1).write.parquet(f"{root}/in")
    assert {(r["job_url"], r["owning_user"]) for r in run(spark, root, base.schema).collect()} == {
        ("u2", "a"), ("u1", "b"),
    }
    second = posts(spark, [(6, "u2", "a", "Late repeat"), (7, "u4", "a", "Newer")])
    second.coalesce(1).write.mode("append").parquet(f"{root}/in")
    after = run(spark, root, base.schema).collect()
    assert sorted((r["arrival_id"], r["job_url"]) for r in after) == [(2, "u2"), (4, "u1"), (7, "u4")]
    together = ig.new_postings(
        first.union(second).where("title <> 'Chef'"), base, F.asc("arrival_id")
    )
    assert sorted(r["arrival_id"] for r in together.collect()) == [2, 4, 7]


def save(spark, sink, batch, rows, buckets=16):
    ingest.save_batch(posts(spark, rows), sink, batch, [F.asc("arrival_id")], buckets=buckets)


def test_repeated_batch_replaces_itself(spark, tmp_path):
    sink = str(tmp_path / "store")
    kind = posts(spark, [(0, "u", "a", "x")]).schema
    ingest.open_sink(spark, sink, posts(spark, [(0, "u1", "a", "Old")]), 16)
    for _ in range(2):
        save(spark, sink, 0, [(1, "u1", "a", "x"), (2, "u2", "a", "y")])
    # another attempt may see other rows; the first leaves nothing behind
    save(spark, sink, 0, [(1, "u1", "a", "x"), (3, "u3", "a", "z")])
    assert [r["job_url"] for r in ingest.stored(spark, sink, kind).collect()] == ["u3"]
    save(spark, sink, 1, [(4, "u2", "a", "y"), (5, "u3", "a", "z")])
    assert sorted(r["job_url"] for r in ingest.stored(spark, sink, kind).collect()) == ["u2", "u3"]


def files(path):
    return [p for p in path.rglob("*.parquet") if p.name.startswith("part-")]


def test_a_small_batch_reads_few_buckets(spark, tmp_path):
    sink = str(tmp_path / "store")
    ingest.open_sink(spark, sink, posts(spark, [(i, f"u{i}", "a", "x") for i in range(3000)]))
    asked = posts(spark, [(i, f"u{i}", "a", "x") for i in range(10)])
    held = ingest.held_keys(spark, sink, asked, 0)
    read = held.select(F.input_file_name().alias("file"), "bucket").distinct().collect()
    assert 1 <= len({r["bucket"] for r in read}) <= 10 and len({r["file"] for r in read}) <= 10
    assert len(files(tmp_path)) > 200
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    assert asked.join(held, ig.POSTING_KEY, "left_anti").count() == 0


def test_many_batches_leave_few_parts(spark, tmp_path):
    sink = str(tmp_path / "store")
    kind = posts(spark, [(0, "u", "a", "x")]).schema
    expected, most = set(), 0
    for batch in range(22):
        rows = [(100 * batch + i, f"u{(7 * batch + i) % 90}", "a", "x") for i in range(12)]
        save(spark, sink, batch, rows, buckets=4)
        expected |= {r[1] for r in rows}
        most = max(most, len(parts.live(spark, f"{sink}/rows")), len(parts.live(spark, f"{sink}/keys")))
    assert most <= 8 and len(files(tmp_path / "store" / "keys")) <= 4 * 8
    found = [r["job_url"] for r in ingest.stored(spark, sink, kind).collect()]
    assert sorted(found) == sorted(expected)


def test_a_crash_between_merge_and_removal_loses_nothing(spark, tmp_path):
    root = str(tmp_path / "parts")
    rows = [spark.createDataFrame([(b, b % 2)], "n int, k int") for b in range(4)]
    for b, r in enumerate(rows):
        parts.write(r, root, b)
    copies = {b: (tmp_path / f"copy{b}") for b in range(4)}
    for b, path in copies.items():
        shutil.copytree(parts.path_of(root, (b, b)), path)
    parts.merge(spark, root, rows[0].schema, before=4)
    assert parts.live(spark, root) == [(0, 3)]
    # not yet removed, and a half-written wider part
    for b, path in copies.items():
        shutil.copytree(path, parts.path_of(root, (b, b)))
    (tmp_path / "parts" / "part=0000000000-0000000015").mkdir()
    assert parts.live(spark, root) == [(0, 3)]
    assert sorted(r["n"] for r in parts.read(spark, root, rows[0].schema).collect()) == [0, 1, 2, 3]
    parts.merge(spark, root, rows[0].schema, before=4)
    assert sorted(p.name for p in (tmp_path / "parts").iterdir() if (p / "_SUCCESS").exists()) == ["part=0000000000-0000000003"]
    assert parts.live(spark, root, before=3) == []


def test_stateful_distinct(spark, tmp_path):
    rows = spark.createDataFrame(
        [("u1", "a", "2024-01-01 00:00:00"), ("u1", "a", "2024-01-01 00:05:00"), ("u1", "b", "2024-01-01 00:06:00")],
        "job_url string, owning_user string, t string",
    ).withColumn("landed_at", F.col("t").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.landed(spark, str(tmp_path / "in"), rows.schema)
    job = (
        ingest.distinct_stream(stream, "landed_at")
        .writeStream.format("memory").queryName("distinct_postings")
        .option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()
    assert spark.table("distinct_postings").count() == 2


def test_first_posting_is_corrected_and_state_goes(spark, tmp_path):
    ingest.use_rocksdb(spark)
    kind = "arrival_id long, job_url string, owning_user string, t string"

    def land(*rows):
        made = spark.createDataFrame(rows, kind).withColumn("at", F.col("t").cast("timestamp"))
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.landed(spark, str(tmp_path / "in"), made.schema)
        job = (
            ingest.first_postings(stream, "at", keep_ms=86_400_000, delay="1 hour")
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
            .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        )
        job.awaitTermination()
        sizes = [o["numRowsTotal"] for p in job.recentProgress for o in p["stateOperators"]]
        seen = spark.read.parquet(str(tmp_path / "out")).collect()
        return sizes[-1], sorted((r["job_url"], r["arrival_id"], r["replaces"] or 0) for r in seen)

    _, found = land((5, "u1", "a", "2024-01-01 00:00:00"), (9, "u1", "a", "2024-01-01 00:01:00"), (6, "u2", "a", "2024-01-01 00:02:00"))
    assert found == [("u1", 5, 0), ("u2", 6, 0)]
    # a repeat, and a smaller arrival that comes later
    _, found = land((7, "u1", "a", "2024-01-01 01:00:00"), (3, "u2", "a", "2024-01-01 01:00:00"))
    assert found == [("u1", 5, 0), ("u2", 3, 6), ("u2", 6, 0)]
    # many keys of a day that is over: their state goes, and a key seen again is new
    land(*[(100 + i, f"v{i}", "a", "2024-01-02 00:00:00") for i in range(40)])
    size, _ = land((900, "w", "a", "2024-01-05 00:00:00"))
    assert size <= 4
    _, found = land((901, "u1", "a", "2024-01-05 00:10:00"))
    assert ("u1", 901, 0) in found


def test_first_postings_in_a_sink_are_those_of_the_processor(spark, tmp_path):
    kind, day, root = "arrival_id long, job_url string, owning_user string, t string", 86_400_000, str(tmp_path)
    batches = [
        [(5, "u1", "a", "2024-01-01 00:00:00"), (9, "u1", "a", "2024-01-01 00:01:00"), (6, "u2", "a", "2024-01-01 00:02:00"), (4, None, "a", "2024-01-01 00:00:00")],
        [(7, "u1", "a", "2024-01-01 01:00:00"), (3, "u2", "a", "2024-01-01 01:00:00"), (2, None, "a", "2024-01-01 01:00:00")],
        [(8, "u2", "a", "2024-01-01 02:00:00")],
        [(9, "v", "a", "2024-01-01 03:00:00")],
        [(1, "u2", "a", "2024-01-01 04:00:00"), (900, "w", "a", "2024-01-05 00:00:00")],
        [(901, "u1", "a", "2024-01-05 00:10:00"), (902, "w", "a", "2024-01-05 00:10:00")],
    ]

    def save(number):
        rows = spark.createDataFrame(batches[number], kind).withColumn("at", F.col("t").cast("timestamp"))
        ingest.save_firsts(rows, root, number, "at", keep_ms=day, delay_ms=day // 24)
        return rows.schema

    for number in range(len(batches)):
        for _ in range(2):  # a batch that runs again
            schema = save(number)
    found = sorted((str(r["job_url"]), r["arrival_id"], r["replaces"] or 0) for r in ingest.first_changes(spark, root, schema).collect())
    assert found == [
        ("None", 2, 4), ("None", 4, 0), ("u1", 5, 0), ("u1", 901, 0), ("u2", 1, 3), ("u2", 3, 6), ("u2", 6, 0), ("v", 9, 0), ("w", 900, 0),
    ]
    assert ingest.first_changes(spark, root, schema).columns == [*schema.names, "replaces"]
    assert len(parts.live(spark, f"{root}/state")) <= 4


def test_the_query_of_first_postings_calls_no_python_for_a_key(source, monkeypatch):
    """One call of a processor for each key took longer than its limit over 1 GB."""
    monkeypatch.setattr(ingest, "first_postings", None)
    assert "stream_distinct" in QUERIES and QUERIES["stream_distinct"](source).count() > 1000


CALLS = (
    "run_id string, call_type string, prompt_tokens long, completion_tokens long, "
    "total_tokens long, cache_hit_tokens long, cache_miss_tokens long, duration_ms long, t string"
)


def calls(spark, *times):
    rows = [("r", "c", 1, 1, 2, 0, 0, 5, t) for t in times]
    return spark.createDataFrame(rows, CALLS).withColumn("timestamp", F.col("t").cast("timestamp"))


def test_late_usage_goes_to_the_side_and_windows_close_once(spark, tmp_path):
    path, root, kind = str(tmp_path / "in"), str(tmp_path / "root"), calls(spark, "2024-01-01").schema

    def step(*times):
        calls(spark, *times).coalesce(1).write.mode("append").parquet(path)
        lateness.admit(ingest.landed(spark, path, kind), root, f"{root}/a", "timestamp", "10 minutes").awaitTermination()
        windows = usage.windowed_usage(lateness.on_time(spark, root, kind), delay="10 minutes")
        usage.write_closed(windows, f"{root}/closed", f"{root}/c").awaitTermination()
        totals = usage.windowed_usage(lateness.on_time(spark, root, kind), delay="10 minutes", width="1 day")
        usage.write_updates(totals, f"{root}/totals", f"{root}/t").awaitTermination()
        closed = spark.read.schema(windows.schema).parquet(f"{root}/closed").collect()
        now = usage.run_totals(usage.current_totals(spark, f"{root}/totals", totals.schema)).collect()
        late = sorted((r["t"], r["batch"]) for r in lateness.late(spark, root, kind).collect())
        return sorted((r["window_start"].hour, r["call_count"]) for r in closed), [r["call_count"] for r in now], late

    closed, now, late = step("2024-01-01 00:10:00", "2024-01-01 05:00:00")
    assert closed == [(0, 1)] and now == [2] and late == []
    closed, now, late = step("2024-01-01 00:20:00", "2024-01-01 04:55:00", "2024-01-01 05:10:00")
    assert closed == [(0, 1), (4, 1)] and now == [4] and late == [("2024-01-01 00:20:00", 1)]
    for k in range(5):
        closed, now, late = step(f"2024-01-01 0{6 + k // 2}:{20 + 20 * (k % 2)}:00", "2023-12-31 00:00:00")
    assert closed == [(0, 1), (4, 1), (5, 2), (6, 2), (7, 2)] and now == [9] and len(late) == 6
    assert len(parts.live(spark, f"{root}/totals")) <= 8


def test_an_admitted_batch_does_not_change(spark, tmp_path):
    root = str(tmp_path)
    lateness.admit_batch(calls(spark, "2024-01-01 00:00:00"), root, 0, "timestamp", "1 hour")
    before = sorted(files(tmp_path))
    lateness.admit_batch(calls(spark, "2024-01-01 00:00:00"), root, 0, "timestamp", "1 hour")
    assert sorted(files(tmp_path)) == before
    lateness.admit_batch(calls(spark).limit(0), root, 1, "timestamp", "1 hour")
    lateness.admit_batch(calls(spark, "2023-12-31 22:00:00", None, "2023-12-31 23:30:00"), root, 2, "timestamp", "1 hour")
    kind = calls(spark, "2024-01-01").schema
    assert sorted(str(r["t"]) for r in lateness.late(spark, root, kind).collect()) == ["2023-12-31 22:00:00", "None"]
