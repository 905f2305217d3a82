"""Feeds in any order, renames, and aggregates that follow changes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from postloom.operators import analytics as an
from postloom.operators import changes as ch
from postloom.operators import deltas, feeds

KEYS = ["k"]
FEED = "k long, seq long, op string, a string, b long"


def plain(rows, table):
    """State of each key after the changes in the order of their numbers."""
    cells = {k: {"a": a, "b": b} for k, a, b in table}
    for k, _, op, a, b in sorted(rows, key=lambda r: r[1]):
        if op == "D":
            cells.pop(k, None)
        else:
            held = cells.setdefault(k, {"a": None, "b": None})
            held |= {c: v for c, v in (("a", a), ("b", b)) if v is not None}
    return sorted((k, c["a"], c["b"]) for k, c in cells.items())


def test_any_order_and_any_number_of_times(spark):
    rng = random.Random(3)
    table = [(k, f"old{k}", k) for k in range(12)]
    rows = []
    for seq in range(1, 120):
        op = "D" if rng.random() < 0.2 else "U"
        a, b = (rng.choice([None, f"v{seq}"]), rng.choice([None, seq])) if op == "U" else (None, None)
        rows.append((rng.randrange(20), seq, op, a, b))
    start = feeds.state_of(spark.createDataFrame(table, "k long, a string, b long"), KEYS)
    batches = [spark.createDataFrame(rows[i::4], FEED) for i in range(4)]
    for order in [(0, 1, 2, 3), (3, 1, 0, 2, 1, 3)]:
        state = start
        for i in order:
            state = feeds.merged(state, batches[i], KEYS)
        found = sorted((r["k"], r["a"], r["b"]) for r in feeds.current(state, KEYS).collect())
        assert found == plain(rows, table)
    # applying it all again changes nothing, tombstones included
    again = feeds.merged(state, batches[2], KEYS)
    assert sorted(map(str, again.collect())) == sorted(map(str, state.collect()))


def test_deletes_win_over_older_updates(spark):
    state = feeds.state_of(spark.createDataFrame([(1, "x", 1)], "k long, a string, b long"), KEYS)
    state = feeds.merged(state, spark.createDataFrame([(1, 5, "D", None, None)], FEED), KEYS)
    late = feeds.merged(state, spark.createDataFrame([(1, 4, "U", "late", 9)], FEED), KEYS)
    assert feeds.current(late, KEYS).collect() == []
    after = feeds.merged(late, spark.createDataFrame([(1, 6, "U", None, 7)], FEED), KEYS)
    assert [tuple(r) for r in feeds.current(after, KEYS).collect()] == [(1, None, 7)]
    assert feeds.without_old_deletes(late, 6).count() == 0 and feeds.without_old_deletes(after, 9).count() == 1
    assert feeds.without_old_deletes(late, 5).count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_renames_equal_plain_rules(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    profiles = [(n, o) for o in "xy" for n in names[:10]]
    forms = [(n, o, rng.choice([*names, "", None, "free"]), f"r{n}{o}") for n, o in profiles if rng.random() < 0.8]
    after, renames = ch.edit_profiles(
        spark.createDataFrame([(n, o, "old", None) for n, o in profiles], "profile_name string, owning_user string, resume string, date_updated date"),
        spark.createDataFrame(forms, "profile_name string, owning_user string, new_name string, resume string"),
        [F.asc("resume")], "2024-02-01",
    )
    wanted = {(n, o): new for n, o, new, _ in forms if new and new != n}
    for owner in "xy":
        claims = {}
        for (n, o), new in sorted(wanted.items()):
            if o == owner and claims.setdefault(new, n) != n:
                wanted.pop((n, o))
    while True:  # a name is free unless its profile stays
        refused = [(n, o) for (n, o), new in wanted.items() if (new, o) in profiles and (new, o) not in wanted]
        if not refused:
            break
        for key in refused:
            wanted.pop(key)
    found = {(r["profile_name"], r["owning_user"]): r for r in after.collect()}
    assert set(found) == {(wanted.get((n, o), n), o) for n, o in profiles} and len(found) == len(profiles)
    edited = {(n, o): r for n, o, _, r in forms}
    for n, o in profiles:
        row = found[wanted.get((n, o), n), o]
        assert row["resume"] == edited.get((n, o), "old") and (row["date_updated"] is None) == ((n, o) not in edited)
    audits = ch.renamed(spark.createDataFrame([(n, o, 7) for n, o in profiles], "profile_name string, owning_user string, score int"), renames)
    assert {(r["profile_name"], r["owning_user"]) for r in audits.collect()} == set(found)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, v long")


def test_folded_and_extremes_equal_a_recount(spark):
    rng = random.Random(9)
    table = {i: (i, rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randrange(50)])) for i in range(60)}
    sums = {"n": F.lit(1), "total": F.coalesce("v", F.lit(0))}
    columns = {"least": ("min", "v"), "most": ("max", "v")}

    def recount(rows):
        counted = rows_of(spark, rows).groupBy("g").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("v", F.lit(0))).alias("total"), F.min("v").alias("least"), F.max("v").alias("most")
        )
        return counted.where("g IS NOT NULL")

    stored = recount(list(table.values()))
    totals, ends = stored.select("g", "n", "total"), stored.select("g", "least", "most")
    for step in range(4):
        before = dict(table)
        for i in rng.sample(sorted(table), 12):
            if step == 3 and table[i][1] == "a" or rng.random() < 0.3:
                table.pop(i)
            else:
                table[i] = (i, rng.choice(["a", "b", "c", "d"]), rng.choice([None, rng.randrange(-20, 80)]))
        table[1000 + step] = (1000 + step, "e", step)
        touched = rows_of(spark, [(i, "", 0) for i in before.keys() | table.keys() if before.get(i) != table.get(i)])
        after = rows_of(spark, list(table.values())).where("g IS NOT NULL")
        changes = deltas.changed_rows(rows_of(spark, list(before.values())).where("g IS NOT NULL"), after, touched, ["id"])
        totals, ends = deltas.folded(totals, changes, ["g"], sums), deltas.extremes(ends, changes, after, ["g"], columns)
        expected = recount(list(table.values())).collect()
        assert sorted(map(tuple, totals.collect())) == sorted((r["g"], r["n"], r["total"]) for r in expected if r["n"] or r["total"])
        assert sorted(map(tuple, ends.collect())) == sorted((r["g"], r["least"], r["most"]) for r in expected)
        totals = spark.createDataFrame(totals.collect(), totals.schema)
        ends = spark.createDataFrame(ends.collect(), ends.schema)


def test_a_row_that_did_not_change_cancels_out(spark):
    rows = spark.createDataFrame([(1, "o", "high", "saved")], "id long, owning_user string, title_compatibility_score string, review_status string")
    changes = deltas.changed_rows(rows, rows, rows, ["id"])
    kept = deltas.folded(an.funnel(rows), changes, ["owning_user"], {"total": F.lit(1), "saved": F.lit(1)})
    assert [tuple(r) for r in kept.collect()] == [("o", 1, 1)]
    assert list(itertools.chain(*[r.asDict() for r in changes.groupBy().sum("_sign").collect()])) == ["sum(_sign)"]
