import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import mixing, queries

WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]


def corpus(seed, count):
    """Texts of two domains that differ in a few words."""
    rng, rows = random.Random(seed), []
    for i in range(count):
        good = rng.random() < 0.7
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 80))]
        words += [rng.choice(["fine", "nice"] if good else ["bad", "ugly"]) for _ in range(3)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), "good" if good else "poor"))
    return rows


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, domain string")


def test_posteriors_are_right_on_held_out_rows(spark, docs):
    rows = corpus(1, 600)
    labels = labels_of(spark, [(i, d) for i, _, d in rows[:300]] + [(None, "good"), (5, None), (9999, "poor"), (2, "none")])
    rates = mixing.mix(docs([(i, t) for i, t, _ in rows]), labels, {"good": 0.9, "poor": 0.1}, "good").collect()
    truth = {i: d for i, _, d in rows[300:]}
    right = [(r.p_good > 0.5) == (truth[r.doc_id] == "good") for r in rates if r.doc_id in truth]
    assert np.mean(right) > 0.98


def test_expected_tokens_meet_the_targets_and_equal_plain_descent(spark):
    rng = np.random.default_rng(4)
    n = 200
    p = rng.dirichlet([0.4, 0.3, 0.3], size=n)
    t = rng.integers(0, 500, size=n).astype(float)
    soft = spark.createDataFrame(
        [(i, i, int(a), *map(float, b)) for i, (a, b) in enumerate(zip(t, p, strict=True))],
        "doc_id long, text_key long, tokens long, p0 double, p1 double, p2 double",
    )
    targets = [t.sum() * 0.3, t.sum() * 0.1, t.sum() * 0.5]
    settings = mixing.Settings(piece=7)
    fitted, misses = mixing.fit_rates(soft, targets, settings)
    got = np.array([r.rate for r in fitted.orderBy("doc_id").collect()])
    rate, supply = np.ones(n), (t[:, None] * p).sum(axis=0)
    step, miss, last = 1 / (1 + settings.stay), np.full(3, np.inf), np.ones(n)
    for k in range(settings.steps):
        ahead = rate + (rate - last) * (k / (k + 3))
        before, miss = miss, ((ahead * t) @ p - targets) / supply
        if np.abs(miss).max() < settings.tolerance or np.abs(miss - before).max() < settings.tolerance / 20:
            break
        last, rate = rate, np.maximum(0, ahead - step * (p @ miss + settings.stay * (ahead - 1)))
    assert got == pytest.approx(rate, abs=1e-9)
    assert (got >= 0).all()
    assert (got * t) @ p == pytest.approx(targets, rel=0.01)
    assert misses == pytest.approx(((got * t) @ p - targets) / supply, abs=1e-9)
    # out of reach: every rate at its bound, and the miss says so
    bounded, misses = mixing.fit_rates(soft, list(3 * supply), mixing.Settings(most=1.5))
    assert {r.rate for r in bounded.collect()} == {1.5} and misses == pytest.approx([-1.5] * 3)


def test_copies(spark):
    frame = spark.range(4000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("n"))
    counts = {r.n: r["count"] for r in frame.groupBy("n").count().collect()}
    assert set(counts) == {1, 2} and abs(counts[2] / 4000 - 0.3) < 0.03
    for rate, n in [(0.0, 0), (0.04, 0), (0.97, 1), (1.0, 1), (2.02, 2)]:
        assert spark.range(1).select(mixing.copies(F.lit(rate), F.col("id"))).first()[0] == n


def test_odd_rows(spark, docs):
    rows = corpus(2, 80)
    texts = [(i, t) for i, t, _ in rows] + [(None, "fine nice"), (500, None), (501, ""), (502, " \n"), (3, rows[3][1])]
    texts += [(3, "another text of id three"), (503, "bad " * 50_000)]
    labels = labels_of(spark, [(i, d) for i, _, d in rows] + [(0, "good"), (0, "poor")])
    given = docs(texts)
    rates = mixing.mix(given, labels, {"good": 0.5, "poor": 0.5}, "good")
    found = rates.collect()
    assert len(found) == len(texts)
    assert {r.tokens for r in found if r.doc_id in (500, 501, 502)} == {0}
    assert all(r.rate >= 0 and abs(r.p_good + r.p_poor - 1) < 1e-9 for r in found)
    assert {r.missed for r in found} == {found[0].missed} and found[0].missed < 1e-2
    assert all(p.dataType.typeName() in ("long", "double", "integer") for p in rates.schema)
    out = mixing.mixed(given, rates)
    assert out.columns == given.columns
    copies = {}
    for r in found:
        copies[(r.doc_id, r.text_key)] = r.copies
    doubled = sum(copies[(3, r.text_key)] for r in found if r.doc_id == 3)
    assert out.where("doc_id = 3").count() == doubled
    assert out.count() == sum(r.copies for r in found)


def slow_posteriors(rows, labels, domains, settings=mixing.Settings()):  # noqa: B008
    """The classifier, written out for one text after the other."""

    def marks(text):
        words = [w for w in re.split(r"[\s.,;:!?]+", (text or "").lower()) if w]
        found, n = set(words), len(words)
        signs = sum(c in mixing.SYMBOLS for c in text or "")
        shouts, caps = (text or "").count("!"), sum("A" <= c <= "Z" for c in text or "")
        for name, top, bottom in [("variety", len(found), n), ("symbols", min(signs, n), n), ("marks", min(shouts, n), n), ("capitals", caps, len(text or ""))]:
            found.add(f"\x00{name} {math.floor(10 * top / max(bottom, 1))}")
        return found

    seen = [(marks(t), domains.index(labels[i])) for i, t in rows if i in labels]
    n = [sum(d == k for _, d in seen) for k in range(len(domains))]
    base = [math.log((x + 1) / (sum(n) + len(domains))) for x in n]
    weights = {}
    for word in set().union(*[m for m, _ in seen]):
        held = [sum(word in m for m, d in seen if d == k) for k in range(len(domains))]
        rate, mean = [(c + 0.5) / (x + 1) for c, x in zip(held, n, strict=True)], (sum(held) + 0.5) / (sum(n) + 1)
        share = [(x + 1) / (sum(n) + len(domains)) for x in n]
        told = sum(s * (r * math.log(r / mean) + (1 - r) * math.log((1 - r) / (1 - mean))) for s, r in zip(share, rate, strict=True))
        ratio = [math.log(r / mean) for r in rate]
        if sum(held) < settings.least_texts or 2 * sum(n) * told < settings.least_told or max(map(abs, ratio)) < settings.least_weight:
            continue
        absent = [math.log((1 - r) / (1 - mean)) if x >= settings.least_weight and r >= settings.least_cover else 0.0 for x, r in zip(ratio, rate, strict=True)]
        base = [b + a for b, a in zip(base, absent, strict=True)]
        weights[word] = [(x if abs(x) >= settings.least_weight else 0.0) - a for x, a in zip(ratio, absent, strict=True)]
    out = {}
    for i, t in rows:
        score = [b + sum(weights[w][k] for w in marks(t) if w in weights) for k, b in enumerate(base)]
        raised = [math.exp(s - max(score)) for s in score]
        out[i] = [x / sum(raised) for x in raised]
    return out, weights


def test_posteriors_equal_plain_arithmetic(spark, docs):
    rows = corpus(3, 300)
    texts = [(i, t + " " + "$ " * (i % 3) + "A! " * (i % 5)) for i, t, _ in rows] + [(900, None), (901, ""), (902, "fine " * 9), (903, "Bad!!! #")]
    domains = {i: d for i, _, d in rows[:200]}
    rates = mixing.mix(docs(texts), labels_of(spark, list(domains.items())), {"good": 0.9, "poor": 0.1}, "good").collect()
    expected, weights = slow_posteriors(texts, domains, ["good", "poor"])
    assert len(weights) >= 4 and len(rates) == len(expected)
    for r in rates:
        assert (r.p_good, r.p_poor) == pytest.approx(expected[r.doc_id], abs=1e-9)


def test_model_is_a_constant(spark, docs):
    """Features are found by their number, and the plan has neither a join nor a parse for each row."""
    rows = corpus(3, 200)
    labels = labels_of(spark, [(i, d) for i, _, d in rows])
    plain = docs([(i, t) for i, t, _ in rows]).select("doc_id", "text")
    model = mixing.learn(plain, labels, ["good", "poor"])
    slot, there, weights = mixing._lookup(model, range(2))
    asked = model.select("feature", "w1").unionAll(spark.range(500).select(F.xxhash64("id"), F.lit(None)))
    at = asked.withColumn("at", slot(F.col("feature"))).where(there(F.col("feature"), F.col("at")))
    found = at.select("w1", weights[1](F.col("at")).alias("w")).collect()
    assert all(r["w"] == r["w1"] for r in found) and len(found) == model.count()
    plan = mixing.posteriors(plain, model, ["good", "poor"])._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "Join" not in plan


def test_hash_table_has_no_clashes():
    rng = random.Random(2)
    for n in (0, 1, 2, 700):
        features = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
        shifts, slots = mixing._perfect(features)
        for k, f in enumerate(features):
            assert slots[((f % (1 << 64) >> 20) & (len(slots) - 1)) ^ shifts[f & (len(shifts) - 1)]] == k


def test_columns_of_any_name_are_carried(spark):
    names = ["_copies", "_copy", "_id", "_key", "row", "id", "key", "copies", "col", "text_key"]
    rows = spark.createDataFrame([(1, "a b", *range(10)), (1, "a b", *range(10)), (None, None, *range(10))], ["doc_id", "text", *names])
    labels = labels_of(spark, [(1, "good")])
    rates = mixing.mix(rows, labels, {"good": 0.5, "poor": 0.5}, "good")
    out = mixing.mixed(rows, rates.withColumn("copies", F.lit(2)))
    assert out.columns == rows.columns and sorted(map(tuple, out.collect()), key=str) == sorted(list(map(tuple, rows.collect())) * 2, key=str)


def test_empty_tables(spark, docs):
    none = labels_of(spark, [])
    assert mixing.mix(docs([]), none, {"good": 0.5, "poor": 0.5}, "good").collect() == []
    even = mixing.mix(docs([(1, "a b")]), none, {"good": 0.5, "poor": 0.5}, "good").collect()
    assert [(r.p_good, r.copies) for r in even] == [(0.5, 1)]


def test_no_python_on_the_executors(spark):
    plan = queries.op9(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_realised_tokens_meet_the_targets_with_junk_at_a_third(spark, docs):
    rng, rows = random.Random(8), []
    for i in range(4500):
        poor = i % 3 == 0
        words = [rng.choice(WORDS) for _ in range(20)] + [rng.choice(["bad", "ugly"] if poor else ["fine", "nice"]) for _ in range(6)]
        rows.append((i, " ".join(words), "poor" if poor else "good"))
    weights = {"good": 0.98, "poor": 0.02}
    rates = mixing.mix(docs([r[:2] for r in rows]), labels_of(spark, [(i, d) for i, _, d in rows]), weights, "good").toPandas()
    assert rates["rate"][rates["p_poor"] > 0.9].median() < 0.05
    got = {d: (rates["copies"] * rates["tokens"] * rates[f"p_{d}"]).sum() for d in weights}
    assert abs(got["poor"] / sum(got.values()) - 0.02) < 0.012
    assert abs(got["good"] / (rates["tokens"] * rates["p_good"]).sum() - 1) < 0.02
