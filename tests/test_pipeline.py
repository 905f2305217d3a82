"""Title cache, usage, scoring, changes and sources on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from postloom import dims
from postloom.operators import analytics as an
from postloom.operators import changes as ch
from postloom.operators import configs as co
from postloom.operators import ingest as ig
from postloom.operators import scoring as sc
from postloom.operators import titles as ti
from postloom.sources import exports, tables

ROLE = "Principal Engineer, Python"


@pytest.fixture
def cache(spark):
    rows = [
        ("user-alice", "principal engineer, python", "senior software engineer", "high", "2024-01-20"),
        ("user-alice", "principal engineer, python", "data analyst", "low", "2023-06-01"),
    ]
    df = spark.createDataFrame(
        rows, "owning_user string, role_normalized string, title_normalized string, score string, d string"
    )
    return df.withColumn("date_updated", F.col("d").cast("date")).drop("d")


def probes(spark, *titles, owner="user-alice", role=ROLE):
    return spark.createDataFrame(
        [(owner, role, t) for t in titles], "owning_user string, desired_role string, title string"
    )


def counts(looked):
    return tuple(an.cache_counts(looked).first())


def test_cache_hit_after_normalising(spark, cache):
    asked = probes(spark, "  senior   software engineer ", role=ROLE.upper())
    looked = ti.cache_lookup(asked, cache)
    assert [r["score"] for r in looked.collect()] == ["high"]
    assert counts(looked) == (1, 1, 0)


def test_cache_misses(spark, cache):
    assert counts(ti.cache_lookup(probes(spark, "Registered Nurse"), cache)) == (1, 0, 1)
    assert counts(
        ti.cache_lookup(probes(spark, "Senior Software Engineer", owner="user-bob"), cache)
    ) == (1, 0, 1)
    java = ROLE.replace("Python", "Java")
    assert counts(
        ti.cache_lookup(probes(spark, "Senior Software Engineer", role=java), cache)
    ) == (1, 0, 1)


def test_cache_mixed_and_off(spark, cache):
    asked = probes(spark, "Senior Software Engineer", "Data Analyst", "Chef")
    assert counts(ti.cache_lookup(asked, cache)) == (3, 2, 1)
    assert [r["title"] for r in ti.misses(ti.cache_lookup(asked, cache)).collect()] == ["Chef"]
    assert counts(ti.cache_lookup(asked, cache, enabled=False)) == (3, 0, 3)


def test_cache_prune(cache):
    kept = ch.prune_cache(cache, "2024-01-31", 90)
    assert [r["title_normalized"] for r in kept.collect()] == ["senior software engineer"]


def test_scorer_retries_and_drops_bad_entries(spark, cache):
    def flaky(titles, role):
        # the first call of each task fails, the second answers with one bad entry
        if not hasattr(flaky, "called"):
            flaky.called = True
            return {"error": "down"}
        return [{"job_title": t, "score": "medium"} for t in titles if t != "Bad"] + ["junk", {"x": 1}]

    looked = ti.cache_lookup(probes(spark, "Chef", "Bad", "Data Analyst"), cache)
    fresh = ti.score_misses(ti.misses(looked).coalesce(1), flaky)
    scores = {r["title"]: r["score"] for r in ti.all_scores(ti.resolved(looked), fresh).collect()}
    assert scores == {"Chef": "medium", "Data Analyst": "low"}
    rows = ti.cache_rows(fresh, F.lit("2024-02-01").cast("date"))
    both = ch.upsert_cache(cache.withColumn("title_raw", F.lit("")).withColumn("source", F.lit("")), rows, [F.asc("title_raw")])
    assert both.count() == 3


def test_usage_summary(spark):
    calls = [
        ("r1", "resume_ats", 100, 10, 110, 0, 100, 5),
        ("r1", "title_scoring", 20, 4, 24, 0, 20, 3),
        ("r1", "title_scoring", 30, 6, 36, 0, 30, 2),
    ]
    df = spark.createDataFrame(
        calls,
        "run_id string, call_type string, prompt_tokens long, completion_tokens long, "
        "total_tokens long, cache_hit_tokens long, cache_miss_tokens long, duration_ms long",
    )
    rows = {r["call_type"]: r for r in an.usage_summary(df).collect()}
    total = rows[None]
    assert (total["call_count"], total["prompt_tokens"], total["completion_tokens"]) == (3, 150, 20)
    assert (total["total_tokens"], total["cache_miss_tokens"], total["duration_ms"]) == (170, 150, 10)
    assert (rows["resume_ats"]["call_count"], rows["resume_ats"]["total_tokens"]) == (1, 110)
    assert (rows["title_scoring"]["call_count"], rows["title_scoring"]["total_tokens"]) == (2, 60)
    assert an.usage_summary(df.where("run_id = 'r3'")).count() == 0


def test_usage_rows(spark):
    usage = {"prompt_tokens": 10, "completion_tokens": 5, "total_tokens": 15,
             "cache_hit_tokens": 2, "cache_miss_tokens": 8}
    calls = spark.createDataFrame(
        [("r", "p", "m", "resume_ats", usage, 42), ("r", "p", "m", "resume_ats", {}, 1)],
        "run_id string, provider string, model string, call_type string, usage map<string,long>, duration_ms long",
    )
    rows = ig.usage_log_rows(calls, F.lit("2024-01-01").cast("timestamp")).collect()
    assert len(rows) == 1
    assert (rows[0]["prompt_tokens"], rows[0]["cache_miss_tokens"], rows[0]["duration_ms"]) == (10, 8, 42)


GOOD = {
    "clearance_assessment": {"status": "ClearanceStatus.ACTIVE_REQUIRED",
                             "required_clearance_types": ["Secret"], "detected_phrasing": "p",
                             "eligibility_score": 5},
    "citizenship_assessment": {"status": "CitizenshipStatus.REQUIRED", "meets_requirement": True,
                               "reason": "r"},
    "job_requirements": {"years_of_experience_required": 3, "travel_percentage": "10%",
                         "detected_requirements_phrasing": "d"},
    "ats_score_estimate": {"total_overall_score": 77, "tier": "Strong Match", "confidence_score": 0.8},
    "reason": "ok", "decision": "Pass",
    "scoring_breakdown": {
        "keyword_alignment": {"score": 80, "weight": 0.6, "top_matches": ["a"], "missing_critical_terms": []},
        "seniority_alignment": {"score": 70, "weight": 0.2, "years_of_experience_detected": 4, "title_match_grade": "A"},
        "impact_metrics": {"score": 60, "weight": 0.1, "detected_anchors": []},
        "structural_parsability": {"score": 90, "weight": 0.1, "format_risk": "Low"}},
    "strategic_pivots": ["x"],
}


def test_score_and_write_back(spark):
    text = json.dumps(GOOD)
    prompts = spark.createDataFrame([(1, "good"), (2, "none"), (3, "half")], "id long, prompt string")

    def scorer(prompt):
        answers = {"good": f"Sure: {text} done", "none": "no answer", "half": '{"decision": "Pass"}'}
        return answers[prompt], {"total_tokens": 9}

    checked = sc.check_answers(sc.score_postings(prompts, scorer))
    faults = {r["id"]: r["error"] for r in sc.faulty(checked).collect()}
    assert faults[2] == "no json"
    assert faults[3].startswith("missing clearance_assessment.status")
    sound = sc.sound_results(checked)
    stored = json.loads(sound.first()["job_score_json"])
    assert stored["schema_version"] == "1.0"
    assert stored["clearance_assessment"]["status"] == "Active Required"
    assert stored["citizenship_assessment"]["status"] == "Required"
    jobs = spark.createDataFrame(
        [(1, 0, "{}", "", 0), (2, 5, "{}", "", 0)],
        "id long, job_score int, job_score_json string, usage_metrics string, security_clearance_required int",
    )
    after = {r["id"]: r for r in ch.write_back(jobs, sound).collect()}
    assert (after[1]["job_score"], after[1]["security_clearance_required"]) == (77, 1)
    assert json.loads(after[1]["usage_metrics"]) == {"total_tokens": 9}
    assert after[2]["job_score"] == 5
    shown = sc.eligibility_rows(sound).first()
    assert (shown["clearance_class"], shown["years"], shown["confidence"]) == ("required", 3, "80%")


def test_audit_rows(spark):
    audits = spark.createDataFrame(
        [("p", "o", json.dumps({"headline": {"score": 8, "analysis": "a"}, "grammar": {}, "odd": {"score": 1}})),
         ("q", "o", "bad")],
        "profile_name string, owning_user string, ats_score string",
    )
    rows = sc.audit_rows(audits, dims.resume_sections(spark)).collect()
    assert [(r["section"], r["label"], r["score"], r["band"]) for r in rows] == [
        ("Summary Strength", "Headline", 8, "high")
    ]


def test_retention_settings():
    assert ch.usable_retention("60") == 60
    assert [ch.usable_retention(x) for x in (None, "never", 0, -3, "1.5")] == [None] * 5


def test_configs(spark):
    urls = spark.createDataFrame(
        [
            ("https://f.wd5.myworkdayjobs.com/x?locations=" + "a" * 32, "Freddie Mac", "t/s", None),
            ("https://f.wd5.myworkdayjobs.com/x", "No Tenant", None, None),
            ("https://h/hcmUI/CandidateExperience/en/sites/n/jobs?radius=25", "Navy", None,
             "findReqs;siteNumber=CX_1,sortBy=NEW"),
            ("https://www.indeed.com/jobs?q=python", "Indeed", None, None),
        ],
        "url string, company_name string, tenant_site string, finder string",
    )
    found = {r["config_key"]: json.loads(r["config_json"]) for r in co.from_urls(urls).collect()}
    assert found == {
        "freddiemac": {"company_name": "Freddie Mac", "tenant_site": "t/s",
                       "base_url": "https://f.wd5.myworkdayjobs.com",
                       "search_params": {"locations": "a" * 32}},
        "navy": {"company_name": "Navy", "siteNumber": "CX_1", "facetsList": "", "sortBy": "NEW",
                 "base_url": "https://h", "radius": "25"},
    }
    forms = spark.createDataFrame(
        [("usajobs", "U", "https://u", "McLean\n Reston \n", '{"hp":"public"}', None),
         ("eightfold", "E", "https://e", None, "bad json", None),
         ("workday", "W", "https://w", None, None, '{"locations":["a"]}')],
        "config_type string, company_name string, base_url string, usajobs_l string, "
        "extra_params string, search_params string",
    )
    made = {r["config_type"]: json.loads(r["config_json"]) for r in co.from_forms(forms).collect()}
    assert made["usajobs"] == {"company_name": "U", "base_url": "https://u", "l": ["McLean", "Reston"],
                               "hp": "public"}
    assert made["eightfold"] == {"company_name": "E", "base_url": "https://e"}
    assert made["workday"]["search_params"] == {"locations": ["a"]}


def test_store_snapshots(spark, tmp_path, source):
    root = str(tmp_path / "t")
    small = source.view("users")
    tables.write_snapshot(small, root, 1)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.write_snapshot(small, root, 1)
    tables.write_snapshot(small.where("email <> ''"), root, 2)
    old, new = tables.read_snapshot(spark, root, 1), tables.read_snapshot(spark, root, 2, "users")
    assert old.count() > new.count() > 0
    # columns of a later design are there, with their defaults
    assert {r["theme"] for r in new.collect()} == {"system"}


def test_table_report(spark, source):
    source.view("users").createOrReplaceTempView("users")
    rows = {r["table_name"]: r for r in tables.table_report(spark, ["users", "job_details"]).collect()}
    spark.catalog.dropTempView("users")
    assert rows["users"]["present"] and rows["users"]["rows"] > 0
    assert not rows["job_details"]["present"] and rows["job_details"]["rows"] is None


def test_documents(spark, tmp_path):
    import os

    (tmp_path / "a.txt").write_text("line one\nline two")
    (tmp_path / "b.md").write_text("# head")
    (tmp_path / "c.csv").write_text("x")
    os.utime(tmp_path / "a.txt", (1_000_000, 1_000_000))
    os.utime(tmp_path / "b.md", (2_000_000, 2_000_000))
    os.utime(tmp_path / "c.csv", (3_000_000, 3_000_000))
    docs = tables.read_documents(spark, str(tmp_path / "*.txt"))
    assert docs.first()["text"] == "line one\nline two"
    assert tables.newest_resume(spark, str(tmp_path)).first()["path"].endswith("b.md")
    order = [r["path"][-5:] for r in tables.files_newest_first(spark, str(tmp_path)).collect()]
    assert order == ["c.csv", "/b.md", "a.txt"]
    asked = spark.createDataFrame([("https://x/1",), ("plain words",)], "source string")
    pages = spark.createDataFrame([("https://x/1", "<p>Hi <b>you</b></p>")], "url string, html string")
    got = {r["source"]: r["text"] for r in tables.source_text(asked, pages, docs).collect()}
    assert got == {"https://x/1": "Hi **you**", "plain words": "plain words"}


def test_exports(spark, tmp_path):
    jobs = spark.createDataFrame(
        [("T", "C", "u1", 1.0, 2.0, "L"), (None, "C", "u2", None, None, None), ("T", "C", "", None, None, "L")],
        "title string, company string, job_url string, min_amount double, max_amount double, location string",
    ).withColumn("date_posted", F.lit("2024-05-01").cast("date"))
    exports.write_json(jobs, str(tmp_path / "out"), "indeed", "python")
    rows = spark.read.json(str(tmp_path / "out" / "jobs")).collect()
    assert len(rows) == 1 and rows[0]["compensation"]["min"] == 1.0 and rows[0]["date_posted"] == "2024-05-01"
    assert spark.read.json(str(tmp_path / "out" / "metadata")).first()["total_jobs"] == 1
    assert sorted(r["reason"] for r in exports.incomplete_rows(jobs).collect()) == ["no title", "no url"]
    quoted = spark.createDataFrame([('say "hi", \\ then\nmore', 1)], "a string, b int")
    exports.write_csv(quoted, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", "\\").option("multiLine", True)
    assert back.csv(str(tmp_path / "csv")).first()["b"] == "1"


def test_repeats_are_dropped_within_a_search_only(spark):
    from postloom.sources import boards

    def answer(*keys):
        jobs = ",".join(f'{{"job":{{"key":"{k}","title":"t"}}}}' if k else '{"job":{"title":"no key"}}' for k in keys)
        return f'{{"data":{{"jobSearch":{{"results":[{jobs}]}}}}}}'

    landed = spark.createDataFrame(
        [(1, "ann", "data", 7, answer("a", "b", "", "")), (2, "ann", "data", 7, answer("a")), (3, "bob", "data", 8, answer("a"))],
        "payload_id long, owning_user string, search_term string, run_id long, payload string",
    )
    posts = boards.flatten("indeed", landed)
    found = sorted((r.owning_user, r.run_id, r.payload_id, r._pos, r.id or "") for r in posts.collect())
    assert found == [
        ("ann", 7, 1, 0, "in-a"), ("ann", 7, 1, 1, "in-b"), ("ann", 7, 1, 2, ""), ("ann", 7, 1, 3, ""), ("bob", 8, 3, 0, "in-a"),
    ]
    assert "run_id" not in boards.flatten("indeed", landed.drop("owning_user", "search_term", "run_id")).columns


def test_cards_without_an_id_stay(spark):
    from postloom.sources import pages

    card = '<article data-job-id=""><h2><a href="/j/{0}">Title {0}</a></h2></article>'
    html = "<div>" + card.format(1) + card.format(2) + card.format(3).replace('id=""', 'id="7"') * 2 + "</div>"
    landed = spark.createDataFrame([(n, html) for n in range(3)], "payload_id long, html string")
    empty = spark.createDataFrame([], "payload_id long, job_id string, html string")
    found = pages.zip_recruiter(landed, empty).groupBy("title").count().collect()
    assert {r.title: r["count"] for r in found} == {"Title 1": 3, "Title 2": 3, "Title 3": 3}
    plan = pages.zip_cards(landed)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange")]
    assert "html#" not in above and "_in#" not in above
