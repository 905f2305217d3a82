"""Pipeline queries: screening, lookup, save, telemetry, choosing what to score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom import fixed_values as fv
from postloom.functions.results import list_text
from postloom.operators import analytics as an
from postloom.operators import changes as ch
from postloom.operators import ingest as ig
from postloom.operators import scoring as sc
from postloom.operators import titles as ti
from postloom.plans.registry import Source, query
from postloom.functions.text import ready_to_score

AS_OF = "2001-08-01"
REJECT_WORDS = ["Intern", "nurse", ""]

_NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_CACHE_JOIN = f"""SELECT p.probe_id, p.owning_user, p.desired_role, p.title, c.score
FROM <<title_probes>> p LEFT JOIN <<title_score_cache>> c ON c.owning_user = p.owning_user
AND c.role_normalized = {_NORM.format('p.desired_role')}
AND c.title_normalized = {_NORM.format('p.title')}"""


# --- titles --------------------------------------------------------------------------------------


@query(
    "reject_titles",
    """SELECT * FROM <<job_details>> WHERE NOT (lower(title) LIKE '%intern%' OR lower(title) LIKE '%nurse%')""",
)
def reject_titles(s: Source) -> DataFrame:
    return ti.drop_rejected(s.view("job_details"), F.array(*[F.lit(w) for w in REJECT_WORDS]))


@query(
    "reject_titles_strict",
    """SELECT * FROM <<job_details>> WHERE NOT (contains(lower(title), 'Intern') OR contains(lower(title), 'nurse'))""",
)
def reject_titles_strict(s: Source) -> DataFrame:
    words = F.array(*[F.lit(w) for w in REJECT_WORDS if w])
    return ti.drop_rejected(s.view("job_details"), words, strict=True)


@query(
    "unique_titles",
    "SELECT DISTINCT owning_user, title FROM <<incoming_postings>> WHERE title IS NOT NULL AND title <> ''",
)
def unique_titles(s: Source) -> DataFrame:
    return ti.unique_titles(s.view("incoming_postings"), "owning_user")


@query("title_cache_lookup", _CACHE_JOIN)
def title_cache_lookup(s: Source) -> DataFrame:
    found = ti.cache_lookup(s.view("title_probes"), s.view("title_score_cache"))
    return found.select("probe_id", "owning_user", "desired_role", "title", "score")


@query(
    "title_cache_off",
    """SELECT probe_id, owning_user, desired_role, title, CAST(NULL AS VARCHAR) AS score FROM <<title_probes>>""",
)
def title_cache_off(s: Source) -> DataFrame:
    found = ti.cache_lookup(s.view("title_probes"), s.view("title_score_cache"), enabled=False)
    return found.select("probe_id", "owning_user", "desired_role", "title", "score")


@query(
    "cache_counts",
    f"""SELECT count(*) AS total, count(score) AS exact, count(*) - count(score) AS llm FROM ({_CACHE_JOIN}) j""",
)
def cache_counts(s: Source) -> DataFrame:
    return an.cache_counts(ti.cache_lookup(s.view("title_probes"), s.view("title_score_cache")))


def keyword_scorer(titles: list[str], role: str) -> dict:
    """A stand-in scorer for tests: a fixed word rule."""
    return {
        "scores": [
            {"job_title": t, "score": "high" if "ring" in t.lower() else "low"}
            for t in titles
            if "bolt" not in t.lower()
        ]
    }


_SCORED = f"""SELECT owning_user, desired_role, title,
  CASE WHEN score IS NOT NULL THEN score WHEN contains(lower(title), 'bolt') THEN NULL
       WHEN contains(lower(title), 'ring') THEN 'high' ELSE 'low' END AS score
FROM (SELECT DISTINCT owning_user, desired_role, title, score FROM ({_CACHE_JOIN}) j) d"""


def _all_scores(s: Source) -> DataFrame:
    probes = s.view("title_probes").select("owning_user", "desired_role", "title").distinct()
    as_of = F.lit(AS_OF).cast("date")
    scores, _ = ti.score_titles(probes, s.view("title_score_cache"), keyword_scorer, as_of)
    return scores


@query("score_misses", f"SELECT * FROM ({_SCORED}) x WHERE score IS NOT NULL")
def score_misses(s: Source) -> DataFrame:
    return _all_scores(s)


@query(
    "attach_title_scores",
    f"""SELECT p.probe_id, p.owning_user, p.title, coalesce(x.score, 'low') AS title_compatibility_score
    FROM <<title_probes>> p LEFT JOIN ({_SCORED}) x ON p.owning_user = x.owning_user
    AND p.desired_role = x.desired_role AND p.title = x.title""",
)
def attach_title_scores(s: Source) -> DataFrame:
    keys = ["owning_user", "desired_role", "title"]
    scored = ti.attach_scores(s.view("title_probes"), _all_scores(s), keys)
    return scored.select("probe_id", "owning_user", "title", "title_compatibility_score")


@query(
    "missing_title_score",
    """SELECT * FROM <<job_details>> WHERE title_compatibility_score IS NULL OR title_compatibility_score = ''""",
)
def missing_title_score(s: Source) -> DataFrame:
    return ti.without_score(s.view("job_details"))


# --- duplicates and save ------------------------------------------------------------------------------

_STORED = "SELECT job_url, owning_user FROM <<job_details>>"
_FIRST = """SELECT arrival_id, job_url, owning_user, site, title, date_posted FROM (
  SELECT *, row_number() OVER (PARTITION BY job_url, owning_user ORDER BY arrival_id) AS rn
  FROM <<incoming_postings>>) i WHERE rn = 1"""
_NEW = f"""SELECT f.* FROM ({_FIRST}) f WHERE NOT EXISTS (
  SELECT 1 FROM <<job_details>> j WHERE j.job_url = f.job_url AND j.owning_user = f.owning_user)"""


@query("distinct_postings", _FIRST)
def distinct_postings(s: Source) -> DataFrame:
    return ig.distinct_postings(s.view("incoming_postings"), F.asc("arrival_id"))


@query("new_postings", _NEW)
def new_postings(s: Source) -> DataFrame:
    return ig.new_postings(
        s.view("incoming_postings"), s.view("job_details"), F.asc("arrival_id")
    )


@query(
    "unseen_anywhere",
    """SELECT * FROM <<incoming_postings>> i WHERE NOT EXISTS (
    SELECT 1 FROM <<job_details>> j WHERE j.job_url = i.job_url)""",
)
def unseen_anywhere(s: Source) -> DataFrame:
    return ig.unseen_anywhere(s.view("incoming_postings"), s.view("job_details"))


def _totals(s: Source) -> DataFrame:
    incoming = s.view("incoming_postings").withColumn(
        "description", F.when(F.col("arrival_id") % 7 == 0, " ").otherwise(F.col("title"))
    )
    return ig.key_totals(incoming, s.view("job_details"))


@query(
    "save_counts",
    f"""SELECT CAST(sum(n) AS BIGINT) AS saved, CAST(sum(CASE WHEN n = 1 AND arrival_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_description,
    CAST(sum(1 - n) AS BIGINT) AS already_stored FROM (
      SELECT i.arrival_id, CASE WHEN w.arrival_id IS NULL THEN 0 ELSE 1 END AS n
      FROM <<incoming_postings>> i LEFT JOIN ({_NEW}) w ON i.arrival_id = w.arrival_id) x""",
)
def save_counts(s: Source) -> DataFrame:
    return an.save_counts(_totals(s))


@query("saved_by_board", f"SELECT site, count(*) AS saved FROM ({_NEW}) n GROUP BY site")
def saved_by_board(s: Source) -> DataFrame:
    return an.saved_by_board(_totals(s))


@query(
    "stored_rows",
    f"""SELECT job_url, site, title, date_posted, 0 AS job_score, '{{}}' AS job_score_json,
    CASE WHEN regexp_matches(title, '(?i)\\b(current|active|with).*(security clearance|TS/SCI|public trust|secret|top.secret)\\b')
      THEN 1 ELSE 0 END AS security_clearance_required,
    'not_reviewed' AS review_status, DATE '{AS_OF}' AS date_created, owning_user FROM ({_NEW}) n""",
)
def stored_rows(s: Source) -> DataFrame:
    fresh = ig.new_postings(
        s.view("incoming_postings"), s.view("job_details"), F.asc("arrival_id")
    )
    return ig.stored_rows(fresh, AS_OF).select(
        "job_url", "site", "title", "date_posted", "job_score", "job_score_json",
        "security_clearance_required", "review_status", "date_created", "owning_user",
    )


# counts of a board and a term that the logs do not have go to no row
_SAVED = """SELECT run_id, CASE search_term WHEN 'nurse' THEN 'doctor' ELSE search_term END AS search_term,
  CASE scraper WHEN 'workday' THEN 'monster' ELSE scraper END AS scraper, CAST(sum(jobs_found) % 97 AS BIGINT) AS saved
FROM <<scraping_logs>> GROUP BY 1, 2, 3"""


@query(
    "reconcile_logs",
    f"""SELECT l.id, l.run_id, l.scraper, l.search_term, l.success, l.log_ts,
    CASE WHEN l.success = 1 AND t.run_id IS NOT NULL THEN
      CASE WHEN l.rn = 1 THEN coalesce(v.saved, 0) ELSE 0 END ELSE l.jobs_found END AS jobs_found
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id, search_term, scraper, success ORDER BY id) AS rn
          FROM <<scraping_logs>>) l
    LEFT JOIN ({_SAVED}) v ON l.run_id = v.run_id AND l.search_term = v.search_term AND l.scraper = v.scraper
    LEFT JOIN (SELECT DISTINCT run_id, search_term FROM ({_SAVED}) s) t
      ON l.run_id = t.run_id AND l.search_term = t.search_term""",
)
def reconcile_logs(s: Source) -> DataFrame:
    saved = (
        s.view("scraping_logs")
        .replace({"workday": "monster"}, subset=["scraper"])
        .replace({"nurse": "doctor"}, subset=["search_term"])
        .groupBy("run_id", "search_term", "scraper")
        .agg((F.sum("jobs_found") % 97).cast("bigint").alias("saved"))
    )
    return ig.reconcile_logs(s.view("scraping_logs"), saved)


@query(
    "mark_incomplete",
    """SELECT id, run_id, scraper, search_term, log_ts,
    CASE WHEN hit THEN 0 ELSE jobs_found END AS jobs_found, CASE WHEN hit THEN 0 ELSE success END AS success,
    CASE WHEN hit THEN 'timeout' END AS error_message FROM (
      SELECT *, id > 50 AND run_id = 'run-2024-01-01' AND search_term = 'Security' AND success = 1 AS hit
      FROM <<scraping_logs>>) l""",
)
def mark_incomplete(s: Source) -> DataFrame:
    return ig.mark_incomplete(
        s.view("scraping_logs"), "run-2024-01-01", "Security", 50, "timeout"
    )


@query("log_high_water", "SELECT coalesce(max(id), 0) AS max_id FROM <<scraping_logs>>")
def log_high_water(s: Source) -> DataFrame:
    return ig.high_water(s.view("scraping_logs"))


@query(
    "scrape_log_rows",
    """SELECT run_id, scraper, search_term, CASE WHEN success = 0 THEN 0 ELSE CAST(jobs_found AS INTEGER) END AS jobs_found,
    success = 1 AS success, CASE WHEN success = 0 THEN 'failed' END AS error_message FROM <<scraping_logs>>""",
)
def scrape_log_rows(s: Source) -> DataFrame:
    attempts = (
        s.view("scraping_logs")
        .withColumn("error_message", F.when(F.col("success") == 0, "failed"))
        .withColumn("site", F.lit(None).cast("string"))
        .withColumn("scrape_duration_seconds", F.lit(1.0))
    )
    return ig.scrape_log_rows(attempts, F.col("log_ts")).drop(
        "timestamp", "site", "scrape_duration_seconds"
    )


@query(
    "usage_log_rows",
    """SELECT run_id, call_type, prompt_tokens, completion_tokens, CAST(0 AS BIGINT) AS total_tokens,
    CAST(0 AS BIGINT) AS cache_hit_tokens, CAST(0 AS BIGINT) AS cache_miss_tokens, duration_ms
    FROM <<llm_usage_log>> WHERE cache_hit_tokens <> 0""",
)
def usage_log_rows(s: Source) -> DataFrame:
    usage = F.when(
        F.col("cache_hit_tokens") != 0,
        F.create_map(
            F.lit("prompt_tokens"), F.col("prompt_tokens"),
            F.lit("completion_tokens"), F.col("completion_tokens"),
        ),
    ).otherwise(F.create_map().cast("map<string,bigint>"))
    calls = s.view("llm_usage_log").select(
        "run_id", "call_type", "duration_ms", "log_ts", usage.alias("usage"),
        F.lit("p").alias("provider"), F.lit("m").alias("model"),
    )
    return ig.usage_log_rows(calls, F.col("log_ts")).drop("timestamp", "provider", "model")


# --- owners, profiles, work list ---------------------------------------------------------------------


def _profiles(s: Source) -> DataFrame:
    return s.view("job_profiles").withColumn("keywords", list_text("keywords"))


_WORDS = """CASE keywords WHEN '["data engineer","nurse"]' THEN ['data engineer', 'nurse']
  WHEN '["security"]' THEN ['security'] ELSE [] END"""
_WANTED = f"""SELECT owning_user, location, unnest({_WORDS}) AS search_term
  FROM <<job_profiles>> WHERE is_default = 1"""
_SITES = ", ".join(f"('{x}')" for x in fv.SITES)
_MULTI = ", ".join(f"'{x}'" for x in fv.MULTI_TENANT_SITES)


@query(
    "work_list",
    f"""SELECT w.owning_user, w.location, w.search_term, t.site, c.config_key AS site_config
    FROM ({_WANTED}) w CROSS JOIN (VALUES {_SITES}) t(site)
    LEFT JOIN <<scraper_configs>> c ON c.owning_user = w.owning_user AND c.config_type = t.site AND t.site IN ({_MULTI})
    WHERE t.site NOT IN ({_MULTI}) OR c.config_key IS NOT NULL""",
)
def work_list(s: Source) -> DataFrame:
    return ig.work_list(_profiles(s), s.view("scraper_configs")).select(
        "owning_user", "location", "search_term", "site", "site_config"
    )


@query(
    "owners_with_configs",
    "SELECT DISTINCT owning_user FROM <<scraper_configs>> WHERE owning_user <> ''",
)
def owners_with_configs(s: Source) -> DataFrame:
    return an.owners_with_configs(s.view("scraper_configs"))


@query(
    "owners_with_keywords",
    f"""SELECT DISTINCT owning_user FROM <<job_profiles>>
    WHERE is_default = 1 AND owning_user <> '' AND len({_WORDS}) > 0""",
)
def owners_with_keywords(s: Source) -> DataFrame:
    return an.owners_with_keywords(s.view("job_profiles"))


_DEFAULTS = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owning_user ORDER BY profile_name) AS rn
FROM <<job_profiles>> WHERE is_default = 1) p WHERE rn = 1"""


@query(
    "default_profiles",
    f"SELECT profile_name, owning_user, resume, desired_role_description FROM ({_DEFAULTS}) d",
)
def default_profiles(s: Source) -> DataFrame:
    return sc.default_profiles(s.view("job_profiles")).select(
        "profile_name", "owning_user", "resume", "desired_role_description"
    )


@query(
    "with_default_profile",
    f"""SELECT j.id, j.owning_user, d.profile_name AS profile_profile_name, d.resume AS profile_resume
    FROM <<job_details>> j LEFT JOIN ({_DEFAULTS}) d ON j.owning_user = d.owning_user""",
)
def with_default_profile(s: Source) -> DataFrame:
    return sc.with_default_profile(s.view("job_details"), s.view("job_profiles")).select(
        "id", "owning_user", "profile_profile_name", "profile_resume"
    )


@query(
    "missing_users",
    """SELECT DISTINCT o.owning_user AS username, o.owning_user AS display_name, 'local' AS auth_provider FROM (
      SELECT profile_name AS owning_user FROM <<job_profiles>> UNION ALL SELECT company_name FROM <<scraper_configs>>
      UNION ALL SELECT owning_user FROM <<scraper_configs>>) o
    WHERE o.owning_user <> '' AND NOT EXISTS (SELECT 1 FROM <<users>> u WHERE u.username = o.owning_user)""",
)
def missing_users(s: Source) -> DataFrame:
    profiles = s.view("job_profiles").select(F.col("profile_name").alias("owning_user"))
    configs = s.view("scraper_configs")
    owners = configs.select("owning_user").union(configs.select("company_name"))
    return ch.missing_users(profiles, owners, s.view("users"))


# --- choosing what to score ---------------------------------------------------------------------------


@query(
    "batch_candidates",
    "SELECT * FROM <<job_details>> WHERE security_clearance_required = 0 AND job_score = 0",
)
def batch_candidates(s: Source) -> DataFrame:
    return sc.batch_candidates(s.view("job_details"))


_HIGH = f"""SELECT id, owning_user, title, date_posted FROM <<described_jobs>>
WHERE security_clearance_required = 0 AND job_score < 50 AND job_score_json = '{{}}'
AND title_compatibility_score = 'high' AND date_posted >= DATE '{AS_OF}' - 7 AND trim(description) <> ''"""


def _high(s: Source) -> DataFrame:
    # the derived scores are rarely 0, so half of them count as not scored yet
    jobs = s.view("described_jobs").withColumn(
        "job_score", F.when(F.col("job_score") < 50, 0).otherwise(F.col("job_score"))
    )
    return sc.high_candidates(jobs, AS_OF)


@query("high_candidates", _HIGH)
def high_candidates(s: Source) -> DataFrame:
    return _high(s).select("id", "owning_user", "title", "date_posted")


_REASON = """CASE WHEN d.profile_name IS NULL THEN 'no default profile' WHEN d.resume IS NULL OR d.resume = '' THEN 'no resume'
WHEN d.desired_role_description IS NULL OR d.desired_role_description = '' THEN 'no desired role' END"""


@query(
    "profile_readiness",
    f"""SELECT h.id, h.owning_user, {_REASON} AS skip_reason FROM <<job_details>> h
    LEFT JOIN ({_DEFAULTS}) d ON h.owning_user = d.owning_user""",
)
def profile_readiness(s: Source) -> DataFrame:
    return sc.readiness(s.view("job_details"), s.view("job_profiles")).select(
        "id", "owning_user", "skip_reason"
    )


@query(
    "candidates_by_owner",
    f"""SELECT h.owning_user, {_REASON} AS skip_reason, count(*) AS postings
    FROM <<job_details>> h LEFT JOIN ({_DEFAULTS}) d ON h.owning_user = d.owning_user
    WHERE h.security_clearance_required = 0 AND h.job_score = 0 GROUP BY ALL""",
)
def candidates_by_owner(s: Source) -> DataFrame:
    candidates = sc.batch_candidates(s.view("job_details"))
    return an.candidates_by_owner(sc.readiness(candidates, s.view("job_profiles")))


@query(
    "scoring_readiness",
    """SELECT doc_id, length(trim(text, ' ' || chr(10))) >= 100 AND length(trim(source)) >= 100 AS ready,
    length(trim(text, ' ' || chr(10))) >= 100 AS ready_alone FROM <<documents>>""",
)
def scoring_readiness(s: Source) -> DataFrame:
    return s.table("documents").select(
        "doc_id",
        ready_to_score("source", "text").alias("ready"),
        ready_to_score("text", "text").alias("ready_alone"),
    )
