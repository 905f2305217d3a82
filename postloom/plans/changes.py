"""Table change queries: each returns the table as it is after the change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators import analytics as an
from postloom.operators import changes as ch
from postloom.operators import search as se
from postloom.operators import titles as ti
from postloom.plans.registry import Source, query
from postloom.session import cut_lineage

AS_OF = "2001-08-01"
_KEPT = f"""(review_status IN ('saved', 'applied') OR NOT (date_posted < DATE '{AS_OF}' - 60))"""


# --- upserts --------------------------------------------------------------------------------------


@query(
    "upsert_users",
    """SELECT coalesce(u.username, c.username) AS username, coalesce(c.display_name, u.display_name) AS display_name,
    coalesce(c.picture_url, u.picture_url) AS picture_url,
    CASE WHEN u.username IS NULL THEN c.email WHEN c.username IS NULL THEN u.email WHEN u.email = '' THEN c.email ELSE u.email END AS email,
    coalesce(u.auth_provider, c.auth_provider) AS auth_provider
    FROM <<users>> u FULL JOIN (SELECT * FROM <<user_changes>> WHERE version = 2) c ON u.username = c.username""",
)
def upsert_users(s: Source) -> DataFrame:
    return ch.upsert_users(s.view("users"), s.view("user_changes"), [F.desc("version")])


@query(
    "insert_or_ignore_users",
    """SELECT username, email FROM <<users>> UNION ALL
    SELECT username, email FROM <<user_changes>> c WHERE version = 2 AND NOT EXISTS (SELECT 1 FROM <<users>> u WHERE u.username = c.username)""",
)
def insert_or_ignore_users(s: Source) -> DataFrame:
    users = s.view("users").select("username", "email")
    changes = s.view("user_changes").select("username", "email", "version")
    return ch.insert_or_ignore(users, changes, ["username"], [F.desc("version")])


def _twice(changes: DataFrame, column: str) -> DataFrame:
    """Every change as version 2, after an older one that must not count."""
    old = changes.withColumn(column, F.lit("stale"))
    return changes.withColumn("version", F.lit(2)).unionByName(old.withColumn("version", F.lit(1)))


_CONFIG_CHANGES = """SELECT config_key, CASE WHEN config_type = 'usajobs' THEN 'NEW' ELSE owning_user END AS owning_user,
  'changed ' || company_name AS company_name, '{}' AS config_json FROM <<scraper_configs>> WHERE config_type <> 'eightfold'"""


@query(
    "upsert_configs",
    f"""SELECT coalesce(c.config_key, n.config_key) AS config_key, coalesce(c.owning_user, n.owning_user) AS owning_user,
    coalesce(n.company_name, c.company_name) AS company_name, coalesce(n.config_json, c.config_json) AS config_json, c.config_type
    FROM <<scraper_configs>> c FULL JOIN ({_CONFIG_CHANGES}) n ON c.config_key = n.config_key AND c.owning_user = n.owning_user""",
)
def upsert_configs(s: Source) -> DataFrame:
    return ch.upsert_configs(s.view("scraper_configs"), _twice(s.sql(_CONFIG_CHANGES), "config_json"), [F.desc("version")])


@query(
    "upsert_profiles",
    """SELECT profile_name, owning_user, CASE WHEN is_default = 1 THEN resume ELSE 'new resume' END AS resume, location,
      CASE WHEN is_default = 1 THEN DATE '2024-01-01' ELSE DATE '2024-02-01' END AS date_updated FROM <<job_profiles>>
    UNION ALL SELECT c_name || ' copy', c_mktsegment, 'new resume', NULL, DATE '2024-02-01' FROM <<customer>>
    UNION ALL SELECT profile_name || ' other', owning_user, 'new resume', NULL, DATE '2024-02-01' FROM <<job_profiles>> WHERE is_default = 1""",
)
def upsert_profiles(s: Source) -> DataFrame:
    """Every profile is sent in, those of defaults under a name that is new, and a copy of each."""
    held = s.view("job_profiles")
    profiles = held.select(
        "profile_name", "owning_user", "resume", "location", F.lit("2024-01-01").cast("date").alias("date_updated")
    )
    name = F.when(F.col("is_default") == 1, F.concat("profile_name", F.lit(" other"))).otherwise(F.col("profile_name"))
    sent = held.select(
        F.explode(F.array(name, F.concat("profile_name", F.lit(" copy")))).alias("profile_name"),
        "owning_user",
        F.lit("new resume").alias("resume"),
    )
    return ch.upsert_profiles(profiles, _twice(sent, "resume"), [F.desc("version")], "2024-02-01")


_FRESH = """SELECT owning_user, 'role 1' AS role_normalized, lower(title) AS title_normalized, 'low' AS score
FROM (SELECT DISTINCT owning_user, title FROM <<incoming_postings>>) i"""


@query(
    "upsert_cache",
    f"""SELECT coalesce(c.owning_user, f.owning_user) AS owning_user, coalesce(c.role_normalized, f.role_normalized) AS role_normalized,
    coalesce(c.title_normalized, f.title_normalized) AS title_normalized, coalesce(f.score, c.score) AS score,
    CASE WHEN f.score IS NOT NULL THEN DATE '2024-02-01' ELSE c.date_updated END AS date_updated
    FROM <<title_score_cache>> c FULL JOIN ({_FRESH}) f ON c.owning_user = f.owning_user
    AND c.role_normalized = f.role_normalized AND c.title_normalized = f.title_normalized""",
)
def upsert_cache(s: Source) -> DataFrame:
    fresh = ti.unique_titles(s.view("incoming_postings"), "owning_user").select(
        "owning_user", F.lit("ROLE  1").alias("desired_role"), "title", F.lit("low").alias("score")
    )
    rows = ti.cache_rows(fresh, F.lit("2024-02-01").cast("date"))
    return ch.upsert_cache(s.view("title_score_cache"), rows, [F.asc("title_raw")])


@query(
    "prune_cache",
    "SELECT * FROM <<title_score_cache>> WHERE date_updated >= DATE '2024-01-31' - 90",
)
def prune_cache(s: Source) -> DataFrame:
    return ch.prune_cache(s.view("title_score_cache"), "2024-01-31", 90)


# --- postings -------------------------------------------------------------------------------------


@query(
    "keyed_update",
    """SELECT j.id, j.owning_user, CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'saved' ELSE j.review_status END AS review_status,
    j.title FROM <<job_details>> j JOIN <<orders>> o ON j.id = o.o_orderkey""",
)
def keyed_update(s: Source) -> DataFrame:
    jobs = s.view("job_details").select("id", "owning_user", "review_status", "title")
    urgent = s.sql(
        """SELECT j.id, j.owning_user, 'saved' AS review_status, CAST(NULL AS STRING) AS title
        FROM <<job_details>> j JOIN <<orders>> o ON j.id = o.o_orderkey WHERE o.o_orderpriority = '1-URGENT'"""
    )
    return ch.update(jobs, _twice(urgent, "review_status"), ch.POSTING_OWNER, [F.desc("version")])


_REQUESTS = """SELECT DISTINCT l_orderkey AS id, 'FURNITURE' AS owning_user FROM <<lineitem>> WHERE l_returnflag = 'R'"""


@query(
    "apply_postings",
    f"""SELECT j.id, j.owning_user, CASE WHEN r.id IS NOT NULL THEN 'applied' ELSE j.review_status END AS review_status,
    CASE WHEN r.id IS NOT NULL THEN DATE '{AS_OF}' ELSE j.applied_at END AS applied_at
    FROM <<job_details>> j LEFT JOIN ({_REQUESTS}) r ON j.id = r.id AND j.owning_user = r.owning_user""",
)
def apply_postings(s: Source) -> DataFrame:
    postings, _ = _applied(s)
    return postings.select("id", "owning_user", "review_status", "applied_at")


@query(
    "apply_history",
    f"""SELECT applied_job_id, status, changed_at FROM <<applied_job_status_history>> UNION ALL
    SELECT j.id, 'submitted', DATE '{AS_OF}' FROM <<job_details>> j JOIN ({_REQUESTS}) r ON j.id = r.id AND j.owning_user = r.owning_user""",
)
def apply_history(s: Source) -> DataFrame:
    _, history = _applied(s)
    return history.select("applied_job_id", "status", "changed_at")


def _applied(s: Source) -> tuple[DataFrame, DataFrame]:
    return ch.apply_to(
        s.view("job_details"), s.view("applied_job_status_history"), s.sql(_REQUESTS), AS_OF
    )


def _undone(s: Source) -> tuple[DataFrame, DataFrame]:
    return ch.undo_application(
        s.view("job_details"), s.view("applied_job_status_history"), s.sql(_REQUESTS), "saved"
    )


@query(
    "move_to_saved",
    f"""SELECT j.id, j.owning_user, CASE WHEN r.id IS NOT NULL THEN 'saved' ELSE j.review_status END AS review_status,
    CASE WHEN r.id IS NULL THEN j.applied_at END AS applied_at
    FROM <<job_details>> j LEFT JOIN ({_REQUESTS}) r ON j.id = r.id AND j.owning_user = r.owning_user""",
)
def move_to_saved(s: Source) -> DataFrame:
    return _undone(s)[0].select("id", "owning_user", "review_status", "applied_at")


@query(
    "withdrawn_history",
    f"""SELECT * FROM <<applied_job_status_history>> h WHERE NOT EXISTS (SELECT 1 FROM ({_REQUESTS}) r
    JOIN <<job_details>> j ON j.id = r.id AND j.owning_user = r.owning_user WHERE r.id = h.applied_job_id)""",
)
def withdrawn_history(s: Source) -> DataFrame:
    return _undone(s)[1]


@query(
    "manual_postings",
    f"""SELECT 'https://m.example.com/' || CAST(o_orderkey AS VARCHAR) AS job_url, 'manual' AS site, '' AS title,
    o_totalprice AS min_amount, false AS is_remote, 1 AS security_clearance_required, 'applied' AS review_status,
    DATE '{AS_OF}' AS date_posted, coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END, DATE '{AS_OF}') AS applied_at
    FROM <<orders>>""",
)
def manual_postings(s: Source) -> DataFrame:
    forms = s.sql(
        """SELECT 'https://m.example.com/' || CAST(o_orderkey AS STRING) AS job_url, 'FURNITURE' AS owning_user,
        CAST(o_totalprice AS STRING) AS min_amount, 1 AS security_clearance_required,
        CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE '' END AS applied_at FROM <<orders>>"""
    )
    return ch.manual_postings(forms, AS_OF, applied=True).select(
        "job_url", "site", "title", "min_amount", "is_remote", "security_clearance_required",
        "review_status", "date_posted", "applied_at",
    )


@query(
    "manual_history",
    f"""SELECT 'https://m.example.com/' || CAST(o_orderkey AS VARCHAR) AS job_url, 'submitted' AS status, 'Manually added' AS notes,
    DATE '{AS_OF}' AS changed_at FROM <<orders>>""",
)
def manual_history(s: Source) -> DataFrame:
    forms = s.sql(
        """SELECT 'https://m.example.com/' || CAST(o_orderkey AS STRING) AS job_url, 'FURNITURE' AS owning_user FROM <<orders>>"""
    )
    # ids are given once, by the write
    stored = cut_lineage(ch.manual_postings(forms, AS_OF, applied=True, first_id=500), "manual")
    history = ch.manual_history(stored, AS_OF)
    named = stored.select(F.col("id").alias("applied_job_id"), "job_url")
    # both sides are as long as the forms; their files are small for their rows, and by these the planner would broadcast one
    return history.join(named.hint("merge"), "applied_job_id").select("job_url", "status", "notes", "changed_at")


_FEED = """SELECT CASE l_returnflag WHEN 'N' THEN 'I' WHEN 'R' THEN 'U' ELSE 'D' END AS op, l_orderkey * 10 + l_linenumber AS id,
  l_orderkey AS applied_job_id, 'offer' AS status, 'n' AS notes, min(l_partkey) AS seq,
  CASE WHEN l_returnflag = 'N' THEN CAST(NULL AS DATE) ELSE CAST(min(l_shipdate) AS DATE) END AS changed_at
FROM <<lineitem>> GROUP BY l_returnflag, l_orderkey, l_linenumber"""
_LAST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, op DESC) AS rn
FROM ({_FEED}) f WHERE op <> 'I') x WHERE rn = 1"""


@query(
    "status_events",
    f"""SELECT h.applied_job_id, CASE WHEN x.op = 'U' THEN x.status ELSE h.status END AS status,
      CASE WHEN x.op = 'U' THEN x.changed_at ELSE h.changed_at END AS changed_at
    FROM <<applied_job_status_history>> h LEFT JOIN ({_LAST}) x ON h.id = x.id WHERE x.op IS NULL OR x.op <> 'D'
    UNION ALL SELECT applied_job_id, status, DATE '{AS_OF}' FROM ({_FEED}) f WHERE op = 'I'""",
)
def status_events(s: Source) -> DataFrame:
    # equal sequence numbers are told apart by the operation
    feed = s.sql(_FEED).withColumn("seq", F.struct("seq", "op"))
    history = s.view("applied_job_status_history")
    return ch.status_events(history, feed, AS_OF).select("applied_job_id", "status", "changed_at")


@query(
    "edited_fields",
    """SELECT id, CASE WHEN amount IN ('n/a') OR contains(amount, '$') OR contains(amount, 'EUR') THEN NULL ELSE CAST(amount AS DOUBLE) END AS min_amount
    FROM <<money_texts>>""",
)
def edited_fields(s: Source) -> DataFrame:
    forms = s.view("money_texts").select(
        "id", F.col("amount").alias("min_amount"), F.col("amount").alias("max_amount"),
        F.lit("").alias("applied_at"),
    )
    return ch.edited_fields(forms).select("id", "min_amount")


@query(
    "edit_postings",
    """SELECT j.id, j.owning_user, CASE WHEN m.id IS NULL THEN j.title ELSE '' END AS title,
    CASE WHEN m.id IS NULL THEN j.min_amount WHEN m.amount = 'n/a' OR contains(m.amount, '$') OR contains(m.amount, 'EUR') THEN NULL
      ELSE CAST(m.amount AS DOUBLE) END AS min_amount, CASE WHEN m.id IS NULL THEN j.applied_at END AS applied_at, j.review_status
    FROM <<job_details>> j LEFT JOIN <<money_texts>> m ON j.id = m.id AND j.owning_user = 'FURNITURE'""",
)
def edit_postings(s: Source) -> DataFrame:
    jobs = s.view("job_details").select(
        "id", "owning_user", "title", "min_amount", "applied_at", "review_status"
    )
    forms = s.view("money_texts").select(
        "id", F.lit("FURNITURE").alias("owning_user"), F.lit("").alias("title"),
        F.col("amount").alias("min_amount"), F.col("amount").alias("max_amount"),
        F.lit("").alias("applied_at"),
    )
    return ch.edit_postings(jobs, forms)


@query("expired_postings", f"SELECT * FROM <<job_details>> WHERE NOT {_KEPT}")
def expired_postings(s: Source) -> DataFrame:
    return _dated(s).where(ch.is_expired(AS_OF, 60)).drop("date_created")


def _dated(s: Source) -> DataFrame:
    return s.view("job_details").withColumn("date_created", F.col("date_posted"))


@query(
    "expired_count", f"SELECT count(*) AS expired FROM <<job_details>> WHERE NOT {_KEPT}"
)
def expired_count(s: Source) -> DataFrame:
    return _dated(s).where(ch.is_expired(AS_OF, 60)).agg(an.count_rows().alias("expired"))


@query("retention_postings", f"SELECT * FROM <<job_details>> WHERE {_KEPT}")
def retention_postings(s: Source) -> DataFrame:
    kept, _ = ch.drop_expired(_dated(s), s.view("applied_job_status_history"), AS_OF, "60")
    return kept.drop("date_created")


@query(
    "retention_history",
    f"""SELECT h.* FROM <<applied_job_status_history>> h
    WHERE EXISTS (SELECT 1 FROM <<job_details>> j WHERE j.id = h.applied_job_id AND {_KEPT})""",
)
def retention_history(s: Source) -> DataFrame:
    _, history = ch.drop_expired(_dated(s), s.view("applied_job_status_history"), AS_OF, 60)
    return history


@query("retention_unset", "SELECT * FROM <<job_details>>")
def retention_unset(s: Source) -> DataFrame:
    kept, _ = ch.drop_expired(_dated(s), s.view("applied_job_status_history"), AS_OF, "never")
    return kept.drop("date_created")


@query(
    "backfill_clearance",
    """SELECT id, CASE WHEN security_clearance_required = 1 OR id % 9 = 2 THEN 1 ELSE 0 END AS security_clearance_required
    FROM <<described_jobs>>""",
)
def backfill_clearance(s: Source) -> DataFrame:
    return ch.backfill_clearance(s.view("described_jobs")).select("id", "security_clearance_required")


@query(
    "fill_missing_scores",
    """SELECT id, title, CASE WHEN title_compatibility_score IS NULL OR title_compatibility_score = '' THEN
      CASE WHEN contains(title, 'Data') THEN 'high' ELSE 'low' END ELSE title_compatibility_score END AS title_compatibility_score
    FROM <<job_details>>""",
)
def fill_missing_scores(s: Source) -> DataFrame:
    """Scores of all titles; those without the word are of owners who have no postings."""
    jobs = s.view("job_details")
    found = ti.unique_titles(ti.without_score(jobs), "owning_user")
    owner = F.when(F.col("title").contains("Data"), F.col("owning_user")).otherwise(F.concat(F.lit("former "), "owning_user"))
    scores = found.withColumn("owning_user", owner).withColumn(
        "role", F.explode(F.array(F.struct(F.lit("a").alias("desired_role"), F.lit("high").alias("score")),
                                  F.struct(F.lit("b").alias("desired_role"), F.lit("low").alias("score"))))
    ).select("owning_user", "title", "role.*")
    return ti.fill_missing_scores(jobs, scores).select("id", "title", "title_compatibility_score")


@query(
    "bulk_reject",
    """SELECT id, CASE WHEN date_posted = DATE '2000-03-01' AND company ILIKE '%#0000%' AND title ILIKE '%a%'
      THEN 'rejected' ELSE review_status END AS review_status FROM <<job_details>>""",
)
def bulk_reject(s: Source) -> DataFrame:
    rule = se.rule_matches("2000-03-01", ["%#0000%"], "%a%")
    return ch.bulk_status(s.view("job_details"), rule).select("id", "review_status")


@query(
    "write_back",
    """SELECT j.id, CASE WHEN r.job_score_json->>'$.schema_version' = '1.0'
      THEN CAST(r.job_score_json->>'$.ats_score_estimate.total_overall_score' AS BIGINT)
      ELSE CAST(trunc(coalesce(CAST(r.job_score_json->>'$.score.final_score' AS DOUBLE), 0) * 100) AS BIGINT) END AS job_score,
    r.job_score_json FROM <<described_jobs>> j JOIN <<results_json>> r ON j.id = r.id""",
)
def write_back(s: Source) -> DataFrame:
    results = s.view("results_json").withColumn("usage_metrics", F.lit("{}"))
    return ch.write_back(s.view("described_jobs"), results).select("id", "job_score", "job_score_json")


@query(
    "set_default_profile",
    """SELECT p.profile_name, p.owning_user, CASE WHEN c.owning_user IS NULL THEN p.is_default
      WHEN p.profile_name = c.profile_name THEN 1 ELSE 0 END AS is_default
    FROM <<job_profiles>> p LEFT JOIN (SELECT owning_user, min(profile_name) AS profile_name FROM <<job_profiles>>
      WHERE owning_user IN ('FURNITURE', 'HOUSEHOLD') GROUP BY owning_user) c ON p.owning_user = c.owning_user""",
)
def set_default_profile(s: Source) -> DataFrame:
    profiles = s.view("job_profiles").select("profile_name", "owning_user", "is_default")
    chosen = (
        profiles.where(F.col("owning_user").isin("FURNITURE", "HOUSEHOLD"))
        .groupBy("owning_user")
        .agg(F.min("profile_name").alias("profile_name"))
    )
    return ch.set_default_profile(profiles, chosen)


@query(
    "delete_configs",
    """SELECT config_key, owning_user, config_type FROM <<scraper_configs>> WHERE config_type <> 'usajobs'""",
)
def delete_configs(s: Source) -> DataFrame:
    configs = s.view("scraper_configs").select("config_key", "owning_user", "config_type")
    gone = configs.where(F.col("config_type") == "usajobs")
    return ch.delete(configs, gone, ["config_key", "owning_user"])


@query(
    "schema_change",
    """SELECT config_key, owning_user, 'none' AS notes FROM <<scraper_configs>>""",
)
def schema_change(s: Source) -> DataFrame:
    configs = s.view("scraper_configs").select("config_key", "owning_user", "config_json")
    changed = ch.add_column(ch.drop_column(configs, "config_json"), "notes", "string", "none")
    return ch.add_column(changed, "notes", "string", "again")


@query(
    "folded_configs",
    """SELECT owning_user, config_type || '_params' AS params_key, CASE WHEN config_type <> 'usajobs' THEN config_key END AS config_key,
    arg_max(config_json->>'$.base_url', company_name) AS base_url, arg_max(config_json->>'$.company_name', company_name) AS company
    FROM <<scraper_configs>> GROUP BY 1, 2, 3""",
)
def folded_configs(s: Source) -> DataFrame:
    folded = an.folded_configs(s.view("scraper_configs"))
    return folded.select(
        "owning_user", "params_key", "config_key", F.col("config")["base_url"].alias("base_url"),
        F.col("config")["company_name"].alias("company"),
    )


_COUNTED = ["job_details", "applied_job_status_history", "scraping_logs", "llm_usage_log",
            "title_score_cache", "job_profiles", "scraper_configs", "users"]


@query(
    "table_counts",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS \"rows\" FROM <<{name}>>" for name in _COUNTED
    ),
)
def table_counts(s: Source) -> DataFrame:
    return an.row_counts({name: s.view(name) for name in _COUNTED})
