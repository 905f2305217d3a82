"""Queries over change feeds: replays, renames, and aggregates that follow the changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import fixed_values as fv
from postloom.operators import analytics as an
from postloom.operators import changes as ch
from postloom.operators import deltas, feeds
from postloom.plans.registry import Source, query
from postloom.session import cut_lineage

# --- changes in any order ---------------------------------------------------------------------------

_FEED = """SELECT c_name AS username, CAST(1 AS BIGINT) AS seq, 'U' AS op, 'Old ' || c_name AS display_name, CAST(NULL AS STRING) AS email, c_custkey % 4 AS part FROM <<customer>>
UNION ALL SELECT c_name, 2, 'D', NULL, NULL, (c_custkey + 1) % 4 FROM <<customer>> WHERE c_custkey % 7 = 0
UNION ALL SELECT c_name, 3, 'U', 'New ' || c_name, CASE WHEN c_custkey % 2 = 0 THEN 'new@example.org' END, (c_custkey + 2) % 4 FROM <<customer>> WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_name, 4, 'D', NULL, NULL, (c_custkey + 3) % 4 FROM <<customer>> WHERE c_custkey % 11 = 0"""


@query(
    "replayed_changes",
    f"""WITH cells AS (SELECT username, 0 AS seq, 'U' AS op, display_name, email FROM <<users>>
      UNION ALL SELECT username, seq, op, display_name, email FROM ({_FEED}) f),
    marks AS (SELECT username, max(seq) FILTER (op = 'U') AS seen, coalesce(max(seq) FILTER (op = 'D'), -1) AS gone FROM cells GROUP BY username)
    SELECT c.username, arg_max(c.display_name, c.seq) FILTER (c.op = 'U' AND c.seq > m.gone AND c.display_name IS NOT NULL) AS display_name,
      arg_max(c.email, c.seq) FILTER (c.op = 'U' AND c.seq > m.gone AND c.email IS NOT NULL) AS email
    FROM cells c JOIN marks m ON c.username = m.username WHERE m.seen > m.gone GROUP BY c.username""",
)
def replayed_changes(s: Source) -> DataFrame:
    """Batches of a feed in the wrong order, some twice."""
    state = feeds.state_of(s.view("users").select("username", "display_name", "email"), ["username"])
    feed = s.sql(_FEED)
    for part in (2, 0, 3, 1, 2, 0):
        state = cut_lineage(feeds.merged(state, feed.where(F.col("part") == part), ["username"]), "state")
    return feeds.current(state, ["username"])


# --- profiles that change their name -------------------------------------------------------------------

# free names, names of profiles that stay, names that several want, and chains of names given away
_RENAMES = """SELECT c.c_name AS profile_name, c.c_mktsegment AS owning_user, 'resume of ' || c.c_name AS resume, c.c_custkey AS version,
  CASE c.c_custkey % 5 WHEN 0 THEN c.c_name || ' renamed' WHEN 3 THEN 'shared ' || CAST(CAST(floor(c.c_custkey / 50) AS INTEGER) AS STRING) ELSE n.c_name END AS new_name
FROM <<customer>> c LEFT JOIN <<customer>> n ON n.c_custkey = c.c_custkey + 1 WHERE c.c_custkey % 5 <> 2"""
_RENAMED = f"""SELECT p.*, r.resume AS new_resume, CASE WHEN r.new_name IS NULL THEN p.profile_name
  WHEN p.profile_name LIKE 'Customer%' AND r.new_name LIKE 'shared%' AND p.profile_name > min(CASE WHEN r.new_name LIKE 'shared%' THEN p.profile_name END)
    OVER (PARTITION BY p.owning_user, r.new_name) THEN p.profile_name
  WHEN EXISTS (SELECT 1 FROM <<job_profiles>> o WHERE o.owning_user = p.owning_user AND o.profile_name = r.new_name
    AND NOT EXISTS (SELECT 1 FROM <<customer>> k WHERE k.c_name = o.profile_name AND k.c_custkey % 5 = 0)) THEN p.profile_name
  ELSE r.new_name END AS final_name
FROM <<job_profiles>> p LEFT JOIN ({_RENAMES}) r ON p.profile_name = r.profile_name AND p.owning_user = r.owning_user"""


@query(
    "renamed_profiles",
    f"""SELECT 'profile' AS kind, owning_user, final_name AS profile_name, coalesce(new_resume, resume) AS value,
      CASE WHEN new_resume IS NULL THEN DATE '2024-01-01' ELSE DATE '2024-02-01' END AS date_updated FROM ({_RENAMED}) p
    UNION ALL SELECT 'audit', a.owning_user, p.final_name, a.ats_score, NULL
    FROM <<resume_audits>> a JOIN ({_RENAMED}) p ON a.profile_name = p.profile_name AND a.owning_user = p.owning_user""",
)
def renamed_profiles(s: Source) -> DataFrame:
    """Edit forms with new names, and the audits that follow their profiles."""
    profiles = s.view("job_profiles").select("profile_name", "owning_user", "resume", F.lit("2024-01-01").cast("date").alias("date_updated"))
    after, renames = ch.edit_profiles(profiles, s.sql(_RENAMES), [F.desc("version")], "2024-02-01")
    audits = ch.renamed(s.view("resume_audits"), renames)
    return after.select(F.lit("profile").alias("kind"), "owning_user", "profile_name", F.col("resume").alias("value"), "date_updated").unionByName(
        audits.select(
            F.lit("audit").alias("kind"), "owning_user", "profile_name", F.col("ats_score").alias("value"), F.lit(None).cast("date").alias("date_updated")
        )
    )


# --- aggregates that follow the changes -------------------------------------------------------------------


def _one(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _tier(name: str) -> Column:
    return _one(F.col("title_compatibility_score") == name)


_JOBS = ["id", "owning_user", "site", "search_term", "title_compatibility_score", "review_status"]


def _job_changes(s: Source) -> tuple[DataFrame, DataFrame]:
    """The postings before, and the signed rows of those that were edited, deleted or added."""
    before, after = s.view("job_details").select(*_JOBS), s.view("changed_jobs").select(*_JOBS)
    touched = before.where("id % 5 = 0 OR id % 7 = 0 OR id % 13 = 0").select("id").unionAll(after.where("id < 0").select("id"))
    return before, deltas.changed_rows(before, after, touched, ["id"])


_FUNNEL_SQL = """count(*) AS total,
  CAST(sum(CASE WHEN title_compatibility_score = 'high' AND review_status = 'not_reviewed' THEN 1 ELSE 0 END) AS BIGINT) AS high_unreviewed,
  CAST(sum(CASE WHEN review_status = 'saved' THEN 1 ELSE 0 END) AS BIGINT) AS saved,
  CAST(sum(CASE WHEN review_status = 'applied' THEN 1 ELSE 0 END) AS BIGINT) AS applied,
  CAST(sum(CASE WHEN review_status = 'rejected' THEN 1 ELSE 0 END) AS BIGINT) AS rejected"""


@query("funnel_from_changes", f"SELECT owning_user, {_FUNNEL_SQL} FROM <<changed_jobs>> GROUP BY owning_user")
def funnel_from_changes(s: Source) -> DataFrame:
    before, changes = _job_changes(s)
    status = F.col("review_status")
    sums = {
        "total": F.lit(1),
        "high_unreviewed": _one((F.col("title_compatibility_score") == "high") & (status == "not_reviewed")),
        **{name: _one(status == name) for name in ("saved", "applied", "rejected")},
    }
    return deltas.folded(an.funnel(before), changes, ["owning_user"], sums)


_TIERS_SQL = ", ".join(
    f"CAST(sum(CASE WHEN title_compatibility_score = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS {t}_compat" for t in ("high", "medium", "low")
)


@query(
    "keyword_quality_from_changes",
    f"""SELECT owning_user, search_term AS keyword, count(*) AS total, {_TIERS_SQL} FROM <<changed_jobs>>
    WHERE search_term IS NOT NULL AND search_term <> '' GROUP BY owning_user, search_term""",
)
def keyword_quality_from_changes(s: Source) -> DataFrame:
    before, changes = _job_changes(s)
    said = changes.where(F.col("search_term") != "").withColumnRenamed("search_term", "keyword")
    sums = {"total": F.lit(1), **{f"{t}_compat": _tier(t) for t in ("high", "medium", "low")}}
    return deltas.folded(an.keyword_quality(before), said, ["owning_user", "keyword"], sums)


@query(
    "sources_from_changes",
    """SELECT lower(site) AS site, count(*) AS total, CAST(sum(CASE WHEN title_compatibility_score = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS high_compat
    FROM <<changed_jobs>> WHERE site IS NOT NULL AND site <> '' GROUP BY lower(site)""",
)
def sources_from_changes(s: Source) -> DataFrame:
    before, changes = _job_changes(s)
    said = changes.where(F.col("site") != "").withColumn("site", F.lower("site"))
    return deltas.folded(an.source_effectiveness(before), said, ["site"], {"total": F.lit(1), "high_compat": _tier("high")})


@query(
    "usage_from_changes",
    """SELECT run_id, min(log_ts) AS started_at, count(*) AS call_count, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
    CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
    CAST(sum(cache_hit_tokens) AS BIGINT) AS cache_hit_tokens, CAST(sum(cache_miss_tokens) AS BIGINT) AS cache_miss_tokens
    FROM <<changed_usage>> WHERE call_type = 'title_scoring' GROUP BY run_id""",
)
def usage_from_changes(s: Source) -> DataFrame:
    """Sums by signed rows; the start of a run that lost its first call is read again."""
    columns = ["id", "log_ts", "run_id", "call_type", *fv.USAGE_FIELDS]
    before, after = s.view("llm_usage_log").select(*columns), s.view("changed_usage").select(*columns)
    touched = before.where("id % 9 = 0").select("id").unionAll(after.where("id < 0").select("id"))
    scoring = F.col("call_type") == "title_scoring"
    changes = cut_lineage(deltas.changed_rows(before, after, touched, ["id"]).where(scoring), "changes")
    stored = cut_lineage(an.usage_by_run(before, "title_scoring", "log_ts"), "usage")
    sums = {"call_count": F.lit(1), **{f: F.col(f) for f in fv.USAGE_FIELDS}}
    totals = deltas.folded(stored, changes, ["run_id"], sums)
    starts = deltas.extremes(stored, changes, after.where(scoring), ["run_id"], {"started_at": ("min", "log_ts")})
    return totals.join(starts, "run_id")
