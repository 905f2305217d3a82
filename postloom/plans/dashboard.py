"""Search, tracking and analytics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom import fixed_values as fv
from postloom.operators import analytics as an
from postloom.operators import postings as po
from postloom.operators import search as se
from postloom.operators.ranking import board_slice, places
from postloom.plans.registry import Source, query

OWNER = "FURNITURE"
AS_OF = "2001-08-01"

_TIERS = """count(*) AS total,
  CAST(sum(CASE WHEN title_compatibility_score = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS high_compat,
  CAST(sum(CASE WHEN title_compatibility_score = 'medium' THEN 1 ELSE 0 END) AS BIGINT) AS medium_compat,
  CAST(sum(CASE WHEN title_compatibility_score = 'low' THEN 1 ELSE 0 END) AS BIGINT) AS low_compat"""

_QUALITY = f"""SELECT search_term AS keyword, {_TIERS} FROM <<job_details>>
WHERE owning_user = '{OWNER}' AND search_term IS NOT NULL AND search_term <> '' GROUP BY search_term"""

_LATEST = """SELECT applied_job_id, id AS history_id, status, changed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY applied_job_id ORDER BY changed_at DESC, id DESC) AS rn
  FROM <<applied_job_status_history>>) h WHERE rn = 1"""

_APPLIED = f"""SELECT j.*, coalesce(h.status, 'submitted') AS current_status_latest,
  h.changed_at AS last_status_date
FROM <<job_details>> j LEFT JOIN ({_LATEST}) h ON j.id = h.applied_job_id
WHERE j.review_status = 'applied'"""

_TERMINAL = ", ".join(f"'{s}'" for s in fv.TERMINAL_STATUSES)


# --- postings in numbers -----------------------------------------------------------------------


@query("keyword_quality", _QUALITY)
def keyword_quality(s: Source) -> DataFrame:
    return an.keyword_quality(s.view("job_details"), OWNER)


@query(
    "keyword_quality_order",
    f"SELECT *, row_number() OVER (ORDER BY high_compat DESC, total DESC, keyword) - 1 AS place FROM ({_QUALITY}) q",
)
def keyword_quality_order(s: Source) -> DataFrame:
    return places(an.keyword_quality(s.view("job_details"), OWNER))


@query(
    "keyword_quality_by_owner",
    f"""SELECT owning_user, search_term AS keyword, {_TIERS} FROM <<job_details>>
    WHERE search_term IS NOT NULL AND search_term <> '' GROUP BY owning_user, search_term""",
)
def keyword_quality_by_owner(s: Source) -> DataFrame:
    return an.keyword_quality(s.view("job_details"))


def _share_sql(part: str) -> str:
    return (
        f"CASE WHEN total <> 0 THEN CAST(round_even(100.0 * {part} / total, 1) AS VARCHAR) || '%' "
        f"ELSE '{fv.DASH}' END"
    )


@query(
    "keyword_shares",
    f"""SELECT *, {_share_sql('high_compat')} AS high_share, {_share_sql('medium_compat')} AS medium_share,
    {_share_sql('low_compat')} AS low_share,
    CAST(least(round_even(100.0 * high_compat / total, 0), 100) AS INTEGER) AS high_bar
    FROM ({_QUALITY}) q""",
)
def keyword_shares(s: Source) -> DataFrame:
    return an.keyword_shares(an.keyword_quality(s.view("job_details"), OWNER))


@query(
    "site_breakdown",
    f"""SELECT lower(site) AS site, {_TIERS} FROM <<job_details>>
    WHERE owning_user = '{OWNER}' AND lower(search_term) = 'security' GROUP BY lower(site)""",
)
def site_breakdown(s: Source) -> DataFrame:
    return an.site_breakdown(s.view("job_details"), OWNER, "SECURITY")


@query(
    "site_breakdown_high",
    f"""SELECT lower(site) AS site, {_TIERS} FROM <<job_details>>
    WHERE owning_user = '{OWNER}' AND lower(search_term) = 'security'
    AND lower(title_compatibility_score) = 'high' GROUP BY lower(site)""",
)
def site_breakdown_high(s: Source) -> DataFrame:
    return an.site_breakdown(s.view("job_details"), OWNER, "Security", "High")


_FUNNEL = """count(*) AS total,
  CAST(sum(CASE WHEN title_compatibility_score = 'high' AND review_status = 'not_reviewed' THEN 1 ELSE 0 END) AS BIGINT) AS high_unreviewed,
  CAST(sum(CASE WHEN review_status = 'saved' THEN 1 ELSE 0 END) AS BIGINT) AS saved,
  CAST(sum(CASE WHEN review_status = 'applied' THEN 1 ELSE 0 END) AS BIGINT) AS applied,
  CAST(sum(CASE WHEN review_status = 'rejected' THEN 1 ELSE 0 END) AS BIGINT) AS rejected"""


@query("funnel", f"SELECT {_FUNNEL} FROM <<job_details>> WHERE owning_user = '{OWNER}'")
def funnel(s: Source) -> DataFrame:
    return an.funnel(s.view("job_details"), OWNER)


@query("funnel_no_rows", f"SELECT {_FUNNEL} FROM <<job_details>> WHERE owning_user = 'nobody'")
def funnel_no_rows(s: Source) -> DataFrame:
    return an.funnel(s.view("job_details"), "nobody")


@query(
    "funnel_by_owner", f"SELECT owning_user, {_FUNNEL} FROM <<job_details>> GROUP BY owning_user"
)
def funnel_by_owner(s: Source) -> DataFrame:
    return an.funnel(s.view("job_details"))


@query(
    "source_effectiveness",
    """SELECT lower(site) AS site, count(*) AS total,
    CAST(sum(CASE WHEN title_compatibility_score = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS high_compat
    FROM <<job_details>> WHERE site IS NOT NULL AND site <> '' GROUP BY lower(site)""",
)
def source_effectiveness(s: Source) -> DataFrame:
    return an.source_effectiveness(s.view("job_details"))


_MONTHS = """SELECT owning_user, strftime(applied_at, '%Y-%m') AS month, count(*) AS applied
FROM <<job_details>> WHERE review_status = 'applied' AND applied_at IS NOT NULL GROUP BY ALL"""


@query(
    "applications_timeline",
    f"SELECT month, applied FROM ({_MONTHS}) t WHERE owning_user = '{OWNER}'",
)
def applications_timeline(s: Source) -> DataFrame:
    return an.applications_timeline(s.view("job_details"), OWNER)


@query(
    "timeline_bars",
    f"""SELECT *, CAST(least(round_even(100.0 * applied / max(applied) OVER (PARTITION BY owning_user), 0), 100)
    AS INTEGER) AS bar FROM ({_MONTHS}) t""",
)
def timeline_bars(s: Source) -> DataFrame:
    return an.timeline_bars(an.applications_timeline(s.view("job_details")))


@query(
    "search_terms",
    f"""SELECT DISTINCT search_term FROM <<job_details>>
    WHERE owning_user = '{OWNER}' AND search_term IS NOT NULL AND search_term <> ''""",
)
def search_terms(s: Source) -> DataFrame:
    return an.search_terms(s.view("job_details"), OWNER)


# --- token usage -------------------------------------------------------------------------------

_BY_RUN = """SELECT run_id, min(log_ts) AS started_at, count(*) AS call_count,
  CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  CAST(sum(cache_hit_tokens) AS BIGINT) AS cache_hit_tokens,
  CAST(sum(cache_miss_tokens) AS BIGINT) AS cache_miss_tokens
FROM <<llm_usage_log>> WHERE call_type = 'title_scoring' GROUP BY run_id"""


@query("usage_by_run", f"SELECT *, row_number() OVER (ORDER BY started_at, run_id) - 1 AS place FROM ({_BY_RUN}) r")
def usage_by_run(s: Source) -> DataFrame:
    return places(an.usage_by_run(s.view("llm_usage_log"), "title_scoring", "log_ts"))


def _series_sql(value: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT run_id, started_at, strftime(started_at, '%Y-%m-%d %H:%M') || "
        f"CASE WHEN run_id = '' THEN '{fv.NO_RUN_SUFFIX}' ELSE '' END AS label, "
        f"'{title}' AS measure, CAST({value.format(name)} AS DOUBLE) AS value FROM ({_BY_RUN}) u"
        for name, title in fv.USAGE_SERIES
    )
    return parts


@query("usage_series_total", _series_sql("{}"))
def usage_series_total(s: Source) -> DataFrame:
    return an.usage_series(an.usage_by_run(s.view("llm_usage_log"), "title_scoring", "log_ts"))


@query("usage_series_average", _series_sql("round_even({} / call_count, 1)"))
def usage_series_average(s: Source) -> DataFrame:
    by_run = an.usage_by_run(s.view("llm_usage_log"), "title_scoring", "log_ts")
    return an.usage_series(by_run, "avg")


@query(
    "usage_summary",
    """SELECT run_id, call_type, CAST(grouping(call_type) AS INTEGER) AS is_total, count(*) AS call_count,
    CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
    CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
    CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
    CAST(sum(cache_hit_tokens) AS BIGINT) AS cache_hit_tokens,
    CAST(sum(cache_miss_tokens) AS BIGINT) AS cache_miss_tokens,
    CAST(sum(duration_ms) AS BIGINT) AS duration_ms
    FROM <<llm_usage_log>> GROUP BY GROUPING SETS ((run_id), (run_id, call_type))""",
)
def usage_summary(s: Source) -> DataFrame:
    return an.usage_summary(s.view("llm_usage_log"))


# --- search -----------------------------------------------------------------------------------


@query(
    "search_postings",
    f"""SELECT * FROM <<job_details>> WHERE owning_user = '{OWNER}'
    AND (title ILIKE '%engineer%' OR company ILIKE '%engineer%') AND security_clearance_required = 0
    AND review_status = 'not_reviewed' AND title_compatibility_score = 'high'""",
)
def search_postings(s: Source) -> DataFrame:
    return se.search_postings(
        s.view("job_details"), OWNER, AS_OF, keyword="Engineer", clearance="not_required",
        review_status="not_reviewed", compatibility="high",
    )


@query(
    "search_company_keyword",
    f"""SELECT * FROM <<job_details>> WHERE owning_user = '{OWNER}'
    AND (title ILIKE '%R#0000_0%' OR company ILIKE '%R#0000_0%') AND security_clearance_required = 1""",
)
def search_company_keyword(s: Source) -> DataFrame:
    return se.search_postings(
        s.view("job_details"), OWNER, AS_OF, keyword="r#0000_0", clearance="required",
        review_status="all", compatibility="all",
    )


@query(
    "search_date_ranges",
    " UNION ALL ".join(
        f"SELECT '{word}' AS date_range, * FROM <<job_details>> WHERE owning_user = '{OWNER}' "
        f"AND date_posted >= DATE '{AS_OF}' - {days}"
        for word, days in fv.DATE_RANGE_DAYS.items()
    ),
)
def search_date_ranges(s: Source) -> DataFrame:
    """All ranges in one scan: a posting is in every range that reaches back to it."""
    return se.by_date_range(s.view("job_details").where(F.col("owning_user") == OWNER), AS_OF)


@query(
    "default_search",
    f"""SELECT * FROM <<job_details>> WHERE owning_user = '{OWNER}'
    AND date_posted >= DATE '{AS_OF}' - 7 AND title_compatibility_score = 'high'
    AND security_clearance_required = 0 AND review_status = 'not_reviewed'""",
)
def default_search(s: Source) -> DataFrame:
    return se.default_search(s.view("job_details"), OWNER, AS_OF)


@query(
    "saved_postings",
    f"""SELECT * FROM <<job_details>> WHERE owning_user = '{OWNER}' AND review_status = 'saved'
    AND (title ILIKE '%data%' OR company ILIKE '%data%')""",
)
def saved_postings(s: Source) -> DataFrame:
    return se.saved_postings(s.view("job_details"), OWNER, AS_OF, "data")


@query("latest_status", _LATEST)
def latest_status(s: Source) -> DataFrame:
    return se.latest_status(s.view("applied_job_status_history"))


@query("applied_with_status", _APPLIED)
def applied_with_status(s: Source) -> DataFrame:
    return se.applied_with_status(s.view("job_details"), s.view("applied_job_status_history"))


@query(
    "applied_by_status",
    f"""SELECT * FROM ({_APPLIED}) a WHERE owning_user = '{OWNER}'
    AND (title ILIKE '%a%' OR company ILIKE '%a%') AND current_status_latest = 'submitted'""",
)
def applied_by_status(s: Source) -> DataFrame:
    return se.search_applied(
        s.view("job_details"), s.view("applied_job_status_history"), OWNER, "a", "submitted"
    )


@query(
    "open_applications",
    f"""SELECT * FROM ({_APPLIED}) a WHERE owning_user = '{OWNER}'
    AND current_status_latest NOT IN ({_TERMINAL})""",
)
def open_applications(s: Source) -> DataFrame:
    return se.open_applications(
        s.view("job_details"), s.view("applied_job_status_history"), OWNER
    )


@query(
    "status_timeline",
    """SELECT *, row_number() OVER (ORDER BY applied_job_id, changed_at DESC NULLS LAST, id DESC) - 1 AS place
    FROM <<applied_job_status_history>>""",
)
def status_timeline(s: Source) -> DataFrame:
    return places(se.status_timeline(s.view("applied_job_status_history")))


def _page_sql(source: str, order: str, number: int) -> str:
    return f"SELECT * FROM ({source}) p ORDER BY {order} LIMIT 100 OFFSET {(number - 1) * 100}"


_MINE = f"SELECT * FROM <<job_details>> WHERE owning_user = '{OWNER}'"


@query("search_page_by_score", _page_sql(_MINE, "job_score DESC NULLS LAST, id", 1))
def search_page_by_score(s: Source) -> DataFrame:
    found = se.search_postings(s.view("job_details"), OWNER, AS_OF)
    return se.page(found, se.posting_order("score"))


@query("search_page_by_title", _page_sql(_MINE, "title NULLS FIRST, id", 2))
def search_page_by_title(s: Source) -> DataFrame:
    found = se.search_postings(s.view("job_details"), OWNER, AS_OF)
    return se.page(found, se.posting_order("title"), 2)


@query("search_page_by_date", _page_sql(_MINE, "date_posted DESC NULLS LAST, id", 3))
def search_page_by_date(s: Source) -> DataFrame:
    found = se.search_postings(s.view("job_details"), OWNER, AS_OF)
    return se.page(found, se.posting_order("unknown"), 3)


_MINE_APPLIED = f"SELECT * FROM ({_APPLIED}) a WHERE owning_user = '{OWNER}'"


@query(
    "applied_page_recent",
    _page_sql(
        _MINE_APPLIED, "last_status_date DESC NULLS LAST, applied_at DESC NULLS LAST, id", 1
    ),
)
def applied_page_recent(s: Source) -> DataFrame:
    found = se.search_applied(s.view("job_details"), s.view("applied_job_status_history"), OWNER)
    return se.page(found, se.applied_order("recent_activity"))


@query("applied_page_by_company", _page_sql(_MINE_APPLIED, "company NULLS FIRST, id", 1))
def applied_page_by_company(s: Source) -> DataFrame:
    found = se.search_applied(s.view("job_details"), s.view("applied_job_status_history"), OWNER)
    return se.page(found, se.applied_order("company"))


@query(
    "page_summary",
    f"""SELECT count(*) AS total, CAST(ceil(count(*) / 100.0) AS BIGINT) AS pages, count(*) > 100 AS has_more,
    CAST(count(*) AS VARCHAR) || CASE WHEN count(*) = 1 THEN ' job' ELSE ' jobs' END
    || CASE WHEN count(*) > 100 THEN ' (showing first 100)' ELSE '' END AS count_label
    FROM ({_MINE}) m""",
)
def page_summary(s: Source) -> DataFrame:
    return se.page_summary(se.search_postings(s.view("job_details"), OWNER, AS_OF))


@query(
    "result_order",
    """SELECT id, job_url, site, date_posted,
    row_number() OVER (ORDER BY site NULLS FIRST, date_posted DESC NULLS LAST, job_url) - 1 AS place FROM <<job_details>>""",
)
def result_order(s: Source) -> DataFrame:
    return places(po.result_order(s.view("job_details").select("id", "job_url", "site", "date_posted")))


@query(
    "board_slice",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, search_term ORDER BY date_posted DESC, id) AS rn
    FROM <<job_details>>) r WHERE rn > 10 AND rn <= 60""",
)
def board_results(s: Source) -> DataFrame:
    jobs = s.view("job_details")
    keys = ["site", "search_term"]
    order = [F.desc("date_posted"), F.asc("id")]
    kept = board_slice(jobs, keys, order, wanted=50, offset=10)
    place = kept.withColumn("rn", F.row_number().over(_board_window(keys, order)) + 10)
    return place.withColumn("rn", F.col("rn").cast("bigint"))


def _board_window(keys: list[str], order: list) -> object:
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


# --- lookups and lists ---------------------------------------------------------------------------


@query("key_lookup", f"SELECT * FROM <<job_details>> WHERE id = 42 AND owning_user = '{OWNER}'")
def key_lookup(s: Source) -> DataFrame:
    return se.lookup(s.view("job_details"), id=42, owning_user=OWNER)


@query(
    "local_users",
    """SELECT *, row_number() OVER (ORDER BY display_name NULLS FIRST, username) - 1 AS place
    FROM <<users>> WHERE auth_provider = 'local'""",
)
def local_users(s: Source) -> DataFrame:
    return places(se.lookup(s.view("users"), auth_provider="local").orderBy("display_name", "username"))


@query(
    "listing_columns",
    """SELECT username, display_name, email, row_number() OVER (ORDER BY display_name NULLS FIRST, username) - 1 AS place
    FROM <<users>>""",
)
def listing_columns(s: Source) -> DataFrame:
    users = s.view("users").withColumn("picture_blob", F.encode("picture_url", "UTF-8"))
    listed = se.without_blobs(users).select("username", "display_name", "email")
    return places(listed.orderBy("display_name", "username"))


@query(
    "bulk_rule_matches",
    """SELECT id, title, company, review_status FROM <<job_details>> WHERE date_posted = DATE '2000-03-01'
    AND (company ILIKE '%#0000%' OR company ILIKE '%9') AND title ILIKE 's%'
    AND review_status IS DISTINCT FROM 'rejected'""",
)
def bulk_rule_matches(s: Source) -> DataFrame:
    rule = se.rule_matches("2000-03-01", ["%#0000%", "%9"], "s%")
    return s.view("job_details").where(rule).select("id", "title", "company", "review_status")


@query(
    "bulk_rule_count",
    """SELECT count(*) AS touched FROM <<job_details>> WHERE date_posted = DATE '2000-03-01'
    AND (company ILIKE '%#0000%' OR company ILIKE '%9') AND title ILIKE 's%'
    AND review_status IS DISTINCT FROM 'rejected'""",
)
def bulk_rule_count(s: Source) -> DataFrame:
    rule = se.rule_matches("2000-03-01", ["%#0000%", "%9"], "s%")
    return s.view("job_details").where(rule).agg(an.count_rows().alias("touched"))


@query(
    "posting_cards",
    """SELECT id, title, company, score,
    CASE WHEN lo <> '' AND hi <> '' THEN currency || lo || '–' || hi WHEN lo <> '' THEN currency || lo || '+' ELSE '' END AS salary,
    needs_clearance, CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'middle' WHEN score > 0 THEN 'low' ELSE 'none' END AS score_band,
    compatibility, review_status, date_posted, is_remote, decision, travel FROM (
      SELECT id, title, company, job_score AS score, currency,
      CASE WHEN min_amount IS NULL OR min_amount = 0 THEN '' ELSE CAST(CAST(min_amount AS BIGINT) AS VARCHAR) END AS lo,
      CASE WHEN max_amount IS NULL OR max_amount = 0 THEN '' ELSE CAST(CAST(max_amount AS BIGINT) AS VARCHAR) END AS hi,
      security_clearance_required = 1 AS needs_clearance, coalesce(title_compatibility_score, '') AS compatibility,
      review_status, strftime(date_posted, '%Y-%m-%d') AS date_posted,
      coalesce(lower(is_remote) IN ('true', '1', 'yes'), false) AS is_remote,
      job_score_json->>'$.decision' AS decision, CAST(NULL AS VARCHAR) AS travel
      FROM <<described_jobs>>) c""",
)
def posting_cards(s: Source) -> DataFrame:
    return se.cards(s.view("described_jobs"))
