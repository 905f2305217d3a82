"""Text, pay, place, url and result rules run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom import dims
from postloom import fixed_values as fv
from postloom.functions import dates, jobtypes, pay, places, results, text, urls
from postloom.operators import configs as co
from postloom.operators import scoring as sc
from postloom.plans.registry import Source, query

# --- text -----------------------------------------------------------------------------------------


@query(
    "normalized_titles",
    """SELECT probe_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS title_normalized,
    lower(trim(regexp_replace(desired_role, '\\s+', ' ', 'g'))) AS role_normalized FROM <<title_probes>>""",
)
def normalized_titles(s: Source) -> DataFrame:
    return s.view("title_probes").select(
        "probe_id",
        text.normalize_text("title").alias("title_normalized"),
        text.normalize_text("desired_role").alias("role_normalized"),
    )


_EMAILS = "regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')"


@query(
    "text_emails",
    f"""SELECT doc_id, CASE WHEN text <> '' THEN array_to_string({_EMAILS}, ', ') END AS emails,
    CASE WHEN text <> '' THEN len({_EMAILS}) END AS n_emails FROM <<documents>>""",
)
def text_emails(s: Source) -> DataFrame:
    found = s.table("documents").select("doc_id", text.emails("text").alias("_e"))
    return found.select(
        "doc_id", F.array_join("_e", ", ").alias("emails"), F.size("_e").cast("bigint").alias("n_emails")
    )


_LINES = "regexp_replace(regexp_replace(text, '\\r\\n|[\\n\\x0B\\f\\r\\x1C-\\x1E]|\\x{85}|\\x{2028}|\\x{2029}', chr(10), 'g'), '\\n$', '')"


@query(
    "remove_pii",
    f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      CASE WHEN text = '' THEN '' ELSE
        regexp_replace(split_part(t, chr(10), 1), '^(\\*\\*)?[A-Za-z]+ [A-Za-z]+(\\*\\*)?', '{fv.PII_NAME_TEXT}')
        || chr(10) || substr(t, length(split_part(t, chr(10), 1)) + 2) END,
      '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b', '{fv.PII_EMAIL_TEXT}', 'g'),
      '(?:\\(\\d{{3}}\\)[\\s.-]*|\\b\\d{{3}}[\\s.-]+)\\d{{3}}[\\s.-]+\\d{{4}}\\b', '{fv.PII_PHONE_TEXT}', 'g'),
      '<a\\s[^>]*>(.*?)</a>', '\\1', 'g'),
      'http\\S+|www.\\S+', '{fv.PII_URL_TEXT}', 'g') AS text
    FROM (SELECT doc_id, text, {_LINES} AS t FROM <<documents>>) d""",
)
def remove_pii(s: Source) -> DataFrame:
    return s.table("documents").select("doc_id", text.remove_pii("text").alias("text"))


_PHRASES = " OR ".join(f"contains(x, '{p}')" for p in fv.REDACT_PHRASES)
_CUT = f"list_position(list_transform(lines, lambda x: starts_with(x, '{fv.REDACT_CUT_PREFIX}')), true)"


@query(
    "redact",
    f"""SELECT doc_id, array_to_string(list_filter(
      CASE WHEN coalesce({_CUT}, 0) > 0 THEN lines[1:{_CUT} - 1] ELSE lines END,
      lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '' AND NOT ({_PHRASES})), chr(10)) AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM <<documents>>) d""",
)
def redact(s: Source) -> DataFrame:
    return s.table("documents").select("doc_id", text.redact("text").alias("text"))


_CLEARED = """CASE WHEN regexp_matches(description, '(?i)\\b(current|active|required|requirement|requires)\\s+(?:\\S+\\s+){0,10}(security clearance|TS/SCI|public trust|secret|top.secret)\\b')
  OR regexp_matches(title, '(?i)\\b(current|active|with).*(security clearance|TS/SCI|public trust|secret|top.secret)\\b') THEN 1 ELSE 0 END"""


@query("clearance_flag", f"SELECT id, {_CLEARED} AS required FROM <<clearance_texts>>")
def clearance_flag(s: Source) -> DataFrame:
    return s.view("clearance_texts").select(
        "id", text.clearance_flag("description", "title").alias("required")
    )


_TYPE_WORDS = """list_filter([CASE WHEN regexp_matches(description, '(?i)full\\s?time') THEN 'fulltime' END,
  CASE WHEN regexp_matches(description, '(?i)part\\s?time') THEN 'parttime' END,
  CASE WHEN regexp_matches(description, '(?i)internship') THEN 'internship' END,
  CASE WHEN regexp_matches(description, '(?i)contract') THEN 'contract' END], lambda x: x IS NOT NULL)"""


@query(
    "text_job_types",
    f"""SELECT id, CASE WHEN len({_TYPE_WORDS}) > 0 THEN array_to_string({_TYPE_WORDS}, ', ') END AS job_types
    FROM <<described_jobs>>""",
)
def text_job_types(s: Source) -> DataFrame:
    return s.view("described_jobs").select(
        "id", F.array_join(jobtypes.text_job_types("description"), ", ").alias("job_types")
    )


@query(
    "label_job_types",
    """SELECT doc_id, CASE source WHEN 'src0' THEN 'fulltime' WHEN 'src1' THEN 'parttime' WHEN 'src2' THEN 'contract'
    WHEN 'src3' THEN 'fulltime' ELSE 'other' END AS job_type FROM <<documents>>""",
)
def label_job_types(s: Source) -> DataFrame:
    label = (
        F.when(F.col("source") == "src0", "Full-Time")
        .when(F.col("source") == "src1", "Teil Zeit")
        .when(F.col("source") == "src2", "contractor")
        .when(F.col("source") == "src3", "Voll-zeit")
        .otherwise("unknown kind")
    )
    return s.table("documents").select(
        "doc_id", F.array_join(jobtypes.job_types(F.array(label), "other"), ", ").alias("job_type")
    )


@query(
    "remote_flag",
    """SELECT id, contains(lower(concat_ws(' ', title, description, location)), 'remote')
    OR contains(lower(concat_ws(' ', title, description, location)), 'work from home')
    OR contains(lower(concat_ws(' ', title, description, location)), 'wfh') AS is_remote FROM <<described_jobs>>""",
)
def remote_flag(s: Source) -> DataFrame:
    return s.view("described_jobs").select(
        "id", text.remote_flag("title", "description", "location").alias("is_remote")
    )


@query(
    "refetch_quality",
    """SELECT doc_id, length(trim(text, ' ' || chr(10))) > 0
    AND length(replace(text, 'e', '')) < 0.9 * length(trim(text, ' ' || chr(10))) AS shorter
    FROM <<documents>>""",
)
def refetch_quality(s: Source) -> DataFrame:
    fetched = F.replace("text", F.lit("e"), F.lit(""))
    return s.table("documents").select("doc_id", text.shorter_refetch(fetched, "text").alias("shorter"))


@query(
    "truthy",
    """SELECT id, coalesce(lower(is_remote) IN ('true', '1', 'yes'), false) AS is_remote FROM <<described_jobs>>""",
)
def truthy(s: Source) -> DataFrame:
    return s.view("described_jobs").select("id", text.truthy("is_remote").alias("is_remote"))


@query(
    "industry_text",
    """SELECT p_partkey, trim(upper(p_type[1]) || lower(p_type[2:]) || ' ' || upper(p_brand[1]) || lower(p_brand[2:])) AS industry
    FROM <<part>>""",
)
def industry_text(s: Source) -> DataFrame:
    raw = F.concat(F.lit("Iv1"), F.lower("p_type"), F.lit("_"), F.upper("p_brand"))
    return s.table("part").select("p_partkey", text.industry(raw).alias("industry"))


_PLAIN = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'),
  '(?s)</?[a-zA-Z](?:[^<>"'']|"[^"]*"|''[^'']*'')*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g'))"""


@query("page_text", f"SELECT page_id, {_PLAIN} AS text FROM <<pages>>")
def page_text(s: Source) -> DataFrame:
    return s.table("pages").select("page_id", text.html_to_text("html").alias("text"))


@query(
    "blocked_pages",
    f"""SELECT page_id, CASE WHEN contains(h, 'cloudflare') OR contains(t, 'just a moment') THEN 'Cloudflare challenge'
    WHEN contains(t, 'access denied') OR contains(t, '403') THEN 'Access denied (403)'
    WHEN contains(h, 'captcha') THEN 'CAPTCHA detected'
    WHEN contains(h, 'are you a robot') OR contains(h, 'are you human') THEN 'Bot detection page' END AS block
    FROM (SELECT page_id, lower(CASE page_id % 6 WHEN 1 THEN 'Just a moment' WHEN 2 THEN '403' ELSE 'page' END) AS t,
      lower({_PLAIN}) AS h
      FROM (SELECT page_id, CASE page_id % 6 WHEN 3 THEN '<p>CAPTCHA</p>' ELSE '' END || html
        || CASE page_id % 6 WHEN 4 THEN '<p>Are you human' ELSE '' END AS html FROM <<pages>>) m) p""",
)
def blocked_pages(s: Source) -> DataFrame:
    kind = F.col("page_id") % 6
    title = F.when(kind == 1, "Just a moment").when(kind == 2, "403").otherwise("page")
    head, tail = F.when(kind == 3, "<p>CAPTCHA</p>").otherwise(""), F.when(kind == 4, "<p>Are you human").otherwise("")
    return s.table("pages").select(
        "page_id", text.blocked_page(title, F.concat(head, F.col("html"), tail)).alias("block")
    )


# --- pay --------------------------------------------------------------------------------------------

_RANGE = "\\$(\\d+(?:,\\d+)?(?:\\.\\d+)?)([kK]?)\\s*[-—–]\\s*(?:\\$)?(\\d+(?:,\\d+)?(?:\\.\\d+)?)([kK]?)"


def _salary_sql(source: str, key: str) -> str:
    def group(n: int) -> str:
        return f"regexp_extract(description, '{_RANGE}', {n})"

    def number(n: int) -> str:
        return f"CAST(trunc(TRY_CAST(replace({group(n)}, ',', '') AS DOUBLE)) AS BIGINT)"

    return f"""SELECT {key}, CASE WHEN ok THEN iv END AS "interval", CASE WHEN ok THEN CAST(lo AS DOUBLE) END AS min_amount,
      CASE WHEN ok THEN CAST(hi AS DOUBLE) END AS max_amount, CASE WHEN ok THEN 'USD' END AS currency,
      CASE WHEN ok THEN CAST(lo * f AS DOUBLE) END AS annual_min, CASE WHEN ok THEN CAST(hi * f AS DOUBLE) END AS annual_max
    FROM (SELECT *, coalesce((cap IS NULL OR hi < cap) AND lo * f BETWEEN 1000 AND 700000
        AND hi * f BETWEEN 1000 AND 700000 AND lo < hi, false) AS ok FROM (
      SELECT *, CASE WHEN lo < 350 THEN 'hourly' WHEN lo < 30000 THEN 'monthly' ELSE 'yearly' END AS iv,
        CASE WHEN lo < 350 THEN 2080 WHEN lo < 30000 THEN 12 ELSE 1 END AS f,
        CASE WHEN lo < 350 THEN 350 WHEN lo < 30000 THEN 30000 END AS cap FROM (
        SELECT {key}, {number(1)} * k AS lo, {number(3)} * k AS hi FROM (
          SELECT *, CASE WHEN contains(lower({group(2)} || {group(4)}), 'k') THEN 1000 ELSE 1 END AS k
          FROM {source}) a) b) c) d"""


@query("salary_range", _salary_sql("<<salary_texts>>", "id"))
def salary_range(s: Source) -> DataFrame:
    found = s.view("salary_texts").select(
        "id",
        pay.salary_range("description").alias("_p"),
        pay.salary_range("description", annual=True).alias("_y"),
    )
    return found.select(
        "id", "_p.*", F.col("_y.min_amount").alias("annual_min"), F.col("_y.max_amount").alias("annual_max")
    )


@query(
    "annualise",
    """SELECT id, CASE WHEN ok THEN 'yearly' ELSE interval_unit END AS "interval",
    CASE WHEN ok THEN min_amount * f ELSE min_amount END AS min_amount,
    CASE WHEN ok THEN max_amount * f ELSE max_amount END AS max_amount, 'USD' AS currency FROM (
      SELECT *, coalesce(interval_unit <> '' AND interval_unit <> 'yearly' AND min_amount <> 0 AND max_amount <> 0, false) AS ok,
      CASE interval_unit WHEN 'hourly' THEN 2080 ELSE 1 END AS f FROM <<job_details>>) j""",
)
def annualise(s: Source) -> DataFrame:
    stated = pay.compensation(
        F.col("interval_unit"), F.col("min_amount"), F.col("max_amount"), F.lit("USD")
    )
    return (
        s.view("job_details")
        .select("id", stated.alias("_p"))
        .select("id", pay.annualise(F.col("_p")).alias("_p"))
        .select("id", "_p.*")
    )


_DIGITS = "regexp_replace(amount, '[^-0-9.,]', '', 'g')"


@query(
    "currency_numbers",
    f"""SELECT id, round_even(TRY_CAST(CASE WHEN NOT contains(tail, '.') AND contains(tail, ',')
      THEN replace(head || tail, ',', '.') ELSE head || tail END AS DOUBLE), 2) AS amount FROM (
      SELECT id, right(d, 3) AS tail, regexp_replace(substr(d, 1, greatest(length(d) - 3, 0)), '[.,]', '', 'g') AS head
      FROM (SELECT id, {_DIGITS} AS d FROM <<money_texts>>) x) y""",
)
def currency_numbers(s: Source) -> DataFrame:
    return s.view("money_texts").select("id", pay.currency_number("amount").alias("amount"))


@query(
    "zip_salary",
    """SELECT id, 'yearly' AS "interval", CAST(a * 1000 AS DOUBLE) AS min_amount, CAST(b * 1000 AS DOUBLE) AS max_amount
    FROM (SELECT o_orderkey AS id, 90 + o_custkey % 60 AS a, 150 + o_custkey % 90 AS b FROM <<orders>>) o""",
)
def zip_salary(s: Source) -> DataFrame:
    shown = F.concat(
        F.lit("$"), (90 + F.col("o_custkey") % 60).cast("string"), F.lit("K - $"),
        (150 + F.col("o_custkey") % 90).cast("string"), F.lit("K/yr"),
    )
    found = s.table("orders").select(F.col("o_orderkey").alias("id"), pay.zip_salary(shown).alias("_p"))
    return found.select("id", "_p.interval", "_p.min_amount", "_p.max_amount")


@query(
    "salary_text",
    """SELECT id, CASE WHEN lo <> '' AND hi <> '' THEN c || lo || '–' || hi WHEN lo <> '' THEN c || lo || '+' ELSE '' END AS salary
    FROM (SELECT id, currency AS c, CASE WHEN coalesce(min_amount, 0) = 0 THEN '' ELSE CAST(CAST(min_amount AS BIGINT) AS VARCHAR) END AS lo,
      CASE WHEN coalesce(max_amount, 0) = 0 THEN '' ELSE CAST(CAST(max_amount AS BIGINT) AS VARCHAR) || '.5' END AS hi
      FROM <<described_jobs>>) j""",
)
def salary_text(s: Source) -> DataFrame:
    high = F.when(F.col("max_amount") == 0, 0.0).otherwise(F.col("max_amount") + 0.5)
    return s.view("described_jobs").select(
        "id", pay.salary_text("min_amount", high, "currency").alias("salary")
    )


_FOUND = _salary_sql("<<described_jobs>>", "id")


@query(
    "chosen_pay",
    f"""SELECT j.id, CASE WHEN j.min_amount IS NOT NULL THEN j.interval_unit ELSE f."interval" END AS "interval",
    coalesce(j.min_amount, f.min_amount) AS min_amount,
    CASE WHEN j.min_amount IS NOT NULL THEN j.max_amount ELSE f.max_amount END AS max_amount,
    CASE WHEN j.min_amount IS NOT NULL THEN 'EUR' ELSE f.currency END AS currency,
    CASE WHEN coalesce(j.min_amount, f.min_amount) <> 0 THEN
      CASE WHEN j.min_amount IS NOT NULL THEN 'direct_data' ELSE 'description' END END AS salary_source
    FROM <<described_jobs>> j JOIN ({_FOUND}) f ON j.id = f.id""",
)
def chosen_pay(s: Source) -> DataFrame:
    direct = F.when(
        F.col("min_amount").isNotNull(),
        pay.compensation(
            F.col("interval_unit"), F.col("min_amount"), F.col("max_amount"), F.lit("EUR")
        ),
    )
    return (
        s.view("described_jobs")
        .select("id", pay.chosen_pay(direct, F.col("description"), F.lit("USA")).alias("_p"))
        .select("id", "_p.*")
    )


# --- places -------------------------------------------------------------------------------------------


@query(
    "locations",
    """SELECT id, CASE WHEN n >= 2 THEN p1 END AS city, CASE WHEN n >= 2 THEN p2 END AS state,
    CASE WHEN n >= 3 AND lower(p3) = 'canada' THEN 'CANADA' WHEN n >= 3 AND lower(p3) = 'uk' THEN 'UK' ELSE 'USA' END AS country,
    concat_ws(', ', CASE WHEN n >= 2 THEN p1 END, CASE WHEN n >= 2 THEN p2 END,
      CASE WHEN n >= 3 AND lower(p3) = 'canada' THEN 'Canada' WHEN n >= 3 AND lower(p3) = 'uk' THEN 'UK' ELSE 'USA' END) AS shown
    FROM (SELECT id, len(string_split(place, ',')) AS n, trim(split_part(place, ',', 1)) AS p1,
      trim(split_part(place, ',', 2)) AS p2, trim(split_part(place, ',', 3)) AS p3 FROM <<place_texts>>) p""",
)
def locations(s: Source) -> DataFrame:
    found = s.view("place_texts").select("id", places.oraclecloud_location("place").alias("_l"))
    return found.select(
        "id", "_l.city", "_l.state", "_l.country", places.display_location(F.col("_l")).alias("shown")
    )


@query(
    "country_codes",
    """SELECT id, CASE lower(trim(split_part(place, ',', -1))) WHEN 'united states' THEN 'USA' WHEN 'canada' THEN 'CANADA'
    WHEN 'uk' THEN 'UK' END AS country FROM (SELECT id, replace(place, 'VA, United States', 'United States') AS place FROM <<place_texts>>) p
    """,
)
def country_codes(s: Source) -> DataFrame:
    place = F.replace("place", F.lit("VA, United States"), F.lit("United States"))
    last = F.substring_index(place, ",", -1)
    known = F.when(~F.trim(last).isin("VA", "Paris"), F.trim(last))
    return s.view("place_texts").select("id", places.country_code(known).alias("country"))


@query(
    "country_dimension",
    """SELECT c.id, CASE c.k WHEN 'us' THEN 'USA' WHEN 'turkey' THEN 'TURKEY' WHEN 'czechia' THEN 'CZECHREPUBLIC' WHEN 'de' THEN 'GERMANY' END AS country
    FROM (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'us' WHEN 1 THEN 'turkey' WHEN 2 THEN 'czechia' WHEN 3 THEN 'de' ELSE 'nowhere' END AS k FROM <<customer>>) c""",
)
def country_dimension(s: Source) -> DataFrame:
    keyed = s.sql(
        """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'us' WHEN 1 THEN 'turkey'
        WHEN 2 THEN 'czechia' WHEN 3 THEN 'de' ELSE 'nowhere' END AS country_text FROM <<customer>>"""
    )
    dim = dims.countries(s.spark).where(F.col("country_key") != "www")
    return dims.with_dimension(keyed, dim, "country_text", "country_key").select("id", "country")


_LABELS = " ".join(f"WHEN '{c}' THEN '{label}'" for c, label in fv.APPLICATION_STATUSES)
_ENDS = ", ".join(f"'{c}'" for c in fv.TERMINAL_STATUSES)


@query(
    "status_labels",
    f"""SELECT id, CASE status {_LABELS} END AS label, status IN ({_ENDS}) AS is_terminal
    FROM <<applied_job_status_history>>""",
)
def status_labels(s: Source) -> DataFrame:
    labelled = dims.with_dimension(
        s.view("applied_job_status_history").withColumnRenamed("status", "code"),
        dims.statuses(s.spark), "code", "status",
    )
    return labelled.select("id", "label", "is_terminal")


# --- dates -----------------------------------------------------------------------------------------------


@query(
    "date_rules",
    """SELECT event_id, CAST(ts AS DATE) AS from_ms, CAST(ts AS DATE) AS from_s, CAST(ts AS DATE) AS from_iso,
    CASE WHEN event_type = 'view' THEN NULL ELSE CAST(ts AS DATE) END AS from_token,
    DATE '2024-02-01' - CAST(user_id % 40 AS INTEGER) AS from_age FROM <<events>>""",
)
def date_rules(s: Source) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    token = F.when(F.col("event_type") == "view", "soon").otherwise(
        F.date_format("ts", " yyyy-MM-dd HH:mm")
    )
    return s.table("events").select(
        "event_id",
        dates.epoch_ms_date(ms).alias("from_ms"),
        dates.epoch_s_date(F.floor(ms / 1000)).alias("from_s"),
        dates.iso_date(F.concat(iso, F.lit("+02:00"))).alias("from_iso"),
        dates.first_token_date(token).alias("from_token"),
        dates.aged_date(F.col("user_id") % 40, "2024-02-01").alias("from_age"),
    )


# --- urls ----------------------------------------------------------------------------------------------


@query(
    "job_sources",
    """SELECT id, CASE id % 8 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'Indeed' WHEN 2 THEN 'Dice' WHEN 3 THEN 'OracleCloud-NFCU'
      WHEN 4 THEN 'Workday-acme' || CAST(o_custkey % 9 AS VARCHAR) ELSE '' END AS job_source,
    CASE id % 8 WHEN 1 THEN 'k' || CAST(o_custkey AS VARCHAR) WHEN 4 THEN 'R' || CAST(id AS VARCHAR)
      WHEN 5 THEN left(sha256(url), 10) WHEN 6 THEN left(sha256(url), 10) WHEN 7 THEN left(sha256(url), 10)
      ELSE CAST(id AS VARCHAR) END AS job_id,
    CASE id % 8 WHEN 0 THEN 'https://www.linkedin.com/jobs/view/' || CAST(id AS VARCHAR)
      WHEN 1 THEN 'https://www.indeed.com/?vjk=k' || CAST(o_custkey AS VARCHAR)
      WHEN 2 THEN 'https://www.dice.com/job-detail/' || CAST(id AS VARCHAR)
      WHEN 3 THEN 'https://fa-etbx-saasfaprod1.fa.ocs.oraclecloud.com/hcmUI/CandidateExperience/en/sites/nfcu/job/' || CAST(id AS VARCHAR)
      WHEN 4 THEN '/en/x/job/Eng_R' || CAST(id AS VARCHAR) || '-1' ELSE '' END AS job_url
    FROM <<posting_urls>> u JOIN <<orders>> o ON u.id = o.o_orderkey""",
)
def job_sources(s: Source) -> DataFrame:
    return (
        s.view("posting_urls").select("id", urls.job_source("url").alias("_s")).select("id", "_s.*")
    )


@query(
    "url_facts",
    """SELECT page_id, regexp_replace(url, '\\?[^#]*', '') AS without_query,
    nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), '') AS page_no,
    regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1) AS base_url,
    CASE WHEN contains(url, 'workday') THEN 'workday' ELSE 'generic' END AS route,
    regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1) || '/wday/cxs/'
      || split_part(regexp_extract(url, '://([^/?#]*)', 1), '.', 1) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS workday_api FROM <<pages>>""",
)
def url_facts(s: Source) -> DataFrame:
    return s.table("pages").select(
        "page_id",
        urls.drop_query("url").alias("without_query"),
        urls.first_param("url", "page").alias("page_no"),
        urls.base_url(F.col("url")).alias("base_url"),
        urls.download_route("url").alias("route"),
        urls.workday_api_url("url").alias("workday_api"),
    )


@query(
    "oraclecloud_parts",
    """SELECT id, CASE WHEN id % 8 = 3 THEN 'https://fa-etbx.fa.ocs.oraclecloud.com' END AS base_url,
    CASE WHEN id % 8 = 3 THEN 'nfcu' END AS site_number, CASE WHEN id % 8 = 3 THEN CAST(id AS VARCHAR) END AS job_id,
    CASE WHEN id % 8 = 1 THEN regexp_extract(url, 'vjk=([^&]*)', 1) END AS indeed_key FROM <<posting_urls>>""",
)
def oraclecloud_parts(s: Source) -> DataFrame:
    return (
        s.view("posting_urls")
        .select(
            "id",
            urls.oraclecloud_parts("url").alias("_o"),
            urls.indeed_job_key("url").alias("indeed_key"),
        )
        .select("id", "_o.*", "indeed_key")
    )


@query(
    "site_configs",
    """SELECT id, config_type, 'acmeco' AS config_key, base_url, '{"company_name":"Acme & Co"' || CASE config_type
      WHEN 'eightfold' THEN ',"base_url":"' || base_url || '","pid":"' || CAST(id AS VARCHAR)
        || '","location":"Reston, VA","sort_by":"new","filter_x":"' || regexp_extract(url, 'filter_x=(\\d+)', 1) || '"}'
      WHEN 'workday' THEN ',"tenant_site":"acme/x","base_url":"' || base_url || '"}'
      WHEN 'oraclecloud' THEN ',"siteNumber":"CX_' || CAST(id AS VARCHAR) || '","facetsList":"LOCATIONS;WORK","sortBy":"RELEVANCY","base_url":"' || base_url || '"}'
      ELSE ',"base_url":"' || base_url || '","l":"Reston"}' END AS config_json
    FROM (SELECT id, url, CASE id % 8 WHEN 3 THEN 'oraclecloud' WHEN 4 THEN 'workday' WHEN 5 THEN 'usajobs' ELSE 'eightfold' END AS config_type,
      CASE id % 8 WHEN 5 THEN 'https://www.usajobs.gov' ELSE regexp_extract(url, '^(https://[^/]+)', 1) END AS base_url
      FROM <<posting_urls>> WHERE id % 8 IN (3, 4, 5, 6)) u""",
)
def site_configs(s: Source) -> DataFrame:
    """All four kinds of boards; the tenant and the finder come with the traffic, so they are columns."""
    kind = F.col("id") % 8
    given = s.view("posting_urls").select(
        "id",
        F.when(kind == 5, "https://www.usajobs.gov/search/results/?k=engineer&l=Reston").otherwise(F.col("url")).alias("url"),
        F.lit("Acme & Co").alias("company_name"),
        F.when(kind == 4, "acme/x").alias("tenant_site"),
        F.when(kind == 3, F.concat(F.lit("findReqs;siteNumber=CX_"), F.col("id").cast("string"), F.lit(",facetsList=LOCATIONS%3BWORK"))).alias("finder"),
    )
    return co.from_urls(given).select("id", "config_type", "config_key", "base_url", "config_json")


@query(
    "search_urls",
    """SELECT config_key, owning_user, CASE config_type WHEN 'workday' THEN b || '/jobs'
    WHEN 'oraclecloud' THEN b || '/hcmUI/CandidateExperience/en/sites//job-search'
    WHEN 'eightfold' THEN b || '/careers?pid=' || substr(config_key, 4)
    ELSE b || '/search/results/?pid=' || substr(config_key, 4) END AS search_url FROM (
      SELECT *, 'https://h' || CAST(CAST(substr(config_key, 4) AS BIGINT) % 40 AS VARCHAR) || '.example.com' AS b
      FROM <<scraper_configs>>) c""",
)
def search_urls(s: Source) -> DataFrame:
    return co.search_urls(s.view("scraper_configs")).select("config_key", "owning_user", "search_url")


@query(
    "finder_params",
    """SELECT o_orderkey AS id, 'CX_' || CAST(o_custkey AS VARCHAR) AS site_number, 'LOCATIONS;WORK' AS facets,
    '25' AS radius FROM <<orders>>""",
)
def finder_params(s: Source) -> DataFrame:
    raw = F.concat(
        F.lit("findReqs;siteNumber=CX_"), F.col("o_custkey").cast("string"),
        F.lit(",facetsList=LOCATIONS%3BWORK,radius=10, radius = 25"),
    )
    return (
        s.table("orders")
        .select(F.col("o_orderkey").alias("id"), urls.finder_params(raw).alias("_m"))
        .select(
            "id", F.col("_m")["siteNumber"].alias("site_number"), F.col("_m")["facetsList"].alias("facets"),
            F.col("_m")["radius"].alias("radius"),
        )
    )


@query(
    "location_ids",
    """SELECT o_orderkey AS id, array_to_string(list_filter([CAST(a AS VARCHAR),
      CASE WHEN b <> a THEN CAST(b AS VARCHAR) END, CASE WHEN c <> a AND c <> b THEN CAST(c AS VARCHAR) END], lambda x: x IS NOT NULL), ',') AS ids
    FROM (SELECT o_orderkey, o_custkey % 7 AS a, o_custkey % 5 AS b, o_custkey % 3 AS c FROM <<orders>>) o""",
)
def location_ids(s: Source) -> DataFrame:
    def part(n: int) -> F.Column:
        return (F.col("o_custkey") % n).cast("string")

    url = F.concat(
        F.lit("https://x.example.com/jobs?locationId="), part(7), F.lit("&selectedLocationsFacet="),
        part(5), F.lit("%3B"), part(3),
    )
    return s.table("orders").select(
        F.col("o_orderkey").alias("id"), F.array_join(urls.location_ids(url), ",").alias("ids")
    )


@query(
    "config_conflicts",
    """SELECT owning_user, config_type, base_url, count(*) AS configs FROM (
      SELECT owning_user, config_type, CASE WHEN config_type = 'usajobs' THEN '' ELSE rtrim(config_json->>'$.base_url', '/') END AS base_url
      FROM <<scraper_configs>>) c GROUP BY ALL HAVING count(*) > 1""",
)
def config_conflicts(s: Source) -> DataFrame:
    return co.conflicts(s.view("scraper_configs"))


@query(
    "config_forms",
    """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 4 THEN CASE WHEN s_nationkey % 2 = 0 THEN '{"kept":1}' ELSE '{}' END ELSE
      '{"company_name":"' || s_name || '","base_url":"https://a.example.com"' || CASE s_suppkey % 5
        WHEN 0 THEN ',"siteNumber":"CX_' || CAST(s_nationkey AS VARCHAR) || '","radius":' || CAST(s_nationkey AS VARCHAR) || ',"sortBy":"RELEVANCY"'
        WHEN 1 THEN ',"tenant_site":"CX_' || CAST(s_nationkey AS VARCHAR) || '"' || CASE WHEN s_nationkey % 3 = 0 THEN ',"search_params":{"q":["x"]}' ELSE '' END
        WHEN 2 THEN ',"domain":"CX_' || CAST(s_nationkey AS VARCHAR) || '"' || CASE WHEN s_nationkey % 3 = 0 THEN ',"q":["x"]' ELSE '' END
        ELSE ',"l":["Reston, VA","Paris"]' || CASE WHEN s_nationkey % 3 = 0 THEN ',"q":["x"]' ELSE '' END END || '}' END AS config_json FROM <<supplier>>""",
)
def config_forms(s: Source) -> DataFrame:
    """All five kinds of form, with blank fields and JSON that is none."""
    nation, kind = F.col("s_nationkey").cast("string"), F.col("s_suppkey") % 5
    more = F.when(F.col("s_nationkey") % 3 == 0, '{"q":["x"]}').when(F.col("s_nationkey") % 3 == 1, "{bad").otherwise("  ")
    kinds = F.array(*[F.lit(k) for k in ("oraclecloud", "workday", "eightfold", "usajobs", "google")])
    forms = s.table("supplier").select(
        "s_suppkey",
        F.get(kinds, kind.cast("int")).alias("config_type"),
        F.concat(F.lit("CX_"), nation).alias("tenant_site"),
        more.alias("search_params"),
        F.concat(F.lit("CX_"), nation).alias("domain"),
        F.lit("").alias("location"),
        more.alias("extra_params"),
        F.lit(" Reston, VA\n\n  Paris \n").alias("usajobs_l"),
        F.when(F.col("s_nationkey") % 2 == 0, '{"kept":1}').otherwise("").alias("config_json"),
        F.col("s_name").alias("company_name"),
        F.lit("https://a.example.com").alias("base_url"),
        F.concat(F.lit("CX_"), nation).alias("siteNumber"),
        F.lit("").alias("locationId"),
        nation.alias("radius"),
        F.lit("RELEVANCY").alias("sortBy"),
    )
    return co.from_forms(forms).select("s_suppkey", "config_json")


# --- stored results --------------------------------------------------------------------------------------

_LEGACY = "CAST(job_score_json->>'$.score.final_score' AS DOUBLE)"
_CURRENT = "coalesce(job_score_json->>'$.schema_version' = '1.0', false)"


@query(
    "result_scores",
    f"""SELECT id, CASE WHEN {_CURRENT} THEN CAST(job_score_json->>'$.ats_score_estimate.total_overall_score' AS INTEGER)
      ELSE CAST(trunc(coalesce({_LEGACY}, 0) * 100) AS INTEGER) END AS job_score,
    CASE WHEN {_CURRENT} THEN CASE WHEN job_score_json->>'$.clearance_assessment.status' = 'Active Required' THEN 1 ELSE 0 END
      WHEN coalesce(CAST(job_score_json->>'$.security_clearances.missing_security_clearances_count' AS INTEGER), 0) > 0 THEN 1
      ELSE 0 END AS security_clearance_required,
    CASE WHEN {_LEGACY} IS NOT NULL THEN 0.0::DOUBLE END AS confirmed_score, coalesce({_LEGACY} <> 0, false) AS score_mismatch
    FROM <<results_json>>""",
)
def result_scores(s: Source) -> DataFrame:
    return (
        s.view("results_json")
        .select("id", results.stored_fields("job_score_json").alias("_f"))
        .select("id", "_f.*")
    )


@query(
    "corrected_results",
    """SELECT id, CASE WHEN id % 4 = 2 THEN regexp_replace(job_score_json, '"final_score":[0-9.]+', '"final_score":0.0')
    ELSE job_score_json END AS job_score_json FROM <<results_json>>""",
)
def corrected_results(s: Source) -> DataFrame:
    staged = s.view("results_json").withColumn("_f", results.stored_fields("job_score_json"))
    return staged.select(
        "id", results.corrected_json("job_score_json", F.col("_f")).alias("job_score_json")
    )


@query(
    "decision_travel",
    """SELECT id, nullif(job_score_json->>'$.decision', '') AS decision,
    'Travel: ' || (job_score_json->>'$.job_requirements.travel_percentage') AS travel FROM <<results_json>>""",
)
def decision_travel(s: Source) -> DataFrame:
    return s.view("results_json").select(
        "id",
        results.decision("job_score_json").alias("decision"),
        results.travel("job_score_json").alias("travel"),
    )


@query(
    "score_bands",
    """SELECT id, CASE WHEN job_score >= 80 THEN 'high' WHEN job_score >= 60 THEN 'middle' WHEN job_score > 0 THEN 'low' ELSE 'none' END AS band,
    CASE WHEN job_score / 10.0 >= 8 THEN 'high' WHEN job_score / 10.0 >= 5 THEN 'middle' ELSE 'low' END AS audit_band,
    CASE WHEN job_score / 100.0 < 0.5 THEN 'Fail' WHEN job_score / 100.0 < 0.7 THEN 'Conditional' ELSE 'Pass' END AS legacy_decision,
    CASE WHEN security_clearance_required = 1 THEN 'Fail' WHEN job_score >= 80 THEN 'Pass' WHEN job_score >= 60 THEN 'Conditional' ELSE 'Fail' END AS decision
    FROM <<job_details>>""",
)
def score_bands(s: Source) -> DataFrame:
    score = F.col("job_score")
    return s.view("job_details").select(
        "id",
        results.score_band(score).alias("band"),
        results.audit_band(score / 10).alias("audit_band"),
        results.legacy_decision(score / 100).alias("legacy_decision"),
        results.current_decision(score, F.col("security_clearance_required") == 1).alias("decision"),
    )


@query(
    "weighted_scores",
    """SELECT o_orderkey AS id, round_even(k * 0.6 + n * 0.2 + i * 0.1 + p * 0.1, 2) AS weighted FROM (
      SELECT o_orderkey, CAST(o_custkey % 101 AS DOUBLE) AS k, CAST(o_custkey % 91 AS DOUBLE) AS n, CAST(o_custkey % 81 AS DOUBLE) AS i, 50.0::DOUBLE AS p
      FROM <<orders>>) o""",
)
def weighted_scores(s: Source) -> DataFrame:
    def part(n: int, weight: float) -> F.Column:
        return F.struct((F.col("o_custkey") % n).alias("score"), F.lit(weight).alias("weight"))

    breakdown = F.struct(
        part(101, 0.6).alias("keyword_alignment"),
        part(91, 0.2).alias("seniority_alignment"),
        part(81, 0.1).alias("impact_metrics"),
        F.struct(F.lit(50).alias("score"), F.lit(None).cast("double").alias("weight")).alias(
            "structural_parsability"
        ),
    )
    return s.table("orders").select(
        F.col("o_orderkey").alias("id"), results.weighted_score(breakdown).alias("weighted")
    )


@query(
    "answer_json",
    """SELECT id, CASE id % 5 WHEN 0 THEN regexp_extract(answer, '(\\{.*\\})', 1) WHEN 1 THEN '[{"job_title":"a","score":"high"}]'
    WHEN 4 THEN answer END AS json FROM <<answers>>""",
)
def answer_json(s: Source) -> DataFrame:
    return s.view("answers").select("id", results.answer_json("answer").alias("json"))


@query(
    "answer_faults",
    """SELECT id, CASE WHEN id % 5 IN (2, 3) THEN 'no json' WHEN id % 5 = 0 THEN NULL ELSE 'missing decision' END AS error FROM <<answers>>""",
)
def answer_faults(s: Source) -> DataFrame:
    from postloom import schemas

    checked = results.validated("answer", schemas.SCORE_RESULT, ["decision"])
    return s.view("answers").withColumn("_c", checked).select("id", "_c.error")


@query(
    "enum_text",
    """SELECT id, CASE id % 4 WHEN 0 THEN 'Active Required' WHEN 1 THEN 'None Required' WHEN 2 THEN 'Other.ACTIVE' ELSE 'Plain' END AS status,
    CASE id % 4 WHEN 0 THEN 'Active Required' WHEN 1 THEN 'None Required' WHEN 2 THEN 'Active' ELSE 'Plain' END AS shown
    FROM <<job_details>>""",
)
def enum_text(s: Source) -> DataFrame:
    kind = F.col("id") % 4
    raw = (
        F.when(kind == 0, "ClearanceStatus.ACTIVE_REQUIRED")
        .when(kind == 1, "ClearanceStatus.none_required")
        .when(kind == 2, "Other.ACTIVE")
        .otherwise("Plain")
    )
    return s.view("job_details").select(
        "id", results.clearance_text(raw).alias("status"), results.shown_enum(raw).alias("shown")
    )


@query(
    "audit_rows",
    """SELECT profile_name, owning_user, section_no, section, category_no, category, label, score, analysis,
    CASE WHEN score >= 8 THEN 'high' WHEN score >= 5 THEN 'middle' ELSE 'low' END AS band FROM (
      SELECT profile_name, owning_user, 1 AS section_no, 'Summary Strength' AS section, 0 AS category_no, 'headline' AS category,
        'Headline' AS label, CAST(ats_score->>'$.headline.score' AS INTEGER) AS score, ats_score->>'$.headline.analysis' AS analysis
      FROM <<resume_audits>> WHERE starts_with(ats_score, '{')
      UNION ALL SELECT profile_name, owning_user, 4, 'Language & Tone', 1, 'grammar', 'Grammar',
        CAST(ats_score->>'$.grammar.score' AS INTEGER), ats_score->>'$.grammar.analysis'
      FROM <<resume_audits>> WHERE starts_with(ats_score, '{')) a""",
)
def audit_rows(s: Source) -> DataFrame:
    return sc.audit_rows(s.view("resume_audits"), dims.resume_sections(s.spark))


@query(
    "list_and_map_text",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, 0::BIGINT AS bad_list FROM <<events>>""",
)
def list_and_map_text(s: Source) -> DataFrame:
    return s.table("events").select(
        "event_id",
        F.try_element_at(results.map_text("props"), F.lit("k")).alias("k"),
        F.size(results.list_text(F.concat("event_type", F.lit("[")))).cast("bigint").alias("bad_list"),
    )


@query(
    "eligibility",
    """SELECT id, CASE id % 4 WHEN 0 THEN 'Active Required' WHEN 1 THEN 'None Required' ELSE 'Unknown' END AS clearance_status,
    CASE WHEN id % 4 IN (0, 1) THEN 'required' ELSE 'other' END AS clearance_class, 'None specified' AS clearance_types,
    'Unknown' AS citizenship_status, false AS meets_citizenship, 0 AS years,
    CASE WHEN id % 4 = 0 THEN '25%' ELSE '0%' END AS travel, '0%' AS confidence
    FROM <<results_json>> WHERE job_score_json <> '{}'""",
)
def eligibility(s: Source) -> DataFrame:
    return sc.eligibility_rows(s.view("results_json"))


@query(
    "top_terms",
    """SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:5], '|') AS top FROM <<conversations>>""",
)
def top_terms(s: Source) -> DataFrame:
    return s.table("conversations").select(
        "conv_id", "turn", F.array_join(results.top_terms(F.split("text", " ")), "|").alias("top")
    )


@query(
    "prompt_parts",
    """SELECT id, CASE id % 3 WHEN 0 THEN 'sys' || chr(10) || chr(10) || title WHEN 1 THEN 'sys' END AS system,
    CASE WHEN id % 3 = 2 THEN title ELSE company END AS "user" FROM <<job_details>>""",
)
def prompt_parts(s: Source) -> DataFrame:
    kind = F.col("id") % 3
    prompt = (
        F.when(
            kind == 0,
            F.concat(
                F.lit(f"sys\n{fv.CANDIDATE_MARKER}\n "), "title", F.lit(f"\n{fv.USER_MARKER} "), "company"
            ),
        )
        .when(kind == 1, F.concat(F.lit(f"sys{fv.USER_MARKER}"), "company", F.lit("\n")))
        .otherwise(F.col("title"))
    )
    parts = s.view("job_details").select("id", sc.prompt_parts(prompt).alias("_p"))
    return parts.select("id", "_p.system", "_p.user")


@query(
    "posting_prompts",
    """SELECT j.id, 'R:firstname lastname' || chr(10) || 'email@example.com|' || CASE WHEN d.us_citizen = 1 THEN 'Yes' ELSE 'No' END
    || '|' || j.job_url || '|' || CASE WHEN trim(j.description) = '' THEN '' ELSE j.description END AS prompt, false AS over_limit
    FROM <<described_jobs>> j JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owning_user ORDER BY profile_name) AS rn
      FROM <<job_profiles>> WHERE is_default = 1) p WHERE rn = 1) d ON j.owning_user = d.owning_user
    WHERE d.resume <> '' AND d.desired_role_description <> ''""",
)
def posting_prompts(s: Source) -> DataFrame:
    profiles = s.view("job_profiles").withColumn("security_clearance", F.lit("No"))
    ready = sc.readiness(s.view("described_jobs"), profiles).where(F.col("skip_reason").isNull())
    return sc.posting_prompt(ready, "R:{resume}|{us_citizen}|{job_url}|{job_description}").select(
        "id", "prompt", "over_limit"
    )
