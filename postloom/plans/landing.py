"""Board payloads and pages: made from the supplied rows in SQL, flattened by Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import schemas
from postloom.functions import text
from postloom.operators import postings as po
from postloom.operators.run import Run, ingest_run
from postloom.plans.registry import Source, query
from postloom.session import shared_folder
from postloom.sources import boards, exports, pages, payloads, runs

AS_OF = "2001-08-01"
_DAY_MS = 86400000
_Y2000_MS = 946684800000


def _posted(day: str) -> str:
    return f"DATE '2000-01-01' + CAST({day} AS INTEGER)"


# --- indeed: one result per order; recruiter links repeat over orders --------------------------------

_INDEED = f"""SELECT o_orderkey AS payload_id,
  '{{"data":{{"jobSearch":{{"results":[{{"job":{{"key":"k' || CAST(o_orderkey AS STRING) || '","title":"Engineer ' || CAST(o_custkey AS STRING)
  || '","description":{{"html":"<p>Work <b>' || CASE WHEN o_orderkey % 3 = 0 THEN 'Remote' ELSE 'here' END || '</b> a' || CAST(o_custkey AS STRING) || '@x.example.com</p>"}},"attributes":[{{"label":"'
  || CASE WHEN o_orderkey % 2 = 0 THEN 'Full-time' ELSE 'Part Time' END || '"}},{{"label":"odd"}}],"datePublished":' || CAST({_Y2000_MS} + {_DAY_MS} * (o_orderkey % 400) AS STRING)
  || ',"recruit":' || CASE WHEN o_orderkey % 4 = 0 THEN '{{"viewJobUrl":"https://r.example.com/' || CAST(o_custkey AS STRING) || '"}}' ELSE 'null' END
  || ',"employer":{{"name":"Co ' || CAST(o_custkey AS STRING) || '","relativeCompanyPageUrl":"/cmp/x","dossier":{{"employerDetails":{{"addresses":["a1","a2"],"industry":"Iv1_REAL_estate"}},"links":{{"corporateWebsite":"w"}},"images":{{}}}}}},'
  || '"location":{{"city":"Reston","admin1Code":"VA","countryCode":"US","formatted":{{"long":"Reston"}}}},"compensation":{{"baseSalary":'
  || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '{{"unitOfWork":"HOUR","range":{{"min":' || CAST(20 + o_custkey % 30 AS STRING) || '.5,"max":60}}}}' END
  || ',"estimated":null,"currencyCode":"USD"}}}}}}]}}}}}}' AS payload FROM <<orders>>"""

_INDEED_ROWS = f"""SELECT 'in-k' || CAST(o_orderkey AS VARCHAR) AS id, job_url, job_url_direct, 'Engineer ' || CAST(o_custkey AS VARCHAR) AS title,
  'Co ' || CAST(o_custkey AS VARCHAR) AS company, 'Reston, VA, US' AS location, {_posted('o_orderkey % 400')} AS date_posted,
  CASE WHEN o_orderkey % 2 = 0 THEN 'fulltime' ELSE 'parttime' END AS job_type,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'direct_data' END AS salary_source, CASE WHEN o_orderkey % 5 <> 0 THEN 'hourly' END AS "interval",
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(20 + o_custkey % 30 AS DOUBLE) END AS min_amount,
  o_orderkey % 3 = 0 AS is_remote, 'a' || CAST(o_custkey AS VARCHAR) || '@x.example.com' AS emails,
  'https://www.indeed.com/viewjob?jk=k' || CAST(o_orderkey AS VARCHAR) || chr(10) || chr(10) || 'Work **' ||
    CASE WHEN o_orderkey % 3 = 0 THEN 'Remote' ELSE 'here' END || '** a' || CAST(o_custkey AS VARCHAR) || '@x.example.com' AS description,
  'Real Estate' AS company_industry, 'a1' AS company_addresses, 'https://www.indeed.com/cmp/x' AS company_url FROM (
  SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY o_orderkey) AS rn FROM (
    SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'https://r.example.com/' || CAST(o_custkey AS VARCHAR) END AS job_url_direct,
      coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'https://r.example.com/' || CAST(o_custkey AS VARCHAR) END,
        'https://www.indeed.com/viewjob?jk=k' || CAST(o_orderkey AS VARCHAR)) AS job_url FROM <<orders>>) o) p WHERE rn = 1"""
_INDEED_COLUMNS = [
    "id", "job_url", "job_url_direct", "title", "company", "location", "date_posted", "job_type",
    "salary_source", "interval", "min_amount", "is_remote", "emails", "description",
    "company_industry", "company_addresses", "company_url",
]


@query("board_indeed", _INDEED_ROWS)
def board_indeed(s: Source) -> DataFrame:
    posts = payloads.indeed(s.sql(_INDEED))
    return po.flat_postings(posts, "indeed").select(*_INDEED_COLUMNS)


# --- workday: lists per customer, details per card ---------------------------------------------------

_WORKDAY_LIST = """SELECT c_custkey AS payload_id, 'https://w.example.com' AS base_url, c_name AS company_name,
  '{"jobPostings":[{"externalPath":"/job/' || CAST(c_custkey AS STRING) || '","title":"t"},{"externalPath":""},{"title":"none"}]}' AS payload
FROM <<customer>>"""
_WORKDAY_DETAIL = """SELECT 'https://w.example.com' AS base_url, '/job/' || CAST(c_custkey AS STRING) AS external_path,
  '{"jobPostingInfo":{"jobReqId":"R' || CAST(c_custkey AS STRING) || '","title":"Title ' || CAST(c_nationkey AS STRING) || '","jobDescription":"<ul><li>one</li><li>two</li></ul>","startDate":"2001-07-0'
  || CAST(1 + c_custkey % 9 AS STRING) || '","timeType":"' || CASE c_custkey % 3 WHEN 0 THEN 'Full time' WHEN 1 THEN '' ELSE 'Sometimes' END
  || '","location":"' || CASE c_custkey % 2 WHEN 0 THEN 'USA, VA, Reston' ELSE 'Paris' END || '"'
  || CASE WHEN c_custkey % 5 = 0 THEN ',"externalUrl":"https://ext.example.com/' || CAST(c_custkey AS STRING) || '"' ELSE '' END
  || CASE WHEN c_custkey % 2 = 1 THEN ',"country":{"alpha2Code":"FR"}' ELSE '' END || '}}' AS payload
FROM <<customer>>"""


@query(
    "board_workday",
    """SELECT 'R' || CAST(c_custkey AS VARCHAR) AS id, 'Title ' || CAST(c_nationkey AS VARCHAR) AS title, c_name AS company,
    CASE WHEN c_custkey % 5 = 0 THEN 'https://ext.example.com/' || CAST(c_custkey AS VARCHAR) ELSE 'https://w.example.com/job/' || CAST(c_custkey AS VARCHAR) END AS job_url,
    CASE WHEN c_custkey % 2 = 0 THEN 'Reston, VA, USA' ELSE 'Paris, France' END AS location,
    CASE WHEN c_custkey % 3 = 0 THEN 'fulltime' ELSE 'other' END AS job_type, DATE '2001-07-01' + CAST(c_custkey % 9 AS INTEGER) AS date_posted,
    '* one' || chr(10) || '* two' AS description FROM <<customer>>""",
)
def board_workday(s: Source) -> DataFrame:
    posts = payloads.workday(s.sql(_WORKDAY_LIST), s.sql(_WORKDAY_DETAIL))
    return po.flat_postings(posts, "workday").select(
        "id", "title", "company", "job_url", "location", "job_type", "date_posted", "description"
    )


# --- oraclecloud ----------------------------------------------------------------------------------------

# two tenants share their requisition ids; every detail is landed twice, and only the first counts
_ORACLE_LIST = """SELECT 2 * c_custkey + t AS payload_id, 'https://o' || CAST(t AS STRING) || '.example.com' AS base_url, 'CX' AS site_number, c_name AS company_name,
  '{"items":[{"TotalJobsCount":2,"requisitionList":[{"Id":"' || CAST(c_custkey AS STRING) || '","Title":"T","ShortDescriptionStr":"short","PrimaryLocation":"Vienna, VA, United States","PostedDate":"2001-07-01"},'
  || '{"Id":"x' || CAST(c_custkey AS STRING) || '","ShortDescriptionStr":"only short","PrimaryLocation":"","PostedDate":"soon"}]}]}' AS payload FROM <<customer>> LATERAL VIEW explode(array(0, 1)) x AS t"""
_ORACLE_DETAIL = """SELECT 4 * c_custkey + 2 * t + again AS payload_id, CAST(c_custkey AS STRING) AS job_id, 'https://o' || CAST(t AS STRING) || '.example.com' AS base_url, 'CX' AS site_number,
  '{"items":[{"ExternalDescriptionStr":"<p>' || CASE WHEN again = 0 THEN 'A' || CAST(t AS STRING) ELSE 'later' END || '</p>","ExternalQualificationsStr":"<p>Q' || CAST(c_nationkey AS STRING) || '</p>","CorporateDescriptionStr":""}]}' AS payload
  FROM <<customer>> LATERAL VIEW explode(array(0, 1)) x AS t LATERAL VIEW explode(array(0, 1)) y AS again"""


@query(
    "board_oraclecloud",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, 'T' AS title, c_name AS company, 'Vienna, VA, USA' AS location, DATE '2001-07-01' AS date_posted,
    'https://o' || t || '.example.com/hcmUI/CandidateExperience/en/sites/CX/job/' || CAST(c_custkey AS VARCHAR) AS job_url,
    'A' || t || chr(10) || chr(10) || 'Q' || CAST(c_nationkey AS VARCHAR) || chr(10) || chr(10) || 'short' AS description FROM <<customer>>, (VALUES ('0'), ('1')) x(t)
    UNION ALL SELECT 'x' || CAST(c_custkey AS VARCHAR), '', c_name, 'USA', NULL,
    'https://o' || t || '.example.com/hcmUI/CandidateExperience/en/sites/CX/job/x' || CAST(c_custkey AS VARCHAR), 'only short' FROM <<customer>>, (VALUES ('0'), ('1')) x(t)""",
)
def board_oraclecloud(s: Source) -> DataFrame:
    posts = payloads.oraclecloud(s.sql(_ORACLE_LIST), s.sql(_ORACLE_DETAIL))
    return po.flat_postings(posts, "oraclecloud").select(
        "id", "title", "company", "location", "date_posted", "job_url", "description"
    )


# --- eightfold ---------------------------------------------------------------------------------------------

_EIGHT_LIST = """SELECT 2 * c_custkey + t AS payload_id, 'https://e' || CAST(t AS STRING) || '.example.com' AS base_url, c_name AS company_name,
  '{"data":{"positions":[{"id":' || CAST(c_custkey AS STRING) || '},{"id":-1}]}}' AS payload FROM <<customer>> LATERAL VIEW explode(array(0, 1)) x AS t"""
_EIGHT_DETAIL = f"""SELECT CAST(c_custkey AS STRING) AS job_id, 'https://e' || CAST(t AS STRING) || '.example.com' AS base_url, 4 * c_custkey + 2 * t + again AS payload_id, '{{"data":{{"jobDescription":"<h2>Role</h2>' || CASE WHEN again = 0 THEN 'text' || CAST(t AS STRING) ELSE 'later' END || '","postedTs":'
  || CAST({_Y2000_MS // 1000} + 86400 * (c_custkey % 300) AS STRING) || ',"positionUrl":"/p/' || CAST(c_custkey AS STRING) || '","name":"N' || CAST(c_nationkey AS STRING)
  || '","efcustomTextEmploymentType":' || CASE c_custkey % 3 WHEN 0 THEN '["Full-Time","Contract"]' WHEN 1 THEN '["Never"]' ELSE '[]' END || '}}}}' AS payload
  FROM <<customer>> LATERAL VIEW explode(array(0, 1)) x AS t LATERAL VIEW explode(array(0, 1)) y AS again"""


@query(
    "board_eightfold",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS id, 'N' || CAST(c_nationkey AS VARCHAR) AS title, c_name AS company,
    'https://e' || t || '.example.com/p/' || CAST(c_custkey AS VARCHAR) AS job_url, {_posted('c_custkey % 300')} AS date_posted,
    CASE WHEN c_custkey % 3 = 0 THEN 'fulltime, contract' ELSE 'other' END AS job_type,
    '## Role' || chr(10) || chr(10) || 'text' || t AS description FROM <<customer>>, (VALUES ('0'), ('1')) x(t)""",
)
def board_eightfold(s: Source) -> DataFrame:
    posts = payloads.eightfold(s.sql(_EIGHT_LIST), s.sql(_EIGHT_DETAIL))
    return po.flat_postings(posts, "eightfold").select(
        "id", "title", "company", "job_url", "date_posted", "job_type", "description"
    )


# --- usajobs -----------------------------------------------------------------------------------------------

_USAJOBS = """SELECT s_suppkey AS payload_id, '{"SearchResult":{"SearchResultItems":[{"MatchedObjectId":"' || CAST(s_suppkey AS STRING)
  || '","MatchedObjectDescriptor":{"PositionTitle":"T' || CAST(s_nationkey AS STRING) || '","OrganizationName":"Org","PositionURI":"https://u.example.com/' || CAST(s_suppkey AS STRING)
  || '","PositionLocationDisplay":"Washington, District of Columbia; Reston, Virginia","PublicationStartDate":"2001-07-0' || CAST(1 + s_suppkey % 9 AS STRING) || 'T00:00:00.9970","PositionRemuneration":[{"MinimumRange":"'
  || CAST(50000 + s_suppkey AS STRING) || '","MaximumRange":"90000","RateIntervalCode":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'PA' ELSE 'PH' END
  || '"}],"UserArea":{"Details":{"SecurityClearance":"' || CASE WHEN s_suppkey % 3 = 0 THEN 'Not Required' ELSE 'Secret' END || '","MajorDuties":["one","two"]}}}}]}}' AS payload FROM <<supplier>>"""


@query(
    "board_usajobs",
    """SELECT CAST(s_suppkey AS VARCHAR) AS id, 'T' || CAST(s_nationkey AS VARCHAR) AS title, 'https://u.example.com/' || CAST(s_suppkey AS VARCHAR) AS job_url,
    'Washington' AS city, 'District of Columbia' AS state, DATE '2001-07-01' + CAST(s_suppkey % 9 AS INTEGER) AS date_posted,
    CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS security_clearance, CASE WHEN s_suppkey % 2 = 0 THEN CAST(50000 + s_suppkey AS DOUBLE) END AS min_amount,
    CASE WHEN s_suppkey % 2 = 0 THEN 'yearly' END AS "interval",
    CASE WHEN s_suppkey % 5 = 0 THEN 'page text' ELSE 'one' || chr(10) || 'two' END AS description FROM <<supplier>>""",
)
def board_usajobs(s: Source) -> DataFrame:
    texts = s.sql(
        """SELECT 'https://u.example.com/' || CAST(s_suppkey AS STRING) AS job_url,
        CASE WHEN s_suppkey % 5 = 0 THEN 'page text' ELSE '' END AS description FROM <<supplier>>"""
    )
    return payloads.usajobs(s.sql(_USAJOBS), texts).select(
        "id", "title", "job_url", "location.city", "location.state", "date_posted",
        "security_clearance", "compensation.min_amount", "compensation.interval", "description",
    )


# --- google: two nesting shapes ---------------------------------------------------------------------------

_JOB = """'["g' || CAST(o_custkey AS STRING) || '","T' || CAST(o_orderkey AS STRING) || '",null,[null,"<p>resp</p>"],[null,"qual"],0,0,"Google Co",0,[["' ||
  CASE WHEN o_custkey % 2 = 0 THEN 'Remote, CA, USA' ELSE 'Reston, VA, USA' END || '"]],[null,""],0,0,[' || CAST(946684800 + 86400 * (o_orderkey % 300) AS STRING) || ']]'"""
_GOOGLE = f"""SELECT o_orderkey AS payload_id, 'AF_initDataCallback({{key: ds:1, data:' || CASE WHEN o_orderkey % 2 = 0 THEN '[[' || {_JOB} || '],null,3]' ELSE '[' || {_JOB} || ']' END
  || ', sideChannel: {{}}}});' AS payload FROM <<orders>>"""


@query(
    "board_google",
    f"""SELECT 'g' || CAST(o_custkey AS VARCHAR) AS id, 'T' || CAST(o_orderkey AS VARCHAR) AS title, 'Google Co' AS company_name,
    o_custkey % 2 = 0 AS is_remote, {_posted('o_orderkey % 300')} AS date_posted,
    'https://www.google.com/about/careers/applications/jobs/results/g' || CAST(o_custkey AS VARCHAR) AS job_url,
    CASE WHEN o_custkey % 2 = 0 THEN 'Remote, CA, USA' ELSE 'Reston, VA, USA' END AS location,
    '### Responsibilities' || chr(10) || chr(10) || 'resp' || chr(10) || chr(10) || '### Qualifications' || chr(10) || chr(10) || 'qual' AS description
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM <<orders>>) o WHERE rn = 1""",
)
def board_google(s: Source) -> DataFrame:
    from postloom.functions.places import display_location

    posts = payloads.google(s.sql(_GOOGLE), AS_OF)
    return posts.select(
        "id", "title", "company_name", "is_remote", "date_posted", "job_url",
        display_location(F.col("location")).alias("location"),
        F.regexp_replace("description", " +\n", "\n").alias("description"),
    )


# --- glassdoor ----------------------------------------------------------------------------------------------

_GLASS = """SELECT o_orderkey AS payload_id, '{"data":{"jobListings":{"jobListings":[{"jobview":{"job":{"listingId":' || CAST(o_custkey AS STRING) || ',"jobTitleText":"T' || CAST(o_orderkey AS STRING)
  || '"},"header":{"employerNameFromSearch":"Co","employer":{"id":' || CAST(o_custkey % 3 AS STRING) || '},"locationName":"' || CASE WHEN o_custkey % 4 = 0 THEN 'Remote' ELSE 'Reston, VA' END
  || '","locationType":"' || CASE WHEN o_custkey % 2 = 0 THEN 'S' ELSE 'C' END || '","ageInDays":' || CASE WHEN o_custkey % 7 = 0 THEN 'null' ELSE CAST(o_custkey % 30 AS STRING) END
  || ',"payPeriod":"ANNUAL","payPeriodAdjustedPay":{"p10":' || CAST(50000 + o_custkey AS STRING) || '.7,"p90":99999.9},"adOrderSponsorshipLevel":"SPONSORED"}}}]}}}' AS payload FROM <<orders>>"""


@query(
    "board_glassdoor",
    f"""SELECT 'gd-' || CAST(o_custkey AS VARCHAR) AS id, 'T' || CAST(o_orderkey AS VARCHAR) AS title, o_custkey % 2 = 0 AS is_remote,
    CASE WHEN o_custkey % 7 <> 0 THEN DATE '{AS_OF}' - CAST(o_custkey % 30 AS INTEGER) END AS date_posted,
    CASE WHEN o_custkey % 2 = 1 THEN 'Reston' END AS city, CASE WHEN o_custkey % 3 <> 0 THEN 'https://www.glassdoor.com/Overview/W-EI_IE' || CAST(o_custkey % 3 AS VARCHAR) || '.htm' END AS company_url,
    CAST(50000 + o_custkey AS DOUBLE) AS min_amount, 99999.0::DOUBLE AS max_amount, 'yearly' AS "interval", 'sponsored' AS listing_type
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM <<orders>>) o WHERE rn = 1""",
)
def board_glassdoor(s: Source) -> DataFrame:
    return payloads.glassdoor(s.sql(_GLASS), AS_OF).select(
        "id", "title", "is_remote", "date_posted", "location.city", "company_url",
        "compensation.min_amount", "compensation.max_amount", "compensation.interval", "listing_type",
    )


# --- pages: linkedin, zip_recruiter, marriott ------------------------------------------------------------------

_LI_CARDS = """SELECT o_orderkey AS payload_id, '<ul><li><div class="base-card base-search-card"><a class="base-card__full-link" href="https://www.linkedin.com/jobs/view/eng-at-co-' || CAST(o_custkey AS STRING)
  || '?position=1"> x </a><div><span class="sr-only"> Engineer ' || CAST(o_orderkey AS STRING) || ' </span><h4 class="base-search-card__subtitle"><a href="https://www.linkedin.com/company/a?trk=1">Co &amp; Sons</a></h4>'
  || '<div class="base-search-card__metadata"><span class="job-search-card__location">' || CASE WHEN o_custkey % 2 = 0 THEN 'Reston, VA' ELSE 'Toronto, ON, Canada' END
  || '</span><time class="job-search-card__listdate" datetime="2001-07-0' || CAST(1 + o_orderkey % 9 AS STRING) || '">now</time></div>'
  || CASE WHEN o_custkey % 3 = 0 THEN '<span class="job-search-card__salary-info">$90,000.00 - $120,000.00</span>' ELSE '' END || '</div></div></li></ul>' AS html FROM <<orders>>"""
_LI_DETAIL = """SELECT CAST(c_custkey AS STRING) AS job_id, '<div class="x show-more-less-html__markup"><div><p>Text ' || c_name || ' ' || CASE WHEN c_custkey % 5 = 0 THEN 'WFH' ELSE '' END
  || '</p></div></div><ul><li><h3 class="description__job-criteria-subheader">Seniority level</h3><span class="description__job-criteria-text description__job-criteria-text--criteria"> Mid-Senior </span></li>'
  || '<li><h3 class="description__job-criteria-subheader"> Employment type </h3><span class="description__job-criteria-text description__job-criteria-text--criteria">Full-time</span></li></ul>'
  || '<code id="applyUrl"><!--"https://www.linkedin.com/out?url=https%3A%2F%2Fa.example.com%2F' || CAST(c_custkey AS STRING) || '"--></code>' AS html FROM <<customer>>"""


@query(
    "board_linkedin",
    """SELECT 'li-' || CAST(o_custkey AS VARCHAR) AS id, 'Engineer ' || CAST(o_orderkey AS VARCHAR) AS title, 'Co & Sons' AS company,
    'https://www.linkedin.com/jobs/view/' || CAST(o_custkey AS VARCHAR) AS job_url, 'https://www.linkedin.com/company/a' AS company_url,
    CASE WHEN o_custkey % 2 = 0 THEN 'Reston, VA' ELSE 'Toronto, ON, Canada' END AS location, DATE '2001-07-01' + CAST(o_orderkey % 9 AS INTEGER) AS date_posted,
    CASE WHEN o_custkey % 3 = 0 THEN 90000.0::DOUBLE END AS min_amount, CASE WHEN o_custkey % 3 = 0 THEN 'direct_data' END AS salary_source,
    trim('Text ' || c_name || ' ' || CASE WHEN o_custkey % 5 = 0 THEN 'WFH' ELSE '' END) AS description, o_custkey % 5 = 0 AS is_remote,
    'mid-senior' AS job_level, 'fulltime' AS job_type, 'https://a.example.com/' || CAST(o_custkey AS VARCHAR) AS job_url_direct
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM <<orders>>) o JOIN <<customer>> c ON o.o_custkey = c.c_custkey WHERE rn = 1""",
)
def board_linkedin(s: Source) -> DataFrame:
    posts = pages.linkedin(s.sql(_LI_CARDS), s.sql(_LI_DETAIL))
    return po.flat_postings(posts, "linkedin").select(
        "id", "title", "company", "job_url", "company_url", "location", "date_posted", "min_amount",
        "salary_source", "description", "is_remote", "job_level", "job_type", "job_url_direct",
    )


# a card is shown twice on its page; pages of the second kind have a card without an id as well
_ZIP_CARDS = """SELECT o_orderkey AS payload_id, '<main>' || repeat(card, 2) || '<article data-job-id=""><h2><a href="/c/none">No id</a></h2></article></main>' AS html
FROM (SELECT o_orderkey, '<article ' || CASE o_orderkey % 2 WHEN 0 THEN 'id' ELSE 'data-job-id' END || '="job-card-' || CAST(o_custkey AS STRING) || '"><h2><a href="/c/co/' || CAST(o_custkey AS STRING) || '">Dev ' || CAST(o_orderkey AS STRING)
  || '</a></h2><a data-testid="job-card-company">Co</a><p>Reston</p><p>$120K - $' || CAST(130 + o_custkey % 50 AS STRING) || 'K/yr</p><p>$1</p></article>' AS card FROM <<orders>>) c"""
_ZIP_PANES = """SELECT CAST(c_custkey AS STRING) AS job_id, '<div>' || CASE WHEN c_custkey % 2 = 0 THEN '<a href="/jobs/' || CAST(c_custkey AS STRING) || '">go</a>' ELSE '' END
  || '<h2>Job description</h2><span>s</span><div><b>Do</b> it</div></div>' AS html FROM <<customer>>"""


@query(
    "board_zip_recruiter",
    """SELECT CAST(o_custkey AS VARCHAR) AS id, 'Dev ' || CAST(o_orderkey AS VARCHAR) AS title, 'Co' AS company,
    'https://www.ziprecruiter.com/' || CASE WHEN o_custkey % 2 = 0 THEN 'jobs/' ELSE 'c/co/' END || CAST(o_custkey AS VARCHAR) AS job_url,
    120000.0::DOUBLE AS min_amount, CAST(1000 * (130 + o_custkey % 50) AS DOUBLE) AS max_amount, 'yearly' AS "interval", '**Do** it' AS description
    FROM <<orders>>
    UNION ALL SELECT '', 'No id', '', 'https://www.ziprecruiter.com/c/none', NULL, NULL, NULL, '' FROM <<orders>> WHERE o_orderkey % 2 = 1""",
)
def board_zip_recruiter(s: Source) -> DataFrame:
    posts = pages.zip_recruiter(s.sql(_ZIP_CARDS), s.sql(_ZIP_PANES))
    return po.flat_postings(posts, "zip_recruiter").select(
        "id", "title", "company", "job_url", "min_amount", "max_amount", "interval", "description"
    )


_MA_CARDS = """SELECT s_suppkey AS payload_id, '<ul><li class="results-list__item"><h3 class="results-list__item-title"><a class="results-list__item-title--link" href="/x/job/H' || CAST(s_suppkey AS STRING)
  || '">Cook</a></h3>' || CASE WHEN s_suppkey % 2 = 0 THEN '<span class="reference">' || CAST(s_suppkey AS STRING) || '</span>' ELSE '' END
  || '<span class="results-list__item-street--label">7750 Wisconsin Ave, Bethesda MD, United States</span></li></ul>' AS html FROM <<supplier>>"""
_MA_DETAIL = """SELECT 'https://careers.marriott.com/x/job/H' || CAST(s_suppkey AS STRING) AS job_url,
  CASE WHEN s_suppkey % 2 = 0 THEN '<script type="application/ld+json">{"description":"<p>LD</p>","datePosted":"2001-07-0' || CAST(1 + s_suppkey % 9 AS STRING)
    || 'T10:00:00Z","employmentType":["FULL_TIME"],"jobLocationType":"TELECOMMUTE","baseSalary":{"currency":"USD","value":{"minValue":20,"maxValue":' || CASE WHEN s_suppkey % 4 = 0 THEN '0' ELSE '40' END || ',"unitText":"HOUR"}}}</script>'
  ELSE '<time datetime="2001-06-01">x</time><section class="job-description"><div class="description">Full time work, mail a@b.example.com</div></section>' END
  || '<div class="summary-list-item" data-pay-range="$21 - $31 hourly"></div>' AS html FROM <<supplier>>"""


@query(
    "board_marriott",
    """SELECT CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'H' END || CAST(s_suppkey AS VARCHAR) AS id, 'Cook' AS title, 'Marriott' AS company,
    'https://careers.marriott.com/x/job/H' || CAST(s_suppkey AS VARCHAR) AS job_url, 'Bethesda, MD, USA' AS location,
    CASE WHEN s_suppkey % 2 = 0 THEN DATE '2001-07-01' + CAST(s_suppkey % 9 AS INTEGER) ELSE DATE '2001-06-01' END AS date_posted,
    CASE WHEN s_suppkey % 2 = 0 THEN 'LD' ELSE 'Full time work, mail a@b.example.com' END AS description, 'fulltime' AS job_type,
    CASE WHEN s_suppkey % 2 = 0 THEN true END AS is_remote, CASE WHEN s_suppkey % 2 = 1 THEN 'a@b.example.com' END AS emails,
    CASE WHEN s_suppkey % 4 = 2 THEN 20.0::DOUBLE ELSE 21.0::DOUBLE END AS min_amount, CASE WHEN s_suppkey % 4 = 2 THEN 40.0::DOUBLE ELSE 31.0::DOUBLE END AS max_amount,
    'hourly' AS "interval" FROM <<supplier>>""",
)
def board_marriott(s: Source) -> DataFrame:
    posts = pages.marriott(s.sql(_MA_CARDS), s.sql(_MA_DETAIL))
    return po.flat_postings(posts, "marriott").select(
        "id", "title", "company", "job_url", "location", "date_posted", "description", "job_type",
        "is_remote", "emails", "min_amount", "max_amount", "interval",
    )


# --- descriptions out of pages -----------------------------------------------------------------------------


# the title of a page as it stands, in both forms; no quotes, which would end a JSON text
_TITLE = """trim(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '"', ''))"""

_TITLE_TEXT = f"""replace(replace(replace(regexp_replace({_TITLE}, '\\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"""


def _title() -> Column:
    return F.trim(F.replace(F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit('"'), F.lit("")))


def _markdown_sql(html: str) -> str:
    """Markdown of a page in SQL, by the same patterns."""

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''").replace("$1", "\\1").replace("$2", "\\2") + "'"

    out = (
        f"regexp_replace(regexp_replace({html}, '(?is)<!--.*?-->|<!doctype[^>]*>|<script\\b[^>]*>.*?</script\\s*>"
        "|<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '\\s+', ' ', 'g')"
    )
    for pattern, mark in text.markdown_steps():
        out = f"regexp_replace({out}, {quoted(pattern.replace('*+', '*'))}, {quoted(mark)}, 'g')"
    for name, sign in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")]:
        out = f"replace({out}, '&{name};', '{sign}')"
    out = f"regexp_replace(regexp_replace({out}, '\\n[ \\t]+', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"trim({out}, ' ' || chr(9) || chr(10))"


@query(
    "structured_descriptions",
    f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'about ' || {_TITLE} WHEN 1 THEN 'bare ' || {_TITLE} END AS description FROM <<pages>>""",
)
def structured_descriptions(s: Source) -> DataFrame:
    kind = F.col("page_id") % 4
    script = (
        F.when(
            kind == 0,
            F.concat(
                F.lit('<script type="application/ld+json">{"description":"about '), _title(), F.lit('"}</script>')
            ),
        )
        .when(kind == 1, F.concat(F.lit('<script>{"jobLocation":"x","description":"bare '), _title(), F.lit('"}</script>')))
        .when(kind == 2, '<script type="application/ld+json">{broken</script>')
        .otherwise("")
    )
    staged = s.table("pages").withColumn("html", F.concat(F.col("html"), script))
    return staged.select("page_id", pages.structured_description("html").alias("description"))


@query(
    "page_descriptions",
    f"""SELECT page_id, CASE WHEN page_id % 4 <> 1 THEN {_markdown_sql('html')}
      ELSE '# Job ' || {_TITLE_TEXT} || chr(10) || chr(10) || 'inner **text**' END AS description FROM <<pages>>
    UNION ALL SELECT -1 - page_id, '' FROM <<pages>> WHERE page_id < 2""",
)
def page_descriptions(s: Source) -> DataFrame:
    kind = F.col("page_id") % 4
    first = F.concat(
        F.lit('<div data-testid="job-description">no</div><div class="a show-more-less-html__markup"><div><h1>Job '),
        _title(), F.lit("</h1></div><p>inner <b>text</b></p></div>"),
    )
    html = F.when(kind == 1, F.concat(F.col("html"), first)).otherwise(F.col("html"))
    blank = s.table("pages").where("page_id < 2").select(
        (-1 - F.col("page_id")).alias("page_id"), "url", F.lit("<div> <!-- x --> </div>").alias("html")
    )
    staged = s.table("pages").withColumn("html", html).unionByName(blank)
    return pages.described(staged).select("page_id", "description")


@query(
    "greenhouse_descriptions",
    f"""SELECT page_id, '<div class="job__description a">one<div>x</div></div><div class="job__description">' || {_TITLE} || '</div>' AS description FROM <<pages>>""",
)
def greenhouse_descriptions(s: Source) -> DataFrame:
    html = F.concat(
        F.lit('<div class="job__description a">one<div>x</div></div>'), F.col("html"),
        F.lit('<div class="job__description">'), _title(), F.lit("</div>"),
    )
    found = pages.greenhouse_description(s.table("pages").withColumn("html", html))
    return found.select("page_id", "description")


@query(
    "page_headings",
    """SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) AS heading,
    CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS links FROM <<pages>>""",
)
def page_headings(s: Source) -> DataFrame:
    return pages.page_facts(s.table("pages")).select("page_id", "heading", "links")


@query(
    "unblocked_pages",
    """SELECT page_id FROM <<pages>> WHERE page_id % 6 NOT IN (1, 2)""",
)
def unblocked_pages(s: Source) -> DataFrame:
    kind = F.col("page_id") % 6
    html = F.concat(
        F.when(kind == 1, "<title>Just a moment...</title>")
        .when(kind == 2, "<p>Are you a robot?</p>")
        .otherwise(""),
        F.col("html"),
    )
    return pages.unblocked(s.table("pages").withColumn("html", html)).select("page_id")


# --- one frame, exports -----------------------------------------------------------------------------------

_WORKDAY_FLAT = """SELECT 'R' || CAST(c_custkey AS VARCHAR) AS id, 'workday' AS site FROM <<customer>>"""


@query(
    "unified_postings",
    f"""SELECT id, 'indeed' AS site, salary_source, "interval", company_industry FROM ({_INDEED_ROWS}) i
    UNION ALL SELECT id, site, NULL, NULL, NULL FROM ({_WORKDAY_FLAT}) w""",
)
def unified_postings(s: Source) -> DataFrame:
    landed = {
        "indeed": (s.sql(_INDEED),),
        "workday": (s.sql(_WORKDAY_LIST), s.sql(_WORKDAY_DETAIL)),
    }
    return boards.flatten_all(landed).select(
        "id", "site", "salary_source", "interval", "company_industry"
    )


# every payload is landed for two owners, who so share its urls
_OWNED = """SELECT 2 * p.payload_id + o.n AS payload_id, {columns} CASE o.n WHEN 0 THEN 'ann' ELSE 'bob' END AS owning_user,
  'term' AS search_term, 'run-1' AS run_id, p.payload FROM ({rows}) p LATERAL VIEW explode(array(0, 1)) o AS n"""
_SAVED = f"""SELECT owning_user, site, job_url, title, CASE WHEN length(title) % 2 = 0 THEN 'high' ELSE 'low' END AS score
  FROM (SELECT 'indeed' AS site, job_url, title FROM ({_INDEED_ROWS}) i
    UNION ALL SELECT 'workday', CASE WHEN c_custkey % 5 = 0 THEN 'https://ext.example.com/' || CAST(c_custkey AS VARCHAR)
      ELSE 'https://w.example.com/job/' || CAST(c_custkey AS VARCHAR) END, 'Title ' || CAST(c_nationkey AS VARCHAR) FROM <<customer>>) b,
    (VALUES ('ann'), ('bob')) o(owning_user) WHERE owning_user = 'ann' OR NOT contains(lower(title), 'title 2')"""


def _by_length(titles: list[str], role: str) -> list[dict[str, str]]:
    return [{"job_title": t, "score": "low" if len(t) % 2 else "high"} for t in titles]


def _landed_run(s: Source, root: str, number: int) -> DataFrame:
    """One attempt of a run over what two boards landed; returns its record."""
    landed = {
        "indeed": (s.sql(_OWNED.format(columns="", rows=_INDEED)),),
        "workday": (
            s.sql(_OWNED.format(columns="p.base_url, p.company_name,", rows=_WORKDAY_LIST)), s.sql(_WORKDAY_DETAIL),
        ),
    }
    profiles = s.spark.sql(
        """SELECT * FROM VALUES ('p', 'ann', 1, 'Engineer', array('')), ('p', 'bob', 1, 'Engineer', array('title 2'))
        AS t(profile_name, owning_user, is_default, desired_role_description, reject_job_titles)"""
    )
    none = {t: s.spark.createDataFrame([], schemas.STORE[n]) for t, n in (("cache", "title_score_cache"), ("stored", "job_details"))}
    logs = s.spark.sql(
        """SELECT 1L AS id, 'run-1' AS run_id, 'indeed' AS scraper, 'term' AS search_term, 0 AS jobs_found, true AS success
        UNION ALL SELECT 2L, 'run-1', 'workday', 'term', 0, true"""
    )

    def work() -> Run:
        incoming = po.with_arrivals(boards.flatten_all(landed))
        store = runs.postings(s.spark, root, number, none["stored"])
        cache = runs.newest(s.spark, root, number, "cache", none["cache"])
        return ingest_run(incoming, store, profiles, cache, runs.newest(s.spark, root, number, "logs", logs), _by_length, AS_OF)

    return runs.save(s.spark, root, number, work)


@query("landed_to_saved", f"SELECT *, 1 AS copies FROM ({_SAVED}) v")
def landed_to_saved(s: Source) -> DataFrame:
    """Two boards, two owners: a run, the same run again, and a later run over the same payloads."""
    root = f"{shared_folder(s.spark)}/runs-{uuid.uuid4().hex}"
    for number in (0, 0, 1):
        _landed_run(s, root, number)
    saved = runs.postings(s.spark, root, 2)
    keys = ["owning_user", "site", "job_url"]
    return saved.groupBy(*keys).agg(
        F.min("title").alias("title"), F.min("title_compatibility_score").alias("score"), F.count(F.lit(1)).cast("int").alias("copies")
    )


@query(
    "landed_counts",
    f"""WITH saved AS ({_SAVED})
    SELECT 0 AS run, count(*) AS saved, CAST(0 AS BIGINT) AS already_stored, count(*) FILTER (WHERE site = 'indeed') AS indeed_found,
      count(*) FILTER (WHERE site = 'workday') AS workday_found FROM saved
    UNION ALL SELECT 1, 0, count(*), count(*) FILTER (WHERE site = 'indeed'), count(*) FILTER (WHERE site = 'workday') FROM saved""",
)
def landed_counts(s: Source) -> DataFrame:
    """The records of the runs of ``landed_to_saved``, and the scrape logs after each; one that saves nothing leaves them."""
    root = f"{shared_folder(s.spark)}/runs-{uuid.uuid4().hex}"
    first, again, later = (_landed_run(s, root, number) for number in (0, 0, 1))
    records = first.unionByName(again).distinct().unionByName(later).select("run", "saved", "already_stored")
    found = [
        runs.newest(s.spark, root, n + 1, "logs", s.spark.createDataFrame([], "scraper string, jobs_found int")).select(
            F.lit(n).alias("run"), "scraper", F.col("jobs_found").cast("long").alias("jobs_found")
        )
        for n in (0, 1)
    ]
    logs = found[0].unionByName(found[1]).groupBy("run").agg(
        *[F.sum(F.when(F.col("scraper") == b, F.col("jobs_found"))).alias(f"{b}_found") for b in ("indeed", "workday")]
    )
    return records.join(logs, "run")


@query(
    "export_rows",
    """SELECT title, company, job_url AS url, strftime(date_posted, '%Y-%m-%d') AS date_posted, location,
    min_amount AS pay_min, max_amount AS pay_max FROM <<job_details>> WHERE title <> 'Chef'""",
)
def export_rows(s: Source) -> DataFrame:
    jobs = s.view("job_details").withColumn("title", F.when(F.col("title") != "Chef", F.col("title")))
    rows = exports.export_rows(jobs)
    return rows.select(
        "title", "company", "url", "date_posted", "location",
        F.col("compensation.min").alias("pay_min"), F.col("compensation.max").alias("pay_max"),
    )


@query(
    "csv_round_trip",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(len(text) AS BIGINT) AS text_length, source FROM <<documents>>""",
)
def csv_round_trip(s: Source) -> DataFrame:
    path = f"{shared_folder(s.spark)}/csv-{uuid.uuid4().hex}"
    docs = s.table("documents").select("doc_id", "text", "source")
    exports.write_csv(docs, path)
    back = s.spark.read.option("header", True).option("escape", "\\").option("multiLine", True).csv(path)
    return back.select("doc_id", F.length("text").cast("bigint").alias("text_length"), "source")
