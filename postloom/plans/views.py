"""Posting-shaped views over the supplied tables.

The same text runs in Spark SQL and in the checking database; ``<<name>>`` marks a table or a view.
"""

VIEWS = {}

VIEWS["job_details"] = """
SELECT o.o_orderkey AS id,
       'https://jobs.example.com/view/' || CAST(o.o_orderkey AS STRING) AS job_url,
       CASE o.o_custkey % 8 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'linkedin' WHEN 2 THEN 'indeed' WHEN 3 THEN 'Indeed'
            WHEN 4 THEN 'workday' WHEN 5 THEN 'oraclecloud' WHEN 6 THEN '' ELSE 'usajobs' END AS site,
       CASE o.o_orderkey % 6 WHEN 0 THEN 'Senior Data Engineer' WHEN 1 THEN 'Data Analyst' WHEN 2 THEN 'Registered Nurse'
            WHEN 3 THEN 'Security Architect' WHEN 4 THEN 'software ENGINEER intern' ELSE 'Chef' END AS title,
       c.c_name AS company,
       n.n_name AS location,
       CAST(o.o_orderdate AS DATE) AS date_posted,
       CASE WHEN o.o_orderkey % 3 = 0 THEN 'yearly' WHEN o.o_orderkey % 3 = 1 THEN 'hourly' ELSE '' END AS interval_unit,
       CASE WHEN o.o_orderkey % 3 = 2 THEN CAST(NULL AS DOUBLE) ELSE floor(o.o_totalprice / 10) END AS min_amount,
       CASE WHEN o.o_orderkey % 3 = 2 THEN CAST(NULL AS DOUBLE) ELSE floor(o.o_totalprice / 8) END AS max_amount,
       CAST(floor(o.o_totalprice) AS BIGINT) % 101 AS job_score,
       CASE WHEN o.o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS security_clearance_required,
       CASE WHEN o.o_orderkey % 11 < 6 THEN 'not_reviewed' WHEN o.o_orderkey % 11 < 8 THEN 'saved'
            WHEN o.o_orderkey % 11 < 10 THEN 'applied' ELSE 'rejected' END AS review_status,
       CASE o.o_orderkey % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'medium'
            WHEN 4 THEN 'low' WHEN 5 THEN '' ELSE CAST(NULL AS STRING) END AS title_compatibility_score,
       c.c_mktsegment AS owning_user,
       CASE o.o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'data engineer' WHEN 2 THEN 'Security' WHEN 3 THEN 'nurse'
            ELSE CAST(NULL AS STRING) END AS search_term,
       CASE WHEN o.o_orderkey % 11 IN (8, 9) THEN CAST(o.o_orderdate AS DATE) ELSE CAST(NULL AS DATE) END AS applied_at
FROM <<orders>> o
JOIN <<customer>> c ON o.o_custkey = c.c_custkey
JOIN <<nation>> n ON c.c_nationkey = n.n_nationkey
"""

VIEWS["applied_job_status_history"] = """
SELECT l_orderkey * 10 + l_linenumber AS id,
       l_orderkey AS applied_job_id,
       CASE min(l_partkey) % 12 WHEN 0 THEN 'submitted' WHEN 1 THEN 'initial_criteria_met' WHEN 2 THEN 'screen_scheduled'
            WHEN 3 THEN 'screen_completed' WHEN 4 THEN 'interview_scheduled' WHEN 5 THEN 'interview_completed'
            WHEN 6 THEN 'offer' WHEN 7 THEN 'offer_accepted' WHEN 8 THEN 'offer_declined' WHEN 9 THEN 'not_considered'
            WHEN 10 THEN 'withdrawn' ELSE 'expired' END AS status,
       CAST(min(l_shipdate) AS DATE) AS changed_at
FROM <<lineitem>>
GROUP BY l_orderkey, l_linenumber
"""

VIEWS["llm_usage_log"] = """
SELECT event_id AS id,
       ts AS log_ts,
       CASE WHEN user_id % 25 = 0 THEN '' ELSE 'run-' || CAST(CAST(ts AS DATE) AS STRING) END AS run_id,
       CASE event_type WHEN 'click' THEN 'ats_scoring' WHEN 'purchase' THEN 'resume_ats' WHEN 'signup' THEN ''
            ELSE 'title_scoring' END AS call_type,
       CAST(floor(value * 10) AS BIGINT) AS prompt_tokens,
       CAST(floor(value) AS BIGINT) AS completion_tokens,
       CAST(floor(value * 10) AS BIGINT) + CAST(floor(value) AS BIGINT) AS total_tokens,
       user_id % 40 AS cache_hit_tokens,
       event_id % 90 AS cache_miss_tokens,
       CAST(floor(value * 3) AS BIGINT) AS duration_ms
FROM <<events>>
"""

VIEWS["scraping_logs"] = """
SELECT event_id AS id,
       'run-' || CAST(CAST(ts AS DATE) AS STRING) AS run_id,
       CASE user_id % 4 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'workday' ELSE 'oraclecloud' END AS scraper,
       CASE user_id % 3 WHEN 0 THEN 'data engineer' WHEN 1 THEN 'Security' ELSE 'nurse' END AS search_term,
       CAST(floor(value / 10) AS BIGINT) AS jobs_found,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success,
       ts AS log_ts
FROM <<events>>
"""

VIEWS["title_score_cache"] = """
SELECT CASE p_size % 5 WHEN 0 THEN 'FURNITURE' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'BUILDING'
            WHEN 3 THEN 'AUTOMOBILE' ELSE 'HOUSEHOLD' END AS owning_user,
       'role ' || CAST(p_size % 3 AS STRING) AS role_normalized,
       lower(p_name || ' ' || p_brand) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' (old)' END
         AS title_normalized,
       CASE min(p_partkey) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS score,
       CASE WHEN min(p_partkey) % 4 = 0 THEN DATE '2023-06-01' ELSE DATE '2024-01-15' END AS date_updated
FROM <<part>>
GROUP BY 1, 2, 3
"""

VIEWS["title_probes"] = """
SELECT p_partkey AS probe_id,
       CASE p_size % 5 WHEN 0 THEN 'FURNITURE' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'BUILDING'
            WHEN 3 THEN 'AUTOMOBILE' ELSE 'HOUSEHOLD' END AS owning_user,
       'ROLE  ' || CAST(p_size % 3 AS STRING) AS desired_role,
       '  ' || upper(p_name) || '   ' || p_brand || ' ' AS title
FROM <<part>>
"""

VIEWS["incoming_postings"] = """
SELECT l_orderkey * 10 + l_linenumber AS arrival_id,
       'https://jobs.example.com/view/' || CAST(l_orderkey * 2 AS STRING) AS job_url,
       CASE min(l_partkey) % 5 WHEN 0 THEN 'FURNITURE' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'BUILDING'
            WHEN 3 THEN 'AUTOMOBILE' ELSE 'HOUSEHOLD' END AS owning_user,
       CASE l_orderkey % 4 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'workday' ELSE 'oraclecloud' END AS site,
       CASE l_orderkey % 6 WHEN 0 THEN 'Senior Data Engineer' WHEN 1 THEN 'Data Analyst' WHEN 2 THEN 'Registered Nurse'
            WHEN 3 THEN 'Security Architect' WHEN 4 THEN 'software ENGINEER intern' ELSE 'Chef' END AS title,
       CAST(min(l_shipdate) AS DATE) AS date_posted
FROM <<lineitem>>
GROUP BY l_orderkey, l_linenumber
"""

VIEWS["salary_texts"] = """
SELECT o_orderkey AS id,
       CASE o_orderkey % 6
            WHEN 0 THEN 'Pay $' || CAST(90 + o_custkey % 60 AS STRING) || 'k - $' || CAST(140 + o_custkey % 90 AS STRING) || 'k a year'
            WHEN 1 THEN 'Rate: $' || CAST(20 + o_custkey % 50 AS STRING) || '.50 - ' || CAST(60 + o_custkey % 40 AS STRING) || ' per hour'
            WHEN 2 THEN '$' || CAST(3 + o_custkey % 6 AS STRING) || ',000 - $' || CAST(9 + o_custkey % 9 AS STRING) || ',500 monthly'
            WHEN 3 THEN '$' || CAST(50 + o_custkey % 30 AS STRING) || ' - $400'
            WHEN 4 THEN '$150,000 - $100,000'
            ELSE 'competitive pay' END AS description
FROM <<orders>>
"""

VIEWS["clearance_texts"] = """
SELECT doc_id AS id,
       CASE doc_id % 6 WHEN 0 THEN 'Must have an active TS/SCI clearance. ' WHEN 1 THEN 'Current Secret clearance needed. '
            WHEN 2 THEN 'requires the ability to obtain public trust. ' WHEN 3 THEN 'Inactive secret garden. '
            ELSE '' END || text AS description,
       CASE WHEN doc_id % 5 = 0 THEN 'Analyst with Secret clearance' ELSE 'Analyst' END AS title
FROM <<documents>>
"""

VIEWS["results_json"] = """
SELECT o_orderkey AS id,
       CASE o_orderkey % 4
            WHEN 0 THEN '{"schema_version":"1.0","decision":"Pass","clearance_assessment":{"status":"Active Required"},"job_requirements":{"travel_percentage":"25%"},"ats_score_estimate":{"total_overall_score":' || CAST(o_custkey % 101 AS STRING) || '}}'
            WHEN 1 THEN '{"schema_version":"1.0","decision":"Fail","clearance_assessment":{"status":"None Required"},"ats_score_estimate":{"total_overall_score":' || CAST(o_custkey % 101 AS STRING) || '}}'
            WHEN 2 THEN '{"score":{"final_score":0.' || CAST(10 + o_custkey % 90 AS STRING) || '},"security_clearances":{"matching_security_clearances_count":0,"missing_security_clearances_count":' || CAST(o_custkey % 2 AS STRING) || '}}'
            ELSE '{}' END AS job_score_json
FROM <<orders>>
"""

VIEWS["described_jobs"] = """
SELECT j.*,
       CASE WHEN id % 9 = 0 THEN '  '
            WHEN id % 9 = 1 THEN 'Remote work for ' || company || '. Pay $' || CAST(90 + id % 60 AS STRING) || 'k - $' || CAST(150 + id % 40 AS STRING) || 'k'
            WHEN id % 9 = 2 THEN 'Must have an active TS/SCI clearance. ' || title
            ELSE 'Work as ' || title || ' at ' || company || ', full time.' END AS description,
       CASE WHEN id % 10 < 8 THEN '{}' ELSE '{"decision":"Pass"}' END AS job_score_json,
       CASE WHEN id % 5 = 0 THEN 'USD' WHEN id % 5 = 1 THEN '$' ELSE '' END AS currency,
       CASE WHEN id % 4 = 0 THEN 'True' WHEN id % 4 = 1 THEN '0' WHEN id % 4 = 2 THEN 'yes' ELSE CAST(NULL AS STRING) END AS is_remote
FROM <<job_details>> j
"""

VIEWS["job_profiles"] = """
SELECT c_name AS profile_name,
       c_mktsegment AS owning_user,
       CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Jane Doe' || chr(10) || 'jane' || CAST(c_custkey AS STRING) || '@mail.example.com' END AS resume,
       CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Role  ' || CAST(c_nationkey % 3 AS STRING) END AS desired_role_description,
       CASE c_custkey % 5 WHEN 0 THEN '[]' WHEN 1 THEN '["data engineer","nurse"]' WHEN 2 THEN ''
            WHEN 3 THEN '["security"]' ELSE 'bad' END AS keywords,
       'Reston, VA' AS location,
       1 - c_custkey % 2 AS us_citizen,
       CASE WHEN c_mktsegment <> 'HOUSEHOLD' AND c_custkey % 10 IN (0, 3, 4) THEN 1 ELSE 0 END AS is_default
FROM <<customer>>
"""

VIEWS["scraper_configs"] = """
SELECT 'key' || CAST(s_suppkey AS STRING) AS config_key,
       CASE s_suppkey % 5 WHEN 0 THEN 'workday' WHEN 1 THEN 'oraclecloud' WHEN 2 THEN 'eightfold' WHEN 3 THEN 'usajobs' ELSE 'workday' END AS config_type,
       s_name AS company_name,
       CASE s_nationkey % 6 WHEN 0 THEN 'FURNITURE' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'BUILDING' WHEN 3 THEN 'AUTOMOBILE' WHEN 4 THEN 'HOUSEHOLD' ELSE '' END AS owning_user,
       '{"company_name":"' || s_name || '","base_url":"https://h' || CAST(s_suppkey % 40 AS STRING) || '.example.com' || CASE WHEN s_suppkey % 3 = 0 THEN '/' ELSE '' END || '","pid":"' || CAST(s_suppkey AS STRING) || '"}' AS config_json
FROM <<supplier>>
"""

VIEWS["users"] = """
SELECT CASE WHEN c_acctbal > 0 THEN c_name ELSE 'Former ' || c_name END AS username,
       CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Name ' || CAST(c_custkey AS STRING) END AS display_name,
       'pic' || CAST(c_nationkey AS STRING) AS picture_url,
       CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name || '@example.com' END AS email,
       CASE WHEN c_custkey % 2 = 0 THEN 'local' ELSE 'google-oauth' END AS auth_provider
FROM <<customer>>
"""

VIEWS["user_changes"] = """
SELECT c_name AS username, 'New ' || c_name AS display_name, 'newpic' AS picture_url,
       'new' || CAST(c_custkey AS STRING) || '@example.org' AS email, 'local' AS auth_provider, 2 AS version
FROM <<customer>>
UNION ALL
SELECT c_name, 'Old ' || c_name, 'oldpic', 'old' || CAST(c_custkey AS STRING) || '@example.org', 'local', 1
FROM <<customer>>
"""

VIEWS["resume_audits"] = """
SELECT c_name AS profile_name, c_mktsegment AS owning_user,
       CASE WHEN c_custkey % 9 = 0 THEN 'bad' WHEN c_custkey % 9 = 1 THEN ''
            ELSE '{"headline":{"score":' || CAST(c_custkey % 11 AS STRING) || ',"analysis":"a' || CAST(c_nationkey AS STRING) || '"},"grammar":{"score":' || CAST(c_nationkey % 11 AS STRING) || ',"analysis":"ok"},"layout":null,"top_matching_job_titles":["x"]}' END AS ats_score
FROM <<customer>>
"""

VIEWS["answers"] = """
SELECT o_orderkey AS id,
       CASE o_orderkey % 5 WHEN 0 THEN 'Here it is: {"decision":"Pass","n":' || CAST(o_custkey AS STRING) || '} done'
            WHEN 1 THEN 'List [{"job_title":"a","score":"high"}] end' WHEN 2 THEN 'no json here'
            WHEN 3 THEN 'broken } and {' ELSE '{"a":[1,2]}' END AS answer
FROM <<orders>>
"""

VIEWS["posting_urls"] = """
SELECT o_orderkey AS id,
       CASE o_orderkey % 8
            WHEN 0 THEN 'https://www.linkedin.com/jobs/view/' || CAST(o_orderkey AS STRING) || '/?trk=a'
            WHEN 1 THEN 'https://www.indeed.com/?vjk=k' || CAST(o_custkey AS STRING) || '&advn=4'
            WHEN 2 THEN 'https://www.dice.com/job-detail/' || CAST(o_orderkey AS STRING)
            WHEN 3 THEN 'https://fa-etbx.fa.ocs.oraclecloud.com/hcmUI/CandidateExperience/en/sites/nfcu/job/' || CAST(o_orderkey AS STRING) || '/?keyword=x'
            WHEN 4 THEN 'https://acme' || CAST(o_custkey % 9 AS STRING) || '.wd1.myworkdayjobs.com/en/x/job/Eng_R' || CAST(o_orderkey AS STRING) || '-1?q=1'
            WHEN 5 THEN 'https://jobs.example.com/view/' || CAST(o_orderkey AS STRING)
            WHEN 6 THEN 'https://apply.example.com/careers?start=0&pid=' || CAST(o_orderkey AS STRING) || '&location=Reston%2C+VA&sort_by=new&filter_x=' || CAST(o_custkey % 5 AS STRING)
            ELSE 'plain text ' || CAST(o_orderkey AS STRING) END AS url
FROM <<orders>>
"""

VIEWS["place_texts"] = """
SELECT c_custkey AS id,
       CASE c_custkey % 6 WHEN 0 THEN 'Vienna, VA, United States' WHEN 1 THEN 'Reston, VA' WHEN 2 THEN 'Toronto, ON, Canada'
            WHEN 3 THEN 'Paris' WHEN 4 THEN 'London, England, uk' ELSE '' END AS place
FROM <<customer>>
"""

VIEWS["money_texts"] = """
SELECT o_orderkey AS id,
       CASE o_orderkey % 5 WHEN 0 THEN '$' || CAST(o_custkey AS STRING) || ',' || CAST(100 + o_orderkey % 900 AS STRING) || '.50'
            WHEN 1 THEN CAST(1 + o_custkey % 900 AS STRING) || '.' || CAST(100 + o_orderkey % 900 AS STRING) || ',75 EUR'
            WHEN 2 THEN '$' || CAST(o_custkey AS STRING) || '/yr' WHEN 3 THEN 'n/a' ELSE '-' || CAST(o_custkey % 1000 AS STRING) || '.5' END AS amount
FROM <<orders>>
"""

# the month's calls in four landings, some one or two landings late
VIEWS["landed_usage"] = """
SELECT u.*, least(3, CASE WHEN extract(DAY FROM log_ts) <= 8 THEN 0 WHEN extract(DAY FROM log_ts) <= 16 THEN 1
         WHEN extract(DAY FROM log_ts) <= 24 THEN 2 ELSE 3 END + CASE id % 19 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) AS landing
FROM <<llm_usage_log>> u
"""

# the years' arrivals likewise; a url is found again and again, by smaller arrival numbers too
VIEWS["landed_postings"] = """
SELECT i.*, least(3, CASE WHEN extract(YEAR FROM date_posted) <= 1996 THEN 0 WHEN extract(YEAR FROM date_posted) <= 1998 THEN 1
         WHEN extract(YEAR FROM date_posted) <= 2000 THEN 2 ELSE 3 END + CASE WHEN arrival_id % 7 = 0 THEN 1 ELSE 0 END) AS landing
FROM <<incoming_postings>> i
"""

# the tables after a feed of edits, deletes and new rows
VIEWS["changed_jobs"] = """
SELECT id, owning_user, site, search_term, CASE WHEN id % 5 = 0 THEN 'high' ELSE title_compatibility_score END AS title_compatibility_score,
       CASE WHEN id % 5 = 0 THEN 'saved' WHEN id % 7 = 0 THEN 'not_reviewed' ELSE review_status END AS review_status
FROM <<job_details>> WHERE id % 13 <> 0
UNION ALL SELECT -id, owning_user, 'newsite', 'kafka', 'high', 'not_reviewed' FROM <<job_details>> WHERE id % 17 = 0
"""

VIEWS["changed_usage"] = """
SELECT id, log_ts, run_id, call_type, prompt_tokens, completion_tokens, total_tokens, cache_hit_tokens, cache_miss_tokens
FROM <<llm_usage_log>> WHERE id % 9 <> 0
UNION ALL SELECT -id, log_ts - INTERVAL 1 HOUR, run_id, call_type, 1, 1, 2, 0, 0 FROM <<llm_usage_log>> WHERE id % 23 = 0
"""
