"""Fixed values.

Word lists, lookup tables, patterns and formats that results depend on. They are stated here in
one place and in natural order; nothing in this file is logic. Patterns are written for the JVM:
``(?U)`` gives white space, word and digit classes their Unicode meaning and ``(?d)`` limits a
line end to ``\\n``.
"""

# --- output layout -------------------------------------------------------------------------

POSTING_COLUMNS = [
    "id",
    "site",
    "job_url",
    "job_url_direct",
    "title",
    "company",
    "location",
    "date_posted",
    "job_type",
    "salary_source",
    "interval",
    "min_amount",
    "max_amount",
    "currency",
    "is_remote",
    "job_level",
    "job_function",
    "listing_type",
    "emails",
    "description",
    "company_industry",
    "company_url",
    "company_logo",
    "company_url_direct",
    "company_addresses",
    "company_num_employees",
    "company_revenue",
    "company_description",
    "skills",
    "experience_range",
    "company_rating",
    "company_reviews_count",
    "vacancy_count",
    "work_from_home_type",
]

SITES = [
    "linkedin",
    "indeed",
    "zip_recruiter",
    "glassdoor",
    "google",
    "workday",
    "oraclecloud",
    "marriott",
    "eightfold",
    "usajobs",
]

MULTI_TENANT_SITES = ["oraclecloud", "workday", "eightfold"]

PAGE_SIZE = 100

# --- job types: canonical word first, then the other accepted spellings ----------------------

JOB_TYPES = {
    "fulltime": [
        "fulltime", "períodointegral", "estágio/trainee", "cunormăîntreagă", "tiempocompleto",
        "vollzeit", "voltijds", "tempointegral", "全职", "plnýúvazek", "fuldtid", "دوامكامل",
        "kokopäivätyö", "tempsplein", "πλήρηςαπασχόληση", "teljesmunkaidő", "tempopieno",
        "heltid", "jornadacompleta", "pełnyetat", "정규직", "100%", "全職", "งานประจำ",
        "tamzamanlı", "повназайнятість", "toànthờigian",
    ],
    "parttime": ["parttime", "teilzeit", "částečnýúvazek", "deltid"],
    "contract": ["contract", "contractor"],
    "temporary": ["temporary"],
    "internship": ["internship", "prácticas", "ojt(onthejobtraining)", "praktikum", "praktik"],
    "perdiem": ["perdiem"],
    "nights": ["nights"],
    "other": ["other"],
    "summer": ["summer"],
    "volunteer": ["volunteer"],
}

JOB_TYPE_WORDS = {
    "fulltime": r"(?iU)full\s?time",
    "parttime": r"(?iU)part\s?time",
    "internship": r"(?iU)internship",
    "contract": r"(?iU)contract",
}

# --- countries: code, accepted names (first is shown), country code --------------------------

COUNTRIES = [
    ("ARGENTINA", ["argentina"], "ar"),
    ("AUSTRALIA", ["australia"], "au"),
    ("AUSTRIA", ["austria"], "at"),
    ("BAHRAIN", ["bahrain"], "bh"),
    ("BANGLADESH", ["bangladesh"], "bd"),
    ("BELGIUM", ["belgium"], "be"),
    ("BULGARIA", ["bulgaria"], "bg"),
    ("BRAZIL", ["brazil"], "br"),
    ("CANADA", ["canada"], "ca"),
    ("CHILE", ["chile"], "cl"),
    ("CHINA", ["china"], "cn"),
    ("COLOMBIA", ["colombia"], "co"),
    ("COSTARICA", ["costa rica"], "cr"),
    ("CROATIA", ["croatia"], "hr"),
    ("CYPRUS", ["cyprus"], "cy"),
    ("CZECHREPUBLIC", ["czech republic", "czechia"], "cz"),
    ("DENMARK", ["denmark"], "dk"),
    ("ECUADOR", ["ecuador"], "ec"),
    ("EGYPT", ["egypt"], "eg"),
    ("ESTONIA", ["estonia"], "ee"),
    ("FINLAND", ["finland"], "fi"),
    ("FRANCE", ["france"], "fr"),
    ("GERMANY", ["germany"], "de"),
    ("GREECE", ["greece"], "gr"),
    ("HONGKONG", ["hong kong"], "hk"),
    ("HUNGARY", ["hungary"], "hu"),
    ("INDIA", ["india"], "in"),
    ("INDONESIA", ["indonesia"], "id"),
    ("IRELAND", ["ireland"], "ie"),
    ("ISRAEL", ["israel"], "il"),
    ("ITALY", ["italy"], "it"),
    ("JAPAN", ["japan"], "jp"),
    ("KUWAIT", ["kuwait"], "kw"),
    ("LATVIA", ["latvia"], "lv"),
    ("LITHUANIA", ["lithuania"], "lt"),
    ("LUXEMBOURG", ["luxembourg"], "lu"),
    ("MALAYSIA", ["malaysia"], "my"),
    ("MALTA", ["malta"], "mt"),
    ("MEXICO", ["mexico"], "mx"),
    ("MOROCCO", ["morocco"], "ma"),
    ("NETHERLANDS", ["netherlands"], "nl"),
    ("NEWZEALAND", ["new zealand"], "nz"),
    ("NIGERIA", ["nigeria"], "ng"),
    ("NORWAY", ["norway"], "no"),
    ("OMAN", ["oman"], "om"),
    ("PAKISTAN", ["pakistan"], "pk"),
    ("PANAMA", ["panama"], "pa"),
    ("PERU", ["peru"], "pe"),
    ("PHILIPPINES", ["philippines"], "ph"),
    ("POLAND", ["poland"], "pl"),
    ("PORTUGAL", ["portugal"], "pt"),
    ("QATAR", ["qatar"], "qa"),
    ("ROMANIA", ["romania"], "ro"),
    ("SAUDIARABIA", ["saudi arabia"], "sa"),
    ("SINGAPORE", ["singapore"], "sg"),
    ("SLOVAKIA", ["slovakia"], "sk"),
    ("SLOVENIA", ["slovenia"], "sl"),
    ("SOUTHAFRICA", ["south africa"], "za"),
    ("SOUTHKOREA", ["south korea"], "kr"),
    ("SPAIN", ["spain"], "es"),
    ("SWEDEN", ["sweden"], "se"),
    ("SWITZERLAND", ["switzerland"], "ch"),
    ("TAIWAN", ["taiwan"], "tw"),
    ("THAILAND", ["thailand"], "th"),
    ("TURKEY", ["türkiye", "turkey"], "tr"),
    ("UKRAINE", ["ukraine"], "ua"),
    ("UNITEDARABEMIRATES", ["united arab emirates"], "ae"),
    ("UK", ["uk", "united kingdom"], "gb"),
    ("USA", ["usa", "us", "united states"], "us"),
    ("URUGUAY", ["uruguay"], "uy"),
    ("VENEZUELA", ["venezuela"], "ve"),
    ("VIETNAM", ["vietnam"], "vn"),
    ("US_CANADA", ["usa/ca"], "www"),
    ("WORLDWIDE", ["worldwide"], "www"),
]
COUNTRIES_SHOWN_UPPER = ["usa", "uk"]
COUNTRIES_HIDDEN = ["US_CANADA", "WORLDWIDE"]

# --- pay -------------------------------------------------------------------------------------

ANNUAL_FACTORS = {"hourly": 2080, "daily": 260, "weekly": 52, "monthly": 12}
PAY_PERIODS = {
    "YEAR": "yearly",
    "HOUR": "hourly",
    "YEARLY": "yearly",
    "MONTHLY": "monthly",
    "WEEKLY": "weekly",
    "DAILY": "daily",
    "HOURLY": "hourly",
}
PAY_UNITS = {
    "DAY": "daily",
    "YEAR": "yearly",
    "HOUR": "hourly",
    "WEEK": "weekly",
    "MONTH": "monthly",
}
# order in which a free unit word is tested
PAY_UNIT_WORDS = ["YEAR", "MONTH", "WEEK", "DAY", "HOUR"]
SALARY_LOWER = 1000
SALARY_UPPER = 700000
HOURLY_BELOW = 350
MONTHLY_BELOW = 30000
SALARY_PATTERN = (
    r"(?U)\$(\d+(?:,\d+)?(?:\.\d+)?)([kK]?)\s*[-—–]\s*(?:\$)?(\d+(?:,\d+)?(?:\.\d+)?)([kK]?)"
)
PAY_RANGE_PATTERN = r"\$?([0-9,]+)\s*-\s*\$?([0-9,]+)\s*([A-Za-z]+)?"

# --- text rules ------------------------------------------------------------------------------

# what str.strip() removes
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# what str.splitlines() breaks on
LINE_BREAK_PATTERN = "\\r\\n|[\\n\\x0B\\f\\r\\x1C-\\x1E\\x85\\u2028\\u2029]"

EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

PII_NAME_PATTERN = r"^(\*\*)?[A-Za-z]+ [A-Za-z]+(\*\*)?"
PII_NAME_TEXT = "firstname lastname"
PII_EMAIL_PATTERN = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PII_EMAIL_TEXT = "email@example.com"
PII_PHONE_PATTERN = r"(?U)(?:\(\d{3}\)[\s.-]*|\b\d{3}[\s.-]+)\d{3}[\s.-]+\d{4}\b"
PII_PHONE_TEXT = "123-456-7890"
PII_ANCHOR_PATTERN = r"(?dU)<a\s[^>]*>(.*?)</a>"
PII_URL_PATTERN = r"(?dU)http\S+|www.\S+"
PII_URL_TEXT = "http://pii_replaced_example.com"

REDACT_CUT_PREFIX = "Benefits"
REDACT_PHRASES = [
    "![SVG",
    "http",
    "The Fair Chance Act",
    "**Reasonable Accommodation:**",
    "**Disability Employment:**",
    "**IMPORTANT INFORMATION FOR SURPLUS OR DISPLACED FEDERAL EMPLOYEES:**",
    "PERMANENT CHANGE OF STATION (PCS)",
    "DIRECT DEPOSIT:",
    "**Equal Employment Opportunity (EEO)",
]

CLEARANCE_DESCRIPTION_PATTERN = (
    r"(?diU)\b(current|active|required|requirement|requires)\s+(?:\S+\s+){0,10}"
    r"(security clearance|TS/SCI|public trust|secret|top.secret)\b"
)
CLEARANCE_TITLE_PATTERN = (
    r"(?diU)\b(current|active|with).*(security clearance|TS/SCI|public trust|secret|top.secret)\b"
)

REMOTE_WORDS = ["remote", "work from home", "wfh"]

BLOCK_CLOUDFLARE = "Cloudflare challenge"
BLOCK_DENIED = "Access denied (403)"
BLOCK_CAPTCHA = "CAPTCHA detected"
BLOCK_BOT = "Bot detection page"

TRUE_WORDS = ["true", "1", "yes"]
READY_MIN_CHARS = 100
PROMPT_MAX_CHARS = 32061
CANDIDATE_MARKER = "<!-- CANDIDATE -->"
USER_MARKER = "<!-- USER -->"

# --- search and tracking ---------------------------------------------------------------------

DATE_RANGE_DAYS = {"today": 0, "yesterday": 1, "1week": 7, "2weeks": 14, "1month": 30}

APPLICATION_STATUSES = [
    ("submitted", "Submitted"),
    ("initial_criteria_met", "Initial Criteria Met"),
    ("screen_scheduled", "Screen Scheduled"),
    ("screen_completed", "Screen Completed"),
    ("interview_scheduled", "Interview Scheduled"),
    ("interview_completed", "Interview Completed"),
    ("offer", "Offer"),
    ("offer_accepted", "Offer Accepted"),
    ("offer_declined", "Offer Declined"),
    ("not_considered", "Not Considered"),
    ("withdrawn", "Withdrawn"),
    ("expired", "Expired"),
]
TERMINAL_STATUSES = ["offer_accepted", "offer_declined", "not_considered", "withdrawn", "expired"]
REVIEW_STATUSES = ["not_reviewed", "saved", "applied", "rejected"]
KEPT_REVIEW_STATUSES = ["saved", "applied"]

APPLY_NOTE = "Applied"
MANUAL_NOTE = "Manually added"
MANUAL_SITE = "manual"
DASH = "—"

# --- scored results --------------------------------------------------------------------------

RESULT_VERSION = "1.0"
CLEARANCE_STATUSES = {
    "ACTIVE_REQUIRED": "Active Required",
    "ABILITY_TO_OBTAIN": "Ability to Obtain",
    "NONE_REQUIRED": "None Required",
}
CITIZENSHIP_STATUSES = {
    "REQUIRED": "Required",
    "PREFERRED": "Preferred",
    "NOT_REQUIRED": "Not Required",
}
BREAKDOWN_WEIGHTS = {
    "keyword_alignment": 0.60,
    "seniority_alignment": 0.20,
    "impact_metrics": 0.10,
    "structural_parsability": 0.10,
}
RESUME_SECTIONS = [
    ("Resume Basics", [
        ("resume_clarity", "Resume Clarity"),
        ("contact_information", "Contact Information"),
        ("chronological_order", "Chronological Order"),
        ("formatting", "Formatting"),
        ("resume_length", "Resume Length"),
    ]),
    ("Summary Strength", [
        ("headline", "Headline"),
        ("summary", "Summary"),
    ]),
    ("Experience Audit", [
        ("experience_details", "Experience Details"),
        ("recent_experience", "Recent Experience"),
        ("role_separation", "Role Separation"),
    ]),
    ("Achievements", [
        ("quantified_achievements", "Quantified Achievements"),
        ("technologies", "Technologies"),
        ("numbers_placement", "Numbers Placement"),
    ]),
    ("Language & Tone", [
        ("verb_usage", "Verb Usage"),
        ("grammar", "Grammar"),
        ("punctuation", "Punctuation"),
        ("voice_and_terse", "Voice & Terse"),
    ]),
    ("Visual Impact", [
        ("text_format", "Text Format"),
        ("layout", "Layout"),
        ("font_styles", "Font Styles"),
        ("file_size", "File Size"),
    ]),
]
USAGE_FIELDS = [
    "prompt_tokens",
    "completion_tokens",
    "total_tokens",
    "cache_hit_tokens",
    "cache_miss_tokens",
]
USAGE_SERIES = [
    ("prompt_tokens", "Prompt"),
    ("completion_tokens", "Completion"),
    ("cache_hit_tokens", "Cache hit"),
    ("cache_miss_tokens", "Cache miss"),
]
NO_RUN_SUFFIX = " (pre-run_id)"

# --- board urls and url parameters -------------------------------------------------------------

INDEED_BASE = "https://www.indeed.com"
LINKEDIN_BASE = "https://www.linkedin.com"
GLASSDOOR_BASE = "https://www.glassdoor.com/"
ZIP_BASE = "https://www.ziprecruiter.com"
MARRIOTT_BASE = "https://careers.marriott.com"
GOOGLE_RESULT_BASE = "https://www.google.com/about/careers/applications/jobs/results/"
NFCU_JOB_BASE = (
    "https://fa-etbx-saasfaprod1.fa.ocs.oraclecloud.com/hcmUI/CandidateExperience/en/sites/nfcu/job/"
)

WORKDAY_FACETS = ["locations", "jobFamilyGroup", "jobFamily", "workerSubType", "timeType"]
WORKDAY_FACET_VALUE_PATTERN = r"^[0-9a-f]{32}$"
ORACLE_PARAMS = [
    "location", "locationId", "locationLevel", "selectedCategoriesFacet", "selectedTitlesFacet",
    "selectedWorkplaceTypesFacet", "radius", "radiusUnit",
]
EIGHTFOLD_PARAMS = ["pid", "location", "sort_by"]
EIGHTFOLD_PREFIX = "filter_"
USAJOBS_KEYWORD_PARAM = "k"
EIGHTFOLD_URL_SKIP = ["base_url", "company_name", "domain"]
USAJOBS_URL_SKIP = ["base_url", "company_name"]
USAJOBS_SITE = "https://www.usajobs.gov"
USAJOBS_SEARCH_PATH = "/search/results/"

# --- page rules: (tag, attribute, comparison, value), first match in this order -----------------

DESCRIPTION_BLOCKS = [
    ("div", "class", "word", "show-more-less-html__markup"),
    ("div", "data-testid", "equals", "job-description"),
    ("div", "class", "word", "job-desc-content"),
    ("div", "class", "word", "css-11p01j8"),
]
