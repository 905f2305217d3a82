"""Column rules on single values and against plain-Python models."""

import datetime as dt
import html as html_lib
import re

import pytest
from pyspark.sql import functions as F

from postloom import fixed_values as fv
from postloom.functions import dates, jobtypes, pay, places, results, text, urls
from postloom.functions.expr import strip


def test_normalize(one):
    assert one("  Senior   SOFTWARE\tEng x ", text.normalize_text) == "senior software eng x"
    assert one(None, text.normalize_text) == ""


def test_emails(one):
    assert one("a@b.com x c.d@e.org", text.emails) == ["a@b.com", "c.d@e.org"]
    assert one("none", text.emails) == []
    assert one("", text.emails) is None


@pytest.mark.parametrize(
    "raw, masked",
    [
        (
            "John Smith\nme@x.com (703) 555-1234\r\n<a href='x'>link</a> http://foo.bar/x www.a.b\n",
            "firstname lastname\nemail@example.com 123-456-7890\n"
            "link http://pii_replaced_example.com http://pii_replaced_example.com",
        ),
        ("**Jane Doe**, PhD tel 703 555 1234", "firstname lastname, PhD\ntel 123-456-7890"),
        ("x", "x\n"),
        ("", ""),
    ],
)
def test_remove_pii(one, raw, masked):
    assert one(raw, text.remove_pii) == masked


def _model_pii(raw: str) -> str:
    lines = raw.splitlines()
    if lines:
        first = re.sub(r"^(\*\*)?[A-Za-z]+ [A-Za-z]+(\*\*)?", fv.PII_NAME_TEXT, lines[0])
        raw = first + "\n" + "\n".join(lines[1:])
    for pattern, mask in (
        (fv.PII_EMAIL_PATTERN, fv.PII_EMAIL_TEXT),
        (fv.PII_PHONE_PATTERN, fv.PII_PHONE_TEXT),
        (fv.PII_ANCHOR_PATTERN, r"\1"),
        (fv.PII_URL_PATTERN, fv.PII_URL_TEXT),
    ):
        raw = re.sub(re.sub(r"^\(\?[a-zA-Z]+\)", "", pattern), mask, raw)
    return raw


def test_remove_pii_equals_model(source):
    rows = source.table("documents").select("text", text.remove_pii("text").alias("masked")).collect()
    assert len(rows) > 100
    assert [r["masked"] for r in rows] == [_model_pii(r["text"]) for r in rows]


def _model_redact(raw: str) -> str:
    kept = []
    for line in raw.split("\n"):
        if line.startswith(fv.REDACT_CUT_PREFIX):
            break
        if line.strip() and not any(p in line for p in fv.REDACT_PHRASES):
            kept.append(line)
    return "\n".join(kept)


def test_redact_equals_model(spark, source):
    docs = [r["text"] for r in source.table("documents").select("text").limit(50).collect()]
    docs += ["a\n\n see http://x\nb\nBenefits: z\nc", "Benefits", "", "x\nDIRECT DEPOSIT: y\n  \nz"]
    df = spark.createDataFrame([(d,) for d in docs], "t string")
    got = [r["r"] for r in df.select(text.redact("t").alias("r")).collect()]
    assert got == [_model_redact(d) for d in docs]


@pytest.mark.parametrize(
    "description, title, flag",
    [
        ("Must have an active TS/SCI clearance", "x", 1),
        ("active secret", "x", 1),
        ("requires the ability to obtain a public trust", "x", 1),
        ("Inactive secret garden", "x", 0),
        ("active " + "word " * 11 + "secret", "x", 0),
        ("", "Analyst with Top Secret", 1),
        (None, None, 0),
        ("top secret only", "Analyst", 0),
    ],
)
def test_clearance(spark, description, title, flag):
    df = spark.createDataFrame([(description, title)], "d string, t string")
    assert df.select(text.clearance_flag("d", "t")).first()[0] == flag


def test_small_text_rules(one):
    assert one("Iv1_health-care_&_it", text.industry) == "Health-Care & It"
    assert one("YES", text.truthy) is True
    assert one(None, text.truthy) is False
    assert one("<html>Cloudflare", lambda c: text.blocked_page(F.lit("t"), c)) == fv.BLOCK_CLOUDFLARE
    assert one("<html>ok", lambda c: text.blocked_page(F.lit("t"), c)) is None
    assert one('<div class="a>b" id=x>t<b c=d></b></div>', text.strip_attributes) == (
        "<div>t<b c=d></b></div>"
    )
    assert one("x" * 100, lambda c: text.ready_to_score(c, c)) is True
    assert one(" " * 50 + "x" * 99, lambda c: text.ready_to_score(c, c)) is False


def test_markup(one):
    page = "<p>A&amp;B &#39;q&#x27; &nbsp;&eacute;&bogus; <script>x<y</script><b>c</b></p><!-- z -->"
    assert one(page, text.html_to_text) == "A&B 'q' é&bogus; c"
    page = '<h2>T</h2><p>a <b>b</b> <a class=x href="u">l</a></p><ul><li>x</li><li>y</li></ul>'
    assert one(page, text.html_to_markdown) == "## T\n\na **b** [l](u)\n\n* x\n* y"


def _model_text(page: str) -> str:
    page = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style)\b.*?</\1\s*>", " ", page)
    page = re.sub(r"(?s)</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", " ", page)
    return re.sub(r"\s+", " ", html_lib.unescape(page)).strip()


def test_page_text_equals_model(source):
    rows = source.table("pages").select("html", text.html_to_text("html").alias("t")).collect()
    assert [r["t"] for r in rows] == [_model_text(r["html"]) for r in rows]


@pytest.mark.parametrize(
    "money, number",
    [
        ("1,234.50", 1234.5), ("€1.234,50", 1234.5), ("$90,000", 90000.0), ("12", 12.0),
        ("$1.5", 1.5), ("", None), ("n/a", None),
    ],
)
def test_currency_number(one, money, number):
    assert one(money, pay.currency_number) == number


@pytest.mark.parametrize(
    "phrase, annual, found",
    [
        ("Pay $90k - $140k", False, ("yearly", 90000.0, 140000.0, "USD")),
        ("Pay $90 - 140K", False, ("yearly", 90000.0, 140000.0, "USD")),
        ("$20.50 - 60", False, ("hourly", 20.0, 60.0, "USD")),
        ("$20.50 - 60", True, ("hourly", 41600.0, 124800.0, "USD")),
        ("$3,000 — $9,500", True, ("monthly", 36000.0, 114000.0, "USD")),
        ("$150,000 - $100,000", False, None),
        ("$50 - $400", False, None),
        ("$900,000 - $950,000", False, None),
        ("competitive", False, None),
        (None, False, None),
    ],
)
def test_salary_range(one, phrase, annual, found):
    got = one(phrase, lambda c: pay.salary_range(c, annual=annual))
    assert (got and tuple(got)) == found


def test_pay_texts(one):
    assert tuple(one("$120K - $160K/yr", pay.zip_salary)) == ("yearly", 120000.0, 160000.0, "USD")
    assert tuple(one("$20 - $30", pay.zip_salary)) == ("hourly", 20000.0, 30000.0, "USD")
    assert one("$20", pay.zip_salary) is None
    assert tuple(one("$90,000.00 - $120,000.00", pay.linkedin_pay)) == (
        None, 90000.0, 120000.0, "USD",
    )
    assert one("x annually", pay.unit_interval) is None
    assert one("hourly", pay.unit_interval) == "hourly"
    shown = lambda high: lambda c: pay.salary_text(c, F.lit(high), F.lit("USD"))
    assert one("120000.0", shown("150000.5")) == "USD120000–150000.5"
    assert one("120000.0", shown("")) == "USD120000+"
    assert one("0", shown("5")) == ""
    assert one("12.50", pay.amount_or_blank) == "12.5"
    assert one("many", pay.amount_or_blank) == ""


@pytest.mark.parametrize(
    "raw, rule, place",
    [
        ("Vienna, VA, United States", places.oraclecloud_location, ("USA", "Vienna", "VA")),
        ("Vienna, VA, Nowhere", places.oraclecloud_location, ("USA", "Vienna", "VA")),
        (None, places.oraclecloud_location, ("USA", None, None)),
        ("Washington, District of Columbia; Other", places.usajobs_location,
         ("USA", "Washington", "District of Columbia")),
        ("7750 Wisconsin Ave, Bethesda MD, United States", places.marriott_location,
         ("USA", "Bethesda", "MD")),
        ("Paris", places.marriott_location, ("USA", "Paris", None)),
        ("Remote - anywhere", places.marriott_location, ("USA", None, None)),
        ("Reston, VA", places.linkedin_location, ("WORLDWIDE", "Reston", "VA")),
        ("Toronto, ON, Canada", places.linkedin_location, ("CANADA", "Toronto", "ON")),
        ("Reston, VA", places.glassdoor_location, (None, "Reston", "VA")),
    ],
)
def test_locations(one, raw, rule, place):
    assert tuple(one(raw, rule)) == place


def test_display_location(one):
    shown = lambda rule: lambda c: places.display_location(rule(c))
    assert one("Vienna, VA, United States", shown(places.oraclecloud_location)) == "Vienna, VA, USA"
    assert one("Reston, VA", shown(places.linkedin_location)) == "Reston, VA"
    assert one("Prague, X, czechia", shown(places.oraclecloud_location)) == "Prague, X, Czech Republic"
    assert one("gb", places.country_code) == "UK"
    assert one("nowhere", places.country_code) is None


def test_job_types(one):
    assert one(["Full-time", "Part time", "x"], jobtypes.job_types, "array<string>") == [
        "fulltime", "parttime",
    ]
    assert one(["x"], lambda c: jobtypes.job_types(c, "other"), "array<string>") == ["other"]
    assert one("Full time contract", jobtypes.text_job_types) == ["fulltime", "contract"]
    assert one("none", jobtypes.text_job_types) is None
    assert one("vollzeit", jobtypes.job_type) == "fulltime"


def test_dates(one):
    assert one("2024-05-01T10:00:00+02:00", dates.iso_date) == dt.date(2024, 5, 1)
    assert one("20240501", dates.iso_date) == dt.date(2024, 5, 1)
    assert one("May 1", dates.iso_date) is None
    assert one(" 2024-05-01 10:00", dates.first_token_date) == dt.date(2024, 5, 1)
    assert one("abc", dates.first_token_date) is None
    assert one(3, lambda c: dates.aged_date(c, "2024-05-04"), "int") == dt.date(2024, 5, 1)
    assert one(None, lambda c: dates.aged_date(c, "2024-05-04"), "int") is None


H1, H2 = "ebb03f92c7c40101f189d9045d870000", "2900f8ebf0380101f153aa5d6ffe0000"


@pytest.mark.parametrize(
    "query, kept",
    [
        (f"locations={H1}", {"locations": [H1]}),
        (f"locations={H1}&locations={H2}", {"locations": [H1, H2]}),
        (f"source=jobboard&locations={H1}", {"locations": [H1]}),
        (f"locations={H1}&someOther={H2}", {"locations": [H1]}),
        ("", {}),
    ],
)
def test_workday_facets(one, query, kept):
    url = f"https://f.wd5.myworkdayjobs.com/en-US/External?{query}"
    assert one(url, urls.config_type) == "workday"
    assert one(url, lambda c: urls.search_params(c, F.lit("workday"))) == kept


def test_other_params(one):
    kept = lambda kind: lambda c: urls.search_params(c, F.lit(kind))
    url = "https://h/hcmUI/CandidateExperience/en/sites/n/jobs?selectedCategoriesFacet=3%3B4&mode=x&radius=25"
    assert one(url, urls.config_type) == "oraclecloud"
    assert one(url, kept("oraclecloud")) == {"selectedCategoriesFacet": ["3;4"], "radius": ["25"]}
    url = "https://a.b/careers?query=s&start=0&location=Reston%2C++VA&pid=19&filter_work=3+days%2Fweek"
    assert one(url, urls.config_type) == "eightfold"
    assert one(url, kept("eightfold")) == {
        "location": ["Reston,  VA"], "pid": ["19"], "filter_work": ["3 days/week"],
    }
    assert one("https://a.b/careers?start=0", urls.config_type) is None
    url = "https://www.usajobs.gov/search/results/?k=a%20b&l=McLean%2C+Virginia&l=Reston&ws=1&hp=public&hp=ses"
    assert one(url, urls.config_type) == "usajobs"
    assert one(url, kept("usajobs")) == {
        "l": ["McLean, Virginia", "Reston"], "ws": ["1"], "hp": ["public", "ses"],
    }
    assert one("https://www.indeed.com/jobs?q=python", urls.config_type) is None
    assert one("Freddie Mac", urls.config_key) == "freddiemac"
    assert one("Booz Allen Hamilton", urls.config_key) == "boozallenhamilton"


def test_finder_and_ids(one):
    finder = "findReqs;siteNumber=CX_1001,facetsList=LOCATIONS%3BWORK,limit=10,radius=25,sortBy=POSTING_DATES_DESC"
    assert one(finder, urls.finder_params) == {
        "siteNumber": "CX_1001", "facetsList": "LOCATIONS;WORK", "limit": "10", "radius": "25",
        "sortBy": "POSTING_DATES_DESC",
    }
    assert one("findReqs", urls.finder_params) == {}
    url = "https://x/?locationId=1&selectedLocationsFacet=2%3B1%3B3"
    assert one(url, urls.location_ids) == ["1", "2", "3"]


@pytest.mark.parametrize(
    "kind, config, url",
    [
        ("eightfold", '{"base_url":"https://a.b/","company_name":"M","pid":"1","location":["R, VA","X~*"]}',
         "https://a.b/careers?pid=1&location=R%2C+VA&location=X~%2A"),
        ("workday", '{"base_url":"https://a.b/","tenant_site":"t/s","search_params":{"locations":["a","b"]}}',
         "https://a.b/t/s/jobs?locations=a&locations=b"),
        ("workday", '{"base_url":"https://a.b/"}', "https://a.b/jobs"),
        ("oraclecloud", '{"base_url":"https://a.b/","siteNumber":"CX","sortBy":"R","radius":25,"locationId":["1","2"]}',
         "https://a.b/hcmUI/CandidateExperience/en/sites/CX/job-search?locationId=1&locationId=2&radius=25&sortBy=R"),
        ("usajobs", '{"l":["x","y"]}', "https://www.usajobs.gov/search/results/?l=x&l=y"),
        ("other", "{}", ""),
    ],
)
def test_search_url(one, kind, config, url):
    assert one(config, lambda c: urls.search_url(F.lit(kind), c)) == url


@pytest.mark.parametrize(
    "url, source, job_id, clean",
    [
        ("https://www.linkedin.com/jobs/view/4308118213/?a=b", "LinkedIn", "4308118213",
         "https://www.linkedin.com/jobs/view/4308118213"),
        ("https://www.indeed.com/?vjk=ec1c&advn=44", "Indeed", "ec1c", "https://www.indeed.com/?vjk=ec1c"),
        ("https://www.dice.com/job-detail/6ab2", "Dice", "6ab2", "https://www.dice.com/job-detail/6ab2"),
        ("https://acme.wd1.myworkdayjobs.com/en/x/job/R_R123-4?q=1", "Workday-acme", "R123",
         "/en/x/job/R_R123-4"),
    ],
)
def test_job_source(one, url, source, job_id, clean):
    assert tuple(one(url, urls.job_source)) == (source, job_id, clean)


def test_url_facts(one):
    parts = one("https://h/hcmUI/CandidateExperience/en/sites/nfcu/job/28116/?k=1", urls.oraclecloud_parts)
    assert tuple(parts) == ("https://h", "nfcu", "28116")
    assert one("https://h/sites/job", urls.oraclecloud_parts) is None
    assert one("https://acme.wd1.com/x/y", urls.workday_api_url) == (
        "https://acme.wd1.com/wday/cxs/acme/x/y"
    )
    assert one("https://x/?jk=1&vjk=2", urls.indeed_job_key) == "1"
    assert one('"https://l.com/x?url=https%3A%2F%2Fa.b%2Fc+d"', urls.redirect_target) == "https://a.b/c+d"
    assert one("https://www.workday.com/indeed", urls.download_route) == "workday"


@pytest.mark.parametrize(
    "json, fields",
    [
        ('{"score":{"final_score":0.29,"desired_job_score":0.1},'
         '"security_clearances":{"missing_security_clearances_count":1}}', (28, 1, 0.1, True)),
        ('{"schema_version":"1.0","clearance_assessment":{"status":"Active Required"},'
         '"ats_score_estimate":{"total_overall_score":77}}', (77, 1, None, False)),
        ("not json", (0, 0, None, False)),
        ("{}", (0, 0, None, False)),
    ],
)
def test_stored_fields(one, json, fields):
    assert tuple(one(json, results.stored_fields)) == fields


def test_answers(one):
    assert one('here [1,{"a":1}] x', results.answer_json) == '[1,{"a":1}]'
    assert one('x {"a":[1]} y', results.answer_json) == '{"a":[1]}'
    assert one("none", results.answer_json) is None
    assert one("ClearanceStatus.NONE_REQUIRED", results.clearance_text) == "None Required"
    assert one("ClearanceStatus.WRONG", results.clearance_text) == "ClearanceStatus.WRONG"
    assert one('{"travel_required":25.7}', results.travel) == "Travel: 25%"
    assert one('{"job_requirements":{"travel_percentage":"25%"}}', results.travel) == "Travel: 25%"
    assert one("bad", results.travel) is None
    assert one("bad", results.list_text) == []
    assert one('["a","b"]', results.list_text) == ["a", "b"]


def test_long_runs_and_tags_take_linear_time(one, spark):
    import random
    import time

    from postloom.sources import markup

    rng = random.Random(3)
    parts = ["a", "b.c", "@", ".", "-", "%", "com", "é", " ", "_x", "x@y.zz", "..", "@d.ee", "A|B"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = frame.select(
        F.regexp_extract_all("t", F.lit(fv.EMAIL_PATTERN), 0).alias("a"),
        F.regexp_extract_all("t", F.lit(text._EMAIL), 0).alias("b"),
        F.regexp_replace("t", fv.PII_EMAIL_PATTERN, fv.PII_EMAIL_TEXT).alias("c"),
        F.regexp_replace("t", text._PII_EMAIL, f"$1{fv.PII_EMAIL_TEXT}").alias("d"),
    ).collect()
    assert sum(len(r.a) for r in plain) > 500
    assert [(r.a, r.c) for r in plain] == [(r.b, r.d) for r in plain]
    one("a@b.cc", text.emails, "string")
    for run in ("a" * 200_000 + " x@y.com", "a." * 100_000 + " x@y.com"):
        start = time.perf_counter()
        assert one(run, text.emails) == ["x@y.com"]
        assert "email@example.com" in one(run, text.remove_pii)
        assert time.perf_counter() - start < 4
    start = time.perf_counter()
    assert len(markup._spans("<b>" * 20_000 + "</i>" * 20_000)) == 20_000
    assert time.perf_counter() - start < 2


def test_markdown_steps_that_are_passed_over_find_nothing(spark):
    """Searching for a tag first changes no text: the same as all steps, one after the other."""
    tags = [
        "<p>", "</P>", "<B>", "</b>", "<BR/>", "<Hr>", "<h1 x='a'>", "</H1>", '<a href="u">', "</A>", "<li>", "</LI>", "<em>", "</I>",
        "<code>", "<td>", "</TD>", "</th>", "<!-- x -->", "<SCRIPT>a<b</script>", "<!", "<", "<x:y>", "<ul>", "&lt;b&gt;", "&#10;&#10;&#10;",
    ]
    texts = [f"{a} w\n {b}x  {a}" for a in tags for b in tags] + ["plain", "", None]

    def plain(c):
        out = F.regexp_replace(F.regexp_replace(c, text._HIDDEN, ""), r"(?U)\s+", " ")
        for pattern, mark in text.markdown_steps():
            out = F.regexp_replace(out, pattern, mark)
        out = F.regexp_replace(F.regexp_replace(text.unescape(out), r"\n[ \t]+", "\n"), r"\n{3,}", "\n\n")
        return strip(out)

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(~text.html_to_markdown("t").eqNullSafe(plain(F.col("t")))).count() == 0
