"""Landed pages to postings and descriptions.

A page table has ``url`` and ``html`` (and ``payload_id`` for list pages). ``with_elements`` adds the
element spans once; everything after that is Columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom import fixed_values as fv
from postloom.functions import dates, jobtypes, pay, places, text, urls
from postloom.functions.expr import let, nonblank, strip
from postloom.operators.postings import ARRIVAL, SEARCH, as_posts, searched
from postloom.operators.ranking import keep_first
from postloom.sources import markup as m



def with_elements(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_els", m.elements("html"))


def unblocked(pages: DataFrame) -> DataFrame:
    """Pages that are not a challenge, denial or captcha."""
    return pages.where(text.blocked_page(text.page_title("html"), "html").isNull())


def _absolute(base: str, href: Column) -> Column:
    return (
        F.when(href.startswith("http"), href)
        .when(href.startswith("/"), F.concat(F.lit(base), href))
        .when(href != "", F.concat(F.lit(base + "/"), href))
        .otherwise(F.lit(""))
    )


# --- descriptions ----------------------------------------------------------------------------------

_LD_SCRIPT = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script"
_BARE_SCRIPT = r"(?s)<script[^>]*>\s*(\{[^<]*\"jobLocation\"[^<]*)\s*</script>"


def structured_data(html: Column) -> Column:
    """Text of the page's JSON-LD script, cut to its object; null when it is not JSON."""
    raw = F.regexp_extract(html, _LD_SCRIPT, 1)

    def sound(t: Column) -> Column:
        return F.when(F.try_parse_json(t).isNotNull(), t)

    cut = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(raw != "", F.coalesce(sound(strip(raw)), sound(nonblank(cut))))


def structured_description(c: Column | str) -> Column:
    """Description from JSON-LD, else from an untyped script that holds a job location."""
    html = F.col(c) if isinstance(c, str) else c

    def found(json: Column) -> Column:
        return nonblank(F.get_json_object(json, "$.description"))

    return F.coalesce(
        found(structured_data(html)), found(nonblank(F.regexp_extract(html, _BARE_SCRIPT, 1)))
    )


def _block(els: Column, rules: list[tuple[str, str, str, str]]) -> Column:
    return F.coalesce(
        *[m.first(els, m.is_tag(tag), m.has(name, how, value)) for tag, name, how, value in rules]
    )


def described(pages: DataFrame) -> DataFrame:
    """Description of each page as markdown: first known block, else the whole page; '' if empty."""
    html = F.col("html")
    block = _block(F.col("_els"), fv.DESCRIPTION_BLOCKS)
    staged = with_elements(pages).withColumn("_block", block)
    picked = F.when(F.col("_block").isNotNull(), m.outer_html(html, F.col("_block"))).otherwise(html)
    return staged.withColumn(
        "description",
        F.when(text.html_to_text(html) == "", F.lit("")).otherwise(text.html_to_markdown(picked)),
    ).drop("_block", "_els")


def greenhouse_description(pages: DataFrame) -> DataFrame:
    """Every block whose class starts with the description mark, joined."""
    html = F.col("html")
    blocks = m.select(F.col("_els"), m.is_tag("div"), m.has("class", "starts", "job__description"))
    return (
        with_elements(pages)
        .withColumn(
            "description", F.array_join(F.transform(blocks, lambda e: m.outer_html(html, e)), "")
        )
        .drop("_els")
    )


def routed_description(pages: DataFrame) -> DataFrame:
    """Raw description of each page by the board its url belongs to."""
    html = F.col("html")
    els = F.col("_els")
    linkedin = m.first(els, m.is_tag("div"), m.has("class", "word", "description__text--rich"))
    green = m.select(els, m.is_tag("div"), m.has("class", "starts", "job__description"))
    route = F.col("route")
    return (
        with_elements(pages)
        .withColumn("route", urls.download_route("url"))
        .withColumn(
            "description",
            F.when(
                route == "linkedin",
                F.coalesce(let(linkedin, lambda e: m.inner_html(html, e)), html),
            )
            .when(
                route == "greenhouse",
                F.array_join(F.transform(green, lambda e: m.outer_html(html, e)), ""),
            )
            .when(
                route.isin("workday", "indeed", "dice", "oraclecloud"),
                F.coalesce(structured_description(html), F.lit("")),
            )
            .otherwise(html),
        )
        .drop("_els")
    )


# --- card lists ----------------------------------------------------------------------------------------


def _cards(pages: DataFrame, options: list[m.Selector], picks: list[m.Pick]) -> DataFrame:
    """One row per card with its place in the page and what is picked of it; neither page nor elements go along."""
    found = pages.select(
        "payload_id", *[c for c in SEARCH if c in pages.columns], m.cards("html", options, picks).alias("_found")
    )
    there = [c for c in found.columns if c != "_found"]
    return found.select(*there, F.posexplode("_found").alias("_pos", "_card")).select(*there, "_pos", "_card.*")


def _search(df: DataFrame) -> list[str]:
    return [c for c in SEARCH if c in df.columns]


def _distinct(cards: DataFrame, *keys: str) -> DataFrame:
    """The first card of each key in a search."""
    return keep_first(cards, [*_search(cards), *keys], *[F.asc(c) for c in ARRIVAL])


def _one(details: DataFrame, key: str) -> DataFrame:
    """One row of extracted details for each key: that of the page that landed first, where it says so."""
    rest = [c for c in details.columns if c not in (key, "_landed")]
    return keep_first(details, [key], *[F.asc(c) for c in ("_landed", *rest)]).drop("_landed")


def _landed(pages: DataFrame) -> Column:
    there = "payload_id" in pages.columns
    return (F.col("payload_id") if there else F.lit(0)).cast("long").alias("_landed")


# fixed values: tags, classes and attributes of the boards' cards

_LINKEDIN_COMPANY = (("h4", "class", "word", "base-search-card__subtitle"), ("a", None, "", ""))
_LINKEDIN_META = ("div", "class", "word", "base-search-card__metadata")
_LINKEDIN_CARD = [
    m.Pick({"href": "@href"}, ((("a", "class", "word", "base-card__full-link"),),)),
    m.Pick({"title": "inner"}, ((("span", "class", "word", "sr-only"),),)),
    m.Pick({"company": "inner", "company_href": "@href"}, (_LINKEDIN_COMPANY,)),
    m.Pick({"place": "inner"}, ((_LINKEDIN_META, ("span", "class", "word", "job-search-card__location")),)),
    m.Pick({"day": "@datetime"}, ((_LINKEDIN_META, ("time", "class", "word", "job-search-card__listdate")),)),
    m.Pick({"salary": "inner"}, ((("span", "class", "word", "job-search-card__salary-info"),),)),
]


def linkedin_cards(pages: DataFrame) -> DataFrame:
    """Cards of search pages; the id is the last dash part of the link."""
    cards = _cards(pages, [("div", "class", "word", "base-search-card")], _LINKEDIN_CARD)
    href = F.split_part("href", F.lit("?"), F.lit(1))
    staged = cards.withColumn("job_id", F.element_at(F.split(href, "-"), -1)).where(F.col("job_id").isNotNull())
    rows = staged.select(
        *_search(staged),
        *ARRIVAL,
        "job_id",
        F.coalesce(text.html_to_text("title"), F.lit("N/A")).alias("title"),
        F.coalesce(text.html_to_text("company"), F.lit("N/A")).alias("company_name"),
        F.coalesce(urls.drop_query("company_href"), F.lit("")).alias("company_url"),
        text.html_to_text("place").alias("location_text"),
        dates.plain_date("day").alias("date_posted"),
        text.html_to_text("salary").alias("salary_text"),
    )
    return _distinct(rows, "job_id")


def _headed(word: str) -> m.Test:
    return lambda x: x["head"].contains(word)


def linkedin_details(pages: DataFrame) -> DataFrame:
    """Detail pages (``job_id, html``): description, criteria list, logo, direct link."""
    html, els = F.col("html"), F.col("_els")
    staged = with_elements(pages)
    block = m.first(els, m.is_tag("div"), m.has("class", "contains", "show-more-less-html__markup"))
    value = m.has("class", "word", "description__job-criteria-text")

    heads = F.transform(
        m.select(els, m.is_tag("h3")),
        lambda h: F.struct(
            m.text_of(html, h).alias("head"),
            m.inner_html(html, m.first(m.after(els, h), m.is_tag("span"), value)).alias("value"),
        ),
    )
    wanted = ["Employment type", "Seniority level", "Industries", "Job function"]

    def values(listed: Column) -> Column:
        raw = [F.get(F.filter(listed, _headed(w)), F.lit(0))["value"] for w in wanted]
        return F.transform(F.array(*raw), lambda t: text.html_to_text(t))

    staged = staged.withColumn("_criteria", let(heads, values))

    def criterion(heading: str) -> Column:
        return F.get("_criteria", F.lit(wanted.index(heading)))

    apply_code = m.first(els, m.is_tag("code"), m.has("id", "equals", "applyUrl"))
    kind = F.replace(F.lower(criterion("Employment type")), F.lit("-"), F.lit(""))
    return staged.select(
        _landed(pages),
        "job_id",
        F.coalesce(
            text.html_to_markdown(let(block, lambda e: m.outer_html(html, e))), F.lit("")
        ).alias("description"),
        F.array_compact(F.array(jobtypes.job_type(kind))).alias("job_type"),
        F.lower(F.coalesce(criterion("Seniority level"), F.lit(""))).alias("job_level"),
        criterion("Industries").alias("company_industry"),
        criterion("Job function").alias("job_function"),
        m.first_attr(
            els, "data-delayed-url", m.is_tag("img"), m.has("class", "word", "artdeco-entity-image")
        ).alias("company_logo"),
        urls.redirect_target(let(apply_code, lambda e: m.inner_html(html, e))).alias(
            "job_url_direct"
        ),
    )


def linkedin(cards: DataFrame, details: DataFrame, base_url: str = fv.LINKEDIN_BASE) -> DataFrame:
    """Search pages joined to detail pages; a card without details has no description."""
    joined = (
        linkedin_cards(cards)
        .join(_one(linkedin_details(details), "job_id"), "job_id", "left")
        .withColumn("location", places.linkedin_location("location_text"))
        .withColumn("description", F.coalesce("description", F.lit("")))
    )
    return as_posts(
        joined.select(
            F.concat(F.lit("li-"), F.col("job_id")).alias("id"),
            "title", "company_name", "company_url", "location", "date_posted", "description",
            "job_type", "company_industry", "job_function", "company_logo", "job_url_direct",
            F.coalesce("job_level", F.lit("")).alias("job_level"),
            F.concat(F.lit(f"{base_url}/jobs/view/"), F.col("job_id")).alias("job_url"),
            pay.linkedin_pay("salary_text").alias("compensation"),
            text.remote_flag(
                "title", "description", places.display_location(F.col("location"))
            ).alias("is_remote"),
            text.emails("description").alias("emails"),
            *searched(joined),
        )
    )


# fixed values: tags, classes and attributes of the boards' cards


def _marked(name: str, tag: str | None = None) -> tuple[m.Selector, ...]:
    return ((tag, "data-testid", "equals", name),)


_ZIP_OPTIONS = [
    ("article", "id", "starts", "job-card-"),
    ("article", "data-job-id", "present", ""),
    (None, "class", "word", "job_result_two_pane_v2"),
    (None, "class", "word", "job_result"),
]
_ZIP_LINKS = (
    _marked("job-title", "a"),
    (("h2", None, "", ""), ("a", None, "", "")),
    ((None, "class", "word", "job_link"), ("a", None, "", "")),
    (("a", "class", "word", "title"),),
)
_ZIP_COMPANY = (_marked("job-card-company", "a"), _marked("job-card-company"), (("a", "href", "contains", "/co/"),))
_ZIP_CARD = [
    m.Pick({"own_id": "@id", "own_job_id": "@data-job-id"}),
    m.Pick({"link": "inner", "href": "@href"}, _ZIP_LINKS, earliest=True),
    m.Pick({"heading": "inner"}, ((("h2", None, "", ""),),)),
    m.Pick({"company": "inner"}, _ZIP_COMPANY),
    m.Pick({"place": "inner"}, (_marked("job-card-location", "a"), _marked("job-card-location"))),
    m.Pick({"paragraphs": "inner"}, ((("p", None, "", ""),),), every=True),
]


def zip_cards(pages: DataFrame) -> DataFrame:
    """Cards of list pages: the first selector that finds any is used for the page.

    A card repeats one of its page that has the same id; cards without an id repeat nothing.
    """
    staged = _cards(pages, _ZIP_OPTIONS, _ZIP_CARD).withColumn("card_id", F.coalesce("own_id", "own_job_id", F.lit("")))
    money = F.filter(F.transform("paragraphs", lambda t: text.html_to_text(t)), lambda t: t.startswith("$"))
    rows = staged.select(
        *_search(staged),
        *ARRIVAL,
        "card_id",
        F.when(F.col("card_id").startswith("job-card-"), F.replace("card_id", F.lit("job-card-"), F.lit("")))
        .otherwise(F.lit(""))
        .alias("job_id"),
        F.coalesce(text.html_to_text("link"), text.html_to_text("heading"), F.lit("")).alias("title"),
        _absolute(fv.ZIP_BASE, F.coalesce("href", F.lit(""))).alias("job_url"),
        F.coalesce(text.html_to_text("company"), F.lit("")).alias("company_name"),
        F.coalesce(text.html_to_text("place"), F.lit("")).alias("location_text"),
        F.coalesce(F.get(money, F.lit(0)), F.lit("")).alias("salary_text"),
    ).withColumn("_own", F.when(F.col("card_id") == "", F.col("_pos")).otherwise(-1))
    first = _distinct(rows, "payload_id", "card_id", "_own")
    return first.drop("card_id", "_own").where(F.col("title") != "")


def zip_panes(pages: DataFrame) -> DataFrame:
    """Right panes (``job_id, html``): description and direct link."""
    html, els = F.col("html"), F.col("_els")
    links = F.filter(
        els,
        lambda e: m.is_tag("a")(e)
        & (
            m.has("href", "contains", "/c/")(e)
            | m.has("href", "contains", "/jobs/")(e)
            | m.has("data-testid", "equals", "job-url")(e)
        )
        & F.coalesce(m.attr(e, "href") != "", F.lit(False)),
    )
    head = F.get(
        F.filter(
            els,
            lambda e: m.is_tag("h2")(e) & F.lower(m.text_of(html, e)).contains("job description"),
        ),
        F.lit(0),
    )
    block = F.coalesce(
        let(head, lambda h: F.when(h.isNotNull(), m.first(m.after(els, h), m.is_tag("div")))),
        m.first(els, m.is_tag("div"), m.has("class", "contains", "whitespace-pre-line")),
    )
    return with_elements(pages).select(
        _landed(pages),
        "job_id",
        F.coalesce(
            text.html_to_markdown(let(block, lambda e: m.outer_html(html, e))), F.lit("")
        ).alias("description"),
        _absolute(fv.ZIP_BASE, F.coalesce(m.attr(F.get(links, F.lit(0)), "href"), F.lit(""))).alias(
            "direct_url"
        ),
    )


def zip_recruiter(cards: DataFrame, panes: DataFrame) -> DataFrame:
    joined = zip_cards(cards).join(_one(zip_panes(panes), "job_id"), "job_id", "left")
    return as_posts(
        joined.select(
            F.col("job_id").alias("id"),
            "title",
            "company_name",
            F.coalesce(nonblank("direct_url"), F.col("job_url")).alias("job_url"),
            places.location(F.lit("USA"), F.col("location_text"), F.lit(None)).alias("location"),
            F.coalesce("description", F.lit("")).alias("description"),
            pay.zip_salary("salary_text").alias("compensation"),
            *searched(joined),
        ).where(F.col("job_url") != "")
    )


# --- marriott ------------------------------------------------------------------------------------------

# fixed values: outer tag and class, tag and class of the blocks that may hold the description

_MARRIOTT_BLOCKS = [
    ("section", "job-description", "div", "description"),
    ("div", "job-description-grid", "div", "description"),
    (None, None, "div", "description"),
    (None, None, "section", "job-description"),
    (None, None, "div", "job-content"),
]


# fixed values: tags, classes and attributes of the boards' cards

_MARRIOTT_LINK = (
    ("h3", "class", "word", "results-list__item-title"),
    ("a", "class", "word", "results-list__item-title--link"),
)
_MARRIOTT_CARD = [
    m.Pick({"title": "inner", "href": "@href"}, (_MARRIOTT_LINK,)),
    m.Pick({"reference": "inner"}, (((None, "class", "word", "reference"),),)),
    m.Pick({"owner": "inner"}, (((None, "class", "word", "results-list__item-ownership--label"),),)),
    m.Pick({"street": "inner"}, (((None, "class", "word", "results-list__item-street--label"),),)),
]


def marriott_cards(pages: DataFrame, base_url: str = fv.MARRIOTT_BASE) -> DataFrame:
    """List items with a title link."""
    cards = _cards(pages, [("li", "class", "word", "results-list__item")], _MARRIOTT_CARD)
    staged = cards.where(F.col("title").isNotNull())
    return staged.select(
        *_search(staged),
        *ARRIVAL,
        F.coalesce(
            nonblank(text.html_to_text("reference")), F.get(F.split("href", "/job/"), F.lit(1))
        ).alias("job_id"),
        text.html_to_text("title").alias("title"),
        _absolute(base_url, F.col("href")).alias("job_url"),
        F.coalesce(text.html_to_text("owner"), F.lit("Marriott")).alias("company_name"),
        text.html_to_text("street").alias("location_text"),
    )


def marriott_details(pages: DataFrame) -> DataFrame:
    """Detail pages (``job_url, html``): structured data first, then the page's own elements."""
    html, els, ld = F.col("html"), F.col("_els"), F.col("_ld")

    def data(path: str) -> Column:
        return nonblank(F.get_json_object(ld, path))

    blocks = []
    for outer_tag, outer_class, tag, name in _MARRIOTT_BLOCKS:
        scope = els
        if outer_tag:
            scope = m.within(els, m.first(els, m.is_tag(outer_tag), m.has("class", "word", outer_class)))
        blocks.append(m.first(scope, m.is_tag(tag), m.has("class", "word", name)))
    page_text = F.coalesce(*[let(b, lambda e: nonblank(m.text_of(html, e))) for b in blocks])
    day = F.coalesce(
        m.first_attr(els, "datetime", m.is_tag("time")),
        m.first_attr(els, "content", m.is_tag("meta"), m.has("itemprop", "equals", "datePosted")),
        m.first_attr(els, "content", m.is_tag("meta"), m.has("name", "equals", "date")),
    )
    shown_range = m.first_attr(
        els, "data-pay-range", m.is_tag("div"), m.has("class", "word", "summary-list-item"),
        m.has("data-pay-range", "present"),
    )
    staged = (
        with_elements(pages)
        .withColumn("_ld", structured_data(html))
        .withColumn("_ld_text", text.html_to_markdown(data("$.description")))
        .withColumn("_page_text", F.when(F.col("_ld_text").isNull(), page_text))
        .withColumn("_shown", pay.pay_range_text(shown_range))
        .withColumn("_stated", pay.pay_range_text(data("$.baseSalary")))
    )
    words = F.lower("_page_text")
    page_types = F.array_compact(
        F.array(
            F.when(words.contains("full time") | words.contains("full-time"), "fulltime"),
            F.when(words.contains("part time") | words.contains("part-time"), "parttime"),
            F.when(words.contains("contract"), "contract"),
        )
    )
    stated_types = F.coalesce(
        F.from_json(data("$.employmentType"), T.ArrayType(T.StringType())),
        F.array(F.coalesce(data("$.employmentType"), data("$.employment_type"))),
    )
    ld_types = jobtypes.schema_org_job_types(stated_types)

    def money(path: str) -> Column:
        return F.regexp_replace(data(path), "[$,]", "").try_cast("double")

    # a plain value stands for both ends; a range text is read from the salary itself
    single = money("$.baseSalary.value")
    low = F.coalesce(
        money("$.baseSalary.value.minValue"), money("$.baseSalary.value.value"), single,
        F.col("_stated.low"),
    )
    high = F.coalesce(money("$.baseSalary.value.maxValue"), single, F.col("_stated.high"))
    shown = F.col("_shown")
    unit = F.coalesce(
        data("$.baseSalary.value.unitText"), data("$.baseSalary.value.unit"), F.col("_stated.unit")
    )
    staged = staged.select("*", low.alias("_low"), high.alias("_high"), unit.alias("_unit"))
    use_shown = shown["low"].isNotNull() & (
        F.coalesce(F.col("_high") == 0, F.lit(False))
        | (F.col("_low").isNull() & F.col("_high").isNull())
    )
    amounts = [
        F.when(use_shown, shown[name]).otherwise(F.col(f"_{name}")) for name in ("low", "high", "unit")
    ]
    currency = F.coalesce(data("$.baseSalary.currency"), data("$.baseSalary.currencyCode"), F.lit("USD"))
    return staged.select(
        _landed(pages),
        "job_url",
        F.coalesce("_ld_text", "_page_text").alias("description"),
        F.coalesce(dates.iso_date(data("$.datePosted")), dates.iso_date(day)).alias("date_posted"),
        F.when(F.size(ld_types) > 0, ld_types)
        .when(F.size(page_types) > 0, page_types)
        .otherwise(F.array().cast("array<string>"))
        .alias("job_type"),
        F.when(F.size(text.emails("_page_text")) > 0, F.array_distinct(text.emails("_page_text"))).alias(
            "emails"
        ),
        F.when(
            F.lower(data("$.jobLocationType")).contains("telecommute")
            | words.contains("remote")
            | words.contains("telecommute"),
            F.lit(True),
        ).alias("is_remote"),
        F.when(
            amounts[0].isNotNull() | amounts[1].isNotNull(),
            pay.compensation(pay.unit_interval(amounts[2]), amounts[0], amounts[1], currency),
        ).alias("compensation"),
    )


def marriott(cards: DataFrame, details: DataFrame) -> DataFrame:
    joined = marriott_cards(cards).join(_one(marriott_details(details), "job_url"), "job_url", "left")
    return as_posts(
        joined.select(
            F.col("job_id").alias("id"),
            "title", "job_url", "company_name", "date_posted", "description", "emails",
            "is_remote", "job_type", "compensation",
            F.when(
                F.col("location_text").isNotNull(), places.marriott_location("location_text")
            ).alias("location"),
            *searched(joined),
        )
    )


# --- page facts --------------------------------------------------------------------------------------


def page_facts(pages: DataFrame) -> DataFrame:
    """Heading, links and visible text of each page."""
    html, els = F.col("html"), F.col("_els")
    return with_elements(pages).select(
        *[c for c in pages.columns if c != "html"],
        m.first_text(html, els, m.is_tag("h1")).alias("heading"),
        F.size(m.select(els, m.is_tag("a"), m.has("href", "present"))).alias("links"),
        F.size(els).alias("elements"),
        let(
            m.first(els, m.is_tag("article")),
            lambda e: F.when(e.isNotNull(), m.text_of(html, e)),
        ).alias("article"),
    )


PAGE_BOARDS = {"linkedin": linkedin, "zip_recruiter": zip_recruiter, "marriott": marriott}
