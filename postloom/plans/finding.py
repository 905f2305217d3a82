"""Queries that find rows without going through all of them: indexes, pages, automata."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators import paging, ranking, trigrams
from postloom.operators import titles as ti
from postloom.plans.registry import Source, query
from postloom.session import shared_folder

#: Keywords of one letter, two, three and more, with wildcards and upper case.
KEYWORDS = ["", "e", "ng", "dat", "Engineer", "SECURITY ARCH", "da%ana", "eng_neer", "%", "zzz", "ürse", "Customer#00000001"]


@query(
    "search_by_trigrams",
    " UNION ALL ".join(
        f"SELECT '{k}' AS keyword, id FROM <<job_details>> WHERE title ILIKE '%{k}%' OR company ILIKE '%{k}%'" for k in KEYWORDS
    ),
)
def search_by_trigrams(s: Source) -> DataFrame:
    jobs = s.view("job_details").select("id", "title", "company")
    path = f"{shared_folder(s.spark)}/trigrams-{uuid.uuid4().hex}"
    trigrams.write_index(jobs, path)
    found = [trigrams.search(jobs, path, k).select(F.lit(k).alias("keyword"), "id") for k in KEYWORDS]
    return reduce(DataFrame.unionAll, found)


_APPLIED_KEYS = [paging.Key("applied_at", descending=True, nulls_last=True), paging.Key("title"), paging.Key("id")]
_APPLIED_ORDER = "applied_at DESC NULLS LAST, title ASC NULLS FIRST, id"
PAGES = 6


@query(
    "keyset_pages",
    f"""SELECT id, CAST(floor((row_number() OVER (ORDER BY {_APPLIED_ORDER}) - 1) / size) AS INTEGER) AS page
    FROM <<job_details>>, (SELECT CAST(ceil(count(*) / {PAGES}.0) AS BIGINT) AS size FROM <<job_details>>) n""",
)
def keyset_pages(s: Source) -> DataFrame:
    """Page after page, each from the last row of the one before; most rows tie on a null date."""
    jobs = s.view("job_details").select("id", "title", "applied_at")
    size = -(-jobs.count() // PAGES)
    pages, last = [], None
    for number in range(PAGES):
        page = paging.page_after(jobs, _APPLIED_KEYS, last, size)
        tail = page.orderBy(F.asc_nulls_first("applied_at"), F.desc_nulls_last("title"), F.desc("id")).first()
        last = tail.asDict() if tail else last
        pages.append(page.select("id", F.lit(number).alias("page")))
    return reduce(DataFrame.unionAll, pages)


@query(
    "ranged_pages",
    f"""SELECT id, title, CAST(rn - 1 AS BIGINT) AS place FROM (SELECT *, row_number() OVER (ORDER BY {_APPLIED_ORDER}) AS rn FROM <<job_details>>) j,
    (SELECT count(*) AS n FROM <<job_details>>) c
    WHERE rn <= 100 OR rn > 100 * floor(n / 200) AND rn <= 100 * floor(n / 200) + 100 OR rn > 100 * floor((n - 1) / 100)""",
)
def ranged_pages(s: Source) -> DataFrame:
    """The first page, one in the middle and the last."""
    jobs = s.view("job_details").select("id", "title", "applied_at")
    listed = paging.Ranged(jobs, _APPLIED_KEYS)
    n = sum(count for _, count in listed.counts)
    numbers = sorted({1, n // 200 + 1, (n - 1) // 100 + 1})
    shown = []
    for number in numbers:
        page = listed.page(number, 100)
        # a page is small by its size
        placed = ranking.numbered(page, [k.order() for k in _APPLIED_KEYS])
        shown.append(placed.select("id", "title", (F.col("place") + 100 * (number - 1)).alias("place")))
    return reduce(DataFrame.unionAll, shown)


# a third of all results belong to one search
_RESULTS = """SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey % 40 END AS search_id, l_orderkey * 10 + l_linenumber AS result_id,
  CAST(max(l_extendedprice) AS DOUBLE) AS relevance FROM <<lineitem>> GROUP BY l_orderkey, l_linenumber"""


@query(
    "board_slice_deep",
    f"""SELECT search_id, result_id FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY relevance DESC, result_id) AS rn
    FROM ({_RESULTS}) r) x WHERE rn > 700 AND rn <= 750""",
)
def board_slice_deep(s: Source) -> DataFrame:
    order = [F.desc("relevance"), F.asc("result_id")]
    return ranking.deep_slice(s.sql(_RESULTS), ["search_id"], order, 50, 700).select("search_id", "result_id")


# words of part names, some hundreds for each owner, and some that titles hold
_WORDS = """SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN 'FURNITURE' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'BUILDING' WHEN 3 THEN 'AUTOMOBILE' ELSE 'HOUSEHOLD' END AS owning_user,
  CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_type ELSE p_brand || ' ' || CAST(p_partkey AS STRING) END AS word FROM <<part>>
UNION ALL SELECT 'FURNITURE', 'NURSE' UNION ALL SELECT 'FURNITURE', '' UNION ALL SELECT 'BUILDING', 'engineer' UNION ALL SELECT 'BUILDING', 'data' UNION ALL SELECT 'MACHINERY', 'f'"""


@query(
    "reject_by_owner_words",
    f"""SELECT id, owning_user, title, EXISTS (SELECT 1 FROM ({_WORDS}) w WHERE w.owning_user = j.owning_user AND w.word <> '' AND contains(lower(j.title), lower(w.word))) AS rejected
    FROM <<job_details>> j""",
)
def reject_by_owner_words(s: Source) -> DataFrame:
    jobs = s.view("job_details").select("id", "owning_user", "title")
    return ti.rejected_by_owner(jobs, s.sql(_WORDS))
