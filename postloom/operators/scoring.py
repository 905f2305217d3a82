"""Choosing postings to score, building prompts, calling the caller's scorer, checking answers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import fixed_values as fv
from postloom import schemas
from postloom.functions import results
from postloom.functions.dates import day, first_token_date
from postloom.functions.expr import is_blank, let, strip
from postloom.functions.results import map_text
from postloom.functions.text import redact, remove_pii
from postloom.operators.ledger import answers, content_key
from postloom.operators.ranking import keep_first
from postloom.session import shared_folder

PostingScorer = Callable[[str], tuple[str, dict]]


def batch_candidates(postings: DataFrame) -> DataFrame:
    """Not yet scored and no clearance needed."""
    return postings.where((F.col("security_clearance_required") == 0) & (F.col("job_score") == 0))


def high_candidates(postings: DataFrame, as_of: Column | str, days: int = 7) -> DataFrame:
    """High-tier postings of the last days with no result and a description."""
    posted = F.col("date_posted")
    if dict(postings.dtypes)["date_posted"] == "string":
        posted = first_token_date("date_posted")
    out = batch_candidates(postings).where(
        (F.col("job_score_json") == "{}")
        & (F.col("title_compatibility_score") == "high")
        & (posted >= F.date_sub(day(as_of), days))
    )
    if "description" in postings.columns:
        out = out.where(strip("description") != "")
    return out


def default_profiles(profiles: DataFrame) -> DataFrame:
    """One default profile per owner."""
    return keep_first(profiles.where(F.col("is_default") == 1), ["owning_user"], F.asc("profile_name"))


def with_default_profile(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Postings with their owner's default profile as ``profile_*`` columns; null when there is none.

    At most one profile row per owner is left before the join. Owners are few and may be very
    unequal, so nothing is shuffled by owner unless the profiles outgrow the planner's size limit,
    and then a hot owner is split by adaptive execution.
    """
    mine = default_profiles(profiles).select(
        "owning_user",
        *[F.col(c).alias(f"profile_{c}") for c in profiles.columns if c != "owning_user"],
    )
    return postings.join(mine, "owning_user", "left")


def skip_reason() -> Column:
    """Why an owner's postings cannot be scored, null when they can."""
    return (
        F.when(F.col("profile_is_default").isNull(), "no default profile")
        .when(is_blank("profile_resume"), "no resume")
        .when(is_blank("profile_desired_role_description"), "no desired role")
    )


def readiness(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    return with_default_profile(candidates, profiles).withColumn("skip_reason", skip_reason())


# --- prompts ------------------------------------------------------------------------------------


def fill_template(template: Column | str, **values: Column) -> Column:
    """Replace ``{name}`` marks by column values."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def posting_prompt(ready: DataFrame, template: str) -> DataFrame:
    """Prompt per posting from the redacted description and the masked, redacted résumé."""
    yes_no = F.when(F.col("profile_us_citizen") == 1, "Yes").otherwise("No")
    prompt = fill_template(
        template,
        resume=redact(remove_pii("profile_resume")),
        us_citizen=yes_no,
        security_clearance=F.col("profile_security_clearance"),
        job_url=F.col("job_url"),
        job_id=F.col("id").cast("string"),
        job_source=F.col("site"),
        job_description=redact("description"),
    )
    return ready.withColumn("prompt", prompt).withColumn(
        "over_limit", F.length("prompt") > fv.PROMPT_MAX_CHARS
    )


def prompt_parts(prompt: Column | str) -> Column:
    """System and user message: instructions and candidate stay fixed per owner, the posting varies."""
    text = F.col(prompt) if isinstance(prompt, str) else prompt

    def halves(t: Column, marker: str) -> Column:
        at = F.instr(t, marker)
        return F.struct(
            F.substring(t, F.lit(1), at - 1).alias("head"),
            F.substring(t, at + len(marker), F.length(t)).alias("tail"),
        )

    def message(system: Column, user: Column) -> Column:
        return F.struct(system.cast("string").alias("system"), user.alias("user"))

    three = let(
        halves(text, fv.CANDIDATE_MARKER),
        lambda p: let(
            halves(p["tail"], fv.USER_MARKER),
            lambda q: message(
                F.concat(strip(p["head"]), F.lit("\n\n"), strip(q["head"])), strip(q["tail"])
            ),
        ),
    )
    two = let(halves(text, fv.USER_MARKER), lambda p: message(strip(p["head"]), strip(p["tail"])))
    has_user = text.contains(fv.USER_MARKER)
    return (
        F.when(has_user & text.contains(fv.CANDIDATE_MARKER), three)
        .when(has_user, two)
        .otherwise(message(F.lit(None), text))
    )


# --- scoring ----------------------------------------------------------------------------------------


def score_postings(prompts: DataFrame, scorer: PostingScorer, ledger: str | None = None, batch: int = 20) -> DataFrame:
    """Answers of the caller's scorer: ``(id, answer, usage)``. It may be slow, so prompts are spread.

    Equal prompts are asked once. Answers are written to the ``ledger`` (a shared folder) after every ``batch``, so a task
    that is retried asks only for what is missing there.
    """

    def ask(rows: list[dict]) -> list[str]:
        return [json.dumps([answer, usage or {}]) for answer, usage in (scorer(r["prompt"]) for r in rows)]

    folder = ledger or f"{shared_folder(prompts.sparkSession)}/ledger-{uuid.uuid4().hex}"
    keyed = prompts.select("id", "prompt", content_key("prompt").alias("key"))
    told = answers(keyed.select("key", "prompt"), ask, folder, batch)
    pair = F.from_json(F.concat(F.lit('{"x":'), "answer", F.lit("}")), "x array<string>")["x"]
    found = told.select("key", pair[0].alias("answer"), F.from_json(pair[1], "map<string,bigint>").alias("usage"))
    return keyed.select("id", "key").join(found, "key").select("id", "answer", "usage")


def check_answers(answers: DataFrame) -> DataFrame:
    """Answers with their JSON, its parsed value and the fault if there is one."""
    checked = results.validated("answer", schemas.SCORE_RESULT, schemas.REQUIRED_RESULT_FIELDS)
    return answers.withColumn("_checked", checked).select(
        *answers.columns, "_checked.json", "_checked.value", "_checked.error"
    )


def faulty(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNotNull())


def sound_results(checked: DataFrame) -> DataFrame:
    """Sound answers as results: readable enum values, the schema version, usage as text."""
    value = F.col("value")
    fixed = value.withField("schema_version", F.lit(fv.RESULT_VERSION)).withField(
        "clearance_assessment.status", results.clearance_text(value["clearance_assessment"]["status"])
    ).withField(
        "citizenship_assessment.status",
        results.citizenship_text(value["citizenship_assessment"]["status"]),
    )
    return checked.where(F.col("error").isNull()).select(
        "id", F.to_json(fixed).alias("job_score_json"), F.to_json("usage").alias("usage_metrics")
    )


# --- result rows ----------------------------------------------------------------------------------------


def audit_rows(profiles: DataFrame, sections: DataFrame) -> DataFrame:
    """Résumé audits as one row per category with its section; categories not rated are skipped."""
    rated = F.map_entries(map_text("ats_score"))
    rows = profiles.select("profile_name", "owning_user", F.explode(rated).alias("_e"))
    return (
        rows.select(
            "profile_name",
            "owning_user",
            F.col("_e.key").alias("category"),
            F.from_json("_e.value", schemas.CATEGORY_SCORE).alias("_c"),
        )
        .where(F.coalesce("_c.score", "_c.analysis").isNotNull())
        .join(sections, "category")
        .withColumn("score", F.coalesce("_c.score", F.lit(0)))
        .withColumn("analysis", F.coalesce("_c.analysis", F.lit("")))
        .withColumn("band", results.audit_band("score"))
        .drop("_c")
    )


def eligibility_rows(postings: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Display columns of the eligibility part of each result."""
    parsed = F.from_json("job_score_json", schemas.SCORE_RESULT)
    return postings.where(~results.no_result("job_score_json")).withColumn(
        "_e", let(parsed, results.eligibility)
    ).select(*keep, "_e.*")
