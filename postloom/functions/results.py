"""Rules over scored results held as JSON text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom import fixed_values as fv
from postloom import schemas
from postloom.functions.expr import col, is_blank, let, lookup, nonblank

STORED_FIELDS = (
    "struct<job_score:int,security_clearance_required:int,confirmed_score:double,"
    "score_mismatch:boolean>"
)


def list_text(c: Column | str) -> Column:
    """JSON list text as an array; blank or malformed gives an empty one."""
    return F.coalesce(F.from_json(col(c), T.ArrayType(T.StringType())), F.array().cast("array<string>"))


def map_text(c: Column | str) -> Column:
    """JSON object text as a map; blank or malformed gives an empty one."""
    return F.coalesce(
        F.from_json(col(c), T.MapType(T.StringType(), T.StringType())),
        F.create_map().cast("map<string,string>"),
    )


def stored_fields(c: Column | str) -> Column:
    """Score, clearance flag and score check of a result, from one parse of its JSON."""

    def build(r: Column) -> Column:
        current = F.coalesce(r["schema_version"] == fv.RESULT_VERSION, F.lit(False))
        legacy = r["score"]
        final = F.coalesce(legacy["final_score"], F.lit(0.0))
        confirmed = (
            F.coalesce(legacy["desired_job_score"], F.lit(0.0))
            + F.coalesce(legacy["required_skill_match_score"], F.lit(0.0))
            + F.coalesce(legacy["preferred_skill_match_score"], F.lit(0.0))
        )
        score = F.when(
            current, F.coalesce(r["ats_score_estimate"]["total_overall_score"], F.lit(0.0))
        ).otherwise(final * 100)
        counts = r["security_clearances"]
        required = F.when(
            current,
            r["clearance_assessment"]["status"] == fv.CLEARANCE_STATUSES["ACTIVE_REQUIRED"],
        ).otherwise(
            (F.coalesce(counts["matching_security_clearances_count"], F.lit(0)) > 0)
            | (F.coalesce(counts["missing_security_clearances_count"], F.lit(0)) > 0)
        )
        checked = ~current & legacy.isNotNull()
        return F.struct(
            score.cast("int").alias("job_score"),
            F.when(F.coalesce(required, F.lit(False)), 1).otherwise(0).alias(
                "security_clearance_required"
            ),
            F.when(checked, confirmed).alias("confirmed_score"),
            (checked & (confirmed != final)).alias("score_mismatch"),
        )

    return let(F.from_json(col(c), schemas.STORED_RESULT), build)


def corrected_json(c: Column | str, fields: Column) -> Column:
    """The result with its stated legacy score replaced by the sum of its parts when they differ."""
    number = fields["confirmed_score"].cast("string")
    replaced = F.regexp_replace(
        col(c),
        F.lit(r'("final_score"\s*:\s*)[-+0-9.eE]+'),
        F.concat(F.lit("$1"), number),
    )
    return F.when(fields["score_mismatch"], replaced).otherwise(col(c))


def final_score(c: Column | str) -> Column:
    return stored_fields(c)["job_score"]


def _last(text: Column, mark: str) -> Column:
    """1-based place of the last ``mark``, 0 when absent."""
    back = F.instr(F.reverse(text), mark)
    return F.when(back > 0, F.length(text) - back + 1).otherwise(0)


def answer_json(c: Column | str) -> Column:
    """The JSON part of a model answer: an object, or a list when it starts earlier; else null."""
    text = col(c)

    def cut(start: Column, end: Column) -> Column:
        return F.when(
            (start > 0) & (end >= start), F.substring(text, start, end - start + 1)
        ).otherwise(F.lit(""))

    obj_start, arr_start = F.instr(text, "{"), F.instr(text, "[")

    def choose(pair: Column) -> Column:
        use_list = (pair["arr"] != "") & ((pair["obj"] == "") | (arr_start < obj_start))
        return nonblank(F.when(use_list, pair["arr"]).otherwise(pair["obj"]))

    return let(
        F.struct(
            cut(obj_start, _last(text, "}")).alias("obj"),
            cut(arr_start, _last(text, "]")).alias("arr"),
        ),
        choose,
    )


def validated(c: Column | str, schema: T.StructType, required: list[str]) -> Column:
    """Parsed answer and its fault: ``no json``, ``malformed``, ``missing <field>`` or null."""

    def check(part: Column) -> Column:
        def judge(parsed: Column) -> Column:
            missing = F.array_compact(
                F.array(
                    *[
                        F.when(reduce(lambda x, f: x[f], path.split("."), parsed).isNull(), path)
                        for path in required
                    ]
                )
            )
            sound = F.try_parse_json(part).isNotNull()
            fault = (
                F.when(part.isNull(), "no json")
                .when(~sound, "malformed")
                .when(
                    F.size(missing) > 0,
                    F.concat(F.lit("missing "), F.array_join(missing, ", ")),
                )
            )
            return F.struct(part.alias("json"), parsed.alias("value"), fault.alias("error"))

        return let(F.from_json(part, schema), judge)

    return let(answer_json(c), check)


def enum_text(c: Column | str, name: str, values: dict[str, str]) -> Column:
    """``Name.MEMBER`` to its readable value; anything else is kept."""
    text = col(c)
    member = F.upper(F.substring_index(text, ".", -1))
    known = F.when(F.substring_index(text, ".", 1) == name, lookup(values, member))
    return F.when(text.contains("."), F.coalesce(known, text)).otherwise(text)


def clearance_text(c: Column | str) -> Column:
    return enum_text(c, "ClearanceStatus", fv.CLEARANCE_STATUSES)


def citizenship_text(c: Column | str) -> Column:
    return enum_text(c, "CitizenshipStatus", fv.CITIZENSHIP_STATUSES)


def shown_enum(c: Column | str) -> Column:
    """Last part of a dotted value in title case for display."""
    text = col(c)
    last = F.replace(F.substring_index(text, ".", -1), F.lit("_"), F.lit(" "))
    return F.when(text.contains("."), F.initcap(last)).otherwise(text)


def decision(c: Column | str) -> Column:
    return nonblank(F.get_json_object(col(c), "$.decision"))


def travel(c: Column | str) -> Column:
    """``Travel: n%`` when numeric, the raw text otherwise, null when not stated."""
    raw = F.coalesce(
        F.get_json_object(col(c), "$.travel_required"),
        F.get_json_object(col(c), "$.job_requirements.travel_percentage"),
    )
    number = raw.try_cast("double").cast("bigint").cast("string")
    return F.concat(F.lit("Travel: "), F.coalesce(F.concat(number, F.lit("%")), raw))


def score_band(c: Column | str) -> Column:
    c = col(c)
    return F.when(c >= 80, "high").when(c >= 60, "middle").when(c > 0, "low").otherwise("none")


def audit_band(c: Column | str) -> Column:
    c = col(c)
    return F.when(c >= 8, "high").when(c >= 5, "middle").otherwise("low")


def legacy_decision(score: Column | str) -> Column:
    c = col(score)
    return F.when(c < 0.5, "Fail").when(c < 0.7, "Conditional").otherwise("Pass")


def current_decision(score: Column | str, missing_clearance: Column) -> Column:
    c = col(score)
    return (
        F.when(missing_clearance, "Fail")
        .when(c >= 80, "Pass")
        .when(c >= 60, "Conditional")
        .otherwise("Fail")
    )


def weighted_score(breakdown: Column) -> Column:
    """Sum of category score times its stated weight, two decimals."""
    total = F.lit(0.0)
    for name, weight in fv.BREAKDOWN_WEIGHTS.items():
        part = breakdown[name]
        total = total + F.coalesce(part["score"], F.lit(0)) * F.coalesce(
            part["weight"], F.lit(weight)
        )
    return F.bround(total, 2)


def top_terms(c: Column, n: int = 5) -> Column:
    return F.slice(c, 1, n)


def eligibility(r: Column) -> Column:
    """Display columns of the clearance, citizenship and requirement parts of a result."""
    clearance, citizen, need = (
        r["clearance_assessment"], r["citizenship_assessment"], r["job_requirements"],
    )
    status = F.coalesce(shown_enum(clearance["status"]), F.lit("Unknown"))
    types = clearance["required_clearance_types"]
    return F.struct(
        status.alias("clearance_status"),
        F.when(status.contains("Active") | status.contains("Required"), "required")
        .when(status.contains("Obtain"), "obtain")
        .otherwise("other")
        .alias("clearance_class"),
        F.when(F.size(types) > 0, F.array_join(types, ", "))
        .otherwise("None specified")
        .alias("clearance_types"),
        F.coalesce(shown_enum(citizen["status"]), F.lit("Unknown")).alias("citizenship_status"),
        F.coalesce(citizen["meets_requirement"], F.lit(False)).alias("meets_citizenship"),
        F.coalesce(need["years_of_experience_required"], F.lit(0)).alias("years"),
        F.coalesce(need["travel_percentage"], F.lit("0%")).alias("travel"),
        F.concat(
            F.bround(
                F.coalesce(r["ats_score_estimate"]["confidence_score"], F.lit(0.0)) * 100, 0
            ).cast("int").cast("string"),
            F.lit("%"),
        ).alias("confidence"),
    )


def no_result(c: Column | str) -> Column:
    return is_blank(c) | (col(c) == "{}")
