"""Table changes as new snapshots: upsert, keyed update, delete, and the jobs built on them.

Parquet has no row updates, so each function returns the table as it is after the change. The
caller writes it to a new version path and never over the one being read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import fixed_values as fv
from postloom.functions import pay
from postloom.functions.dates import date_or_today, day
from postloom.functions.expr import is_blank
from postloom.functions.results import stored_fields
from postloom.functions.text import clearance_flag
from postloom.operators.ingest import next_ids
from postloom.operators.keys import absent
from postloom.operators.ranking import keep_first
from postloom.session import cut_lineage

Rule = Callable[[Column, Column], Column]


def take_new(old: Column, new: Column) -> Column:
    return new


def keep_old(old: Column, new: Column) -> Column:
    return old


def new_if_given(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def new_if_old_blank(old: Column, new: Column) -> Column:
    return F.when(is_blank(old), new).otherwise(old)


def latest(changes: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The change that counts for every key; ``order`` puts it first."""
    return keep_first(changes, keys, *order)


def apply_changes(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column] | None,
    rules: Mapping[str, Rule] | None = None,
    default: Rule = take_new,
    insert: bool = True,
) -> DataFrame:
    """The target after the changes; of several changes for a key the first in ``order`` counts.

    Without an order the changes must have one row per key by the way they are made.

    Matched rows follow the rule of each column the changes carry; other columns stay. Unmatched
    changes are added when ``insert`` is set and dropped otherwise. This is a left join and a union
    rather than a full join, so that a small set of changes leaves the target where it is: a full join
    always shuffles both sides.
    """
    rules = dict(rules or {})
    changes = latest(changes, keys, *order) if order else changes
    changed = [c for c in changes.columns if c not in keys and c in target.columns]
    new = changes.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_change")
    )
    joined = target.join(new, list(keys), "left")

    def value(name: str) -> Column:
        kind = target.schema[name].dataType
        if name in keys or name not in changed:
            return F.col(name)
        before, after = F.col(name), F.col(f"_new_{name}").cast(kind)
        merged = rules.get(name, default)(before, after)
        return (
            F.when(F.col("_change").isNull(), before)
            .otherwise(merged)
            .cast(kind)
            .alias(name)
        )

    updated = joined.select(*[value(c) for c in target.columns])
    if not insert:
        return updated
    added = absent(changes, target, keys).select(
        *[
            (F.col(c) if c in changes.columns else F.lit(None)).cast(target.schema[c].dataType).alias(c)
            for c in target.columns
        ]
    )
    return updated.unionByName(added)


def update(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column] | None, **rules: Rule
) -> DataFrame:
    """Keyed column update; a null in the changes leaves the column alone."""
    return apply_changes(target, changes, keys, order, rules, default=new_if_given, insert=False)


def delete(target: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def insert_or_ignore(
    target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Add rows whose key is free; of several for one key the first in ``order``."""
    added = latest(rows, keys, *order).select(*[c for c in rows.columns if c in target.columns])
    return target.unionByName(absent(added, target, keys), allowMissingColumns=True)


# --- users, profiles, configurations, cache ------------------------------------------------------


def upsert_users(users: DataFrame, changes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Refresh name and picture; keep an email that is already there."""
    return apply_changes(
        users, changes, ["username"], order,
        {"email": new_if_old_blank, "auth_provider": keep_old, "date_created": keep_old},
    )


PROFILE = ["owning_user", "profile_name"]


def _dated(changes: DataFrame, table: DataFrame, as_of: Column | str | None) -> DataFrame:
    """The changes with the day they are made on, where the table has a column for it."""
    there = as_of is not None and "date_updated" in table.columns
    return changes.withColumn("date_updated", day(as_of).cast(table.schema["date_updated"].dataType)) if there else changes


def upsert_profiles(
    profiles: DataFrame, changes: DataFrame, order: Sequence[Column], as_of: Column | str | None = None
) -> DataFrame:
    """Changed and new profiles; ``date_updated`` is set where the table has it and ``as_of`` is given."""
    return apply_changes(profiles, _dated(changes, profiles, as_of), PROFILE, order)


def accepted_renames(profiles: DataFrame, forms: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``owning_user``, ``profile_name`` and ``new_name`` of the renames that can be done.

    Of several forms for a profile the first in ``order`` counts. A new name must be free once all renames of the batch
    are done: not that of a profile which stays, and of several that want one the first by its old name gets it.
    """
    asked = latest(forms.where(~is_blank("new_name")), PROFILE, *order).select(*PROFILE, "new_name")
    known = asked.join(profiles.select(*PROFILE), PROFILE, "left_semi").where(F.col("new_name") != F.col("profile_name"))
    done = cut_lineage(keep_first(known, ["owning_user", "new_name"], F.asc("profile_name")).select(*PROFILE, "new_name"), "renames")
    left = done.count()
    # a profile whose rename is refused keeps a name that another may have asked for, so this goes on to the chain's end
    while True:
        staying = profiles.select(*PROFILE).join(done, PROFILE, "left_anti")
        taken = staying.select("owning_user", F.col("profile_name").alias("new_name"))
        done = cut_lineage(done.join(taken, ["owning_user", "new_name"], "left_anti").select(*PROFILE, "new_name"), "renames")
        before, left = left, done.count()
        if left == before:
            return done


def edit_profiles(
    profiles: DataFrame, forms: DataFrame, order: Sequence[Column], as_of: Column | str
) -> tuple[DataFrame, DataFrame]:
    """Profiles after edit forms, and the renames among them (``accepted_renames``).

    A form names its profile and states every field it has, ``new_name`` among them. Where a new name is not free the
    profile keeps its own and the other fields are taken. A profile that gave its name away to another is no clash.
    """
    edited = apply_changes(
        profiles, _dated(forms.drop("new_name"), profiles, as_of), PROFILE, order, default=take_new, insert=False
    )
    renames = accepted_renames(profiles, forms, order)
    return renamed(edited, renames), renames


def renamed(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """Rows of any table that name a profile, with its new name."""
    name = F.coalesce("new_name", "profile_name").alias("profile_name")
    joined = rows.join(renames, PROFILE, "left")
    return joined.select(*[name if c == "profile_name" else F.col(c) for c in rows.columns])


def upsert_configs(
    configs: DataFrame, changes: DataFrame, order: Sequence[Column], as_of: Column | str | None = None
) -> DataFrame:
    """Changed and new configurations; ``date_updated`` is set where the table has it and ``as_of`` is given."""
    return apply_changes(configs, _dated(changes, configs, as_of), ["config_key", "owning_user"], order)


def upsert_cache(cache: DataFrame, rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    return apply_changes(cache, rows, ["owning_user", "role_normalized", "title_normalized"], order)


def missing_users(profiles: DataFrame, configs: DataFrame, users: DataFrame) -> DataFrame:
    """Owners seen in profiles or configurations that have no user row yet."""
    owners = (
        profiles.select("owning_user")
        .union(configs.select("owning_user"))
        .where(F.col("owning_user") != "")
        .distinct()
        .select(F.col("owning_user").alias("username"))
    )
    return owners.join(users.select("username"), "username", "left_anti").select(
        "username", F.col("username").alias("display_name"), F.lit("local").alias("auth_provider")
    )


def set_default_profile(profiles: DataFrame, chosen: DataFrame) -> DataFrame:
    """Exactly the chosen profile of each owner in ``chosen`` is the default; others are untouched."""
    picked = chosen.select("owning_user", F.col("profile_name").alias("_chosen"))
    flag = F.when(F.col("profile_name") == F.col("_chosen"), 1).otherwise(0)
    return (
        profiles.join(picked, "owning_user", "left")
        .withColumn(
            "is_default",
            F.when(F.col("_chosen").isNull(), F.col("is_default"))
            .otherwise(flag)
            .cast(profiles.schema["is_default"].dataType),
        )
        .select(*profiles.columns)
    )


# --- postings and their history --------------------------------------------------------------------

POSTING_OWNER = ["id", "owning_user"]


def history_rows(
    events: DataFrame, status: str, note: str, on: Column, first_id: int = 1
) -> DataFrame:
    """First history rows for postings."""
    return events.select(
        next_ids(first_id).alias("id"),
        F.col("id").alias("applied_job_id"),
        F.lit(status).alias("status"),
        F.lit(note).alias("notes"),
        on.alias("changed_at"),
    )


def add_history(history: DataFrame, rows: DataFrame) -> DataFrame:
    return history.unionByName(rows, allowMissingColumns=True).select(*history.columns)


def manual_history(postings: DataFrame, as_of: Column | str, first_id: int = 1) -> DataFrame:
    """First history rows of hand-entered applications, as they are stored with their ids."""
    applied = postings.where(F.col("review_status") == "applied")
    return history_rows(applied, "submitted", fv.MANUAL_NOTE, day(as_of), first_id)


def apply_to(
    postings: DataFrame, history: DataFrame, requests: DataFrame, as_of: Column | str,
    first_id: int = 1, note: str = fv.APPLY_NOTE,
) -> tuple[DataFrame, DataFrame]:
    """Mark postings as applied and open their history; unknown ids and owners do nothing."""
    today = day(as_of)
    change = requests.select(*POSTING_OWNER).distinct().select(
        *POSTING_OWNER, F.lit("applied").alias("review_status"), today.alias("applied_at")
    )
    known = postings.select(*POSTING_OWNER).join(change.select(*POSTING_OWNER), POSTING_OWNER)
    opened = history_rows(known, "submitted", note, today, first_id)
    return update(postings, change, POSTING_OWNER, None), add_history(history, opened)


def undo_application(
    postings: DataFrame, history: DataFrame, requests: DataFrame, status: str = "not_reviewed"
) -> tuple[DataFrame, DataFrame]:
    """Withdraw (``not_reviewed``) or move back (``saved``): history goes, applied fields are reset.

    History goes only with a posting that the request's owner has.
    """
    hit = requests.select(*POSTING_OWNER).distinct().withColumn("_hit", F.lit(True))
    cleared = {
        "review_status": F.lit(status),
        "applied_at": F.lit(None),
        "job_notes": F.lit(""),
        "resume": F.lit(None),
    }
    joined = postings.join(hit, POSTING_OWNER, "left")
    columns = [
        F.when(F.col("_hit"), cleared[c].cast(postings.schema[c].dataType))
        .otherwise(F.col(c))
        .alias(c)
        if c in cleared
        else F.col(c)
        for c in postings.columns
    ]
    owned = postings.select(*POSTING_OWNER).join(hit.drop("_hit"), POSTING_OWNER)
    kept = history.join(
        owned.select(F.col("id").alias("applied_job_id")).distinct(), "applied_job_id", "left_anti"
    )
    return joined.select(*columns), kept.select(*history.columns)


def manual_postings(
    forms: DataFrame, as_of: Column | str, applied: bool, first_id: int = 1
) -> DataFrame:
    """Hand-entered postings as store rows, applied or saved."""
    there = set(forms.columns)
    today = day(as_of)

    def text(name: str, default: str = "") -> Column:
        value = F.col(name) if name in there else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(default)).alias(name)

    def amount(name: str) -> Column:
        value = F.col(name) if name in there else F.lit(None)
        return value.cast("string").try_cast("double").alias(name)

    stated = F.col("applied_at") if "applied_at" in there else F.lit(None)
    clearance = (
        F.coalesce(F.col("security_clearance_required").cast("boolean"), F.lit(False))
        if "security_clearance_required" in there
        else F.lit(False)
    )
    return forms.select(
        next_ids(first_id).alias("id"),
        text("job_url"),
        F.lit(fv.MANUAL_SITE).alias("site"),
        text("title"),
        text("company"),
        text("location"),
        F.lit("").alias("job_type"),
        today.alias("date_posted"),
        text("interval"),
        amount("min_amount"),
        amount("max_amount"),
        text("currency"),
        (F.lower(text("is_remote", "false")) == "true").alias("is_remote"),
        text("description"),
        F.lit(0).alias("job_score"),
        F.lit("{}").alias("job_score_json"),
        F.when(clearance, 1).otherwise(0).alias("security_clearance_required"),
        F.lit("applied" if applied else "saved").alias("review_status"),
        today.alias("date_created"),
        "owning_user",
        (
            date_or_today(stated.cast("string").try_cast("date"), as_of)
            if applied
            else F.lit(None).cast("date")
        ).alias("applied_at"),
        F.lit("").alias("job_notes"),
    )


def status_events(
    history: DataFrame, feed: DataFrame, as_of: Column | str, first_id: int = 1
) -> DataFrame:
    """History after a feed of inserts, updates and deletes (``op`` I, U, D; ``seq`` orders it).

    A blank date is the run date. Updates and deletes go by history id, the last one per id counts.
    """
    dated = feed.withColumn("changed_at", date_or_today("changed_at", as_of))
    keyed = latest(dated.where(F.col("op").isin("U", "D")), ["id"], F.desc("seq"))
    changed = update(
        history, keyed.where(F.col("op") == "U").select("id", "status", "notes", "changed_at"), ["id"], None
    )
    kept = delete(changed, keyed.where(F.col("op") == "D"), ["id"])
    added = dated.where((F.col("op") == "I") & (F.col("status") != "")).select(
        next_ids(first_id).alias("id"),
        "applied_job_id", "status", "notes", "changed_at",
    )
    return kept.select(*history.columns).unionByName(added, allowMissingColumns=True)


def edited_fields(forms: DataFrame) -> DataFrame:
    """Edit form values as a change set: amounts become numbers, blanks stay blank."""
    return (
        forms.withColumn("min_amount", pay.amount_or_blank("min_amount").try_cast("double"))
        .withColumn("max_amount", pay.amount_or_blank("max_amount").try_cast("double"))
        .withColumn("applied_at", F.col("applied_at").cast("string").try_cast("date"))
    )


def edit_postings(
    postings: DataFrame, forms: DataFrame, order: Sequence[Column] | None = None
) -> DataFrame:
    """Postings after edit forms. A form states every field it has, so a blank one clears the column."""
    return apply_changes(
        postings, edited_fields(forms), POSTING_OWNER, order, default=take_new, insert=False
    )


# --- retention ---------------------------------------------------------------------------------------


def usable_retention(days: object) -> int | None:
    """A positive whole number of days, or null when the setting cannot be used."""
    try:
        days = int(days)
    except (TypeError, ValueError):
        return None
    return days if days > 0 else None


def is_expired(as_of: Column | str, days: int) -> Column:
    """Not kept by its owner, and posted (or, without a date, stored) before the cutoff."""
    kept = F.col("review_status").isin(fv.KEPT_REVIEW_STATUSES)
    return ~kept & (F.coalesce("date_posted", "date_created") < F.date_sub(day(as_of), days))


def cascade_history(history: DataFrame, postings: DataFrame) -> DataFrame:
    """History of the postings that are still there."""
    return history.join(
        postings.select(F.col("id").alias("applied_job_id")), "applied_job_id", "left_semi"
    ).select(*history.columns)


def drop_expired(
    postings: DataFrame, history: DataFrame, as_of: Column | str, days: object
) -> tuple[DataFrame, DataFrame]:
    """Retention on postings and their history; an unusable setting deletes nothing."""
    usable = usable_retention(days)
    if usable is None:
        return postings, history
    kept = postings.where(~F.coalesce(is_expired(as_of, usable), F.lit(False)))
    return kept, cascade_history(history, kept)


def prune_cache(cache: DataFrame, as_of: Column | str, days: int) -> DataFrame:
    return cache.where(F.col("date_updated") >= F.date_sub(day(as_of), days))


# --- backfills and bulk rules -------------------------------------------------------------------------


def backfill_clearance(postings: DataFrame) -> DataFrame:
    """Set the clearance flag where the text asks for it; a flag that is set stays."""
    return postings.withColumn(
        "security_clearance_required",
        F.greatest(F.col("security_clearance_required"), clearance_flag("description", "title")),
    )


def bulk_status(postings: DataFrame, rule: Column, status: str = "rejected") -> DataFrame:
    """Give every posting that meets a rule a review status."""
    return postings.withColumn(
        "review_status",
        F.when(F.coalesce(rule, F.lit(False)), F.lit(status)).otherwise(F.col("review_status")),
    )


def write_back(postings: DataFrame, results: DataFrame) -> DataFrame:
    """Score, result, usage and clearance flag of scored postings. ``results`` has one row per id."""
    fields = results.select("id", "job_score_json", "usage_metrics").withColumn(
        "_fields", stored_fields("job_score_json")
    )
    change = fields.select(
        "id",
        "job_score_json",
        "usage_metrics",
        F.col("_fields.job_score").alias("job_score"),
        F.col("_fields.security_clearance_required").alias("security_clearance_required"),
    )
    return update(postings, change, ["id"], None)


# --- schema changes -----------------------------------------------------------------------------------


def add_column(df: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    """Add a column with a default unless it is there."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)
