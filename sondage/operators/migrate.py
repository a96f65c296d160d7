"""User-migration record preparation (O71-O74). No passwords, no API calls:
the output is the records and the report, computed per user row."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------------------
STATUS_CREATED = "created"
STATUS_SKIPPED = "skipped"
REASON_EMAIL = "email_filter"
REASON_EMPTY = "empty_profile"
# ---------------------------------------------------------------------------------------------


def email_filtered(email: Column, suffixes: Sequence[str]) -> Column:
    """True when the email ends with one of the suffixes: one expression for a list of any length."""
    listed = F.array(*[F.lit(s) for s in suffixes]).cast("array<string>")
    return F.exists(listed, lambda s: F.endswith(email, s))


def email_suffix_filter(users: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Drop users whose email ends with any suffix."""
    return users.where(~email_filtered(F.col("email"), suffixes))


def skip_empty_profiles(users: DataFrame, enabled: bool = True, profiles: DataFrame | None = None,
                        key: str = "user_key") -> DataFrame:
    """Drop users with no profile when enabled.

    With ``profiles`` in long form (one row per profile, keyed by ``key``) this is a
    semi-join and no per-user arrays are built.
    """
    if not enabled:
        return users
    if profiles is not None:
        return users.join(profiles.select(key).distinct(), key, "left_semi")
    return users.where(F.size("profiles") > 0)


def main_profile_first(profiles: Column | str) -> Column:
    """Stable partition — profiles flagged ``main`` first, then the rest."""
    p = F.col(profiles) if isinstance(profiles, str) else profiles
    return F.concat(F.filter(p, lambda x: F.coalesce(x.getField("main"), F.lit(False))),
                    F.filter(p, lambda x: ~F.coalesce(x.getField("main"), F.lit(False))))


def main_profile_first_long(spark, profiles: DataFrame, key: str = "user_key", seq: str = "seq") -> DataFrame:
    """O73 in long form: each profile's position, main profiles first, then the
    original order (``seq``); no user's profiles are held by one task."""
    from .store import rank_within_group
    ordered = profiles.withColumn("_rest", (~F.coalesce(F.col("main"), F.lit(False))).cast("int"))
    return rank_within_group(spark, ordered, key, ["_rest", seq], "pos").drop("_rest")


def migration_records(users: DataFrame, suffixes: Sequence[str], skip_empty: bool,
                      preferred_language: str, study_keys: Sequence[str], use_2fa: bool = False) -> DataFrame:
    """One target record per user and its status.

    ``status`` is ``created`` or ``skipped`` with ``reason`` (email filter
    first, then empty profiles).  Records carry the profile ids and names with
    the main profile first, the user's language or the default, the studies.
    """
    prof = main_profile_first("profiles")
    filtered = email_filtered(F.col("email"), suffixes)
    empty = F.lit(bool(skip_empty)) & (F.size("profiles") == 0)
    reason = F.when(filtered, F.lit(REASON_EMAIL)).when(empty, F.lit(REASON_EMPTY))
    lang = F.col("language") if "language" in users.columns else F.lit(None).cast("string")
    return users.select(
        "*",
        F.col("email").alias("accountId"),
        F.transform(prof, lambda x: x.getField("gid")).alias("oldParticipantIDs"),
        F.transform(prof, lambda x: x.getField("name")).alias("profileNames"),
        F.coalesce(lang, F.lit(preferred_language)).alias("preferredLanguage"),
        F.array(*[F.lit(s) for s in study_keys]).alias("studies"),
        F.lit(bool(use_2fa)).alias("use2FA"),
        F.when(reason.isNull(), F.lit(STATUS_CREATED)).otherwise(F.lit(STATUS_SKIPPED)).alias("status"),
        reason.alias("reason"))


def migration_records_long(spark, users: DataFrame, profiles: DataFrame, suffixes: Sequence[str], skip_empty: bool,
                           preferred_language: str, study_keys: Sequence[str], use_2fa: bool = False,
                           key: str = "user_key") -> tuple[DataFrame, DataFrame]:
    """O74 in long form: ``(records, record profiles)``.

    A record per user without its profiles, and ``(accountId, pos, gid, name)``
    per profile, the main ones first.  No user's profiles meet in one row or
    task.
    """
    lang = F.col("language") if "language" in users.columns else F.lit(None).cast("string")
    status = migration_status(users, profiles, suffixes, skip_empty, key)
    records = status.join(users.drop("email"), key).select(
        key, F.col("email").alias("accountId"), F.coalesce(lang, F.lit(preferred_language)).alias("preferredLanguage"),
        F.array(*[F.lit(s) for s in study_keys]).cast("array<string>").alias("studies"), F.lit(bool(use_2fa)).alias("use2FA"), "status", "reason")
    placed = main_profile_first_long(spark, profiles, key)
    return records, placed.join(users.select(key, F.col("email").alias("accountId")), key).select(key, "accountId", "pos", "gid", "name")


def migration_status(users: DataFrame, profiles: DataFrame, suffixes: Sequence[str], skip_empty: bool,
                     key: str = "user_key") -> DataFrame:
    """O74 status without building records: ``(key, email, status, reason)``.

    Emptiness comes from a left join to the distinct profile owners (long form),
    so no per-user arrays are built.
    """
    owners = profiles.select(key).distinct().withColumn("_has", F.lit(True))
    j = users.join(owners, key, "left")
    filtered = email_filtered(F.col("email"), suffixes)
    empty = F.lit(bool(skip_empty)) & F.col("_has").isNull()
    reason = F.when(filtered, F.lit(REASON_EMAIL)).when(empty, F.lit(REASON_EMPTY))
    return j.select(key, "email", F.when(reason.isNull(), F.lit(STATUS_CREATED)).otherwise(F.lit(STATUS_SKIPPED))
                    .alias("status"), reason.alias("reason"))


def migration_report(records: DataFrame) -> DataFrame:
    """O74 report: users per (status, reason) — from ``migration_records`` or ``migration_status``."""
    return records.groupBy("status", "reason").agg(F.count("*").alias("n"))
