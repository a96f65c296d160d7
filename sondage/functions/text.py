"""Localized text and time formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_TIME = "Unknown"
MAX_EPOCH = 253402300799  # 9999-12-31T23:59:59Z, the last time with a four-digit year
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"

LOCALIZED_TYPE = "array<struct<code:string,parts:array<struct<str:string>>>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def localized_text(c: Column | str, language: str | None = None) -> Column:
    """``[{code, parts:[{str}]}]`` -> array of texts.

    With a language, only entries of that code, parts joined by a space.
    Without one every entry, prefixed by ``"[code] "`` and then joined by a
    space (so two spaces follow the bracket, as the reference prints).
    """
    arr = _col(c)
    if language is not None:
        arr = F.filter(arr, lambda e: e.getField("code") == F.lit(language))
        return F.transform(arr, lambda e: F.array_join(
            F.transform(e.getField("parts"), lambda p: p.getField("str")), " "))
    return F.transform(arr, lambda e: F.array_join(F.concat(
        F.array(F.concat(F.lit("["), e.getField("code"), F.lit("] "))),
        F.transform(e.getField("parts"), lambda p: p.getField("str"))), " "))


def localize_map(c: Column | str) -> Column:
    """``MAP<language, text>`` -> ``[{code, parts:[{str}]}]`` in map order."""
    return F.transform(F.map_entries(_col(c)), lambda e: F.struct(
        e.getField("key").alias("code"),
        F.array(F.struct(e.getField("value").alias("str"))).alias("parts")))


def published_iso(c: Column | str) -> Column:
    """Epoch seconds -> ``YYYY-MM-DDTHH:MM:SS`` (UTC); zero, negative, beyond
    year 9999 or non-integer text -> ``Unknown``."""
    s = F.trim(_col(c).cast("string"))
    n = F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))  # null where even 64 bits are too few
    return F.when((n > 0) & (n <= MAX_EPOCH), F.date_format(F.timestamp_seconds(n), ISO_FORMAT)).otherwise(F.lit(UNKNOWN_TIME))


def midnight_floor(c: Column | str) -> Column:
    """Truncate a timestamp to the start of its day (UTC)."""
    return F.date_trunc("DAY", _col(c))
