"""Wide <-> long layouts."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schema_rows


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None,
                 keep_nulls: bool = False) -> DataFrame:
    """One row per id x column, ``(ids..., key, value)`` with text values."""
    ids = list(ids)
    cols = [c for c in (columns or df.columns) if c not in ids]
    src = df.select(*ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    out = src.unpivot(ids, cols, "key", "value")
    return out if keep_nulls else out.where(F.col("value").isNotNull())


def payload_to_long(df: DataFrame, ids: Sequence[str], payload: str = "payload") -> DataFrame:
    """O10 from a decoded payload map: ``explode`` the map."""
    return df.select(*ids, F.explode(payload).alias("key", "value"))


def long_to_wide(df: DataFrame, ids: Sequence[str], key: str = "key", value: str = "value",
                 keys: Sequence[str] | None = None) -> DataFrame:
    """One row per id, one column per key (missing -> null).

    Keys are discovered with one distinct aggregate unless given (bounded by
    the schema).  The pivot is a grouped aggregate with a partial step.
    """
    if keys is None:
        keys = sorted(r[0] for r in schema_rows(df.select(key).distinct(), "set of keys"))
    return df.groupBy(*ids).pivot(key, list(keys)).agg(F.max(value))
