"""Column functions: versions, renames, selection, casts, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Entries of a schema (keys, columns) that may reach the driver; more is an error, as that is no schema.
MAX_SCHEMA_ENTRIES = 1_000_000


class SchemaSizeError(ValueError):
    pass


def schema_rows(rows: DataFrame, what: str = "schema") -> list:
    """Schema-sized rows at the driver, checked against the declared limit."""
    got = rows.limit(MAX_SCHEMA_ENTRIES + 1).collect()
    if len(got) > MAX_SCHEMA_ENTRIES:
        raise SchemaSizeError(f"the {what} has more than {MAX_SCHEMA_ENTRIES} entries")
    return got


def evaluate_once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns whose (expensive) expressions must run once per row.

    Catalyst inlines a projected expression into every consumer (a parsed JSON
    payload read as twelve fields would be parsed twelve times).  Producing the
    values through ``inline(array(struct(...)))`` — a one-row generator — keeps
    them as real columns, evaluated once.
    """
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))
