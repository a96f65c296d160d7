"""Casting rules.

All casts are built-in Column expressions (whole-stage codegen, no Python per
row).  ANSI mode stays on; the rules use ``try_cast`` and explicit guards where
the source data may be dirty.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import ColumnSelector
from .versions import parse_selector

# --- fixed values ----------------------------------------------------------------------------
# Text accepted as a boolean (compared after lower-casing); null and '' give null.
BOOL_TRUE = ["1", "true"]
BOOL_FALSE = ["0", "false"]
# Cast types that change a column; any other schema type leaves the text as it is.
CAST_TYPES = ["bool", "json", "date", "int", "float"]
# ---------------------------------------------------------------------------------------------

# A plain decimal number (white space around it), infinity or a signed NaN, as Python's float()
# reads it (no '1d'/'1f' suffixes); the group is what the engine's cast reads.
NUMBER_RE = (r"(?i)^(?:\s*(?=[+-]?[.0-9]))?(?:[+-](?=nan\z))?"
             r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|[+-]?inf(?:inity)?|nan)(?:(?<=[0-9.])\s*)?\z")
# Years 0001..9999 in epoch seconds: beyond them a timestamp overflows.
_MIN_EPOCH, _MAX_EPOCH = -62135596800, 253402300799

ITEMS_SCHEMA = "struct<items:array<struct<key:string>>>"


def _col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


class CastError(ValueError):
    pass


def to_bool(c: Column | str, on_error: str = "error") -> Column:
    """``0/1/true/false`` in any case -> boolean; null and ``''`` -> null.

    Anything else fails the job (``on_error='error'``, the reference's behaviour)
    or becomes null (``on_error='null'``).
    """
    c = _col(c)
    s = c.cast("string")
    low = F.lower(s)
    other = (F.raise_error(F.concat(F.lit("cannot read as boolean: "), s)).cast("boolean")
             if on_error == "error" else F.lit(None).cast("boolean"))
    return (F.when(s.isNull() | (s == ""), F.lit(None).cast("boolean"))
            .when(low.isin(*BOOL_TRUE), F.lit(True))
            .when(low.isin(*BOOL_FALSE), F.lit(False))
            .otherwise(other))


def parse_number(c: Column | str) -> Column:
    """Text -> DOUBLE the way Python's ``float()`` reads plain decimals, else null.

    ``nan``/``inf`` (any case, signed) are kept as NaN/Infinity like ``float()``.
    """
    # Python also accepts single underscores between digits ('1_000').
    s = F.regexp_replace(F.trim(_col(c).cast("string")), r"(?<=[0-9])_(?=[0-9])", "")
    # One chain: a value is read once, however often callers name the result.
    return F.regexp_extract(s, NUMBER_RE, 1).try_cast("double")


def to_int(c: Column | str) -> Column:
    """A whole number's text -> BIGINT; other text, and numbers beyond 64 bits -> null."""
    s = F.trim(_col(c).cast("string"))
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))


def epoch_to_timestamp(c: Column | str) -> Column:
    """Epoch seconds (number or text) -> TIMESTAMP; anything uncastable -> null."""
    x = parse_number(c)
    return F.when((x >= _MIN_EPOCH) & (x <= _MAX_EPOCH), F.timestamp_seconds(x))  # NaN is above every number


def json_item_keys(c: Column | str) -> Column:
    """JSON object -> its ``items[].key`` joined by ``,``.

    ``''`` stays ``''``; null, unparsable JSON or no items -> null.
    """
    c = _col(c).cast("string")
    keys = F.transform(F.from_json(c, ITEMS_SCHEMA).getField("items"), lambda x: x.getField("key"))
    # One parse per value: no items (or no keys) join to '' which becomes null.  (``nullif``
    # would repeat its argument, and so the parse; a one-element filter keeps a single copy.)
    joined = F.array_join(keys, ",")
    non_empty = F.try_element_at(F.filter(F.array(joined), lambda x: x != ""), F.lit(1))
    return F.when(c == "", F.lit("")).otherwise(non_empty)


CASTERS = {
    "bool": to_bool,
    "date": epoch_to_timestamp,
    "json": json_item_keys,
    "int": to_int,
    "float": parse_number,
}

RESULT_TYPES = {"bool": "boolean", "date": "timestamp", "json": "string", "int": "bigint", "float": "double"}


def cast_expr(c: Column | str, kind: str, on_error: str = "error") -> Column:
    if kind == "bool":
        return to_bool(c, on_error)
    if kind in CASTERS:
        return CASTERS[kind](c)
    return _col(c)


def schema_cast(df: DataFrame, column_types: Mapping[str, str], on_error: str = "error") -> DataFrame:
    """One projection applying the casts of ``CAST_TYPES``; absent columns ignored."""
    present = set(df.columns)
    todo = {c: t for c, t in column_types.items() if c in present and t in CASTERS}
    # Apply in the fixed order bool, json, date (matters only if a name appears twice).
    out = []
    for name in df.columns:
        t = todo.get(name)
        expr = cast_expr(name, t, on_error) if t else _col(name)
        out.append(expr.alias(name))
    return df.select(*out)


def cast_selected(df: DataFrame, rule: str, columns, version: str | None = None,
                  version_col: str = "version", on_error: str = "error") -> DataFrame:
    """``to_bool``/``to_date`` on the columns picked by a selector.

    With ``version`` only rows of that version are cast; the others get a
    lenient cast of the same type so the column keeps one type.
    """
    kind = {"to_bool": "bool", "to_date": "date", "bool": "bool", "date": "date"}[rule]
    selector = columns if isinstance(columns, ColumnSelector) else ColumnSelector(columns)
    chosen = set(selector.select(df.columns))
    pred = parse_selector(version).column(F.col(version_col)) if version else None
    out = []
    for name in df.columns:
        if name not in chosen:
            out.append(_col(name))
            continue
        strict = cast_expr(name, kind, on_error)
        if pred is None:
            out.append(strict.alias(name))
        else:
            lenient = cast_expr(name, kind, "null")
            out.append(F.when(pred, strict).otherwise(lenient).alias(name))
    return df.select(*out)


def json_flatten(df: DataFrame, column: str, keys: Sequence[str] | None = None,
                 separator: str = "_") -> DataFrame:
    """Explode a JSON object column to flat text columns ``{column}_{key}``.

    Keys are discovered with one distinct aggregate (bounded by the schema)
    unless given.
    """
    from . import evaluate_once, schema_rows
    if keys is None:
        keys = sorted(r[0] for r in schema_rows(df.select(F.explode(F.json_object_keys(_col(column).cast("string")))).distinct(), "set of keys"))
    parsed = evaluate_once(df, _m=F.from_json(_col(column).cast("string"), "map<string,string>"))
    cols = [_col(c) for c in df.columns if c != column]
    return parsed.select(*cols, *[F.element_at("_m", F.lit(k)).alias(f"{column}{separator}{k}") for k in keys])


#: Kinds of a key's values, each one wide enough for those before it.
KINDS = ("null", "int", "float", "text")


def widest(kinds: Iterable[str]) -> str:
    """The kind that holds values of all these kinds, in whatever order they come."""
    return max(kinds, key=KINDS.index, default="null")
