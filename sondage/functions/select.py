"""Column selection (O19) and field projection.

Selectors work on column *names* on the driver; the result is one ``select``.
"""

from __future__ import annotations

import fnmatch
import re
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ColumnSelector:
    """Union of names, name lists, ``{'glob': p}`` and ``{'re': p}`` selectors.

    The result keeps the table's column order (no duplicates).  A ``re`` pattern
    must match at the start of the name (``re.match``).
    """

    def __init__(self, conf):
        if isinstance(conf, (str, Mapping)):
            conf = [conf]
        if not isinstance(conf, (list, tuple)):
            raise ValueError("column selector must be a list of names, lists or {'glob'|'re': ...}")
        self.fixed: set[str] = set()
        self.globs: list[str] = []
        self.regexes: list = []
        for item in conf:
            if isinstance(item, str):
                self.fixed.add(item)
            elif isinstance(item, (list, tuple)):
                self.fixed.update(item)
            elif isinstance(item, Mapping):
                for mode in ("glob", "re"):
                    if mode in item:
                        pats = item[mode]
                        pats = [pats] if isinstance(pats, str) else list(pats)
                        if mode == "glob":
                            self.globs.extend(pats)
                        else:
                            self.regexes.extend(re.compile(p) for p in pats)
            else:
                raise ValueError(f"unknown column selector entry {item!r}")

    def matches(self, name: str) -> bool:
        return (name in self.fixed
                or any(fnmatch.fnmatch(name, g) for g in self.globs)
                or any(r.match(name) for r in self.regexes))

    def select(self, columns: Sequence[str]) -> list[str]:
        return [c for c in columns if self.matches(c)]


def select_columns(df: DataFrame, conf) -> DataFrame:
    """O19 over a DataFrame."""
    cols = ColumnSelector(conf).select(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in cols])


def project_fields(df: DataFrame, fields) -> DataFrame:
    """Fields to columns, a list or ``{column: field}``; a missing field is an error.

    A field may be a nested path (``a.b``): a column, then fields of structs or
    keys of maps.
    """
    pairs = list(fields.items()) if isinstance(fields, Mapping) else [(f, f) for f in fields]
    for _, fld in pairs:
        kind = df.schema
        for name in fld.split("."):
            found = [f.dataType for f in kind.fields if f.name.lower() == name.lower()] if isinstance(kind, T.StructType) else []
            if not found and not isinstance(kind, T.MapType):
                raise KeyError(f"field {fld!r} not found")
            kind = found[0] if found else kind.valueType
    return df.select(*[F.col(fld).alias(column) for column, fld in pairs])
