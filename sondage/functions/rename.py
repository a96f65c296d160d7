"""Column renaming.

Response keys look like ``group.path.Question|response.path``.  Renaming is
planned on the driver over *names* (metadata, bounded by the survey schema),
and every rule also has a Column form so a DataFrame of keys — e.g. all keys
seen in the payloads — can be renamed as a distributed projection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (they must equal the reference's for the same names) -------------------
DEFAULT_SEPARATOR = "|"
SEPARATOR_PLACEHOLDER = "<$>"
# Default rename chain: (pattern, replacement) after the group prefix is removed.
DEFAULT_RENAME_RULES = [
    (r"<$>mat\.row(\d+)\.col(\d+)", r"<$>multi_row\1_col\2"),
    (r"<$>likert_(\d+)", r"<$>lk_\1"),
    ("<$>", "_"),
]
# Standard fields left out of the default chain, and their fixed new names.
DEFAULT_EXCLUDED_COLUMNS = ["submitted", "language", "participantID", "engineVersion", "opened", "ID"]
DEFAULT_RENAME_COLUMNS = {"participantID": "global_id", "submitted": "timestamp", "ID": "id"}
# ------------------------------------------------------------------------------------------


class DuplicateColumnError(ValueError):
    pass


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _java_replacement(py_repl: str) -> str:
    r"""Python ``re.sub`` replacement -> Java ``Matcher`` replacement.

    ``\1``/``\g<1>`` become ``$1``; a literal ``$`` or ``\`` is escaped.
    """
    out = []
    i = 0
    while i < len(py_repl):
        ch = py_repl[i]
        if ch == "\\" and i + 1 < len(py_repl):
            nxt = py_repl[i + 1]
            if nxt.isdigit():
                j = i + 1
                while j < len(py_repl) and py_repl[j].isdigit() and j - i <= 2:
                    j += 1
                out.append("$" + py_repl[i + 1:j])
                i = j
                continue
            m = re.match(r"\\g<(\d+)>", py_repl[i:])
            if m:
                out.append("$" + m.group(1))
                i += len(m.group(0))
                continue
            out.append("\\\\" if nxt == "\\" else nxt)
            i += 2
            continue
        if ch == "$":
            out.append("\\$")
        elif ch == "\\":
            out.append("\\\\")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


# --- rules ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class StripPrefix:
    """Keep the last dot segment of the question part, reattach the response part."""

    separator: str = DEFAULT_SEPARATOR

    def apply(self, name: str) -> str:
        question, sep, response = name.partition(self.separator)
        last = question.split(".")[-1]
        return last + self.separator + response if sep else last

    def column(self, c: Column | str) -> Column:
        c = _col(c)
        pos = F.instr(c, self.separator)
        question = F.when(pos > 0, F.substring_index(c, self.separator, 1)).otherwise(c)
        last = F.substring_index(question, ".", -1)
        response = F.substr(c, pos + F.lit(len(self.separator)))
        return F.when(pos > 0, F.concat(last, F.lit(self.separator), response)).otherwise(last)


@dataclass(frozen=True)
class RegexRename:
    """Ordered regex substitution; ``<$>`` stands for the separator.

    In the pattern the separator is escaped, in the replacement it is literal.
    Case-insensitive unless ``ignore_case=False`` (O18 header renames).
    """

    pattern: str
    replace: str
    separator: str = DEFAULT_SEPARATOR
    ignore_case: bool = True

    @property
    def py_pattern(self) -> str:
        return self.pattern.replace(SEPARATOR_PLACEHOLDER, re.escape(self.separator))

    @property
    def py_replace(self) -> str:
        return self.replace.replace(SEPARATOR_PLACEHOLDER, self.separator)

    def compiled(self):
        try:
            return re.compile(self.py_pattern, re.IGNORECASE if self.ignore_case else 0)
        except re.error as e:
            raise ValueError(f"bad rename pattern {self.py_pattern!r}: {e}") from e

    def apply(self, name: str) -> str:
        return self.compiled().sub(self.py_replace, name)

    def column(self, c: Column | str) -> Column:
        # as Python reads patterns over text: Unicode case folding, digits and letters
        flags = "(?iuU)" if self.ignore_case else "(?U)"
        return F.regexp_replace(_col(c), F.lit(flags + self.py_pattern),
                                F.lit(_java_replacement(self.py_replace)))


@dataclass(frozen=True)
class FixedRename:
    """Exact dictionary lookup, otherwise unchanged."""

    mapping: tuple

    @classmethod
    def of(cls, mapping: Mapping[str, str]) -> "FixedRename":
        return cls(tuple(mapping.items()))

    @property
    def as_dict(self) -> dict:
        return dict(self.mapping)

    def apply(self, name: str) -> str:
        return self.as_dict.get(name, name)

    def column(self, c: Column | str) -> Column:
        c = _col(c)
        if not self.mapping:
            return c
        m = F.create_map(*[F.lit(x) for kv in self.mapping for x in kv])
        return F.coalesce(F.element_at(m, c), c)


@dataclass
class RenameChain:
    """Apply rules in order to every non-excluded name; a many-to-one result is an error.

    The collision check is case-insensitive by default because Spark resolves
    column names case-insensitively (``ID`` and ``id`` are the same column).
    """

    rules: list = field(default_factory=list)
    excluded: Sequence[str] = ()
    defaults: Mapping[str, str] = field(default_factory=dict)
    case_sensitive: bool = False

    def target(self, name: str) -> str:
        value = name
        if name not in self.excluded:
            for rule in self.rules:
                value = rule.apply(value)
        return self.defaults.get(value, value)

    def plan(self, names: Iterable[str]) -> dict[str, str]:
        names = list(names)
        mapping = {n: self.target(n) for n in names}
        self.check(mapping)
        return mapping

    def collisions(self, mapping: Mapping[str, str]) -> dict[str, list[str]]:
        groups: dict[str, list[str]] = {}
        for src, dst in mapping.items():
            key = dst if self.case_sensitive else dst.lower()
            groups.setdefault(key, []).append(src)
        return {k: v for k, v in groups.items() if len(v) > 1}

    def check(self, mapping: Mapping[str, str]) -> None:
        bad = self.collisions(mapping)
        if bad:
            desc = "; ".join(f"{k} <- {sorted(v)}" for k, v in sorted(bad.items()))
            raise DuplicateColumnError(f"duplicate column after renaming: {desc}")

    def column(self, c: Column | str) -> Column:
        c = _col(c)
        value = c
        for rule in self.rules:
            value = rule.column(value)
        if self.excluded:
            value = F.when(c.isin(*self.excluded), c).otherwise(value)
        if self.defaults:
            value = FixedRename.of(self.defaults).column(value)
        return value


def default_rules(separator: str = DEFAULT_SEPARATOR) -> list:
    return [StripPrefix(separator)] + [RegexRename(p, r, separator) for p, r in DEFAULT_RENAME_RULES]


def default_chain(separator: str = DEFAULT_SEPARATOR) -> RenameChain:
    """Strip prefix, the three default regex rules, the six excluded standard
    fields, then the fixed names of the standard fields."""
    return RenameChain(default_rules(separator), DEFAULT_EXCLUDED_COLUMNS, DEFAULT_RENAME_COLUMNS)


def parse_rename_rules(rules_spec: Sequence[Mapping], separator: str = DEFAULT_SEPARATOR,
                       ignore_case: bool = True) -> list:
    """Rule specs in the reference vocabulary: ``[{'regex': {pat: repl}}, {'fixed': {a: b}}]``."""
    rules = []
    for pos, spec in enumerate(rules_spec):
        found = False
        if "regex" in spec:
            if not isinstance(spec["regex"], Mapping):
                raise ValueError(f"rename rule {pos}: 'regex' must map pattern to replacement")
            for pat, repl in spec["regex"].items():
                rules.append(RegexRename(pat, repl, separator, ignore_case))
            found = True
        if "fixed" in spec:
            if not isinstance(spec["fixed"], Mapping):
                raise ValueError(f"rename rule {pos}: 'fixed' must map old name to new name")
            rules.append(FixedRename.of(spec["fixed"]))
            found = True
        if "strip_prefix" in spec or spec.get("name") == "remove_prefix":
            rules.append(StripPrefix(separator))
            found = True
        if not found:
            raise ValueError(f"rename rule {pos}: no known rule")
    return rules


# --- DataFrame forms ------------------------------------------------------------------------


def rename_columns(df: DataFrame, chain: RenameChain) -> DataFrame:
    """Rename the columns of ``df`` (names are metadata: one projection, no data moved)."""
    mapping = chain.plan(df.columns)
    return df.select(*[F.col(f"`{c}`").alias(mapping[c]) for c in df.columns])


def header_rename(df: DataFrame, substitutions: Sequence[tuple[str, str]]) -> DataFrame:
    """Case-sensitive regex substitutions over the header, in order."""
    chain = RenameChain([RegexRename(p, r, ignore_case=False) for p, r in substitutions],
                        case_sensitive=True)
    return rename_columns(df, chain)


def rename_plan(keys: DataFrame, chain: RenameChain, key_col: str = "source",
                group: Sequence[str] = ()) -> DataFrame:
    """O16 as data: ``(group..., source, target, n_sources)`` for a DataFrame of distinct keys.

    ``n_sources`` > 1 marks a collision inside its group (e.g. one survey
    version).  Targets are compared lower-cased when the chain is
    case-insensitive, as Spark resolves column names.
    """
    group = list(group)
    renamed = keys.select(*group, F.col(key_col).alias("source"), chain.column(F.col(key_col)).alias("target"))
    gkey = F.col("target") if chain.case_sensitive else F.lower("target")
    counts = renamed.groupBy(*group, gkey.alias("_g")).agg(F.count("*").alias("n_sources"))
    return (renamed.withColumn("_g", gkey).join(counts, [*group, "_g"]).drop("_g")
            .select(*group, "source", "target", F.col("n_sources").cast("bigint")))
