"""Survey versions (O05) and version selectors.

A version is text like ``25-10-1``: whole numbers compared position by
position, a missing position counting as 0.  Its canonical form drops the
zeros at the end, so that plain lexicographic order (of Python tuples, and of
Spark arrays) is the order of versions, whatever their lengths.  In Spark a
part is a ``DECIMAL(38,0)``: parts may be time stamps or longer.

A selector is text, or a nested list of texts, of items separated by commas::

    item     = [ "!" ] ( version | [ version ] ":" [ version ] )

``!`` excludes, and exclusion wins over inclusion.  Each item is one closed
interval of versions; a single version is the interval from itself to itself,
and a missing side is open.  The driver's check and the Spark predicate both
come from the intervals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Iterable, Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PART_TYPE = "decimal(38,0)"


class VersionError(ValueError):
    pass


def parse_version(text: str) -> tuple[int, ...]:
    """``'25-10-1'`` -> ``(25, 10, 1)``; a part that is no whole number is an error."""
    parts = str(text).strip().split("-")
    bad = next((k for k, p in enumerate(parts) if not re.fullmatch(r"\s*\+?[0-9]+\s*", p)), None)
    if bad is not None:
        raise VersionError(f"version {text!r}: whole number expected at position {bad}")
    return tuple(map(int, parts))


def canonical(v: str | Sequence[int]) -> tuple[int, ...]:
    """The version without zeros at its end: ``(25, 1, 0)`` -> ``(25, 1)``."""
    parts = list(parse_version(v) if isinstance(v, str) else v)
    while parts and parts[-1] == 0:
        parts.pop()
    return tuple(parts)


def compare_versions(a: str | Sequence[int], b: str | Sequence[int]) -> int:
    """-1, 0 or 1, with missing positions taken as 0."""
    x, y = canonical(a), canonical(b)
    return (x > y) - (x < y)


def version_array(col: Column | str, strict: bool = True) -> Column:
    """Version text -> canonical ``ARRAY<DECIMAL(38,0)>``, ordered as versions are.

    With ``strict`` a part that is no whole number is an error, otherwise null.
    """
    c = F.col(col) if isinstance(col, str) else col
    parts = F.transform(F.split(F.trim(c), "-"), lambda p: p.cast(PART_TYPE) if strict else p.try_cast(PART_TYPE))
    if not strict:
        parts = F.when(~F.exists(parts, lambda p: p.isNull()), parts)
    last = F.array_max(F.transform(parts, lambda p, k: F.when(p != 0, k + 1).otherwise(F.lit(0))))
    return F.slice(parts, F.lit(1), last)


@dataclass(frozen=True)
class Interval:
    """Versions from ``low`` to ``high``, both included; None: open on that side."""

    low: tuple[int, ...] | None
    high: tuple[int, ...] | None

    def __contains__(self, v: tuple[int, ...]) -> bool:
        return (self.low is None or self.low <= v) and (self.high is None or v <= self.high)

    def column(self, versions: Column) -> Column:
        literal = lambda v: F.array(*[F.lit(str(x)).cast(PART_TYPE) for x in v]).cast(f"array<{PART_TYPE}>")
        if self.low is not None and self.low == self.high:
            return versions == literal(self.low)
        sides = [versions >= literal(self.low)] if self.low is not None else []
        sides += [versions <= literal(self.high)] if self.high is not None else []
        return sides[0] & sides[1] if len(sides) == 2 else sides[0] if sides else versions.isNotNull()


@dataclass
class VersionSelector:
    include: list[Interval] = field(default_factory=list)
    exclude: list[Interval] = field(default_factory=list)
    #: Whether a selector that only excludes matches nothing else either.
    strict_include: bool = False

    @property
    def is_empty(self) -> bool:
        return not (self.include or self.exclude)

    def matches(self, version: str | Sequence[int]) -> bool:
        v = canonical(version)
        wanted = any(v in i for i in self.include) if self.include else not self.strict_include
        return wanted and not any(v in i for i in self.exclude)

    def column(self, version_col: Column | str) -> Column:
        versions = version_array(version_col)

        def one_of(intervals: list[Interval]) -> Column:
            found = F.lit(False)
            for i in intervals:
                found = found | i.column(versions)
            return found
        wanted = one_of(self.include) if self.include else F.lit(not self.strict_include)
        return wanted & ~one_of(self.exclude) if self.exclude else wanted


_ITEM = re.compile(r"(!?)([^:!]*)(?::([^:!]*))?")


def _items(conf, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], str]]:
    """The items of a selector with their places in its lists."""
    if isinstance(conf, str):
        yield from ((path, item.strip()) for item in conf.split(",") if item.strip())
    elif isinstance(conf, (list, tuple)):
        for k, sub in enumerate(conf):
            yield from _items(sub, (*path, k))
    elif conf is not None:
        raise VersionError(f"a version selector is text or a list, not {type(conf).__name__}")


def parse_selector(conf, strict_include: bool = False) -> VersionSelector:
    sel = VersionSelector(strict_include=strict_include)
    for path, item in _items(conf):
        where = f"selector entry {'.'.join(map(str, path))}: " if path else ""
        m = _ITEM.fullmatch(item)
        low, high = (m[2].strip(), m[3] if m[3] is None else m[3].strip()) if m else ("", None)
        if not low and high is None:
            raise VersionError(f"{where}cannot read {item!r}; expected a version or a range a:b")
        try:
            first = canonical(low) if low else None
            last = first if high is None else canonical(high) if high else None
        except VersionError as e:
            raise VersionError(f"{where}{e}") from None
        (sel.exclude if m[1] else sel.include).append(Interval(first, last))
    return sel


def filter_versions(df, selector, version_col: str = "version"):
    """O13 as a DataFrame filter; an empty selector keeps every row."""
    sel = selector if isinstance(selector, VersionSelector) else parse_selector(selector)
    return df if sel.is_empty else df.where(sel.column(F.col(version_col)))


def sort_versions(versions: Iterable[str], descending: bool = False) -> list[str]:
    return sorted(versions, key=canonical, reverse=descending)
