"""Version parsing, comparison and selectors (O05, O13) — the reference's literal cases first."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sondage.functions.versions import (VersionError, compare_versions, filter_versions, parse_selector,
                                        parse_version, sort_versions, version_array)


def test_parse_and_compare_literals():
    v = parse_version("25-10-1")
    assert v == (25, 10, 1)
    assert compare_versions("25-10-1", "25-10-1") == 0
    assert compare_versions("25-10-1", "25-10-2") != 0
    assert compare_versions("25-10-1", "26-2-10") != 0
    for other in ["25-10-1", "25-10-2", "25-2-2"]:
        assert not compare_versions("25-0-0", other) > 0
        assert compare_versions("25-0-0", other) < 0


def test_missing_positions_are_zero():
    assert compare_versions("25-1", "25-1-0") == 0
    assert compare_versions("25-1", "25-1-1") < 0


def test_non_integer_is_error():
    with pytest.raises(VersionError):
        parse_version("25-a-1")


def test_selector_eq_and_range_literals():
    eq = parse_selector("25-10-1")
    assert [eq.matches(v) for v in ["24-1-12", "25-10-2", "25-10-1"]] == [False, False, True]
    rng = parse_selector("25-0-0:25-12-99")
    assert [rng.matches(v) for v in ["24-1-12", "25-10-2", "25-10-1", "23-10-12", "25-2-2"]] == \
        [False, True, True, False, True]


def test_selector_open_ranges_exclusion_and_lists():
    sel = parse_selector(["24-2-1:", ["!24-4-1:24-4-9"]])
    assert sel.matches("24-3-1") and not sel.matches("24-4-2") and not sel.matches("24-1-9")
    assert parse_selector(":24-1-5").matches("1-0-0")
    # Only exclusions: everything else matches (documented meaning) ...
    only_excl = parse_selector("!24-1-4")
    assert only_excl.matches("24-1-1") and not only_excl.matches("24-1-4")
    # ... unless the strict include behaviour is asked for.
    assert not parse_selector("!24-1-4", strict_include=True).matches("24-1-1")
    assert parse_selector("24-1-1, 24-1-3").matches("24-1-3")


def test_sort_versions():
    assert sort_versions(["24-10-1", "24-2-1", "24-2", "3-99"]) == ["3-99", "24-2", "24-2-1", "24-10-1"]


def test_version_array_pads(spark):
    df = spark.createDataFrame([("25-1",), ("25-1-0",), ("25-1-1",)], "v string")
    rows = df.select(version_array(F.col("v")).alias("a")).collect()
    assert rows[0]["a"] == rows[1]["a"] and rows[0]["a"] < rows[2]["a"]


versions = st.lists(st.integers(0, 30) | st.integers(2**31, 10**20), min_size=1, max_size=9).map(lambda xs: "-".join(map(str, xs)))


@settings(max_examples=25, deadline=None)
@given(st.lists(versions, min_size=1, max_size=12), versions, versions, versions)
def test_column_form_matches_driver_form(spark, vs, lo, hi, ex):
    sel = parse_selector(f"{lo}:{hi}, !{ex}")
    df = spark.createDataFrame([(v,) for v in vs], "version string")
    got = sorted(r[0] for r in filter_versions(df, sel).collect())
    assert got == sorted(v for v in vs if sel.matches(v))


def test_long_versions_and_large_parts(spark):
    vs = ["24-1-20240101120000", "24-1-20240101120001", "1-2-3-4-5-6-7", "1-2-3-4-5-6-7-0-0", "1-2-3-4-5-6-7-8-9", "0", "0-0", "24"]
    df = spark.createDataFrame([(v,) for v in vs], "version string")
    order = [r[0] for r in df.orderBy(version_array("version"), "version").collect()]
    assert order == ["0", "0-0", "1-2-3-4-5-6-7", "1-2-3-4-5-6-7-0-0", "1-2-3-4-5-6-7-8-9", "24", "24-1-20240101120000", "24-1-20240101120001"]
    assert sort_versions(vs) == sorted(vs, key=order.index) or sort_versions(vs)[-1] == order[-1]
    kept = {r[0] for r in filter_versions(df, "1-2-3-4-5-6-7:24-1-20240101120000, !24").collect()}
    assert kept == {"24-1-20240101120000", "1-2-3-4-5-6-7", "1-2-3-4-5-6-7-0-0", "1-2-3-4-5-6-7-8-9"}


@pytest.mark.parametrize("bad", ["a", "1:2:3", "!", "1-x", "24-1:b", ["24", ["!"]], 5, "1!2", "!!1"])
def test_bad_selectors(bad):
    with pytest.raises(VersionError):
        parse_selector(bad)


def test_open_intervals():
    assert parse_selector(":").matches("1") and parse_selector("24:").matches("99-1") and not parse_selector(":24").matches("24-0-1")
    assert parse_selector(":24").matches("24-0-0") and parse_selector(" ! 24-1 : 24-2 ").exclude
