"""Rename rules (O12, O14-O18) — the reference's literal cases, collisions and Column forms."""

import pytest
from pyspark.sql import functions as F

from sondage.functions.rename import (DuplicateColumnError, FixedRename, RegexRename, RenameChain, StripPrefix,
                                      default_chain, header_rename, rename_plan)

SEP = "|"


def test_strip_prefix_literals():
    r = StripPrefix(SEP)
    assert r.apply("intake.main.Q1") == "Q1"
    assert r.apply("intake.main.Q1|1") == "Q1|1"
    assert r.apply("Q2|mat.row1.col2") == "Q2|mat.row1.col2"


def test_regex_literals():
    assert RegexRename(r"<$>mat\.row(\d+)\.col(\d+)", r"<$>multi_row\1_col\2").apply("Q2|mat.row1.col2") == \
        "Q2|multi_row1_col2"
    assert RegexRename(r"<$>likert_(\d+)", r"<$>lk_\1").apply("Q10|likert_10") == "Q10|lk_10"
    # case-insensitive by default
    assert RegexRename(r"<$>LIKERT_(\d+)", r"<$>lk_\1").apply("Q10|likert_3") == "Q10|lk_3"


def test_fixed_literals():
    r = FixedRename.of({"Q12": "Q23b", "Q34": "Q26"})
    assert [r.apply(c) for c in ["Q1", "Q12", "Q34"]] == ["Q1", "Q23b", "Q26"]


def test_default_chain_on_fake_renamer_rows():
    ch = default_chain(SEP)
    assert ch.target("Q1|0") == "Q1_0"
    assert ch.target("Q2|2|open") == "Q2_2_open"
    assert ch.target("weekly.main.Q3|likert_2") == "Q3_lk_2"
    assert ch.target("ID") == "id" and ch.target("participantID") == "global_id"
    assert ch.target("submitted") == "timestamp" and ch.target("opened") == "opened"


def test_collision_is_an_error_unless_renamed():
    ch = default_chain(SEP)
    with pytest.raises(DuplicateColumnError):
        ch.plan(["weekly.main.Q10", "weekly.EX.Q10"])
    custom = RenameChain([RegexRename(r"EX\.Q", "EX_Q")])
    first = custom.plan(["weekly.main.Q10", "weekly.EX.Q10"])
    assert ch.plan(first.values()) == {"weekly.main.Q10": "Q10", "weekly.EX_Q10": "EX_Q10"}


def test_collision_is_case_insensitive():
    with pytest.raises(DuplicateColumnError):
        RenameChain([FixedRename.of({"a": "Q1"})]).plan(["a", "q1"])


def test_column_forms_match_driver_forms(spark):
    names = ["intake.main.Q1", "intake.main.Q1|1", "w.m.Q2|mat.row1.col2", "w.m.Q10|likert_10", "ID",
             "participantID", "submitted", "opened", "version", "a.b.c|x.y|z", "Q5", "x$y|likert_2"]
    df = spark.createDataFrame([(n,) for n in names], "source string")
    for chain in [default_chain(SEP), RenameChain([StripPrefix(SEP)]),
                  RenameChain([RegexRename(r"\$(\w)", r"_\1$")])]:
        got = dict(df.select("source", chain.column(F.col("source")).alias("t")).collect())
        assert got == {n: chain.target(n) for n in names}


def test_rename_plan_counts_sources(spark):
    df = spark.createDataFrame([("s", "1", "s.main.Q2"), ("s", "1", "s.EX.Q2"), ("s", "2", "s.main.Q2")],
                               "survey string, version string, source string")
    rows = {(r["version"], r["source"]): r["n_sources"]
            for r in rename_plan(df, default_chain(SEP), group=["survey", "version"]).collect()}
    assert rows == {("1", "s.main.Q2"): 2, ("1", "s.EX.Q2"): 2, ("2", "s.main.Q2"): 1}


def test_header_rename_is_case_sensitive(spark):
    df = spark.createDataFrame([(1, 2)], "Q1_0 int, q2_lk_1 int")
    out = header_rename(df, [(r"^Q(\d+)_", r"q\1_"), ("_lk_", "_likert_")])
    assert out.columns == ["q1_0", "q2_likert_1"]


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_part = st.sampled_from(["intake", "main", "weekly", "EX", "Q1", "Q10", "q2", "mat.row1.col2", "likert_3",
                         "LIKERT_12", "mat.row10.col2", "0", "open", "x$y", "a_b"])
_key = st.builds(lambda q, r, sep: ".".join(q) + (sep + "|".join(r) if r else ""),
                 st.lists(_part, min_size=1, max_size=3), st.lists(_part, max_size=2), st.just("|"))


@settings(max_examples=30, deadline=None)
@given(st.lists(_key, min_size=1, max_size=15, unique=True))
def test_column_form_equals_driver_form_property(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "source string")
    chain = default_chain(SEP)
    got = dict(df.select("source", chain.column(F.col("source")).alias("t")).collect())
    assert got == {n: chain.target(n) for n in names}


@pytest.mark.parametrize("rule", [(r"sé(\d+)", r"se\1"), (r"\w+É", "x"), ("straSSe", "road")])
def test_both_forms_fold_unicode_alike(spark, rule):
    names = ["SÉ12", "sé٣", "été_É1", "é", "STRASSE", "Q1", "Ünï|É"]
    r = RegexRename(*rule)
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", r.column(F.col("n")).alias("m"))
    assert {x["n"]: x["m"] for x in df.collect()} == {n: r.apply(n) for n in names}
