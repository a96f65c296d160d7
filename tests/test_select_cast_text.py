"""Column selectors (O19, O20), casts (O21, O24-O28) and text functions."""

import math

import pytest
from pyspark.sql import functions as F

from sondage.functions import cast as C
from sondage.functions import text as TX
from sondage.functions.select import ColumnSelector, project_fields, select_columns


def test_selector_literals():
    assert ColumnSelector(["Q12", "Q15", "intake.main.Q2"]).select(["Q2", "Q15"]) == ["Q15"]
    glob = ColumnSelector([{"glob": ["*.Q2", "Q10*"]}])
    assert glob.select(["intake.main.Q2", "Q15"]) == ["intake.main.Q2"]
    assert glob.select(["Q2", "Q10c", "Q10d", "Q10_2"]) == ["Q10c", "Q10d", "Q10_2"]


def test_regex_selector_is_anchored_and_keeps_table_order():
    sel = ColumnSelector([{"re": r"Q1\d"}, "a"])
    assert sel.select(["Q12", "a", "xQ13", "Q1"]) == ["Q12", "a"]


def test_select_and_project(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Q1 int, Q2 int, other int")
    assert select_columns(df, [{"glob": "Q*"}]).columns == ["Q1", "Q2"]
    assert project_fields(df, {"x": "Q2"}).first()["x"] == 2
    with pytest.raises(KeyError):
        project_fields(df, ["missing"])


def test_to_bool_edges(spark):
    df = spark.createDataFrame([(x,) for x in ["1", "0", "TRUE", "false", "", None]], "v string")
    got = [r[0] for r in df.select(C.to_bool("v")).collect()]
    assert got == [True, False, True, False, None, None]
    bad = spark.createDataFrame([("yes",)], "v string")
    assert bad.select(C.to_bool("v", "null")).first()[0] is None
    with pytest.raises(Exception):
        bad.select(C.to_bool("v", "error")).collect()


def test_epoch_edges(spark):
    vals = ["1704067200", " 1704067200 ", "1704067200.5", "", None, "nan", "inf", "1d", "abc", "1e3"]
    df = spark.createDataFrame([(x,) for x in vals], "v string")
    got = [r[0] for r in df.select(F.unix_micros(C.epoch_to_timestamp("v"))).collect()]
    assert got == [1704067200000000, 1704067200000000, 1704067200500000, None, None, None, None, None, None,
                   1000000000]


def test_parse_number_like_python_float(spark):
    vals = ["1.5", " 2 ", "nan", "-inf", "1e2", "1_000", "1d", "abc", "", None, "1__0", "_1"]
    df = spark.createDataFrame([(x,) for x in vals], "v string")
    got = [r[0] for r in df.select(C.parse_number("v")).collect()]
    assert got[0] == 1.5 and got[1] == 2.0 and math.isnan(got[2]) and got[3] == float("-inf")
    assert got[4] == 100.0 and got[5] == 1000.0 and got[6:] == [None] * 6


def test_json_item_keys_edges(spark):
    vals = ['{"items":[{"key":"a"},{"key":"b"}]}', '{"items":[]}', "{}", "", None, '{"items":', "[1]"]
    df = spark.createDataFrame([(x,) for x in vals], "v string")
    got = [r[0] for r in df.select(C.json_item_keys("v")).collect()]
    assert got == ["a,b", None, None, "", None, None, None]


def test_schema_cast_ignores_absent(spark):
    df = spark.createDataFrame([("1", '{"items":[{"key":"x"}]}', "0")], "b string, j string, d string")
    out = C.schema_cast(df, {"b": "bool", "j": "json", "d": "date", "zz": "bool", "t": "text"})
    r = out.first()
    assert r["b"] is True and r["j"] == "x" and r["d"].year == 1970


def test_json_flatten(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": 2}')], "id int, j string")
    out = C.json_flatten(df, "j")
    assert out.columns == ["id", "j_a", "j_b"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "1", "x"), (2, "2", None)]


def test_localized_text_and_map(spark):
    df = spark.createDataFrame([([("en", [("Hello",), ("world",)]), ("fr", [("Bonjour",)])],)], f"t {TX.LOCALIZED_TYPE}")
    r = df.select(TX.localized_text("t", "fr").alias("fr"), TX.localized_text("t").alias("all")).first()
    assert r["fr"] == ["Bonjour"]
    assert r["all"] == ["[en]  Hello world", "[fr]  Bonjour"]
    m = spark.createDataFrame([({"en": "Hi"},)], "m map<string,string>")
    assert m.select(TX.localize_map("m").alias("x")).first()["x"][0]["parts"][0]["str"] == "Hi"


def test_published_iso_and_midnight(spark):
    df = spark.createDataFrame([("1704067261",), ("0",), ("x",), (None,), ("-5",)], "p string")
    assert [r[0] for r in df.select(TX.published_iso("p")).collect()] == \
        ["2024-01-01T00:01:01", "Unknown", "Unknown", "Unknown", "Unknown"]
    ts = spark.createDataFrame([(1704070000,)], "s long").select(F.timestamp_seconds("s").alias("t"))
    assert ts.select(F.unix_seconds(TX.midnight_floor("t"))).first()[0] == 1704067200


def test_recode_keeps_json_types(spark):
    from sondage.sources.raw import recode_json
    rows = ['{"o":{"k":"TRUE"},"n":5,"a":"TRUE","b":"FALSE","c":"True","d":null,"f":2.5,"l":["TRUE"],"t":"5","q":"say \\"TRUE\\""}', "[1]", "{", "", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "d string").select(recode_json("d")).collect()]
    assert got[0] == '{"o":{"k":"TRUE"},"n":5,"a":true,"b":false,"c":"True","d":null,"f":2.5,"l":["TRUE"],"t":"5","q":"say \\"TRUE\\""}'
    assert got[1:] == rows[1:]


def test_published_iso_over_all_lengths(spark):
    from sondage.functions.text import published_iso
    cases = {"0": "Unknown", "-5": "Unknown", "1": "1970-01-01T00:00:01", "1704067200": "2024-01-01T00:00:00", "253402300799": "9999-12-31T23:59:59",
             "253402300800": "Unknown", "1704067200123": "Unknown", "170406720012345678": "Unknown", "9" * 30: "Unknown", "x": "Unknown", None: "Unknown", " 7 ": "1970-01-01T00:00:07"}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", published_iso("s").alias("t"))
    assert {r["s"]: r["t"] for r in df.collect()} == cases


def test_project_fields_checks_the_schema(spark):
    from sondage.functions.select import project_fields
    df = spark.createDataFrame([(1, {"k": "v"}, (2,))], "a int, m map<string,string>, s struct<b: int>")
    assert project_fields(df, {"x": "s.b", "y": "m.k"}).first().asDict() == {"x": 2, "y": "v"}
    for missing in ("z", "s.c", "a.b"):
        with pytest.raises(KeyError):
            project_fields(df, [missing])
