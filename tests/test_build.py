"""Version-dispatched build (O43-O46) on hand-made raw rows."""

import json

import pytest
from pyspark.sql import functions as F

from sondage.functions.rename import DuplicateColumnError
from sondage.plans import build as B
from sondage.plans.build import (build_flat, build_plan, build_rejects, discover_members, discover_schema, member_plans,
                                 order_processors, parse_profile)

RAW = "survey string, id string, submitted long, version string, data string"


def row(survey, rid, sub, version, **payload):
    base = {"ID": rid, "participantID": "p1", "version": version, "submitted": sub}
    base.update(payload)
    return (survey, rid, sub, version, json.dumps(base))


def profile(**kw):
    p = {"schema": {"s.main.Q1|0": "bool", "s.main.Q5": "json", "s.main.Q6": "date"}}
    p.update(kw)
    return p


def test_basic_build(spark):
    raw = spark.createDataFrame([
        row("s", "a", 100, "1-0-0", **{"s.main.Q1|0": "TRUE", "s.main.Q5": {"items": [{"key": "3"}]},
                                        "s.main.Q6": "86400", "s.main.Q3|likert_2": "x"}),
        row("s", "b", 200, "1-0-1", **{"s.main.Q1|0": "0", "s.main.Q6": ""}),
    ], RAW)
    out = build_flat(raw, profile())
    assert out.columns[:5] == ["survey", "id", "global_id", "version", "timestamp"]
    rows = {r["id"]: r for r in out.collect()}
    assert rows["a"]["Q1_0"] is True and rows["a"]["Q5"] == "3" and rows["a"]["Q3_lk_2"] == "x"
    assert rows["a"]["Q6"].year == 1970 and rows["b"]["Q6"] is None and rows["b"]["Q1_0"] is False
    assert rows["b"]["Q3_lk_2"] is None and rows["b"]["timestamp"].timestamp() == 200


def test_collision_needs_the_version_rule(spark):
    raw = spark.createDataFrame([row("s", "a", 1, "2-0-0", **{"s.main.Q2": "1", "s.EX.Q2": "x"}),
                                 row("s", "b", 1, "1-0-0", **{"s.main.Q2": "2"})], RAW)
    with pytest.raises(DuplicateColumnError):
        build_flat(raw, profile())
    rule = {"name": "rename", "rules": [{"regex": {r"EX\.Q": "EX_Q"}}], "version": "2-0-0"}
    out = {r["id"]: r for r in build_flat(raw, profile(processors=[rule])).collect()}
    assert out["a"]["EX_Q2"] == "x" and out["a"]["Q2"] == "1" and out["b"]["Q2"] == "2"


def test_same_key_renamed_differently_per_version(spark):
    raw = spark.createDataFrame([row("s", "a", 1, "2-0-0", **{"s.main.Q9": "new"}),
                                 row("s", "b", 1, "1-0-0", **{"s.main.Q9": "old"})], RAW)
    rule = {"name": "rename", "rules": [{"fixed": {"s.main.Q9": "s.main.Q9v2"}}], "version": "2-0-0:"}
    out = {r["id"]: r for r in build_flat(raw, profile(processors=[rule])).collect()}
    assert out["a"]["Q9v2"] == "new" and out["a"]["Q9"] is None
    assert out["b"]["Q9"] == "old" and out["b"]["Q9v2"] is None


def test_cast_limited_to_a_version_types_the_column(spark):
    raw = spark.createDataFrame([row("s", "a", 1, "2-0-0", **{"s.main.Q7": "1", "s.main.Q8": "5"}),
                                 row("s", "b", 1, "1-0-0", **{"s.main.Q7": "x", "s.main.Q8": 7}),
                                 row("s", "c", 1, "1-0-0", **{"s.main.Q7": "FALSE", "s.main.Q8": 8})], RAW)
    rules = [{"name": "to_bool", "columns": ["s.main.Q7"], "version": "2-0-0"}, {"name": "to_date", "columns": ["s.main.Q8"], "version": "2-0-0"}]
    out = {r["id"]: r for r in build_flat(raw, profile(processors=rules)).collect()}
    assert [out[i]["Q7"] for i in "abc"] == [True, None, False]
    assert [out[i]["Q8"].timestamp() for i in "abc"] == [5, 7, 8]


def test_profile_versions_filter_rows(spark):
    raw = spark.createDataFrame([row("s", "a", 1, "2-0-0"), row("s", "b", 1, "1-0-0")], RAW)
    assert [r["id"] for r in build_flat(raw, profile(versions="!1-0-0")).collect()] == ["a"]


def test_time_range(spark):
    raw = spark.createDataFrame([row("s", "a", 10, "1"), row("s", "b", 20, "1"), row("s", "c", 30, "1")], RAW)
    assert sorted(r["id"] for r in build_flat(raw, profile(start_time=20)).collect()) == ["b", "c"]
    assert sorted(r["id"] for r in build_flat(raw, profile(start_time=10, end_time=20)).collect()) == ["a", "b"]


def test_bad_json_left_out(spark):
    good = row("s", "a", 1, "1")
    raw = spark.createDataFrame([good, ("s", "b", 1, "1", '{"ID": "b", "trunc'), ("s", "c", 1, "1", "[1]"),
                                 ("s", "d", 1, "1", "")], RAW)
    assert [r["id"] for r in build_flat(raw, profile()).collect()] == ["a"]


def test_dedupe_first_by_version_then_time(spark):
    raw = spark.createDataFrame([row("s", "a", 5, "1-0-10", **{"s.main.Q2": "late-version"}),
                                 row("s", "a", 9, "1-0-2", **{"s.main.Q2": "keep"}),
                                 row("s", "a", 1, "1-0-2", **{"s.main.Q2": "earliest"}),
                                 row("s", "b", 1, "1-0-2", **{"s.main.Q2": "solo"})], RAW)
    out = {r["id"]: r["Q2"] for r in build_flat(raw, profile()).collect()}
    assert out == {"a": "earliest", "b": "solo"}
    assert build_flat(raw, profile(dedupe=False)).count() == 4


def test_truncated_copy_does_not_displace_a_whole_one(spark):
    whole = row("s", "a", 9, "1-0-2", **{"s.main.Q2": "whole"})
    raw = spark.createDataFrame([whole, ("s", "a", 1, "1-0-1", whole[4][:12]), ("s", "b", 1, "1-0-1", "{"), ("s", "b", 2, "1-0-1", None),
                                 ("s", None, 3, "1-0-2", whole[4]), ("s", None, 4, "1-0-2", whole[4])], RAW)
    out = build_flat(raw, profile())
    assert [(r["id"], r["Q2"]) for r in out.collect()] == [("a", "whole")] * 2  # the payload's own id; a null key is one key
    bad = {(r["id"], r["submitted"]): r["lost"] for r in build_rejects(raw, profile()).collect()}
    assert bad == {("a", 1): False, ("b", 1): True, ("b", 2): True}


def test_stale_key_catalog_is_an_error(spark):
    raw = spark.createDataFrame([row("s", "a", 1, "1", **{"s.main.Q1": "x"}), row("s", "b", 1, "2", **{"s.main.Q2": "y"})], RAW)
    keys = discover_members(raw)
    assert build_flat(raw, profile(keys=keys)).count() == 2
    for stale in ({m: k for m, k in keys.items() if m[1] == "1"}, {m: [x for x in k if x != "s.main.Q2"] for m, k in keys.items()}):
        with pytest.raises(Exception, match="missing from the key catalog.*s.main.Q2"):
            build_flat(raw, profile(keys=stale)).collect()
        assert build_flat(raw, profile(keys=stale, verify_keys=False)).count() == 2


def test_numbers_become_number_columns(spark):
    raw = spark.createDataFrame([row("s", "a", 1, "1", i=5, f=1, t=2, m=1), row("s", "b", 2, "1", i=None, f=2.5, t="2", m=True)], RAW)
    out = build_flat(raw, profile())
    types = dict(out.dtypes)
    assert (types["i"], types["f"], types["t"], types["m"], types["timestamp"]) == ("bigint", "double", "string", "string", "timestamp")
    got = {r["id"]: (r["i"], r["f"], r["t"], r["m"]) for r in out.collect()}
    assert got == {"a": (5, 1.0, "2", "1"), "b": (None, 2.5, "2", "true")}
    assert discover_schema(raw)[1] == {"i": "int", "f": "float", "submitted": "int"}
    as_text = build_flat(raw, profile(infer_numbers=False, schema={"f": "float"}))
    assert (dict(as_text.dtypes)["i"], dict(as_text.dtypes)["f"]) == ("string", "double")


def test_schema_has_a_limit(spark, monkeypatch):
    from sondage import functions
    monkeypatch.setattr(functions, "MAX_SCHEMA_ENTRIES", 3)
    with pytest.raises(functions.SchemaSizeError):
        build_flat(spark.createDataFrame([row("s", "a", 1, "1")], RAW), profile())


def test_custom_processors_run_at_their_place_for_their_versions(spark):
    raw = spark.createDataFrame([row("s", "a", 1, "1-0", **{"s.main.Q1": "x", "s.main.Q1|0": "1"}),
                                 row("s", "b", 1, "2-0", **{"s.main.Q1": "y", "s.main.Q1|0": "0"})], RAW)
    early = {"name": "custom", "version": "2-0", "position": "before_casting",
             "fn": lambda d: d.withColumn("s.main.N|1", F.concat(F.lit("n"), F.col("`s.main.Q1`"))).withColumn("s.main.Q1|0", F.lit("TRUE"))}
    late = {"name": "custom", "position": "end", "fn": lambda d: d.withColumn("Q1", F.upper("Q1"))}
    out = build_flat(raw, profile(processors=[late, early]))
    got = {r["id"]: (r["Q1"], r["N_1"], r["Q1_0"]) for r in out.collect()}
    assert got == {"a": ("X", None, True), "b": ("Y", "ny", True)}
    with pytest.raises(ValueError, match="must keep"):
        build_flat(raw, profile(processors=[{"name": "custom", "fn": lambda d: d.select("ID")}]))


def test_defaults_by_name(spark):
    raw = spark.createDataFrame([row("s", "a", 1, "1", **{"s.main.Q1|0": "1"})], RAW)
    whole = build_flat(raw, profile())
    named = build_flat(raw, profile(processors_defaults=False, processors=["default_renaming", "default_casting"]))
    assert sorted(map(tuple, named.collect())) == sorted(map(tuple, whole.collect()))
    assert dict(build_flat(raw, profile(processors_defaults=False, processors=["default_renaming"])).dtypes)["Q1_0"] == "string"
    with pytest.raises(ValueError, match="unknown default"):
        parse_profile({"processors": ["default_nothing"]})


def test_processor_order_is_by_position():
    prof = parse_profile({"processors": [
        {"name": "rename", "rules": [{"fixed": {"a": "b"}}], "position": "end"},
        {"name": "to_bool", "columns": ["x"], "position": "before_casting"}]})
    assert [p.position for p in prof.processors] == \
        ["before_casting", "default_casting", "default_renaming", "end"]
    assert order_processors(prof.processors) == prof.processors


def test_member_plans_per_version():
    prof = parse_profile(profile(processors=[{"name": "rename", "rules": [{"regex": {r"EX\.Q": "EX_Q"}}],
                                              "version": "2-0-0"}]))
    plans = member_plans({("s", "1-0-0"): ["s.main.Q2"], ("s", "2-0-0"): ["s.main.Q2", "s.EX.Q2"]}, prof)
    assert set(plans[("s", "2-0-0")]) == {"Q2", "EX_Q2"} and set(plans[("s", "1-0-0")]) == {"Q2"}


def test_build_twice_equals_once_and_plan(spark):
    raw = spark.createDataFrame([row("s", "a", 1, "1"), row("t", "a", 2, "1"), row("t", "b", 3, "1")], RAW)
    once = build_flat(raw, profile())
    twice = build_flat(raw.unionByName(raw), profile())
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    plan = build_plan(raw, {"profiles": {"p": profile()}, "surveys": [{"survey": "s", "profile": "p"},
                                                                        {"survey": "t", "profile": "p"}]})
    assert {k: v.count() for k, v in plan.items()} == {"s": 1, "t": 2}


def test_discover_members(spark):
    raw = spark.createDataFrame([row("s", "a", 1, "1", **{"k1": "x"}), row("s", "b", 1, "2", **{"k2": "y"})], RAW)
    m = discover_members(raw)
    assert "k1" in m[("s", "1")] and "k2" in m[("s", "2")] and "k2" not in m[("s", "1")]


def test_empty_input(spark):
    raw = spark.createDataFrame([], RAW)
    out = build_flat(raw, profile())
    assert out.count() == 0 and "id" in out.columns


def test_versions_of_unequal_length_dispatch(spark):
    raw = spark.createDataFrame([row("s", "a", 1, "2", **{"s.main.Q1": "x"}),
                                 row("s", "b", 1, "2-0-1", **{"s.main.Q1": "y"}),
                                 row("s", "c", 1, "1-9", **{"s.main.Q1": "z"})], RAW)
    rule = {"name": "rename", "rules": [{"fixed": {"s.main.Q1": "s.main.Q1new"}}], "version": "2-0-0"}
    out = {r["id"]: (r["Q1"], r["Q1new"]) for r in build_flat(raw, profile(processors=[rule])).collect()}
    # "2" equals "2-0-0" (missing parts are 0); "2-0-1" and "1-9" do not.
    assert out == {"a": (None, "x"), "b": ("y", None), "c": ("z", None)}


def test_stats_on_empty_states(spark):
    from sondage.operators import stats as ST
    empty = spark.createDataFrame([], "participantId string, studyStatus string, flags map<string,string>")
    assert ST.flag_counts(empty).count() == 0
    r = ST.flag_summary(empty, "x").first()
    assert r["n"] == 0 and r["mean"] is None


def test_plan_file_forms(spark, tmp_path):
    import json as _json

    from sondage.plans.build import load_spec, run_build_plan
    raw = spark.createDataFrame([row("s", "a", 1, "1", **{"s.main.Q1|0": "1"}), row("t", "b", 2, "1"),
                                 row("u", "c", 3, "1")], RAW)
    (tmp_path / "t.json").write_text(_json.dumps({"schema": {"t.main.Q9": "bool"}}))
    (tmp_path / "plan.yaml").write_text(
        "profiles:\n  std:\n    schema:\n      s.main.Q1|0: bool\n"
        "surveys:\n  s: std\n  t: '@t.json'\n  u: ~\n")
    plan = load_spec(str(tmp_path / "plan.yaml"))
    got = {k: v.count() for k, v in build_plan(raw, plan, base_dir=str(tmp_path)).items()}
    assert got == {"s": 1, "t": 1, "u": 1}
    assert build_plan(raw, plan, base_dir=str(tmp_path))["s"].first()["Q1_0"] is True
    reg = run_build_plan(spark, raw, plan, str(tmp_path / "out"), base_dir=str(tmp_path))
    assert sorted((r["table"], r["rows_written"]) for r in reg.collect()) == \
        [("pollster_results_s", 1), ("pollster_results_t", 1), ("pollster_results_u", 1)]
    again = run_build_plan(spark, raw, plan, str(tmp_path / "out"), base_dir=str(tmp_path))
    assert all(r["rows_written"] == 0 for r in again.collect())  # building twice adds nothing
    from sondage.operators.store import read_keyed
    assert read_keyed(spark, str(tmp_path / "out" / B.REGISTRY_TABLE)).count() == 3
    assert [tuple(r) for r in read_keyed(spark, str(tmp_path / "out" / B.DIMENSION_TABLE)).collect()] == [(1, "p1")]
    with pytest.raises(KeyError):
        build_plan(raw, {"surveys": {"s": "missing"}})


def test_schema_inference_precedence(spark):
    from sondage.plans.build import infer_column_types
    si = spark.createDataFrame([("s", "1-0-0", "s.main.Q1", "multiple", 1), ("s", "2-0-0", "s.main.Q1", "single", 2),
                                ("s", "1-0-0", "s.main.Q2", "multiple", 1), ("s", "1-0-0", "s.main.Q3", "unknown", 1)],
                               "survey string, version string, column string, questionType string, published long")
    inferred = infer_column_types(si)
    assert inferred == {"s": {"s.main.Q1": "text", "s.main.Q2": "bool", "s.main.Q3": "json"}}
    raw = spark.createDataFrame([row("s", "a", 1, "1", **{"s.main.Q1": "1", "s.main.Q2": "0", "s.main.Q3": "x"})], RAW)
    out = build_flat(raw, {"inferred_schema": inferred, "schema": {"s.main.Q1": "bool"}}).first()
    # profile overrides the inferred text type; inferred bool applies; json of a non-object is null
    assert out["Q1"] is True and out["Q2"] is False and out["Q3"] is None


def test_dedupe_ties_are_deterministic(spark):
    rows = [row("s", "a", 5, "1", **{"s.main.Q2": v}) for v in ["zz", "aa", "mm"]]
    for order in (rows, list(reversed(rows))):
        raw = spark.createDataFrame(order, RAW)
        assert [r["Q2"] for r in build_flat(raw, profile()).collect()] == ["aa"]


def test_wide_long_wide_identity(spark):
    from sondage.operators.reshape import long_to_wide, wide_to_long
    wide = spark.createDataFrame([("a", "1", None, "x"), ("b", None, "2", "y")], "id string, p string, q string, r string")
    back = long_to_wide(wide_to_long(wide, ["id"]), ["id"], keys=["p", "q", "r"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))


def test_keys_differing_only_in_case(spark):
    raw = spark.createDataFrame([row("s", "a", 1, "1", **{"s.main.Q1": "x", "s.main.q1|1": "y"}),
                                 row("s", "b", 1, "1", **{"s.main.q1": "z"})], RAW)
    rule = {"name": "rename", "rules": [{"fixed": {"s.main.q1": "s.main.Q1b"}}]}
    out = {r["id"]: (r["Q1"], r["q1_1"], r["Q1b"]) for r in build_flat(raw, profile(processors=[rule])).collect()}
    assert out == {"a": ("x", "y", None), "b": (None, None, "z")}


def test_zlib_compressed_raw_store(spark):
    import zlib
    plain = [row("s", "a", 1, "1", **{"s.main.Q1|0": "1"}), row("s", "b", 2, "1", **{"s.main.Q1|0": "0"})]
    packed = [(s_, i, t, v, bytearray(zlib.compress(d.encode()))) for s_, i, t, v, d in plain]
    raw = spark.createDataFrame(packed, "survey string, id string, submitted long, version string, data binary")
    out = {r["id"]: r["Q1_0"] for r in build_flat(raw, profile(compressor="zlib")).collect()}
    assert out == {"a": True, "b": False}


def test_zstd_compressed_raw_store(spark):
    zstandard = pytest.importorskip("zstandard")
    plain = [row("s", "a", 1, "1", **{"s.main.Q1|0": "1"}), row("s", "b", 2, "1", **{"s.main.Q1|0": "0"})]
    packed = [(s_, i, t, v, bytearray(zstandard.compress(d.encode()))) for s_, i, t, v, d in plain] + [("s", "c", 1, "1", bytearray(b"x"))]
    raw = spark.createDataFrame(packed, "survey string, id string, submitted long, version string, data binary")
    out = {r["id"]: r["Q1_0"] for r in build_flat(raw, profile(compressor="zstd")).collect()}
    assert out == {"a": True, "b": False}


def test_plan_shared_discovery_respects_versions(spark):
    raw = spark.createDataFrame([row("s", "a", 1, "1", **{"s.main.Old": "x"}), row("s", "b", 1, "2", **{"s.main.New": "y"})],
                                RAW)
    plan = {"surveys": {"s": {"versions": "2"}}}
    out = build_plan(raw, plan)["s"]
    assert "New" in out.columns and "Old" not in out.columns and out.count() == 1


def test_rename_excluded_is_honoured(spark):
    raw = spark.createDataFrame([row("s", "a", 1, "1", **{"s.main.Q1": "x", "s.main.Q2": "y"})], RAW)
    rule = {"name": "rename", "rules": [{"regex": {r"main\.Q": "main.R"}}], "excluded": ["s.main.Q2"]}
    out = build_flat(raw, profile(processors=[rule]))
    assert "R1" in out.columns and "Q2" in out.columns and "Q1" not in out.columns
