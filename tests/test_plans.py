"""Plan-shape regressions: the properties that matter at scale, asserted on the physical plan."""

import json
import re


from sondage.operators import store as SO
from sondage.plans.build import build_flat

RAW = "survey string, id string, submitted long, version string, data string"


def _raw(spark, n=200):
    rows = [("s", f"r{i}", i, f"1-0-{i % 3}", json.dumps({"ID": f"r{i}", "participantID": "p", "version": "1",
                                                           "submitted": i, "s.main.Q1|0": "1",
                                                           "s.main.Q5": {"items": [{"key": "a"}]}}))
            for i in range(n)]
    return spark.createDataFrame(rows, RAW)


def _static_plan(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _schema():
    return {"schema": {"s.main.Q1|0": "bool", "s.main.Q5": "json"}}


def test_build_shuffles_once_by_key_and_not_at_all_over_a_keyed_store(spark):
    plan = _static_plan(spark, build_flat(_raw(spark), _schema()))
    assert plan.count("Exchange") == 1 and plan.count("WindowGroupLimit") == 2  # one row per key in each task, then of all
    assert "Exchange" not in _static_plan(spark, build_flat(_raw(spark), {**_schema(), "dedupe": False}))


def test_build_parses_the_payload_once(spark):
    df = build_flat(_raw(spark), _schema())
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    # one parse of the payload, one of the JSON-typed column
    assert optimized.count("from_json") == 2


def test_build_projection_is_whole_stage_codegen(spark):
    plan = _static_plan(spark, build_flat(_raw(spark), _schema()))
    top = plan.split("\n")[0]
    assert re.match(r"\*\(\d+\) Project", top), top


def test_one_plan_with_and_without_duplicates(spark):
    df = _raw(spark)
    dup = df.unionByName(df)
    assert SO.first_per_key(dup, ["survey", "id"]).count() == SO.first_per_key(df, ["survey", "id"]).count() == 200
    assert _static_plan(spark, SO.first_per_key(dup, ["survey", "id"])).count("Exchange") == 1


def test_upsert_moves_each_side_once(spark):
    df = _raw(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _static_plan(spark, SO.upsert(df, df, ["survey", "id"], "ignore"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 3 and "BroadcastExchange" not in plan


def test_numbering_has_no_window_over_all_rows(spark):
    ids = spark.range(1000).selectExpr("concat('g', id) as g")
    df = SO.dense_index(spark, ids, "g")
    assert "Window" not in _static_plan(spark, df) and df.agg({"idx": "max"}).first()[0] == 1000


def test_keyed_append_scans_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "k")
    first = spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], "survey string, id string, v int")
    SO.write_keyed(spark, path, first, ["survey", "id"])
    batch = spark.createDataFrame([("a", "2", 2)], "survey string, id string, v int")
    target = SO.read_keyed(spark, path)
    scope = target.join(batch.select("survey").distinct(), ["survey"], "left_semi")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = scope._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "dynamicpruningexpression" in plan.lower() or "PartitionFilters: [isnotnull(survey" in plan
