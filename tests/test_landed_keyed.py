"""The data source, the export sink, the bucketed store, the observed load, strict payloads and pruned scans."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from sondage.operators import stats, store
from sondage.operators.keyed import KeyedStore
from sondage.operators.observed import LoadWatch
from sondage.sources import export_sink, landed, raw
from sondage.streaming import stream

SCHEMA = "survey string, id string, submitted long, version string, data string"
DAY = 86400


def rows_of(spark, *rows):
    return spark.createDataFrame([(s, i, t, "1", f'{{"ID":"{i}"}}') for s, i, t in rows], SCHEMA)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_strict_payloads(spark):
    texts = ['{"ID":"a"}', ' {"ID":"a"} \n', "{}", '{"ID":"a"} x', '{"ID":"a"}{"ID":"b"}', "{'ID':'a'}", '{"ID":NaN}', '{"ID":"a"', "", "[1]", "7",
             '{"ID":"a"},{"ID":"b"}', '{"ID":"a"}],[{}', None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, data string").withColumn("m", raw.decode("data")).collect()
    assert {r.k for r in got if r.m is not None} == {0, 1, 2}


def test_landed_files_are_split_and_filtered(spark, tmp_path):
    lines = [{"survey": "s", "id": f"r{k}", "submitted": k, "version": "1", "data": "é" * (k % 50)} for k in range(500)]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(x) for x in lines[:400]) + "\n")
    (tmp_path / "b.json").write_text("\n".join(json.dumps(x) for x in lines[400:]) + "\nno json\n")
    (tmp_path / "_skipped.json").write_text("x")
    df = landed.read_landed(spark, str(tmp_path), splitBytes="1000")
    got = df.collect()
    assert sorted(r.id for r in got if r.id) == sorted(x["id"] for x in lines) and [r.data for r in got if r.id is None] == ["no json"]
    some = df.where((F.col("submitted") >= 390) & (F.col("submitted") < 410) & (F.col("survey") == "s"))
    assert some.count() == 20 and df.where(F.col("survey") == "other").count() == 0
    assert df.rdd.getNumPartitions() > 5


def test_a_failed_export_leaves_the_old_periods(spark, tmp_path):
    path, anchor = str(tmp_path / "out"), 0
    first = rows_of(spark, ("s", "a", 1), ("s", "b", 8 * DAY), ("t", "c", 2))
    export_sink.export_periods(first, path, anchor)
    before = sorted(map(tuple, export_sink.read_exported(spark, path, SCHEMA).collect()))
    bad = first.unionByName(rows_of(spark, (None, "x", 3)))  # belongs to no period
    with pytest.raises(Exception, match="belongs to no period"):
        export_sink.export_periods(bad, path, anchor)
    assert sorted(map(tuple, export_sink.read_exported(spark, path, SCHEMA).collect())) == before
    assert export_sink.remove_orphans(path) == 0
    export_sink.export_periods(rows_of(spark, ("s", "d", 5)), path, anchor)  # replaces one period of one survey
    assert sorted(r.id for r in export_sink.read_exported(spark, path, SCHEMA).collect()) == ["b", "c", "d"]
    assert sorted((r.survey, r.start, r.n) for r in export_sink.exported_catalog(spark, path).collect()) == [("s", 0, 1), ("s", 7 * DAY, 1), ("t", 0, 1)]
    assert [r.id for r in export_sink.read_exported(spark, path, SCHEMA, surveys=["s"], start=7 * DAY).collect()] == ["b"]


def test_keyed_store(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path / uuid.uuid4().hex), buckets=4)
    s.load(rows_of(spark, ("s", "a", 1), ("s", "b", DAY), ("s", None, 2)), "one", "replace")
    assert s.load(rows_of(spark, ("s", "a", 1)), "one", "replace")["rows"] == 3  # a load of that name was done
    s.load(rows_of(spark, ("s", "a", 5 * DAY), ("t", "a", 3), ("s", None, 4)), "two", "replace")  # a is dated anew
    rows = {("s", "a", 5 * DAY), ("s", "b", DAY), ("s", None, 4), ("t", "a", 3)}
    days = {("1970-01-06", "s", 1), ("1970-01-02", "s", 1), ("1970-01-01", "s", 1), ("1970-01-01", "t", 1)}
    for _ in range(2):
        assert {(r.survey, r.id, r.submitted) for r in s.current().collect()} == rows
        assert {(str(r.day), r.survey, r.n) for r in s.daily().collect()} == days
        s.compact()
    again = KeyedStore(spark, s.path)
    with pytest.raises(store.DuplicateKeyError):
        again.load(rows_of(spark, ("s", "b", 9)), "three", "plain")
    assert {(r.survey, r.id, r.submitted) for r in again.current().collect()} == rows
    assert [(r.name, r.added, r.replaced) for r in again.loads().collect()] == [("one", 3, 0), ("two", 3, 2)]


def test_stored_keys_are_not_shuffled(spark, tmp_path):
    """With the size rules off, the join's stored side has no exchange."""
    s = KeyedStore(spark, str(tmp_path / uuid.uuid4().hex), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    s.load(rows_of(spark, ("s", "a", 1)), "one")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = rows_of(spark, ("s", "b", 1)).withColumn("_key", F.concat("survey", "id")).repartition("_key")
        plan = plan_of(batch.join(s._newest(["submitted"]).withColumnRenamed("submitted", "old"), "_key", "left")).split("== Physical Plan ==")[1]
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_watched_load(spark, tmp_path):
    rows = rows_of(spark, ("s", "a", 1), ("s", "b", 9), ("t", "c", 3), (None, "d", 4)).withColumn(
        "data", F.when(F.col("id") == "b", "{").otherwise(F.col("data")))
    watch = LoadWatch(["s", "t", "u"], ["1", "2"])
    watch.watch(rows).write.parquet(str(tmp_path / "w"))
    assert [tuple(r)[:5] for r in watch.log(spark).collect()] == [("s", 1, 9, 2, 1), ("t", 3, 3, 1, 0), (None, 4, 4, 1, 0)]
    assert watch.rejects == 1 and [tuple(r) for r in watch.version_counts(spark).collect()] == [("s", "1", 2), ("t", "1", 1), (None, "1", 1)]


def test_scans_read_the_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = rows_of(spark, *[("s", f"r{k}", k * DAY) for k in range(9)], ("t", "x", DAY)).withColumn("day", raw.day_of(F.col("submitted")))
    store.write_keyed(spark, path, rows, ["survey", "id"], "ignore", ("survey", "day"))
    stored = store.read_keyed(spark, path)
    near = store._in_partitions(stored, rows.where("id = 'r3'"), ["survey", "day"])
    plan = plan_of(near).split("== Physical Plan ==")[1]
    assert [r.id for r in near.collect()] == ["r3"] and "PartitionFilters: []" not in plan and len(near.inputFiles()) <= len(stored.inputFiles())
    late = stats.daily_counts(stored, since="1970-01-08")
    plan = plan_of(late).split("== Physical Plan ==")[1]
    assert late.count() == 2 and "GreaterThanOrEqual(submitted" in plan


def test_a_restarted_stream_goes_on_behind_its_files(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "store")
    for k in range(2):
        stream.land_files(rows_of(spark, ("s", f"r{k}", k), ("s", "both", k)), f"{src}/part={k}")
        stream.ingest_stream(spark, src, out, fmt=landed.LANDED)
        if k == 0:
            for f in os.listdir(f"{src}/part=0"):
                if f.endswith(".json"):
                    os.rename(f"{src}/part=0/{f}", str(tmp_path / f"taken-{f}"))  # a file taken may go
    assert sorted((r.id, r.submitted) for r in store.read_keyed(spark, out).collect()) == [("both", 0), ("r0", 0), ("r1", 1)]
