"""Work that must not grow faster than the input: micro-batches, files of a load, splits, casts in a plan."""

import json
import os

from pyspark.sql import functions as F

from sondage.functions import cast
from sondage.operators import store
from sondage.plans import build
from sondage.plans import registry
from sondage.sources import fixtures, landed
from sondage.streaming import stream

SCHEMA = "survey string, id string, submitted long, version string, data string"
DAY = 86400


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_land_in_a_number_of_files(spark, tmp_path):
    rows = spark.range(40_000).select(F.lit("s").alias("survey"), F.col("id").cast("string"), F.col("id").alias("submitted"),
                                      F.lit("1").alias("version"), F.lit("{}").alias("data"))
    path = stream.land_files(rows, str(tmp_path / "in"), files=registry.LANDED_FILES)
    assert sum(f.endswith(".json") for f in os.listdir(path)) == registry.LANDED_FILES
    assert spark.read.schema(SCHEMA).json(path).count() == 40_000


def test_a_load_adds_few_files_to_a_partition(spark, tmp_path):
    rows = spark.range(0, 400, 1, 8).select(F.lit("s").alias("survey"), F.col("id").cast("string"), (F.col("id") % 5 * DAY).alias("submitted"),
                                            F.lit("1").alias("version"), F.lit("{}").alias("data"))
    path = str(tmp_path / "store")
    assert stream.ingest_batch(spark, rows, path) == 400
    files = [f for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(files) == 5 and store.read_keyed(spark, path).count() == 400


def test_small_landed_files_share_a_task(spark, tmp_path):
    for k in range(60):
        line = {"survey": "s", "id": f"r{k}", "submitted": k, "version": "1", "data": "{}"}
        (tmp_path / f"{k:02d}.json").write_text(json.dumps(line) + "\n")
    df = landed.read_landed(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 1 and sorted(r.id for r in df.collect()) == sorted(f"r{k}" for k in range(60))
    kept = str(tmp_path / "kept")
    stream.ingest_stream(spark, str(tmp_path), kept, fmt=landed.LANDED)
    assert store.read_keyed(spark, kept).count() == 60


def test_casts_do_not_grow_with_the_surveys(spark):
    def flat(surveys):
        raw = spark.createDataFrame([(s, s + "1", 1, "1", json.dumps({f"{s}.main.Q6": "5"})) for s in surveys], SCHEMA)
        return build.build_flat(raw, {"schema": {f"{s}.main.Q6": "date" for s in surveys}})

    assert plan_of(flat("a")).count("regexp_extract") == plan_of(flat("abc")).count("regexp_extract") <= 3
    assert [r["Q6"].second for r in flat("abc").collect()] == [5, 5, 5]


def test_numbers_read_as_before(spark):
    want = {"1": 1.0, " 2 ": 2.0, "\t3\n": 3.0, "1_000": 1000.0, ".5": 0.5, "5.": 5.0, "1E+5": 1e5, "1d": None, "0x1p3": None, "": None, ".": None,
            "e5": None, "--1": None, "_1": None, "\tnan": None, "nan\n": None, "inf": float("inf"), "-INFINITY": float("-inf"), "infinit": None}
    got = spark.createDataFrame([(v,) for v in want], "v string").select("v", cast.parse_number("v").alias("n")).collect()
    assert {r["v"]: r["n"] for r in got} == want
    nan = spark.createDataFrame([("nan",), ("-NaN",), ("+nan",)], "v string").select(cast.parse_number("v").alias("n")).collect()
    assert all(r["n"] != r["n"] for r in nan)


def test_an_export_evaluates_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("s", f"r{k}", k * DAY) for k in range(20)], "survey string, id string, submitted long")
    rows = rows.mapInArrow(each, "survey string, id string, submitted long")
    catalog = store.export_with_catalog(spark, rows, str(tmp_path / "out"), 0)
    assert catalog.agg(F.sum("n")).first()[0] == 20 and seen.value == 20 and not rows.is_cached


def test_a_copy_reads_its_row_once(spark):
    sf = "/root/testdata/sf0.001"
    for variant in ("R_dup", "R_dirty", "R_moved"):
        assert plan_of(fixtures.raw_responses(spark, sf, variant)).count("Relation [") == 1
    n = fixtures.raw_responses(spark, sf).count()
    fives = fixtures.table(spark, sf, "events").where("event_id % 5 = 0").count()
    assert fixtures.raw_responses(spark, sf, "R_dup").count() == fixtures.raw_responses(spark, sf, "R_dirty").count() == n + fives
