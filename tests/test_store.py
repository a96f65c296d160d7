"""Keyed writes (O31-O36, O50), export (O09) and snapshots."""

import pytest
from pyspark.sql import functions as F

from sondage.operators import store as SO


def test_upsert_modes(spark):
    target = spark.createDataFrame([("a", "old"), ("b", "old")], "id string, v string")
    batch = spark.createDataFrame([("b", "new1"), ("b", "new2"), ("c", "new")], "id string, v string")
    ign = dict(SO.upsert(target, batch, ["id"], "ignore").collect())
    assert ign == {"a": "old", "b": "old", "c": "new"}
    rep = dict(SO.upsert(target, batch, ["id"], "replace", [F.col("v")]).collect())
    assert rep == {"a": "old", "b": "new2", "c": "new"}
    with pytest.raises(SO.DuplicateKeyError):
        SO.upsert(target, batch, ["id"], "plain")
    ok = SO.upsert(target, spark.createDataFrame([("z", "n")], "id string, v string"), ["id"], "plain")
    assert ok.count() == 3


def test_ignore_is_idempotent_and_order_free(spark):
    batch = spark.createDataFrame([(str(i), i) for i in range(30)], "id string, v int")
    once = SO.upsert(None, batch, ["id"], "ignore")
    twice = SO.upsert(once, batch, ["id"], "ignore")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    rev = SO.upsert(None, batch.orderBy(F.col("v").desc()), ["id"], "ignore")
    assert sorted(map(tuple, rev.collect())) == sorted(map(tuple, once.collect()))


def test_evolution_adds_and_rejects_type_clash(spark):
    t = spark.createDataFrame([("a", 1)], "id string, x int")
    b = spark.createDataFrame([("b", 2, "y")], "id string, x int, z string")
    out = {r["id"]: r for r in SO.evolve_schema(t, b).collect()}
    assert out["a"]["z"] is None and out["b"]["z"] == "y"
    with pytest.raises(SO.SchemaEvolutionError):
        SO.evolve_schema(t, spark.createDataFrame([("c", "no")], "id string, x string"))


def test_participant_dim_dense_and_stable(spark):
    r1 = spark.createDataFrame([(f"g{i:03d}",) for i in range(0, 40, 2)], "global_id string")
    dim = SO.participant_dim(spark, r1, None)
    ids = sorted(dim.collect(), key=lambda r: r["id"])
    assert [r["id"] for r in ids] == list(range(1, 21))
    assert [r["global_id"] for r in ids] == sorted(r["global_id"] for r in ids)
    r2 = spark.createDataFrame([(f"g{i:03d}",) for i in range(40)] + [(None,)], "global_id string")
    dim2 = SO.participant_dim(spark, r2, dim)
    rows = dim2.collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 41))
    old = {r["global_id"]: r["id"] for r in ids}
    assert all(old[r["global_id"]] == r["id"] for r in rows if r["global_id"] in old)


def test_meta_and_registry(spark):
    meta = spark.createDataFrame([("|",), ("|",)], "key_separator string")
    assert SO.meta_check(meta).first()["consistent"]
    assert not SO.meta_check(spark.createDataFrame([("|",), (";",)], "key_separator string")).first()["consistent"]
    reg = spark.createDataFrame([("s", "t1", "raw")], "survey string, table string, type string")
    new = spark.createDataFrame([("s", "t1", "flat"), ("s", "t2", "flat")], "survey string, table string, type string")
    assert dict((r["table"], r["type"]) for r in SO.registry_upsert(reg, new).collect()) == {"t1": "raw", "t2": "flat"}


def test_publish_and_current(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "id string, v int")
    base = str(tmp_path)
    assert SO.current(spark, "unit_tbl", base) is None
    SO.publish(spark, df, "unit_tbl", base=base)
    SO.publish(spark, SO.upsert(SO.current(spark, "unit_tbl", base), spark.createDataFrame([("b", 2)], "id string, v int"),
                                ["id"]), "unit_tbl", base=base)
    assert sorted(r["id"] for r in SO.current(spark, "unit_tbl", base).collect()) == ["a", "b"]


def test_export_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("t", 1, "c")], "survey string, period_start int, id string")
    SO.export_responses(df, str(tmp_path / "x"), "json")
    back = SO.read_export(spark, str(tmp_path / "x"), "json")
    assert sorted((r["survey"], r["period_start"], r["id"]) for r in back.collect()) == \
        [("s", 1, "a"), ("s", 2, "b"), ("t", 1, "c")]


def test_write_keyed_ignore_appends_and_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "kt")
    b1 = spark.createDataFrame([("s", "a", 1), ("s", "b", 1), ("t", "a", 1)], "survey string, id string, v int")
    assert SO.write_keyed(spark, path, b1, ["survey", "id"], "ignore") == 3
    b2 = spark.createDataFrame([("s", "a", 9), ("t", "c", 2), ("t", "c", 3)], "survey string, id string, v int")
    assert SO.write_keyed(spark, path, b2, ["survey", "id"], "ignore") == 1
    assert SO.write_keyed(spark, path, b2, ["survey", "id"], "ignore") == 0  # a retried batch adds nothing
    got = {(r["survey"], r["id"]): r["v"] for r in SO.read_keyed(spark, path).collect()}
    assert got == {("s", "a"): 1, ("s", "b"): 1, ("t", "a"): 1, ("t", "c"): 2}


def test_write_keyed_replace_touches_only_batch_partitions(spark, tmp_path):
    path = str(tmp_path / "kr")
    b1 = spark.createDataFrame([("s", "a", 1), ("s", "b", 1), ("t", "a", 1)], "survey string, id string, v int")
    SO.write_keyed(spark, path, b1, ["survey", "id"], "replace")
    t_files = sorted(p.name for p in (tmp_path / "kr" / "survey=t").iterdir())
    b2 = spark.createDataFrame([("s", "a", 5), ("s", "z", 7)], "survey string, id string, v int")
    SO.write_keyed(spark, path, b2, ["survey", "id"], "replace", order=[F.col("v")])
    got = {(r["survey"], r["id"]): r["v"] for r in SO.read_keyed(spark, path).collect()}
    assert got == {("s", "a"): 5, ("s", "b"): 1, ("s", "z"): 7, ("t", "a"): 1}
    assert sorted(p.name for p in (tmp_path / "kr" / "survey=t").iterdir()) == t_files


def test_write_keyed_evolves_schema(spark, tmp_path):
    path = str(tmp_path / "ke")
    SO.write_keyed(spark, path, spark.createDataFrame([("s", "a", 1)], "survey string, id string, v int"), ["id"])
    SO.write_keyed(spark, path, spark.createDataFrame([("s", "b", 2, "x")], "survey string, id string, v int, w string"),
                   ["id"])
    got = {r["id"]: r["w"] for r in SO.read_keyed(spark, path).collect()}
    assert got == {"a": None, "b": "x"}
    with pytest.raises(SO.SchemaEvolutionError):
        SO.write_keyed(spark, path, spark.createDataFrame([("s", "c", "no")], "survey string, id string, v string"),
                       ["id"])


def test_dense_index_without_global_window(spark):
    df = spark.createDataFrame([(f"k{i:04d}",) for i in range(500)], "k string")
    out = SO.dense_index(spark, df, "k", start=0).collect()
    assert sorted((r["k"], r["idx"]) for r in out) == [(f"k{i:04d}", i) for i in range(500)]


def test_sources_from_files(spark, tmp_path):
    import json
    import zlib

    from sondage.sources import raw as RW
    info = {"key": "weekly", "versions": [
        {"versionId": "24-1-1", "published": 1704067200, "questions": [
            {"key": "weekly.main.Q1", "questionType": "multiple", "title": "t",
             "responses": [{"key": "0", "label": "a"}, {"key": "1", "label": "b"}]}]},
        {"versionId": "24-2-1", "published": 1706745600, "questions": []}]}
    (tmp_path / "info.json").write_text(json.dumps(info))
    doc = spark.read.schema(RW.SURVEY_INFO_SCHEMA).json(str(tmp_path / "info.json"))
    flat = RW.flatten_survey_info(doc, explode_responses=True).collect()
    assert [(r["version"], r["question"], r["response"]) for r in flat] == \
        [("24-1-1", "weekly.main.Q1", "0"), ("24-1-1", "weekly.main.Q1", "1")]
    (tmp_path / "ids.txt").write_text(" p1 \n\np2\np1\n")
    assert sorted(r["id"] for r in RW.read_id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["p1", "p2"]
    (tmp_path / "ids.json").write_text(json.dumps({"p3": "x", " p4": "y"}))
    assert sorted(r["id"] for r in RW.read_id_list(spark, str(tmp_path / "ids.json"), "json_keys").collect()) == \
        ["p3", "p4"]
    blobs = spark.createDataFrame([(zlib.compress(b'{"a": "1"}'),), (b"junk",), (None,)], "data binary")
    got = [r[0] for r in blobs.select(RW.decompress("data", "zlib")).collect()]
    assert got == ['{"a": "1"}', None, None]


def test_quarantine_and_recode(spark):
    from sondage.sources import raw as RW
    df = spark.createDataFrame([("a", '{"x": "TRUE", "y": "True", "z": {"k": 1}}'), ("b", "{bad"), ("c", "[]"),
                                ("d", "{}")], "id string, data string")
    good, bad = RW.split_quarantine(df)
    assert sorted(r["id"] for r in good.collect()) == ["a", "d"]
    assert sorted(r["id"] for r in bad.collect()) == ["b", "c"]
    m = good.where(F.col("id") == "a").select(RW.recode_flags("payload").alias("m")).first()["m"]
    assert m == {"x": "true", "y": "True", "z": '{"k":1}'}


def test_time_filter_prunes_day_partitions(spark, tmp_path):
    from sondage.sources import raw as RW
    rows = [("s", f"r{i}", 1704067200 + 86400 * i, "1", "{}") for i in range(10)]
    df = spark.createDataFrame(rows, "survey string, id string, submitted long, version string, data string")
    df.withColumn("day", RW.day_of(F.col("submitted"))).write.partitionBy("survey", "day").parquet(str(tmp_path / "r"))
    store = spark.read.parquet(str(tmp_path / "r"))
    q = RW.scan_raw(store, survey="s", start=1704067200 + 86400 * 3, end=1704067200 + 86400 * 5)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1][:400]
    assert sorted(r["id"] for r in q.collect()) == ["r3", "r4", "r5"]


def test_export_with_catalog_wide_and_long(spark, tmp_path):
    df = spark.createDataFrame([("s", "a", 86400 * 2, "x"), ("s", "b", 86400 * 9, None), ("t", "c", 86400 * 2, "z")],
                               "survey string, id string, submitted long, q string")
    cat = SO.export_with_catalog(spark, df, str(tmp_path / "w"), anchor=0, fmt="json")
    assert sorted((r["survey"], r["start"], r["n"]) for r in cat.collect()) == \
        [("s", 0, 1), ("s", 7 * 86400, 1), ("t", 0, 1)]
    back = SO.read_export(spark, str(tmp_path / "w" / "*.json"), "json")
    assert back.count() == 3
    long = SO.export_with_catalog(spark, df, str(tmp_path / "l"), anchor=0, fmt="json", layout="long")
    assert sum(r["n"] for r in long.collect()) == 3  # responses; as cells, submitted x3 and q x2 (null q dropped)
    assert SO.read_export(spark, str(tmp_path / "l" / "*.json"), "json").count() == 5


DAYS = "survey string, id string, day string, v int"


@pytest.mark.parametrize("mode,want", [("ignore", {("s", "a"): ("d1", 1), ("s", "b"): ("d1", 1), ("s", None): ("d2", 3), ("s", "c"): ("d2", 2)}),
                                       ("replace", {("s", "a"): ("d2", 2), ("s", "b"): ("d1", 1), ("s", None): ("d2", 4), ("s", "c"): ("d2", 2)})])
def test_key_holds_across_partitions(spark, tmp_path, mode, want):
    path = str(tmp_path / "k")
    SO.write_keyed(spark, path, spark.createDataFrame([("s", "a", "d1", 1), ("s", "b", "d1", 1)], DAYS), ["survey", "id"], mode, ("survey", "day"))
    batch = spark.createDataFrame([("s", "a", "d2", 2), ("s", "c", "d2", 2), ("s", None, "d2", 3), ("s", None, "d2", 4)], DAYS)
    for _ in range(2):  # a repeated batch changes nothing
        SO.write_keyed(spark, path, batch, ["survey", "id"], mode, ("survey", "day"), [F.col("v")])
        rows = SO.read_keyed(spark, path).collect()
        assert len(rows) == len(want) and {(r["survey"], r["id"]): (r["day"], r["v"]) for r in rows} == want


def test_replace_removes_a_partition_left_empty(spark, tmp_path):
    path = str(tmp_path / "k")
    SO.write_keyed(spark, path, spark.createDataFrame([("s", "a", "d1", 1)], DAYS), ["survey", "id"], "ignore", ("survey", "day"))
    SO.write_keyed(spark, path, spark.createDataFrame([("s", "a", "d2", 2)], DAYS), ["survey", "id"], "replace", ("survey", "day"))
    assert [tuple(r) for r in SO.read_keyed(spark, path).select("survey", "id", "day", "v").collect()] == [("s", "a", "d2", 2)]
    assert not (tmp_path / "k" / "survey=s" / "day=d1").exists()


def test_plain_raises_from_the_first_write(spark, tmp_path):
    path = str(tmp_path / "p")
    twice = spark.createDataFrame([("s", "a", "d1", 1), ("s", "a", "d2", 1)], DAYS)
    with pytest.raises(SO.DuplicateKeyError):
        SO.write_keyed(spark, path, twice, ["survey", "id"], "plain", ("survey", "day"))
    assert SO.write_keyed(spark, path, twice.limit(1), ["survey", "id"], "plain", ("survey", "day")) == 1
    with pytest.raises(SO.DuplicateKeyError):
        SO.write_keyed(spark, path, twice.limit(1), ["survey", "id"], "plain", ("survey", "day"))


def test_replace_without_partitions_leaves_the_old_snapshot_until_done(spark, tmp_path):
    path = str(tmp_path / "u")
    SO.write_keyed(spark, path, spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"), ["id"], "ignore", ())
    old = SO.read_keyed(spark, path)
    bad = spark.createDataFrame([("a", 2)], "id string, v int").withColumn("v", F.when(F.col("v") == 2, F.raise_error(F.lit("stop")).cast("int")))
    with pytest.raises(Exception, match="stop"):
        SO.write_keyed(spark, path, bad, ["id"], "replace", ())
    assert sorted(map(tuple, SO.read_keyed(spark, path).collect())) == [("a", 1), ("b", 1)]
    SO.write_keyed(spark, path, spark.createDataFrame([("a", 2), ("c", 3)], "id string, v int"), ["id"], "replace", ())
    assert sorted(map(tuple, SO.read_keyed(spark, path).collect())) == [("a", 2), ("b", 1), ("c", 3)]
    assert sorted(map(tuple, old.collect())) == [("a", 1), ("b", 1)]


def test_shared_folder_is_required_off_local_masters(spark, monkeypatch):
    from sondage import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_export_with_catalog_names_files_and_restarts(spark, tmp_path):
    from sondage.operators import periods as PD
    week = 7 * 86400
    df = spark.createDataFrame([("s", "a", 10, "x"), ("s", "b", week + 5, "y"), ("t", "c", 20, None)], "survey string, id string, submitted long, Q_lk_1 string")
    path = str(tmp_path / "out")
    for layout, ext in (("wide", "csv"), ("long", "json")):
        cat = SO.export_with_catalog(spark, df, f"{path}/{layout}", 0, ext, layout, headers=[("_lk_", "_likert_")])
        files = {r["file"] for r in cat.collect()}
        assert files == {f"s_responses_1970-01-01-00-00-00_1970-01-08-00-00-00.{ext}", f"s_responses_1970-01-08-00-00-00_1970-01-15-00-00-00.{ext}",
                         f"t_responses_1970-01-01-00-00-00_1970-01-08-00-00-00.{ext}"}
        assert files | {"catalog"} == {p.name for p in (tmp_path / "out" / layout).iterdir()}
    assert "Q_likert_1" in SO.read_export(spark, f"{path}/wide/s_*.csv", "csv").columns
    again = SO.export_with_catalog(spark, df.where("id = 'b'").withColumn("submitted", F.col("submitted") + 1), f"{path}/wide", 0)
    assert again.count() == 3 and SO.read_export(spark, f"{path}/wide/s_*.csv", "csv").count() == 2
    assert {r["survey"]: r["restart"] for r in PD.catalog_restart(again, now=10**9).collect()} == {"s": week, "t": 0}
