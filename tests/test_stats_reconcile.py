"""Statistics (O22, O23, O59-O70), reconciliation (O51-O58), migration (O71-O74), periods."""

import math

import pytest
from pyspark.sql import functions as F

from sondage.operators import migrate as MG
from sondage.operators import periods as PD
from sondage.operators import reconcile as RC
from sondage.operators import stats as ST

STATES = "participantId string, studyStatus string, flags map<string,string>"


def states(spark):
    return spark.createDataFrame([
        ("p1", "active", {"x": "1.5", "c": "a"}),
        ("p2", "active", {"x": "nan", "c": None}),
        ("p3", "temporary", {"x": "abc"}),
        ("p4", "active", {"x": None, "c": "a"}),
        ("p5", "active", {"x": "-inf"}),
        ("p6", "active", {}),
    ], STATES)


def test_counts_category_summary(spark):
    s = states(spark)
    assert dict(ST.flag_counts(s).collect()) == {"x": 5, "c": 3}
    assert dict(ST.flag_category(s, "c").collect()) == {"a": 2, "_NA_": 1}
    r = ST.flag_summary(s, "x").first()
    assert r["n"] == 2 and r["nan"] == 1 and r["invalid"] == 2
    assert r["min"] == float("-inf") and r["max"] == 1.5


def test_summary_with_no_values(spark):
    r = ST.flag_summary(states(spark), "absent").first()
    assert r["n"] == 0 and r["mean"] is None and r["var"] is None and r["invalid"] == 0


def test_summary_variance_is_population(spark):
    s = spark.createDataFrame([(f"p{i}", "active", {"v": str(v)}) for i, v in enumerate([1, 2, 3, 4])], STATES)
    r = ST.flag_summary(s, "v").first()
    assert r["mean"] == 2.5 and math.isclose(r["var"], 1.25)


def test_collector_specs():
    cols = ST.parse_collectors(["counts, category:c", {"type": "summary", "field": "x", "name": "sx"}])
    assert [c["name"] for c in cols] == ["counts", "category_c", "sx"]
    with pytest.raises(ValueError):
        ST.parse_collectors("category")
    with pytest.raises(ValueError):
        ST.parse_collectors("counts, counts")
    with pytest.raises(ValueError):
        ST.parse_collectors("median:x")


def test_multi_stats_long(spark):
    out = ST.multi_stats(states(spark), "counts, category:c, summary:x").collect()
    got = {(r["name"], r["key"]): r["value"] for r in out}
    assert got[("counts", "x")] == 5 and got[("category_c", "_NA_")] == 1 and got[("summary_x", "n")] == 2


def test_flag_sync_invariant(spark):
    s = states(spark)
    wanted = spark.createDataFrame([("p1", {"c": "a"}), ("p2", {"c": "a"}), ("p3", {"x": "1"}), ("zz", {"c": "a"})],
                                   "participantId string, flags map<string,string>")
    summ = RC.flag_sync_summary(s, wanted).first()
    assert summ["in_file"] == 4 and summ["found"] == 2 and summ["synced"] == 1 and summ["to_update"] == 1
    assert summ["synced"] + summ["to_update"] == summ["found"]
    diff = RC.flag_sync_diff(s, wanted).collect()
    assert [(r["participantId"], r["flag"], r["current"], r["wanted"]) for r in diff] == [("p2", "c", None, "a")]


def test_pending_batches_missing(spark):
    ids = spark.createDataFrame([(f"u{i:02d}",) for i in range(25)], "id string")
    done = spark.createDataFrame([("u00",), ("u03",)], "id string")
    pend = RC.pending_ids(ids, done)
    assert pend.count() == 23
    b = RC.work_batches(pend, 10, 4).orderBy("id").collect()
    assert [r["batch"] for r in b] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    pub = spark.createDataFrame([("s", "1", 10), ("s", "2", 20), ("s", "3", 30)], "survey string, version string, published long")
    repo = spark.createDataFrame([("s", "2")], "survey string, version string")
    assert [r["version"] for r in RC.missing_versions(pub, repo, 15).collect()] == ["3"]


def test_schema_merge_and_conflicts(spark):
    prev = spark.createDataFrame([("s", "a", "text"), ("s", "b", "bool")], "survey string, column string, type string")
    new = spark.createDataFrame([("s", "a", "text"), ("s", "b", "date"), ("s", "c", "json")],
                                "survey string, column string, type string")
    got = {r["column"]: (r["type"], r["status"]) for r in RC.schema_merge(prev, new).collect()}
    assert got == {"a": ("text", "kept"), "b": ("bool", "conflict"), "c": ("json", "new")}
    rows = spark.createDataFrame([("s", "1", "a", "text"), ("s", "2", "a", "bool"), ("s", "1", "b", "text")],
                                 "survey string, version string, column string, type string")
    c = RC.type_conflicts(rows).collect()
    assert [(r["column"], r["types"]) for r in c] == [("a", "bool,text")]


def test_migration(spark):
    users = spark.createDataFrame([
        (1, "a@x.org", [("g1", "n1", False), ("g2", "n2", True)]),
        (2, "b@skip.test", [("g3", "n3", True)]),
        (3, "c@x.org", []),
    ], "user_key int, email string, profiles array<struct<gid:string,name:string,main:boolean>>")
    rec = {r["user_key"]: r for r in MG.migration_records(users, ["skip.test"], True, "en", ["s1"]).collect()}
    assert rec[1]["oldParticipantIDs"] == ["g2", "g1"] and rec[1]["status"] == "created"
    assert rec[2]["reason"] == "email_filter" and rec[3]["reason"] == "empty_profile"
    assert MG.email_suffix_filter(users, ["skip.test"]).count() == 2
    assert MG.skip_empty_profiles(users).count() == 2


def test_periods(spark):
    starts = spark.createDataFrame([("s", 0, 20 * 86400)], "survey string, start long, mx long")
    grid = PD.period_grid(starts, "start", "mx").collect()
    assert [r["period_start"] // 86400 for r in grid] == [0, 7, 14]
    raw = spark.createDataFrame([("s", 86400 * 3), ("s", 86400 * 10), ("s", 86400 * 11)], "survey string, submitted long")
    cat = {r["start"]: r["n"] for r in PD.period_catalog(raw, anchor=86400).collect()}
    assert cat == {86400: 1, 86400 * 8: 2}
    bad = spark.createDataFrame([("s", 10, 20), ("s", 15, 30), ("s", 40, 99)], "survey string, start long, end long")
    v = {(r["start"], r["violation"]) for r in PD.catalog_violations(bad, F.lit(0), F.lit(50)).collect()}
    assert v == {(15, "overlaps_previous"), (40, "end_after_max")}


def test_assigned_counts_nested_equals_long(spark):
    states = spark.createDataFrame([
        ("p1", "active", [("s1", "a"), ("s2", "b")]), ("p2", "inactive", [("s1", "a")]), ("p3", "active", [])],
        "participantId string, studyStatus string, assignedSurveys array<struct<surveyKey:string,category:string>>")
    long = spark.createDataFrame([("p1", "s1", "a"), ("p1", "s2", "b"), ("p2", "s1", "a")],
                                 "participantId string, surveyKey string, category string")
    nested = sorted(map(tuple, ST.assigned_counts(states, "active").collect()))
    flat = sorted(map(tuple, ST.assigned_counts(states.drop("assignedSurveys"), "active", long).collect()))
    assert nested == flat == [("s1", "a", 1), ("s2", "b", 1)]
    assert sorted(map(tuple, ST.assigned_counts(states, "all").collect())) == [("s1", "a", 2), ("s2", "b", 1)]


def test_daily_counts_resume_replaces_repeated_days(spark):
    raw = spark.createDataFrame([("s", 0), ("s", 86400), ("s", 86400 + 5)], "survey string, submitted long")
    first = ST.daily_counts(raw)
    later = raw.unionByName(spark.createDataFrame([("s", 86400 + 9), ("s", 2 * 86400)], "survey string, submitted long"))
    restart = "1970-01-02"
    merged = ST.merge_daily(first, ST.daily_counts(later, since=restart), restart)
    assert sorted((str(r["day"]), r["n"]) for r in merged.collect()) == \
        [("1970-01-01", 1), ("1970-01-02", 3), ("1970-01-03", 1)]


def test_restart_points(spark):
    raw = spark.createDataFrame([("s", 86400 * 3 + 50), ("s", 86400 * 5 + 7), ("t", 10)], "survey string, submitted long")
    assert dict(PD.restart_point(raw).collect()) == {"s": 86400 * 5, "t": 0}
    cat = spark.createDataFrame([("s", 0, 7 * 86400), ("s", 7 * 86400, 14 * 86400)], "survey string, start long, end long")
    assert dict(PD.catalog_restart(cat, now=8 * 86400).collect()) == {"s": 7 * 86400}
    assert dict(PD.catalog_restart(cat, now=30 * 86400).collect()) == {"s": 7 * 86400}


def test_migration_long_form_matches_nested(spark):
    users = spark.createDataFrame([
        (1, "a@x.org", [("g1", "n1", False)]), (2, "b@skip.test", [("g3", "n3", True)]), (3, "c@x.org", [])],
        "user_key int, email string, profiles array<struct<gid:string,name:string,main:boolean>>")
    profiles = spark.createDataFrame([(1, "g1", "n1", False), (2, "g3", "n3", True)],
                                     "user_key int, gid string, name string, main boolean")
    nested = MG.migration_report(MG.migration_records(users, ["skip.test"], True, "en", []))
    flat = MG.migration_report(MG.migration_status(users.drop("profiles"), profiles, ["skip.test"], True))
    assert sorted(map(tuple, nested.collect())) == sorted(map(tuple, flat.collect()))
    assert sorted(r["user_key"] for r in MG.skip_empty_profiles(users.drop("profiles"), profiles=profiles).collect()) == [1, 2]


def test_rank_within_group_spreads_a_hot_group(spark):
    from sondage.operators import store as SO
    rows = [("hot", i) for i in range(300)] + [("cold", i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, v int")
    out = SO.rank_within_group(spark, df, "g", ["v"]).collect()
    assert sorted((r["g"], r["v"], r["pos"]) for r in out) == sorted((g, v, v) for g, v in rows)


def test_main_profile_first_long_matches_nested(spark):
    profiles = spark.createDataFrame([(1, "g1", "n", False, 1), (1, "g2", "n", True, 2), (1, "g3", "n", True, 3),
                                      (2, "g4", "n", None, 1)], "user_key int, gid string, name string, main boolean, seq int")
    got = sorted((r["user_key"], r["pos"], r["gid"]) for r in MG.main_profile_first_long(spark, profiles).collect())
    assert got == [(1, 0, "g2"), (1, 1, "g3"), (1, 2, "g1"), (2, 0, "g4")]


def test_own_collector_type(spark):
    from sondage.operators import stats as ST
    states = spark.createDataFrame([("a", {"x": "12"}), ("b", {"x": "3"}), ("c", {"y": "4"})], "participantId string, flags map<string,string>")

    def lengths(df, field):
        return df.select(F.length(F.element_at("flags", F.lit(field))).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("value"))
    out = ST.multi_stats(states, ["counts", {"type": "lengths", "field": "x", "name": "len"}], own={"lengths": lengths})
    assert {(r["key"], r["value"]) for r in out.where("name = 'len'").collect()} == {("2", 1.0), ("1", 1.0)}
    with pytest.raises(ValueError):
        ST.parse_collectors("lengths:x")


def test_flag_sync_with_nulls(spark):
    from sondage.operators import reconcile as RC
    states = spark.createDataFrame([("a", None, {"x": "1"}), ("b", "active", {"x": "1"}), ("c", "temporary", {"x": "0"}), ("d", "active", {"x": None})],
                                   "participantId string, studyStatus string, flags map<string,string>")
    wanted = spark.createDataFrame([("a", {"x": "2"}), ("b", {"x": None}), ("c", {"x": "1"}), ("d", {"x": None})], "participantId string, flags map<string,string>")
    assert {(r["participantId"], r["current"], r["wanted"]) for r in RC.flag_sync_diff(states, wanted).collect()} == {
        ("a", "1", "2"), ("b", "1", None), ("d", None, None)}
    assert RC.flag_sync_summary(states, wanted).first().asDict() == {"in_file": 4, "found": 3, "synced": 0, "to_update": 3}


def test_latest_version_breaks_ties_by_version(spark):
    from sondage.operators import stats as ST
    info = spark.createDataFrame([("s", "24-9", 5), ("s", "24-10", 5), ("s", "23-1", 4)], "survey string, version string, published long")
    assert ST.latest_version(info).first()["version"] == "24-10"


def test_daily_counts_resume(spark, tmp_path):
    from sondage.operators import stats as ST
    rows = lambda *days: spark.createDataFrame([("s", 86400 * d) for d in days], "survey string, submitted long")
    path = str(tmp_path / "d")
    ST.resume_daily(spark, path, rows(1, 1, 2))
    got = ST.resume_daily(spark, path, rows(2, 2, 3))  # day 1 is archived, day 2 was incomplete
    assert {(str(r["day"]), r["n"]) for r in got.collect()} == {("1970-01-02", 2), ("1970-01-03", 2), ("1970-01-04", 1)}
