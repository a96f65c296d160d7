"""Survey-shaped tables derived from the driver's parquet tables (FIXTURES.md §2).

Every table here is a lazy Spark plan over ``/root/testdata/sf*/``; nothing is
made up on the driver, so the work grows with the input tables.

* ``raw_responses``  (R)  — from ``events``
* ``participants``   (P)  — from ``customer`` and ``orders``
* ``survey_info_rows`` (SI) — from ``part``
* ``old_users``      (U)  — from ``customer`` and ``orders``
* ``localized_nations`` (T) — from ``nation`` and ``region``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evaluate_once
from ..functions.rename import DEFAULT_SEPARATOR

# --- fixed values (fixture rules of FIXTURES.md) ----------------------------------------------
STUDY_STATUSES = {0: "temporary", 1: "inactive"}  # any other c_custkey % 10 -> 'active'
QUESTION_TYPES = ["single", "multiple", "date", "unknown"]  # by p_partkey % 4
EMAIL_DOMAINS = ["a.org", "b.org", "skip.test"]  # by c_nationkey % 3
SKIP_SUFFIX = "skip.test"
SI_EPOCH = 1704067200  # 2024-01-01T00:00:00Z
# Incremental sync: the store holds responses before BASE_UNTIL; the next load
# re-fetches from BATCH_FROM (an overlap, as a restart point re-reads recent days).
BASE_UNTIL = 1705708800  # 2024-01-20T00:00:00Z (exclusive)
BATCH_FROM = 1705276800  # 2024-01-15T00:00:00Z (inclusive)
# ------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; how a scan is split is left to ``spark.sql.files.maxPartitionBytes``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k(events: DataFrame) -> Column:
    return F.get_json_object(events["props"], "$.k").cast("bigint")


def _submitted(ts: Column) -> Column:
    # events.ts is TIMESTAMP_NTZ; the session zone is UTC, so the cast reads it as UTC.
    return F.unix_seconds(ts.cast("timestamp"))


def _payload(survey: Column, rid: Column, pid: Column, version: Column, submitted: Column,
             opened: Column, k: Column, q2: Column, sep: str) -> Column:
    """JSON text of one response (text values, two numbers and one object)."""
    q = lambda group, name: F.concat(survey, F.lit(f".{group}."), F.lit(name))
    q6 = F.when(k % 11 == 0, F.lit("")).otherwise((submitted - F.lit(86400) * (k % 7)).cast("string"))
    ex = F.when(version == "24-1-4", F.concat(F.lit("x"), k.cast("string")))
    texts = F.map_filter(F.create_map(
        F.lit("ID"), rid,
        F.lit("participantID"), pid,
        F.lit("version"), version,
        q("main", f"Q1{sep}0"), F.when(k % 2 == 0, F.lit("TRUE")).otherwise(F.lit("FALSE")),
        q("main", "Q2"), F.when(k % 10 != 0, q2),
        q("main", f"Q3{sep}likert_1"), (k % 5).cast("string"),
        q("main", f"Q4{sep}mat.row1.col2"), (k % 3).cast("string"),
        q("main", "Q6"), q6,
        q("EX", "Q2"), ex,
    ), lambda key, v: v.isNotNull())
    items = F.array(*[F.struct(F.lit(str(i)).alias("key")) for i in (1, 2, 3)])
    q5 = F.to_json(F.struct(F.slice(items, 1, (k % 4).cast("int")).alias("items")))
    head = F.rtrim(F.to_json(texts), F.lit("}"))  # the object's own brace: its values are quoted
    return F.concat(
        head,
        F.lit(',"submitted":'), submitted.cast("string"),
        F.lit(',"opened":'), opened.cast("string"),
        F.lit(',"'), q("main", "Q5"), F.lit('":'), q5,
        F.lit("}"))


def _with_copy(rows: DataFrame, which: Column) -> DataFrame:
    """The rows, and ``which`` of them once more (``_copy`` true); each is computed once."""
    twice = F.when(which, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return rows.select("*", F.explode(twice).alias("_copy"))


RAW_COLUMNS = ["survey", "id", "submitted", "version", "data"]


def raw_responses(spark: SparkSession, sf_dir: str, variant: str = "R",
                  separator: str = DEFAULT_SEPARATOR) -> DataFrame:
    """R: ``raw(survey, id, submitted, version, data)`` from ``events``, computed where it is used.

    Variants:

    * ``R_bad``   10-character payload where ``event_id % 97 = 0``
    * ``R_dup``   rows with ``event_id % 5 = 0`` twice
    * ``R_dirty`` ``R_bad``, and a truncated copy, submitted 1,000 s earlier,
      of each row with ``event_id % 5 = 0``
    * ``R_base``  responses before ``BASE_UNTIL``
    * ``R_batch`` responses from ``BATCH_FROM`` on, with Q2 changed: together
      with ``R_base`` the whole table, overlapping on the re-fetched days
    * ``R_moved`` ``R_batch`` where ``event_id % 6 = 0`` is dated one day later,
      ``event_id % 101 = 0`` has no id, and ``event_id % 7 = 0`` comes twice
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    batch = variant in ("R_batch", "R_moved")
    if variant == "R_base":
        ev = ev.where(F.col("ts") < F.timestamp_seconds(F.lit(BASE_UNTIL)).cast("timestamp_ntz"))
    elif batch:
        ev = ev.where(F.col("ts") >= F.timestamp_seconds(F.lit(BATCH_FROM)).cast("timestamp_ntz"))
    ev = evaluate_once(ev, _k=_k(ev), _sub=_submitted(ev["ts"]))  # props parsed once per row
    k = F.col("_k")
    submitted = F.col("_sub")
    version = F.concat(F.lit("24-1-"), (F.floor(F.dayofmonth("ts") / 10) + 1).cast("string"))
    rid = F.concat(F.lit("r"), F.col("event_id").cast("string"))
    pid = F.concat(F.lit("p"), F.col("user_id").cast("string"))
    opened = submitted - F.col("event_id") % 600
    q2 = F.concat(F.lit("b"), k.cast("string")) if batch else k.cast("string")
    data = _payload(F.col("event_type"), rid, pid, version, submitted, opened, k, q2, separator)
    out = ev.select(
        F.col("event_type").alias("survey"), rid.alias("id"), submitted.alias("submitted"),
        version.alias("version"), data.alias("data"), F.col("event_id").alias("_eid"))
    cut = F.substring("data", 1, 10)
    if variant in ("R_bad", "R_dirty"):
        out = out.withColumn("data", F.when(F.col("_eid") % 97 == 0, cut).otherwise(F.col("data")))
    if variant == "R_dirty":
        out = _with_copy(out, F.col("_eid") % 5 == 0)
        out = out.withColumn("data", F.when(F.col("_copy"), cut).otherwise(F.col("data"))) \
            .withColumn("submitted", F.col("submitted") - F.when(F.col("_copy"), 1000).otherwise(0)).drop("_copy")
    elif variant == "R_odd":  # text that only a lenient parser takes
        data, eid = F.col("data"), F.col("_eid")
        out = out.withColumn("data", F.when(eid % 97 == 0, F.concat(data, F.lit(" x"))).when(eid % 89 == 0, F.concat(data, data))
                             .when(eid % 83 == 0, F.translate(data, '"', "'")).when(eid % 79 == 0, F.concat(F.lit('{"ID":NaN,'), F.substr(data, F.lit(2))))
                             .otherwise(data))
    elif variant == "R_dup":
        out = _with_copy(out, F.col("_eid") % 5 == 0).drop("_copy")
    elif variant == "R_moved":
        out = out.withColumn("submitted", F.col("submitted") + F.when(F.col("_eid") % 6 == 0, 86400).otherwise(0))
        out = out.withColumn("id", F.when(F.col("_eid") % 101 != 0, F.col("id")))
        out = _with_copy(out, F.col("_eid") % 7 == 0).drop("_copy")
    return out.drop("_eid")


def write_raw_store(spark: SparkSession, sf_dir: str, path: str, variant: str = "R") -> DataFrame:
    """R as a Parquet raw store at ``path``, partitioned by survey; an explicit step, never reused by itself."""
    rows = raw_responses(spark, sf_dir, variant).sortWithinPartitions("survey", "submitted")
    rows.write.partitionBy("survey").parquet(path)
    return spark.read.parquet(path).select(*RAW_COLUMNS)


def fixture_column_types(survey: str, separator: str = DEFAULT_SEPARATOR) -> dict[str, str]:
    """Schema map of R for one survey (FIXTURES.md §2 'Schema type')."""
    s = survey
    return {
        "ID": "text", "participantID": "text", "version": "text",
        "submitted": "date", "opened": "date",
        f"{s}.main.Q1{separator}0": "bool",
        f"{s}.main.Q2": "text",
        f"{s}.main.Q3{separator}likert_1": "text",
        f"{s}.main.Q4{separator}mat.row1.col2": "text",
        f"{s}.main.Q5": "json",
        f"{s}.main.Q6": "date",
        f"{s}.EX.Q2": "text",
    }


# The custom rule that resolves the Q2 collision of version 24-1-4.
FIXTURE_PROCESSORS = [
    {"name": "rename", "rules": [{"regex": {r"EX\.Q": "EX_Q"}}], "version": "24-1-4",
     "position": "after_casting"},
]

# Processors over all positions, in no order, one limited cast and two custom functions.
# Q4 is cast in two versions only, rows from 24-1-2 on are marked with their Q2 before
# the renaming and in capitals in 24-1-3 after it, and two columns are renamed at the end.


def _mark(df: DataFrame) -> DataFrame:
    q2 = [F.col(f"`{c}`") for c in df.columns if c.endswith(".main.Q2")]  # one for each survey
    return df.withColumn("mark", F.concat(F.lit("m"), F.coalesce(*q2, F.lit("-"))))


def _shout(df: DataFrame) -> DataFrame:
    return df.withColumn("mark", F.upper("mark"))


ORDERED_PROCESSORS = [
    {"name": "custom", "fn": _shout, "position": "end", "version": "24-1-3"},
    {"name": "rename", "rules": [{"fixed": {"mark": "tag", "Q3_lk_1": "likert"}}], "position": "end"},
    *FIXTURE_PROCESSORS,
    {"name": "custom", "fn": _mark, "position": "after_casting", "version": "24-1-2:"},
    {"name": "to_bool", "columns": [{"glob": "*|mat.row1.col2"}], "version": "24-1-1:24-1-2", "position": "before_casting"},
    "default_renaming",
    "default_casting",
]


def fixture_profile(**overrides) -> dict:
    prof = {
        "key_separator": DEFAULT_SEPARATOR,
        "schema": fixture_column_types,
        "processors": FIXTURE_PROCESSORS,
        "mode": "ignore",
    }
    prof.update(overrides)
    return prof


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: participant states with a flag map and assigned surveys."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                                   "o_orderpriority")
    key = F.col("c_custkey")
    status = F.when(key % 23 == 0, F.lit(None).cast("string")).when(key % 10 == 0, F.lit(STUDY_STATUSES[0])) \
        .when(key % 10 == 1, F.lit(STUDY_STATUSES[1])).otherwise(F.lit("active"))
    minor = F.when(key % 7 == 0, F.lit(None).cast("string")).otherwise((key % 2).cast("string"))
    counter = F.when(key % 17 == 0, F.lit("nan")).when(key % 19 == 0, F.lit("abc")) \
        .otherwise(F.col("c_acctbal").cast("string"))
    flags = F.when(key % 13 == 0, F.create_map(F.lit("segment"), F.col("c_mktsegment"),
                                               F.lit("counter"), counter)) \
        .otherwise(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("minor"), minor,
                                F.lit("counter"), counter))
    # One participant's assigned surveys: bounded by that participant's orders.
    assigned = (orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(
        "o_orderkey", F.col("o_orderstatus").alias("surveyKey"),
        F.col("o_orderpriority").alias("category")))).alias("_a"))
        .select(F.col("o_custkey").alias("c_custkey"),
                F.transform("_a", lambda x: F.struct(x.getField("surveyKey").alias("surveyKey"),
                                                     x.getField("category").alias("category")))
                .alias("assignedSurveys")))
    return (cust.join(assigned, "c_custkey", "left")
            .select(F.concat(F.lit("p"), key.cast("string")).alias("participantId"),
                    status.alias("studyStatus"), flags.alias("flags"),
                    F.coalesce("assignedSurveys", F.array().cast(
                        "array<struct<surveyKey:string,category:string>>")).alias("assignedSurveys")))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P's assigned surveys in long form: ``(participantId, surveyKey, category)``, one per order."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("participantId"),
                         F.col("o_orderstatus").alias("surveyKey"), F.col("o_orderpriority").alias("category"))


def wanted_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag-sync input ``(participantId, flags)``: custkey % 4 = 0 -> segment BUILDING, minor 0 (null where custkey % 12 = 0)."""
    cust = table(spark, sf_dir, "customer").select("c_custkey")
    return cust.where(F.col("c_custkey") % 4 == 0).select(
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("participantId"),
        F.create_map(F.lit("segment"), F.lit("BUILDING"), F.lit("minor"),
                     F.when(F.col("c_custkey") % 12 != 0, F.lit("0"))).alias("flags"))


def survey_info_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SI: ``(survey, version, column, questionType, published, p_partkey)`` from ``part``."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    qtype = F.element_at(F.array(*[F.lit(t) for t in QUESTION_TYPES]),
                         (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.select(
        F.col("p_brand").alias("survey"),
        F.concat(F.lit("24-"), (F.col("p_size") % 12 + 1).cast("string"), F.lit("-"),
                 (F.col("p_partkey") % 3 + 1).cast("string")).alias("version"),
        F.concat(F.lit("Q"), F.col("p_size").cast("string")).alias("column"),
        qtype.alias("questionType"),
        (F.lit(SI_EPOCH) + F.lit(86400) * (F.lit(30) * (F.col("p_size") % 12) + F.col("p_partkey") % 3))
        .cast("bigint").alias("published"),
        F.col("p_partkey"))


def changing_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of four loads (``load``: o_custkey % 4), one per order, whose keys change their kind of value.

    ``a``: whole number, number, null, not there.  ``b``: whole number, null,
    text, whole number.  ``c``: null, whole number, whole number, not there.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    load, key = F.col("o_custkey") % 4, F.col("o_custkey")
    pair = lambda name, value: F.concat(F.lit(f', "{name}": '), F.coalesce(value.cast("string"), F.lit("null")))
    number = F.col("o_totalprice").cast("decimal(18,2)")
    a = F.when(load == 0, pair("a", key)).when(load == 1, pair("a", number)).when(load == 2, pair("a", F.lit(None))).otherwise(F.lit(""))
    text = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))
    b = F.when(load == 1, pair("b", F.lit(None))).when(load == 2, pair("b", text)).otherwise(pair("b", key))
    c = F.when(load == 0, pair("c", F.lit(None))).when(load == 3, F.lit("")).otherwise(pair("c", F.col("o_orderkey")))
    ident = F.col("o_orderkey").cast("string")
    data = F.concat(F.lit('{"ID": "'), ident, F.lit('"'), a, b, c, F.lit("}"))
    return orders.select(load.cast("int").alias("load"), F.col("o_orderstatus").alias("survey"), ident.alias("id"),
                         F.lit(SI_EPOCH).cast("bigint").alias("submitted"), F.lit("25-1-1").alias("version"), data.alias("data"))


def long_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(p_partkey, version)``: versions of 1 to 9 parts, some parts beyond 32 bits, some with zeros at the end."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    key = F.col("p_partkey")
    value = lambda i: (key * i) % 4 + F.when((key + i) % 11 == 0, F.lit(20240101120000)).otherwise(F.lit(0))
    parts = F.transform(F.sequence(F.lit(1).cast("bigint"), key % 9 + 1), lambda i: value(i).cast("string"))
    return part.select("p_partkey", F.array_join(parts, "-").alias("version"))


def repository_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository side of ``missing_versions``: SI rows with ``p_partkey % 5 <> 0``."""
    si = survey_info_rows(spark, sf_dir)
    return si.where(F.col("p_partkey") % 5 != 0).select("survey", "version").distinct()


def old_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U: old-platform users ``(custkey, email, profiles[{gid,name,main}])``."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                                   "o_orderpriority")
    domain = F.element_at(F.array(*[F.lit(d) for d in EMAIL_DOMAINS]), (F.col("c_nationkey") % 3 + 1).cast("int"))
    profiles = (orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(
        F.col("o_orderkey").alias("_o"), F.col("o_orderkey").cast("string").alias("gid"),
        F.col("o_orderpriority").alias("name"), (F.col("o_orderstatus") == "O").alias("main"))))
        .alias("_p")).select(F.col("o_custkey").alias("c_custkey"), "_p"))
    ptype = "array<struct<gid:string,name:string,main:boolean>>"
    prof = F.transform("_p", lambda x: F.struct(x.getField("gid").alias("gid"),
                                                x.getField("name").alias("name"),
                                                x.getField("main").alias("main")))
    prof = F.when(F.col("c_custkey") % 11 == 0, F.array().cast(ptype)).otherwise(
        F.coalesce(prof, F.array().cast(ptype)))
    return cust.join(profiles, "c_custkey", "left").select(
        F.col("c_custkey").alias("user_key"),
        F.concat(F.col("c_name"), F.lit("@"), domain).alias("email"),
        prof.alias("profiles"))


def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U's profiles in long form: ``(user_key, gid, name, main)``, one per order; the users
    whose profiles FIXTURES.md empties have none."""
    orders = table(spark, sf_dir, "orders")
    return orders.where(F.col("o_custkey") % 11 != 0).select(
        F.col("o_custkey").alias("user_key"), F.col("o_orderkey").cast("string").alias("gid"),
        F.col("o_orderpriority").alias("name"), (F.col("o_orderstatus") == "O").alias("main"),
        F.col("o_orderkey").alias("seq"))  # the profile's place in the user's original list


def localized_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: ``(n_nationkey, text)`` with ``text`` a localized-text array (en: nation+region, fr: nation)."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    j = nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left")
    text = F.array(
        F.struct(F.lit("en").alias("code"), F.array(F.struct(F.col("n_name").alias("str")),
                                                    F.struct(F.col("r_name").alias("str"))).alias("parts")),
        F.struct(F.lit("fr").alias("code"), F.array(F.struct(F.lower("n_name").alias("str"))).alias("parts")))
    return j.select("n_nationkey", text.alias("text"))
