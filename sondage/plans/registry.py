"""

Every query reads the driver's tables (through the fixtures of
``sources.fixtures``), runs over whole tables, and returns scalar columns with
explicit types so the DuckDB oracle (``plans.oracle``) can compare values.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cast as C
from ..functions import rename as RN
from ..functions import text as TX
from ..functions.select import project_fields, select_columns
from ..functions.versions import filter_versions, version_array
from ..operators import migrate as MG
from ..operators import observed as OB
from ..operators import periods as PD
from ..operators import reconcile as RC
from ..operators import reshape as RS
from ..operators import stats as ST
from ..operators import store as SO
from ..operators.keyed import KeyedStore
from ..session import checkpoint_dir
from ..sources import export_sink as ES
from ..sources import fixtures as fx
from ..sources import landed as LD
from ..sources import raw as RW
from ..streaming import stream as SM
from . import oracle as O
from . import build as B
from .build import build_flat, parse_profile

#: Files that a part of the rows lands in, however many rows there are.
LANDED_FILES = 9

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def scalars(df: DataFrame) -> DataFrame:
    """Timestamps as ``yyyy-MM-dd HH:mm:ss`` and dates as ``yyyy-MM-dd`` text (UTC), so
    both engines hand over the same values however the rows are collected."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the engine's clock is UTC
        return scalars(fn(spark, sf))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def r4(c):
    return F.round(c, 4).cast("double")


def _scratch(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_dir(spark)}/scratch/{what}-{uuid.uuid4().hex[:10]}"


def R(spark, sf, variant="R"):
    return fx.raw_responses(spark, sf, variant)


def FLAT(spark, sf, variant="R"):
    return build_flat(R(spark, sf, variant), fx.fixture_profile())


def KEYS(spark, sf):
    return RW.decode_payload(R(spark, sf)).select(F.explode(F.map_keys("payload")).alias("key")).distinct()


# --- 2.1 scans, sources, sinks -------------------------------------------------------------------

@query
def scan_raw(spark, sf):
    return RW.scan_raw(R(spark, sf), start=O.TIME_FROM, end=O.TIME_TO,
                       columns=("survey", "id", "submitted", "version"))


@query
def landed_scan(spark, sf):
    """O01 through the data source: landed JSON lines, read with the scan's time range pushed into the reader."""
    src = SM.land_files(R(spark, sf), _scratch(spark, "landed"), "json", files=LANDED_FILES)
    return RW.scan_raw(LD.read_landed(spark, src), start=O.TIME_FROM, end=O.TIME_TO, columns=("survey", "id", "submitted", "version"))


@query
def time_range_filter(spark, sf):
    return RW.time_range_filter(R(spark, sf), start=O.TIME_ONLY_FROM).select("survey", "id", "submitted")


@query
def decode_payload(spark, sf):
    d = RW.decode_payload(R(spark, sf))
    return RS.payload_to_long(d, ["id"])


@query
def quarantine_rows(spark, sf):
    _, bad = RW.split_quarantine(R(spark, sf, "R_bad"))
    return bad.groupBy("survey").agg(F.count("*").alias("n_bad"))


@query
def recode_flags(spark, sf):
    """The payload text after the ingest recode: values, and the JSON types they have."""
    member = lambda name: F.concat(F.lit("$['"), F.col("survey"), F.lit(f"{name}']"))
    d = R(spark, sf).select("id", "survey", F.parse_json(RW.recode_json("data")).alias("v"))
    out = [F.col("id")]
    for name, path in (("q1", member(".main.Q1|0")), ("q2", member(".main.Q2")), ("q5", member(".main.Q5")), ("submitted", F.lit("$.submitted"))):
        got = F.variant_get("v", path, "variant")
        out += [F.regexp_extract(F.schema_of_variant(got), "^[A-Z]+", 0).alias(f"{name}_type"), F.to_json(got).alias(name)]
    return d.select(*out)


@query
def flatten_survey_info(spark, sf):
    docs = RW.survey_info_documents(fx.survey_info_rows(spark, sf))
    return RW.flatten_survey_info(docs)


@query
def participants_by_status(spark, sf):
    return RW.participants_by_status(fx.participants(spark, sf), "active").select("participantId", "studyStatus")


@query
def id_list(spark, sf):
    orders = fx.table(spark, sf, "orders")
    customer = fx.table(spark, sf, "customer")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    key = F.col("o_custkey").cast("string")
    own = F.col("c_custkey").cast("string")
    lists = [(orders, text(" p", key, " ,, p", (F.col("o_custkey") % 7).cast("string"), " "), "comma"),
             (customer, text("  l", own, " "), "lines"), (customer, text('["j', own, '", " ", null, " j0 "]'), "json_list"),
             (customer, text('{"k', own, '": 1, " k0 ": 2}'), "json_keys"), (customer, text('{"a": "v', own, '", "b": " v0 "}'), "json_values")]
    out = None
    for df, column, mode in lists:
        ids = df.select(F.explode(RW.parse_id_list(column, mode)).alias("id"))
        out = ids if out is None else out.unionByName(ids)
    return out.distinct()


@query
def export_roundtrip(spark, sf):
    """Flat rows, payload columns included, exported wide and long under renamed headers and read back through the catalog."""
    flat = FLAT(spark, sf).select("survey", "id", "version", F.unix_seconds("timestamp").alias("submitted"),
                                  "Q2", "Q3_lk_1", "Q4_multi_row1_col2", "Q5", "EX_Q2")
    wide, long = _scratch(spark, "export_wide"), _scratch(spark, "export_long")
    rules = [("_lk_", "_likert_")]
    flat.persist()  # built once for both exports
    try:
        catalog = SO.export_with_catalog(spark, flat, wide, O.ANCHOR, "csv", headers=rules)
        SO.export_with_catalog(spark, flat, long, O.ANCHOR, "json", "long", headers=rules)
    finally:
        flat.unpersist()
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    columns = ["Q2", "Q3_likert_1", "Q4_multi_row1_col2", "Q5", "EX_Q2"]
    rows = SO.read_export(spark, f"{wide}/*.csv", "csv", "survey string, id string, version string, submitted bigint, "
                          + ", ".join(f"{c} string" for c in columns)).withColumn("file", name)
    rows = RS.wide_to_long(rows, ["survey", "id", "version", "submitted", "file"], columns)
    rows = rows.join(catalog.select("file", F.col("start").alias("period_start"), "n"), "file")
    cells = SO.read_export(spark, f"{long}/*.json", "json", "survey string, id string, key string, value string")
    cells = cells.where(F.col("key").isin("Q2", "Q3_lk_1", "Q4_multi_row1_col2", "Q5", "EX_Q2")).select(
        "id", F.regexp_replace("key", "_lk_", "_likert_").alias("key"), F.col("value").alias("long_value"))
    return rows.join(cells, ["id", "key"], "full_outer")


@query
def export_commit(spark, sf):
    """O09 + O39 through the sink: a first export, the next one over its last periods, catalog and files read back."""
    path = _scratch(spark, "exported")
    for variant in ("R_base", "R_batch"):
        ES.export_periods(R(spark, sf, variant), path, O.ANCHOR)
    rows = ES.read_exported(spark, path, SM.RAW_SCHEMA).withColumn("start", PD.period_of(F.col("submitted"), O.ANCHOR))
    read = rows.groupBy("survey", "start").agg(F.count("*").alias("n_read"), F.count_distinct("id").alias("n_ids"))
    return ES.exported_catalog(spark, path).select("survey", "start", "end", "n").join(read, ["survey", "start"], "full")


@query
def wide_to_long(spark, sf):
    return RS.wide_to_long(FLAT(spark, sf), ["id"], ["Q2", "Q3_lk_1", "Q4_multi_row1_col2", "Q5", "EX_Q2"])


@query
def long_to_wide(spark, sf):
    lng = RS.wide_to_long(FLAT(spark, sf), ["id"], ["Q2", "Q3_lk_1", "Q4_multi_row1_col2", "Q5", "EX_Q2"])
    return RS.long_to_wide(lng, ["id"])


# --- 2.2 versions, projections, predicates ---------------------------------------------------------

@query
def version_order(spark, sf):
    v = fx.survey_info_rows(spark, sf).select("version").union(R(spark, sf).select("version")) \
        .union(fx.long_versions(spark, sf).select("version")).distinct()
    v = v.select("version", version_array("version").alias("parts"))
    # versions of one order share their number; they are numbered inside sorted ranges
    ranks = SO.dense_index(spark, v.select("parts").distinct(), "parts", 1, "rank")
    return v.join(ranks, "parts").select("version", "rank")


@query
def version_filter(spark, sf):
    rows = fx.survey_info_rows(spark, sf).select("p_partkey", "version").unionByName(fx.long_versions(spark, sf))
    return filter_versions(rows, O.VERSION_SELECTOR)


def _key_rename(spark, sf, expr_fn):
    k = KEYS(spark, sf)
    return k.select(F.col("key").alias("source"), expr_fn(F.col("key")).alias("target"))


@query
def rename_strip_prefix(spark, sf):
    return _key_rename(spark, sf, RN.StripPrefix("|").column)


@query
def rename_regex(spark, sf):
    rules = [RN.RegexRename(p, r) for p, r in RN.DEFAULT_RENAME_RULES[:2]]
    return _key_rename(spark, sf, RN.RenameChain(rules).column)


@query
def rename_fixed(spark, sf):
    return _key_rename(spark, sf, RN.FixedRename.of(RN.DEFAULT_RENAME_COLUMNS).column)


@query
def default_rename(spark, sf):
    return _key_rename(spark, sf, RN.default_chain("|").column)


def _members(spark, sf):
    d = RW.decode_payload(R(spark, sf))
    return d.select("survey", "version", F.explode(F.map_keys("payload")).alias("source")).distinct()


@query
def rename_plan(spark, sf):
    return RN.rename_plan(_members(spark, sf), RN.default_chain("|"), group=["survey", "version"])


@query
def rename_collisions(spark, sf):
    p = RN.rename_plan(_members(spark, sf), RN.default_chain("|"), group=["survey", "version"])
    return (p.where(F.col("n_sources") > 1)
            .groupBy("survey", "version", F.lower("target").alias("target"))
            .agg(F.count("*").alias("n_sources"),
                 F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources")))


@query
def header_rename(spark, sf):
    flat = FLAT(spark, sf).select("id", "Q1_0", "Q3_lk_1", "Q4_multi_row1_col2")
    return RN.header_rename(flat, [(r"^Q(\d+)_", r"q\1_"), ("_lk_", "_likert_")])


@query
def select_columns_q(spark, sf):
    return select_columns(FLAT(spark, sf), ["id", {"glob": "Q*_*"}, {"re": "EX_"}])


QUERIES["select_columns"] = QUERIES.pop("select_columns_q")


@query
def project_fields_q(spark, sf):
    return project_fields(fx.participants(spark, sf), {"pid": "participantId", "status": "studyStatus"})


QUERIES["project_fields"] = QUERIES.pop("project_fields_q")


# --- 2.3 casts and scalar functions ------------------------------------------------------------------

@query
def cast_bool(spark, sf):
    p = fx.participants(spark, sf)
    return p.select("participantId", C.to_bool(F.element_at("flags", F.lit("minor"))).alias("minor"))


def _q(name):
    return F.element_at("payload", F.concat(F.col("survey"), F.lit(name)))


@query
def cast_epoch(spark, sf):
    d = RW.decode_payload(R(spark, sf))
    return d.select("id", C.epoch_to_timestamp(_q(".main.Q6")).alias("q6"))


@query
def json_item_keys(spark, sf):
    d = RW.decode_payload(R(spark, sf))
    return d.select("id", C.json_item_keys(_q(".main.Q5")).alias("q5"))


@query
def json_flatten(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", "props")
    return C.json_flatten(ev, "props")


def _text_frame(spark, sf):
    d = RW.decode_payload(R(spark, sf))
    return d.select("id", "version", _q(".main.Q1|0").alias("q1"), _q(".main.Q3|likert_1").alias("q3"),
                    _q(".main.Q5").alias("q5"), _q(".main.Q6").alias("q6"),
                    F.element_at("payload", F.lit("submitted")).alias("submitted"))


@query
def schema_cast(spark, sf):
    df = _text_frame(spark, sf).drop("version", "q3")
    return C.schema_cast(df, {"q1": "bool", "q5": "json", "q6": "date", "submitted": "date", "absent": "bool"})


@query
def cast_selected(spark, sf):
    df = _text_frame(spark, sf).select("id", "version", "q1", "q3")
    return C.cast_selected(df, "to_bool", [{"glob": "q1*"}], version="24-1-2")


@query
def localized_text(spark, sf):
    t = fx.localized_nations(spark, sf)
    return t.select("n_nationkey", F.element_at(TX.localized_text("text", "en"), 1).alias("en"),
                    F.array_join(TX.localized_text("text"), ";").alias("all_text"))


@query
def localize_map(spark, sf):
    n = fx.table(spark, sf, "nation")
    m = F.create_map(F.lit("en"), F.col("n_name"), F.lit("fr"), F.lower("n_name"))
    loc = n.select("n_nationkey", F.posexplode(TX.localize_map(m)).alias("pos", "e"))
    return loc.select("n_nationkey", "pos", F.col("e.code").alias("code"),
                      F.array_join(F.transform("e.parts", lambda p: p.getField("str")), " ").alias("text"))


@query
def published_iso(spark, sf):
    si = fx.survey_info_rows(spark, sf)
    digits = F.substring(F.concat(F.col("published").cast("string"), F.lit("123456789")), F.lit(1), (F.col("p_partkey") % 19).cast("int"))
    pub = F.when(F.col("p_partkey") % 9 == 0, F.lit("0")).when(F.col("p_partkey") % 10 == 0, F.col("published").cast("string")).otherwise(digits)
    return si.select("p_partkey", TX.published_iso(pub).alias("published_iso"))


@query
def midnight_floor(spark, sf):
    r = R(spark, sf)
    return r.select("id", F.unix_seconds(TX.midnight_floor(F.timestamp_seconds("submitted"))).alias("midnight"))


# --- 2.4 build pipeline ------------------------------------------------------------------------------

@query
def version_dispatch(spark, sf):
    """Which processors each version's rows went through, in order, and what they made of a row."""
    prof = parse_profile(fx.fixture_profile(processors=fx.ORDERED_PROCESSORS, processors_defaults=False))
    names = F.array_compact(F.array(*[
        (F.lit(p.name) if p.version is None or p.version.is_empty
         else F.when(p.version.column(F.col("version")), F.lit(p.name)))
        for p in prof.processors]))
    made = ORDERED(spark, sf).groupBy("survey", "version").agg(
        F.max("likert").alias("max_likert"), F.count("Q4_multi_row1_col2").alias("n_q4"), F.max("tag").alias("max_tag"))
    return made.select("*", F.array_join(names, ",").alias("processors"))


def ORDERED(spark, sf):
    spec = fx.fixture_profile(processors=fx.ORDERED_PROCESSORS, processors_defaults=False, on_error="null")
    return build_flat(R(spark, sf), spec)


@query
def processor_order(spark, sf):
    """Seven processors over all positions, given in no order: defaults by name, two custom functions, a limited cast."""
    return ORDERED(spark, sf).select("id", "Q2", "EX_Q2", "Q1_0", "likert", "Q4_multi_row1_col2", "tag")


@query
def build_flat_q(spark, sf):
    return FLAT(spark, sf, "R_dirty")


QUERIES["build_flat"] = QUERIES.pop("build_flat_q")


@query
def build_rejects(spark, sf):
    bad = B.build_rejects(R(spark, sf, "R_dirty"), fx.fixture_profile())
    return bad.groupBy("survey", "lost").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"))


@query
def strict_payloads(spark, sf):
    """O02 + O45: text behind the object, a second object, single quotes and NaN; every id is built or rejected."""
    raw, spec = R(spark, sf, "R_odd"), fx.fixture_profile()
    rows = lambda df, n: df.groupBy("survey").agg(F.count("*").alias(n))
    bad = rows(RW.split_quarantine(raw)[1], "n_bad")
    lost = rows(B.build_rejects(raw, spec).where("lost"), "n_lost")
    return rows(build_flat(raw, spec), "n_flat").join(bad, "survey", "full").join(lost, "survey", "full")


@query
def build_plan_q(spark, sf):
    raw = R(spark, sf)
    surveys = [r[0] for r in raw.select("survey").distinct().collect()]  # the survey list (a handful)
    plan = {"profiles": {"std": fx.fixture_profile()},
            "surveys": [{"survey": s, "profile": "std"} for s in sorted(surveys)]}
    path = _scratch(spark, "plan")
    B.run_build_plan(spark, raw, plan, path)
    dim = SO.read_keyed(spark, f"{path}/{B.DIMENSION_TABLE}")
    out = None
    for r in SO.read_keyed(spark, f"{path}/{B.REGISTRY_TABLE}").collect():  # a row per survey
        flat = SO.read_keyed(spark, f"{path}/{r['table']}").join(dim.withColumnRenamed("id", "participant"), "global_id")
        c = flat.agg(F.lit(r["survey"]).alias("survey"), F.lit(r["table"]).alias("table"), F.count("*").alias("n_rows"), F.count("Q2").alias("n_q2"),
                     F.count("EX_Q2").alias("n_ex_q2"), F.count_distinct("participant").alias("n_participants"))
        out = c if out is None else out.unionByName(c)
    return out


QUERIES["build_plan"] = QUERIES.pop("build_plan_q")


# --- 2.5 writes --------------------------------------------------------------------------------------

def _base_batch(spark, sf):
    return FLAT(spark, sf, "R_base"), FLAT(spark, sf, "R_batch")


def _keyed_store(spark, sf, mode):
    """A first load, then a batch with re-dated, repeated and missing ids, into the day-partitioned raw store."""
    store, order = _scratch(spark, f"store_{mode}"), [F.col("submitted"), F.col("data")]
    for variant in ("R_base", "R_moved"):
        rows = R(spark, sf, variant).withColumn("day", RW.day_of(F.col("submitted")))
        SO.write_keyed(spark, store, rows, ["survey", "id"], mode, ("survey", "day"), order)
    q2 = F.call_function("get_json_object", F.col("data"), F.concat(F.lit("$['"), F.col("survey"), F.lit(".main.Q2']")))
    return SO.read_keyed(spark, store).select("survey", "id", "submitted", "version", q2.alias("q2"), F.get_json_object("data", "$.ID").alias("payload_id"))


@query
def upsert_ignore(spark, sf):
    return _keyed_store(spark, sf, "ignore")


@query
def upsert_replace(spark, sf):
    return _keyed_store(spark, sf, "replace")


def _bucketed_store(spark, sf, mode):
    """The same two loads as ``_keyed_store``, into a store bucketed by key."""
    store = KeyedStore(spark, _scratch(spark, f"keyed_{mode}"))
    for variant in ("R_base", "R_moved"):
        store.load(R(spark, sf, variant), variant, mode, [F.col("submitted"), F.col("data")])
    return store


def _stored_rows(store):
    q2 = F.call_function("get_json_object", F.col("data"), F.concat(F.lit("$['"), F.col("survey"), F.lit(".main.Q2']")))
    return store.current().select("survey", "id", "submitted", "version", q2.alias("q2"), F.get_json_object("data", "$.ID").alias("payload_id"))


@query
def keyed_ignore(spark, sf):
    return _stored_rows(_bucketed_store(spark, sf, "ignore"))


@query
def keyed_replace(spark, sf):
    """Compacted at the end, so the rewritten store is what is compared."""
    store = _bucketed_store(spark, sf, "replace")
    store.compact()
    return _stored_rows(store)


@query
def keyed_daily(spark, sf):
    """O63 from the loads' signed changes: the second load dates rows anew and replaces others."""
    return _bucketed_store(spark, sf, "replace").daily()


@query
def watched_import(spark, sf):
    """O50 + O02 + O65 observed while a load is written, without a job of their own."""
    rows = R(spark, sf, "R_bad")
    surveys = sorted(r[0] for r in R(spark, sf).select("survey").distinct().collect())  # the survey list (a handful)
    watch = OB.LoadWatch(surveys)
    KeyedStore(spark, _scratch(spark, "watched")).load(rows, "first", "ignore", watch=watch)
    return watch.log(spark).withColumn("versions", F.concat_ws(",", "versions"))


@query
def evolve_schema(spark, sf):
    base, batch = _base_batch(spark, sf)
    out = SO.upsert(base.select("id", "Q2"), batch.select("id", "Q2", "Q6"), ["id"], "ignore")
    return out.select("id", "Q2", "Q6")


@query
def registry_upsert(spark, sf):
    s = R(spark, sf).select("survey").distinct()
    existing = s.select("survey", F.concat(F.lit(SO.RAW_TABLE_PREFIX), "survey").alias("table"),
                        F.lit("raw").alias("type"))
    batch = s.select("survey", F.concat(F.lit(SO.FLAT_TABLE_PREFIX), "survey").alias("table"),
                     F.lit("flat").alias("type")) \
        .unionByName(s.select("survey", F.concat(F.lit(SO.RAW_TABLE_PREFIX), "survey").alias("table"),
                              F.lit("raw_again").alias("type")))
    return SO.registry_upsert(existing, batch)


@query
def participant_dim(spark, sf):
    # The dimension as built from the first load, then extended by the whole table.
    ids = lambda variant: R(spark, sf, variant).select(F.get_json_object("data", "$.participantID").alias("global_id"))
    path = _scratch(spark, "dimension")
    SO.update_dimension(spark, path, ids("R_base"))
    SO.update_dimension(spark, path, ids("R"))
    return SO.read_keyed(spark, path)


@query
def survey_info_upsert(spark, sf):
    si = fx.survey_info_rows(spark, sf)
    existing = si.where(F.col("p_partkey") % 5 != 0).select("survey", "version", "published").distinct() \
        .withColumn("source", F.lit("existing"))
    batch = si.select("survey", "version", "published").distinct().withColumn("source", F.lit("batch"))
    return SO.survey_info_upsert(existing, batch, "ignore")


@query
def meta_check(spark, sf):
    """Separators found in the payload keys of two loads; the second wrote ';' in the surveys of even name length."""
    first = R(spark, sf).select("survey", "data")
    other = fx.raw_responses(spark, sf, "R_batch", separator=";").where(F.length("survey") % 2 == 0).select("survey", "data")
    keys = first.unionByName(other).select("survey", F.explode(F.json_object_keys("data")).alias("key"))
    found = keys.select("survey", F.regexp_extract("key", r"([^\w.])", 1).alias("key_separator")).where("key_separator <> ''").distinct()
    return SO.meta_check(found, by=["survey"])


@query
def import_log(spark, sf):
    r = R(spark, sf).withColumn("day", F.to_date(F.timestamp_seconds("submitted")))
    return SO.import_log(r, group=("survey", "day"))


# --- 2.6 joins ----------------------------------------------------------------------------------------

@query
def flag_sync_diff(spark, sf):
    return RC.flag_sync_diff(fx.participants(spark, sf), fx.wanted_flags(spark, sf))


@query
def flag_sync_summary(spark, sf):
    return RC.flag_sync_summary(fx.participants(spark, sf), fx.wanted_flags(spark, sf))


def _pending(spark, sf):
    ids = fx.participants(spark, sf).select(F.col("participantId").alias("id"))
    done = R(spark, sf).select(F.get_json_object("data", "$.participantID").alias("id"))
    return RC.pending_ids(ids, done)


@query
def pending_ids(spark, sf):
    return _pending(spark, sf)


@query
def work_batches(spark, sf):
    return RC.work_batches(_pending(spark, sf), 500, 100)


@query
def missing_versions(spark, sf):
    si = fx.survey_info_rows(spark, sf)
    pub = si.select("survey", "version", "published").distinct()
    return RC.missing_versions(pub, fx.repository_versions(spark, sf), O.MISSING_AFTER)


@query
def survey_name_map(spark, sf):
    s = fx.survey_info_rows(spark, sf).select("survey").distinct()
    return RC.survey_name_map(spark, s, ["intake=Brand#1", "weekly=Brand#2", "vaccination=Brand#3"])


def _schema_rows(spark, sf):
    return RC.schema_rows_from_info(fx.survey_info_rows(spark, sf))


@query
def schema_merge(spark, sf):
    rows = _schema_rows(spark, sf)
    prev = RC.latest_type(rows.where(F.col("published") < O.SPLIT_PUBLISHED))
    new = RC.latest_type(rows.where(F.col("published") >= O.SPLIT_PUBLISHED))
    return RC.schema_merge(prev, new)


@query
def infer_schema(spark, sf):
    """Schema inference from survey info (latest version's question type per column)."""
    return RC.latest_type(_schema_rows(spark, sf))


@query
def type_conflicts(spark, sf):
    return RC.type_conflicts(_schema_rows(spark, sf))


# --- 2.7 aggregations ----------------------------------------------------------------------------------

@query
def flag_counts(spark, sf):
    return ST.flag_counts(fx.participants(spark, sf))


@query
def flag_category(spark, sf):
    return ST.flag_category(fx.participants(spark, sf), "minor")


@query
def flag_summary(spark, sf):
    s = ST.flag_summary(fx.participants(spark, sf), "counter")
    return s.select("n", *[r4(F.col(c)).alias(c) for c in ("mean", "var", "min", "max")], "nan", "invalid")


@query
def multi_stats(spark, sf):
    s = ST.multi_stats(fx.participants(spark, sf), "counts, category:segment, category:minor, summary:counter")
    return s.withColumn("value", r4(F.col("value")))


@query
def assigned_counts(spark, sf):
    # Long form: one row per assignment (no per-participant arrays are built).
    states = fx.participants(spark, sf).select("participantId", "studyStatus")
    return ST.assigned_counts(states, "active", assignments=fx.assignments(spark, sf))


@query
def response_counts(spark, sf):
    return ST.response_counts(R(spark, sf))


@query
def daily_counts(spark, sf):
    """Counted over the first load, then resumed over the whole table."""
    path = _scratch(spark, "daily_counts")
    ST.resume_daily(spark, path, R(spark, sf, "R_base"))
    return ST.resume_daily(spark, path, R(spark, sf)).select("day", "survey", "n")


@query
def time_bounds(spark, sf):
    return ST.time_bounds(R(spark, sf))


@query
def version_counts(spark, sf):
    return ST.version_counts(R(spark, sf)).withColumn("percent", r4(F.col("percent")))


@query
def distinct_versions(spark, sf):
    return ST.distinct_versions(R(spark, sf))


@query
def describe_tables(spark, sf):
    flat = FLAT(spark, sf).select(F.unix_seconds("timestamp").alias("submitted"))
    return ST.describe_tables({"raw": R(spark, sf), "flat": flat})


@query
def latest_version(spark, sf):
    si = fx.survey_info_rows(spark, sf).select("survey", "version", "published").distinct()
    return ST.latest_version(si)


@query
def counter_snapshot(spark, sf):
    ev = fx.table(spark, sf, "events")
    counters = ev.select(F.col("event_type").alias("name"),
                         F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"),
                         F.when(F.col("event_id") % 17 == 0, F.lit("timeout")).alias("error"),
                         F.unix_micros(F.col("ts").cast("timestamp")).alias("time"))
    return ST.counter_snapshot(counters)


# --- 2.8 migration --------------------------------------------------------------------------------------

@query
def email_suffix_filter(spark, sf):
    return MG.email_suffix_filter(fx.old_users(spark, sf), [fx.SKIP_SUFFIX]).select("user_key", "email")


@query
def skip_empty_profiles(spark, sf):
    # Long form: a semi-join to the profile owners, no per-user arrays.
    users = fx.old_users(spark, sf).select("user_key", "email")
    return MG.skip_empty_profiles(users, profiles=fx.user_profiles(spark, sf)).select("user_key")


@query
def main_profile_first(spark, sf):
    # Long form: positions within each user without a per-user array or a per-user task.
    ranked = MG.main_profile_first_long(spark, fx.user_profiles(spark, sf))
    return ranked.select("user_key", "pos", "gid", "main")


@query
def migration_report(spark, sf):
    users = fx.old_users(spark, sf).select("user_key", "email")
    status = MG.migration_status(users, fx.user_profiles(spark, sf), [fx.SKIP_SUFFIX], True)
    return MG.migration_report(status)


@query
def migration_records(spark, sf):
    users = fx.old_users(spark, sf).select("user_key", "email")
    records, profiles = MG.migration_records_long(spark, users, fx.user_profiles(spark, sf), [fx.SKIP_SUFFIX], True, "en", ["study"])
    own = profiles.groupBy("user_key").agg(F.count("*").cast("int").alias("n"), F.max(F.when(F.col("pos") == 0, F.col("gid"))).alias("first_gid"))
    return records.join(own, "user_key", "left").select(
        "accountId", F.coalesce("n", F.lit(0)).alias("n_profiles"), "first_gid", "preferredLanguage", "status")


# --- 2.9 periods, sort, limit --------------------------------------------------------------------------

@query
def period_grid(spark, sf):
    b = R(spark, sf).groupBy("survey").agg((F.floor(F.min("submitted") / 86400) * 86400).cast("bigint").alias("start"),
                                          F.max("submitted").alias("mx"))
    return PD.period_grid(b, "start", "mx")


@query
def period_catalog(spark, sf):
    return PD.period_catalog(R(spark, sf), O.ANCHOR)


@query
def catalog_violations(spark, sf):
    c = R(spark, sf).groupBy("survey", "version").agg(F.min("submitted").alias("start"),
                                                     F.max("submitted").alias("end"))
    return PD.catalog_violations(c, F.lit(O.ANCHOR), F.lit(O.MAX_CATALOG))


@query
def restart_point(spark, sf):
    return PD.restart_point(R(spark, sf))


@query
def ordered_page(spark, sf):
    return PD.ordered_page(R(spark, sf).select("survey", "id", "version", "submitted"), 100, 200)


# --- 2.10 streaming --------------------------------------------------------------------------------------

def _in_two_runs(spark, sf, variant, run):
    """Land the rows in two parts; run the stream on the first, archive its files, run it again on the second.

    The parts mix all days and files come in no order of time; each run takes
    several micro-batches.
    """
    src = _scratch(spark, "landed")
    rows = R(spark, sf, variant)
    late = F.pmod(F.xxhash64("id"), F.lit(2)) == 1
    for k, part in enumerate((rows.where(~late), rows.where(late))):
        SM.land_files(part, f"{src}/part={k}", "json", files=LANDED_FILES)
        run(f"{src}/part=*")
        if k == 0:
            fs, old = SO._hadoop(spark, f"{src}/part=0")
            fs.rename(old, SO._hadoop(spark, f"{src}_archived")[1])


@query
def stream_ingest(spark, sf):
    store = _scratch(spark, "raw_store")
    _in_two_runs(spark, sf, "R_dup", lambda src: SM.ingest_stream(
        spark, src, store, max_files_per_trigger=3, key_catalog=store + "_keys", import_log_path=store + "_log"))
    rows = SO.read_keyed(spark, store)
    payload = F.explode(RW.decode("data")).alias("key", "value")
    return rows.select("survey", "id", "version", "submitted", payload)


@query
def stream_landed(spark, sf):
    """O47 through the data source: a restarted stream goes on behind the files it has taken."""
    src, store = _scratch(spark, "landed"), _scratch(spark, "raw_store")
    rows, late = R(spark, sf, "R_dup"), F.pmod(F.xxhash64("id"), F.lit(2)) == 1
    for k, part in enumerate((rows.where(~late), rows.where(late))):
        SM.land_files(part, f"{src}/part={k}", "json", files=LANDED_FILES)
        SM.ingest_stream(spark, src, store, fmt=LD.LANDED)
    return SO.read_keyed(spark, store).select("survey", "id", "version", "submitted", F.explode(RW.decode("data")).alias("key", "value"))


@query
def stream_build(spark, sf):
    table = _scratch(spark, "flat")
    _in_two_runs(spark, sf, "R_dup", lambda src: SM.build_stream(
        spark, src, table, fx.fixture_profile(), max_files_per_trigger=3, dimension=table + "_dim"))
    flat = SO.read_keyed(spark, table)
    return flat.join(SO.read_keyed(spark, table + "_dim").select("global_id"), "global_id").select(*flat.columns)


@query
def typed_loads(spark, sf):
    """O45 + O32: keys that are whole numbers, numbers, null or text by load; one load comes twice."""
    table, rows = _scratch(spark, "typed"), fx.changing_loads(spark, sf)
    for load in (1, 0, 3, 2, 0):
        flat, kinds = B.build_held(rows.where(F.col("load") == load).drop("load"), {})
        SO.write_keyed(spark, table, flat, ["survey", "id"], kinds=kinds)
    return SO.read_keyed(spark, table).select("survey", "id", "a", "b", "c")


@query
def stream_typed(spark, sf):
    """O48 over the same loads in another order, a run of the stream after each."""
    table, src, rows = _scratch(spark, "flat"), _scratch(spark, "landed"), fx.changing_loads(spark, sf)
    for load in (2, 3, 1, 0):
        SM.land_files(rows.where(F.col("load") == load).drop("load"), f"{src}/part={load}", "json")
        SM.build_stream(spark, f"{src}/part=*", table, {})
    return SO.read_keyed(spark, table).select("survey", "id", "a", "b", "c")


@query
def stream_daily(spark, sf):
    table = _scratch(spark, "daily")
    _in_two_runs(spark, sf, "R_dup", lambda src: SM.daily_stream(spark, src, table, store=table + "_store", max_files_per_trigger=3))
    return SO.read_keyed(spark, table).select("day", "survey", "n")


ORACLE = {k: v for k, v in O.ORACLE.items() if k in QUERIES}
