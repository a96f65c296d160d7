"""Participant and response statistics.

Every statistic is a built-in aggregate, so Spark computes it with a partial
(map-side) step and a small final merge; a multi-statistic run shares one
``agg`` for the summaries and one ``explode`` for the frequencies.
"""

from __future__ import annotations

from typing import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cast import parse_number
from ..functions.versions import version_array

# --- fixed values ----------------------------------------------------------------------------
NA_VALUE = "_NA_"
COUNTS_DEFAULT_NAME = "counts"
LABEL_COUNTS = "Field occurence frequency"
LABEL_CATEGORY = "Values frequency of field %s"
LABEL_SUMMARY = "Summary of field '%s'"
SUMMARY_KEYS = ["n", "mean", "var", "min", "max", "nan", "invalid"]
KNOWN_COLLECTORS = ["counts", "summary", "category"]
# ---------------------------------------------------------------------------------------------

LONG_SCHEMA = "name string, type string, label string, key string, value double"


def flag_counts(states: DataFrame, flags_col: str = "flags") -> DataFrame:
    """O59 ``counts``: occurrences of each flag key (null values count)."""
    return (states.select(F.explode(F.map_keys(flags_col)).alias("key"))
            .groupBy("key").agg(F.count("*").alias("n")))


def flag_category(states: DataFrame, field: str, flags_col: str = "flags") -> DataFrame:
    """O60 ``category:f``: frequency of the values of ``f``; absent key skipped, null -> ``_NA_``."""
    m = F.col(flags_col)
    return (states.where(F.map_contains_key(m, F.lit(field)))
            .select(F.coalesce(F.element_at(m, F.lit(field)), F.lit(NA_VALUE)).alias("value"))
            .groupBy("value").agg(F.count("*").alias("n")))


def summary_inputs(value: Column, present: Column, prefix: str = "") -> list[Column]:
    """Per-row inputs of O23, computed once in a projection: the parsed number and presence."""
    return [parse_number(value).alias(prefix + "x"), present.alias(prefix + "present")]


def summary_aggs(prefix: str = "") -> list[Column]:
    """O23 as aggregate Columns over ``summary_inputs``.

    ``n/mean/var(pop)/min/max`` over the valid non-NaN numbers, ``nan`` the NaN
    count, ``invalid`` the count of present values that are not numbers (null
    included).  Spark's ``max`` ranks NaN highest, so NaN is filtered first.
    """
    x, present = F.col(prefix + "x"), F.col(prefix + "present")
    valid = present & x.isNotNull() & ~F.isnan(x)
    xv = F.when(valid, x)
    return [
        F.count(xv).cast("bigint").alias(prefix + "n"),
        F.avg(xv).alias(prefix + "mean"),
        F.var_pop(xv).alias(prefix + "var"),
        F.min(xv).alias(prefix + "min"),
        F.max(xv).alias(prefix + "max"),
        F.count(F.when(present & x.isNotNull() & F.isnan(x), 1)).cast("bigint").alias(prefix + "nan"),
        F.count(F.when(present & x.isNull(), 1)).cast("bigint").alias(prefix + "invalid"),
    ]


def flag_summary(states: DataFrame, field: str, flags_col: str = "flags") -> DataFrame:
    """O23 ``summary:f`` over a flag; with n = 0 the mean/var/min/max are null."""
    m = F.col(flags_col)
    present = F.coalesce(F.map_contains_key(m, F.lit(field)), F.lit(False))
    return states.select(*summary_inputs(F.element_at(m, F.lit(field)), present)).agg(*summary_aggs())


# --- O61: several collectors in one pass ----------------------------------------------------------


#: A user's collector: (states, field) -> DataFrame ``(key, value)``, built from aggregates or a grouped pandas UDF.
Collector = Callable[[DataFrame, str], DataFrame]


def parse_collectors(spec, own: Mapping[str, Collector] | None = None) -> list[dict]:
    """Collector specs: ``'counts, category:segment'``, or a list of such strings
    and dicts ``{'type', 'field', 'name'}``.  Names must be unique; ``own`` adds
    types."""
    out = []

    def add(ctype, field, name):
        ctype = (ctype or "").strip()
        if ctype not in KNOWN_COLLECTORS and ctype not in (own or {}):
            raise ValueError(f"unknown collector type {ctype!r}")
        field = field.strip() if isinstance(field, str) else field
        if ctype != "counts" and not field:
            raise ValueError(f"{ctype!r} collector needs a field after ':'")
        if name is None:
            name = COUNTS_DEFAULT_NAME if ctype == "counts" else f"{ctype}_{field}"
        out.append({"type": ctype, "field": field, "name": name})

    items = spec if isinstance(spec, (list, tuple)) else [spec]
    for pos, item in enumerate(items):
        try:
            if isinstance(item, str):
                for d in item.split(","):
                    ctype, _, field = d.partition(":")
                    add(ctype, field or None, None)
            elif isinstance(item, Mapping):
                add(item.get("type"), item.get("field"), item.get("name"))
            else:
                raise ValueError("collector definition must be text or dict")
        except ValueError as e:
            raise ValueError(f"collector definition {pos}: {e}") from e
    names = [c["name"] for c in out]
    dups = {n for n in names if names.count(n) > 1}
    if dups:
        raise ValueError(f"collector(s) registered twice: {sorted(dups)}")
    return out


def multi_stats(states: DataFrame, spec="counts", flags_col: str = "flags", own: Mapping[str, Collector] | None = None) -> DataFrame:
    """All collectors, long result ``(name, type, label, key, value)``.

    Without a spec only ``counts`` runs (the reference's default).  ``own`` holds
    further collector types by name.

    Summaries share one aggregate; counts and categories share one explode of
    the flag map and one grouped count.
    """
    cols = parse_collectors(spec, own)
    m = F.col(flags_col)
    parts: list[DataFrame] = []
    freq = [c for c in cols if c["type"] in ("counts", "category")]
    if freq:
        e = states.select(F.explode(m).alias("k", "v"))
        tags = []
        for c in freq:
            if c["type"] == "counts":
                tags.append(F.struct(F.lit(c["name"]).alias("name"), F.lit("frequency").alias("type"),
                                     F.lit(LABEL_COUNTS).alias("label"), F.col("k").alias("key")))
            else:
                tags.append(F.when(F.col("k") == F.lit(c["field"]), F.struct(
                    F.lit(c["name"]).alias("name"), F.lit("frequency").alias("type"),
                    F.lit(LABEL_CATEGORY % c["field"]).alias("label"),
                    F.coalesce(F.col("v"), F.lit(NA_VALUE)).alias("key"))))
        t = e.select(F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("t")).select("t.*")
        parts.append(t.groupBy("name", "type", "label", "key").agg(F.count("*").cast("double").alias("value")))
    summ = [c for c in cols if c["type"] == "summary"]
    if summ:
        inputs, aggs = [], []
        for i, c in enumerate(summ):
            present = F.coalesce(F.map_contains_key(m, F.lit(c["field"])), F.lit(False))
            inputs.extend(summary_inputs(F.element_at(m, F.lit(c["field"])), present, prefix=f"s{i}_"))
            aggs.extend(summary_aggs(prefix=f"s{i}_"))
        wide = states.select(*inputs).agg(*aggs)
        entries = []
        for i, c in enumerate(summ):
            for k in SUMMARY_KEYS:
                entries.append(F.struct(F.lit(c["name"]).alias("name"), F.lit("summary").alias("type"),
                                        F.lit(LABEL_SUMMARY % c["field"]).alias("label"),
                                        F.lit(k).alias("key"), F.col(f"s{i}_{k}").cast("double").alias("value")))
        parts.append(wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*"))
    for c in cols:
        if c["type"] in (own or {}):
            made = own[c["type"]](states, c["field"])
            parts.append(made.select(F.lit(c["name"]).alias("name"), F.lit(c["type"]).alias("type"), F.lit(f"{c['type']} of {c['field']}").alias("label"),
                                     F.col("key").cast("string").alias("key"), F.col("value").cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- participants and responses -------------------------------------------------------------------


def assigned_counts(states: DataFrame, status: str | None = "active",
                    assignments: DataFrame | None = None) -> DataFrame:
    """Participants per (surveyKey, category) of their assigned surveys.

    ``states`` holds nested ``assignedSurveys``; or pass ``assignments``
    ``(participantId, surveyKey, category)`` in long form, semi-joined to the
    participants with the status.
    """
    s = states if status in (None, "all") else states.where(F.col("studyStatus") == F.lit(status))
    if assignments is not None:
        return (assignments.join(s.select("participantId"), "participantId", "left_semi")
                .groupBy("surveyKey", "category").agg(F.count("*").alias("n")))
    return (s.select(F.explode("assignedSurveys").alias("a"))
            .groupBy(F.col("a.surveyKey").alias("surveyKey"), F.col("a.category").alias("category"))
            .agg(F.count("*").alias("n")))


def response_counts(raw: DataFrame, start=None, end=None) -> DataFrame:
    """Responses per survey, optionally in a time range."""
    from ..sources.raw import time_range_filter
    return time_range_filter(raw, start, end).groupBy("survey").agg(F.count("*").alias("n"))


def daily_counts(raw: DataFrame, time_col: str = "submitted", since=None) -> DataFrame:
    """Responses per (day, survey); ``since`` (a date) restricts to the restart day on."""
    from ..sources.raw import day_of, time_range_filter
    if since is not None:  # on the time itself, which the scan can push down (and the day partition, if there is one)
        at = since if isinstance(since, str) else since.isoformat()
        raw = time_range_filter(raw, at[:10] + "T00:00:00", column=time_col)
    df = raw.select(day_of(F.col(time_col)).alias("day"), "survey")
    return df.groupBy("day", "survey").agg(F.count("*").alias("n"))


def merge_daily(existing: DataFrame, fresh: DataFrame, restart_day) -> DataFrame:
    """O63 resumable: keep days before the restart, replace the rest by ``fresh``."""
    keep = existing.where(F.col("day") < F.lit(restart_day).cast("date"))
    return keep.unionByName(fresh.where(F.col("day") >= F.lit(restart_day).cast("date")))


def resume_daily(spark: SparkSession, path: str, raw: DataFrame, time_col: str = "submitted") -> DataFrame:
    """O63 end to end: the stored counts at ``path``, brought up to date from ``raw``.

    Counts restart at the last day stored, which may have been incomplete; its
    rows are replaced, and earlier days are pruned from the scan of ``raw``.
    """
    from .store import read_keyed, write_keyed
    done = read_keyed(spark, path)
    since = None if done is None else done.agg(F.max("day")).first()[0]
    write_keyed(spark, path, daily_counts(raw, time_col, since), ["day", "survey"], "replace", ("day",))
    return read_keyed(spark, path)


def time_bounds(raw: DataFrame, time_col: str = "submitted") -> DataFrame:
    """min/max submission time per survey."""
    return raw.groupBy("survey").agg(F.min(time_col).alias("min_time"), F.max(time_col).alias("max_time"))


def version_counts(raw: DataFrame) -> DataFrame:
    """Rows per (survey, version), the survey total and the percent share.

    The total is a window over the *aggregated* rows, partitioned by survey.
    """
    c = raw.groupBy("survey", "version").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("survey"))
    return c.select("survey", "version", "n", total.alias("total"),
                    (F.col("n") * 100.0 / total).alias("percent"))


def distinct_versions(raw: DataFrame, start=None, end=None) -> DataFrame:
    """Versions present, optionally in a time range."""
    from ..sources.raw import time_range_filter
    return time_range_filter(raw, start, end).select("survey", "version").distinct()


def describe_tables(tables: Mapping[str, DataFrame], time_col: str = "submitted") -> DataFrame:
    """``(table, rows, min_time, max_time)`` per table, one aggregate each."""
    out = None
    for name, df in tables.items():
        t = df.agg(F.count("*").alias("rows"), F.min(time_col).cast("bigint").alias("min_time"),
                   F.max(time_col).cast("bigint").alias("max_time")).select(F.lit(name).alias("table"), "*")
        out = t if out is None else out.unionByName(t)
    return out


def latest_version(info: DataFrame) -> DataFrame:
    """The current published version per survey (latest ``published``; of those the largest version)."""
    order = F.struct(F.col("published"), version_array("version"), F.col("version"))
    return info.groupBy("survey").agg(F.max_by("version", order).alias("version"), F.max("published").alias("published"))


def counter_snapshot(counters: DataFrame) -> DataFrame:
    """Counters with a value and no error; the latest value per name and the snapshot time."""
    ok = counters.where(F.col("value").isNotNull() & F.col("error").isNull())
    return ok.groupBy("name").agg(F.max_by("value", "time").alias("value"), F.max("time").alias("time"))


# --- O70: payload size by codec -------------------------------------------------------------------

CODECS = ["none", "snappy", "gzip", "zstd"]


def codec_sizes(spark: SparkSession, raw: DataFrame, folder: str, data_col: str = "data") -> DataFrame:
    """What the payloads take on storage under each codec: ``(codec, bytes, percent)``.

    Spark writes the payload column once with each codec under ``folder`` and
    reads the sizes of the files; ``percent`` is of the uncompressed files.
    """
    out = None
    for codec in CODECS:
        path = f"{folder}/codec={codec}"
        raw.select(data_col).write.mode("errorifexists").option("compression", codec).parquet(path)
        files = spark.read.parquet(path).select(F.col("_metadata.file_path"), F.col("_metadata.file_size")).distinct()
        one = files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")).select(F.lit(codec).alias("codec"), "bytes")
        out = one if out is None else out.unionByName(one)
    base = out.filter(F.col("codec") == CODECS[0]).select(F.col("bytes").alias("_all")).first()["_all"]
    return out.withColumn("percent", F.col("bytes") * 100.0 / F.lit(base or 1))
