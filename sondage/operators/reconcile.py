"""Reconciliation between tables (O51-O58): all equi-joins or anti-joins.

No side is broadcast by hint unless its size is bounded by a small
configuration list; otherwise Spark's sort-merge join applies and AQE may
switch to a broadcast after *measuring* a side.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.versions import version_array

def _differs(current, wanted):
    return current.isNull() | ~current.eqNullSafe(wanted)


def flag_sync_diff(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """Flags to update — ``(participantId, flag, current, wanted)``.

    Participants in the file and in the study; ``temporary`` ones are skipped (a
    participant without a status is not); a flag is kept when its current value
    is null or differs from the wanted one, which may be null.
    """
    j = states.where(~F.col("studyStatus").eqNullSafe("temporary")).select("participantId", F.col("flags").alias("cur")) \
        .join(wanted.select("participantId", F.col("flags").alias("want")), "participantId")
    e = j.select("participantId", "cur", F.explode("want").alias("flag", "wanted"))
    cur = F.element_at(F.col("cur"), F.col("flag"))
    return e.select("participantId", "flag", cur.alias("current"), "wanted") \
        .where(_differs(F.col("current"), F.col("wanted")))


def flag_sync_summary(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """``in_file, found, synced, to_update`` — ``synced + to_update = found``.

    One left join from the file to the study, then one aggregate.
    """
    live = states.where(~F.col("studyStatus").eqNullSafe("temporary")) \
        .select("participantId", F.col("flags").alias("cur"), F.lit(True).alias("_found"))
    j = wanted.select("participantId", F.col("flags").alias("want")).join(live, "participantId", "left")
    upd = F.exists(F.map_entries("want"), lambda e: _differs(F.element_at(F.col("cur"), e.getField("key")), e.getField("value")))
    found = F.col("_found").isNotNull()
    return j.agg(F.count("*").cast("bigint").alias("in_file"),
                 F.count(F.when(found, 1)).cast("bigint").alias("found"),
                 F.count(F.when(found & ~upd, 1)).cast("bigint").alias("synced"),
                 F.count(F.when(found & upd, 1)).cast("bigint").alias("to_update"))


def pending_ids(ids: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids not in the done list; both sides are made distinct before they are shuffled."""
    return ids.select(id_col).distinct().join(done.select(id_col).distinct(), id_col, "left_anti")


def work_batches(ids: DataFrame, max_run: int | None, max_batch: int, id_col: str = "id",
                 spark: SparkSession | None = None) -> DataFrame:
    """The first ``max_run`` ids (the run limit is the feature), cut into
    batches of ``max_batch``, all ids without a limit.  Rows are numbered inside
    sorted ranges (``dense_index``), never in one task."""
    from .store import dense_index
    idx = dense_index(spark or ids.sparkSession, ids.select(id_col), id_col, start=0)
    if max_run is not None:
        idx = idx.where(F.col("idx") < max_run)
    return idx.select(id_col, F.floor(F.col("idx") / max_batch).cast("bigint").alias("batch"))


def missing_versions(published: DataFrame, repository: DataFrame, published_after: int | None = None) -> DataFrame:
    """Published ``(survey, version)`` absent from the repository, latest first."""
    p = published if published_after is None else published.where(F.col("published") >= published_after)
    return p.join(repository.select("survey", "version"), ["survey", "version"], "left_anti") \
        .orderBy(F.col("published").desc(), "survey", "version")


def parse_name_map(entries: Sequence[str]) -> dict[str, str]:
    """O56 input: ``['name=key', ...]`` -> ``{key: name}``."""
    out = {}
    for e in entries:
        name, sep, key = e.partition("=")
        if not sep:
            raise ValueError(f"survey name entry {e!r} must be name=key")
        out[key.strip()] = name.strip()
    return out


def survey_name_map(spark: SparkSession, surveys: DataFrame, entries: Sequence[str],
                    key_col: str = "survey") -> DataFrame:
    """Recode survey keys to names; unmapped keys keep their key.

    The mapping is a driver-side configuration list, joined plainly: Spark
    knows its size and picks the join.
    """
    mdf = spark.createDataFrame(list(parse_name_map(entries).items()), f"{key_col} string, _name string")
    return surveys.join(mdf, key_col, "left").withColumn("name", F.coalesce("_name", key_col)).drop("_name")


def latest_type(schema_rows: DataFrame, keys: Sequence[str] = ("survey", "column")) -> DataFrame:
    """One type per column: the type of the latest version (ties -> largest type name)."""
    order = F.struct(version_array(F.col("version")).alias("v"), F.col("type").alias("t"))
    return schema_rows.groupBy(*keys).agg(F.max_by("type", order).alias("type"))


def schema_merge(previous: DataFrame, new: DataFrame, keys: Sequence[str] = ("survey", "column")) -> DataFrame:
    """Merge new column types into a previous schema.

    ``status``: ``kept`` (unchanged or only previous), ``new`` (only new),
    ``conflict`` (same column, other type).  The previous type is kept.
    """
    keys = list(keys)
    j = previous.select(*keys, F.col("type").alias("prev")).join(
        new.select(*keys, F.col("type").alias("nw")), keys, "full_outer")
    status = (F.when(F.col("prev").isNull(), F.lit("new"))
              .when(F.col("nw").isNull() | (F.col("prev") == F.col("nw")), F.lit("kept"))
              .otherwise(F.lit("conflict")))
    return j.select(*keys, F.coalesce("prev", "nw").alias("type"), F.col("nw").alias("new_type"),
                    status.alias("status"))


def type_conflicts(schema_rows: DataFrame, keys: Sequence[str] = ("survey", "column")) -> DataFrame:
    """Columns given more than one type across versions."""
    g = schema_rows.groupBy(*keys).agg(F.array_sort(F.collect_set("type")).alias("types"))
    return g.where(F.size("types") > 1).select(*keys, F.size("types").cast("bigint").alias("n_types"),
                                               F.array_join("types", ",").alias("types"))


def type_of_question(qtype_col: str = "questionType"):
    """Question type -> column type (ours): multiple->bool, date->date, unknown->json, else text."""
    from ..plans.build import QUESTION_TYPE_MAP
    c = F.col(qtype_col)
    expr = F.lit("text")
    for q, t in QUESTION_TYPE_MAP.items():
        expr = F.when(c == q, F.lit(t)).otherwise(expr)
    return expr


def schema_rows_from_info(si: DataFrame, column: str = "column") -> DataFrame:
    """Survey-info rows -> ``(survey, version, column, type)``."""
    return si.select("survey", "version", F.col(column).alias("column"), type_of_question().alias("type"),
                     "published")

