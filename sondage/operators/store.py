"""Keyed writes without a table format.

Upsert modes on a key:

* ``ignore``  keep the existing row; from the batch keep the first row per key
  by ``order`` (deterministic), then append the keys the target lacks.
* ``replace`` the batch wins: target rows whose key is in the batch are
  dropped, the batch's latest row per key is appended.
* ``plain``   a key present twice (in the batch or against the target) is an
  error, from the first write on.

There is one plan whatever the data: rows move once, by key.  The first row
per key is a ``row_number`` filter, of which Spark keeps one row per key in
each task before the shuffle (window group limit), so a hot key does not
travel; the anti join with the stored keys uses the same partitioning.  A key
with nulls is a key like any other: nulls are equal.
"""

from __future__ import annotations

import datetime as _dt
import functools
import uuid
from typing import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.cast import widest
from ..session import checkpoint_dir, tables_dir


# --- fixed values ----------------------------------------------------------------------------
# Table names in the table registry: raw store and flat table of a survey.
RAW_TABLE_PREFIX = "responses_"
FLAT_TABLE_PREFIX = "pollster_results_"
# ---------------------------------------------------------------------------------------------


class DuplicateKeyError(ValueError):
    pass


class SchemaEvolutionError(ValueError):
    pass


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return functools.reduce(lambda x, y: x & y, [left[k].eqNullSafe(right[k]) for k in keys])


def _without(df: DataFrame, other: DataFrame, keys: Sequence[str], kind: str = "left_anti") -> DataFrame:
    """Rows of ``df`` whose key (nulls are equal) is not in ``other``; with ``left_semi`` those whose key is."""
    right = other.select(*[F.col(f"`{k}`") for k in keys]).toDF(*keys)
    return df.join(right, _same_key(df, right, keys), kind)


def _in_partitions(df: DataFrame, touched: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Rows of the table ``df`` in the partitions of ``touched``, whose values become literal filters of the scan.

    Their number is that of the partitions a load touches, as in a listing of its files.
    """
    rows = touched.select(*parts).distinct().collect()
    for p in parts:
        values = {r[p] for r in rows}
        known = [F.lit(v).cast(df.schema[p].dataType) for v in values if v is not None]
        here = df[p].isin(known) if known else F.lit(False)
        df = df.where(here | df[p].isNull() if None in values else here)
    if len(parts) > 1:  # not every pair of the values is touched
        df = _without(df, df.sparkSession.createDataFrame(rows, touched.select(*parts).schema), parts, "left_semi")
    return df


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None,
                  latest: bool = False) -> DataFrame:
    """One row per key: the smallest (or, with ``latest``, largest) by ``order``.

    Without an order all non-key columns order the rows (a total, deterministic
    choice).  Lazy: one exchange on the key, before which each task keeps one
    row per key.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    by = [c.desc_nulls_last() if latest else c.asc_nulls_first() for c in order or [F.col(f"`{c}`") for c in rest]]
    place = "_place"
    while place in df.columns:
        place = "_" + place
    row = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*by))
    return df.withColumn(place, row).where(F.col(place) == 1).drop(place)


def evolve_schema(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Union with additive evolution — new columns appear, missing ones are null.

    A column present on both sides with different types is an error.
    """
    tt = {f.name.lower(): f.dataType for f in target.schema.fields}
    for f in batch.schema.fields:
        t = tt.get(f.name.lower())
        if t is not None and t != f.dataType and not isinstance(f.dataType, T.NullType) \
                and not isinstance(t, T.NullType):
            raise SchemaEvolutionError(f"column {f.name!r}: {t.simpleString()} vs {f.dataType.simpleString()}")
    return target.unionByName(batch, allowMissingColumns=True)


def upsert(target: DataFrame | None, batch: DataFrame, keys: Sequence[str], mode: str = "ignore",
           order: Sequence[Column] | None = None) -> DataFrame:
    """O31 + O32: the new contents of the keyed table (lazy)."""
    keys = list(keys)
    if mode == "ignore":
        fresh = first_per_key(batch, keys, order)
        if target is None:
            return fresh
        return evolve_schema(target, _without(fresh, target, keys))
    if mode == "replace":
        fresh = first_per_key(batch, keys, order, latest=True)
        if target is None:
            return fresh
        return evolve_schema(_without(target, fresh, keys), fresh)
    if mode == "plain":
        dup = batch.groupBy(*keys).count().where(F.col("count") > 1)
        if target is not None:
            dup = dup.select(*keys).unionByName(_without(batch.select(*keys), target, keys, "left_semi"))
        first = dup.limit(1).collect()
        if first:
            raise DuplicateKeyError(f"duplicate key {tuple(first[0][k] for k in keys)}")
        return batch if target is None else evolve_schema(target, batch)
    raise ValueError(f"unknown upsert mode {mode!r}")


# --- snapshots ---------------------------------------------------------------------------------


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, through the Hadoop FileSystem of the path (HDFS, S3, local)."""
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _point(spark: SparkSession, path: str, snapshot: str) -> None:
    """Record ``snapshot`` as the current contents of the table at ``path`` (an append-only log)."""
    stamp = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d%H%M%S%f")
    spark.createDataFrame([(stamp, snapshot)], "stamp string, path string").coalesce(1).write.mode("append").json(f"{path}/_pointers")


def _pointed(spark: SparkSession, path: str) -> str | None:
    """The current snapshot of the table at ``path``; None where it has none."""
    if not path_exists(spark, f"{path}/_pointers"):
        return None
    row = spark.read.schema("stamp string, path string").json(f"{path}/_pointers").agg(F.max_by("path", "stamp").alias("path")).first()
    return row["path"]


def _new_snapshot(path: str) -> str:
    return f"{path}/snap-{_dt.datetime.now(_dt.timezone.utc):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"


def publish(spark: SparkSession, df: DataFrame, table: str, partition_by: Sequence[str] = (), base: str | None = None) -> str:
    """Write ``df`` as a new snapshot of ``table``, then record it as current.

    The previous snapshot stays readable until the new one is recorded, so an
    upsert that reads the current table never overwrites what it reads, and a
    failed job leaves the old contents in place.  Tables live in the warehouse
    (``tables_dir``) unless ``base`` names another folder.
    """
    path = f"{base or tables_dir(spark)}/{table}"
    snapshot = _new_snapshot(path)
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(snapshot)
    _point(spark, path, snapshot)
    return snapshot


def current(spark: SparkSession, table: str, base: str | None = None) -> DataFrame | None:
    """The latest published snapshot of ``table`` (None before the first)."""
    snapshot = _pointed(spark, f"{base or tables_dir(spark)}/{table}")
    return None if snapshot is None else spark.read.parquet(snapshot)


# --- keyed tables --------------------------------------------------------------------------------


KIND_TYPES = {"null": "string", "int": "bigint", "float": "double", "text": "string"}


def _record_kinds(spark: SparkSession, path: str, kinds: Mapping[str, str]) -> None:
    """Add the kinds of a load's columns to the table's record, an append-only log; those it holds already add nothing."""
    known = _recorded_kinds(spark, path)
    new = [(c, k) for c, k in kinds.items() if k not in known.get(c, ())]
    if new:
        spark.createDataFrame(new, "column string, kind string").coalesce(1).write.mode("append").json(f"{path}/_kinds")


def _recorded_kinds(spark: SparkSession, path: str) -> dict[str, set]:
    """{column: kinds of its values in all loads}; at most a few rows for each column."""
    if not path_exists(spark, f"{path}/_kinds"):
        return {}
    out: dict[str, set] = {}
    for r in spark.read.schema("column string, kind string").json(f"{path}/_kinds").distinct().collect():
        out.setdefault(r["column"], set()).add(r["kind"])
    return out


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """A keyed Parquet table (files of several schema generations are merged); None before the first write.

    Columns stored as text with a record of their kinds get the type that holds
    the values of all loads: BIGINT where all are whole numbers, DOUBLE where
    all are numbers, else the text.  So the type widens and never stops a load.
    """
    df = _stored(spark, path)
    if df is None:
        return None
    types = {c.lower(): KIND_TYPES[widest(k)] for c, k in _recorded_kinds(spark, path).items()}
    if set(types.values()) <= {"string"}:
        return df
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) if (t := types.get(c.lower(), "string")) != "string" else F.col(f"`{c}`")
                       for c in df.columns])


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as its files have it; None while it has no file or partition (only records that precede them)."""
    path = _pointed(spark, path) or path
    if not path_exists(spark, path):
        return None
    fs, p = _hadoop(spark, path)
    names = fs.listStatusIterator(p)
    while names.hasNext():  # up to the first name of data
        if not names.next().getPath().getName().startswith(("_", ".")):
            break
    else:
        return None
    return spark.read.option("mergeSchema", "true").parquet(path)


def _check_types(target: DataFrame, batch: DataFrame) -> None:
    evolve_schema(target.limit(0), batch.limit(0))


def _drop_partitions(spark: SparkSession, path: str, parts: Sequence[str], gone: Sequence) -> None:
    """Remove the folders of partitions that hold no row any more."""
    catalog = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for row in gone:
        name = "/".join(f"{p}={catalog.escapePathName(str(row[p])) if row[p] is not None else '__HIVE_DEFAULT_PARTITION__'}" for p in parts)
        fs, p = _hadoop(spark, f"{path}/{name}")
        fs.delete(p, True)


def write_keyed(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], mode: str = "ignore",
                partition_by: Sequence[str] = ("survey",), order: Sequence[Column] | None = None,
                kinds: Mapping[str, str] | None = None) -> int:
    """Keyed write into a Parquet table; the key holds across all partitions.

    Stored keys are looked up in the partitions that can hold them: those that
    agree with the batch on the partition columns that are part of the key
    (a filter of the partitions scans these only, and only the key columns).

    * ``ignore``: the batch's first row per key, minus keys already stored, is
      *appended*; stored files are never rewritten.  Re-running the same batch
      adds nothing, so a retried micro-batch is idempotent.
    * ``replace``: the partitions the batch touches, and those that hold a row
      it replaces, are recomputed, checkpointed, and written with dynamic
      partition overwrite; one left empty is removed.  A run that failed in
      between is healed by running the batch again.
    * ``plain``: appended; a key that is there already, or twice in the batch,
      is an error.

    Without partitions the table is a chain of snapshots: ``replace`` writes a
    new one and then points to it, so a failure leaves the old one current.
    New columns are added (files are read with schema merging); a column whose
    type changes is an error, but for those in ``kinds`` (from ``build_held``),
    which are stored as text and typed by all loads' kinds in ``read_keyed``.
    The kinds are recorded before the rows, so readers in between see the wider
    type at most.  Returns the number of rows written.
    """
    keys, parts = list(keys), list(partition_by)
    if mode not in ("ignore", "replace", "plain"):
        raise ValueError(f"unknown mode {mode!r}")
    checkpoint_dir(spark)  # checkpoints below go to the shared folder the session names
    target = _stored(spark, path)
    if target is not None:
        _check_types(target, batch)
    if kinds:
        _record_kinds(spark, path, kinds)
    home = path if parts else _pointed(spark, path)

    def w(df: DataFrame):
        # A table partition's new rows come together before they are written (a large one is
        # spread): every task would else add a file to every partition, and later loads open them all.
        if parts:
            df = df.hint("rebalance", *[F.col(f"`{p}`") for p in parts])
        # Files sorted by submission time inside each partition keep row-group
        # statistics selective for time filters (a local sort, no shuffle).
        if "submitted" in df.columns:
            df = df.sortWithinPartitions(*parts, "submitted")
        return df.write.partitionBy(*parts) if parts else df.write

    if target is None or mode != "replace":
        known = target
        shared = [p for p in parts if p in keys]
        if known is not None and shared:
            known = _in_partitions(known, batch, shared)
        if mode == "plain":
            upsert(known, batch, keys, "plain")  # raises on a duplicate key
            fresh = batch
        else:
            fresh = first_per_key(batch, keys, order, latest=mode == "replace")
            fresh = fresh if known is None else _without(fresh, known, keys)
        fresh = fresh.checkpoint()  # counted and written from one materialization
        n = fresh.count()
        if n or target is None:
            if home is None:
                home = _new_snapshot(path)
                w(fresh).mode("append").parquet(home)
                _point(spark, path, home)
            else:
                w(fresh).mode("append").parquet(home)
        return n
    fresh = first_per_key(batch, keys, order, latest=True).checkpoint()
    scope = target
    if parts:
        near = _in_partitions(target, fresh, shared) if (shared := [p for p in parts if p in keys]) else target
        held = _without(near.select(*dict.fromkeys([*keys, *parts])), fresh, keys, "left_semi").select(*parts)
        touched = held.unionByName(fresh.select(*parts)).distinct().checkpoint()
        scope = _in_partitions(target, touched, parts)
    new = evolve_schema(_without(scope, fresh, keys), fresh).checkpoint()
    if parts:
        gone = _without(touched, new.select(*parts).distinct(), parts).collect()  # partitions of this batch only
        w(new).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        _drop_partitions(spark, path, parts, gone)
    else:
        snapshot = _new_snapshot(path)
        w(new).parquet(snapshot)
        _point(spark, path, snapshot)
    return new.count()


# --- numbering -----------------------------------------------------------------------------------


def _placed(spark: SparkSession, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` in ranges of ``keys``, sorted, with its range ``_p`` and place in it ``_n``; checkpointed.

    ``monotonically_increasing_id`` numbers the rows of each sorted range where
    they are, so nothing is shuffled twice.
    """
    checkpoint_dir(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id()  # range in the upper bits, place in the lower 33
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", at).checkpoint()
    return ranged.withColumn("_p", F.shiftright("_at", 33)).withColumn("_n", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def dense_index(spark: SparkSession, df: DataFrame, order_col: str, start: int = 1,
                name: str = "idx") -> DataFrame:
    """Dense row numbers in ``order_col`` order, without a global window.

    A row's number is its place in its range plus the rows of all earlier
    ranges.  The offsets have one row per range, a proven bound, so they are
    broadcast.
    """
    ranged = _placed(spark, df, [order_col])
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c")).collect()  # one row per range
    offsets, acc = [], start
    for r in sorted(counts, key=lambda r: r["_p"]):
        offsets.append((r["_p"], acc))
        acc += r["_c"]
    off_df = spark.createDataFrame(offsets, "_p bigint, _off bigint")
    return ranged.join(F.broadcast(off_df), "_p").withColumn(name, F.col("_off") + F.col("_n")).drop("_p", "_n", "_off")


def rank_within_group(spark: SparkSession, df: DataFrame, group: str, order: Sequence[str], name: str = "pos",
                      start: int = 0) -> DataFrame:
    """Position of each row inside its group, in ``order``, with no group held by one task.

    Rows are in ranges of ``(group, *order)``, so a hot group spans several.
    For each (range, group) one row tells where the group begins in the range
    and how many of its rows lie in earlier ranges; a row's position is the
    sum of that and its place after the beginning.
    """
    ranged = _placed(spark, df, [group, *order])
    stretches = ranged.groupBy("_p", group).agg(F.count("*").alias("_c"), F.min("_n").alias("_first"))
    earlier = F.sum("_c").over(Window.partitionBy(group).orderBy("_p")) - F.col("_c")
    offsets = stretches.select("_p", group, (earlier - F.col("_first") + F.lit(start)).alias("_off"))
    return (ranged.join(offsets, ["_p", group])
            .withColumn(name, (F.col("_off") + F.col("_n")).cast("int")).drop("_p", "_n", "_off"))


# --- participant dimension ----------------------------------------------------------------------


def new_participants(spark: SparkSession, responses: DataFrame, dim: DataFrame | None,
                     id_col: str = "global_id") -> DataFrame:
    """The ``global_id`` values that the dimension lacks, with the dense ids that follow its largest."""
    seen = responses.select(F.col(id_col).alias("global_id")).where(F.col("global_id").isNotNull()).distinct()
    base = 0
    if dim is not None:
        seen = seen.join(dim.select("global_id"), "global_id", "left_anti")
        base = dim.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).first()[0]
    return dense_index(spark, seen, "global_id", start=base + 1, name="id").select("id", "global_id")


def participant_dim(spark: SparkSession, responses: DataFrame, dim: DataFrame | None,
                    id_col: str = "global_id") -> DataFrame:
    """Add unseen ``global_id`` values with dense surrogate ids after the current max.

    New ids follow the sorted ``global_id`` order (``dense_index``: no global window).
    """
    new = new_participants(spark, responses, dim, id_col)
    return new if dim is None else dim.select("id", "global_id").unionByName(new)


def update_dimension(spark: SparkSession, path: str, responses: DataFrame, id_col: str = "global_id") -> int:
    """O34 on a stored dimension: append the participants it lacks; how many."""
    return write_keyed(spark, path, new_participants(spark, responses, read_keyed(spark, path), id_col), ["global_id"], "ignore", ())


# --- registry, survey info, meta, import log ----------------------------------------------------


def registry_upsert(registry: DataFrame | None, entries: DataFrame) -> DataFrame:
    """``(survey, table, type)`` keyed by ``table``, duplicates ignored."""
    return upsert(registry, entries.select("survey", "table", "type"), ["table"], "ignore")


def survey_info_upsert(info: DataFrame | None, batch: DataFrame, mode: str = "replace") -> DataFrame:
    """Survey-info rows keyed by ``(survey, version)``, replace or ignore."""
    return upsert(info, batch, ["survey", "version"], mode)


def meta_check(meta: DataFrame, column: str = "key_separator", by: Sequence[str] = ()) -> DataFrame:
    """The separator is fixed after the first write — one distinct value at most.

    Returns ``(n_values, consistent)``, for each store named by the ``by``
    columns; ``streaming.ensure_meta`` refuses a load that would break it.
    """
    return meta.groupBy(*by).agg(F.count_distinct(column).cast("bigint").alias("n_values")) \
        .withColumn("consistent", F.col("n_values") <= 1)


def import_log(batch: DataFrame, time_col: str = "submitted", group: Sequence[str] = ("survey",),
               load_time: Column | None = None) -> DataFrame:
    """One log row per non-empty load: ``(survey, start, end, n)`` from min/max."""
    out = batch.groupBy(*group).agg(F.min(time_col).alias("start"), F.max(time_col).alias("end"),
                                    F.count("*").alias("n"))
    if load_time is not None:
        out = out.withColumn("time", load_time)
    return out


# --- file export --------------------------------------------------------------------------------


def export_responses(df: DataFrame, path: str, fmt: str = "csv",
                     partition_by: Sequence[str] = ("survey", "period_start")) -> None:
    """One file set per survey and period; dynamic partition overwrite, so a
    re-export replaces only the periods it covers."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")


def export_with_catalog(spark: SparkSession, df: DataFrame, path: str, anchor: int, fmt: str = "csv",
                        layout: str = "wide", ids: Sequence[str] = ("id",), time_col: str = "submitted",
                        period_days: int = 7, headers: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """O09 + O18 + O39: export responses, one file set per survey and period, and return the stored catalog.

    A file set is a folder ``{survey}_responses_{start}_{end}.{ext}`` of part
    files.  ``layout='long'`` writes one row per id x column (O10); ``headers``
    are rename rules for the written columns.  The catalog at
    ``path/catalog`` has a row per exported period ``(survey, start, end, n,
    file, updated)``; an export replaces the periods present in ``df`` and
    keeps the others, and ``periods.catalog_restart`` reads it.  The rows are
    counted and written from one evaluation (kept meanwhile, if the caller does not).
    """
    if df.storageLevel == StorageLevel.NONE:
        df.persist()
        try:
            return export_with_catalog(spark, df, path, anchor, fmt, layout, ids, time_col, period_days, headers)
        finally:
            df.unpersist()
    from ..functions.rename import header_rename
    from .periods import file_name, period_of
    from .reshape import wide_to_long
    checkpoint_dir(spark)  # the periods are kept in the shared folder
    step = period_days * 86400
    start = period_of(F.col(time_col), anchor, period_days)
    rows = df.withColumn("file", file_name(F.col("survey"), start, start + F.lit(step), fmt)).withColumn("period_start", start)
    periods = rows.groupBy("survey", F.col("period_start").alias("start"), (F.col("period_start") + step).alias("end"), "file") \
        .agg(F.count("*").alias("n")).checkpoint()
    rows = rows.drop("period_start")
    if layout == "long":
        keep = [*ids, "survey", "file"]
        rows = wide_to_long(rows, keep, [c for c in rows.columns if c not in keep])
    elif layout != "wide":
        raise ValueError(f"unknown layout {layout!r}")
    if headers:
        rows = header_rename(rows, headers)
    staged = f"{path}/.staged-{uuid.uuid4().hex}"
    export_responses(rows, staged, fmt, ("file",))
    for r in periods.select("file").collect():  # a row per period of this export
        fs, new = _hadoop(spark, f"{path}/{r['file']}")
        fs.delete(new, True)
        fs.rename(_hadoop(spark, f"{staged}/file={r['file']}")[1], new)
    fs, rest = _hadoop(spark, staged)
    fs.delete(rest, True)
    entries = periods.select("survey", "start", "end", "n", "file", F.current_timestamp().alias("updated"))
    write_keyed(spark, f"{path}/catalog", entries, ["survey", "start"], "replace", ())
    return read_keyed(spark, f"{path}/catalog")


def read_export(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame:
    r = spark.read
    if schema:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", "true").csv(path)
    if fmt == "json":
        return r.json(path)
    return r.parquet(path)
