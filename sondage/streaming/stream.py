"""Structured Streaming jobs.

* ``ingest_stream``  new response files -> raw store, one row per (survey, id),
  ``"TRUE"``/``"FALSE"`` recoded (O03).  Each micro-batch *appends* only the keys
  the store lacks, so a retried micro-batch adds nothing and stored files are
  never rewritten.  It also records its distinct ``(survey, version, key)`` in a
  key catalog, so a later build needs no discovery pass over the payloads.
* ``build_stream``   each micro-batch through the flat build, appended to the
  flat table the same way (additive schema evolution), the participant
  dimension extended with it.
* ``daily_stream``   daily counts per survey.  Each micro-batch goes into the raw
  store, then the days it touches are counted anew from the store, so counts
  are right in whatever order files land.  With ``lateness`` the counts come
  from windowed state with a watermark instead (``update`` mode).

Every job's checkpoint belongs to its target (``<target>.checkpoint`` unless
named), so a job started again goes on where the last one stopped; files it has
read may be archived.  A micro-batch is persisted while it is worked on.

Jobs run with ``Trigger.AvailableNow`` by default (process what has landed,
then stop).  With ``interval`` ('30 seconds') they run on until stopped, and
the running query is returned.

Streaming state: no unbounded ``dropDuplicates`` on ids (it would grow for
ever); de-duplication happens against the store inside ``foreachBatch``, and
the watermark bounds the windowed-count state.
"""

from __future__ import annotations

from typing import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema_rows
from ..operators.store import _in_partitions, import_log, read_keyed, update_dimension, write_keyed
from ..plans.build import build_held
from ..session import tables_dir
from ..sources.landed import LANDED, register_landed
from ..sources.raw import day_of, recode_json

RAW_SCHEMA = "survey string, id string, submitted bigint, version string, data string"


def table_path(spark: SparkSession, name: str) -> str:
    return f"{tables_dir(spark)}/{name}"


def _start(stream: DataFrame, merge: Callable[[DataFrame, int], None], target: str, checkpoint: str | None,
           interval: str | None, mode: str = "append"):
    """Run ``merge`` on every micro-batch that has rows; the checkpoint belongs to the target."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                merge(batch, epoch)
        finally:
            batch.unpersist()

    w = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint or f"{target}.checkpoint")
    if interval:
        return w.trigger(processingTime=interval).start()
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def _source(spark: SparkSession, source_dir: str, fmt: str, max_files_per_trigger: int | None) -> DataFrame:
    """Landed rows as a stream; ``landed_responses`` is the library's own data source, which takes all that has landed."""
    if fmt == LANDED:
        return spark.readStream.format(register_landed(spark)).option("path", source_dir).load()
    reader = spark.readStream.schema(RAW_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source_dir)


def batch_keys(batch: DataFrame) -> DataFrame:
    """Distinct ``(survey, version, key)`` of a batch of raw rows (schema-sized)."""
    return batch.select("survey", "version", F.explode(F.json_object_keys("data")).alias("key")).distinct()


def load_key_catalog(spark: SparkSession, path: str) -> dict[tuple, list[str]]:
    """The key catalog as build ``keys``: ``{(survey, version): [keys]}`` (the survey schema, of a declared size)."""
    cat = read_keyed(spark, path)
    rows = [] if cat is None else schema_rows(cat.select("survey", "version", "key").distinct(), f"key catalog at {path}")
    out: dict[tuple, list[str]] = {}
    for r in sorted(rows, key=lambda r: r["key"]):
        out.setdefault((r["survey"], r["version"]), []).append(r["key"])
    return out


def ensure_meta(spark: SparkSession, meta_path: str, key_separator: str = "|", compressor: str = "none") -> None:
    """The store's separator and codec are fixed by its first load; a later load
    with other values is an error.  The meta is a one-row table written once."""
    current = read_keyed(spark, meta_path)
    mine = spark.createDataFrame([(key_separator, compressor)], "key_separator string, compressor string")
    if current is None:
        mine.coalesce(1).write.mode("errorifexists").parquet(meta_path)
        return
    row = current.first()
    if (row["key_separator"], row["compressor"]) != (key_separator, compressor):
        raise ValueError(f"store was created with separator {row['key_separator']!r} and codec "
                         f"{row['compressor']!r}, not {key_separator!r} / {compressor!r}")


def ingest_batch(spark: SparkSession, rows: DataFrame, store: str, key_catalog: str | None = None,
                 import_log_path: str | None = None, partition_by=("survey", "day"), load: str | None = None,
                 recode: bool = True) -> int:
    """O47 (batch form) + O03 + O50: one load of raw rows into the keyed raw store.

    New ``(survey, id)`` are appended wherever the stored row lies (a repeated
    load adds nothing), the key catalog gets the load's keys, and the import
    log one row per survey with the load's time range.  A load without a name
    is logged if it added rows; a named one (``load``) once, however often it is
    tried.  Returns the number of rows added.
    """
    if recode:  # read by the store and by the key catalog
        rows = rows.withColumn("data", recode_json("data")).persist()
        try:
            return ingest_batch(spark, rows, store, key_catalog, import_log_path, partition_by, load, False)
        finally:
            rows.unpersist()
    order = [F.col("version"), F.col("submitted"), F.col("data")]
    data = rows.withColumn("day", day_of(F.col("submitted"))) if "day" in partition_by else rows
    added = write_keyed(spark, store, data, ["survey", "id"], "ignore", tuple(partition_by), order)
    if key_catalog:
        write_keyed(spark, key_catalog, batch_keys(rows), ["survey", "version", "key"], "ignore", ("survey",))
    if import_log_path and (added or load is not None):
        log = import_log(rows, load_time=F.current_timestamp())
        name = F.lit(load) if load is not None else F.date_format("time", "yyyyMMddHHmmssSSSSSS")
        write_keyed(spark, import_log_path, log.withColumn("load", name), ["survey", "load"], "ignore", ())
    return added


def ingest_stream(spark: SparkSession, source_dir: str, store: str, fmt: str = "json",
                  interval: str | None = None, max_files_per_trigger: int | None = None,
                  key_catalog: str | None = None, partition_by=("survey", "day"),
                  import_log_path: str | None = None, meta_path: str | None = None,
                  key_separator: str = "|", checkpoint: str | None = None, recode: bool = True):
    """Landed response files -> raw store (``ignore`` on ``(survey, id)``)."""
    if meta_path:
        ensure_meta(spark, meta_path, key_separator)

    def merge(batch: DataFrame, epoch: int) -> None:
        ingest_batch(spark, batch, store, key_catalog, import_log_path, partition_by, f"batch {epoch}", recode)

    return _start(_source(spark, source_dir, fmt, max_files_per_trigger), merge, store, checkpoint, interval)


def build_stream(spark: SparkSession, source_dir: str, table: str, profile: Mapping,
                 fmt: str = "json", interval: str | None = None, max_files_per_trigger: int | None = None,
                 checkpoint: str | None = None, key_catalog: str | None = None, dimension: str | None = None):
    """Each micro-batch of raw rows through the flat build into the flat table.

    With ``key_catalog`` the build takes its keys from there (kept by
    ``ingest_stream``), all text; with ``dimension`` the participants are added
    to it.  A key may change from numbers to others or to text from batch to
    batch: ``read_keyed`` gives it the type that holds them all.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spec = dict(profile, keys=load_key_catalog(spark, key_catalog)) if key_catalog else profile
        flat, kinds = build_held(batch, spec)
        write_keyed(spark, table, flat, ["survey", "id"], "ignore", ("survey",), kinds=kinds)
        if dimension:
            seen = batch.select(F.get_json_object("data", "$.participantID").alias("global_id"))
            update_dimension(spark, dimension, seen)

    return _start(_source(spark, source_dir, fmt, max_files_per_trigger), merge, table, checkpoint, interval)


def daily_counts_stream(events: DataFrame, lateness: str = "1 day", window: str = "1 day") -> DataFrame:
    """O49 query part: watermark on the event time, dedupe within the watermark, tumbling count."""
    ts = F.timestamp_seconds(F.col("submitted")).alias("ts")
    e = events.select("survey", "id", ts).withWatermark("ts", lateness)
    e = e.dropDuplicatesWithinWatermark(["survey", "id"])
    return e.groupBy(F.window("ts", window).alias("w"), "survey").agg(F.count("*").alias("n")) \
        .select(F.to_date(F.col("w.start")).alias("day"), "survey", "n")


def daily_stream(spark: SparkSession, source_dir: str, table: str, store: str | None = None, fmt: str = "json",
                 lateness: str | None = None, interval: str | None = None, max_files_per_trigger: int | None = None,
                 checkpoint: str | None = None):
    """Daily counts per survey in a keyed table (``replace`` on day and survey).

    Either from the raw ``store``, which each micro-batch is added to first, or
    with ``lateness`` from windowed state: rows later than the watermark are
    then not counted.
    """
    if (store is None) == (lateness is None):
        raise ValueError("give either the store to count from or the lateness of windowed counts")
    src = _source(spark, source_dir, fmt, max_files_per_trigger)

    def put(counts: DataFrame) -> None:
        write_keyed(spark, table, counts, ["day", "survey"], "replace", ("survey",), [F.col("n")])

    def merge(batch: DataFrame, epoch: int) -> None:
        if lateness is not None:
            put(batch)
            return
        ingest_batch(spark, batch, store)
        # of the whole batch, not of the rows added: a retry after a failed count counts again
        touched = batch.select("survey", day_of(F.col("submitted")).alias("day"))
        put(_in_partitions(read_keyed(spark, store), touched, ["survey", "day"]).groupBy("day", "survey").agg(F.count("*").alias("n")))

    if lateness is not None:
        return _start(daily_counts_stream(src, lateness), merge, table, checkpoint, interval, "update")
    return _start(src, merge, table, checkpoint, interval)


def land_files(df: DataFrame, path: str, fmt: str = "json", rows_per_file: int | None = None, files: int | None = None) -> str:
    """Write rows as landed files (the stream's input), of so many rows at most, or dealt out to so many files.

    A stream pays for every micro-batch, and each looks up what is stored; with
    a number of files its micro-batches do not become more as the rows do.
    """
    if files:
        df = df.repartition(files)
    w = df.write.mode("errorifexists").format(fmt)
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).save(path)
    return path
