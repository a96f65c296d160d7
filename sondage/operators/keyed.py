"""A keyed store bucketed by its key, with incremental daily counts.

Rows lie in a Spark table bucketed by ``_key``, the key as one text that tells
null from every value.  A load is shuffled once, into the table's own buckets;
stored keys are read where they lie (no exchange on the stored side), whatever
partition or day a row belongs to, so an id that was dated anew is found.

Loads only append.  Every row carries the number of the load that wrote it, and
a load counts once its line is in the log of loads, written last; what a failed
load left behind belongs to no line and is never read.  A load that is named
like one in the log adds nothing.

* ``ignore``  the first row of each key that the store lacks
* ``replace`` the latest row of each key; the newest load's row is the current one
* ``plain``   a key twice in the load, or there already, is an error

``current`` gives the newest row of each key, by a window over the buckets (no
exchange either).  ``compact`` rewrites the store into one file a bucket and
forgets replaced rows; readers change over with its line in the log.

Each load also keeps what it did to the daily counts: +1 for a row's (survey,
day), -1 for the one it replaced.  ``daily`` adds up these lines, which are as
many as the days that loads touched, so no load and no reader counts the store
again, in whatever order days come.

One writer at a time, as for any table without a transaction log.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import time
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import checkpoint_dir
from ..sources.raw import day_of
from .observed import LoadWatch
from .store import DuplicateKeyError, SchemaEvolutionError, _hadoop, first_per_key, path_exists

KEY, LOAD = "_key", "_load"
LOG_SCHEMA = ("kind string, load long, name string, mode string, generation long, rows long, added long, replaced long, "
              "start long, end long")


def key_text(keys: Sequence[str]) -> Column:
    """The key as one text: for each column ``n``, or its length and its text.  Different keys give different texts."""
    one = lambda c: F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))
    return F.concat(*[one(F.col(f"`{k}`").cast("string")) for k in keys])


@contextlib.contextmanager
def _width(spark: SparkSession, n: int) -> Iterator[None]:
    """Shuffles of ``n`` partitions, so that a load lands in the table's buckets."""
    name = "spark.sql.shuffle.partitions"
    old = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, old)


class KeyedStore:
    """The store at ``path``; made by its first load, opened by path in any later session."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("survey", "id"), buckets: int | None = None,
                 time_col: str = "submitted", group: str = "survey"):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.time_col, self.group = list(keys), time_col, group
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.schema: T.StructType | None = None
        if path_exists(spark, f"{self.path}/meta"):
            meta = json.loads(spark.read.text(f"{self.path}/meta").first()["value"])
            if meta["keys"] != self.keys:
                raise ValueError(f"the store at {path} has the key {meta['keys']}, not {self.keys}")
            self.buckets, self.time_col, self.group = meta["buckets"], meta["time"], meta["group"]
            self.schema = T.StructType.fromJson(meta["schema"])

    # the log of loads

    def _log(self) -> list:
        if not path_exists(self.spark, f"{self.path}/loads"):
            return []
        rows = self.spark.read.schema(LOG_SCHEMA).json(f"{self.path}/loads").collect()  # a line per load
        return sorted(rows, key=lambda r: r["load"])

    def _commit(self, **line) -> None:
        names = [f.split()[0] for f in LOG_SCHEMA.split(", ")]
        row = self.spark.createDataFrame([tuple(line.get(n) for n in names)], LOG_SCHEMA)
        row.coalesce(1).write.mode("append").json(f"{self.path}/loads")

    def loads(self) -> DataFrame:
        """The log of loads, with the rows and the time range of each."""
        lines = [r for r in self._log() if r["kind"] == "load"]
        return self.spark.createDataFrame(lines, LOG_SCHEMA).select("name", "mode", "rows", "added", "replaced", "start", "end")

    def _state(self) -> tuple[int, list[int], bool]:
        """(generation, its loads, whether a load replaced rows since)."""
        generation, loads, replaced = 0, [], False
        for r in self._log():
            if r["kind"] == "compact":
                generation, loads, replaced = r["generation"], [r["load"]], False
            else:
                loads.append(r["load"])
                replaced |= bool(r["replaced"])
        return generation, loads, replaced

    # the table

    def _table(self, generation: int) -> str:
        """The name of the bucketed table, registered in this session's catalog."""
        where = f"{self.path}/rows-{generation}"
        name = f"sondage_keyed_{hashlib.sha1(where.encode()).hexdigest()[:24]}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*self.schema.fields, T.StructField(KEY, T.StringType()), T.StructField(LOAD, T.LongType())])
            quoted = where.replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{quoted}'")
        return name

    def _rows(self) -> DataFrame:
        generation, loads, _ = self._state()
        return self.spark.table(self._table(generation)).where(F.col(LOAD).isin(loads))

    def _newest(self, columns: Sequence[str]) -> DataFrame:
        """The newest row of each key; only ``columns`` are read."""
        rows = self._rows().select(KEY, LOAD, *columns)
        if self._state()[2]:
            place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.col(LOAD).desc()))
            rows = rows.withColumn("_place", place).where("_place = 1").drop("_place")
        return rows

    def current(self) -> DataFrame:
        """The store's rows."""
        if self.schema is None:
            raise ValueError(f"nothing was loaded into {self.path} yet")
        return self._newest(self.schema.names).select(*self.schema.names)

    # loads

    def _create(self, schema: T.StructType) -> None:
        self.schema = schema
        meta = {"keys": self.keys, "buckets": self.buckets, "time": self.time_col, "group": self.group, "schema": schema.jsonValue()}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{self.path}/meta")

    def load(self, batch: DataFrame, name: str, mode: str = "ignore", order: Sequence[Column] | None = None,
             watch: LoadWatch | None = None) -> dict:
        """One load; ``{rows, added, replaced, start, end}`` as logged.

        Everything is worked out from one pass over the batch, whose changes are
        checkpointed: the rows to write, the counts' changes, and (observed on
        the way) the figures of the log, so nothing is counted by a job of its own.
        """
        if mode not in ("ignore", "replace", "plain"):
            raise ValueError(f"unknown mode {mode!r}")
        done = next((r for r in self._log() if r["name"] == name), None)
        if done is not None:
            return {k: done[k] for k in ("rows", "added", "replaced", "start", "end")}
        checkpoint_dir(self.spark)
        if self.schema is None:
            self._create(T.StructType([T.StructField(f.name, f.dataType) for f in batch.schema]))
        elif {(f.name, f.dataType) for f in batch.schema} != {(f.name, f.dataType) for f in self.schema}:
            raise SchemaEvolutionError(f"columns {batch.schema.simpleString()} vs {self.schema.simpleString()}")
        number = time.time_ns()
        with _width(self.spark, self.buckets):
            changes, seen = self._changes(batch.select(*self.schema.names), mode, order, watch)
            generation, _, _ = self._state()
            target = self._table(generation)
            rows = changes.drop("_old", "_n").withColumn(LOAD, F.lit(number))
            rows.select(*self.schema.names, KEY, LOAD).write.insertInto(target)
            self._partials(changes).withColumn(LOAD, F.lit(number)).coalesce(1).write.mode("append").parquet(f"{self.path}/daily-{generation}")
        figures = {k: seen[k] for k in ("rows", "start", "end")} | {k: seen[k] or 0 for k in ("added", "replaced")}
        self._commit(kind="load", load=number, name=name, mode=mode, generation=generation, **figures)
        return figures

    def _changes(self, batch: DataFrame, mode: str, order: Sequence[Column] | None, watch: LoadWatch | None) -> tuple[DataFrame, dict]:
        """(rows to write with the (group, time) that each replaces, figures of the load)."""
        from pyspark.sql import Observation
        read, wrote = Observation(), Observation()
        batch = batch.observe(read, F.count(F.lit(1)).alias("rows"), F.min(self.time_col).alias("start"), F.max(self.time_col).alias("end"))
        if watch is not None:
            batch = watch.watch(batch)
        keyed = batch.withColumn(KEY, key_text(self.keys))
        old = self._newest([self.group, self.time_col]).select(KEY, F.struct(F.col(self.group).alias("g"), F.col(self.time_col).alias("t")).alias("_old"))
        if mode == "plain":
            n = F.count("*").over(Window.partitionBy(KEY))
            met = keyed.withColumn("_n", n).join(old, KEY, "left")
            said = F.concat(F.lit("duplicate key "), F.col(KEY))
            fresh = met.where(F.when((F.col("_n") > 1) | F.col("_old").isNotNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))
        else:
            fresh = first_per_key(keyed, [KEY], order, latest=mode == "replace").join(old, KEY, "left")
            if mode == "ignore":
                fresh = fresh.where(F.col("_old").isNull())
        fresh = fresh.observe(wrote, F.count(F.lit(1)).alias("added"), F.count("_old").alias("replaced"))
        try:
            changes = fresh.checkpoint()
        except Exception as e:
            if mode == "plain" and "duplicate key" in str(e):
                raise DuplicateKeyError(str(e).split("\n")[0]) from e
            raise
        return changes, {**read.get, **wrote.get}

    def _partials(self, changes: DataFrame) -> DataFrame:
        """What a load did to the daily counts: ``group, day, n``, n of either sign."""
        came = changes.select(F.col(self.group), day_of(F.col(self.time_col)).alias("day"), F.lit(1).alias("n"))
        went = changes.where(F.col("_old").isNotNull()).select(F.col("_old.g").alias(self.group), day_of(F.col("_old.t")).alias("day"), F.lit(-1).alias("n"))
        return came.unionByName(went).groupBy(self.group, "day").agg(F.sum("n").alias("n")).where("n <> 0")

    def daily(self) -> DataFrame:
        """Responses per (day, group), from the loads' lines alone."""
        generation, loads, _ = self._state()
        lines = self.spark.read.parquet(f"{self.path}/daily-{generation}").where(F.col(LOAD).isin(loads))
        return lines.groupBy("day", self.group).agg(F.sum("n").alias("n")).where("n <> 0")

    def compact(self) -> None:
        """Rewrite the store: one file a bucket, one row a key, one line a day."""
        generation, loads, _ = self._state()
        if not loads:
            return
        checkpoint_dir(self.spark)
        number, new = time.time_ns(), generation + 1
        for what in (f"rows-{new}", f"daily-{new}"):  # of a compaction that failed
            fs, p = _hadoop(self.spark, f"{self.path}/{what}")
            fs.delete(p, True)
        rows = self._newest(self.schema.names).withColumn(LOAD, F.lit(number)).select(*self.schema.names, KEY, LOAD)
        with _width(self.spark, self.buckets):
            rows.write.insertInto(self._table(new))
        self.daily().withColumn(LOAD, F.lit(number)).coalesce(1).write.parquet(f"{self.path}/daily-{new}")
        self._commit(kind="compact", load=number, generation=new)

