"""Response export as a Spark data source sink with one commit (O09, O39, the Writer surface).

A ``Writer`` writes a task's rows and tells what it wrote; the messages of all
tasks come to one ``commit`` on the driver, or to ``abort`` when the job
failed.  ``register_writer`` makes a sink of it that ``df.write.format(name)``
opens.

``PeriodFiles`` (registered as ``response_export``) writes one file set per
survey and period, a folder ``{survey}_responses_{start}_{end}.{ext}`` of part
files, and a catalog row for each: ``survey, start, end, n, file, parts,
updated``.  Tasks write under names of their own next to the files of earlier
exports; nothing is renamed.  The commit writes the next version of the
catalog, one small file, and that alone makes the new parts the period's
contents: readers (``exported_catalog``, ``read_exported``) go by the catalog,
so they see all periods of an export or none.  A failed task or job leaves the
old periods whole, and its own parts are removed.  Parts that a commit replaced
are removed after it; if the driver dies in between, they stay as files that no
catalog lists until ``remove_orphans``.

An export replaces the periods it has rows of and keeps the others.  Rows
without a survey or a time have no period and are an error.  Messages and
catalog have an entry per part file, so their size is that of a file listing.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as DS
from pyspark.sql import functions as F

from ..operators.periods import PERIOD_DAYS, period_of
from .landed import FILE_SET_TIME

CATALOG = "_catalog"
CATALOG_SCHEMA = "survey string, start long, end long, n long, file string, parts array<string>, updated string"
PERIOD = "__period"


# --- the extension surface -------------------------------------------------------------------


class Writer:
    """A sink of rows: subclass it, then ``register_writer``.

    It is made on the driver from the writer's options, pickled, and used by
    the tasks; ``commit`` and ``abort`` run on the driver.
    """

    def __init__(self, options: Mapping[str, str], overwrite: bool = False):
        self.options, self.overwrite = dict(options), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> list[dict]:
        """Write a task's rows; what was written.  A task that fails cleans up after itself."""
        raise NotImplementedError

    def commit(self, written: list[dict]) -> None:
        """Make what all tasks wrote visible, at once."""
        raise NotImplementedError

    def abort(self, written: list[dict]) -> None:
        """The job failed: undo what these tasks wrote."""
        raise NotImplementedError


@dataclass
class _Message(DS.WriterCommitMessage):
    written: list[dict] = field(default_factory=list)


class _Sink(DS.DataSourceArrowWriter):
    def __init__(self, writer: Writer):
        self.writer = writer

    def write(self, iterator):
        return _Message(self.writer.write(iterator))

    def commit(self, messages):
        self.writer.commit([w for m in messages if m is not None for w in m.written])

    def abort(self, messages):
        self.writer.abort([w for m in messages if m is not None for w in m.written])


def register_writer(spark: SparkSession, name: str, make: Callable[[Mapping[str, str], bool], Writer]) -> None:
    """Make a sink ``name`` of a writer class (or any function of options and overwrite)."""

    class WriterSource(DS.DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            raise ValueError(f"{name} is for writing; read it through its catalog")

        def writer(self, schema, overwrite):
            return _Sink(make(self.options, overwrite))

    spark.dataSource.register(WriterSource)


# --- period files ----------------------------------------------------------------------------


def open_fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path and the path in it; a plain path is local."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


class _Part:
    """One part file while it is written."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, fmt: str, schema: pa.Schema):
        self.path, self.fmt, self.n = path, fmt, 0
        self.out = fs.open_output_stream(path)
        self.rows = {"csv": pa.csv.CSVWriter, "parquet": pa.parquet.ParquetWriter}[fmt](self.out, schema) if fmt != "json" else None

    def add(self, t: pa.Table) -> None:
        self.n += t.num_rows
        if self.rows is not None:
            self.rows.write_table(t)
            return
        for row in t.to_pylist():
            line = {k: v for k, v in row.items() if v is not None}
            self.out.write(json.dumps(line, ensure_ascii=False, default=str).encode() + b"\n")

    def close(self) -> None:
        if self.rows is not None:
            self.rows.close()
        self.out.close()


class PeriodFiles(Writer):
    """Part files by survey and period; rows come with their period's start in ``__period``, sorted by both."""

    def __init__(self, options: Mapping[str, str], overwrite: bool = False):
        super().__init__({k.lower(): v for k, v in dict(options).items()}, overwrite)
        if "path" not in self.options:
            raise ValueError("response_export needs a path")
        self.path = self.options["path"].rstrip("/")
        self.fmt = self.options.get("fileformat", "csv")
        if self.fmt not in ("csv", "json", "parquet"):
            raise ValueError(f"unknown export format {self.fmt!r}")
        self.step = int(self.options.get("perioddays", PERIOD_DAYS)) * 86400

    def folder(self, survey: str, start: int) -> str:
        at = lambda t: _dt.datetime.fromtimestamp(t, _dt.timezone.utc).strftime(FILE_SET_TIME)
        return f"{survey}_responses_{at(start)}_{at(start + self.step)}.{self.fmt}"

    # task side

    def write(self, batches: Iterator[pa.RecordBatch]) -> list[dict]:
        fs, root = open_fs(self.path)
        written: list[dict] = []
        part: _Part | None = None
        now: tuple | None = None
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                t = pa.Table.from_batches([b])
                if t["survey"].null_count or t[PERIOD].null_count:
                    raise ValueError("a row without survey or time belongs to no period")
                start, keys = 0, list(zip(t["survey"].to_pylist(), t[PERIOD].to_pylist()))
                rows = t.drop_columns([PERIOD])
                for end in [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]:
                    if keys[start] != now:
                        if part is not None:
                            part.close()
                            written[-1]["n"] = part.n
                        now = keys[start]
                        folder = self.folder(*now)
                        fs.create_dir(f"{root}/{folder}")
                        name = f"part-{uuid.uuid4().hex}.{self.fmt}"
                        written.append({"survey": now[0], "start": now[1], "file": folder, "part": name, "n": 0})
                        part = _Part(fs, f"{root}/{folder}/{name}", self.fmt, rows.schema)
                    part.add(rows.slice(start, end - start))
                    start = end
            if part is not None:
                part.close()
                written[-1]["n"] = part.n
            return written
        except BaseException:
            if part is not None:
                part.out.close()
            self.abort(written)
            raise

    # driver side

    def commit(self, written: list[dict]) -> None:
        fs, root = open_fs(self.path)
        version, entries = latest_catalog(self.path)
        fresh: dict[tuple, dict] = {}
        stamp = _dt.datetime.now(_dt.timezone.utc).isoformat(timespec="seconds")
        for w in written:
            e = fresh.setdefault((w["survey"], w["start"]), {
                "survey": w["survey"], "start": w["start"], "end": w["start"] + self.step, "n": 0, "file": w["file"], "parts": [], "updated": stamp})
            e["n"] += w["n"]
            e["parts"].append(w["part"])
        replaced = entries if self.overwrite else [e for e in entries if (e["survey"], e["start"]) in fresh]
        kept = [e for e in entries if e not in replaced]
        fs.create_dir(f"{root}/{CATALOG}")
        target = f"{root}/{CATALOG}/{version + 1:09d}.json"
        text = "".join(json.dumps(e) + "\n" for e in sorted([*kept, *fresh.values()], key=lambda e: (e["survey"], e["start"])))
        staged = f"{root}/{CATALOG}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(staged) as f:
            f.write(text.encode())
        if fs.get_file_info(target).type != pa.fs.FileType.NotFound:
            raise RuntimeError(f"another export committed version {version + 1} of {self.path}")
        fs.move(staged, target)  # from here on readers see the new periods
        _remove(fs, [f"{root}/{e['file']}/{p}" for e in replaced for p in e["parts"]])

    def abort(self, written: list[dict]) -> None:
        fs, root = open_fs(self.path)
        _remove(fs, [f"{root}/{w['file']}/{w['part']}" for w in written])


def _remove(fs: pa.fs.FileSystem, paths: list[str]) -> None:
    """Remove files that nothing lists; one that is gone already, or cannot be removed, is left."""
    for p in paths:
        try:
            fs.delete_file(p)
        except OSError:
            continue


def latest_catalog(path: str) -> tuple[int, list[dict]]:
    """(version, entries) of the export at ``path``; (0, []) before the first."""
    fs, root = open_fs(path.rstrip("/"))
    found = fs.get_file_info(pa.fs.FileSelector(f"{root}/{CATALOG}", allow_not_found=True))
    versions = [int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit()]
    if not versions:
        return 0, []
    with fs.open_input_stream(f"{root}/{CATALOG}/{max(versions):09d}.json") as f:
        return max(versions), [json.loads(x) for x in f.read().decode().splitlines() if x]


def remove_orphans(path: str) -> int:
    """Remove part files that the current catalog does not list; not while an export runs.  How many."""
    fs, root = open_fs(path.rstrip("/"))
    _, entries = latest_catalog(path)
    listed = {f"{root}/{e['file']}/{p}" for e in entries for p in e["parts"]}
    found = [f.path for f in fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
             if f.type == pa.fs.FileType.File and f.base_name.startswith("part-") and f.path not in listed]
    _remove(fs, found)
    return len(found)


EXPORT = "response_export"


def export_periods(df: DataFrame, path: str, anchor: int, fmt: str = "csv", time_col: str = "submitted",
                   period_days: int = PERIOD_DAYS, overwrite: bool = False) -> None:
    """O09 + O39: write ``df`` as file sets by survey and period, in one commit.

    Rows move once, by survey and period; AQE splits a large period over
    several tasks, each of which writes a part (``rebalance``).
    """
    spark = df.sparkSession
    register_writer(spark, EXPORT, PeriodFiles)
    rows = df.withColumn(PERIOD, period_of(F.col(time_col), anchor, period_days)).hint("rebalance", F.col("survey"), F.col(PERIOD))
    (rows.sortWithinPartitions("survey", PERIOD, time_col).write.format(EXPORT).mode("overwrite" if overwrite else "append")
     .options(path=path, fileFormat=fmt, periodDays=str(period_days)).save())


def exported_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The current catalog: ``survey, start, end, n, file, parts, updated``; no rows before the first export."""
    version, _ = latest_catalog(path)
    if not version:
        return spark.createDataFrame([], CATALOG_SCHEMA)
    return spark.read.schema(CATALOG_SCHEMA).json(f"{path.rstrip('/')}/{CATALOG}/{version:09d}.json")


def read_exported(spark: SparkSession, path: str, schema: str, fmt: str = "csv", surveys: list[str] | None = None,
                  start: int | None = None, end: int | None = None) -> DataFrame:
    """The rows of the current export; only the periods of ``surveys`` that meet ``[start, end]`` are opened."""
    _, entries = latest_catalog(path)
    parts = [f"{path.rstrip('/')}/{e['file']}/{p}" for e in entries for p in e["parts"]
             if (surveys is None or e["survey"] in surveys) and (end is None or e["start"] <= end) and (start is None or e["end"] > start)]
    if not parts:
        return spark.createDataFrame([], schema)
    r = spark.read.schema(schema)
    return r.option("header", "true").csv(parts) if fmt == "csv" else r.format(fmt).load(parts)
