"""Landed exports as a Spark data source, batch and stream (O01, O47, the Loader surface).

A ``Loader`` tells which splits a source has and reads one of them as Arrow
batches; ``register_loader`` makes a data source of it that
``spark.read.format(name)`` and ``spark.readStream.format(name)`` open.  What
the loader gets of the query are the surveys and the time range that its
filters ask for (``Bounds``): splits outside are never planned, rows outside
never leave the task, and Spark does not check them again.

``LandedFiles`` (registered as ``landed_responses``) is the loader of response
files in a shared folder: JSON lines, CSV and Parquet, told by their
extension.  Options:

* ``path``         folder (or file) of any file system that pyarrow opens
* ``layout``       ``rows`` (columns ``survey, id, submitted, version, data``; default)
                   or ``payloads`` (JSON lines, each one response: id, time and version
                   are its ``ID``, ``submitted`` and ``version``)
* ``survey``       survey of files that do not name one (a column, ``survey=...`` in the
                   path, or the export's ``{survey}_responses_{start}_{end}`` name does)
* ``columns``      the columns to read, of the five
* ``splitBytes``   bytes of a split (64 MB).  JSON lines and Parquet are split, a CSV file is not;
                   a task reads small files up to as many bytes, each counted with ``OPEN_BYTES``
* ``settleSeconds``  streams leave files alone that changed within so many seconds (0)

A period in the name of a file set prunes it as a partition would.  Files
whose name begins with ``_`` or ``.`` are not read.  A line that is no JSON
object becomes a row with its text as ``data`` and no id, for the quarantine.

A stream's offset is the last file taken, by (time of change, path), so a
restarted stream goes on behind it; files that are already taken may be
archived once their micro-batch is committed.  The Python API has no admission
control: a micro-batch takes all that has landed.
"""

from __future__ import annotations

import datetime as _dt
import io
import json
import re
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
import pyarrow.json
import pyarrow.parquet
from pyspark.sql import SparkSession
from pyspark.sql import datasource as DS
from pyspark.sql import types as T

ROW = pa.schema([("survey", pa.string()), ("id", pa.string()), ("submitted", pa.int64()), ("version", pa.string()), ("data", pa.string())])
SPARK_ROW = {"survey": T.StringType(), "id": T.StringType(), "submitted": T.LongType(), "version": T.StringType(), "data": T.StringType()}
#: Bytes of lines parsed at once.
READ_BYTES = 4 << 20
#: What opening a file costs, in bytes that could be read meanwhile.
OPEN_BYTES = 1 << 20

# --- fixed values ----------------------------------------------------------------------------
FILE_SET = re.compile(r"^(?P<survey>.+)_responses_(?P<start>\d{4}(?:-\d\d){5})_(?P<end>\d{4}(?:-\d\d){5})\.\w+$")
FILE_SET_TIME = "%Y-%m-%d-%H-%M-%S"
# ---------------------------------------------------------------------------------------------


# --- the extension surface -------------------------------------------------------------------


@dataclass(frozen=True)
class Bounds:
    """What the filters of a query leave: surveys (None: all) and an inclusive time range."""

    surveys: frozenset | None = None
    start: int | None = None
    end: int | None = None

    def narrowed(self, f: DS.Filter) -> "Bounds | None":
        """These bounds and a filter; None for a filter that they cannot express."""
        if isinstance(f, DS.EqualTo) and f.attribute == ("survey",):
            return self._only({f.value})
        if isinstance(f, DS.In) and f.attribute == ("survey",):
            return self._only(set(f.value))
        if getattr(f, "attribute", None) != ("submitted",) or not isinstance(getattr(f, "value", None), int):
            return None
        if not isinstance(f, (DS.GreaterThanOrEqual, DS.GreaterThan, DS.LessThanOrEqual, DS.LessThan, DS.EqualTo)):
            return None
        lo, hi = self.start, self.end
        if not isinstance(f, (DS.LessThanOrEqual, DS.LessThan)):
            at = f.value + isinstance(f, DS.GreaterThan)
            lo = at if lo is None else max(lo, at)
        if not isinstance(f, (DS.GreaterThanOrEqual, DS.GreaterThan)):
            at = f.value - isinstance(f, DS.LessThan)
            hi = at if hi is None else min(hi, at)
        return replace(self, start=lo, end=hi)

    def _only(self, names: set) -> "Bounds":
        names = {n for n in names if n is not None}  # a comparison with null holds for no row
        return replace(self, surveys=frozenset(names if self.surveys is None else names & self.surveys))

    def may_hold(self, survey: str | None, start: int | None = None, end: int | None = None) -> bool:
        """Whether rows of a survey (None: not known) in ``[start, end)`` can be wanted."""
        if self.surveys is not None and survey is not None and survey not in self.surveys:
            return False
        return not (self.end is not None and start is not None and start > self.end
                    or self.start is not None and end is not None and end <= self.start)

    def rows(self, table: pa.Table) -> pa.Table:
        keep = None
        for test in self._tests(table):
            keep = test if keep is None else pc.and_kleene(keep, test)
        return table if keep is None else table.filter(keep)  # null: dropped

    def _tests(self, table: pa.Table) -> Iterator[pa.ChunkedArray]:
        if self.surveys is not None:
            yield pc.is_in(table["survey"], pa.array(sorted(self.surveys), pa.string()))
        if self.start is not None:
            yield pc.greater_equal(table["submitted"], self.start)
        if self.end is not None:
            yield pc.less_equal(table["submitted"], self.end)


@dataclass
class Split(DS.InputPartition):
    """One task's part of a source: bytes ``[first, last)`` of an object, and the splits it reads after it."""

    path: str
    first: int = 0
    last: int | None = None
    survey: str | None = None
    more: tuple["Split", ...] = ()

    def __post_init__(self):
        super().__init__(self.path)


@dataclass(frozen=True, order=True)
class Mark:
    """Place of an object in the order of landing."""

    time: int
    path: str


class Loader:
    """A source of raw responses: subclass it, then ``register_loader``.

    It is made from the reader's options on the driver, pickled, and used by
    the tasks.  ``splits`` is the only method that sees the whole source, so
    what it returns must be metadata.
    """

    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)

    def splits(self, bounds: Bounds) -> list[Split]:
        """The splits that can hold wanted rows."""
        raise NotImplementedError

    def read(self, split: Split, bounds: Bounds) -> Iterator[pa.Table]:
        """Tables of ``ROW``'s columns; the rows that ``bounds`` leaves."""
        raise NotImplementedError

    def landed(self) -> list[Mark]:
        """All objects in the order in which they landed; needed by streams only."""
        raise NotImplementedError

    def splits_between(self, after: Mark | None, until: Mark) -> list[Split]:
        """The splits of the objects in ``(after, until]``; needed by streams only."""
        raise NotImplementedError


def _columns(options: Mapping[str, str]) -> list[str]:
    names = [c.strip() for c in (options.get("columns") or ",".join(ROW.names)).split(",")]
    unknown = set(names) - set(ROW.names)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}; there are {ROW.names}")
    return names


def _batches(tables: Iterator[pa.Table], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for t in tables:
        yield from t.select(columns).to_batches()


class _Batch(DS.DataSourceReader):
    def __init__(self, loader: Loader, columns: list[str]):
        self.loader, self.columns, self.bounds = loader, columns, Bounds()

    def pushFilters(self, filters):
        for f in filters:
            narrowed = self.bounds.narrowed(f)
            if narrowed is not None:
                self.bounds = narrowed
            elif not (isinstance(f, DS.IsNotNull) and f.attribute in (("survey",), ("submitted",)) and self._bounded(filters, f)):
                yield f

    @staticmethod
    def _bounded(filters, f) -> bool:
        """Whether a comparison of the same column drops its nulls anyway."""
        return any(g is not f and getattr(g, "attribute", None) == f.attribute and Bounds().narrowed(g) is not None for g in filters)

    def partitions(self):
        return self.loader.splits(self.bounds) or [Split("")]

    def read(self, split):
        for s in (split, *split.more):
            if s.path:
                yield from _batches(self.loader.read(s, self.bounds), self.columns)


class _Stream(DS.DataSourceStreamReader):
    def __init__(self, loader: Loader, columns: list[str]):
        self.loader, self.columns = loader, columns

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        marks = self.loader.landed()
        last = marks[-1] if marks else Mark(-1, "")
        return {"time": last.time, "path": last.path}

    def partitions(self, start: dict, end: dict):
        return self.loader.splits_between(Mark(start["time"], start["path"]), Mark(end["time"], end["path"]))

    def read(self, split):
        for s in (split, *split.more):
            yield from _batches(self.loader.read(s, Bounds()), self.columns)


def register_loader(spark: SparkSession, name: str, make: Callable[[Mapping[str, str]], Loader]) -> None:
    """Make a data source ``name`` of a loader class (or any function of the options)."""

    class LoaderSource(DS.DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return T.StructType([T.StructField(c, SPARK_ROW[c]) for c in _columns(self.options)])

        def reader(self, schema):
            return _Batch(make(self.options), _columns(self.options))

        def streamReader(self, schema):
            return _Stream(make(self.options), _columns(self.options))

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LoaderSource)


# --- landed files ----------------------------------------------------------------------------


@dataclass(frozen=True)
class _File:
    mark: Mark
    size: int
    survey: str | None
    start: int | None = None
    end: int | None = None


@dataclass
class LandedFiles(Loader):
    options: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.options = {k.lower(): v for k, v in dict(self.options).items()}
        self.layout = self.options.get("layout", "rows")
        if self.layout not in ("rows", "payloads"):
            raise ValueError(f"unknown layout {self.layout!r}")
        if "path" not in self.options:
            raise ValueError("landed_responses needs a path")

    def _fs(self) -> tuple[pa.fs.FileSystem, str]:
        path = self.options["path"]
        return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)

    # driver side

    def files(self) -> list[_File]:
        fs, root = self._fs()
        info = fs.get_file_info(root)
        if info.type == pa.fs.FileType.NotFound:
            return []
        found = [info] if info.type == pa.fs.FileType.File else fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
        out = []
        for f in found:
            inner = f.path[len(root):].strip("/").split("/") if f.path != root else [f.base_name]
            if f.type != pa.fs.FileType.File or any(p.startswith(("_", ".")) for p in inner) or self._kind(f.path) is None:
                continue
            out.append(self._named(Mark(f.mtime_ns or 0, f.path), f.size, inner))
        return sorted(out, key=lambda f: f.mark)

    def _named(self, mark: Mark, size: int, parts: list[str]) -> _File:
        """Survey and period that the path tells."""
        survey, start, end = self.options.get("survey"), None, None
        for p in parts:
            if p.startswith("survey="):
                survey = p[len("survey="):]
            if m := FILE_SET.match(p):
                at = [int(_dt.datetime.strptime(m[k], FILE_SET_TIME).replace(tzinfo=_dt.timezone.utc).timestamp()) for k in ("start", "end")]
                survey, (start, end) = m["survey"], at
        return _File(mark, size, survey, start, end)

    @staticmethod
    def _kind(path: str) -> str | None:
        name = path[:-3] if path.endswith(".gz") else path
        ext = name.rsplit(".", 1)[-1]
        return {"json": "json", "jsonl": "json", "ndjson": "json", "csv": "csv", "parquet": "parquet"}.get(ext)

    def _split(self, f: _File) -> list[Split]:
        step = int(self.options.get("splitbytes", 64 << 20))
        path = f.mark.path
        if self._kind(path) == "csv" or path.endswith(".gz") or f.size <= step:
            return [Split(path, 0, f.size, f.survey)]
        return [Split(path, at, min(at + step, f.size), f.survey) for at in range(0, f.size, step)]

    def _packed(self, files: Iterator[_File]) -> list[Split]:
        """The files' splits; small ones share a task."""
        step = int(self.options.get("splitbytes", 64 << 20))
        out: list[list[Split]] = []
        held = 0
        for s in (s for f in files for s in self._split(f)):
            size = s.last - s.first + OPEN_BYTES
            if out and held + size <= step:
                out[-1].append(s)
                held += size
            else:
                out.append([s])
                held = size
        return [replace(s, more=tuple(more)) for s, *more in out]

    def splits(self, bounds: Bounds) -> list[Split]:
        return self._packed(f for f in self.files() if bounds.may_hold(f.survey, f.start, f.end))

    def landed(self) -> list[Mark]:
        quiet = time.time_ns() - int(float(self.options.get("settleseconds", 0)) * 1e9)
        return [f.mark for f in self.files() if f.mark.time <= quiet]

    def splits_between(self, after: Mark | None, until: Mark) -> list[Split]:
        return self._packed(f for f in self.files() if (after is None or f.mark > after) and f.mark <= until)

    # task side

    def read(self, split: Split, bounds: Bounds) -> Iterator[pa.Table]:
        if not bounds.may_hold(split.survey):
            return
        kind = self._kind(split.path)
        read = {"json": self._json, "csv": self._csv, "parquet": self._parquet}[kind]
        for t in read(split, bounds):
            yield bounds.rows(self._shaped(t, split))

    def _shaped(self, t: pa.Table, split: Split) -> pa.Table:
        """``ROW``'s columns; the survey of the path where the rows have none."""
        columns = []
        for f in ROW:
            c = t[f.name].cast(f.type) if f.name in t.column_names else pa.chunked_array([pa.nulls(t.num_rows, f.type)])
            if f.name == "survey" and split.survey is not None:
                c = pc.fill_null(c, split.survey)
            columns.append(c)
        return pa.table(columns, schema=ROW)

    def _lines(self, split: Split) -> Iterator[bytes]:
        """Whole lines that begin in the split, in blocks."""
        fs, _ = self._fs()
        if split.path.endswith(".gz"):
            with fs.open_input_stream(split.path, compression="gzip") as f:
                rest = b""
                while block := f.read(READ_BYTES):
                    lines, _, rest = (rest + block).rpartition(b"\n")
                    if lines:
                        yield lines
                if rest:
                    yield rest
            return
        with fs.open_input_file(split.path) as f:
            at, held, skip = max(0, split.first - 1), b"", split.first > 0  # at: where what is held begins
            f.seek(at)
            while True:
                block = f.read(READ_BYTES)
                if not block:
                    if held and not skip and at < split.last:
                        yield held
                    return
                held += block
                if skip:  # the end of a line that began before
                    cut = held.find(b"\n")
                    skip = cut < 0
                    at, held = (at + len(held), b"") if skip else (at + cut + 1, held[cut + 1:])
                if at >= split.last:
                    return
                last = -1 if skip else held.find(b"\n", split.last - at - 1)  # ends the last line that begins in the split
                if last >= 0:
                    yield held[:last]
                    return
                lines, end, rest = held.rpartition(b"\n")
                if end:
                    yield lines
                    at, held = at + len(lines) + 1, rest

    def _json(self, split: Split, bounds: Bounds) -> Iterator[pa.Table]:
        names = {"ID": "id", "submitted": "submitted", "version": "version"} if self.layout == "payloads" else None
        kinds = pa.schema([("ID", pa.string()), ("submitted", pa.int64()), ("version", pa.string())]) if names else ROW
        parse = pa.json.ParseOptions(explicit_schema=kinds, unexpected_field_behavior="ignore")
        for block in self._lines(split):
            lines = [x for x in block.split(b"\n") if x.strip()]
            if not lines:
                continue
            try:
                t = pa.json.read_json(io.BytesIO(b"\n".join(lines)), parse_options=parse, read_options=pa.json.ReadOptions(use_threads=False, block_size=len(block) + 1))
                if t.num_rows != len(lines):
                    raise pa.ArrowInvalid("lines and objects differ")
            except pa.ArrowInvalid:
                t = self._line_by_line(lines, kinds)
            if names:
                t = t.rename_columns([names[c] for c in t.column_names]).append_column("data", pa.array([x.decode("utf-8", "replace") for x in lines]))
            yield t

    def _line_by_line(self, lines: list[bytes], kinds: pa.Schema) -> pa.Table:
        """A block with a line that is no object, or has a field of another kind."""
        rows = []
        for line in lines:
            text = line.decode("utf-8", "replace")
            try:
                got = json.loads(text)
            except ValueError:
                got = None
            if not isinstance(got, dict):
                rows.append({"data": text})
                continue
            row = {}
            for f in kinds:
                v = got.get(f.name)
                if pa.types.is_integer(f.type):
                    row[f.name] = v if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 63 else None
                elif v is not None:
                    row[f.name] = v if isinstance(v, str) else json.dumps(v)
            rows.append(row)
        return pa.Table.from_pylist(rows, kinds)

    def _csv(self, split: Split, bounds: Bounds) -> Iterator[pa.Table]:
        fs, _ = self._fs()
        convert = pa.csv.ConvertOptions(column_types={f.name: f.type for f in ROW}, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""])
        with fs.open_input_stream(split.path) as f:
            reader = pa.csv.open_csv(f, convert_options=convert, parse_options=pa.csv.ParseOptions(newlines_in_values=True))
            for b in reader:
                yield pa.Table.from_batches([b])

    def _parquet(self, split: Split, bounds: Bounds) -> Iterator[pa.Table]:
        """The row groups that begin in the split and whose statistics allow the time range."""
        fs, _ = self._fs()
        with fs.open_input_file(split.path) as f:
            file = pa.parquet.ParquetFile(f)
            names = [c for c in ROW.names if c in file.schema_arrow.names]
            for g in range(file.num_row_groups):
                group = file.metadata.row_group(g)
                begin = min(group.column(c).dictionary_page_offset or group.column(c).data_page_offset for c in range(group.num_columns))
                stats = next((group.column(c).statistics for c in range(group.num_columns) if group.column(c).path_in_schema == "submitted"), None)
                low, high = (stats.min, stats.max + 1) if stats is not None and stats.has_min_max else (None, None)
                if split.first <= begin < split.last and bounds.may_hold(split.survey, low, high):
                    yield file.read_row_group(g, columns=names)


LANDED = "landed_responses"


def register_landed(spark: SparkSession) -> str:
    """The built-in loader as data source ``landed_responses``; its name."""
    register_loader(spark, LANDED, LandedFiles)
    return LANDED


def read_landed(spark: SparkSession, path: str, **options: str):
    """Landed response files as raw rows."""
    return spark.read.format(register_landed(spark)).options(**options).option("path", path).load()
