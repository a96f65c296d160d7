"""Raw response store: scan, decode, quarantine, recode, time filter (O01-O04),
survey-info flatten (O06), participant-state scan (O07) and id lists (O08).

The raw store is one Parquet dataset ``(survey, id, submitted, version, data)``
partitioned by ``survey``: a survey filter prunes partitions and a time filter on
``submitted`` is pushed into the Parquet reader (row-group statistics).
"""

from __future__ import annotations

import datetime as _dt
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PAYLOAD_TYPE = "map<string,string>"
#: What Spark's parser accepts beyond JSON, switched off.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
RAW_COLUMNS = ["survey", "id", "submitted", "version", "data"]

# --- fixed values -----------------------------------------------------------------------------
# Text values recoded to booleans at ingest (exact case only).
INGEST_TRUE = "TRUE"
INGEST_FALSE = "FALSE"
# ------------------------------------------------------------------------------------------------


def _epoch(bound) -> int | None:
    """A time bound as epoch seconds: int, datetime, or ISO text ``YYYY-MM-DDTHH:MM:SS`` (UTC)."""
    if bound is None:
        return None
    if isinstance(bound, (int, float)):
        return int(bound)
    if isinstance(bound, str):
        bound = _dt.datetime.fromisoformat(bound)
    if isinstance(bound, _dt.datetime):
        if bound.tzinfo is None:
            bound = bound.replace(tzinfo=_dt.timezone.utc)
        return int(bound.timestamp())
    raise TypeError(f"unsupported time bound {bound!r}")


def day_of(epoch: Column) -> Column:
    """UTC day of an epoch-seconds column (the raw store's ``day`` partition)."""
    return F.to_date(F.timestamp_seconds(epoch))


def time_range_filter(df: DataFrame, start=None, end=None, column: str = "submitted") -> DataFrame:
    """``start <= column <= end``, both inclusive, each optional (epoch seconds).

    When the table carries the ``day`` partition column the same bounds also
    prune day partitions, on top of the row-group statistics of ``column``.
    """
    lo, hi = _epoch(start), _epoch(end)
    has_day = column == "submitted" and "day" in df.columns
    if lo is not None:
        df = df.where(F.col(column) >= F.lit(lo))
        if has_day:
            df = df.where(F.col("day") >= day_of(F.lit(lo)))
    if hi is not None:
        df = df.where(F.col(column) <= F.lit(hi))
        if has_day:
            df = df.where(F.col("day") <= day_of(F.lit(hi)))
    return df


def scan_raw(source: DataFrame | str, spark: SparkSession | None = None, survey: str | None = None,
             start=None, end=None, columns=("survey", "id", "submitted", "version", "data")) -> DataFrame:
    """The raw responses of one survey (or all) in a time range.

    No paging: one distributed scan.  ``survey`` and the time bounds become
    scan-level predicates (partition pruning and Parquet pushdown).
    """
    df = spark.read.parquet(source) if isinstance(source, str) else source
    if survey is not None:
        df = df.where(F.col("survey") == F.lit(survey))
    df = time_range_filter(df, start, end)
    return df.select(*[c for c in columns if c in df.columns])


def one_value(data: Column) -> Column:
    """Payload text that is one JSON value, else null: with a number behind it, it makes an array of two.

    The parsers below stop at the end of the first value, so text behind an
    object, or a second object, would be lost without a trace.
    """
    c = data.cast("string")
    return F.when(F.json_array_length(F.concat(F.lit("["), c, F.lit(",0]"))) == 2, c)


def decode(data: Column | str) -> Column:
    """Payload text -> ``MAP<STRING,STRING>``; nested objects stay JSON text.

    Truncated JSON, ``''``, non-objects, text behind the object, single quotes
    and ``NaN`` give null; ``{}`` gives an empty map.
    """
    c = F.col(data) if isinstance(data, str) else data
    return F.from_json(one_value(c), PAYLOAD_TYPE, {"mode": "PERMISSIVE", **STRICT})


def decode_payload(df: DataFrame, data_col: str = "data", keep_data: bool = False) -> DataFrame:
    """Add ``payload``; rows whose payload does not decode get a null map."""
    out = df.withColumn("payload", decode(data_col))
    return out if keep_data else out.drop(data_col)


def split_quarantine(df: DataFrame, data_col: str = "data") -> tuple[DataFrame, DataFrame]:
    """``(decoded rows, quarantined rows)``; bad rows are reported, not dropped silently."""
    dec = df.withColumn("payload", decode(data_col))
    good = dec.where(F.col("payload").isNotNull()).drop(data_col)
    bad = dec.where(F.col("payload").isNull()).drop("payload")
    return good, bad


def recode_flags(payload: Column | str) -> Column:
    """Top-level ``'TRUE'``/``'FALSE'`` (exact case) -> ``'true'``/``'false'``.

    In the JSON text that is the boolean literal; in a string map it reads as
    the lower-case text, which the boolean cast accepts.
    """
    m = F.col(payload) if isinstance(payload, str) else payload
    return F.transform_values(m, lambda k, v: F.when(v == INGEST_TRUE, F.lit("true"))
                              .when(v == INGEST_FALSE, F.lit("false")).otherwise(v))


def recode_json(data: Column | str) -> Column:
    """O03 on payload text: top-level ``"TRUE"``/``"FALSE"`` become JSON booleans.

    All other members keep their JSON type (numbers, objects, arrays, null).
    Text that is no JSON object stays as it is, for the quarantine.
    """
    c = (F.col(data) if isinstance(data, str) else data).cast("string")
    as_variant = F.from_json(one_value(c), "map<string,variant>", STRICT)
    text = lambda v: F.try_variant_get(v, "$", "string")  # noqa: E731  (no value but a string reads as capitals)
    recoded = F.transform_values(as_variant, lambda k, v: F.when(text(v) == INGEST_TRUE, F.parse_json(F.lit("true")))
                                 .when(text(v) == INGEST_FALSE, F.parse_json(F.lit("false"))).otherwise(v))
    return F.when(as_variant.isNull(), c).otherwise(F.to_json(recoded))


def decompress(data: Column | str, codec: str = "zlib") -> Column:
    """BINARY payloads: ``zlib`` (any level) or ``zstd`` via an Arrow-batched helper; ``none`` casts.

    Neither has a Spark expression.  ``zstd`` needs the ``zstandard`` package on
    the executors.  A payload that does not inflate is null, as one that does
    not decode.
    """
    c = F.col(data) if isinstance(data, str) else data
    if codec in ("none", "plain", None):
        return c.cast("string")
    if not codec.startswith(("zlib", "zstd")):
        raise ValueError(f"unknown codec {codec!r}")

    def inflate(b):
        if codec.startswith("zlib"):
            import zlib
            open_one, errors = zlib.decompress, (zlib.error, UnicodeDecodeError)
        else:
            import zstandard
            z = zstandard.ZstdDecompressor().decompressobj  # the size need not be in the frame
            open_one, errors = lambda x: z().decompress(x), (zstandard.ZstdError, UnicodeDecodeError)

        def one(x):
            try:
                return None if x is None else open_one(bytes(x)).decode("utf-8")
            except errors:
                return None
        return b.map(one)

    return F.pandas_udf(inflate, StringType())(c)


# --- survey info -----------------------------------------------------------------------------

SURVEY_INFO_SCHEMA = (
    "key string, versions array<struct<versionId:string, published:bigint, "
    "questions:array<struct<key:string, questionType:string, title:string, "
    "responses:array<struct<key:string, label:string>>>>>>"
)


def flatten_survey_info(info: DataFrame, explode_responses: bool = False) -> DataFrame:
    """One row per (survey, version, question[, response]).

    ``info`` has the survey-info shape ``(key, versions[...])`` (read with
    ``spark.read.schema(SURVEY_INFO_SCHEMA).json(path)``).
    """
    v = info.select(F.col("key").alias("survey"), F.explode("versions").alias("v"))
    q = v.select("survey", F.col("v.versionId").alias("version"), F.col("v.published").alias("published"),
                 F.explode("v.questions").alias("q"))
    out = q.select("survey", "version", "published", F.col("q.key").alias("question"),
                   F.col("q.questionType").alias("questionType"), F.col("q.responses").alias("responses"))
    if explode_responses:
        out = out.select("survey", "version", "published", "question", "questionType",
                         F.explode_outer("responses").alias("r")) \
            .select("survey", "version", "published", "question", "questionType",
                    F.col("r.key").alias("response"))
    else:
        out = out.drop("responses")
    return out


def survey_info_documents(si_rows: DataFrame) -> DataFrame:
    """Flat survey-info rows as documents (the inverse of O06), one question each.

    Documents of one survey and version may be many; nothing is gathered, so
    the work is a projection whatever the size of a survey's definition.
    """
    question = F.struct(F.col("column").alias("key"), F.col("questionType").alias("questionType"),
                        F.lit(None).cast("string").alias("title"),
                        F.array().cast("array<struct<key:string,label:string>>").alias("responses"))
    version = F.struct(F.col("version").alias("versionId"), F.col("published").alias("published"), F.array(question).alias("questions"))
    return si_rows.select(F.col("survey").alias("key"), F.array(version).alias("versions"))


# --- participants and id lists ------------------------------------------------------------------


def participants_by_status(states: DataFrame, status: str | None = "active") -> DataFrame:
    """Participant states with an optional ``studyStatus`` predicate; ``all``/None keeps all."""
    if status is None or status == "all":
        return states
    return states.where(F.col("studyStatus") == F.lit(status))


def parse_id_list(text: Column | str, mode: str = "lines") -> Column:
    """One text value -> array of trimmed, non-empty ids.

    ``mode``: ``lines`` (one id per value), ``comma`` (comma-separated),
    ``json_list``, ``json_keys``, ``json_values``.
    """
    c = F.col(text) if isinstance(text, str) else text
    if mode == "lines":
        arr = F.array(c)
    elif mode == "comma":
        arr = F.split(c, ",")
    elif mode == "json_list":
        arr = F.from_json(c, "array<string>")
    elif mode == "json_keys":
        arr = F.map_keys(F.from_json(c, "map<string,string>"))
    elif mode == "json_values":
        arr = F.map_values(F.from_json(c, "map<string,string>"))
    else:
        raise ValueError(f"unknown id list mode {mode!r}")
    return F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def read_id_list(spark: SparkSession, path: str, mode: str = "lines") -> DataFrame:
    """O08 from files: text lines, or whole JSON documents (list or dict)."""
    if mode in ("lines", "comma"):
        src = spark.read.text(path)
    else:
        src = spark.read.option("wholetext", "true").text(path)
    return src.select(F.explode(parse_id_list("value", mode)).alias("id")).distinct()
