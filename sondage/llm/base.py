"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.session import checkpoint_dir

BATCH = 4 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage durably: a lost executor costs no recomputation, and
    every later reader sees the same rows.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH`` bytes at most: with long texts the usual bound takes much memory in each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key)) or 0) != BATCH:
        spark.conf.set(key, f"{BATCH}b")


def release_memory() -> None:
    """Give freed memory back to the system; a worker keeps it otherwise, next to its executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``new=old`` columns only, so that no other column can clash; bounds Arrow batches on the way."""
    bound_batches(df.sparkSession)
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that ``df`` does not use (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def texts_by_bytes(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) over slices of a batch of about ``limit`` bytes; null is empty."""
    col = batch.column(column)
    size = max(1, col.nbytes // max(1, limit))
    step = max(1, math.ceil(batch.num_rows / size))
    for at in range(0, batch.num_rows, step):
        yield at, [x or b"" for x in col.slice(at, step).cast(pa.large_binary()).to_pylist()]
