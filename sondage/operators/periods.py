"""Export periods, catalog and restart points.

Periods are half-open ``[start, start + 7 days)`` (the reference's end at
23:59 of the last day leaves 59 seconds uncovered).  Period assignment is
integer arithmetic on epoch seconds around an anchor, so it is exact and
needs no alignment trick (``window()`` would align to the epoch's Thursday).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- fixed values ----------------------------------------------------------------------------
PERIOD_DAYS = 7
DEFAULT_HORIZON_DAYS = 365
FILE_TIME_FORMAT = "yyyy-MM-dd-HH-mm-ss"
# ---------------------------------------------------------------------------------------------

DAY = 86400


def period_grid(starts: DataFrame, start_col: str = "start", max_col: str | None = None,
                now: int | None = None, days: int = PERIOD_DAYS) -> DataFrame:
    """Periods from ``start`` while ``period_start < max`` (default start + 365 days),
    none starting after ``now``.  Times are epoch seconds; one row per period."""
    step = days * DAY
    mx = F.col(max_col) if max_col else F.col(start_col) + F.lit(DEFAULT_HORIZON_DAYS * DAY)
    last = mx - F.lit(1)
    if now is not None:
        last = F.least(last, F.lit(now))
    seq = F.when(last >= F.col(start_col), F.sequence(F.col(start_col), last, F.lit(step)))
    keep = [c for c in starts.columns if c not in (start_col, max_col)]
    return (starts.select(*keep, F.explode(seq).alias("period_start"))
            .withColumn("period_end", F.col("period_start") + F.lit(step)))


def period_of(ts: Column, anchor: int, days: int = PERIOD_DAYS) -> Column:
    """Start (epoch seconds) of the period holding ``ts`` (epoch seconds)."""
    step = days * DAY
    return (F.floor((ts - F.lit(anchor)) / F.lit(step)) * F.lit(step) + F.lit(anchor)).cast("bigint")


def file_name(survey: Column, start: Column, end: Column, ext: str = "csv") -> Column:
    fmt = lambda c: F.date_format(F.timestamp_seconds(c), FILE_TIME_FORMAT)
    return F.concat(survey, F.lit("_responses_"), fmt(start), F.lit("_"), fmt(end), F.lit("." + ext))


def period_catalog(raw: DataFrame, anchor: int, days: int = PERIOD_DAYS, time_col: str = "submitted",
                   ext: str = "csv") -> DataFrame:
    """A catalog row per non-empty period: ``(survey, start, end, n, file)``."""
    p = raw.select("survey", period_of(F.col(time_col), anchor, days).alias("start"))
    c = p.groupBy("survey", "start").agg(F.count("*").alias("n"))
    end = F.col("start") + F.lit(days * DAY)
    return c.select("survey", "start", end.alias("end"), "n", file_name(F.col("survey"), F.col("start"), end, ext)
                    .alias("file"))


def catalog_violations(catalog: DataFrame, min_time: Column, max_time: Column) -> DataFrame:
    """Catalog entries outside ``[min, max]`` or starting before the previous end.

    ``lag`` is partitioned by survey, so each survey's catalog is checked in
    its own task.
    """
    w = Window.partitionBy("survey").orderBy("start", "end")
    prev_end = F.lag("end").over(w)
    c = catalog.select("*", prev_end.alias("prev_end"), min_time.alias("_min"), max_time.alias("_max"))
    reasons = F.array_compact(F.array(
        F.when(c["start"] < c["_min"], F.lit("start_before_min")),
        F.when(c["start"] > c["_max"], F.lit("start_after_max")),
        F.when(c["end"] < c["_min"], F.lit("end_before_min")),
        F.when(c["end"] > c["_max"], F.lit("end_after_max")),
        F.when(c["start"] < c["prev_end"], F.lit("overlaps_previous"))))
    return c.select("survey", "start", "end", F.explode(reasons).alias("violation"))


def catalog_period_ok(catalog_period: int, configured: int = PERIOD_DAYS) -> None:
    if catalog_period != configured:
        raise ValueError(f"catalog made for a {catalog_period}-day period, not {configured}")


def restart_point(raw: DataFrame, start: int | None = None, time_col: str = "submitted") -> DataFrame:
    """O37 (raw store): midnight of the latest response per survey, else midnight of ``start``."""
    mx = F.max(time_col)
    fallback = F.lit(start) if start is not None else F.lit(None).cast("bigint")
    t = F.coalesce(mx, fallback)
    return raw.groupBy("survey").agg((F.floor(t / DAY) * DAY).cast("bigint").alias("restart"))


def catalog_restart(catalog: DataFrame, now: int) -> DataFrame:
    """O37 (catalog): midnight of the period holding ``now``, else of the last period."""
    holding = F.max(F.when((F.col("start") <= now) & (F.col("end") > now), F.col("start")))
    last = F.max("start")
    t = F.coalesce(holding, last)
    return catalog.groupBy("survey").agg((F.floor(t / DAY) * DAY).cast("bigint").alias("restart"))


def ordered_page(raw: DataFrame, size: int, offset: int = 0) -> DataFrame:
    """One page in ``(version, submitted, id)`` order — for previews; the
    build itself never pages."""
    o = raw.orderBy("version", "submitted", "id")
    return o.offset(offset).limit(size) if offset else o.limit(size)
