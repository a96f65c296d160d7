"""Figures of a load gathered while it is written.

``LoadWatch`` hangs an observation on the rows of a load: per survey the rows,
the payloads that do not decode, the time range and the versions.  They are
there when the action that writes the rows has finished, so the import log,
the reject counts and the version counts need no job of their own.

An observation has no groups: the surveys must be known (they are the build
plan's), and a metric stands for each of them.  Rows of other surveys, and
rows without one, are counted together under no name.  Counts by version need
the versions too; without them the versions met are listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Surveys (and versions of each) that may be watched; an observation's row goes to the driver.
MOST = 10_000

LOG = "survey string, start long, end long, n long, rejects long, versions array<string>"
VERSIONS = "survey string, version string, n long"


class LoadWatch:
    """Watch one load: ``watch`` its rows, write them, then ask ``log``, ``rejects`` and ``version_counts``."""

    def __init__(self, surveys: Sequence[str], versions: Sequence[str] = (), time_col: str = "submitted", data_col: str = "data"):
        self.surveys, self.versions = list(dict.fromkeys(surveys)), list(dict.fromkeys(versions))
        if len(self.surveys) * (1 + len(self.versions)) > MOST:
            raise ValueError(f"more than {MOST} figures to watch")
        self.time_col, self.data_col = time_col, data_col
        self.seen = Observation()

    def _groups(self) -> list[tuple[str | None, Column]]:
        named = [(s, F.col("survey") == F.lit(s)) for s in self.surveys]
        other = ~F.col("survey").isin(self.surveys) if self.surveys else F.lit(True)
        return [*named, (None, F.coalesce(other, F.lit(True)))]

    def watch(self, df: DataFrame) -> DataFrame:
        """``df`` with the observation on it; it must be executed once."""
        from ..sources.raw import decode
        bad = decode(self.data_col).isNull() if self.data_col in df.columns else F.lit(False)
        metrics = []
        for i, (_, here) in enumerate(self._groups()):
            one = lambda c: F.when(here, c)
            metrics += [
                F.count(one(F.lit(1))).alias(f"n{i}"), F.count(F.when(here & bad, F.lit(1))).alias(f"bad{i}"),
                F.min(one(F.col(self.time_col))).alias(f"start{i}"), F.max(one(F.col(self.time_col))).alias(f"end{i}"),
                F.sort_array(F.collect_set(one(F.col("version")))).alias(f"versions{i}")]
            metrics += [F.count(F.when(here & (F.col("version") == F.lit(v)), F.lit(1))).alias(f"v{i}_{k}") for k, v in enumerate(self.versions)]
        return df.observe(self.seen, *metrics)

    def log(self, spark: SparkSession) -> DataFrame:
        """``survey, start, end, n, rejects, versions`` for each survey that the load had rows of."""
        got = self.seen.get
        rows = [(s, got[f"start{i}"], got[f"end{i}"], got[f"n{i}"], got[f"bad{i}"], list(got[f"versions{i}"]))
                for i, (s, _) in enumerate(self._groups()) if got[f"n{i}"]]
        return spark.createDataFrame(rows, LOG)

    def version_counts(self, spark: SparkSession) -> DataFrame:
        """``survey, version, n`` of the versions watched."""
        got = self.seen.get
        rows = [(s, v, got[f"v{i}_{k}"]) for i, (s, _) in enumerate(self._groups()) for k, v in enumerate(self.versions) if got[f"v{i}_{k}"]]
        return spark.createDataFrame(rows, VERSIONS)

    @property
    def rejects(self) -> int:
        """Payloads of the load that do not decode."""
        got = self.seen.get
        return sum(got[f"bad{i}"] for i in range(len(self.surveys) + 1))
