"""Exact dedup by sorting content.

Texts are equal when identical after lower-casing A-Z.  Sampled splitters
range-partition the rows by (first normalised bytes, SHA-256 of the
normalised text, id); Spark's external sort orders each range alike.  Equal
texts are then neighbours, found by comparing each text in full with the one
before.  The id in the key splits a very common text over many ranges, so a
text may run on over a border: the first and the last run of each range are
matched once more by their full texts, which are two texts a range.

Within a group the row with the smallest id stays (``keep="largest"``: the
largest).  Null text is empty; a null id comes last in either order, so it
stays only where all ids of the group are null.  Repeated rows: one of them
stays.  An empty table gives an empty table.  Carried columns may have any
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.llm.base import ascii_lower, bound_batches, cut, fresh, pick, shuffle_width

#: Leading bytes in the sort key; the hash of the whole text follows them.
KEY_BYTES = 32


def _sorted(df: DataFrame, text: str, row_id: str, keep: str, head: str, digest: str) -> DataFrame:
    """Rows with sort keys, range-partitioned and sorted."""
    norm = ascii_lower(F.col(text))
    order = F.col(row_id).desc_nulls_last() if keep == "largest" else F.col(row_id).asc_nulls_last()
    keyed = (df.withColumn(head, norm.cast("binary")).withColumn(digest, F.sha2(F.col(head), 256))
             .withColumn(head, F.substring(head, 1, KEY_BYTES)))
    keys = [F.col(head), F.col(digest), order]
    return keyed.repartitionByRange(shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys)


def find_runs(df: DataFrame, text: str, row_id: str, keep: str, carry: list[str], names: list[str]) -> DataFrame:
    """``carry`` columns and, under ``names``: digest, run, the run's kept id, its size, first of it, edge text.

    A run is a stretch of equal texts in one range.  Its rows are held until
    it ends; the edge text is given for the first rows of a range's outer runs.
    """
    bound_batches(df.sparkSession)
    head, digest = fresh(df, "_head", "_digest")
    rows = _sorted(df, text, row_id, keep, head, digest)
    kinds = {f.name: f.dataType for f in df.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in carry] + [
        T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.LongType(), kinds[row_id], T.LongType(), T.BooleanType(), T.StringType()))])
    need = list(dict.fromkeys([*carry, row_id, text, digest]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, last, held, held_n = TaskContext.get().partitionId(), 0, None, [], 0

        def closed(rows: pa.Table, new: np.ndarray, final: bool) -> list[pa.RecordBatch]:
            """Whole runs as output; ``new`` marks their first rows."""
            nonlocal done
            starts = np.flatnonzero(new)
            sizes, which = np.diff(np.append(starts, len(new))), np.cumsum(new) - 1
            edge = np.zeros(len(new), bool)
            edge[starts[0]] = done == 0
            edge[starts[-1]] |= final
            lower = pc.ascii_lower(pc.fill_null(rows[text], ""))
            cols = [rows[c] for c in carry] + [
                rows[digest], pa.array(which + (part << 33) + done), rows[row_id].take(pa.array(starts[which])), pa.array(sizes[which]),
                pa.array(new), pc.if_else(pa.array(edge), lower, pa.scalar(None, lower.type))]
            done += len(starts)
            return pa.Table.from_arrays(cols, [*carry, *names]).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            lower = pc.ascii_lower(pc.fill_null(b.column(text), ""))
            new = np.ones(b.num_rows, bool)
            new[1:] = ~pc.equal(lower[1:], lower[:-1]).to_numpy(zero_copy_only=False)
            new[0] = lower[0].as_py() != last
            last = lower[-1].as_py()
            t = pa.Table.from_batches([b])
            starts = np.flatnonzero(new)
            if not len(starts):  # the open run goes on
                held.append(t)
                held_n += b.num_rows
                continue
            rest = int(starts[-1])
            whole = pa.concat_tables([*held, t.slice(0, rest)])
            if whole.num_rows:
                flags = np.concatenate([np.arange(held_n) == 0, new[:rest]])
                yield from closed(whole, flags, False)
            held, held_n = [t.slice(rest)], b.num_rows - rest
        if held_n:
            yield from closed(pa.concat_tables(held), np.arange(held_n) == 0, True)

    return rows.select(*need).mapInArrow(run, schema)


def _over_borders(runs: DataFrame, keep: str, names: list[str]) -> DataFrame:
    """``run, kept id, size`` of the runs of texts that go over a border, by their full texts."""
    digest, run, kept, size, first, edge = names
    best = F.max(kept) if keep == "largest" else F.min(kept)
    return (runs.filter(F.col(first) & F.col(edge).isNotNull()).groupBy(edge)
            .agg(best.alias("_all_kept"), F.sum(size).alias("_all_size"), F.collect_list(run).alias("_runs"))
            .filter(F.size("_runs") > 1).select(F.explode("_runs").alias("_run"), "_all_kept", "_all_size"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row: ``doc_id, keep_id, group_size, kept, text_sha256`` (of the normalised text)."""
    names = ["text_sha256", "_run", "_kept", "_size", "_first", "_edge"]
    runs = cut(find_runs(pick(df, doc_id=id_col, _text=text_col), "_text", "doc_id", keep, ["doc_id"], names), "runs")
    # two rows at most for each range: a proven bound for the broadcast
    borders = F.broadcast(_over_borders(runs, keep, names).withColumnRenamed("_run", "_border"))
    keep_id, over = F.when(F.col("_border").isNotNull(), F.col("_all_kept")).otherwise(F.col("_kept")), F.col("_all_size")
    return runs.join(borders, runs["_run"] == borders["_border"], "left").select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce(over, F.col("_size")).alias("group_size"),
        (F.col("_first") & keep_id.eqNullSafe(F.col("doc_id"))).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that stay, with all their columns."""
    names = fresh(df, "_sha", "_run", "_kept", "_size", "_first", "_edge", "_border")
    run, kept, first = names[1], names[2], names[4]
    heads = cut(find_runs(df, text_col, id_col, keep, df.columns, names[:6]).filter(F.col(first)), "heads")
    borders = _over_borders(heads, keep, names[:6])
    borders = F.broadcast(borders.select(F.col("_run").alias(names[6]), F.col("_all_kept").alias(names[0])))
    stays = F.col(names[6]).isNull() | borders[names[0]].eqNullSafe(heads[kept])
    return heads.join(borders, heads[run] == F.col(names[6]), "left").filter(stays).select(*[heads[c] for c in df.columns])
