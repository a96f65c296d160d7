"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document longer than the capacity C is cut into pieces of C tokens; its
first piece holds the rest.  All pieces are then placed:

* a piece of C tokens fills a sequence alone;
* large pieces (over C/3) meet at most in pairs: from the longest down, each
  takes the longest partner that still fits, else it opens a sequence alone;
* smaller pieces, from the longest down, go where the gap is smallest, and
  open a new sequence only when no gap holds them.

Pieces of one length are alike, so the placement is worked out on the count
of pieces of each length: at most C numbers, whatever the input.  The driver
sees these counts only.  The plan says, for each length, which stretch of its
pieces goes to which sequences and offsets; tasks then place each piece by its
length and its number among the pieces of that length.

Null text is empty; each document has at least its end token, so none is
lost.  Repeated rows are packed as often as they come.  An empty table gives
an empty table.  Only the named columns are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.llm.base import cut, pick, release_memory, texts_by_bytes
from sondage.llm.vocab import encoder


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` > 0 tokens."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


class Plan:
    """Where the pieces of each length go.

    ``runs[length]``: (first number, first sequence, pieces in each sequence,
    first offset), by rising first number; the pieces of a run fill each
    sequence's share before the next sequence.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self._done: dict[int, int] = defaultdict(int)
        left = {n: c for n, c in counts.items() if c}
        if any(not 0 < n <= capacity for n in left):
            raise ValueError("piece lengths must lie between 1 and the capacity")
        #: open gaps: gap -> stretches of sequences (first, how many) with that gap
        self._gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        large = sorted((n for n in left if 3 * n > capacity), reverse=True)
        self._pair(large, left)
        self._heap = list(self._gaps)
        heapq.heapify(self._heap)
        for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            self._fit(n, left[n])

    def _open(self, count: int) -> int:
        first, self.sequences = self.sequences, self.sequences + count
        return first

    def _put(self, length: int, first: int, sequences: int, each: int, offset: int) -> None:
        self.runs[length].append((self._done[length], first, each, offset))
        self._done[length] += sequences * each

    def _pair(self, large: list[int], left: dict[int, int]) -> None:
        rest = {n: left[n] for n in large}
        for a in large:
            for b in large:  # falling, so the first that fits is the longest
                if not rest[a]:
                    break
                if a + b > self.capacity or not rest[b] or b > a:
                    continue
                if (k := rest[a] // 2 if a == b else min(rest[a], rest[b])):
                    first = self._open(k)
                    if a == b:
                        self._put(a, first, k, 2, 0)
                    else:
                        self._put(a, first, k, 1, 0)
                        self._put(b, first, k, 1, a)
                    rest[a] -= k
                    rest[b] -= k
                    self._gaps[self.capacity - a - b].append((first, k))
            if rest[a]:
                first = self._open(rest[a])
                self._put(a, first, rest[a], 1, 0)
                self._gaps[self.capacity - a].append((first, rest[a]))
                rest[a] = 0

    def _fit(self, n: int, count: int) -> None:
        """Best fit: the smallest gap that holds ``n``; a sequence stays the tightest while it still does."""
        for gap in sorted(g for g in self._gaps if g >= n):
            each = gap // n
            while count and self._gaps[gap]:
                first, k = self._gaps[gap].pop()
                full = min(k, count // each)
                if full:
                    self._put(n, first, full, each, self.capacity - gap)
                    self._gaps[gap - each * n].append((first, full))
                    count -= full * each
                if full < k:
                    if count:  # fewer than a full share: one more sequence takes them
                        self._put(n, first + full, 1, count, self.capacity - gap)
                        self._gaps[gap - count * n].append((first + full, 1))
                        full, count = full + 1, 0
                    if full < k:
                        self._gaps[gap].append((first + full, k - full))
            if not count:
                return
        each = self.capacity // n
        if (full := count // each):
            first = self._open(full)
            self._put(n, first, full, each, 0)
            self._gaps[self.capacity - each * n].append((first, full))
        if (over := count - full * each):
            first = self._open(1)
            self._put(n, first, 1, over, 0)
            self._gaps[self.capacity - over * n].append((first, 1))

    def place(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces given by length and number among that length's pieces."""
        seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            begin, first, each, offset = np.array(self.runs[int(n)], np.int64).T
            run = np.searchsorted(begin, numbers[at], "right") - 1
            k = numbers[at] - begin[run]
            seq[at] = first[run] + k // each[run]
            off[at] = offset[run] + k % each[run] * n
        return seq, off


def tokenize_pieces(df: DataFrame, path: str, end_id: int, capacity: int, id_col: str, text_col: str,
                    with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32[, ids]`` and its number in its task and length."""
    rows = pick(df, _id=id_col, _text=text_col)
    kind = dict(df.dtypes)[id_col]
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_number"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        enc, part = encoder(path, "spaced"), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for at, texts in texts_by_bytes(b, "_text"):
                keys, out = b.column("_id").slice(at, len(texts)), []
                for k, raw in enumerate(enc(texts)):
                    raw, start = raw + end, 0
                    for piece, n in enumerate(piece_lengths(len(raw) // 4, capacity)):
                        data = raw[4 * start : 4 * (start + n)]
                        out.append((k, piece, start, n, zlib.crc32(data), seen[n], data))
                        seen[n] += 1
                        start += n
                k, piece, start, n, crc, number, data = zip(*out)
                cols = [keys.take(pa.array(k)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()),
                        pa.array(crc, pa.int64()), pa.array(np.full(len(n), part), pa.int64()), pa.array(number, pa.int64())]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, "<i4") for x in data], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, _part long, _number long"
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def pack(df: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]``."""
    pieces = cut(tokenize_pieces(df, path, end_id, capacity, id_col, text_col, with_ids), "pieces")
    by_part = pieces.groupBy("length", "_part").agg(F.count("*").alias("_count"))
    # rows: lengths x tasks at most; a window over one length sees a row per task
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "_part", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    plan = Plan(counts, capacity)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["sequence_id"], f["offset"] = plan.place(f["length"].to_numpy(), (f["_before"] + f["_number"]).to_numpy())
            yield f[out]

    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    kind = dict(pieces.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.join(offsets, ["length", "_part"]).mapInPandas(run, schema + ", ids array<int>" * with_ids)
