"""Target-distribution importance resampling with an Aho-Corasick dictionary.

A document's weight is the mean log ratio of its features' frequencies in the
target and in the corpus, by hash buckets; Gumbel noise by document id turns
the highest scores into a draw without replacement.

Features are runs of words, hashed by CRC-32.  Distinct words stand in an
Aho-Corasick automaton, bounded by a space on each side, each with its
checksum and its length as payload.  Scanning a text emits the payloads of its
words; the checksum of a run follows from the payloads of adjacent words alone
(a checksum is moved over the bytes behind it and the next one is added), so no
run is ever built as a string.  A worker's dictionary grows with the words it
meets up to ``ROOM`` words; words beyond that, or longer than ``LONGEST``
bytes, get the same checksum directly, so what a dictionary holds changes no
result.

Two scans, one that counts buckets (added up in each task, then by bucket) and
one that scores.  Only the table of gains, one number a bucket, goes to all
tasks.  The draw numbers rows in ranges of their order, with no window over
all of them.

Null and empty texts have no features: weight 0.  A null id counts as the empty
text where it is hashed.  Equal scores go to the smaller id (null first);
repeated rows have equal scores and take places one after the other.  Empty
tables give an empty table; an empty target gives gains all the same (T = 0).
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.base import cut, pick, texts_by_bytes
from sondage.operators.store import dense_index

#: Words of a worker's dictionary, and bytes of the longest word in it.
ROOM, LONGEST = 1 << 17, 48
#: Lower-cases A-Z; every other ASCII character but digits and letters becomes a space.
FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
SPACE = zlib.crc32(b" ")


class Shifts:
    """Checksums moved over n bytes: crc(a + b) = shift(crc(a), len(b)) ^ crc(b).

    Moving is linear over bits, so four tables of a byte each do it; the
    tables of a length are made once.
    """

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    @staticmethod
    def _columns(n: int) -> list[int]:
        """Where each of the 32 bits goes, by doubling the distance."""
        apply = lambda m, x: int(np.bitwise_xor.reduce([m[i] for i in range(32) if x >> i & 1] or [0]))
        bit = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
        for _ in range(3):
            bit = [apply(bit, c) for c in bit]  # one zero byte
        out = [1 << i for i in range(32)]
        while n:
            if n & 1:
                out = [apply(bit, c) for c in out]
            bit, n = [apply(bit, c) for c in bit], n >> 1
        return out

    def table(self, n: int) -> np.ndarray:
        if n not in self.tables:
            columns = np.array(self._columns(n), np.uint32).reshape(4, 8)
            bits = np.arange(256)[:, None] >> np.arange(8) & 1
            self.tables[n] = np.bitwise_xor.reduce(np.where(bits[None], columns[:, None, :], np.uint32(0)), axis=2)
        return self.tables[n]

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.empty(len(crc), np.uint32)
        for length in np.unique(n):
            here = n == length
            t, c = self.table(int(length)), crc[here]
            out[here] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        return out


class Dictionary:
    """Delimited words with their payloads; grows with the words it meets."""

    def __init__(self, room: int = ROOM):
        self.room = room
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.crc, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.later: dict[bytes, int] = {}  # words to be added, with their checksums

    def _grow(self) -> None:
        known = len(self.crc)
        if len(self.later) < max(1024, known // 2) and known + len(self.later) < self.room:
            return
        for i, w in enumerate(self.later):
            self.automaton.add_word(f" {w.decode('latin-1')} ", known + i)  # a character a byte
        self.crc = np.append(self.crc, np.fromiter(self.later.values(), np.uint32, len(self.later)))
        self.length = np.append(self.length, np.fromiter(map(len, self.later), np.int64, len(self.later)))
        self.automaton.make_automaton()
        self.later = {}

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first bytes, checksums, lengths) of the words of a folded text that begins and ends with a space."""
        blank = np.frombuffer(text, np.uint8) == 32
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        crc, length = np.zeros(len(starts), np.uint32), np.zeros(len(starts), np.int64)
        if len(self.crc):
            emitted = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
            word = np.searchsorted(ends, emitted[:, 0])  # a match ends with the space behind its word
            crc[word], length[word] = self.crc[emitted[:, 1]], self.length[emitted[:, 1]]
        missing = np.flatnonzero(length == 0)
        full = len(self.crc) >= self.room
        for i, a, z in zip(missing.tolist(), starts[missing].tolist(), ends[missing].tolist()):
            w = text[a:z]
            c = self.later.get(w)
            if c is None:
                c = zlib.crc32(w)
                if not full and z - a <= LONGEST and len(self.crc) + len(self.later) < self.room:
                    self.later[w] = c
            crc[i], length[i] = c, z - a
        if self.later:
            self._grow()
        return starts, crc, length


_SHIFTS = Shifts()
_DICTIONARY = Dictionary()  # of this worker; shared by its tasks


def feature_buckets(texts: list[bytes], n: int, buckets: int, dictionary: Dictionary | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature) for runs of 1 to ``n`` words."""
    folded = [t.translate(FOLD) for t in texts]
    begins = np.cumsum([1] + [len(t) + 1 for t in folded])
    starts, crc, length = (dictionary or _DICTIONARY).scan(b" " + b" ".join(folded) + b" ")
    owner = np.searchsorted(begins, starts, "right") - 1
    owners, hashes, run = [owner], [crc], crc
    for k in range(1, n):
        run = run[: max(0, len(crc) - k)]
        behind = length[k:]
        run = _SHIFTS(run, behind + 1) ^ _SHIFTS(np.full(len(run), SPACE, np.uint32), behind) ^ crc[k:]
        whole = owner[: len(run)] == owner[k:]
        owners.append(owner[k:][whole])
        hashes.append(run[whole])
    return np.bincount(owner, minlength=len(texts)), np.concatenate(owners), (np.concatenate(hashes) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(df: DataFrame, text_col: str, n: int, buckets: int) -> DataFrame:
    """``bucket, n``: features of all texts by bucket, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, texts in texts_by_bytes(b, "_text"):
                total += np.bincount(feature_buckets(texts, n, buckets)[2], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    return pick(df, _text=text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """Gain of each bucket, and of one that neither side hits; ``buckets`` rows at most come to the driver."""
    both = (corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
            .unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
            .groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    counts = cut(both, "buckets")
    sums = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    double = lambda x: (F.col(x) if isinstance(x, str) else F.lit(x)).cast("double")
    ratio = ((double("t") + 1) * double(sums["s"] + buckets)) / ((double("s") + 1) * double(sums["t"] + buckets))
    out = np.zeros(buckets, np.int64)
    for r in counts.select("bucket", F.floor(F.log(ratio) * 1000.0).alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def weights(df: DataFrame, id_col: str, text_col: str, gain: np.ndarray, n: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in texts_by_bytes(b, "_text"):
                words, owner, bucket = feature_buckets(texts, n, len(gain))
                features = np.bincount(owner, minlength=len(texts))
                total = np.bincount(owner, gain[bucket], len(texts)).astype(np.int64)  # whole numbers far below 2^53
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(texts)), *[pa.array(x.astype(np.int64)) for x in (words, features, weight)]],
                    ["doc_id", "n_words", "n_features", "weight"])

    rows = pick(df, doc_id=id_col, _text=text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(row_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, by the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row per row: ``doc_id, n_features, weight, score, rank`` and ``n_words``; ``rank`` of those drawn."""
    gain = gains(bucket_counts(df, text_col, n, buckets), bucket_counts(target, target_col, n, buckets), buckets)
    scored = cut(weights(df, id_col, text_col, gain, n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    placed = dense_index(df.sparkSession, scored.withColumn("_order", F.struct((~able).alias("out"), (-F.col("score")).alias("score"), "doc_id")), "_order", name="rank")
    rank = F.when(able & (F.col("rank") <= drawn), F.col("rank"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"), "n_words")
