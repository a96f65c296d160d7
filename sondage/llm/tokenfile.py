"""Token ids as files of frequency-ranked, byte-aligned variable-length codes.

The file format.  A shard holds consecutive documents in ascending order of
their ids.  Token ids are ranked by how often they occur in all documents
(ties: the smaller id first), and each token is coded as its rank in 1 to 4
little-endian bytes.  The lengths stand apart from the bytes: two control bits a token
(length - 1), four tokens a control byte, the first in the lowest bits.

======== ======== ======================================================
field    type     content
======== ======== ======================================================
part     long     place of the range of documents in the order of all
seq      long     place of the shard in its range
base     long     tokens before the shard in its range
doc_ids  array    document ids
lengths  array    tokens of each document
control  binary   control bytes
data     binary   rank bytes
======== ======== ======================================================

Shards are rows of Parquet files, so Spark commits each task's files whole;
``_ranking`` beside them, written last, holds a row ``(rank, id)`` for each id in use.

Texts are encoded once, where they lie, and their ids written to a scratch table
(two bytes an id if all of a document's fit), each task's counts of ids with
them.  The counts, summed by Spark, give the ranking: a row for each id of the
vocabulary, which bounds what the driver and the tasks hold of it.  Only ids are
then sorted and coded, no texts.

Each shard is decoded by itself: a table maps a control byte to its four
lengths, a cumulative sum gives each token's place, and one gather per byte
position rebuilds the ranks.

Null text: empty, the end id only.  Null ids come first.  Equal ids are
ordered by a hash of the text, then the token ids.  An empty table gives no shard.  A document is never split
over shards; a shard closes once it holds ``shard_tokens`` tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm.base import pick, scratch, shuffle_width, texts_by_bytes
from sondage.llm.vocab import encoder

SHARD = "part long, seq long, base long, doc_ids array<long>, lengths array<long>, control binary, data binary"
SCHEMA = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("base", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
#: The lengths of the four tokens of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3) + 1).astype(np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes)."""
    ranks = ranks.astype("<u4")
    size = (1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    control = (code.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(1).astype(np.uint8)
    octets = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), octets[np.arange(4) < size[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    start = np.cumsum(size) - size
    octets = np.frombuffer(data, np.uint8)
    out = octets[start].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(size > k)
        out[at] |= octets[start[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: Ids of documents, or (with no tokens) the counts of a task.
IDS = "id long, hash long, wide boolean, tokens binary, seen array<struct<id:long,n:long>>"
IDS_SCHEMA = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("wide", pa.bool_()), ("tokens", pa.binary()),
                        ("seen", pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())])))])


def _encoded(df: DataFrame, path: str, end_id: int, cut: str, id_col: str, text_col: str, chunks: int) -> DataFrame:
    """The ids of all texts as a scratch table of ``IDS``."""
    rows = pick(df, _id=id_col, _text=text_col)
    rows = rows.select(F.col("_id").cast("long").alias("id"), F.xxhash64("_text").alias("hash"), "_text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, count = encoder(path, cut, limit=chunks), np.zeros(0, np.int64)
        for b in batches:
            for at, texts in texts_by_bytes(b, "_text"):
                coded = [raw + end for raw in enc(texts)]
                here = np.bincount(np.frombuffer(b"".join(coded), "<u4"))  # as long as the vocabulary at most
                if len(here) > len(count):
                    here, count = count, here
                count[: len(here)] += here
                ids = [np.frombuffer(x, "<u4") for x in coded]
                wide = [bool(x.max() > 0xFFFF) for x in ids]
                tokens = [x if w else i.astype("<u2").tobytes() for x, i, w in zip(coded, ids, wide)]
                yield pa.RecordBatch.from_arrays([
                    b.column("id").slice(at, len(ids)), b.column("hash").slice(at, len(ids)), pa.array(wide, pa.bool_()),
                    pa.array(tokens, pa.binary()), pa.nulls(len(ids), IDS_SCHEMA.field("seen").type)], schema=IDS_SCHEMA)
        if len(count):
            seen = [{"id": int(i), "n": int(count[i])} for i in np.flatnonzero(count)]
            yield pa.RecordBatch.from_pylist([dict(id=None, hash=None, wide=None, tokens=None, seen=seen)], IDS_SCHEMA)

    out = scratch(df.sparkSession, "ids")
    rows.mapInArrow(run, IDS).write.option("compression", "zstd").parquet(out)
    return df.sparkSession.read.schema(IDS).parquet(out)


def write_tokens(df: DataFrame, out: str, path: str, end_id: int, cut: str = "words", id_col: str = "doc_id", text_col: str = "text",
                 shard_tokens: int = 1 << 20, chunks: int = 1_000_000) -> None:
    """Encode every text, append ``end_id``, and write the ranking and the shards, in ascending order of the ids, to ``out``.

    A worker keeps the ids of ``chunks`` chunks of text at most, which bounds its memory and changes no result.
    """
    spark = df.sparkSession
    coded = _encoded(df, path, end_id, cut, id_col, text_col, chunks)
    seen = coded.where(F.col("seen").isNotNull()).select(F.inline("seen")).groupBy("id").agg(F.sum("n").alias("n"))
    order = [r["id"] for r in sorted(seen.collect(), key=lambda r: (-r["n"], r["id"]))]  # a row for each id of the vocabulary
    rank = np.zeros(1 + max(order, default=0), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    table = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, base, rank = TaskContext.get().partitionId(), 0, 0, table.value
        docs, lengths, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, base, size
            control, data = encode_ranks(np.concatenate(held))
            row = dict(part=part, seq=seq, base=base, doc_ids=list(docs), lengths=list(lengths), control=control, data=data)
            seq, base, size = seq + 1, base + size, 0
            for x in (docs, lengths, held):
                x.clear()
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        for b in batches:
            for key, wide, tokens in zip(b.column("id").to_pylist(), b.column("wide").to_pylist(), b.column("tokens")):
                docs.append(key)
                held.append(rank[np.frombuffer(tokens.as_buffer(), "<u4" if wide else "<u2")])
                lengths.append(len(held[-1]))
                size += lengths[-1]
                if size >= shard_tokens:
                    yield close()
        if docs:
            yield close()

    # ids may repeat: the text's hash splits a very common id, and orders its rows
    keys = [F.col("id").asc_nulls_first(), F.col("hash")]
    (coded.where(F.col("tokens").isNotNull()).select("id", "hash", "wide", "tokens")
     .repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys, "tokens").select("id", "wide", "tokens")
     .mapInArrow(run, SHARD).write.option("compression", "none").parquet(out))
    spark.createDataFrame(list(enumerate(order)), "rank long, id long").coalesce(1).write.parquet(f"{out}/_ranking")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32[, ids]``.

    ``start`` counts the tokens of all documents before.  The ranges' totals
    (a row for each range) give where each range starts.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    ranking = spark.read.schema("rank long, id long").parquet(f"{path}/_ranking").collect()  # a row for each id of the vocabulary
    by_rank = spark.sparkContext.broadcast(np.array([r["id"] for r in sorted(ranking)], "<u4"))
    totals = shards.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    starts, at = {}, 0
    for r in sorted(totals.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # a row for each range
        starts[r["part"]], at = at, at + r["n"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                ends = np.cumsum(row["lengths"])
                ids = by_rank.value[decode_ranks(row["control"], row["data"], int(ends[-1]))]
                raw, first = ids.tobytes(), ends - row["lengths"]
                each = [raw[4 * s : 4 * e] for s, e in zip(first.tolist(), ends.tolist())]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(first + (starts[row["part"]] + row["base"]), pa.int64()),
                        pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, "<i4") for x in each], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
