"""Substring dedup by relative Lempel-Ziv parsing.

A window is a run of ``window`` words of one document; a word goes if a window
over it also stands in a document with a smaller id.

Any two equal windows choose the same run of ``gram`` words in them, the one
with the smallest hash, as their anchor.  Consecutive windows with one anchor
make a piece of text, and pieces go to the reference block of their anchor's
hash, so a window meets all its equals in one block and nothing else has to be
compared.  Only pieces whose anchor stands in more than one document travel.

1. Documents are written once as lines of words, in slices, bucketed by slice:
   later passes over the slices read them where they lie.
2. Each slice sends its distinct anchors, with the number of their distinct
   pieces, and learns which ones other documents have too.
3. Of those it sends the distinct pieces with their smallest document.  An
   anchor with more than ``HOT`` pieces in all (a common phrase in ever new
   surroundings) sends its windows one by one instead, to the block of the
   window's own hash, so no phrase fills a block.
4. A reference block is the distinct pieces in order of their smallest
   documents.  Its index tells for each word how far the text from there on
   repeats a piece of a smaller document (a trie of the block, built level by
   level; a node keeps its smallest document).  Every piece is parsed greedily
   into the longest factors found so.  Factors of ``window`` words or more are
   duplicate spans; a window over a factor's border can repeat another place, so
   the windows over each border that the two factors leave room for are looked
   up as well (three factors cannot hold one: the middle one would go on).
   Words are compared, not hashes.
5. Slices get the answers for their pieces and mark the words.

A common passage counts once a slice, whatever number of documents have it.

Words are runs without ASCII white space, unchanged.  Null and empty texts have
none.  Ids are whole numbers; rows without one come after all others and take
nothing from each other, nor do rows that share an id.  An empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.base import cut, pick, release_memory, scratch, shuffle_width, texts_by_bytes
from sondage.llm.hashing import hash_stretches, mix

#: Bytes of text in a slice (one file of its bucket); bytes for each reference block if all text were sent there once.
SLICE_BYTES, BLOCK_BYTES = 4 << 20, 6 << 20
#: Distinct pieces, added over slices, beyond which an anchor's windows are sent one by one.
HOT = 1 << 14
#: Windows that may share an anchor, at most.
SPREAD = 9
NO_ID = np.iinfo(np.int64).max
_ALONE, _SHARED, _HOT = 0, 1, 2


# --- 1. slices ----------------------------------------------------------------------------


def _slices(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``slice, place, doc_id, size, line`` as a table bucketed by slice, under ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    rows = pick(df, doc_id=id_col, _text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        number, place, held = TaskContext.get().partitionId() << 33, 0, 0
        for b in batches:
            for at, texts in texts_by_bytes(b, "_text"):
                lines = [b" ".join(t.split()) for t in texts]  # bytes: ASCII white space only
                slices, places = [], []
                for line in lines:
                    if held and held + len(line) > SLICE_BYTES:
                        number, place, held = number + 1, 0, 0
                    slices.append(number)
                    places.append(place)
                    place, held = place + 1, held + len(line)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slices, pa.int64()), pa.array(places, pa.int64()), b.column("doc_id").slice(at, len(lines)),
                     pa.array([len(x) for x in lines], pa.int64()), pa.array(lines, pa.binary())], ["slice", "place", "doc_id", "size", "line"])

    name = f"sondage_slices_{uuid.uuid4().hex}"
    (rows.mapInArrow(run, "slice long, place long, doc_id long, size long, line binary").write.bucketBy(shuffle_width(spark), "slice")
     .option("path", scratch(spark, "slices")).option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


class Slice:
    """The words of a slice's documents, and its pieces."""

    def __init__(self, table: pa.Table, window: int, gram: int):
        table = table.sort_by("place")
        self.number = table["slice"][0].as_py()
        self.ids = table["doc_id"]
        self.lines = table["line"].to_pylist()
        self.docs = self.ids.combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.n_words = np.array([x.count(b" ") + 1 if x else 0 for x in self.lines], np.int64)
        self.window = window
        self.data = b" ".join(x for x in self.lines if x)
        octets = np.frombuffer(self.data, np.uint8)
        self.octets = octets
        spaces = np.flatnonzero(octets == 32)
        self.starts = np.append(0, spaces + 1) if len(octets) else np.zeros(0, np.int64)
        self.ends = np.append(spaces, len(octets)) if len(octets) else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(self.lines)), self.n_words)
        n = len(self.starts) - window + 1
        if n < 1:
            self.first = self.count = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        words = hash_stretches(octets, self.starts, self.ends)
        grams = np.zeros(len(words) - gram + 1, np.uint64)
        for j in range(gram):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(grams)]
        grams = mix(grams)
        low, at = grams[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, window - gram + 1):  # the first of the smallest
            less = grams[j : j + n] < low
            np.copyto(low, grams[j : j + n], where=less)
            at[less] = j
        at += np.arange(n)
        whole = self.row[:n] == self.row[window - 1 :]
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (at[1:] != at[:-1])
        self.first = np.flatnonzero(new)
        self.count = np.bincount((np.cumsum(new) - 1)[whole], minlength=len(self.first))
        self.anchor = low[self.first]

    def stretches(self, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) bytes of pieces of ``count`` windows."""
        return self.starts[first], self.ends[first + count + self.window - 2]

    def units(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, windows, key) of what is sent: pieces, or single windows of hot anchors, in order of their keys."""
        pieces, hot = shared == _SHARED, np.flatnonzero(shared == _HOT)
        n = self.count[hot]
        single = np.repeat(self.first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.concatenate([self.first[pieces], single])
        count = np.concatenate([self.count[pieces], np.ones(len(single), np.int64)])
        keys = np.concatenate([self.anchor[pieces], hash_stretches(self.octets, *self.stretches(single, np.ones(len(single), np.int64)))])
        order = np.argsort(keys, kind="stable")
        return first[order], count[order], keys[order]

    def distinct(self, first: np.ndarray, count: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """(different contents, which of them each unit has), in the units' order."""
        known: dict[bytes, int] = {}
        a, z = self.stretches(first, count)
        which = np.fromiter((known.setdefault(self.data[x:y], len(known)) for x, y in zip(a.tolist(), z.tolist())), np.int64, len(first))
        return list(known), which


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)  # rises with the keys


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets there are, their borders) of rising buckets."""
    kinds, starts = np.unique(bucket, return_index=True)
    return kinds, np.append(starts, len(bucket))


# --- 2. anchors ---------------------------------------------------------------------------


def _ask(s: Slice, buckets: int) -> pa.Table:
    """Distinct anchors by bucket: hash, and distinct pieces (15 bits; the upper bit: in several documents of the slice)."""
    content = hash_stretches(s.octets, *s.stretches(s.first, s.count)) if len(s.first) else s.anchor
    order = np.lexsort((content, s.anchor))
    a, c, d = s.anchor[order], content[order], s.docs[s.row[s.first]][order]
    new = np.append(True, a[1:] != a[:-1])[: len(a)]
    starts = np.flatnonzero(new)
    fresh = new.copy()
    fresh[1:] |= c[1:] != c[:-1]
    kinds, borders = np.zeros(0, np.int64), np.zeros(1, np.int64)
    counts = anchors = np.zeros(0)
    if len(a):
        several = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
        counts = (np.minimum(np.add.reduceat(fresh.astype(np.int64), starts), 0x7FFF) | several.astype(np.int64) << 15).astype("<u2")
        anchors = a[starts].astype("<u8")
        kinds, borders = _by_bucket(_bucket(a[starts], buckets))
    return pa.table({
        "bucket": pa.array(kinds, pa.int64()), "slice": pa.array([s.number] * len(kinds), pa.int64()),
        "anchors": pa.array([anchors[x:y].tobytes() for x, y in zip(borders, borders[1:])], pa.binary()),
        "counts": pa.array([counts[x:y].tobytes() for x, y in zip(borders, borders[1:])], pa.binary())})


def _answer(table: pa.Table) -> pa.Table:
    """For each asking slice: whether its anchors are alone, shared or hot."""
    packs = [np.frombuffer(x.as_py(), "<u8") for x in table["anchors"]]
    counts = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in table["counts"]])
    _, place, slices = np.unique(np.concatenate(packs), return_inverse=True, return_counts=True)
    pieces = np.bincount(place, counts & 0x7FFF)
    shared = (slices > 1) | (np.bincount(place, counts >> 15) > 0)
    kind = np.where(shared, np.where(pieces > HOT, _HOT, _SHARED), _ALONE).astype(np.uint8)[place]
    out = [x.tobytes() if x.any() else None for x in np.split(kind, np.cumsum([len(p) for p in packs])[:-1])]
    told = pa.table({"slice": table["slice"], "bucket": table["bucket"], "kinds": pa.array(out, pa.binary())})
    return told.filter(told["kinds"].is_valid())


def _shared(s: Slice, answers: pa.Table, buckets: int) -> np.ndarray:
    """What is known of each piece's anchor."""
    known, which = np.unique(s.anchor, return_inverse=True)
    out = np.zeros(len(known), np.uint8)
    kinds, borders = _by_bucket(_bucket(known, buckets))
    place = dict(zip(kinds.tolist(), zip(borders.tolist(), borders[1:].tolist())))
    for bucket, kind in zip(answers["bucket"].to_pylist(), answers["kinds"].to_pylist()):
        if kind is not None:
            x, y = place[bucket]
            out[x:y] = np.frombuffer(kind, np.uint8)
    return out[which]


# --- 3. pieces ----------------------------------------------------------------------------


def _send(s: Slice, shared: np.ndarray, buckets: int) -> pa.Table:
    first, count, keys = s.units(shared)
    contents, which = s.distinct(first, count)
    low = np.full(len(contents), NO_ID)
    np.minimum.at(low, which, s.docs[s.row[first]])
    begin = np.full(len(contents), len(first))
    np.minimum.at(begin, which, np.arange(len(first)))
    kinds, borders = _by_bucket(_bucket(keys[begin], buckets))  # contents are in order of their first units, so of their keys
    pack = zstandard.ZstdCompressor(level=1).compress
    spans = list(zip(borders.tolist(), borders[1:].tolist()))
    return pa.table({
        "bucket": pa.array(kinds, pa.int64()), "slice": pa.array([s.number] * len(kinds), pa.int64()),
        "pieces": pa.array([pack(b"\n".join(contents[x:y])) for x, y in spans], pa.binary()),
        "docs": pa.array([low[x:y].astype("<i8").tobytes() for x, y in spans], pa.binary())})


# --- 4. reference blocks --------------------------------------------------------------------


def longest_earlier(words: np.ndarray, left: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each place, the words from there on that a piece of a smaller document repeats.

    ``left``: words to the piece's end; ``doc``: its document, rising.  Level
    by level of the block's trie: places are grouped by their next words, and
    nodes with one document only are not opened.
    """
    out = np.zeros(len(words), np.int64)
    at, node, level, width = np.arange(len(words)), words.astype(np.int64), 1, int(words.max(initial=0)) + 1
    while len(at):
        order = np.argsort(node, kind="stable")
        at, node = at[order], node[order]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
        d = doc[at]
        low, high = d[starts], d[np.append(starts[1:], len(at)) - 1]  # places of a node are in order of documents
        open_ = (low < high)[group]
        at, group = at[open_], group[open_]
        later = low[group] < doc[at]
        out[at[later]] = level
        more = left[at] > level
        at, group = at[more], group[more]
        node, level = group * width + words[at + level], level + 1
    return out


def parse(longest: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors ``(piece, first, end)`` of pieces, all pieces in step; in order of their first words."""
    piece, at = np.arange(len(first)), first.copy()
    end = first + n
    found = []
    while len(piece):
        to = at + np.maximum(1, longest[at])
        found.append((piece, at, to))
        more = to < end[piece]
        piece, at = piece[more], to[more]
    factors = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
    order = np.argsort(factors[1], kind="stable")
    return tuple(f[order] for f in factors)


def repeated_windows(longest: np.ndarray, factors: tuple, window: int) -> np.ndarray:
    """Whether a duplicate window begins at each place: inside long factors, and over the borders of factors."""
    piece, first, end = factors
    rise = np.zeros(len(longest) + 1, np.int64)
    long = end - first >= window
    np.add.at(rise, first[long], 1)
    np.add.at(rise, end[long] - window + 1, -1)
    out = np.cumsum(rise[:-1]) > 0
    border = np.flatnonzero(piece[1:] == piece[:-1])
    for back in range(1, window):
        at = first[border + 1] - back
        fits = (at >= first[border]) & (at + window <= end[border + 1])
        at = at[fits]
        out[at[longest[at] >= window]] = True
    return out


def _factor(table: pa.Table, window: int) -> pa.Table:
    """For each slice's pieces: the smallest document, and which of its windows smaller documents have (bits)."""
    unpack = zstandard.ZstdDecompressor().decompress
    known: dict[bytes, int] = {}
    codes = [np.array([known.setdefault(p, len(known)) for p in unpack(x.as_py()).split(b"\n")], np.int64) for x in table["pieces"]]
    low = np.full(len(known), NO_ID)
    for code, docs in zip(codes, table["docs"]):
        np.minimum.at(low, code, np.frombuffer(docs.as_py(), "<i8"))
    order = np.argsort(low, kind="stable")
    pieces = list(known)
    pieces = [pieces[i] for i in order.tolist()]
    n = np.array([p.count(b" ") + 1 for p in pieces], np.int64)
    first = np.cumsum(n) - n
    words = pa.array(b" ".join(pieces).split(b" "), pa.binary()).dictionary_encode().indices.to_numpy()
    left = np.repeat(first + n, n) - np.arange(len(words))
    longest = longest_earlier(words, left, np.repeat(np.unique(low[order], return_inverse=True)[1], n))
    repeated = repeated_windows(longest, parse(longest, first, n), window)
    mask = np.zeros(len(pieces), np.uint16)
    for bit in range(SPREAD):
        has = n >= window + bit
        mask[has] |= repeated[first[has] + bit].astype(np.uint16) << np.uint16(bit)
    masks = np.empty_like(mask)
    masks[order] = mask
    return pa.table({
        "slice": table["slice"], "bucket": table["bucket"], "docs": pa.array([low[c].astype("<i8").tobytes() for c in codes], pa.binary()),
        "masks": pa.array([masks[c].astype("<u2").tobytes() for c in codes], pa.binary())})


# --- 5. result ----------------------------------------------------------------------------


def _finish(s: Slice, answers: pa.Table, buckets: int) -> pa.Table:
    """``doc_id, n_words, spans, kept``."""
    first, count, _ = s.units(_shared(s, answers, buckets))
    _, which = s.distinct(first, count)
    told = sorted((b, d, m) for b, d, m in zip(*[answers[c].to_pylist() for c in ("bucket", "docs", "masks")]) if d is not None)
    docs = np.frombuffer(b"".join(d for _, d, _ in told), "<i8")[which] if told else np.zeros(0, np.int64)
    masks = np.frombuffer(b"".join(m for _, _, m in told), "<u2")[which] if told else np.zeros(0, np.uint16)
    every = docs < s.docs[s.row[first]]
    rise = np.zeros(len(s.starts) + 1, np.int64)
    for bit in range(SPREAD):
        hit = (count > bit) & (every | (masks >> np.uint16(bit) & 1).astype(bool))
        np.add.at(rise, first[hit] + bit, 1)
        np.add.at(rise, first[hit] + bit + s.window, -1)
    gone = np.cumsum(rise[:-1]) > 0
    last = np.cumsum(s.n_words)
    spans, kept = [], []
    for line, z, n in zip(s.lines, last.tolist(), s.n_words.tolist()):
        marks = gone[z - n : z]
        if not marks.any():
            spans.append([])
            kept.append(line)
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
        spans.append([{"first": x, "last": y} for x, y in edges.reshape(-1, 2).tolist()])
        words = line.split(b" ")
        whole, at = [], 0
        for x, y in edges.reshape(-1, 2).tolist():
            whole += words[at:x]
            at = y
        kept.append(b" ".join(whole + words[at:]))
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    return pa.table({"doc_id": s.ids, "n_words": pa.array(s.n_words), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per row: ``doc_id, n_words, spans`` of removed words (``first``, ``last`` excluded) and ``kept`` words."""
    gram = max(1, window - SPREAD + 1)
    slices = _slices(df, id_col, text_col)
    total = slices.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(1, total // BLOCK_BYTES)

    def ask(table: pa.Table) -> pa.Table:
        release_memory()  # of the slice before
        return _ask(Slice(table, window, gram), buckets)

    def answer(table: pa.Table) -> pa.Table:
        release_memory()
        return _answer(table)

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        release_memory()
        if not table.num_rows or not answers.num_rows:
            return pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("pieces", pa.binary()), ("docs", pa.binary())]).empty_table()
        s = Slice(table, window, gram)
        return _send(s, _shared(s, answers, buckets), buckets)

    def factor(table: pa.Table) -> pa.Table:
        release_memory()
        return _factor(table, window)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        release_memory()
        return _finish(Slice(table, window, gram), answers, buckets)

    by_slice = lambda d: d.groupBy("slice")
    asked = by_slice(slices).applyInArrow(ask, "bucket long, slice long, anchors binary, counts binary")
    kinds = cut(asked.groupBy("bucket").applyInArrow(answer, "slice long, bucket long, kinds binary"), "anchors")
    sent = by_slice(slices).cogroup(by_slice(kinds)).applyInArrow(send, "bucket long, slice long, pieces binary, docs binary")
    verdicts = cut(sent.groupBy("bucket").applyInArrow(factor, "slice long, bucket long, docs binary, masks binary"), "spans")
    answers = kinds.unionByName(verdicts, allowMissingColumns=True)
    return by_slice(slices).cogroup(by_slice(answers)).applyInArrow(finish, "doc_id long, n_words long, spans array<struct<first:long,last:long>>, kept string")


def report(df: DataFrame, window: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return drop_repeats(df, window=window).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
