"""Exact Jaccard join of word shingles by PartEnum signatures.

A document's set holds the hashes of its distinct k-word shingles.  Sets of
one size band (sizes from 2^j, doubling) are compared over one partition of
the feature domain into n parts; a set near the band's lower border is also
compared over the partition of the band below, for its smaller partners.

Two sets with Jaccard similarity >= t differ in at most
``d = (|a| + |b|) (1 - t) / (1 + t)`` features, and each difference spoils one
part.  Of the subsets of parts, the single parts are enumerated: the content
of a part that is not empty, hashed, is a signature.  A set with m such parts
agrees with a similar set in m - d of them, so under any common order the
first d + 1 signatures of both share one.  The order is: rarest first.  A
signature found in one set only links nothing and need not be sent, and the
parts inside a passage that very many documents share come last.

The steps:

1. ``_texts``: copies (equal word sequences) fold to one row a task; rows go
   to blocks by content.
2. ``_ask``: each block sends its signatures' hashes, packed by bucket;
   ``_count`` tells how many sets hold each.  ``_choose``: each set with
   enough shared signatures keeps its d + 1 rarest (the shared ones of them).
3. ``_links``: in each signature's group the members are checked against one
   centre, and what is linked becomes one component.  Of the groups that then
   hold several components, small ones are checked pair by pair, each by its
   exact similarity; members of large ones are compared in blocks, in memory,
   where pairs are counted and never sent (``_compare_blocks``).
4. Components of all links, then one row for each document.

No set is cut short, no group is dropped and no pair goes unchecked unless its
two sets are linked already.

Null text, empty text and text without words: the empty set, linked with
nothing.  Fewer than k words: the whole sequence is the one shingle.  Null
ids: a row of their own in the result; a component's id is its smallest id.
Repeated rows are copies.  An empty table gives an empty table.  Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.llm.base import cut, pick, release_memory, shuffle_width, texts_by_bytes
from sondage.llm.components import components
from sondage.llm.hashing import hash_stretches, mix

#: Text of one block, and signatures of one bucket, on average.
BLOCK_BYTES, BUCKET_SIGNATURES = 4 << 20, 1 << 20
#: Sets below this size use a part for each feature, so that none can crowd.
SMALL = 128
#: Bytes of a feature in the sets sent to be compared.
FEATURE_BYTES = 6
#: Rounds of stars; members of a signature's group that are compared pair by pair, larger ones in blocks of so many sets.
STARS, FEW, BLOCK_SETS = 1, 32, 256
#: Documents to go that are broadcast at most (some 40 MB).
BROADCAST_ROWS = 400_000


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z only, ASCII white space only


def shingles(line: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of words joined by one space.

    Fewer words: the whole line is the one shingle.
    """
    if not line:
        return np.zeros(0, np.uint64)
    octets = np.frombuffer(line, np.uint8)
    spaces = np.flatnonzero(octets == 32)
    first, last = np.append(0, spaces + 1), np.append(spaces, len(line))
    first, last = (first[: len(first) - k + 1], last[k - 1 :]) if len(first) >= k else (first[:1], last[-1:])
    h = np.sort(hash_stretches(octets, first, last))
    return h[np.append(True, h[1:] != h[:-1])]


class Bands:
    """Which partitions a set of a size uses, and how many differences its links allow."""

    def __init__(self, percent: int):
        self.percent = percent

    def allowed(self, a: int, b: int) -> int:
        """Most differences of linked sets of these sizes: 100 |a & b| >= percent |a | b|."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def instances(self, size: int) -> list[tuple[int, int]]:
        """(band, differences allowed) for a set of ``size``."""
        band = size.bit_length() - 1
        below = (1 << band) - 1  # the largest size of the band below
        partners = [(band, size * 100 // self.percent)] + [(band - 1, below)] * (100 * below >= self.percent * size)
        # where each feature is a part, only those that the other set lacks are spoiled
        own = size - -(-self.percent * size // 100)
        return [(b, self.allowed(size, other) if self.parts(b) else own) for b, other in partners if b >= 0]

    @staticmethod
    def parts(band: int) -> int:
        """Parts of a band's partition; 0: a part for each feature."""
        low = 1 << band
        return 0 if low < SMALL else low + low // 4 if low < 512 else low


def signatures(features: np.ndarray, band: int) -> np.ndarray:
    """One signature for each part that is not empty."""
    n = Bands.parts(band)
    salt = np.uint64(0x9E3779B97F4A7C15 * (band + 1) % 2**64)
    if not n:
        return mix(features ^ salt)
    part = ((features >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)  # rises with the sorted features
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    content = np.add.reduceat(mix(features), starts)
    return mix(content ^ mix(part[starts] ^ salt))


# --- 1. texts ------------------------------------------------------------------


def _key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key``, its word sequence, for ``_text``."""
    passed = [c for c in rows.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in texts_by_bytes(b, "_text"):
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(at, len(texts)) for c in passed], pa.array([_key(words_of(t)) for t in texts], pa.binary())], [*passed, "key"])

    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in passed] + [T.StructField("key", T.BinaryType())]))


def _texts(df: DataFrame, text_col: str, blocks: int) -> DataFrame:
    """``block, key, line``: each word sequence once a task, by block."""
    rows = pick(df, _text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        seen: set[bytes] = set()
        for b in batches:
            for _, texts in texts_by_bytes(b, "_text"):
                out = []
                for t in texts:
                    words = words_of(t)
                    key = _key(words)
                    if words and key not in seen:
                        seen.add(key)
                        out.append((int.from_bytes(key[:8], "big") % blocks, key, b" ".join(words)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["block", "key", "line"])

    return rows.mapInArrow(run, "block long, key binary, line binary").repartition(shuffle_width(df.sparkSession), "block")


# --- 2. signatures ----------------------------------------------------------------


def _sets(table: pa.Table, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """(key, features) of a block's distinct sequences, in the order of their keys."""
    last = None
    keys = table["key"].to_pylist()
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        if keys[i] != last:
            last = keys[i]
            yield last, shingles(table["line"][i].as_py(), k)


def _block_signatures(table: pa.Table, k: int, bands: Bands, buckets: int):
    """(sets, their instances, all signatures, the order by bucket)."""
    sets, parts, all_sigs = [], [], []
    for key, features in _sets(table, k):
        sets.append((key, features))
        for band, allowed in bands.instances(len(features)):
            sig = signatures(features, band)
            if len(sig) <= allowed:
                raise ValueError(f"a set of {len(features)} features fills only {len(sig)} parts of band {band}")
            parts.append((len(sets) - 1, allowed, len(sig)))
            all_sigs.append(sig)
    sigs = np.concatenate(all_sigs) if all_sigs else np.zeros(0, np.uint64)
    bucket = (sigs >> np.uint64(32)) % np.uint64(buckets)
    return sets, parts, sigs, bucket, np.argsort(bucket, kind="stable")


def _counts(texts: DataFrame, k: int, bands: Bands, buckets: int) -> DataFrame:
    """``block, bucket, counts``: in how many sets each of the block's signatures is (255: so many or more)."""

    def ask(table: pa.Table) -> pa.Table:
        release_memory()  # of the block before
        _, _, sigs, bucket, order = _block_signatures(table, k, bands, buckets)
        kinds, starts = np.unique(bucket[order], return_index=True)
        low = (sigs[order] & np.uint64(0xFFFFFFFF)).astype("<u4")
        packs = [x.tobytes() for x in np.split(low, starts[1:])] if len(kinds) else []
        block = table["block"][0].as_py()
        return pa.table({"block": pa.array([block] * len(kinds), pa.int64()), "bucket": pa.array(kinds.astype(np.int64)), "low": pa.array(packs, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        release_memory()  # of the bucket before
        packs = [np.frombuffer(x.as_py(), "<u4") for x in table["low"]]
        _, place, n = np.unique(np.concatenate(packs), return_inverse=True, return_counts=True)
        n = np.minimum(n, 255).astype(np.uint8)[place]
        out = [x.tobytes() for x in np.split(n, np.cumsum([len(p) for p in packs])[:-1])]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "counts": pa.array(out, pa.binary())})

    asked = texts.groupBy("block").applyInArrow(ask, "block long, bucket long, low binary")
    return asked.groupBy("bucket").applyInArrow(count, "block long, bucket long, counts binary")


def _choose(texts: DataFrame, counts: DataFrame, k: int, bands: Bands, buckets: int) -> DataFrame:
    """``key, size, sigs, features`` of every distinct sequence; the last two only where links are possible."""

    def choose(table: pa.Table, replies: pa.Table) -> pa.Table:
        release_memory()  # of the block before
        sets, parts, sigs, _, order = _block_signatures(table, k, bands, buckets)
        found = np.empty(len(sigs), np.uint8)
        answers = sorted(zip(replies["bucket"].to_pylist(), replies["counts"].to_pylist()))
        if len(sigs):
            found[order] = np.frombuffer(b"".join(c for _, c in answers), np.uint8)
        sent: list[list[np.ndarray]] = [[] for _ in sets]
        at = 0
        for owner, allowed, n in parts:
            sig, count = sigs[at : at + n], found[at : at + n]
            at += n
            if (count > 1).sum() >= n - allowed:  # else it shares too few parts with all others together
                first = np.lexsort((sig, count))[: allowed + 1]
                sent[owner].append(sig[first[count[first] > 1]])
        chosen = [np.concatenate(s).view(np.int64) if s else None for s in sent]
        chosen = [c if c is not None and len(c) else None for c in chosen]
        wide = lambda f: f.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - FEATURE_BYTES :].tobytes()
        return pa.table({
            "key": pa.array([x for x, _ in sets], pa.binary()), "size": pa.array([len(f) for _, f in sets], pa.int64()),
            "sigs": pa.array(chosen, pa.list_(pa.int64())),
            "features": pa.array([wide(f) if c is not None else None for (_, f), c in zip(sets, chosen)], pa.binary())})

    return texts.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(choose, "key binary, size long, sigs array<long>, features binary")


# --- 3. pairs -----------------------------------------------------------------------


def _numbers(features: bytes) -> np.ndarray:
    return np.pad(np.frombuffer(features, np.uint8).reshape(-1, FEATURE_BYTES), ((0, 0), (0, 8 - FEATURE_BYTES))).view("<u8").ravel()


def _similar(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b, fa, fb`` whose sets are similar enough, by their exact intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("fa"), b.column("fb")):
                both = np.concatenate([_numbers(x.as_py()), _numbers(y.as_py())])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a binary, b binary")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("key").alias("a"), F.col("features").alias("fa"))
    two = sets.select(F.col("key").alias("b"), F.col("features").alias("fb"))
    return _similar(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "fa", "fb"), percent)


def _near(a: str, b: str, percent: int):
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def block_links(left: list[bytes], right: list[bytes], percent: int) -> np.ndarray:
    """Whether left[i] and right[j] are similar enough, by bit sets over the features that both sides have."""
    sides = [[_numbers(x) for x in side] for side in (left, right)]
    flat = [np.concatenate(side) for side in sides]
    shared = np.intersect1d(*flat)
    bits = []
    for side, every in zip(sides, flat):
        n = np.array([len(x) for x in side])
        row, at = np.repeat(np.arange(len(side)), n), np.minimum(np.searchsorted(shared, every), max(0, len(shared) - 1))
        has = shared[at] == every if len(shared) else np.zeros(len(every), bool)
        words = np.zeros((len(side), len(shared) // 64 + 1), np.uint64)
        np.bitwise_or.at(words, (row[has], at[has] // 64), np.uint64(1) << (at[has] % 64).astype(np.uint64))
        bits.append((n, words))
    (n, a), (m, b) = bits
    same = np.array([np.bitwise_count(x & b).sum(1, dtype=np.int64) for x in a])
    return 100 * same >= percent * (n[:, None] + m[None, :] - same)


def _compare_blocks(crowds: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the members (``key``) of each ``crowd`` that are not linked yet.

    A crowd is dealt into blocks of ``BLOCK_SETS`` on average; a task compares
    two blocks in memory and gives one link for each two components that it
    finds linked.  Pairs are counted there, never sent.
    """
    blocks = crowds.groupBy("crowd").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    placed = (crowds.join(blocks, "crowd").join(labels, "key", "left").join(sets.select("key", "features"), "key")
              .withColumn("label", F.coalesce("label", "key")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")))
    pairs = (placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).select("crowd", "p", "q", "own", "key", "label", "features"))

    def compare(table: pa.Table) -> pa.Table:
        release_memory()  # of the blocks before
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        own = np.array(table["own"])
        sides = [table.filter(pa.array(own == x)) for x in (p, q)]
        keys, labels = ([s[c].to_pylist() for s in sides] for c in ("key", "label"))
        out: dict[tuple, tuple] = {}
        if all(s.num_rows for s in sides):
            hit = block_links(*[s["features"].to_pylist() for s in sides], percent)
            for i, j in np.argwhere(hit).tolist():
                x, y = labels[0][i], labels[1][j]
                if x != y:
                    out.setdefault((min(x, y), max(x, y)), (keys[0][i], keys[1][j]))
        return pa.table({"a": pa.array([a for a, _ in out.values()], pa.binary()), "b": pa.array([b for _, b in out.values()], pa.binary())})

    return pairs.groupBy("crowd", "p", "q").applyInArrow(compare, "a binary, b binary")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between word sequences that join all that are similar."""
    spark = sets.sparkSession
    sets = sets.filter(F.col("sigs").isNotNull())
    holds = cut(sets.select("key", "size", F.explode(F.array_distinct("sigs")).alias("sig")).withColumn("label", F.col("key")), "signatures")
    links = spark.createDataFrame([], "a binary, b binary")
    labels = spark.createDataFrame([], "key binary, label binary")
    for star in range(STARS):
        crowded = holds.groupBy("sig").agg(F.count("*").alias("n"))
        score = holds.join(crowded, "sig").groupBy("key").agg(F.sum("n").alias("score"))  # the set that shares most: often the original
        centres = holds.join(score, "key").groupBy("sig").agg(F.max_by(F.struct("key", "size", "label"), F.struct("score", "key")).alias("_c"))
        pairs = (holds.join(centres, "sig").filter(F.col("label") != F.col("_c.label"))
                 .select(F.col("_c.key").alias("a"), F.col("key").alias("b"), F.col("_c.size").alias("sa"), F.col("size").alias("sb"))
                 .filter(_near("sa", "sb", percent)).groupBy("a", "b").agg(F.count("*").alias("n"))
                 .groupBy("b").agg(F.max_by("a", "n").alias("a")))  # of a member's centres, the one it shares most with
        links = cut(links.union(_verify(pairs, sets, percent)), "links")
        labels = cut(components(links).withColumnRenamed("node", "key"), "components")
        holds = holds.drop("label").join(labels, "key", "left").select("key", "size", "sig", F.coalesce("label", "key").alias("label"))
        groups = holds.groupBy("sig", "label").agg(F.count("*").alias("n")).groupBy("sig").agg(F.count("*").alias("labels"), F.sum("n").alias("members"))
        # a group within one component has no more to tell
        holds = cut(holds.drop("members").join(groups.filter("labels > 1").select("sig", "members"), "sig"), "signatures")
    few = holds.filter(F.col("members") <= FEW)
    one = few.select("sig", F.col("key").alias("a"), F.col("size").alias("sa"), F.col("label").alias("la"))
    two = few.select("sig", F.col("key").alias("b"), F.col("size").alias("sb"), F.col("label").alias("lb"))
    left = one.join(two, "sig").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _near("sa", "sb", percent)).select("a", "b").distinct()
    many = holds.filter(F.col("members") > FEW)
    hubs = many.groupBy("sig").agg(F.min("key").alias("a"))
    crowds = cut(components(many.join(hubs, "sig").select("a", F.col("key").alias("b")).distinct()).select("node", F.col("label").alias("crowd")), "crowds")
    found = _compare_blocks(crowds.withColumnRenamed("node", "key"), labels, sets, percent)
    return cut(links.union(_verify(left, sets, percent)).union(found), "links")


# --- 4. result -----------------------------------------------------------------------


def _classes(df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key`` of each document, and ``key, n_shingles, component_id`` of each word sequence."""
    bands = Bands(percent)
    total = df.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    blocks = max(1, total // BLOCK_BYTES)
    buckets = max(1, total // 8 // BUCKET_SIGNATURES)
    texts = _texts(df, text_col, blocks)
    sets = cut(_choose(texts, _counts(texts, k, bands, buckets), k, bands, buckets), "sets")
    labels = components(_links(sets, percent))
    members = cut(_keyed(pick(df, doc_id=id_col, _text=text_col)), "members")
    classes = (members.groupBy("key").agg(F.min("doc_id").alias("first"))
               .join(sets.select("key", "size"), "key", "left")
               .join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")))
    smallest = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    return members, classes.join(smallest, "label").select("key", F.coalesce("size", F.lit(0).cast("long")).alias("n_shingles"), "component_id")


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    members, classes = _classes(df, id_col, text_col, k, percent)
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return members.join(classes, "key").select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """Of each component the document with the smallest id, with all its columns; of repeated rows, one.

    The documents to go are joined by id and word sequence: as a broadcast
    while they are few, by a shuffle beyond ``BROADCAST_ROWS``.
    """
    members, classes = _classes(df, id_col, text_col, k, percent)
    found = members.groupBy("doc_id", "key").agg(F.count("*").alias("n")).join(classes.filter("n_shingles > 0"), "key")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    marked = cut(found.filter(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), stays.alias("_stays")), "marked")
    few = marked.count() <= BROADCAST_ROWS
    if members.groupBy("doc_id").count().filter("count > 1").isEmpty():  # the id alone tells a row: texts need not be read as words again
        ids = marked.select("_id")
        return df.join(F.broadcast(ids) if few else ids, df[id_col].eqNullSafe(ids["_id"]), "left_anti")
    rows = _keyed(df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), df[id_col].alias("doc_id"), df[text_col].alias("_text")))
    same = rows["doc_id"].eqNullSafe(marked["_id"]) & (rows["key"] == marked["_key"])
    out = rows.join(F.broadcast(marked) if few else marked, same, "left")
    once = out.filter("_stays is null").select("_row.*")
    return once.unionByName(out.filter("_stays").dropDuplicates(["doc_id", "key"]).select("_row.*"))
