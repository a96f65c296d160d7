"""Language-model scores by a hierarchical Pitman-Yor model.

Every context has a Chinese restaurant whose customers are the training
tokens that follow it; its tables are customers of the root restaurant, which
all contexts share, and whose base is uniform over the vocabulary and one
unknown word.  A context is the word before, or the beginning of a text, so
contexts grow with the vocabulary.  If ``classes`` is given, it is the class
of the word before instead: its ending, hashed to ``classes`` - 1 classes.

Seating is sampled: customers sit down one after the other (in batches that
double), then Gibbs steps take a random customer of every (context, word) up
and seat it anew.  Given the restaurants' totals the (context, word) pairs are
independent, so each task seats its own pairs; after each sweep the totals are
added up for the next one, by the tasks that own a range of word hashes (with
``classes``, which are few, at the driver).  ``burn`` sweeps come
first; the predictive probabilities of the next ``samples`` are averaged.
Discounts come from the counts of ones and twos of each level.

Of the customers of one (context, word), the first ``SEATED`` are seated one
by one; later ones matter through the number of tables they open, drawn in
batches that grow by a tenth.  So a very common word takes bounded memory.

Texts are read once, into blocks of numbered words, where they lie.  A block
sends each of its (word, context) with its count to buckets of pairs by a hash
of both, so that a common word's pairs lie in all of them.  A bucket adds the
counts up and notes which of its pairs each block has; by these notes it
answers in the end.  A block asks each owner for all its words, and scores its
documents with the answers.  Hashes move as the steps between them, numbers in
as many bytes as they need, both compressed; tables on the way go when they are
spent.  With ``classes``, tasks send counts to word buckets, and documents lie
in blocks by hash, which ask each bucket for all their pairs.

Null text: empty, its end token only.  Null ids are held out.  Repeated rows
count and score each.  An empty table gives an empty table; with no training
text every word is unknown.  Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.base import cut, pick, release_memory, shuffle_width, texts_by_bytes
from sondage.llm.hashing import hash_stretches, mix
from sondage.operators.store import _hadoop

BLOCK_BYTES = 16 << 20
SEATED = 128
#: Tokens that a counting task holds before it sends their counts on.
HELD = 8_000_000
END = np.uint64(0)  # the end token's identity; words hash elsewhere
#: Bytes between words.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def is_held_out(doc_id: object) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


class Tokens:
    """Identity of each token of the texts given so far, and its context if that is a class."""

    def __init__(self, classes: int | None):
        self.classes, self.held = classes, 0
        self.words: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []

    def add(self, texts: list[bytes]) -> np.ndarray:
        """Adds the texts' tokens; how many of each."""
        if not texts:
            return np.zeros(0, np.int64)
        octets = np.frombuffer(b"\n".join(texts).lower(), np.uint8)  # bytes: A-Z only
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        edge = np.diff(np.concatenate([[1], BLANK[octets], [1]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        word = np.maximum(hash_stretches(octets, first, last), np.uint64(1))
        counts = np.bincount(np.searchsorted(begins, first, "right") - 1, minlength=len(texts))
        ends = np.cumsum(counts)
        self.words.append(np.insert(word, ends, END))
        self.held += len(self.words[-1])
        if self.classes is None:  # the token before is the context
            return counts + 1
        # a word's class as a context is its ending
        end = octets[last - 1].astype(np.int64) * 31 + np.where(last - first > 1, octets[last - 2], 0) if len(last) else last
        kind = 1 + end % (self.classes - 1)
        kind = np.insert(kind, ends, 0)  # after an end token comes a beginning
        self.contexts.append(np.append(0, kind[:-1]).astype(np.uint8))
        return counts + 1


@dataclass
class Pairs:
    """Distinct (word, context) in the order of words and contexts, with their counts.

    Buckets are ranges of word hashes, so this is the order of buckets too.
    """

    bucket: np.ndarray  # of each word
    word: np.ndarray  # hashes
    start: np.ndarray  # of each word's pairs
    context: np.ndarray
    count: np.ndarray
    place: np.ndarray  # of each token's pair

    @staticmethod
    def of(tokens: Tokens, buckets: int) -> Pairs:
        every = np.concatenate(tokens.words) if tokens.words else np.zeros(0, np.uint64)
        contexts = np.concatenate(tokens.contexts) if tokens.contexts else np.zeros(0, np.uint8)
        words, number = np.unique(every, return_inverse=True)
        pair, place, count = np.unique(number * 256 + contexts, return_inverse=True, return_counts=True)
        start = np.searchsorted(pair, np.arange(len(words)) * 256)
        bucket = ((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        return Pairs(bucket.astype(np.int64), words, start, (pair % 256).astype(np.uint8), count, place)

    def packed(self) -> Iterator[dict]:
        """A row for each bucket."""
        kinds, first = np.unique(self.bucket, return_index=True)
        ends = np.append(self.start, len(self.context))
        for bucket, a, b in zip(kinds.tolist(), first.tolist(), [*first[1:].tolist(), len(self.word)]):
            p, q = int(ends[a]), int(ends[b])
            yield {"bucket": bucket, "words": self.word[a:b].astype("<u8").tobytes(), "sizes": np.diff(ends[a : b + 1]).astype("<u2").tobytes(),
                   "contexts": self.context[p:q].tobytes(), "counts": self.count[p:q].astype("<i8").tobytes()}


PACK = {"bucket": pa.int64(), "words": pa.binary(), "sizes": pa.binary(), "contexts": pa.binary(), "counts": pa.binary()}
PACK_SQL = "bucket long, words binary, sizes binary, contexts binary, counts binary"


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, pairs of each, contexts, counts)."""
    return (np.frombuffer(row["words"], "<u8"), np.frombuffer(row["sizes"], "<u2").astype(np.int64),
            np.frombuffer(row["contexts"], np.uint8), np.frombuffer(row["counts"], "<i8"))


# --- counting ----------------------------------------------------------------------


def count_pairs(df: DataFrame, classes: int, buckets: int) -> DataFrame:
    """One row per bucket of words: its packed (word, context) counts in the training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(classes)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(list(Pairs.of(tokens, buckets).packed()), pa.schema(PACK))

        for b in batches:
            for at, texts in texts_by_bytes(b, "_text", 1 << 20):
                keys = b.column("doc_id").slice(at, len(texts)).to_pylist()
                tokens.add([t for key, t in zip(keys, texts) if not is_held_out(key)])
                if tokens.held > HELD:
                    yield rows()
                    tokens = Tokens(classes)
        if tokens.held:
            yield rows()

    def merge(table: pa.Table) -> pa.Table:
        parts = [_unpack(r) for r in table.select(["words", "sizes", "contexts", "counts"]).to_pylist()]
        word = np.concatenate([np.repeat(w, n) for w, n, _, _ in parts])
        context, count = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        order = np.lexsort((context, word))
        word, context, count = word[order], context[order], count[order]
        new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (context[1:] != context[:-1])))
        count, word, context = np.add.reduceat(count, new), word[new], context[new]
        words, sizes = np.unique(word, return_counts=True)
        row = {"bucket": table["bucket"][0].as_py(), "words": words.astype("<u8").tobytes(), "sizes": sizes.astype("<u2").tobytes(),
               "contexts": context.tobytes(), "counts": count.astype("<i8").tobytes()}
        return pa.Table.from_pylist([row], pa.schema(PACK))

    return df.mapInArrow(count, PACK_SQL).groupBy("bucket").applyInArrow(merge, PACK_SQL)


# --- seating -----------------------------------------------------------------------


def seat(count: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator, steps: int) -> np.ndarray:
    """Tables of each dish: ``count`` customers, ``weight`` of a new table."""
    pairs, seated = len(count), np.minimum(count, SEATED)
    off = np.append(0, np.cumsum(seated))
    n = int(off[-1])
    pair = np.repeat(np.arange(pairs), seated)
    rank = np.arange(n) - off[pair]
    table, size = np.arange(n), np.zeros(n + steps * pairs, np.int64)
    size[off[:-1]] = 1
    tables = np.ones(pairs, np.int64)
    level = np.frexp(np.maximum(rank, 0.5))[1]  # rank 0: 0; 1: 1; 2-3: 2; 4-7: 3; ...
    order = np.argsort(level, kind="stable")
    for idx in np.split(order, np.flatnonzero(np.diff(level[order])) + 1)[1:] if n else []:
        p, before = pair[idx], 1 << int(level[idx[0]] - 1)
        new = rng.random(len(idx)) * (before - discount * tables[p] + weight[p]) < weight[p]
        own = idx[new]
        rest, chosen = idx[~new], np.empty(int((~new).sum()), np.int64)
        todo = np.arange(len(rest))
        while len(todo):  # a table by its size less the discount
            t = table[off[pair[rest[todo]]] + (rng.random(len(todo)) * before).astype(np.int64)]
            ok = rng.random(len(todo)) * size[t] < size[t] - discount
            chosen[todo[ok]] = t[ok]
            todo = todo[~ok]
        table[rest] = chosen
        np.add.at(size, chosen, 1)
        size[own] += 1
        tables += np.bincount(pair[own], minlength=pairs)
    big = np.flatnonzero(count > seated)
    now = seated[big].copy()
    while len(big):
        more = np.minimum(count[big] - now, np.maximum(1, now // 10))
        tables[big] += rng.binomial(more, weight[big] / (now - discount * tables[big] + weight[big]))
        now += more
        left = now < count[big]
        big, now = big[left], now[left]
    live = np.flatnonzero(count > 1)
    for step in range(steps if len(live) else 0):
        shift = (rng.random(len(live)) * seated[live]).astype(np.int64)
        who = off[live] + shift
        size[table[who]] -= 1
        tables[live] -= size[table[who]] == 0
        new = rng.random(len(live)) * (count[live] - 1 - discount * tables[live] + weight[live]) < weight[live]
        fresh = n + step * pairs + live[new]
        table[who[new]], size[fresh] = fresh, 1
        tables[live[new]] += 1
        todo = np.flatnonzero(~new)
        while len(todo):
            p = live[todo]
            other = off[p] + (shift[todo] + 1 + (rng.random(len(todo)) * (seated[p] - 1)).astype(np.int64)) % seated[p]
            t = table[other]
            ok = rng.random(len(todo)) * size[t] < size[t] - discount
            table[who[todo[ok]]] = t[ok]
            np.add.at(size, t[ok], 1)
            todo = todo[~ok]
    return tables


@dataclass(frozen=True)
class Totals:
    """Customers and tables of each context's restaurant, and of the root."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: int
    root_tables: int


@dataclass(frozen=True)
class Model:
    vocabulary: int
    tokens: int
    discount: float
    root_discount: float
    strength: float = 1.0
    steps: int = 8


def _root(model: Model, totals: Totals, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Root probability of words with so many customers and tables there; zeros: an unknown word."""
    rest = (model.strength + model.root_discount * totals.root_tables) / (model.vocabulary + 1)
    return (customers - model.root_discount * tables + rest) / (model.strength + totals.root_customers)


def sweep(model: Model, totals: Totals, sizes: np.ndarray, contexts: np.ndarray, counts: np.ndarray, seed: tuple[int, int]):
    """(tables of each pair, root customers and root tables of each word) of a bucket's words."""
    rng = np.random.default_rng(seed)
    word = np.repeat(np.arange(len(sizes)), sizes)
    base = np.full(len(sizes), (model.strength + model.root_discount * totals.root_tables) / (model.vocabulary + 1))
    about = _root(model, totals, sizes, np.ones(len(sizes)))  # a table in each context, one at the root
    open_weight = model.strength + model.discount * totals.tables[contexts]
    tables = seat(counts, open_weight * about[word], model.discount, rng, model.steps)
    root_customers = np.bincount(word, tables, len(sizes)).astype(np.int64)
    return tables, root_customers, seat(root_customers, base, model.root_discount, rng, model.steps)


def _by_context(contexts: np.ndarray, values: np.ndarray, classes: int) -> list[int]:
    return np.bincount(contexts, values, classes).astype(np.int64).tolist()


def _add_up(packs: DataFrame, measure, names: list[str]) -> list[dict]:
    """Sums of a measure's rows by context; ``classes`` + 1 rows reach the driver, whatever the input."""
    schema = pa.schema([("context", pa.int64()), *[(n, pa.int64()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in measure(b.slice(k, 1).to_pylist()[0])], schema=schema)

    rows = packs.mapInArrow(run, ", ".join(f"{n} long" for n in schema.names)).groupBy("context")
    return sorted((r.asDict() for r in rows.agg(*[F.sum(n).alias(n) for n in names]).collect()), key=lambda r: r["context"])


def train(packs: DataFrame, classes: int, burn: int, samples: int, seed: int) -> tuple[Model, list[Totals], list[Totals]]:
    """(model, the totals before each sample, those after it)."""

    def counts(row: dict):
        _, sizes, contexts, n = _unpack(row)
        whole = np.add.reduceat(n, np.append(0, np.cumsum(sizes)[:-1]))
        per = [_by_context(contexts, v, classes) for v in (n, n > 0, n == 1, n == 2)]
        return [[*range(classes), classes], [*per[0], int(whole.sum())], [*per[1], len(sizes)], [*per[2], int((sizes == 1).sum())], [*per[3], int((sizes == 2).sum())]]

    got = _add_up(packs, counts, ["customers", "kinds", "ones", "twos"])
    rows, root = got[:-1], got[-1] if got else {"customers": 0, "kinds": 0, "ones": 0, "twos": 0}
    share = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b) if a else 0.5))
    model = Model(root["kinds"], root["customers"], share(sum(r["ones"] for r in rows), sum(r["twos"] for r in rows)), share(root["ones"], root["twos"]))
    customers = np.array([r["customers"] for r in rows] or [0] * classes, np.int64)
    kinds = np.array([r["kinds"] for r in rows] or [0] * classes, np.int64)
    totals = [Totals(customers, kinds, int(kinds.sum()), root["kinds"])]
    for turn in range(burn + samples if got else 0):
        last = totals[-1]

        def seating(row: dict, last=last, turn=turn):
            _, sizes, contexts, n = _unpack(row)
            tables, rc, rt = sweep(model, last, sizes, contexts, n, (seed + turn, row["bucket"]))
            return [[*range(classes), classes], [*_by_context(contexts, tables, classes), int(rt.sum())], [0] * classes + [int(rc.sum())]]

        got = _add_up(packs, seating, ["tables", "root_customers"])
        totals.append(Totals(customers, np.array([r["tables"] for r in got[:-1]], np.int64), got[-1]["root_customers"], got[-1]["tables"]))
    return model, totals[burn:-1] or totals[:1], totals[burn + 1 :] or totals[:1]


# --- scoring -----------------------------------------------------------------------


def predict(model: Model, before: list[Totals], after: list[Totals], burn: int, seed: int, bucket: int, trained: dict | None,
            asked: list[dict]) -> list[tuple[bytes, bytes]]:
    """For each request (words, contexts of each): counts of the words, log10 probabilities of the pairs."""
    if trained is None:
        words, sizes, contexts, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    else:
        words, sizes, contexts, counts = _unpack(trained)
    first = np.append(0, np.cumsum(sizes))
    whole = np.add.reduceat(counts, first[:-1]) if len(words) else counts
    known = np.repeat(np.arange(len(words)), sizes) * 256 + contexts
    seatings = [sweep(model, t, sizes, contexts, counts, (seed + burn + k, bucket)) if len(words) else None for k, t in enumerate(before)]
    out = []
    for r in asked:
        w, n, c, _ = _unpack(r)
        at = np.minimum(np.searchsorted(words, w), max(0, len(words) - 1))
        has = words[at] == w if len(words) else np.zeros(len(w), bool)
        word, in_word = np.repeat(at, n), np.repeat(has, n)
        code = word * 256 + c
        pair = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
        seen = in_word & (known[pair] == code) if len(known) else np.zeros(len(c), bool)
        total = np.zeros(len(c))
        for t, seating in zip(after, seatings):
            root = np.full(len(c), _root(model, t, 0, 0))
            own = np.zeros(len(c))
            if seating is not None:
                tables, rc, rt = seating
                root[in_word] = _root(model, t, rc, rt)[word[in_word]]
                own[seen] = (counts - model.discount * tables)[pair[seen]]
            total += (own + (model.strength + model.discount * t.tables[c]) * root) / (model.strength + t.customers[c])
        freq = np.where(has, whole[at], 0) if len(words) else np.zeros(len(w), np.int64)
        out.append((freq.astype("<i8").tobytes(), np.log10(total / len(after)).astype("<f4").tobytes()))
    return out


# --- whole words as contexts --------------------------------------------------------

#: One shape for all that moves: packs, messages, replies, states, seatings, notes, questions and answers.
ROW = pa.schema([("bucket", pa.int64()), ("kind", pa.string()), ("peer", pa.int64()), ("data", pa.list_(pa.binary())), ("numbers", pa.list_(pa.int64()))])
ROW_SQL = "bucket long, kind string, peer long, data array<binary>, numbers array<long>"
#: A block of texts: hashes of its words, the number of each token's word, tokens of each text, their ids (an Arrow stream).
TEXTS_SQL = "names binary, tokens binary, sizes binary, ids binary"
TEXTS = pa.schema([(n, pa.binary()) for n in ("names", "tokens", "sizes", "ids")])
ZSTD = pa.Codec("zstd", compression_level=1)


def _row(bucket: int, kind: str, peer: int, data: list[bytes], numbers: list[int] | None = None) -> dict:
    return {"bucket": int(bucket), "kind": kind, "peer": int(peer), "data": data, "numbers": numbers or []}


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the largest needs, first bytes first, compressed."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    octets = np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + ZSTD.compress(octets, asbytes=True)


def _wide(octets: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        width = octets[0]
        out[:, :width] = np.frombuffer(ZSTD.decompress(octets[1:], width * n, asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<i8").reshape(n)


def _sized(numbers: np.ndarray) -> bytes:
    """``_narrow`` with the length before."""
    return len(numbers).to_bytes(8, "little") + _narrow(numbers)


def _unsized(octets: bytes) -> np.ndarray:
    return _wide(octets[8:], int.from_bytes(octets[:8], "little"))


def _steps(names: np.ndarray) -> bytes:
    """Rising hashes as the steps between them."""
    return _sized(np.diff(names, prepend=np.uint64(0)))


def _names(octets: bytes) -> np.ndarray:
    return np.cumsum(_unsized(octets).view(np.uint64), dtype=np.uint64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    coded = pa.array(values).dictionary_encode()
    kinds = coded.dictionary.to_numpy()
    order = np.argsort(kinds)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return kinds[order], rank[coded.indices.to_numpy()]


def _hashes(octets: bytes) -> np.ndarray:
    return np.frombuffer(octets, "<u8")


def _range(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _pair_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Identity of pairs; by its ranges, pairs of one common word, or after one, lie in all buckets."""
    return mix(word ^ mix(context + np.uint64(1)))


def _runs(sorted_buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    kinds, first = np.unique(sorted_buckets, return_index=True)
    yield from zip(kinds.tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_buckets)])


@dataclass
class WordPairs:
    """Distinct words of texts, and distinct (word, word before) in the order of pair buckets, words and contexts."""

    words: np.ndarray  # hashes
    word: np.ndarray  # numbers in ``words``, of each pair
    context: np.ndarray
    key: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    number: np.ndarray  # of each token's word
    place: np.ndarray  # of each token's pair

    @staticmethod
    def of(words: np.ndarray, number: np.ndarray, counted: np.ndarray, buckets: int) -> WordPairs:
        """Of tokens by the number of their word; ``counted``: those that count."""
        before = np.concatenate([np.zeros(1, np.int64), number[:-1]])[: len(number)]  # END comes first in ``words``, and before every text
        pair, place = _distinct(number * len(words) + before)
        word, context = np.divmod(pair, max(1, len(words)))
        key = _pair_key(words[word], words[context])
        bucket = _range(key, buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[place]
        return WordPairs(words, word[order], context[order], key[order], bucket[order], np.bincount(place, counted, len(pair)).astype(np.int64), number, place)

    def packed(self, block: int) -> Iterator[dict]:
        """A row of counts for each pair bucket."""
        for bucket, a, b in _runs(self.bucket):
            yield _row(bucket, "count", block, _pack(self.words, self.word[a:b], self.context[a:b], self.count[a:b]))

    def questions(self, block: int, buckets: int) -> Iterator[dict]:
        """A row for each owner of words and for each pair bucket."""
        yield from _sent(self.words, [], "ask words", block, buckets, [])
        for bucket, a, b in _runs(self.bucket):
            yield _row(bucket, "ask pairs", block, [self.key[a:b].astype("<u8").tobytes()])


def _pack(names: np.ndarray, word: np.ndarray, context: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Pairs of numbers in ``names`` in the order of words: the names they use, the pairs of each, contexts and counts."""
    used, at = _distinct(np.concatenate([word, context]))
    return [_steps(names[used]), _narrow(np.bincount(at[: len(word)], minlength=len(used))), _sized(at[len(word) :]), _narrow(count)]


def _pairs(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, number of each pair's word, of its context, count)."""
    names, context = _names(data[0]), _unsized(data[2])
    word = np.repeat(np.arange(len(names)), _wide(data[1], len(names)))
    return names, word, context, _wide(data[3], len(context))


def _gather(df: DataFrame, work) -> DataFrame:
    """``work`` on the rows of each bucket."""
    return df.groupBy("bucket").applyInArrow(lambda t: pa.Table.from_pylist(list(work(t.to_pylist())), ROW), ROW_SQL)


def _cut(df: DataFrame, name: str) -> DataFrame:
    """``cut``; the shuffle files behind the table go as soon as it is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return cut(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _drop(*tables: DataFrame) -> None:
    """Removes tables that ``cut`` wrote, once all that reads them is written itself."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:  # encoded as in a URL
            fs, path = _hadoop(t.sparkSession, unquote(folder))
            fs.delete(path, True)


def number_texts(df: DataFrame) -> DataFrame:
    """A row for each block of texts, made where they lie."""
    limit = BLOCK_BYTES

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sizes, ids, held = Tokens(None), [], [], 0

        def block() -> pa.RecordBatch:
            words, place = _distinct(np.concatenate(tokens.words))
            out = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays(ids)], ["doc_id"])
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch)
            row = [_steps(words), _sized(place), _sized(np.concatenate(sizes)), out.getvalue().to_pybytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], schema=TEXTS)

        for b in batches:
            for at, texts in texts_by_bytes(b, "_text", min(limit, 1 << 20)):
                sizes.append(tokens.add(texts))
                ids.append(b.column("doc_id").slice(at, len(texts)))
                held += sum(map(len, texts))
                if held >= limit:
                    yield block()
                    tokens, sizes, ids, held = Tokens(None), [], [], 0
                    release_memory()
        if ids:
            yield block()

    return df.mapInArrow(number, TEXTS_SQL).withColumn("block", F.monotonically_increasing_id())


def _ids(row: dict) -> pa.Table:
    return pa.ipc.open_stream(row["ids"]).read_all()


def _block_pairs(row: dict, buckets: int) -> tuple[WordPairs, np.ndarray]:
    """Pairs of a block, counted in its training documents, and tokens of each document."""
    sizes = _unsized(row["sizes"])
    training = np.array([not is_held_out(x) for x in _ids(row)["doc_id"].to_pylist()])
    return WordPairs.of(_names(row["names"]), _unsized(row["tokens"]), np.repeat(training, sizes), buckets), sizes


def _mapped(work):
    """``work`` on each row."""
    return lambda batches: (
        pa.RecordBatch.from_pylist([x for r in b.slice(k, 1).to_pylist() for x in work(r)], ROW) for b in batches for k in range(b.num_rows))


def count_blocks(blocks: DataFrame, buckets: int) -> DataFrame:
    """For each pair bucket the packed counts of its pairs in training documents, the counts alone, and which pairs each block has."""

    def merge(rows: list[dict]) -> Iterator[dict]:
        bucket, parts = rows[0]["bucket"], [_pairs(r["data"]) for r in rows]
        names, at = _distinct(np.concatenate([p[0] for p in parts]))
        ends = np.cumsum([0, *(len(p[0]) for p in parts)])
        code = [at[a + p[1]] * len(names) + at[a + p[2]] for a, p in zip(ends, parts)]
        pair, place = _distinct(np.concatenate(code))
        n = np.bincount(place, np.concatenate([p[3] for p in parts]), len(pair)).astype(np.int64)
        known = n > 0
        rank = np.cumsum(known) - 1
        if known.any():
            yield _row(bucket, "pack", 0, _pack(names, *np.divmod(pair[known], len(names)), n[known]))
            yield _row(bucket, "counts", 0, [_sized(n[known])])
        first = np.cumsum([0, *map(len, code)])
        for r, a, b in zip(rows, first, first[1:]):
            mine = place[a:b]  # rising
            has = known[mine]
            yield _row(bucket, "has", r["peer"], [np.packbits(has).tobytes(), _sized(np.diff(rank[mine[has]], prepend=0))], [b - a])

    def count(row: dict) -> Iterator[dict]:
        release_memory()  # of the block before
        yield from _block_pairs(row, buckets)[0].packed(row["block"])

    return _gather(blocks.mapInArrow(_mapped(count), ROW_SQL), merge)


def count_words(df: DataFrame, buckets: int) -> DataFrame:
    """One row per pair bucket: its (word, word before) counts in the training documents."""
    return count_blocks(number_texts(df), buckets).filter("kind = 'pack'")


def _sent(names: np.ndarray, values: list[np.ndarray], kind: str, peer: int, buckets: int, numbers: list[int]) -> Iterator[dict]:
    """Rows to the owners of words; the first carries the numbers."""
    for k, (owner, a, b) in enumerate(_runs(_range(names, buckets))):
        yield _row(owner, kind, peer, [_steps(names[a:b]), *(_narrow(v[a:b]) for v in values)], [] if k else numbers)


def _first(df: DataFrame, kind: str, n: int) -> list[int]:
    """Sums of the first ``n`` numbers of the rows of a kind."""
    rows = df.filter((F.col("kind") == kind) & (F.size("numbers") > 0))
    return [x or 0 for x in rows.agg(*[F.sum(F.col("numbers")[k]) for k in range(n)]).first()]


def train_words(packs: DataFrame, buckets: int, burn: int, samples: int, seed: int) -> tuple[Model, list[tuple[int, int]], DataFrame | None]:
    """(model, customers and tables of the root in each sample, rows of the samples' seatings and states).

    Pairs lie in pair buckets, words in ranges of hashes that own them.  A
    sweep seats the pairs; each bucket sends the tables that its pairs have
    beyond one to the owners of both words, which add them up (of the word as
    a dish: customers of the root; as a context: tables of its restaurant),
    seat the root, and reply.  A pair that occurs once has one table, so only
    the others are sent and replied to.
    """

    def tell(r: dict) -> Iterator[dict]:
        """Of each word: its occurrences, contexts, and words after it."""
        names, word, context, n = _pairs(r["data"])
        sums = [np.bincount(x, v, len(names)).astype(np.int64) for x, v in ((word, n), (word, None), (context, None))]
        yield from _sent(names, sums, "base", r["bucket"], buckets,
                         [int((n == 1).sum()), int((n == 2).sum())])

    def own(rows: list[dict]) -> Iterator[dict]:
        told = [_names(r["data"][0]) for r in rows]
        names, place = _distinct(np.concatenate(told))
        sums, ends = np.zeros((3, len(names)), np.int64), np.cumsum([0, *map(len, told)])
        for r, a, b in zip(rows, ends, ends[1:]):
            for k in range(3):
                sums[k, place[a:b]] += _wide(r["data"][1 + k], b - a)
        one, two = (sum(r["numbers"][k] for r in rows if r["numbers"]) for k in range(2))
        yield _row(rows[0]["bucket"], "base", 0, [names.astype("<u8").tobytes(), *map(_narrow, sums)],
                   [int(sums[0].sum()), len(names), one, two, int((sums[1] == 1).sum()), int((sums[1] == 2).sum()), int(sums[1].sum())])

    base = _cut(_gather(packs.mapInArrow(_mapped(tell), ROW_SQL), own), "words")
    n, kinds, ones, twos, root_ones, root_twos, pairs = _first(base, "base", 7)
    share = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b) if a else 0.5))
    model = Model(kinds, n, share(ones, twos), share(root_ones, root_twos))
    if not n:
        return model, [(0, 0)], None

    def repeated(r: dict) -> Iterator[dict]:
        names, word, context, n = _pairs(r["data"])
        yield _row(r["bucket"], "pack", 0, _pack(names, word[n > 1], context[n > 1], n[n > 1]))

    def several(names: np.ndarray, word: np.ndarray, context: np.ndarray, tables: np.ndarray, bucket: int) -> Iterator[dict]:
        sums = [np.bincount(x, tables - 1, len(names)).astype(np.int64) for x in (word, context)]
        yield from _sent(names, sums, "message", bucket, buckets, [])

    def begin(r: dict) -> Iterator[dict]:
        names, word, context, n = _pairs(r["data"])
        yield from several(names, word, context, np.ones(len(n), np.int64), r["bucket"])

    def state(turn: int, root_tables: int):
        def work(rows: list[dict]) -> Iterator[dict]:
            base = next(r for r in rows if r["kind"] == "base")
            names = _hashes(base["data"][0])
            customers, tables = (_wide(base["data"][k], len(names)) for k in (2, 3))
            asked = [(r["peer"], np.searchsorted(names, h := _names(r["data"][0])), *(_wide(x, len(h)) for x in r["data"][1:])) for r in rows if r["kind"] == "message"]
            for _, at, dish, context in asked:
                customers[at] += dish
                tables[at] += context
            weight = np.full(len(names), (model.strength + model.root_discount * root_tables) / (model.vocabulary + 1))
            root = seat(customers, weight, model.root_discount, np.random.default_rng((seed + turn, base["bucket"], 0)), model.steps)
            yield _row(base["bucket"], "state", turn, [_narrow(customers), _narrow(root), _narrow(tables)], [int(customers.sum()), int(root.sum())])
            for peer, at, _, _ in asked:
                yield _row(peer, "reply", base["bucket"], [_narrow(x[at]) for x in (customers, root, tables)], [len(at)])
        return work

    def seating(turn: int, total: tuple[int, int]):
        def work(rows: list[dict]) -> Iterator[dict]:
            pack = next(r for r in rows if r["kind"] == "pack")
            names, word, context, n = _pairs(pack["data"])
            replies = sorted((r for r in rows if r["kind"] == "reply"), key=lambda r: r["peer"])
            customers, root, tables = (np.concatenate([np.zeros(0, np.int64), *(_wide(r["data"][k], r["numbers"][0]) for r in replies)]) for k in range(3))
            about = _root(model, Totals(None, None, *total), customers, root)[word]
            weight = (model.strength + model.discount * tables[context]) * about
            got = seat(n, weight, model.discount, np.random.default_rng((seed + turn, pack["bucket"], 1)), model.steps)
            yield _row(pack["bucket"], "seats", turn + 1, [_narrow(got)])
            yield from several(names, word, context, got, pack["bucket"])
        return work

    packs = _cut(packs.mapInArrow(_mapped(repeated), ROW_SQL), "repeated")
    seated, root_tables, totals, kept = packs.mapInArrow(_mapped(begin), ROW_SQL), kinds, [], []
    spent = []
    for turn in range(burn + samples + 1):
        owned = _cut(_gather(base.unionByName(seated.filter("kind = 'message'")), state(turn, root_tables)), "states")
        totals.append(tuple(_first(owned, "state", 2)))
        root_tables = totals[-1][1]
        if turn > burn:
            kept += [owned.filter("kind = 'state'"), seated.filter("kind = 'seats'")]
        else:
            spent += [owned, *([seated] if turn else [])]
        if turn < burn + samples:
            seated = _cut(_gather(packs.unionByName(owned.filter("kind = 'reply'")), seating(turn, totals[-1])), "seats")
    _drop(packs, *spent)
    rows = base
    for k in kept:
        rows = rows.unionByName(k)
    return model, totals[burn + 1 :], rows


def _answer_words(rows: list[dict], samples: int) -> Iterator[dict]:
    """For each question: occurrences of its words, and in each sample root customers, root tables and tables after them."""
    base = next((r for r in rows if r["kind"] == "base"), None)
    names = _hashes(base["data"][0]) if base else np.zeros(0, np.uint64)
    states = [r["data"] for r in sorted((r for r in rows if r["kind"] == "state"), key=lambda r: r["peer"])]
    columns = [_wide(x, len(names)) for x in ([base["data"][1], *(x for s in states for x in s)] if base else [b""] * (1 + 3 * samples))]
    yield from _look_up(rows, "ask words", "words", names, columns)


def _answer_pairs(rows: list[dict], samples: int) -> Iterator[dict]:
    """For each note or question: occurrences of its pairs, and their tables in each sample."""
    names, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for r in rows:
        if r["kind"] == "counts":
            n = _unsized(r["data"][0])
        elif r["kind"] == "pack":
            words, word, context, n = _pairs(r["data"])
            names = _pair_key(words[word], words[context])
    columns = [n]
    for r in sorted((r for r in rows if r["kind"] == "seats"), key=lambda r: r["peer"]):
        columns.append(np.ones(len(n), np.int64))
        columns[-1][n > 1] = _wide(r["data"][0], int((n > 1).sum()))
    columns += [n] * (1 + samples - len(columns))  # nothing was seated
    for r in rows:
        if r["kind"] == "has":
            has = np.unpackbits(np.frombuffer(r["data"][0], np.uint8), count=r["numbers"][0]).astype(bool)
            at = np.cumsum(_unsized(r["data"][1]))
            found = np.zeros((len(columns), len(has)), np.int64)
            for f, c in zip(found, columns):
                f[has] = c[at]
            yield _row(r["peer"], "pairs", r["bucket"], [_narrow(f) for f in found], [len(has)])
    order = np.argsort(names)
    yield from _look_up(rows, "ask pairs", "pairs", names[order], [c[order] for c in columns], _hashes)


def _look_up(rows: list[dict], kind: str, answer: str, names: np.ndarray, columns: list[np.ndarray], asked=_names) -> Iterator[dict]:
    for r in rows:
        if r["kind"] == kind:
            want = asked(r["data"][0])
            at = np.minimum(np.searchsorted(names, want), max(0, len(names) - 1))
            has = names[at] == want if len(names) else np.zeros(len(want), bool)
            found = [np.where(has, c[at], 0) if len(names) else np.zeros(len(want), np.int64) for c in columns]
            yield _row(r["peer"], answer, r["bucket"], [_narrow(c) for c in found], [len(want)])


def word_logs(model: Model, totals: list[tuple[int, int]], pairs: WordPairs, words: list[np.ndarray], found: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of the pairs, averaged over the samples, from the answers to their block."""
    total = np.zeros(len(pairs.word))
    for k, t in enumerate(totals):
        customers, root, tables = words[1 + 3 * k : 4 + 3 * k]
        about = _root(model, Totals(None, None, *t), customers, root)[pairs.word]
        own = found[0] - model.discount * found[1 + k]
        total += (own + (model.strength + model.discount * tables[pairs.context]) * about) / (model.strength + words[0][pairs.context])
    return np.log10(total / len(totals))


def score_words(docs: DataFrame, buckets: int, burn: int, samples: int, seed: int) -> DataFrame:
    blocks = cut(number_texts(docs), "texts")
    counted = _cut(count_blocks(blocks, buckets), "counts")
    model, totals, trained = train_words(counted.filter("kind = 'pack'"), buckets, burn, samples, seed)
    notes = cut(counted.filter("kind in ('counts', 'has')"), "notes")
    _drop(counted)
    kind, n = docs.dtypes[0][1], len(totals)

    def ask(row: dict) -> Iterator[dict]:
        yield from _sent(_names(row["names"]), [], "ask words", row["block"], buckets, [])

    def answer(rows: list[dict]) -> Iterator[dict]:
        yield from _answer_words(rows, n)
        yield from _answer_pairs(rows, n)

    def add(table: pa.Table, replies: pa.Table) -> pa.Table:
        release_memory()  # of the block before
        row = table.to_pylist()[0]
        pairs, sizes = _block_pairs(row, buckets)
        got = sorted(replies.to_pylist(), key=lambda r: r["peer"])
        words, found = ([np.concatenate(c) for c in zip(*([_wide(x, r["numbers"][0]) for x in r["data"]] for r in got if r["kind"] == k))] for k in ("words", "pairs"))
        c = words[0]  # of each word
        base = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
        first = np.append(0, np.cumsum(sizes)[:-1])
        logs = word_logs(model, totals, pairs, words, found)
        sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64)[pairs.number], base[pairs.number], logs[pairs.place])]
        return _scored(_ids(row), sizes, model, sums)

    rows = notes.unionByName(blocks.select("block", "names").mapInArrow(_mapped(ask), ROW_SQL))
    replies = _gather(rows if trained is None else rows.unionByName(trained), answer).withColumnRenamed("bucket", "block")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(add, SCORED_SQL.format(kind))


SCORED_SQL = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(table: pa.Table, sizes: np.ndarray, model: Model, sums: list[np.ndarray]) -> pa.Table:
    return pa.table({"doc_id": table["doc_id"], "held_out": pa.array([is_held_out(x) for x in table["doc_id"].to_pylist()], pa.bool_()),
                     "n_tokens": pa.array(sizes), "n_known": pa.array(sums[0]), "train_tokens": pa.array(np.full(len(sizes), model.tokens, np.int64)),
                     "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int | None = None, burn: int = 1, samples: int = 2, seed: int = 1) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``classes``: contexts are that many classes of the word before instead of the word itself.
    """
    if classes is not None and not 2 <= classes <= 256:
        raise ValueError("classes must lie between 2 and 256")
    docs = pick(df, doc_id=id_col, _text=text_col)
    total = docs.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    blocks = max(1, total // BLOCK_BYTES)
    if classes is None:
        return score_words(docs, blocks, burn, samples, seed)
    packs = cut(count_pairs(docs, classes, blocks), "counts")
    model, before, after = train(packs, classes, burn, samples, seed)
    placed = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(blocks))).repartition(shuffle_width(df.sparkSession), "block")
    kind = docs.dtypes[0][1]

    def read(table: pa.Table) -> tuple[Pairs, np.ndarray]:
        release_memory()  # of the block before
        tokens, sizes = Tokens(classes), []
        for b in table.select(["_text"]).to_batches():
            for _, texts in texts_by_bytes(b, "_text", 1 << 20):
                sizes.append(tokens.add(texts))
        return Pairs.of(tokens, blocks), np.concatenate(sizes)

    def ask(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        rows = [{**r, "counts": b"", "block": block} for r in read(table)[0].packed()]
        return pa.Table.from_pylist(rows, pa.schema({**PACK, "block": pa.int64()}))

    def answer(asked: pa.Table, trained: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        found = predict(model, before, after, burn, seed, rows[0]["bucket"], (trained.to_pylist() or [None])[0], rows) if rows else []
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int64()),
                         "freq": pa.array([f for f, _ in found], pa.binary()), "logs": pa.array([x for _, x in found], pa.binary())})

    def add(table: pa.Table, replies: pa.Table) -> pa.Table:
        pairs, sizes = read(table)
        got = sorted(replies.select(["bucket", "freq", "logs"]).to_pylist(), key=lambda r: r["bucket"])
        freq = np.frombuffer(b"".join(r["freq"] for r in got), "<i8")
        logs = np.frombuffer(b"".join(r["logs"] for r in got), "<f4").astype(float)
        c = np.repeat(freq, np.diff(np.append(pairs.start, len(pairs.context))))[pairs.place]  # of each token
        base = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
        first = np.append(0, np.cumsum(sizes)[:-1])
        sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), base, logs[pairs.place])]
        return _scored(table, sizes, model, sums)

    asked = placed.groupBy("block").applyInArrow(ask, PACK_SQL + ", block long")
    replies = asked.groupBy("bucket").cogroup(packs.groupBy("bucket")).applyInArrow(answer, "block long, bucket long, freq binary, logs binary")
    return placed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        add, SCORED_SQL.format(kind))
