import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sondage.llm import hashing, jaccard
from sondage.llm.components import components
from sondage.llm.jaccard import Bands, keep_one, shingles, signatures, similar_documents

SCHEMA = "doc_id long, text string, key string, size int"


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return sorted(((d, len(sets[i]), best.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdef", k=rnd.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \n\t ", "one", "ONE", "one two", "a b c d e", "A  b\nc d E", "a b c d e f", "É b c d e f", "é b c d e f"]
    for size in (6, 12, 30, 60, 120, 130, 250, 500, 1100):
        for _ in range(3):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for edits in (1, max(1, size // 60), max(1, size // 35), max(1, size // 30), size // 10):
                w = list(base)
                for _ in range(edits):
                    at = rnd.randrange(len(w))
                    w[at : at + rnd.randint(0, 1)] = [word()]
                texts.append(" ".join(w))
            texts.append(" ".join(base[: int(size * 0.8)]))
            texts.append(passage + " " + " ".join(word() for _ in range(size)))
    chain = [word() for _ in range(200)]  # each like the next, the ends unlike
    for k in range(0, 160, 20):
        texts.append(" ".join(chain[:k] + [w + "x" for w in chain[k : k + 8]] + chain[k + 8 :]))
    walk = list(chain)
    for k in range(0, 200, 14):
        walk[k : k + 10] = [word() for _ in range(10)]
        texts.append(" ".join(walk))
    rows = [(3 * i + 11, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows + [rows[20]] * 3 + [(None, texts[30]), (None, "alone without id of any kind"), (2, texts[40].upper())]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], SCHEMA)
    old = jaccard.BLOCK_BYTES, jaccard.BUCKET_SIGNATURES
    jaccard.BLOCK_BYTES, jaccard.BUCKET_SIGNATURES = 20_000, 2_000  # many blocks and buckets
    try:
        got = sorted(map(tuple, similar_documents(df).collect()), key=repr)
    finally:
        jaccard.BLOCK_BYTES, jaccard.BUCKET_SIGNATURES = old
    assert got == brute(rows)
    linked = [g for g in got if g[0] != g[2]]
    assert len(linked) > 80


def test_one_of_each_stays(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], SCHEMA)
    left = keep_one(df).collect()
    want = {d for d, _, c in brute(rows) if d == c}
    assert {r["doc_id"] for r in left} == want and len(left) == len({(r["doc_id"], r["text"]) for r in left})
    assert keep_one(df).columns == df.columns


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert similar_documents(df).count() == 0 and keep_one(df).count() == 0
    only = spark.createDataFrame([(4, None, "", 1), (3, "", "", 1), (4, None, "", 1)], SCHEMA)
    assert sorted(map(tuple, similar_documents(only).collect())) == [(3, 0, 3), (4, 0, 4), (4, 0, 4)]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 900), st.floats(0, 1), st.floats(0, 1), st.integers(0, 2**31))
def test_similar_sets_share_a_signature_among_the_first(size, drop, add, seed):
    """Any order of signatures will do: here a hash."""
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, size, np.uint64))
    gone = int(drop * 0.25 * len(a))
    more = int(add * (len(a) - gone) / 0.75) - len(a)
    b = np.unique(np.append(rng.permutation(a)[gone:], rng.integers(0, 2**64, max(0, more), np.uint64)))
    bands, same = Bands(75), len(np.intersect1d(a, b))
    if 100 * same < 75 * (len(a) + len(b) - same):
        return
    first = []
    for x in (a, b):
        got = {}
        for band, allowed in bands.instances(len(x)):
            sig = signatures(x, band)
            assert len(sig) > allowed
            got[band] = set(np.sort(sig)[: allowed + 1].tolist())
        first.append(got)
    assert any(first[0][band] & first[1].get(band, set()) for band in first[0])


def test_shingles(monkeypatch):
    rnd = random.Random(3)
    line = lambda words: b" ".join(words)
    for words in ([], [b"a"], [b"a"] * 9, [b"%d" % (i % 40) for i in range(400)], [bytes([rnd.randrange(33, 256) for _ in range(rnd.randint(1, 9))]) for _ in range(500)]):
        text = line(words)
        want = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        got = shingles(text, 5)
        assert len(got) == len(want) and (np.diff(got.astype(float)) > 0).all()
        for stretch in (1, 7, 64):  # how a text is cut changes nothing
            monkeypatch.setattr(hashing, "STRETCH", stretch)
            assert (shingles(text, 5) == got).all()
        monkeypatch.setattr(hashing, "STRETCH", 1 << 18)
    several = [line(w) for w in ([b"a", b"b"], [b"b", b"a"], [b"a"], [b"ab"], [b"a", b"b", b"c", b"d", b"e"], [b"e", b"d", b"c", b"b", b"a"], [b"a", b"b", b"c", b"d", b"f"])]
    assert len(np.unique(np.concatenate([shingles(x, 5) for x in several]))) == len(several)
    shared = np.intersect1d(shingles(b"x y a b c d e z", 5), shingles(b"longer words a b c d e", 5))
    assert len(shared) == 1 and shared[0] == shingles(b"a b c d e", 5)[0]


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (200, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
