import math
import pathlib
import zlib
from collections import Counter

import numpy as np
import pytest

from sondage.llm import hpylm
from sondage.session import checkpoint_dir

SCHEMA = "doc_id long, text string, block long, held_out string"


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def corpus(n=300):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        lang = "ab" if i % 2 else "xy"  # two languages with endings of their own
        words = ["".join(rng.choice(list(lang + "e"), rng.integers(1, 5))) + lang[-1] for _ in range(rng.integers(5, 60))]
        rows.append((i, " ".join(words)))
    return rows + [(1000, None), (1001, ""), (1002, "NEVER seen before"), (None, "no id"), (5, "twice"), (5, "twice"), (1003, "ab " * 30_000)]


def test_counts_and_base_score(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    old = hpylm.BLOCK_BYTES, hpylm.HELD
    hpylm.BLOCK_BYTES, hpylm.HELD = 3_000, 500  # many blocks, buckets and packs
    try:
        out = hpylm.score(df)
        got = sorted((tuple(r) for r in out.collect()), key=repr)
        again = sorted((tuple(r) for r in hpylm.score(df).collect()), key=repr)
    finally:
        hpylm.BLOCK_BYTES, hpylm.HELD = old
    assert got == again  # sampling is seeded
    count = Counter(w for i, t in rows if not held_out(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held_out(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n,
                    sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t in rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9) for g, w in zip(got, want))
    held = [g for g in got if g[1] and g[0] is not None and g[0] < 1000]
    assert sum(g[6] for g in held) > sum(g[5] for g in held) * 0.95  # nearer to zero than the base


@pytest.mark.parametrize("held", [False, True])
def test_probabilities_sum_to_one(spark, held):
    """Over the vocabulary and the one unknown word, in every context, with and without training text."""
    rows = [(i, t) for i, t in corpus(60) if held_out(i) == held][:40]
    df = spark.createDataFrame(rows, "doc_id long, _text string")
    packs = hpylm.count_pairs(df, 8, 1)
    model, before, after = hpylm.train(packs, 8, 1, 2, 1)
    trained = (packs.toPandas().to_dict("records") or [None])[0]
    words = np.append(np.frombuffer(trained["words"], "<u8") if trained else [], np.uint64(12345)).astype(np.uint64)
    n = len(words)
    ask = {"words": words.astype("<u8").tobytes(), "sizes": np.full(n, 8, "<u2").tobytes(), "contexts": bytes([*range(8)] * n), "counts": b""}
    [(freq, logs)] = hpylm.predict(model, before, after, 1, 1, 0, trained, [ask])
    p = 10 ** np.frombuffer(logs, "<f4").astype(float).reshape(n, 8)
    assert np.allclose(p.sum(0), 1, atol=2e-3) and (p > 0).all()
    assert np.frombuffer(freq, "<i8").sum() == model.tokens


def exact_tables(c, weight, d):
    """Posterior mean of tables of a dish with c customers: weights w^t S(c, t) over (w + ...), by recursion on seatings."""
    s = {1: 1.0}
    for n in range(1, c):
        nxt = Counter()
        for t, x in s.items():
            nxt[t] += x * (n - d * t)
            nxt[t + 1] += x
        s = nxt
    total = sum(x * weight**t for t, x in s.items())
    return sum(t * x * weight**t for t, x in s.items()) / total


@pytest.mark.parametrize("c,weight,d", [(2, 0.5, 0.5), (5, 1.0, 0.7), (12, 3.0, 0.4)])
def test_gibbs_reaches_the_posterior(c, weight, d):
    """Many steps on many equal dishes: the mean number of tables is the exact one."""
    got = hpylm.seat(np.full(4000, c), np.full(4000, weight), d, np.random.default_rng(1), 12 * c).mean()
    assert abs(got - exact_tables(c, weight, d)) < 0.06 * exact_tables(c, weight, d)


def test_seating_bounds():
    c = np.array([1, 2, 3, 127, 128, 129, 5_000_000_000])
    t = hpylm.seat(c, np.full(len(c), 0.01), 0.6, np.random.default_rng(2), 20)
    assert (t >= 1).all() and (t <= c).all() and t[0] == 1
    assert len(hpylm.seat(np.zeros(0, np.int64), np.zeros(0), 0.5, np.random.default_rng(1), 3)) == 0


def test_empty_tables(spark):
    assert hpylm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    only = hpylm.score(spark.createDataFrame([(None, "a b", 0, "")], SCHEMA)).collect()[0]
    assert (only["n_tokens"], only["n_known"], only["train_tokens"]) == (3, 0, 0) and math.isclose(only["score"], 0, abs_tol=1e-6)


def test_whole_words_are_contexts(spark):
    """Words with one ending lead to different words: only the whole word before tells which, however many words there are."""
    rng = np.random.default_rng(5)
    names = [f"{a}{b}{c}ing" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]  # 512 contexts, one ending
    rows = [(i, " ".join(f"{names[k]} after{names[k]}x" for k in rng.integers(0, len(names), 60))) for i in range(200)]
    got = hpylm.score(spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)).collect()
    held = [g for g in got if g["held_out"]]
    tokens = sum(g["n_tokens"] for g in held)
    assert len(held) > 10 and sum(g["score"] for g in held) / tokens > -0.5 * math.log10(512) - 0.3
    assert sum(g["base_score"] for g in held) / tokens < -2.5


@pytest.mark.parametrize("blocks", [1, 7])
def test_word_contexts_sum_to_one(spark, blocks):
    """After every word, the beginning and an unknown word: over the vocabulary and the one unknown word."""
    rows = [(i, t) for i, t in corpus(60) if not held_out(i)][:40]
    df = spark.createDataFrame(rows, "doc_id long, _text string")
    packs = hpylm.cut(hpylm.count_words(df, blocks), "counts")
    model, totals, trained = hpylm.train_words(packs, blocks, 1, 2, 1)
    state = [r.asDict() for r in trained.collect()]
    packed = [r.asDict() for r in packs.collect()]
    words = np.unique(np.concatenate([np.frombuffer(r["data"][0], "<u8") for r in state if r["kind"] == "base"] + [np.array([12345], np.uint64)]))
    count = Counter()
    for i, t in rows:
        for w in tokens(t):
            count[w] += 1
    assert len(words) == len(count) + 1 == model.vocabulary + 1 and model.tokens == sum(count.values())
    n = len(words)
    w, u = np.divmod(np.arange(n * n), n)
    key = hpylm._pair_key(words[w], words[u])
    order = np.argsort(key)
    pairs = hpylm.WordPairs(words, w[order], u[order], key[order], hpylm._range(key[order], blocks), None, None, None)
    ask = list(pairs.questions(0, blocks))
    answers = [[], []]
    for k in range(blocks):
        mine = [r for r in ask + state + packed if r["bucket"] == k]
        answers[0] += hpylm._answer_words(mine, len(totals))
        answers[1] += hpylm._answer_pairs(mine, len(totals))
    of_words, found = ([np.concatenate(c) for c in zip(*([hpylm._wide(x, r["numbers"][0]) for x in r["data"]] for r in a))] for a in answers)
    p = np.zeros((n, n))
    p[pairs.word, pairs.context] = 10 ** hpylm.word_logs(model, totals, pairs, of_words, found)
    assert np.allclose(p.sum(0), 1, atol=1e-9) and (p > 0).all()


def test_notes_answer_as_questions_do(spark):
    """What a bucket noted of a block while counting gives the answers that the block's own questions by hash give."""
    rows = corpus(80)
    df = spark.createDataFrame(rows, "doc_id long, _text string").repartition(3)
    old = hpylm.BLOCK_BYTES
    hpylm.BLOCK_BYTES = 3_000
    try:
        blocks = hpylm.cut(hpylm.number_texts(df), "texts")
    finally:
        hpylm.BLOCK_BYTES = old
    counted = hpylm.cut(hpylm.count_blocks(blocks, 4), "counts")
    model, totals, trained = hpylm.train_words(counted.filter("kind = 'pack'"), 4, 1, 2, 1)
    counted, trained, texts = ([r.asDict() for r in x.collect()] for x in (counted, trained, blocks))
    assert len(texts) > 4 and sorted(map(str, (i for r in texts for i in hpylm._ids(r)["doc_id"].to_pylist()))) == sorted(str(i) for i, _ in rows)
    unknown = 0
    for r in texts:
        pairs, sizes = hpylm._block_pairs(r, 4)
        assert len(pairs.number) == sizes.sum()
        ask = list(pairs.questions(r["block"], 4))
        for k in range(4):
            mine = [x for x in counted + trained if x["bucket"] == k]
            seats = [x for x in mine if x["kind"] == "seats"]
            by_note = list(hpylm._answer_pairs([x for x in mine if x["kind"] == "counts" or x["kind"] == "has" and x["peer"] == r["block"]] + seats, 2))
            by_hash = list(hpylm._answer_pairs([x for x in mine if x["kind"] == "pack"] + [x for x in ask if x["bucket"] == k] + seats, 2))
            assert by_note == by_hash and len(by_note) <= 1
            unknown += sum(int((hpylm._wide(x["data"][0], x["numbers"][0]) == 0).sum()) for x in by_note)
    assert unknown > 0  # of held-out documents


def test_disk_on_the_way(spark):
    """No shuffle file of the training and no spent table stays, and notes take less than a quarter of the hashes of their pairs."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.3, 400) % 100_000)) for i in range(400)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {p: p.stat().st_size for d in local for p in pathlib.Path(d).rglob("shuffle_*.data")}
    shared = pathlib.Path(checkpoint_dir(spark).removeprefix("file:"))
    old, before, tables = hpylm.BLOCK_BYTES, set(shuffled()), set(shared.glob("llm-*/*"))
    hpylm.BLOCK_BYTES = 100_000
    try:
        out = hpylm.score(df)
        left = sum(n for p, n in shuffled().items() if p not in before)
        tables = sorted(p.name for p in set(shared.glob("llm-*/*")) - tables)
        assert out.count() == len(rows)
        blocks = hpylm.number_texts(hpylm.pick(df, doc_id="doc_id", _text="text"))
        has = hpylm.count_blocks(blocks, 4).filter("kind = 'has'").collect()
    finally:
        hpylm.BLOCK_BYTES = old
    assert tables == ["notes", "seats", "seats", "states", "states", "texts", "words"]
    assert left < 0.05 * sum(len(t) for _, t in rows)  # totals only
    assert sum(len(x) for r in has for x in r["data"]) < 2 * sum(r["numbers"][0] for r in has)
