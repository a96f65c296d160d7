"""Importance resampling, substring dedup and conversation repair against brute force in plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sondage.llm import relative, repair, resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    """Documents with a column more, whose name the operators might use themselves."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("n_words", F.lit(None).cast("int"))


# --- importance resampling ------------------------------------------------------------------


def features(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def resampled(docs, bench, buckets, percent, least=20):
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for w in features(text):
            s[bucket(w)] += 1
    for text in bench:
        for w in features(text):
            t[bucket(w)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = features(text)
        weight = math.floor(sum(gain[bucket(w)] for w in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0]))
    drawn = {r[0]: k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return {(*r, drawn.get(r[0])) for r in rows}


def test_resampling_equals_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(60)] + ["Ärger", "9x", "日本", "A-B"]
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, "\n.,;"), (503, "one " * 5000), (504, rows[3][1])]
    bench = [" ".join(rnd.choices(words[:20], k=30)) for _ in range(5)] + [None, ""]
    got = resample.resample(docs_of(spark, rows), spark.createDataFrame([(k, x) for k, x in enumerate(bench)], "item_id long, text string"),
                            n=1, buckets=500, percent=10)
    assert {(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()} == resampled(rows, bench, 500, 10)


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(docs_of(spark, []), empty, n=1, buckets=100, percent=10).collect() == []
    one = resample.resample(docs_of(spark, [(1, "a b")]), empty, n=1, buckets=100, percent=10).collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in one] == [(1, 2, None)]


# --- substring dedup --------------------------------------------------------------------------


def deduplicated(docs, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", text or "") for i, text in docs}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = set()
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.add((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed,kinds", [(1, 2), (2, 5), (3, 400)])
def test_substrings_equal_brute_force(spark, seed, kinds):
    """Few different words give windows over factor borders, repeats within a document and phrases met everywhere."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(kinds)] + ["é"]
    passages = [" ".join(rnd.choices(words, k=rnd.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(rnd.choices(words, k=rnd.randint(0, 25))), rnd.choice(passages)]
        if rnd.random() < 0.5:
            parts.append(rnd.choice(passages))
        rnd.shuffle(parts)
        rows.append((i - 3, rnd.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, passages[0]), (904, (passages[1] + " ") * 300)]
    got = relative.report(docs_of(spark, rows), window=13)
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == deduplicated(rows, 13)


def test_substrings_of_nothing(spark):
    assert relative.report(docs_of(spark, []), window=13).collect() == []


# --- conversation repair ------------------------------------------------------------------------


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Every edit of a short conversation: (cost, audit, repaired rows), the cheapest, then the ASCII-least audit."""
    faults, best = faults_of(rows), None
    inserts = [list(x) for n in range(3) for x in itertools.product("ua", repeat=n)]
    names = {"u": "user", "a": "assistant"}
    options = []
    for (role, text), fault in zip(rows, faults):
        o = [(2, "D", [])]
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            o += [(more, "K", [(role[:1], role, text)]), *((1 + more, "R", [(x, names[x], text)]) for x in "ua")]
        options.append(o)
    for edits in itertools.product(*options):
        for ins in itertools.product(inserts, repeat=len(rows) + 1):
            out, audit, cost = [], "", 0
            for k, extra in enumerate(ins):
                out += [(x, names[x], "") for x in extra]
                audit, cost = audit + "I" * len(extra), cost + 5 * len(extra)
                if k < len(rows):
                    out, audit, cost = out + edits[k][2], audit + edits[k][1], cost + edits[k][0]
            if re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in out)):
                said = (cost, audit, "\n".join(f"{r}:{t}" for _, r, t in out))
                best = said if best is None or said[:2] < best[:2] else best
    return best


def repaired(talk):
    rows = [(role or " ", text if text is not None else " ") for _, role, text in talk]
    turns = {t for t, _, _ in talk if t is not None}
    faults = faults_of(rows)
    cost, audit, text = cheapest(rows) if rows else (0, "", "")
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_repair_equals_all_edits(spark):
    """Conversations of up to three rows, every edit tried; damage is left out, so the rows are what they are."""
    rnd = random.Random(4)
    talks = {}
    for c in range(60):
        turns = sorted(rnd.sample(range(6), rnd.randint(1, 3)))
        talks[c] = [(t, rnd.choice(["user", "assistant", "system", "user", "tool"]), rnd.choice(["a.", "b!", "cut", "", " \n", "ü?"])) for t in turns]
    rows = [(c, t, r, x, "other") for c, talk in talks.items() for t, r, x in talk]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, cost string")
    got = repair.report(table, ids=table).collect()
    have = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert have == {c: repaired(talk) for c, talk in talks.items()}


def test_repair_of_lost_and_empty(spark):
    ids = spark.createDataFrame([(1,), (2,)], "conv_id long")
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    got = repair.report(repair.damage(none), ids=ids).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.conv_id, r.gaps, r.cost, r.audit, r.repaired_sha256) for r in got) == [(1, 0, 0, "", empty), (2, 0, 0, "", empty)]
    assert repair.report(repair.damage(none), ids=none).collect() == []


def test_damage_by_the_rule(spark):
    """Each kind of damage by crc32 of id and turn; nulls are one space."""
    rows = [(c, t, "assistant", "One. Two!") for c in range(12) for t in range(8)] + [(None, None, None, None)]
    expected = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if k == 4 else role or " ", "" if k == 1 else (text or " ").translate({46: None, 33: None, 63: None}) if k == 2 else text or " ")
        expected += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    got = repair.damage(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.conv_id, r.turn, r.role, r.text) for r in got.collect()), key=key) == sorted(expected, key=key)
