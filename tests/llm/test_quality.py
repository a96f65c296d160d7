import random
from collections import Counter

import duckdb

from sondage.llm import quality
from sondage.llm.sql import quality_sql

SCHEMA = "doc_id long, text string, source string, n_words string, host string"


def brute(text):
    words = (text or "").encode().split()
    grams = list(zip(words, words[1:], words[2:]))
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.encode().split() and x in lines[:i])
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def corpus():
    rnd = random.Random(5)
    good = lambda: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8))) for _ in range(80))
    table = lambda: " ".join(rnd.choice(["|", "ab", "#x"]) + rnd.choice("abcdefgh") * rnd.randint(1, 5) for _ in range(80))
    rows = [(i, good(), "fine") for i in range(40)] + [(100 + i, table(), "fine") for i in range(3)]
    rows += [(200 + i, table(), "broken") for i in range(30)] + [(300 + i, good(), "broken") for i in range(3)]
    rows += [(400, None, None), (401, "", None), (402, "a a a a a", "fine"), (403, "é x\n\né x\n \n \nb " * 40, None), (404, "spam ham " * 100, "fine"),
             (405, good() + "\n" + "word " * 200_000, "fine"), (406, table(), "small")]
    return rows


def test_measures(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = {r["doc_id"]: r for r in quality.measure(df).collect()}
    for i, t, _ in rows:
        if i != 405:  # quadratic in lines and words
            assert tuple(got[i][n] for n in quality.MEASURES) == brute(t), i


def test_verdicts_match_sql_and_spare_clean_documents(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert got[200]["host_broken"] == ["symbols"] and not got[200]["base_failed"] and not got[200]["kept"]
    assert got[100]["kept"] and all(got[300 + i]["kept"] for i in range(3)) and all(got[i]["kept"] for i in range(40))
    assert got[400]["base_failed"] and not got[402]["kept"] and not got[404]["kept"]
    con = duckdb.connect()
    docs = df.toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT doc_id, text, source FROM docs WHERE doc_id <> 405")
    some = {r["doc_id"]: r for r in quality.judge(df.filter("doc_id <> 405")).collect()}
    for r in con.execute(quality_sql()).df().to_dict("records"):
        assert {k: list(v) if k == "host_broken" else v for k, v in r.items()} == some[r["doc_id"]].asDict()


def test_whole_rows_stay(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in corpus()] + [(7, "one " * 3, "z", None, None)] * 2, SCHEMA)
    kept = {r["doc_id"] for r in quality.judge(df).filter("kept").collect()}
    left = quality.keep_good(df)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == kept
    old, quality.BROADCAST_HOSTS = quality.BROADCAST_HOSTS, 0  # the way beyond the broadcast
    try:
        assert {r["doc_id"] for r in quality.keep_good(df).collect()} == kept
    finally:
        quality.BROADCAST_HOSTS = old
    assert quality.keep_good(df.limit(0)).count() == 0 and quality.judge(df.limit(0)).count() == 0


def test_prior_shrinks_small_hosts(spark):
    hosts = quality.host_verdicts(quality.measure(spark.createDataFrame([(*r, "x", "y") for r in corpus()], SCHEMA)))
    rate = {r["host"]: r["symbols_rate"] for r in hosts.collect()}
    assert 3 / 47 < rate["fine"] < 0.2 < rate["small"] < 30 / 33 < 1 and 0.8 < rate["broken"] < 30 / 33
    a, b = quality.beta_prior(10, 0.2, 0.05, 0.01)
    assert abs(a / (a + b) - 0.2) < 1e-9 and abs(a + b - (0.16 / 0.04 - 1)) < 1e-9
    assert sum(quality.beta_prior(10, 0.2, 0.001, 0.01)) == 1e6
    assert quality.beta_prior(0, None, None, None) == (1.0, 1.0)
