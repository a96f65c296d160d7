import hashlib
import random

import pytest

from sondage.llm.exact import drop_copies, exact_groups

SCHEMA = "doc_id long, text string, _head string, kept string"


def brute(rows, keep):
    groups = {}
    lower = lambda t: bytes((t or "").encode()).lower()
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        best = (max if keep == "largest" else min)(ids) if ids else None
        out.append((i, best, len(groups[lower(t)]), hashlib.sha256(lower(t)).hexdigest()))
    return sorted(out, key=repr), len(groups)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("width", ["3", "40"])
def test_matches_brute_force(spark, keep, width):
    """Nulls, empty texts, non-ASCII case, ties, repeated rows, a very common and a very long text; many narrow ranges."""
    rnd = random.Random(width + keep)
    texts = [None, "", "a", "A", "É", "é", "b" * 300_000, "B" * 300_000, *("x" * 32 + c for c in "abAB")]
    rows = [(i, rnd.choice(texts)) for i in range(300)] + [(i, "common") for i in range(300, 500)]
    rows += [(7, "same row")] * 3 + [(None, "null id"), (None, "null id"), (9, "NULL ID"), (None, "alone")]
    df = spark.createDataFrame([(i, t, "h", "k") for i, t in rows], SCHEMA)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        got = [tuple(r) for r in exact_groups(df, keep=keep).select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()]
        left = [tuple(r) for r in drop_copies(df, keep=keep).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want, groups = brute(rows, keep)
    assert sorted([g[:4] for g in got], key=repr) == want
    assert sum(g[4] for g in got) == groups == len(left)
    assert {g[3] for g in got if g[4]} == {w[3] for w in want}
    assert all(g[0] == g[1] for g in got if g[4])
    assert all(len(r) == 4 and r[2:] == ("h", "k") for r in left)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_groups(df).count() == 0 and drop_copies(df).columns == df.columns and drop_copies(df).count() == 0
