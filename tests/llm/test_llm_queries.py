"""The registered queries against DuckDB or brute force on the smallest tables, and the pipeline."""

import math
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF_SMALL
from sondage.llm import registry, vocab
from sondage.llm.sql import LOWER, quality_sql, similar_sql


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def rows(df):
    norm = lambda v: list(v) if hasattr(v, "__len__") and not isinstance(v, str) else v.item() if hasattr(v, "item") else v
    return sorted(repr([norm(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


def test_registered():
    names = list(registry.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(names) | {"pipeline"} <= set(entry.queries()) and set(registry.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    assert rows(got) == rows(con.execute(registry.ORACLE[name]).df())


def documents(con):
    return con.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def test_token_ids(spark, con):
    lib, at = vocab.load_json(P.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: r for r in registry.op6_token_ids(spark, SF_SMALL).collect()}
    for i, t in documents(con):
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_byte_bpe(spark, con):
    import hashlib

    import tiktoken
    ranks = {t: i for i, t in enumerate(vocab.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {(i, len(ids := own.encode_ordinary(t)), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, t in documents(con)}
    assert {tuple(r) for r in registry.op7_byte_bpe(spark, SF_SMALL).collect()} == want


def test_scores(spark, con):
    got = registry.op4_lm_scoring(spark, SF_SMALL).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in documents(con)}
    held = [r for r in got if r["held_out"]]
    per_token = lambda c: -sum(r[c] for r in held) / sum(r["n_tokens"] for r in held)
    assert per_token("score") < per_token("base_score")
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_warc(spark, con):
    got = registry.op9_warc_derivatives(spark, SF_SMALL).collect()
    pages = con.execute("SELECT count(*) FROM pages").fetchall()[0][0]
    assert len(got) == 2 * pages == len({r["record_id"] for r in got}) and all(r["digest_agrees"] for r in got)
    assert {r["page_id"] for r in got if r["type"] == "metadata"} == {r[0] for r in con.execute("SELECT page_id FROM pages").fetchall()}


def packed_whole(got, docs):
    lib = vocab.load_json(P.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == {i for i, _ in docs}
    for i, t in docs:
        ids, at = np.array(lib.encode(t, add_special_tokens=False).ids + [2], "<u4"), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for items in by_seq.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 1024
    return len(by_seq)


def test_packing(spark, con):
    got = registry.op10_best_fit_packing(spark, SF_SMALL).collect()
    used = packed_whole(got, documents(con))
    assert used <= 1.02 * sum(r["length"] for r in got) / 1024 + 1


def test_pipeline(spark, con):
    """Stages 1 to 3 by SQL, one after the other; the packing of what they keep by its invariants."""
    con.execute("CREATE OR REPLACE TEMP TABLE one AS SELECT d.* FROM documents d JOIN (" + quality_sql() + ") q USING (doc_id) WHERE kept")
    con.execute(f"CREATE OR REPLACE TEMP TABLE two AS SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY {LOWER.format('coalesce(text, chr(0))')} ORDER BY doc_id) = 1")
    con.execute("CREATE OR REPLACE TEMP TABLE three AS SELECT t.* FROM two t JOIN (" + similar_sql().replace("documents", "two") + ") s USING (doc_id) WHERE doc_id = component_id")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for (name, stage), table in zip(corpus_pipeline.STAGES, ("one", "two", "three")):
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        want = con.execute(f"SELECT * FROM {table}").df()
        assert rows(out.toPandas()) == rows(want), name
        docs = spark.createDataFrame(want, docs.schema)
    n = {t: con.execute(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("documents", "one", "two", "three")}
    assert n["documents"] > n["one"] > n["two"] > n["three"] > 0
    packed_whole(corpus_pipeline.run(spark, SF_SMALL).collect(), con.execute("SELECT doc_id, text FROM three").fetchall())


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string"
    text = " ".join(f"word{k} {k % 7}" for k in range(60))
    odd = [(1, text, "en", None, 1, 0, ""), (1, text, "en", None, 1, 0, ""), (None, text.upper(), "en", "s", 1, 0, ""), (2, None, None, None, None, None, None),
           (3, "", "en", "s", 0, 0, ""), (4, text + " " + "long " * 10 + " ".join(map(str, range(100_000))), "en", "s", 1, 0, "")]
    for table, want in ((odd, {1, 4}), ([], set())):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_SMALL)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == schema.replace(",", "").split(" ")[::2], name
        assert {r["doc_id"] for r in docs.collect()} == want
